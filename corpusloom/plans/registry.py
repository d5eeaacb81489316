"""All queries of the library by name, and the SQL that each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import articles, chunking, documents as docs, indexing, normalize, postings, queues, report, retrieval
from corpusloom.session import kept, own_dir
from corpusloom.sources.tables import PAGE, latest_posts, live_posts, table
from corpusloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The query of the retrieval examples, their filters, and the time that splits old from new. Fixed values.
ASKED, CUT, SOURCE = "the open model and the narrow network", "2022-01-01", "post"

_LATEST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY ingested_at DESC, last_seen_at DESC) AS rn FROM bookmarks) WHERE rn = 1"
_LIVE = f"SELECT * FROM ({_LATEST}) WHERE removed_at IS NULL"
_WS = r"[\s\x0b\x{85}\p{Z}]"
_STRIP = rf"^{_WS}+|{_WS}+$"


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _live(spark: SparkSession, d: str) -> DataFrame:
    return live_posts(table(spark, d, "bookmarks"))


def _vector(vectors: DataFrame) -> list[float]:
    """The vector of the smallest usable id, as the query of the examples."""
    return list(vectors.agg(F.min_by("embedding", "chunk_id")).first()[0] or [0.0] * 768)


# ---- posts ----


@_query(f"""
    SELECT p.tweet_id, w.captured_at, w.last_seen_at, p.favorite_count, p.lang, p.removed_at
    FROM ({_LATEST}) p JOIN (SELECT tweet_id, min(captured_at) AS captured_at, max(last_seen_at) AS last_seen_at FROM bookmarks GROUP BY 1) w USING (tweet_id)""")
def posts_upserted(spark, d):
    return latest_posts(table(spark, d, "bookmarks")).select("tweet_id", "captured_at", "last_seen_at", "favorite_count", "lang", "removed_at")


@_query(f"SELECT tweet_id, '2030-01-01T00:00:00+00:00' AS removed_at FROM ({_LIVE}) WHERE tweet_id NOT IN (SELECT tweet_id FROM bookmarks WHERE last_seen_at >= '{CUT}')")
def posts_removed(spark, d):
    rows = table(spark, d, "bookmarks")
    return normalize.removed(latest_posts(rows), rows.where(F.col("last_seen_at") >= CUT), "2030-01-01T00:00:00+00:00").select("tweet_id", "removed_at")


@_query("SELECT DISTINCT tweet_id FROM chunks WHERE tweet_id NOT IN (" + f"SELECT tweet_id FROM ({_LIVE}))")
def posts_gone(spark, d):
    return table(spark, d, "chunks").select("tweet_id").distinct().join(_live(spark, d), "tweet_id", "left_anti")


@_query(f"""
    SELECT tweet_id, sort_index FROM ({_LATEST})
    WHERE sort_index::HUGEINT > (SELECT max(sort_index::HUGEINT) FROM bookmarks WHERE captured_at < '{CUT}')""")
def posts_above_watermark(spark, d):
    rows = table(spark, d, "bookmarks")
    return ingest.above(latest_posts(rows), ingest.watermark(rows.where(F.col("captured_at") < CUT))).select("tweet_id", "sort_index")


@_query("SELECT date_trunc('day', ingested_at)::TIMESTAMP AS start, count(*) AS arrivals FROM bookmarks WHERE ingested_at IS NOT NULL GROUP BY 1")
def arrivals_by_day(spark, d):
    return ingest.arrivals(table(spark, d, "bookmarks")).select(F.col("start").cast("timestamp_ntz").alias("start"), "arrivals")


@_query(rf"""
    SELECT tweet_id, CASE WHEN length(f) > 280 THEN f[:280] || '...' ELSE f END AS snippet, n AS words
    FROM (SELECT tweet_id, regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ | $', '', 'g') AS f,
                 len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) AS n FROM ({_LIVE}))""")
def post_snippets(spark, d):
    return _live(spark, d).select("tweet_id", tx.snippet(F.col("text")).alias("snippet"), tx.word_count(F.col("text")).cast("bigint").alias("words"))


@_query(rf"""
    SELECT tweet_id FROM (
      SELECT tweet_id, lower(coalesce(lang, '')) AS tag, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) AS latin
      FROM ({_LIVE}))
    WHERE ((tag <> '' AND tag NOT LIKE 'en%' AND tag NOT IN ('zxx', 'qme', 'und', 'art')) OR (letters >= 5 AND latin < letters * 0.7))""")
def foreign_posts(spark, d):
    return _live(spark, d).where(tx.is_foreign(F.col("text"), F.col("lang"))).select("tweet_id")


# ---- links and pages ----


@_query(r"""
    WITH u AS (SELECT DISTINCT url, lower(coalesce(nullif(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1), ''), 'https')) AS scheme,
        regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') AS host,
        regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
        list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(string_split(p, '=')[1], '(?i)^(?:utm_|ref_?$|ref_src|ref_url|s|t|si|feature|__twitter)')) AS q
        FROM (SELECT url || '?utm_source=a&q=1&title=x#top' AS url FROM links UNION SELECT replace(url, '://', '://WWW.') FROM documents))
    SELECT url, scheme || '://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical, host AS domain FROM u""")
def canonical_urls(spark, d):
    tagged = table(spark, d, "links").select(F.concat("url", F.lit("?utm_source=a&q=1&title=x#top")).alias("url"))
    rows = tagged.union(table(spark, d, "documents").select(F.replace("url", F.lit("://"), F.lit("://WWW.")))).distinct()
    return rows.select("url", tx.canonical_url(F.col("url")).alias("canonical"), tx.url_host(F.col("url")).alias("domain"))


@_query(r"SELECT DISTINCT url FROM (SELECT url FROM media UNION ALL SELECT url FROM links) WHERE regexp_matches(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '(?i)\.(?:pdf|zip|tar|gz|mp4|mp3|png|jpe?g|gif|webp|csv|xlsx?)$')")
def binary_targets(spark, d):
    rows = table(spark, d, "media").select("url").union(table(spark, d, "links").select("url"))
    return rows.where(tx.is_binary(F.col("url"))).distinct()


_LINK_ORDER = "coalesce(title, '') || '|' || coalesce(description, '') || '|' || coalesce(thumb_url, '') || '|' || from_card"


@_query(f"""
    SELECT tweet_id, url, min(domain) AS domain, arg_max(title, o) FILTER (title IS NOT NULL) AS title, arg_max(description, o) FILTER (description IS NOT NULL) AS description,
           arg_max(thumb_url, o) FILTER (thumb_url IS NOT NULL) AS thumb_url, max(from_card) AS from_card
    FROM (SELECT *, {_LINK_ORDER} AS o FROM links) GROUP BY 1, 2""")
def links_merged(spark, d):
    blank = lambda c: F.coalesce(c, F.lit(""))
    order = F.concat_ws("|", blank("title"), blank("description"), blank("thumb_url"), F.col("from_card").cast("string"))
    return normalize.merged_links(table(spark, d, "links").withColumn("order", order))


_OWNERS = "SELECT tweet_id, url FROM documents WHERE tweet_id IS NOT NULL UNION SELECT tweet_id, url FROM links WHERE url IN (SELECT url FROM documents)"


@_query(f"SELECT url, count(*) AS owners FROM ({_OWNERS}) GROUP BY 1")
def page_owners(spark, d):
    return chunking.owners(table(spark, d, "documents"), table(spark, d, "links")).groupBy("url").agg(F.count("*").alias("owners"))


def _prose(body: str) -> str:
    """The text of a page by replacements, as the tables' markup needs them."""
    steps = [(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "") for t in ("script", "style", "head")]
    steps += [(rf"<[hH]{i}\b[^>]*>", f"\n\n\x01{i} ") for i in range(1, 7)]
    steps += [(r"(?i)<br\s*/?>|<tr\b[^>]*>", "\n"), (r"<[lL][iI]\b[^>]*>", "\n* "), (r"(?i)<pre\b[^>]*>\s*(?:<code\b[^>]*>)?", "\n\n```\n"), (r"(?i)(?:</code\s*>)?\s*</pre\s*>", "\n```\n\n")]
    steps += [(r"(?i)</?code\b[^>]*>", "`"), (r"(?i)<blockquote\b[^>]*>\s*(?:<p\b[^>]*>)?", "\n\n> "), (r"(?i)</?(?:strong\b[^>]*|b)>", "**"), (r"(?i)</?(?:em\b[^>]*|i)>", "*")]
    steps += [(r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | "), (r"(?i)<t[dh]\b[^>]*>", "| "), (r"(?i)</t[dh]\s*>", " |")]
    steps += [(r"(?i)</?(?:p|div|h[1-6]|ul|ol|table|blockquote|pre|section|article|figure|hr)\b[^>]*>", "\n\n"), (r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->", "")]
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    made = body
    for pattern, put in steps:
        made = f"regexp_replace({made}, {lit(pattern)}, {lit(put)}, 'g')"
    for i in range(1, 7):
        made = f"replace({made}, chr(1) || '{i}', '{'#' * i}')"
    made = f"CASE WHEN contains({body}, '<') THEN {made} ELSE {body} END"
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        made = f"replace({made}, {lit(entity)}, {lit(char)})"
    row = r"regexp_matches(x, '^[ \t\n\x0b\f\r]*\|.*\|[ \t\n\x0b\f\r]*$') AND regexp_replace(x, '[\d\s\x0b\x{85}\p{Z}\p{Nd}|:.,%+\-—–]+', '', 'g') = ''"
    made = f"array_to_string(list_filter(string_split_regex({made}, '\\r?\\n'), lambda x: NOT ({row})), chr(10))"
    made = f"regexp_replace({made}, '[ \\t\\f\\r\\x0b\\x{{85}}\\p{{Z}}]+\\n', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({made}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '{_STRIP}', '', 'g')"


def _pieces(source: str) -> str:
    """(k, a, piece): the pieces of the texts of a source (k, t), one step of the recursion for each."""
    return f"""
    SELECT k, a, t[a + 1 : b] AS piece FROM (
      WITH RECURSIVE p AS (SELECT k, t, string_split(t, chr(10) || chr(10)) AS ps FROM ({source})),
      d AS (SELECT k, t, length(t) AS n, list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + 2 * (i - 1)) AS ends FROM p),
      r AS (
        SELECT k, CASE WHEN n > 4800 THEN 0::BIGINT END AS s, 1::BIGINT AS i, CASE WHEN n <= 4800 THEN 0::BIGINT END AS a, CASE WHEN n <= 4800 THEN n END AS b FROM d
        UNION ALL
        SELECT k, CASE WHEN s2 < n THEN s2 END, i2, a2, b2 FROM (
          SELECT k, n, CASE WHEN far THEN s WHEN nil THEN NULL ELSE s END AS a2, CASE WHEN far THEN s + 4800 WHEN nil THEN NULL WHEN j = len(ends) THEN n WHEN s + 4800 > ends[j] + 2 THEN s + 4800 ELSE ends[j] END AS b2,
                 CASE WHEN far THEN s + 4600 WHEN nil THEN s + 2 WHEN j = len(ends) THEN n WHEN s + 4800 > ends[j] + 2 THEN greatest(ends[j] + 2, s + 4600) ELSE ends[j] + 2 END AS s2,
                 CASE WHEN far THEN i WHEN nil THEN i + 1 ELSE j + 1 END AS i2
          FROM (SELECT r.k, s, i, n, ends, ends[i] - s > 4800 AS far, ends[i] = s AS nil, len(list_filter(ends, lambda x: x <= s + 4800))::BIGINT AS j FROM r JOIN d ON r.k = d.k WHERE s IS NOT NULL)))
      SELECT r.k, a, b, t FROM r JOIN d ON r.k = d.k WHERE a IS NOT NULL)"""


_STATES = rf"""
    SELECT doc_id, word_count >= 60 OR (kind = 'video' AND word_count > 0) AS readable,
           coalesce(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')), 0) AS words,
           CASE WHEN coalesce(error, '') <> '' AND coalesce(body, '') = '' THEN 'failed' WHEN coalesce(body, '') = '' THEN 'empty' ELSE 'ok' END AS outcome
    FROM documents"""


@_query(_STATES)
def page_states(spark, d):
    return queues.page_states(table(spark, d, "documents"))


@_query(r"""
    SELECT doc_id, count(*) AS rows FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '^[ \t\n\x0b\f\r]*\|.*\|[ \t\n\x0b\f\r]*$') AND regexp_replace(line, '[\d\s\x0b\x{85}\p{Z}\p{Nd}|:.,%+\-—–]+', '', 'g') = '' GROUP BY 1""")
def number_rows(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(tx.is_number_row(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("rows"))


@_query(f"SELECT doc_id, {_prose('body')} AS prose FROM documents WHERE body IS NOT NULL")
def page_prose(spark, d):
    return table(spark, d, "documents").where("body IS NOT NULL").select("doc_id", tx.prose(F.col("body")).alias("prose"))


@_query("""
    SELECT doc_id, o::INT AS "offset", text[o + 1 : o + 12000] AS page, CASE WHEN length(text) > o + 12000 THEN (o + 12000)::INT END AS next_offset, length(text) > o + 12000 AS has_more
    FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 12000)) AS o FROM documents WHERE text IS NOT NULL)""")
def document_pages(spark, d):
    """Every page of every text."""
    return docs.pages(table(spark, d, "documents"))


# ---- chunks and the index ----


@_query("""
    WITH t AS (SELECT doc_id, replace(text, chr(10) || chr(10), chr(10)) AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, i AS position, left(sha256(t[i * 4600 + 1 : i * 4600 + 4800]), 16) AS hash
    FROM (SELECT doc_id, t, unnest(range(0, 1 + greatest(0, ceil((length(t) - 4800) / 4600e0)::BIGINT))) AS i FROM t)""")
def flat_pieces(spark, d):
    flat = F.replace("text", F.lit("\n\n"), F.lit("\n"))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(chunking.flat_pieces(flat)).alias("position", "p"))
    return rows.select("doc_id", F.col("position").cast("bigint").alias("position"), tx.content_hash(F.col("p.text")).alias("hash"))


@_query(f"""
    SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY a) - 1)::INT AS position, length(piece)::INT AS length, left(sha256(piece), 16) AS hash FROM ({_pieces("SELECT doc_id AS k, text AS t FROM documents WHERE text IS NOT NULL")})""")
def document_pieces(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.split(F.col("text"))).alias("position", "text"))
    return rows.select("doc_id", "position", F.length("text").alias("length"), tx.content_hash(F.col("text")).alias("hash"))


@_query(f"""
    SELECT tweet_id, url AS ref, domain || ': ' || array_to_string(list_filter([title, description], lambda x: x IS NOT NULL AND x <> ''), ' — ') AS text
    FROM links WHERE tweet_id IN (SELECT tweet_id FROM ({_LIVE})) AND (coalesce(title, '') <> '' OR coalesce(description, '') <> '')
      AND url NOT IN (SELECT url FROM documents WHERE kind <> 'x_article' AND (word_count >= 60 OR (kind = 'video' AND word_count > 0)))""")
def card_chunks(spark, d):
    covered = chunking.readable(table(spark, d, "documents")).where("kind <> 'x_article'")
    return chunking.card_chunks(table(spark, d, "links"), _live(spark, d), covered).select("tweet_id", "ref", "text")




def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '{_STRIP}', '', 'g')"


_NAMED = "'@' || coalesce(nullif(screen_name, ''), 'unknown')"


def _post_chunks(stub: str) -> str:
    """Chunks of live posts; an article's stub where ``stub`` holds."""
    texts = f"""SELECT tweet_id || '|0' AS k, {_stripped("text")} AS t FROM ({_LIVE}) UNION ALL SELECT tweet_id || '|1', {_stripped("quoted_text")} FROM ({_LIVE})
                UNION ALL SELECT tweet_id || '|2', {_stripped("article_title || chr(10) || chr(10) || coalesce(article_preview, '')")} FROM ({_LIVE}) WHERE article_title <> '' AND {stub}"""
    return f"""
    SELECT c.tweet_id, CASE m WHEN '0' THEN 'post' WHEN '1' THEN 'quote' ELSE 'article' END AS source, row_number() OVER (PARTITION BY c.tweet_id ORDER BY m, a) - 1 AS position, {_NAMED} || ': ' || piece AS text, lang
    FROM (SELECT split_part(k, '|', 1) AS tweet_id, split_part(k, '|', 2) AS m, a, piece FROM ({_pieces(f"SELECT * FROM ({texts}) WHERE t <> ''")})) c JOIN ({_LIVE}) p ON p.tweet_id = c.tweet_id LEFT JOIN authors USING (author_id)"""


@_query(_post_chunks("true"))
def post_chunks(spark, d):
    none = spark.createDataFrame([], "tweet_id string")
    rows = chunking.post_chunks(_live(spark, d), table(spark, d, "authors"), none)
    return rows.select("tweet_id", "source", F.col("position").cast("bigint").alias("position"), "text", "lang")


_READABLE = "SELECT * FROM documents WHERE word_count >= 60 OR (kind = 'video' AND word_count > 0)"
_LIVE_OWNERS = f"SELECT * FROM ({_OWNERS}) WHERE tweet_id IN (SELECT tweet_id FROM ({_LIVE}))"
_CARDS = "SELECT tweet_id, url, min(domain) AS domain, max(title) AS title, max(description) AS description FROM links GROUP BY 1, 2"
_SITE = r"coalesce(nullif(site, ''), nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', ''), ''), 'link')"
_WHOLE = f"""
    SELECT o.tweet_id || '|' || doc_id AS k, url, kind, CASE WHEN kind IN ('x_article', 'video') THEN {_NAMED} ELSE {_SITE} END || ':' || CASE WHEN title <> '' THEN ' ' || title ELSE '' END || chr(10) || chr(10) || prose AS t
    FROM (SELECT *, {_prose("body")} AS prose FROM ({_READABLE})) g JOIN ({_LIVE_OWNERS}) o USING (url) JOIN (SELECT tweet_id, author_id FROM ({_LIVE})) p ON p.tweet_id = o.tweet_id LEFT JOIN authors USING (author_id) WHERE prose <> ''"""


@_query(f"""
    SELECT tweet_id, source, NULL AS ref, position::INT AS position, left(sha256(text), 16) AS hash FROM ({_post_chunks(f"tweet_id NOT IN (SELECT o.tweet_id FROM ({_OWNERS}) o JOIN ({_READABLE}) g USING (url) WHERE g.kind = 'x_article')")})
    UNION ALL
    SELECT tweet_id, 'link', url, 0, left(sha256(coalesce(domain, '') || ': ' || array_to_string(list_filter([title, description], lambda x: x <> ''), ' — ')), 16) FROM ({_CARDS})
    WHERE tweet_id IN (SELECT tweet_id FROM ({_LIVE})) AND (title <> '' OR description <> '') AND url NOT IN (SELECT url FROM ({_READABLE}) WHERE kind <> 'x_article' AND url IN (SELECT url FROM ({_LIVE_OWNERS})))
    UNION ALL
    SELECT split_part(c.k, '|', 1), CASE kind WHEN 'x_article' THEN 'article' WHEN 'video' THEN 'video' ELSE 'link' END, url, (row_number() OVER (PARTITION BY c.k ORDER BY a) - 1)::INT, left(sha256(piece), 16)
    FROM ({_pieces(f"SELECT k, t FROM ({_WHOLE})")}) c JOIN (SELECT k, url, kind FROM ({_WHOLE})) w ON w.k = c.k
    UNION ALL
    SELECT m.tweet_id, 'image', media_key, 0, left(sha256({_NAMED} || ': ' || {_stripped("alt_text")}), 16)
    FROM (SELECT * FROM media WHERE kind = 'photo') m JOIN ({_LIVE}) p USING (tweet_id) LEFT JOIN authors USING (author_id) WHERE {_stripped("alt_text")} <> ''""")
def wanted_chunks(spark, d):
    from corpusloom.engine import Engine

    return Engine(spark, d).wanted_chunks().select("tweet_id", "source", "ref", "position", "hash")


@_query("""
    WITH w AS (SELECT tweet_id, list_sort(list(DISTINCT hash)) AS h FROM chunks WHERE source <> 'image' GROUP BY 1), o AS (SELECT tweet_id, list_sort(list(DISTINCT hash)) AS h FROM chunks WHERE source <> 'quote' GROUP BY 1)
    SELECT tweet_id, CASE WHEN o.h IS NULL THEN 'add' WHEN w.h IS NULL THEN 'remove' ELSE 'rewrite' END AS change FROM w FULL JOIN o USING (tweet_id) WHERE w.h IS DISTINCT FROM o.h""")
def index_changes(spark, d):
    rows = table(spark, d, "chunks")
    return indexing.changes(indexing.without_sources(rows, ["image"]), indexing.without_sources(rows, ["quote"]))


@_query("SELECT DISTINCT id, tweet_id, hash FROM chunks WHERE id NOT IN (SELECT chunk_id FROM chunk_vec WHERE embedding IS NOT NULL)")
def chunks_to_embed(spark, d):
    return indexing.unembedded(table(spark, d, "chunks").select("id", "tweet_id", "hash").distinct(), table(spark, d, "chunk_vec"))


@_query("""
    WITH c AS (SELECT DISTINCT left(sha256(source_text), 16) AS h, text FROM chunks WHERE source_text <> ''), k AS (SELECT h, min(text) AS english FROM c GROUP BY 1)
    SELECT DISTINCT tweet_id, left(sha256(coalesce(english, s)), 16) AS hash, english IS NOT NULL AS changed
    FROM (SELECT tweet_id, coalesce(nullif(source_text, ''), text) AS s FROM chunks) LEFT JOIN k ON h = left(sha256(s), 16)""")
def chunks_translated(spark, d):
    rows = table(spark, d, "chunks")
    cache = rows.where("source_text <> ''").groupBy(tx.content_hash(F.col("source_text")).alias("hash")).agg(F.min("text").alias("text"))
    plain = rows.select("tweet_id", F.coalesce(tx.given(F.col("source_text")), F.col("text")).alias("text"))
    made = indexing.translated(plain.withColumn("hash", tx.content_hash(F.col("text"))), cache)
    return made.select("tweet_id", "hash", F.col("source_text").isNotNull().alias("changed")).distinct()


@_query("""
    SELECT tweet_id, hash, min(id) AS slot, arg_max(source, id) AS source FROM (SELECT DISTINCT tweet_id, hash, id, source FROM chunks) GROUP BY 1, 2""")
def chunks_distinct(spark, d):
    rows = table(spark, d, "chunks").select("tweet_id", "hash", F.col("id").alias("slot"), "source").distinct()
    return indexing.distinct_within(rows).select("tweet_id", "hash", "slot", "source")


# ---- retrieval ----

_CHUNKS = "SELECT DISTINCT ON (id) * FROM chunks"
_VECTORS = "SELECT DISTINCT ON (chunk_id) chunk_id, embedding::DOUBLE[] AS v FROM chunk_vec WHERE len(embedding) = 768"
_AMONG = f"SELECT id FROM chunks WHERE source = '{SOURCE}' AND tweet_id IN (SELECT tweet_id FROM ({_LIVE}) WHERE created_at >= '{CUT}')"


def _bm25(where: str = "") -> str:
    terms = retrieval.query_terms(ASKED)
    return f"""
    WITH q AS (SELECT t, count(*) AS m FROM (SELECT unnest({terms}) AS t) GROUP BY 1),
    c AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+') AS ts FROM ({_CHUNKS})), s AS (SELECT count(*) AS n, sum(len(ts)) / count(*)::DOUBLE AS mean FROM c),
    tf AS (SELECT id, len(ts) AS dl, t, m, len(list_filter(ts, lambda x: x = t)) AS f FROM c, q), df AS (SELECT t, count(*) FILTER (f > 0) AS df FROM tf GROUP BY 1),
    b AS (SELECT id AS chunk_id, round(sum(m * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean))), 9) AS bm25 FROM tf JOIN df USING (t), s WHERE f > 0 {where} GROUP BY 1)
    SELECT chunk_id, bm25, row_number() OVER (ORDER BY bm25 DESC, chunk_id) - 1 AS rank FROM b ORDER BY rank LIMIT 80"""


def _knn(where: str = "") -> str:
    return f"""
    WITH v AS ({_VECTORS}), q AS (SELECT arg_min(v, chunk_id) AS q FROM v),
    dist AS (SELECT chunk_id, list_distance(v, q) AS d FROM v, q {where})
    SELECT chunk_id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, chunk_id) - 1 AS rank FROM dist ORDER BY rank LIMIT 80"""


def _fused(where_b: str = "", where_k: str = "") -> str:
    return f"""
    SELECT chunk_id, round(sum(1e0 / (rank + 61)), 12) AS score, max(d) AS dense_rank, max(l) AS lexical_rank FROM (
      SELECT chunk_id, rank, rank AS d, NULL AS l FROM ({_knn(where_k)}) UNION ALL SELECT chunk_id, rank, NULL, rank FROM ({_bm25(where_b)})) GROUP BY 1"""


def _text_index(spark: SparkSession, d: str) -> postings.TextIndex:
    """The postings of the chunks, built on first use and kept for the session; later searches read the buckets of their terms."""
    return kept(spark, "text index", [f"{d}/chunks.parquet"], lambda: postings.build(table(spark, d, "chunks"), f"{own_dir(spark)}/postings-{uuid.uuid4().hex}"))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "chunks"), retrieval.index_vectors(table(spark, d, "chunk_vec"))


def _among(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    return retrieval.allowed(chunks, _live(spark, d), table(spark, d, "authors"), source=SOURCE, after=CUT)


@_query(_bm25())
def bm25_topk(spark, d):
    return retrieval.lexical_ranks(_text_index(spark, d), ASKED)


@_query(_bm25(f"AND id IN ({_AMONG})"))
def bm25_filtered(spark, d):
    chunks, _ = _index(spark, d)
    return retrieval.lexical_ranks(_text_index(spark, d), ASKED, among=_among(spark, d, chunks))


@_query(_knn())
def knn_topk(spark, d):
    _, vectors = _index(spark, d)
    return retrieval.vector_ranks(vectors, _vector(vectors)).withColumn("distance", F.round("distance", 6))


@_query(_knn(f"WHERE chunk_id IN ({_AMONG})"))
def knn_filtered(spark, d):
    chunks, vectors = _index(spark, d)
    return retrieval.vector_ranks(vectors, _vector(vectors), among=_among(spark, d, chunks)).withColumn("distance", F.round("distance", 6))


@_query(_fused())
def rrf_fused(spark, d):
    _, vectors = _index(spark, d)
    return retrieval.fuse(retrieval.vector_ranks(vectors, _vector(vectors)), retrieval.lexical_ranks(_text_index(spark, d), ASKED))


@_query(f"SELECT DISTINCT id AS chunk_id FROM ({_AMONG})")
def allowed_chunks(spark, d):
    return _among(spark, d, table(spark, d, "chunks")).distinct()


@_query(f"""
    WITH f AS ({_fused(f"AND id IN ({_AMONG})", f"WHERE chunk_id IN ({_AMONG})")}), c AS ({_CHUNKS}), p AS ({_LIVE}),
    h AS (SELECT c.tweet_id, f.chunk_id, c.source, f.score, p.author_id, p.created_at, p.url, p.text AS post, p.lang, c.ref, c.text AS chunk, c.source_text FROM f JOIN c ON c.id = f.chunk_id JOIN p USING (tweet_id)),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY score DESC, chunk_id) AS r FROM h) WHERE r = 1 ORDER BY score DESC, chunk_id LIMIT 10),
    n AS (SELECT tweet_id, count(*) AS n FROM c GROUP BY 1), k AS (SELECT tweet_id, list_sort(list(DISTINCT kind)) AS k FROM media GROUP BY 1),
    w AS (SELECT o.tweet_id, sum(word_count) AS w FROM ({_OWNERS}) o JOIN documents dd USING (url) GROUP BY 1)
    SELECT b.tweet_id, b.url, chunk_id, source, score, '@' || coalesce(nullif(screen_name, ''), 'unknown') AS handle, created_at, n.n AS chunk_count,
           coalesce(nullif(w.w, 0), len(list_filter(regexp_split_to_array(post, '{_WS}+'), lambda x: x <> '')))::BIGINT AS words, coalesce(k.k, []) AS media,
           b.post AS text, b.lang, b.ref, b.chunk, b.source_text
    FROM b LEFT JOIN n USING (tweet_id) LEFT JOIN k USING (tweet_id) LEFT JOIN w USING (tweet_id) LEFT JOIN authors USING (author_id)""")
def hybrid_search(spark, d):
    tables = {n: table(spark, d, n) for n in ("chunks", "authors", "documents", "links", "media")} | {"posts": _live(spark, d)}
    tables["vectors"] = _index(spark, d)[1]
    return retrieval.search(tables, ASKED, _vector(tables["vectors"]), index=_text_index(spark, d), source=SOURCE, after=CUT).drop("passage")


_PASSAGES = "SELECT min(id) FROM chunks WHERE source IN ('article', 'link', 'video') AND ref IN (SELECT url FROM documents WHERE word_count >= 60 OR (kind = 'video' AND word_count > 0)) GROUP BY ref, position"


@_query(f"""
    WITH f AS ({_fused(f"AND id IN ({_PASSAGES})", f"WHERE chunk_id IN ({_PASSAGES})")})
    SELECT chunk_id, tweet_id, source, ref, position, score, text, source_text FROM (SELECT * FROM f ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id LIMIT 5) JOIN ({_CHUNKS}) c ON c.id = chunk_id""")
def passage_search(spark, d):
    chunks, vectors = _index(spark, d)
    within = docs.passage_ids(chunks, chunking.readable(table(spark, d, "documents")))
    return retrieval.passages(chunks, vectors, ASKED, _vector(vectors), within, index=_text_index(spark, d))


# ---- work queues ----


@_query(f"""
    WITH p AS ({_LIVE}), done AS (SELECT url, arg_max(coalesce(error, ''), (fetched_at, doc_id)) AS error, sum(attempts) AS attempts FROM documents GROUP BY 1),
    j AS (SELECT 'https://x.com/' || screen_name || '/status/' || tweet_id AS url, 'x_article' AS kind, tweet_id FROM p JOIN authors USING (author_id) WHERE article_id IS NOT NULL
          UNION ALL SELECT DISTINCT url, 'link', NULL FROM links WHERE tweet_id IN (SELECT tweet_id FROM p))
    SELECT url, kind, tweet_id FROM j LEFT JOIN done USING (url) WHERE attempts IS NULL OR (error <> '' AND attempts < 2)""")
def pending_pages(spark, d):
    rows = table(spark, d, "documents").withColumn("error", F.coalesce("error", F.lit("")))
    return queues.pending_pages(_live(spark, d), table(spark, d, "authors"), table(spark, d, "links"), rows)


@_query(f"""
    SELECT 'https://x.com/' || coalesce(nullif(screen_name, ''), 'i') || '/status/' || tweet_id || '/video/' || (position + 1) AS url, small_url, duration_ms
    FROM media JOIN ({_LIVE}) p USING (tweet_id) LEFT JOIN authors USING (author_id) WHERE kind = 'video' AND small_url IS NOT NULL""")
def pending_videos(spark, d):
    return queues.pending_videos(_live(spark, d), table(spark, d, "authors"), table(spark, d, "media").select("tweet_id", "kind", "small_url", "duration_ms", "position"), table(spark, d, "documents"))


@_query(f"SELECT media_key, url FROM media WHERE kind = 'photo' AND coalesce(alt_text, '') = '' AND tweet_id IN (SELECT tweet_id FROM ({_LIVE}))")
def pending_captions(spark, d):
    media = table(spark, d, "media")
    done = media.where("alt_text <> ''").select("media_key", F.lit(None).cast("string").alias("error"))
    return queues.pending_captions(_live(spark, d), media, done)


@_query(r"""
    SELECT hash, min(text) AS text FROM (
      SELECT hash, text, lower(coalesce(lang, '')) AS tag, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) AS latin FROM chunks WHERE source <> 'image')
    WHERE ((tag <> '' AND tag NOT LIKE 'en%' AND tag NOT IN ('zxx', 'qme', 'und', 'art')) OR (letters >= 5 AND latin < letters * 0.7))
      AND hash NOT IN (SELECT left(sha256(source_text), 16) FROM chunks WHERE source_text <> '') GROUP BY 1""")
def pending_translations(spark, d):
    rows = table(spark, d, "chunks")
    return queues.pending_translations(rows, rows.where("source_text <> ''").select(tx.content_hash(F.col("source_text")).alias("hash")), ["image"])


# ---- report ----


@_query(f"""
    WITH p AS ({_LATEST}), l AS (SELECT * FROM p WHERE removed_at IS NULL)
    SELECT (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM p WHERE removed_at IS NOT NULL) AS removed, count(*) AS live, count(*) FILTER (is_long = 1) AS long,
      count(*) FILTER (coalesce(quoted_tweet_id, '') <> '') AS quotes, count(*) FILTER (coalesce(article_id, '') <> '') AS articles,
      count(*) FILTER (lang IS NOT NULL AND lang NOT IN ('en', 'und', 'qme', 'qst', 'zxx')) AS "foreign", min(created_at) AS oldest, max(created_at) AS newest,
      count(*) FILTER (text = '') AS empty, trunc(median(length(text)) FILTER (length(text) > 0))::INT AS median_chars, (sum(length(text)) FILTER (length(text) > 0))::BIGINT AS chars FROM l""")
def report_posts(spark, d):
    return report.post_counts(latest_posts(table(spark, d, "bookmarks")))


@_query(f"SELECT coalesce(lang, 'unknown') AS lang, count(*) AS posts FROM ({_LIVE}) GROUP BY 1")
def report_languages(spark, d):
    return report.languages(latest_posts(table(spark, d, "bookmarks")))


@_query(f"SELECT kind, count(*) AS n, count(*) FILTER (coalesce(alt_text, '') <> '') AS with_alt, count(DISTINCT tweet_id) AS posts FROM media WHERE tweet_id IN (SELECT tweet_id FROM ({_LIVE})) GROUP BY 1")
def report_media(spark, d):
    return report.media_kinds(latest_posts(table(spark, d, "bookmarks")), table(spark, d, "media"))


@_query(f"""
    WITH v AS (SELECT duration_ms / 1000e0 AS s, bitrate AS b, coalesce(nullif(small_bitrate, 0), bitrate) AS m FROM media WHERE kind IN ('video', 'animated_gif') AND duration_ms > 0 AND tweet_id IN (SELECT tweet_id FROM ({_LIVE})))
    SELECT count(*) AS videos, round(sum(s), 3) AS seconds, round(median(s), 3) AS median_s, round(max(s), 3) AS longest_s, count(*) FILTER (s > 600) AS long,
      round(sum(coalesce(b, 0) * s / 8), 0) AS best_bytes, round(sum(coalesce(m, 0) * s / 8), 0) AS small_bytes FROM v""")
def report_videos(spark, d):
    return report.videos(latest_posts(table(spark, d, "bookmarks")), table(spark, d, "media"))


@_query(f"SELECT domain, count(*) AS n FROM links WHERE domain IS NOT NULL AND tweet_id IN (SELECT tweet_id FROM ({_LIVE})) GROUP BY 1 ORDER BY n DESC, domain LIMIT 15")
def top_domains(spark, d):
    return report.top_domains(latest_posts(table(spark, d, "bookmarks")), table(spark, d, "links"))


@_query(f"SELECT screen_name, n FROM (SELECT author_id, count(*) AS n FROM ({_LIVE}) GROUP BY 1) JOIN authors USING (author_id) ORDER BY n DESC, screen_name LIMIT 15")
def top_authors(spark, d):
    return report.top_authors(latest_posts(table(spark, d, "bookmarks")), table(spark, d, "authors"))


@_query(f"""
    SELECT (SELECT count(*) FROM ({_LIVE})) AS bookmarks, (SELECT count(*) FROM media WHERE kind = 'photo') AS photos, (SELECT count(*) FROM media WHERE kind = 'video') AS videos, (SELECT count(*) FROM media WHERE kind = 'photo' AND alt_text <> '') AS captioned,
      (SELECT count(*) FROM documents WHERE kind = 'video' AND error IS NULL) AS transcribed, (SELECT count(*) FROM documents WHERE kind = 'video' AND word_count > 0) AS speech,
      (SELECT count(*) FROM documents WHERE kind <> 'video' AND coalesce(body, '') <> '') AS pages, (SELECT count(*) FROM documents WHERE coalesce(error, '') <> '' AND coalesce(body, '') = '') AS failed_pages,
      (SELECT count(DISTINCT id) FROM chunks) AS chunks, (SELECT count(DISTINCT id) FROM chunks WHERE coalesce(source_text, '') <> '') AS translated,
      (SELECT count(DISTINCT chunk_id) FROM chunk_vec WHERE embedding IS NOT NULL) AS embedded""")
def status_counts(spark, d):
    return report.status(latest_posts(table(spark, d, "bookmarks")), *(table(spark, d, n) for n in ("media", "documents", "chunks", "chunk_vec")))


@_query("""
    SELECT media_key, CASE WHEN s < 3600 THEN printf('%d:%02d', s // 60, s % 60) ELSE printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END AS clock,
      CASE WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%dh %dm', s // 3600, s // 60 % 60) END AS duration
    FROM (SELECT media_key, duration_ms // 1000 AS s FROM media WHERE duration_ms IS NOT NULL)""")
def media_clocks(spark, d):
    seconds = F.col("duration_ms") / 1000
    return table(spark, d, "media").where("duration_ms IS NOT NULL").select("media_key", tx.clock(seconds).alias("clock"), tx.duration(seconds).alias("duration"))


@_query(f"""
    SELECT p.tweet_id, screen_name, item, place, title FROM ({_LIVE}) p LEFT JOIN authors USING (author_id)
    JOIN (SELECT tweet_id, 'link' AS item, url AS place, title FROM links UNION ALL SELECT tweet_id, 'media', media_key, alt_text FROM media) i USING (tweet_id)""")
def bookmark_items(spark, d):
    return docs.items(_live(spark, d), *(table(spark, d, n) for n in ("authors", "links", "media")))


@_query("""
    WITH RECURSIVE e AS (SELECT user_id AS key, floor(epoch(ts)) AS start, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_type) AS i FROM events WHERE event_type <> ''),
    r AS (
      SELECT key, i, start AS begun, text FROM e WHERE i = 1
      UNION ALL
      SELECT e.key, e.i, CASE WHEN e.start - r.begun >= 60 THEN e.start ELSE r.begun END, CASE WHEN e.start - r.begun >= 60 THEN e.text ELSE r.text || ' ' || e.text END FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)
    SELECT key, begun AS start, last(text ORDER BY i) AS text, count(*)::INT AS words FROM r GROUP BY key, begun""")
def session_paragraphs(spark, d):
    """The events of each user read as segments of a recording, as paragraphs of a minute or more."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("start"), F.col("event_type").alias("text"))
    return chunking.paragraphs(rows)


@_query(f"""
    SELECT (SELECT count(DISTINCT tweet_id) FROM media WHERE tweet_id IN (SELECT tweet_id FROM ({_LIVE}))) AS with_media, (SELECT count(*) FROM media WHERE alt_text <> '' AND tweet_id IN (SELECT tweet_id FROM ({_LIVE}))) AS with_alt,
      (SELECT count(*) FROM links WHERE tweet_id IN (SELECT tweet_id FROM ({_LIVE}))) AS links, (SELECT count(DISTINCT domain) FROM links WHERE tweet_id IN (SELECT tweet_id FROM ({_LIVE}))) AS domains""")
def report_links_and_media(spark, d):
    posts = latest_posts(table(spark, d, "bookmarks"))
    return report.media_posts(posts, table(spark, d, "media")).join(F.broadcast(report.link_counts(posts, table(spark, d, "links"))))  # two single rows


# ---- searches with other filters, reading, lists ----

_BEFORE = f"SELECT c.id FROM chunks c JOIN ({_LIVE}) p USING (tweet_id) JOIN authors a USING (author_id) WHERE lower(a.screen_name) = (SELECT lower(min(screen_name)) FROM authors WHERE screen_name <> '' AND author_id IN (SELECT author_id FROM ({_LIVE}))) AND p.created_at < '2030-01-01'"


@_query(f"SELECT DISTINCT id AS chunk_id FROM ({_BEFORE})")
def chunks_of_author(spark, d):
    """The chunks of the first author by name among the live posts, before a date."""
    posts, authors = _live(spark, d), table(spark, d, "authors")
    name = authors.where("screen_name <> ''").join(posts.select("author_id"), "author_id", "left_semi").agg(F.min("screen_name")).first()[0]
    return retrieval.allowed(table(spark, d, "chunks"), posts, authors, author=f"@{name or 'nobody'}", before="2030-01-01").distinct()


@_query("SELECT min(id) AS chunk_id, NULL::DOUBLE AS distance, 0 AS rank FROM chunks WHERE id NOT IN (SELECT chunk_id FROM chunk_vec WHERE embedding IS NOT NULL) HAVING count(*) > 0")
def knn_lone(spark, d):
    """A search among a single chunk, which has no vector: it is ranked all the same."""
    chunks, vectors = _index(spark, d)
    alone = indexing.unembedded(chunks, table(spark, d, "chunk_vec")).agg(F.min("id").alias("chunk_id"))
    return retrieval.vector_ranks(vectors, _vector(vectors), among=alone)


_TERMS = ("model", "market", "the")


@_query(f"""
    SELECT term, id AS chunk_id, len(list_filter(ts, lambda x: x = term))::BIGINT AS tf, len(ts)::INT AS dl
    FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+') AS ts FROM ({_CHUNKS})), (SELECT unnest({list(_TERMS)}) AS term) WHERE list_contains(ts, term)""")
def postings_of_terms(spark, d):
    return _text_index(spark, d).of_terms(list(_TERMS)).select("term", "chunk_id", "tf", "dl")


_POST_OF = "(SELECT max(tweet_id) FROM documents WHERE tweet_id IN (SELECT tweet_id FROM (" + _LIVE + ")))"


@_query(f"""
    SELECT url, kind, title, word_count FROM documents WHERE (word_count >= 60 OR (kind = 'video' AND word_count > 0)) AND url IN (SELECT url FROM ({_OWNERS}) WHERE tweet_id = {_POST_OF})""")
def documents_of_post(spark, d):
    """The readable documents of one post: the last that has any."""
    documents, posts = table(spark, d, "documents"), _live(spark, d)
    target = documents.join(posts.select("tweet_id"), "tweet_id", "left_semi").agg(F.max("tweet_id")).first()[0]
    return docs.info(docs.find(documents, table(spark, d, "links"), posts, target or ""))


_PHOTOS = "SELECT media_key, tweet_id, alt_text FROM media WHERE kind = 'photo' AND alt_text <> ''"


@_query(f"""
    SELECT m.tweet_id, 'image' AS source, m.media_key AS ref, 0 AS position, '@' || coalesce(nullif(screen_name, ''), 'unknown') || ': ' || regexp_replace(alt_text, '{_STRIP}', '', 'g') AS text, p.lang
    FROM ({_PHOTOS}) m JOIN ({_LIVE}) p USING (tweet_id) LEFT JOIN authors USING (author_id) WHERE regexp_replace(alt_text, '{_STRIP}', '', 'g') <> ''""")
def image_chunks(spark, d):
    """The photos' descriptions as captions (all are shorter than a piece)."""
    media = table(spark, d, "media")
    said = media.where("kind = 'photo' AND alt_text <> ''").select("media_key", F.col("alt_text").alias("text"), F.lit(None).cast("string").alias("error"))
    return chunking.image_chunks(said, media, _live(spark, d), table(spark, d, "authors"))


@_query(rf"""
    WITH l AS (SELECT tweet_id, i, list_extract(ls, i) AS line, list_extract(ls, i - 1) AS last FROM (
        SELECT tweet_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT tweet_id, string_split(regexp_replace(regexp_replace('<think>why ' || tweet_id || '</think> ' || text || chr(10) || text, '<think>.*?</think>', '', 'gs'), '{_STRIP}', '', 'g'), chr(10)) AS ls FROM ({_LIVE}))))
    SELECT tweet_id, string_agg(line, chr(10) ORDER BY i) AS caption FROM l WHERE i = 1 OR line <> last GROUP BY 1""")
def captions_cleaned(spark, d):
    """Each post's text twice, after a thought, as the raw answer of a captioner."""
    raw = F.concat(F.lit("<THINK>why "), "tweet_id", F.lit("</think> "), F.regexp_replace("text", r"[\r\u000B\u000C\u001C-\u001E\u0085  ]", " "), F.lit("\n"), F.regexp_replace("text", r"[\r\u000B\u000C\u001C-\u001E\u0085  ]", " "))
    return _live(spark, d).where("text IS NOT NULL").select("tweet_id", tx.clean_caption(raw).alias("caption"))


@_query("""
    SELECT media_key, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size
    FROM (SELECT media_key, floor(duration_ms * coalesce(bitrate, 0) / 8000e0) AS b FROM media WHERE duration_ms IS NOT NULL)""")
def media_sizes(spark, d):
    n = F.floor(F.col("duration_ms") * F.coalesce("bitrate", F.lit(0)) / 8000.0)
    return table(spark, d, "media").where("duration_ms IS NOT NULL").select("media_key", tx.byte_size(n).alias("size"))


# ---- raw pages ----

_STAMP = "strftime(created_at::TIMESTAMPTZ, '%a %b %d %H:%M:%S +0000 %Y')"


def _pages(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Raw pages as a capture would bring them, made from the tables: one for each row, through JSON and back.

    ``kind`` says which part a page carries beside the post: nothing, a media item or a link.
    """
    posts, authors = table(spark, d, "bookmarks"), table(spark, d, "authors").withColumnRenamed("description", "about")
    rows = posts.join(authors, "author_id", "left") if kind == "post" else table(spark, d, kind).withColumn("place", F.md5(F.to_json(F.struct("*")))).join(authors.where("false"), F.lit(False), "left")
    own = F.col("tweet_id") if kind == "post" else F.concat_ws("-", "tweet_id", "place")
    stamp = F.to_timestamp("created_at") if kind == "post" else F.lit(None).cast("timestamp")
    text = F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" sho.rt/x ")) if kind == "post" else F.lit("sho.rt/x")
    legacy = {"full_text": text, "created_at": F.date_format(stamp, "EEE MMM dd HH:mm:ss '+0000' yyyy"), "lang": F.col("lang") if kind == "post" else F.lit(None).cast("string"), "conversation_id_str": own}
    if kind == "post":
        legacy |= {c: F.col(c) for c in ("favorite_count", "retweet_count", "reply_count", "quote_count", "bookmark_count")}
        legacy["entities"] = F.struct(F.array(F.struct(F.lit("sho.rt/x").alias("url"), F.concat(F.lit("https://of.test/"), "tweet_id").alias("expanded_url"))).alias("urls"))
    if kind == "links":
        legacy["entities"] = F.struct(F.array(F.struct(F.lit("sho.rt/x").alias("url"), F.col("url").alias("expanded_url"))).alias("urls"))
    if kind == "media":
        clip = lambda rate, url, mime="video/mp4": F.struct(F.lit(mime).alias("content_type"), F.col(rate).alias("bitrate"), F.col(url).alias("url"))
        clips = F.array(clip("bitrate", "url", "application/x-mpegURL"), clip("bitrate", "url"), clip("small_bitrate", "small_url"))
        item = F.struct(
            "media_key", F.col("kind").alias("type"), F.lit("sho.rt/x").alias("url"), F.col("url").alias("media_url_https"), F.col("alt_text").alias("ext_alt_text"), F.struct("width", "height").alias("original_info"),
            F.struct(F.col("duration_ms").alias("duration_millis"), clips.alias("variants")).alias("video_info"),
        )
        legacy["extended_entities"] = F.struct(F.array(item).alias("media"))
    person = F.struct(F.col("author_id").alias("rest_id") if kind == "post" else F.lit("0").alias("rest_id"), F.struct("screen_name", "name").alias("core"), F.struct(F.col("avatar_url").alias("image_url")).alias("avatar"),
                      (F.col("verified") == 1).alias("is_blue_verified"), F.struct(F.col("about").alias("description")).alias("legacy"))
    made = {"__typename": F.lit("Tweet"), "rest_id": own, "core": F.struct(F.struct(person.alias("result")).alias("user_results")), "legacy": F.struct(*(c.alias(n) for n, c in legacy.items()))}
    if kind == "post":
        made["article"] = F.struct(F.struct(F.struct(F.col("article_id").alias("rest_id"), F.col("article_title").alias("title"), F.col("article_preview").alias("preview_text")).alias("result")).alias("article_results"))
    if kind == "links":
        value = lambda key, c: F.struct(F.lit(key).alias("key"), F.struct(F.col(c).alias("string_value")).alias("value"))
        card = F.struct(F.struct(F.lit("sho.rt/x").alias("url"), F.array(value("title", "title"), value("description", "description"), value("thumbnail_image", "thumb_url")).alias("binding_values")).alias("legacy"))
        made["card"] = F.when(F.col("from_card") == 1, card)
    tweet = F.struct(*(c.alias(n) for n, c in made.items()))
    index = F.col("sort_index") if kind == "post" else F.lit("1")
    content = F.struct(F.struct(F.lit("TimelineTweet").alias("itemType"), F.struct(tweet.alias("result")).alias("tweet_results")).alias("itemContent"))
    step = F.struct(F.array(F.struct(index.alias("sortIndex"), content.alias("content"))).alias("entries"))
    whole = F.struct(F.struct(F.struct(F.struct(F.array(step).alias("instructions")).alias("timeline")).alias("bookmark_timeline_v2")).alias("data"))
    seq = F.date_format("ingested_at", "yyyyMMddHHmmss.SSSSSS") if kind == "post" else own
    seq = F.concat_ws("|", seq, "last_seen_at") if kind == "post" else seq
    return rows.select(F.concat_ws("|", seq, own).alias("seq"), F.from_json(F.to_json(whole), PAGE).alias("page"))


_SEEN = "2030-01-01T00:00:00+00:00"


@_query(rf"""
    SELECT tweet_id, sort_index, p.author_id, regexp_replace(coalesce(text, '') || ' https://of.test/' || tweet_id, '{_STRIP}', '', 'g') AS text, 0 AS is_long, lang,
           strftime(created_at::TIMESTAMPTZ AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at, coalesce(favorite_count, 0) AS favorite_count, coalesce(bookmark_count, 0) AS bookmark_count,
           nullif(article_id, '') AS article_id, article_title, article_preview, 'https://x.com/' || coalesce(nullif(screen_name, ''), 'i') || '/status/' || tweet_id AS url, '{_SEEN}' AS last_seen_at
    FROM ({_LATEST}) p LEFT JOIN authors USING (author_id)""")
def normalized_posts(spark, d):
    made = normalize.bookmarks(normalize.posts(_pages(spark, d, "post")), _SEEN)
    return made.select("tweet_id", "sort_index", "author_id", "text", "is_long", "lang", "created_at", "favorite_count", "bookmark_count", "article_id", "article_title", "article_preview", "url", "last_seen_at")


@_query("""
    SELECT author_id, screen_name, name, avatar_url, coalesce(verified, 0)::INT AS verified, description FROM authors WHERE author_id IN (SELECT author_id FROM bookmarks)""")
def normalized_authors(spark, d):
    return normalize.authors(normalize.posts(_pages(spark, d, "post")))


@_query("""
    WITH m AS (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY tweet_id) AS r FROM media)
    SELECT media_key, kind, CASE WHEN kind IN ('video', 'animated_gif') THEN CASE WHEN url IS NULL OR coalesce(bitrate, 0) < coalesce(small_bitrate, 0) OR (coalesce(bitrate, 0) = coalesce(small_bitrate, 0) AND coalesce(small_url, '') <> '') THEN coalesce(nullif(small_url, ''), url) ELSE url END ELSE url END AS url,
           url AS thumb_url, alt_text, width, height, duration_ms FROM m
    WHERE media_key <> '' AND kind IS NOT NULL AND url IS NOT NULL""")
def normalized_media(spark, d):
    return normalize.media(normalize.posts(_pages(spark, d, "media"))).select("media_key", "kind", "url", "thumb_url", "alt_text", "width", "height", "duration_ms")


@_query(r"""
    SELECT tweet_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') AS domain,
           CASE WHEN from_card = 1 THEN nullif(title, '') END AS title, CASE WHEN from_card = 1 THEN nullif(description, '') END AS description, CASE WHEN from_card = 1 THEN nullif(thumb_url, '') END AS thumb_url, coalesce(from_card, 0) AS from_card
    FROM (SELECT DISTINCT * FROM links) WHERE url <> '' AND NOT contains(url, '//x.com/') AND NOT contains(url, '//twitter.com/')""")
def normalized_links(spark, d):
    """Each link as that of a post of its own; the post's number is cut off again."""
    made = normalize.links(normalize.posts(_pages(spark, d, "links")))
    return made.withColumn("tweet_id", F.substring_index("tweet_id", "-", 1))


@_query("""
    SELECT count(*) AS pages, count(*) AS posts, 0::BIGINT AS media, count(*) AS links, count(DISTINCT tweet_id) AS distinct_posts FROM bookmarks""")
def normalized_tallies(spark, d):
    return normalize.tallies(_pages(spark, d, "post"))


# ---- articles and translations ----


@_query(rf"""
    WITH t AS (SELECT doc_id, word_count AS w, body, error, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE regexp_replace(string_split(text, chr(10) || chr(10))[1] || chr(10) || coalesce(title, ''), '{_STRIP}', '', 'g') END AS truth FROM documents WHERE kind = 'x_article'),
    n AS (SELECT *, coalesce(len(list_filter(regexp_split_to_array(truth, '{_WS}+'), lambda x: x <> '')), 0) AS e FROM t)
    SELECT doc_id, (CASE WHEN truth <> '' AND coalesce(w, 0) < e * 0.7 THEN e ELSE coalesce(w, 0) END)::INT AS word_count, left(sha256(CASE WHEN truth <> '' AND coalesce(w, 0) < e * 0.7 THEN truth ELSE body END), 16) AS body,
           CASE WHEN truth <> '' AND coalesce(w, 0) < e * 0.7 THEN 'rendered extraction was short; used authoritative text (' || e || ' words)' WHEN coalesce(truth, '') = '' AND coalesce(w, 0) < 60 THEN 'thin extraction (' || coalesce(w, 0) || ' words)' ELSE error END AS error FROM n""")
def articles_checked(spark, d):
    """Articles against a response in JSON that carries their first paragraph and title, for two of three of them, and the rules for short ones."""
    rows = table(spark, d, "documents").where("kind = 'x_article'")
    blocks = F.array(F.struct(F.split("text", "\n\n")[0].alias("text")), F.struct(F.coalesce("title", F.lit("")).alias("text")))
    payload = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("n")), F.struct(F.lit(1).alias("n"))).alias("first"), F.struct(F.struct(blocks.alias("blocks")).alias("content_state")).alias("data")))
    held = rows.withColumn("truth", F.when((F.col("doc_id") % 3 != 0) & F.col("text").isNotNull(), tx.given(articles.article_text(payload))))
    return articles.checked(held).select("doc_id", F.col("word_count"), tx.content_hash(F.col("body")).alias("body"), "error")


@_query("""
    WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
    r AS (
      SELECT doc_id, 1 AS i, ps[1] AS left_, NULL::VARCHAR AS held, NULL::VARCHAR AS done, 0 AS n FROM d
      UNION ALL
      SELECT doc_id,
             CASE WHEN length(left_) > 1500 THEN i ELSE i + 1 END,
             CASE WHEN length(left_) > 1500 THEN left_[1501:] ELSE ps[i + 1] END,
             CASE WHEN length(left_) > 1500 THEN left_[:1500] WHEN held IS NOT NULL AND length(held) + length(left_) + 2 <= 1500 THEN held || chr(10) || chr(10) || left_ ELSE left_ END,
             CASE WHEN length(left_) > 1500 THEN held WHEN held IS NOT NULL AND length(held) + length(left_) + 2 <= 1500 THEN NULL ELSE held END,
             CASE WHEN held IS NULL OR (length(left_) <= 1500 AND length(held) + length(left_) + 2 <= 1500) THEN n ELSE n + 1 END
      FROM r JOIN d USING (doc_id) WHERE left_ IS NOT NULL)
    SELECT doc_id, (n - 1)::INT AS position, left(sha256(done), 16) AS hash FROM r WHERE done IS NOT NULL
    UNION ALL SELECT doc_id, n::INT, left(sha256(held), 16) FROM r WHERE left_ IS NULL""")
def translation_pieces(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.translation_pieces(F.col("text"))).alias("position", "piece"))
    return rows.select("doc_id", "position", tx.content_hash(F.col("piece")).alias("hash"))


@_query("""
    WITH c AS (SELECT hash, min(text) AS text FROM chunks GROUP BY 1), p AS (SELECT hash, string_split(text, ' ')[1] AS w, length(text) AS n FROM c WHERE length(text) <= 1500)
    SELECT hash, CASE WHEN n % 2 = 0 THEN NULL ELSE 'English of ' || n END AS text, NULL::VARCHAR AS error FROM p""")
def translations_made(spark, d):
    """Short chunks through a translator that says of texts of even length that they are English."""
    rows = table(spark, d, "chunks").groupBy("hash").agg(F.min("text").alias("text")).where("length(text) <= 1500")
    return queues.translated_whole(rows, lambda t: "ENGLISH" if len(t) % 2 == 0 else f"English of {len(t)}").select("hash", "text", "error")


#: Names under which the first round had registered whole forms of queries.
for _name in ("page_states", "document_pages"):
    _QUERIES[f"{_name}_all"], _SQL[f"{_name}_all"] = _QUERIES[_name], _SQL[_name]


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
