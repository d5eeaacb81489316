"""Chunks of posts, quotes, articles, link cards, pages, captions and transcripts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions import text as tx

CAP, OVERLAP = 4800, 200
COLUMNS = ("tweet_id", "source", "ref", "position", "text", "lang")


def spans(text: str, cap: int = CAP, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Where the pieces of a text lie: [start, end) pairs of at most ``cap`` characters.

    A piece runs to the last paragraph end within reach. If another paragraph follows, the piece is filled up with its
    beginning and the next one starts ``overlap`` before that cut, but not before the paragraph; if no character of it
    fits, the next piece starts with it. A paragraph longer than a piece is cut evenly. Empty paragraphs start no piece.
    """
    size = len(text)
    if size <= cap:
        return [(0, size)]
    ends = [m.start() for m in re.finditer("\n\n", text)] + [size]
    found, start, at = [], 0, 0  # ends[at] closes the paragraph in which the next piece starts
    while start < size:
        reach = start + cap
        fits = bisect_right(ends, reach, at) - 1
        if fits < at:
            found.append((start, reach))
            start = reach - overlap
        elif ends[at] == start:
            start, at = start + 2, at + 1
        elif fits == len(ends) - 1:
            found.append((start, size))
            break
        else:
            following, at = ends[fits] + 2, fits + 1
            full = reach > following
            found.append((start, reach if full else ends[fits]))
            start = max(following, reach - overlap) if full else following
    return found


def pieces(text: str, cap: int = CAP, overlap: int = OVERLAP) -> list[str]:
    return [text[a:b] for a, b in spans(text, cap, overlap)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else pieces(t))


def split(text: Column) -> Column:
    """The pieces of a text. Only a text above the cap goes to Python; null gives none."""
    whole = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.length(text) > CAP, _pieces(F.when(F.length(text) > CAP, text))).otherwise(whole)


#: Characters of a piece that is sent to a translator.
TRANSLATED = 1500


def translation_spans(text: str, cap: int = TRANSLATED) -> list[tuple[int, int]]:
    """Where the pieces for a translator lie: whole paragraphs while they fit, a longer one cut every ``cap`` characters; no overlap.

    The rest of a cut paragraph is joined by what follows, if that fits.
    """
    found: list[tuple[int, int]] = []
    start = 0
    for end in [*(m.start() for m in re.finditer("\n\n", text)), len(text)]:
        whole = max(0, (end - start - 1) // cap)
        found += [(start + i * cap, start + (i + 1) * cap) for i in range(whole)]
        rest = start + whole * cap
        if found and not whole and end - found[-1][0] <= cap:
            found[-1] = (found[-1][0], end)
        else:
            found.append((rest, end))
        start = end + 2
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _translation_pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else [t[a:b] for a, b in translation_spans(t)])


def translation_pieces(text: Column) -> Column:
    """The pieces of a text for a translator; only a text above the cap goes to Python, null gives none."""
    whole = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.length(text) > TRANSLATED, _translation_pieces(F.when(F.length(text) > TRANSLATED, text))).otherwise(whole)


def flat_pieces(text: Column, cap: int = CAP, overlap: int = OVERLAP) -> Column:
    """The pieces of a text without paragraphs, in closed form: (start, text) structs."""
    step = cap - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - cap) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.substr(text, i * step + 1, F.lit(cap)).alias("text")))


def post_chunks(posts: DataFrame, authors: DataFrame, with_article: DataFrame) -> DataFrame:
    """Post, quote and article stub share one position counter; the stub is left out for the posts in ``with_article``."""
    rows = posts.join(authors.select("author_id", "screen_name"), "author_id", "left")
    rows = rows.join(with_article.select("tweet_id", F.lit(True).alias("has")).distinct(), "tweet_id", "left")
    title, preview = tx.given(F.col("article_title")), F.coalesce("article_preview", F.lit(""))
    stub = F.when(title.isNotNull() & F.col("has").isNull(), tx.strip(F.concat(title, F.lit("\n\n"), preview)))
    kinds = [("post", tx.strip(F.col("text"))), ("quote", tx.strip(F.col("quoted_text"))), ("article", stub)]
    marked = lambda source: lambda p: F.struct(F.lit(source).alias("source"), p.alias("piece"))
    each = [F.transform(split(tx.given(t)), marked(s)) for s, t in kinds]
    made = rows.select("tweet_id", "lang", "screen_name", F.posexplode(F.concat(*each)).alias("position", "c"))
    return made.select("tweet_id", "c.source", F.lit(None).cast("string").alias("ref"), "position", F.concat(tx.handle(F.col("screen_name")), F.lit(": "), F.col("c.piece")).alias("text"), "lang")


def card_chunks(links: DataFrame, posts: DataFrame, covered: DataFrame) -> DataFrame:
    """Cards with a title or description whose page wasn't read; never split."""
    rows = links.join(posts.select("tweet_id").distinct(), "tweet_id", "left_semi").join(covered.select("url").distinct(), "url", "left_anti")
    made = rows.select("tweet_id", F.lit("link").alias("source"), F.col("url").alias("ref"), F.lit(0).alias("position"), tx.card_text(F.col("domain"), F.col("title"), F.col("description")).alias("text"), F.lit(None).cast("string").alias("lang"))
    return made.where("text IS NOT NULL")


def readable(documents: DataFrame, least: int = 60) -> DataFrame:
    """Documents with enough words; a video with any."""
    return documents.where((F.col("word_count") >= least) | ((F.col("kind") == "video") & (F.col("word_count") > 0)))


def owners(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (tweet_id, url): the post that owns a document, and those that link to it."""
    linked = links.join(documents.select("url").distinct(), "url", "left_semi").select("tweet_id", "url")
    return documents.where("tweet_id IS NOT NULL").select("tweet_id", "url").union(linked).distinct()


def document_chunks(documents: DataFrame, owned: DataFrame, posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Chunks of each readable document for each live post that has it; the head is inside the split text. Markup is removed once a page."""
    body = documents.select("url", "kind", "site", "title", "lang", tx.once(tx.prose(F.col("body"))).alias("body")).where("body <> ''")
    video = F.col("kind").isin("x_article", "video")
    who = posts.select("tweet_id", "author_id").join(authors.select("author_id", "screen_name"), "author_id", "left").select("tweet_id", "screen_name")
    rows = owned.join(who, "tweet_id").join(body, "url")
    site = F.coalesce(tx.given(F.col("site")), tx.given(tx.url_host(F.col("url"))), F.lit("link"))
    label = F.when(video, tx.handle(F.col("screen_name"))).otherwise(site)
    head = F.concat(label, F.lit(":"), F.when(tx.given(F.col("title")).isNotNull(), F.concat(F.lit(" "), F.col("title"))).otherwise(""))
    source = F.when(F.col("kind") == "x_article", "article").when(F.col("kind") == "video", "video").otherwise("link")
    whole = rows.select("tweet_id", source.alias("source"), F.col("url").alias("ref"), "lang", tx.once(F.concat(head, F.lit("\n\n"), F.col("body"))).alias("whole"))
    made = whole.select("tweet_id", "source", "ref", "lang", F.posexplode(split(F.col("whole"))).alias("position", "text"))
    return made.select(*COLUMNS)


def image_chunks(captions: DataFrame, media: DataFrame, posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Chunks of usable captions, the handle on every piece."""
    rows = captions.where("error IS NULL AND text <> ''").select("media_key", F.col("text").alias("caption"))
    rows = rows.join(media.select("media_key", "tweet_id"), "media_key").join(posts.select("tweet_id", "author_id", "lang"), "tweet_id")
    rows = rows.join(authors.select("author_id", "screen_name"), "author_id", "left")
    made = rows.select("tweet_id", "media_key", "lang", "screen_name", F.posexplode(split(tx.given(tx.strip(F.col("caption"))))).alias("position", "piece"))
    return made.select("tweet_id", F.lit("image").alias("source"), F.col("media_key").alias("ref"), "position", F.concat(tx.handle(F.col("screen_name")), F.lit(": "), F.col("piece")).alias("text"), "lang")


def paragraphs(segments: DataFrame, least: float = 60.0) -> DataFrame:
    """(key, start, text, words): segments (key, start, text) as paragraphs of at least ``least`` seconds, counted from a paragraph's first segment.

    Each key's segments are sorted into one partition and streamed; only the open paragraph is carried from batch to batch,
    so memory doesn't follow the length of a recording.
    """
    spoken = segments.select("key", "start", tx.strip(F.col("text")).alias("text")).where("text <> ''").withColumn("start", F.col("start").cast("double"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = begun = last = None
        held: list[str] = []
        schema = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(3)], ["key", "start", "text"])

        for batch in batches:
            schema, done = batch.schema, []
            for k, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (k != key or (begun is not None and at - begun >= least) or (last is not None and at - last >= least)):
                    done.append((key, begun, " ".join(held)))
                    held = []
                if not held:
                    key, begun = k, at
                held.append(text)
                last = at
            yield batch_of(done)
        if held:
            yield batch_of([(key, begun, " ".join(held))])

    ordered = spoken.repartition("key").sortWithinPartitions("key", "start", "text")
    made = ordered.mapInArrow(fold, T.StructType([T.StructField(f.name, f.dataType) for f in ordered.schema.fields]))
    return made.select("key", "start", "text", tx.word_count(F.col("text")).alias("words"))


def transcript(segments: DataFrame, least: float = 60.0) -> DataFrame:
    """(key, body, words): one document for each recording, its paragraphs marked with their time."""
    line = F.concat(F.lit("<p>["), tx.clock(F.col("start")), F.lit("] "), tx.escape_html(F.col("text")), F.lit("</p>"))
    marked = paragraphs(segments, least).select("key", "words", F.struct("start", line.alias("line")).alias("x"))
    made = marked.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("words").alias("words"))
    return made.select("key", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("body"), "words")


def collect(posts: DataFrame, authors: DataFrame, links: DataFrame, documents: DataFrame, captions: DataFrame, media: DataFrame) -> DataFrame:
    """All chunks that the live posts should have, with ``kind`` as the order of their sources."""
    good = readable(documents)
    owned = owners(documents, links).join(posts.select("tweet_id").distinct(), "tweet_id", "left_semi")
    held = good.join(owned, "url", "left_semi")
    article = owned.join(good.where("kind = 'x_article'").select("url"), "url", "left_semi")
    parts = [
        post_chunks(posts, authors, article),
        card_chunks(links, posts, held.where("kind <> 'x_article'")),
        document_chunks(good, owned, posts, authors),
        image_chunks(captions, media, posts, authors),
    ]
    made = [p.withColumn("kind", F.lit(i)) for i, p in enumerate(parts)]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.withColumn("hash", tx.content_hash(F.col("text")))
