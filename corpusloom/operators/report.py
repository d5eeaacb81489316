"""Profiling of a corpus: each group of figures in one pass over its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import text as tx
from corpusloom.session import running


def median(df: DataFrame, value: str, *, name: str = "median") -> DataFrame:
    """One row: the exact median of a column without nulls, null if it has no rows. Rows are counted by value before they are put in order."""
    counts = running(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")), "counts", "n", "v")
    total = counts.agg(F.sum("n").alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("v")))
    return counts.join(F.broadcast(total)).agg(((at(low) + at(high)) / 2.0).alias(name))  # the other side is one row


def post_counts(posts: DataFrame) -> DataFrame:
    """Totals over the latest rows of all posts."""
    live = F.col("removed_at").isNull()
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    size = F.when(live & (F.length("text") > 0), F.length("text"))
    made = posts.agg(
        F.count("*").alias("total"), F.count_if(~live).alias("removed"), F.count_if(live).alias("live"),
        F.count_if(live & (F.col("is_long") == 1)).alias("long"), F.count_if(live & some("quoted_tweet_id")).alias("quotes"), F.count_if(live & some("article_id")).alias("articles"),
        F.count_if(live & F.col("lang").isNotNull() & ~F.col("lang").isin(*tx.UNREPORTED)).alias("foreign"),
        F.min(F.when(live, F.col("created_at"))).alias("oldest"), F.max(F.when(live, F.col("created_at"))).alias("newest"),
        F.count_if(live & (F.col("text") == "")).alias("empty"), F.sum(size).alias("chars"),
    )
    middle = median(posts.where(live & (F.length("text") > 0)).select(F.length("text").alias("size")), "size", name="median_chars")
    return made.join(F.broadcast(middle.select(F.col("median_chars").cast("int").alias("median_chars"))))  # two single rows


def languages(posts: DataFrame) -> DataFrame:
    return posts.where("removed_at IS NULL").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("posts"))


def media_kinds(posts: DataFrame, media: DataFrame) -> DataFrame:
    """Media of live posts by kind."""
    rows = media.join(posts.where("removed_at IS NULL").select("tweet_id"), "tweet_id", "left_semi")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce("alt_text", F.lit("")) != "").alias("with_alt"), F.count_distinct("tweet_id").alias("posts"))


def videos(posts: DataFrame, media: DataFrame, long_s: int = 600) -> DataFrame:
    """Seconds and bytes of the videos and animated pictures of live posts."""
    rows = media.join(posts.where("removed_at IS NULL").select("tweet_id"), "tweet_id", "left_semi").where("kind IN ('video', 'animated_gif') AND duration_ms > 0")
    seconds = F.col("duration_ms") / 1000.0
    size = lambda rate: F.sum(F.coalesce(rate, F.lit(0)) * seconds / 8)
    made = rows.agg(
        F.count("*").alias("videos"), F.sum(seconds).alias("seconds"), F.max(seconds).alias("longest_s"), F.count_if(seconds > long_s).alias("long"),
        size(F.col("bitrate")).alias("best_bytes"), size(F.coalesce(F.nullif("small_bitrate", F.lit(0)), "bitrate")).alias("small_bytes"),
    )
    made = made.join(F.broadcast(median(rows.select(seconds.alias("s")), "s", name="median_s")))  # two single rows
    return made.select(
        "videos", F.round("seconds", 3).alias("seconds"), F.round("median_s", 3).alias("median_s"), F.round("longest_s", 3).alias("longest_s"), "long",
        F.round("best_bytes", 0).alias("best_bytes"), F.round("small_bytes", 0).alias("small_bytes"),
    )


def top_domains(posts: DataFrame, links: DataFrame, limit: int = 15) -> DataFrame:
    rows = links.where("domain IS NOT NULL").join(posts.where("removed_at IS NULL").select("tweet_id"), "tweet_id", "left_semi")
    return rows.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(limit)


def top_authors(posts: DataFrame, authors: DataFrame, limit: int = 15) -> DataFrame:
    """Counted before the join, so that a skewed author costs one row."""
    n = posts.where("removed_at IS NULL").groupBy("author_id").agg(F.count("*").alias("n"))
    return n.join(authors.select("author_id", "screen_name"), "author_id").orderBy(F.desc("n"), "screen_name").limit(limit).select("screen_name", "n")


def media_posts(posts: DataFrame, media: DataFrame) -> DataFrame:
    """One row: live posts with media, and media with a description."""
    rows = media.join(posts.where("removed_at IS NULL").select("tweet_id"), "tweet_id", "left_semi")
    return rows.agg(F.count_distinct("tweet_id").alias("with_media"), F.count_if(F.coalesce("alt_text", F.lit("")) != "").alias("with_alt"))


def link_counts(posts: DataFrame, links: DataFrame) -> DataFrame:
    """One row: links of live posts, and the distinct domains they lead to."""
    rows = links.join(posts.where("removed_at IS NULL").select("tweet_id"), "tweet_id", "left_semi")
    return rows.agg(F.count("*").alias("links"), F.count_distinct("domain").alias("domains"))


def captions(rows: DataFrame) -> DataFrame:
    """One row: captions that came out and that failed."""
    return rows.agg(F.count_if(F.col("error").isNull() & (F.col("text") != "")).alias("captioned"), F.count_if(F.col("error").isNotNull()).alias("caption_failed"))


def _row_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # single rows
    return out


def status(posts: DataFrame, media: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, captions_: DataFrame | None = None) -> DataFrame:
    """One row of counters; without a table of captions, the described photos count as captioned."""
    video, body, error = F.col("kind") == "video", F.coalesce("body", F.lit("")) != "", F.coalesce("error", F.lit("")) != ""
    described = media.where("kind = 'photo'").select(F.lit(None).cast("string").alias("error"), F.col("alt_text").alias("text"))
    parts = [
        posts.agg(F.count_if(F.col("removed_at").isNull()).alias("bookmarks")),
        media.agg(F.count_if(F.col("kind") == "photo").alias("photos"), F.count_if(video).alias("videos")),
        captions(described if captions_ is None else captions_).select("captioned"),
        documents.agg(F.count_if(video & F.col("error").isNull()).alias("transcribed"), F.count_if(video & (F.col("word_count") > 0)).alias("speech"), F.count_if(~video & body).alias("pages"), F.count_if(error & ~body).alias("failed_pages")),
        chunks.agg(F.count_distinct("id").alias("chunks"), F.count_distinct(F.when(F.coalesce("source_text", F.lit("")) != "", F.col("id"))).alias("translated")),
        vectors.where("embedding IS NOT NULL").agg(F.count_distinct("chunk_id").alias("embedded")),
    ]
    return _row_of(parts)


def gather(posts: DataFrame, authors: DataFrame, links: DataFrame, media: DataFrame, captions_: DataFrame | None = None, raw_pages: DataFrame | None = None, state: dict | None = None) -> dict:
    """The whole report as plain values; every part is a small aggregate. ``state`` has the mark and time of the last ingest."""
    row = lambda df: (df.first() or {}).asDict()
    table = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731 - at most 15 rows, or one for each kind
    none = {"captioned": 0, "caption_failed": 0}
    return {
        "posts": row(post_counts(posts)), "authors_total": authors.count(), "raw_pages": 0 if raw_pages is None else raw_pages.count(), "state": state or {},
        "languages": table(languages(posts).orderBy(F.desc("posts"), "lang").limit(12)), "media": table(media_kinds(posts, media).orderBy(F.desc("n"), "kind")), "media_posts": row(media_posts(posts, media)),
        "videos": row(videos(posts, media)), "captions": none if captions_ is None else row(captions(captions_)), "links": row(link_counts(posts, links)),
        "domains": table(top_domains(posts, links)), "authors": table(top_authors(posts, authors)),
    }


def _length(seconds: float | None) -> str:
    s = int(seconds or 0)
    return f"{s}s" if s < 60 else f"{s // 60}m {s % 60}s" if s < 3600 else f"{s // 3600}h {s // 60 % 60}m"


def _size(n: float | None) -> str:
    n, units = n or 0.0, ["B", "KB", "MB", "GB", "TB"]
    while n >= 1024 and len(units) > 1:
        n, units = n / 1024, units[1:]
    return f"{n:.1f} {units[0]}"


def render(stats: dict) -> str:
    """The report as lines of text."""
    p, v, m, c, k, state = (stats[x] for x in ("posts", "videos", "media_posts", "captions", "links", "state"))
    photos = next((r["n"] for r in stats["media"] if r["kind"] == "photo"), 0)
    named = lambda name, key, n: f"{name}: " + ", ".join(f"{r[key]} {r[n]:,}" for r in stats[name.lower()])
    return "\n".join([
        f"Posts: {p['live']:,} live, {p['removed']:,} removed, {stats['authors_total']:,} authors, {stats['raw_pages']:,} raw pages, last ingest {state.get('last_sync_at') or 'never'}",
        f"From {(p['oldest'] or '?')[:10]} to {(p['newest'] or '?')[:10]}",
        f"Text: median {p['median_chars'] or 0:,} characters, {p['chars'] or 0:,} in all; {p['long']:,} long, {p['quotes']:,} with a quote, {p['empty']:,} empty, {p['articles']:,} articles",
        named("Languages", "lang", "posts") + f"; {p['foreign']:,} to translate", named("Media", "kind", "n") + f"; {m['with_media'] or 0:,} posts with media, {m['with_alt'] or 0:,} descriptions",
        f"Videos: {v['videos']:,}, {_length(v['seconds'])}, median {_length(v['median_s'])}, longest {_length(v['longest_s'])}, {v['long']:,} over ten minutes; {_size(v['small_bytes'])} at the smallest, {_size(v['best_bytes'])} at the best",
        named("Domains", "domain", "n") + f"; {k['links']:,} links to {k['domains']:,} domains", named("Authors", "screen_name", "n"),
        f"Work: {c['captioned']:,} of {photos:,} photos captioned ({c['caption_failed']:,} failed), {k['links']:,} pages, {p['articles']:,} articles, {p['foreign']:,} translations",
    ])
