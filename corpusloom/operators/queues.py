"""Work that is still to be done by the enrichers, by anti-joins against what was tried."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking
from corpusloom.operators.indexing import without_sources

ATTEMPTS = 2


def _open(tried: DataFrame, retry_failed: bool) -> Column:
    """Whether a url is wanted, given the latest try: never tried, or failed and not too often."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return F.col("attempts").isNull() | (failed & (F.lit(retry_failed) | (F.col("attempts") < ATTEMPTS)))


def pending_pages(posts: DataFrame, authors: DataFrame, links: DataFrame, documents: DataFrame, *, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    """(url, kind, tweet_id) still to be fetched: articles of live posts by falling sort index (as text), then distinct links by url."""
    done = documents.groupBy("url").agg(F.max_by("error", F.struct("fetched_at", "doc_id")).alias("error"), F.sum("attempts").alias("attempts"))
    sort = F.col("sort_index") if "sort_index" in posts.columns else F.lit(None).cast("string")
    articles = posts.where("article_id IS NOT NULL").select("tweet_id", "author_id", sort.alias("sort_index")).join(authors.select("author_id", "screen_name"), "author_id")
    url = F.concat(F.lit("https://x.com/"), F.col("screen_name"), F.lit("/status/"), F.col("tweet_id"))
    jobs = articles.select(url.alias("url"), F.lit("x_article").alias("kind"), "tweet_id", "sort_index")
    none = F.lit(None).cast("string")
    live = links.join(posts.select("tweet_id"), "tweet_id", "left_semi").select("url").distinct()
    jobs = jobs.unionByName(live.select("url", F.lit("link").alias("kind"), none.alias("tweet_id"), none.alias("sort_index")))
    jobs = jobs.join(done, "url", "left").where(_open(done, retry_failed)).orderBy(F.desc("kind"), F.desc_nulls_last("sort_index"), "url")
    return _first(jobs.select("url", "kind", "tweet_id"), limit)


def _first(jobs: DataFrame, limit: int | None) -> DataFrame:
    return jobs if limit is None else jobs.limit(limit)


def pending_videos(posts: DataFrame, authors: DataFrame, media: DataFrame, documents: DataFrame, *, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    """(url, small_url, duration_ms) of videos of live posts without a document, the longest first; ``limit`` takes the shortest.

    With ``retry_failed``, videos whose document has an error are wanted too.
    """
    rows = media.where("kind = 'video' AND small_url IS NOT NULL").join(posts.select("tweet_id", "author_id"), "tweet_id")
    rows = rows.join(authors.select("author_id", "screen_name"), "author_id", "left")
    url = F.concat(F.lit("https://x.com/"), F.coalesce(tx.given(F.col("screen_name")), F.lit("i")), F.lit("/status/"), F.col("tweet_id"), F.lit("/video/"), (F.col("position") + 1).cast("string"))
    done = documents.where("coalesce(error, '') = ''") if retry_failed else documents
    rows = rows.select(url.alias("url"), "small_url", "duration_ms").join(done.select("url"), "url", "left_anti")
    if limit is not None:
        rows = rows.orderBy(F.asc_nulls_first("duration_ms"), F.desc("url")).limit(limit)
    return rows.orderBy(F.desc_nulls_last("duration_ms"), "url")


def pending_captions(posts: DataFrame, media: DataFrame, captions: DataFrame, *, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    """(media_key, url) of photos of live posts without a caption, by falling sort index (as text) and place in the post."""
    done = captions.where("error IS NULL") if retry_failed else captions
    sort = F.col("sort_index") if "sort_index" in posts.columns else F.lit(None).cast("string")
    rows = media.where("kind = 'photo'").join(posts.select("tweet_id", sort.alias("sort_index")), "tweet_id").join(done.select("media_key"), "media_key", "left_anti")
    return _first(rows.orderBy(F.desc_nulls_last("sort_index"), "position", "media_key").select("media_key", "url"), limit)


def gated(jobs: DataFrame, least: int = 20) -> DataFrame:
    """The jobs if there are at least ``least`` of them, else none: an expensive start waits for enough work."""
    enough = jobs.limit(least).agg((F.count("*") >= least).alias("enough")).where("enough")
    return jobs.join(F.broadcast(enough.select(F.lit(1))))  # the other side has one row or none


def pending_translations(chunks: DataFrame, cache: DataFrame, exclude: list[str]) -> DataFrame:
    """(hash, text) of distinct foreign texts that the cache doesn't have; a cached null counts as answered."""
    rows = without_sources(chunks, exclude).where(tx.is_foreign(F.col("text"), F.col("lang")))
    return rows.join(cache.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.min("text").alias("text"))


def outcome(error: Column, text: Column, empty: str) -> Column:
    """failed, ``empty`` or ok."""
    return F.when(F.coalesce(error, F.lit("")) != "", "failed").when(F.coalesce(text, F.lit("")) == "", empty).otherwise("ok")


def page_states(documents: DataFrame) -> DataFrame:
    """(doc_id, readable, words, outcome) of every document: one without text has 0 words, and is failed or empty as its error says."""
    good = (F.col("word_count") >= 60) | ((F.col("kind") == "video") & (F.col("word_count") > 0))
    state = outcome(F.when(F.coalesce("body", F.lit("")) == "", F.col("error")), F.col("body"), "empty")
    return documents.select("doc_id", good.alias("readable"), tx.word_count(F.col("text")).cast("bigint").alias("words"), state.alias("outcome"))


def _first_line(e: Exception, most: int) -> str:
    return (str(e).splitlines() or [type(e).__name__])[0][:most]


def enriched(rows: DataFrame, key: str, value: str, enricher: Callable[[Any], str | None]) -> DataFrame:
    """(key, text, error) by ``enricher``, a function of one value that may raise; a failure is a row, not a stop."""

    def one(v: Any) -> tuple[str | None, str | None]:
        try:
            return enricher(v), None
        except Exception as e:  # noqa: BLE001
            return None, _first_line(e, 500)

    return _answered(rows, key, value, lambda values: map(one, values))


def captioned(rows: DataFrame, key: str, url: str, captioner: Callable[[list[str]], list[dict]], batch: int = 64) -> DataFrame:
    """(key, text, error) by ``captioner``, a function from at most ``batch`` urls to one {"text"} or {"error"} for each, in order.

    A batch that raises gives its error to each of its rows.
    """

    def some(values: list[str]) -> Iterator[tuple[str | None, str | None]]:
        for i in range(0, len(values), batch):
            part = values[i : i + batch]
            try:
                made = list(captioner(part))
                if len(made) != len(part):
                    raise ValueError(f"{len(made)} answers to {len(part)} urls")
            except Exception as e:  # noqa: BLE001
                made = [{"error": _first_line(e, 200)}] * len(part)
            yield from ((m.get("text"), m.get("error")) for m in made)

    return _answered(rows, key, url, some)


def _answered(rows: DataFrame, key: str, value: str, answer: Callable[[list], Iterable[tuple]]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = list(answer(pdf[value].tolist()))
            yield pdf[[key]].assign(text=[t for t, _ in made], error=[e for _, e in made])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, value).mapInPandas(run, f"`{key}` {kind}, text string, error string")


SEGMENTS = "array<struct<start:double,end:double,text:string>>"


def transcribed(jobs: DataFrame, transcriber: Callable[[list[dict]], Iterator[dict]], batch: int = 8) -> DataFrame:
    """(url, segments, lang, error) of the jobs (url, small_url, duration_ms) by ``transcriber``: a function from at most ``batch`` jobs to answers {url, segments, lang, error} in any order.

    A job without an answer, and each job of a batch that raises, has an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            asked, out = pdf.to_dict("records"), []
            for i in range(0, len(asked), batch):
                part, fault = asked[i : i + batch], "no answer"
                got: dict[str, dict] = {}
                try:
                    got = {a["url"]: a for a in transcriber(part)}
                except Exception as e:  # noqa: BLE001
                    fault = _first_line(e, 500)
                for job in part:
                    a = got.get(job["url"], {"error": fault})
                    out.append((job["url"], a.get("segments") or [], a.get("lang"), a.get("error")))
            yield pd.DataFrame(out, columns=["url", "segments", "lang", "error"])

    return jobs.select("url", "small_url", "duration_ms").mapInPandas(run, f"url string, segments {SEGMENTS}, lang string, error string")


def tallied(outcomes: DataFrame, name: str = "outcome") -> DataFrame:
    """(outcome, n) of a run."""
    return outcomes.groupBy(name).agg(F.count("*").alias("n"))


def translated_whole(chunks: DataFrame, translator: Callable[[str], str], english: str = "ENGLISH") -> DataFrame:
    """(hash, source_text, text, error): each text asked for piece by piece. A piece answered ``english`` stays as it is; if all are, text is null.

    Pieces are asked for in different tasks and put together again by their place; a text with a failed piece has an error and no text.
    """
    each = chunks.select("hash", F.col("text").alias("source_text"), F.posexplode(chunking.translation_pieces(F.col("text"))).alias("at", "piece"))
    asked = each.select("hash", "source_text", "at", "piece", F.concat_ws("/", "hash", "at").alias("key"))
    answers = enriched(asked, "key", "piece", translator).select("key", F.col("text").alias("reply"), "error")
    rows = asked.join(answers, "key")
    own = F.when(F.col("reply") == english, F.col("piece")).otherwise(F.col("reply"))
    made = rows.groupBy("hash").agg(
        F.first("source_text").alias("source_text"), F.bool_and(F.col("reply") == english).alias("same"), F.min("error").alias("error"),
        F.array_sort(F.collect_list(F.struct("at", own.alias("said")))).alias("parts"),
    )
    whole = F.array_join(F.transform("parts", lambda p: p["said"]), "\n\n")
    return made.select("hash", "source_text", F.when(F.col("error").isNull() & ~F.coalesce("same", F.lit(False)), whole).alias("text"), "error")
