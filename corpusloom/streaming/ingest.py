"""Incremental ingest: a stream of raw page files, a high-water mark over sort indexes, and a keyed latest-row table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import normalize
from corpusloom.session import ranked
from corpusloom.sources.tables import PAGE, bottom_cursor, latest_posts


def page_stream(spark: SparkSession, root: str) -> DataFrame:
    """New page files under ``root`` as (path, seq, page); files that are no JSON are left out."""
    text = spark.readStream.schema("value string").option("wholetext", True).text(f"{root}/*/page-*.json")
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", PAGE).alias("page"))
    return rows.where("page.data IS NOT NULL").select("path", F.col("path").alias("seq"), "page")


def watermark(posts: DataFrame) -> str | None:
    """The largest sort index, as a number of any length."""
    return (r := posts.agg(F.max(F.col("sort_index").cast("decimal(38,0)")).alias("m")).first()) and r["m"] is not None and str(r["m"]) or None


def above(posts: DataFrame, mark: str | None) -> DataFrame:
    """Posts beyond the mark; a post at the mark counts as seen."""
    return posts if mark is None else posts.where(F.col("sort_index").cast("decimal(38,0)") > F.lit(mark).cast("decimal(38,0)"))


def stop_reason(first: bool, records: int, repeated_cursor: bool, stalls: int, at_mark: bool, pages: int, most: int | None) -> str | None:
    """Why a walk over pages ends, or None to go on."""
    if not first:
        return "no_first_page"
    if at_mark:
        return "watermark"
    if not records or repeated_cursor or stalls >= 3:
        return "end_of_list"
    return "max_pages" if most is not None and pages >= most else None


def is_clean(reason: str) -> bool:
    """Whether the mark may move after a walk that ended so."""
    return reason in ("end_of_list", "watermark")


def walk(pages: DataFrame, mark: str | None, most: int | None = None) -> tuple[DataFrame, str]:
    """The pages of a walk from the newest on (by ``seq``) that are to be read, and why it ends.

    It ends one page after the first that reaches the mark (equality counts), at the first page without posts or with the
    cursor of an earlier one, or after ``most`` pages. Only counters of pages come to the driver, one row in all.
    """
    sort = F.col("sort_index").cast("decimal(38,0)")
    held = normalize.posts(pages).groupBy("seq").agg(F.count("*").alias("records"), F.min(sort).alias("least"))
    rows = pages.select("seq").distinct().join(held, "seq", "left").join(bottom_cursor(pages), "seq", "left")
    known = rows.groupBy("cursor").agg(F.min("seq").alias("seen")).where("cursor IS NOT NULL")
    rows = rows.join(known, "cursor", "left").withColumns({"empty": F.col("records").isNull(), "again": F.coalesce(F.col("seen") < F.col("seq"), F.lit(False))})
    reached = F.lit(False) if mark is None else F.coalesce(F.col("least") <= F.lit(mark).cast("decimal(38,0)"), F.lit(False))
    at = lambda test: F.min(F.when(test, F.col("seq")))
    found = rows.agg(F.count("*").alias("pages"), at(reached).alias("mark"), at(F.col("empty") | F.col("again")).alias("end")).first()
    over = rows if most is None else ranked(rows.select("seq"), "walk", "seq").where(F.col("rank") < most)
    last = over.agg(F.max("seq")).first()[0]
    if found["mark"] is not None and (found["end"] is None or found["mark"] <= found["end"]) and found["mark"] <= last:
        following = pages.where(F.col("seq") > found["mark"]).agg(F.min("seq")).first()[0]
        return pages.where(F.col("seq") <= (following or found["mark"])), stop_reason(True, 1, False, 0, True, found["pages"], most)
    if found["end"] is not None and found["end"] <= last:
        return pages.where(F.col("seq") <= found["end"]), stop_reason(True, 0, True, 0, False, found["pages"], most)
    reason = stop_reason(found["pages"] > 0, 1, False, 0, False, found["pages"], most)
    return (pages if last is None else pages.where(F.col("seq") <= last)), reason or "end_of_list"


def ingest(pages: DataFrame, out: str, checkpoint: str, seen_at: str, *, run_id: str = "", after: Callable[[dict[str, DataFrame]], None] | None = None) -> StreamingQuery:
    """Append each micro-batch to the tables under ``out``, once for each batch id; the checkpoint and the mark move only after all writes.

    Tables: bookmarks, authors, media, links, raw_pages and, last of all, state. ``tables`` folds them into present rows,
    so a batch that runs again changes nothing. ``after`` gets the present tables when a batch is done, to derive work.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = normalize.posts(batch).persist()
        made = {
            "authors": normalize.authors(rows), "bookmarks": normalize.bookmarks(rows, seen_at).withColumn("ingested_at", F.to_timestamp(F.lit(seen_at))), "media": normalize.media(rows), "links": normalize.links(rows),
            "raw_pages": normalize.page_records(batch).select(F.col("seq").alias("path"), F.lit(run_id).alias("run_id"), F.lit(seen_at).alias("fetched_at"), "entry_count"),
        }
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        mark = rows.agg(F.max(F.col("sort_index").cast("decimal(38,0)")).cast("string").alias("mark")).withColumn("last_sync_at", F.lit(seen_at))
        mark.write.mode("overwrite").parquet(f"{out}/state/batch={number}")
        rows.unpersist()
        if after is not None:
            after(tables(spark, out))

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The present rows of what ``ingest`` has written: the last author, the latest post, the media and links of a post's last batch, a page once."""
    held = {n: spark.read.parquet(f"{out}/{n}") for n in ("authors", "bookmarks", "media", "links", "raw_pages")}
    last = held["bookmarks"].groupBy("tweet_id").agg(F.max("batch").alias("batch"))
    media, links = (held[n].join(last, ["tweet_id", "batch"], "left_semi") for n in ("media", "links"))
    whole = lambda df: F.struct(*(c for c in df.columns if c != "batch"))
    return {
        "bookmarks": latest_posts(held["bookmarks"]),
        "authors": held["authors"].groupBy("author_id").agg(F.max_by(whole(held["authors"]), "batch").alias("x")).select("x.*"),
        "media": media.groupBy("media_key").agg(F.min_by(whole(media), "batch").alias("x")).select("x.*"),
        "links": links.drop("batch"),
        "raw_pages": held["raw_pages"].groupBy("path").agg(F.min_by(F.struct("run_id", "fetched_at"), "batch").alias("x"), F.max_by("entry_count", "batch").alias("entry_count")).select("path", "x.*", "entry_count"),
    }


def stored_mark(spark: SparkSession, out: str) -> str | None:
    """The largest sort index of the batches that are done, as a number of any length."""
    return watermark(spark.read.parquet(f"{out}/state").withColumnRenamed("mark", "sort_index"))


def arrivals(events: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Posts counted by the window of their arrival: works on a batch and, with its watermark, on a stream."""
    rows = events.withWatermark("ingested_at", late) if events.isStreaming else events
    return rows.groupBy(F.window("ingested_at", width).alias("w")).agg(F.count("*").alias("arrivals")).select(F.col("w.start").alias("start"), "arrivals")
