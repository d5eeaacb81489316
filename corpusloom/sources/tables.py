"""Tables of a corpus folder, and raw timeline pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

_USER = "struct<rest_id:string,core:struct<screen_name:string,name:string>,avatar:struct<image_url:string>,is_blue_verified:boolean,legacy:struct<screen_name:string,name:string,profile_image_url_https:string,verified:boolean,description:string>>"
_URLS = "array<struct<url:string,expanded_url:string>>"
_MEDIA = "array<struct<media_key:string,type:string,url:string,media_url_https:string,ext_alt_text:string,original_info:struct<width:bigint,height:bigint>,video_info:struct<duration_millis:bigint,variants:array<struct<content_type:string,bitrate:bigint,url:string>>>>>"
_LEGACY = f"struct<full_text:string,created_at:string,lang:string,conversation_id_str:string,favorite_count:bigint,retweet_count:bigint,reply_count:bigint,quote_count:bigint,bookmark_count:bigint,entities:struct<urls:{_URLS}>,extended_entities:struct<media:{_MEDIA}>>"


def _tweet(quoted: str | None) -> str:
    inner = (
        f"__typename:string,rest_id:string,core:struct<user_results:struct<result:{_USER}>>,legacy:{_LEGACY},"
        f"note_tweet:struct<note_tweet_results:struct<result:struct<text:string,entity_set:struct<urls:{_URLS}>>>>,"
        "card:struct<legacy:struct<url:string,binding_values:array<struct<key:string,value:struct<string_value:string,image_value:struct<url:string>>>>>>,"
        "article:struct<article_results:struct<result:struct<rest_id:string,id:string,title:string,preview_text:string>>>"
    )
    return f"struct<{inner}" + (f",quoted_status_result:struct<result:{quoted}>" if quoted else "") + ">"


def _wrapped(quoted: str | None) -> str:
    """A post, or a wrapper that holds it in ``tweet``."""
    bare = _tweet(quoted)
    return bare[:-1] + f",tweet:{bare}>"


#: One raw page; a post may be wrapped and may quote another.
PAGE = (
    "struct<data:struct<bookmark_timeline_v2:struct<timeline:struct<instructions:array<struct<type:string,entries:array<struct<entryId:string,sortIndex:string,"
    f"content:struct<entryType:string,cursorType:string,value:string,itemContent:struct<itemType:string,tweet_results:struct<result:{_wrapped(_wrapped(None))}>>>>>>>>>>>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_posts(bookmarks: DataFrame) -> DataFrame:
    """One row for each post: the payload of its last arrival, the first capture and the last sighting.

    A struct of the payload travels through a partial aggregation, so a post with many rows is reduced before the shuffle.
    """
    payload = [c for c in bookmarks.columns if c not in ("tweet_id", "captured_at", "last_seen_at")]
    order = F.struct("ingested_at", "last_seen_at", F.xxhash64(*payload).alias("tie"))
    kept = F.max(F.struct(order.alias("order"), F.struct(*payload).alias("payload"))).alias("last")
    found = bookmarks.groupBy("tweet_id").agg(kept, F.min("captured_at").alias("captured_at"), F.max("last_seen_at").alias("last_seen_at"))
    return found.select("tweet_id", "captured_at", "last_seen_at", "last.payload.*")


def live_posts(bookmarks: DataFrame) -> DataFrame:
    return latest_posts(bookmarks).where("removed_at IS NULL")


def raw_pages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Pages (path, seq, page) of ``root/*/page-*.json`` in path order, and rejects (path) that are no JSON.

    ``seq`` is the order of the path as text, ready for last-wins folds; no global sort is needed for it.
    """
    text = spark.read.option("wholetext", True).text(f"{root}/*/page-*.json").select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = text.select("path", "value", F.from_json("value", PAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("page"))
    good = F.try_parse_json("value").isNotNull()
    return parsed.where(good).select("path", F.col("path").alias("seq"), "page"), text.where(~good).select("path")


def entries(pages: DataFrame) -> DataFrame:
    """Every entry of every instruction of the pages: (seq, instruction, at, entry)."""
    steps = pages.select("seq", F.posexplode("page.data.bookmark_timeline_v2.timeline.instructions").alias("instruction", "step"))
    return steps.select("seq", "instruction", F.posexplode("step.entries").alias("at", "entry"))


def bottom_cursor(pages: DataFrame) -> DataFrame:
    """(seq, cursor) of the first bottom cursor of each page."""
    found = entries(pages).where("entry.content.cursorType = 'Bottom'")
    return found.groupBy("seq").agg(F.min_by("entry.content.value", F.struct("instruction", "at")).alias("cursor"))
