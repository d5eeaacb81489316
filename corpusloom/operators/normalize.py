"""Raw timeline entries to relational rows, and the folds that keep one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text as tx
from corpusloom.sources.tables import entries

_KINDS = ("Tweet", "TweetWithVisibilityResults")


def _unwrapped(result: Column) -> Column:
    """The post itself, from its wrapper if it has one; null if it is neither."""
    inner = result["tweet"]
    fields = ["__typename", "rest_id", "core", "legacy", "note_tweet", "card", "article"]
    pick = lambda r: F.struct(*(r[f].alias(f) for f in fields))
    bare = F.when(result["__typename"] == _KINDS[1], pick(inner)).otherwise(pick(result))
    return F.when(bare["__typename"].isin(*_KINDS) | bare["legacy"].isNotNull(), bare)


def posts(pages: DataFrame) -> DataFrame:
    """(seq, instruction, at, sort_index, tweet, quoted) of the readable posts in the pages."""
    rows = entries(pages).where("entry.content.itemContent.itemType = 'TimelineTweet'")
    result = F.col("entry.content.itemContent.tweet_results.result")
    outer = F.when(result["__typename"] == _KINDS[1], result["tweet"]["quoted_status_result"]["result"]).otherwise(result["quoted_status_result"]["result"])
    rows = rows.select("seq", "instruction", "at", F.coalesce(tx.given(F.col("entry.sortIndex")), F.lit("0")).alias("sort_index"), _unwrapped(result).alias("tweet"), _unwrapped(outer).alias("quoted"))
    return rows.where("tweet.rest_id IS NOT NULL AND tweet.rest_id <> ''")


def _author(tweet: Column) -> dict[str, Column]:
    user = tweet["core"]["user_results"]["result"]
    old = user["legacy"]
    first = lambda a, b: F.coalesce(tx.given(a), b)
    return {
        "author_id": user["rest_id"],
        "screen_name": first(user["core"]["screen_name"], old["screen_name"]),
        "name": first(user["core"]["name"], old["name"]),
        "avatar_url": first(user["avatar"]["image_url"], old["profile_image_url_https"]),
        "verified": (F.coalesce(user["is_blue_verified"], F.lit(False)) | F.coalesce(old["verified"], F.lit(False))).cast("int"),
        "description": old["description"],
    }


def full_text(tweet: Column) -> Column:
    """The fullest text, short links replaced by their targets in order, links to media dropped."""
    note = tweet["note_tweet"]["note_tweet_results"]["result"]
    long = F.coalesce(note["text"], F.lit("")) != ""
    text = F.when(long, note["text"]).otherwise(F.coalesce(tweet["legacy"]["full_text"], F.lit("")))
    urls = F.when(long, note["entity_set"]["urls"]).otherwise(tweet["legacy"]["entities"]["urls"])
    usable = F.filter(F.coalesce(urls, F.array().cast("array<struct<url:string,expanded_url:string>>")), lambda u: (u["url"] != "") & (u["expanded_url"] != ""))
    text = F.aggregate(usable, text, lambda t, u: F.replace(t, u["url"], u["expanded_url"]))
    media = F.filter(F.coalesce(F.transform(tweet["legacy"]["extended_entities"]["media"], lambda m: m["url"]), F.array().cast("array<string>")), lambda u: u != "")
    return tx.strip(F.aggregate(media, text, lambda t, u: F.regexp_replace(F.replace(t, u, F.lit("")), r"(?U)\s+$", "")))


def authors(rows: DataFrame) -> DataFrame:
    """Authors of the posts; the last writer wins on all columns, a missing id is skipped."""
    fields = _author(F.col("tweet"))
    made = rows.select(F.struct("seq", "instruction", "at").alias("order"), *(c.alias(n) for n, c in fields.items())).where("author_id <> ''")
    return made.groupBy("author_id").agg(F.max_by(F.struct(*fields), "order").alias("last")).select("last.*")


def bookmarks(rows: DataFrame, seen_at: str) -> DataFrame:
    """One row for each post; ``seen_at`` is the time of the load, as ISO text."""
    tweet, quoted = F.col("tweet"), F.col("quoted")
    legacy, article = tweet["legacy"], tweet["article"]["article_results"]["result"]
    user, other = _author(tweet), _author(quoted)
    count = lambda n: F.coalesce(legacy[n], F.lit(0)).alias(n)
    made = rows.select(
        F.struct("seq", "instruction", "at").alias("order"), tweet["rest_id"].alias("tweet_id"), "sort_index", user["author_id"].alias("author_id"),
        full_text(tweet).alias("text"), (F.coalesce(tweet["note_tweet"]["note_tweet_results"]["result"]["text"], F.lit("")) != "").cast("int").alias("is_long"),
        legacy["lang"].alias("lang"), tx.created_at(legacy["created_at"]).alias("created_at"),
        *(count(f"{n}_count") for n in ("favorite", "retweet", "reply", "quote", "bookmark")),
        quoted["rest_id"].alias("quoted_tweet_id"), F.when(quoted.isNotNull(), tx.strip(F.concat(tx.handle(other["screen_name"]), F.lit(": "), full_text(quoted)))).alias("quoted_text"),
        F.coalesce(tx.given(article["rest_id"]), article["id"]).alias("article_id"), article["title"].alias("article_title"), article["preview_text"].alias("article_preview"),
        legacy["conversation_id_str"].alias("conversation_id"),
        F.concat(F.lit("https://x.com/"), F.coalesce(tx.given(user["screen_name"]), F.lit("i")), F.lit("/status/"), tweet["rest_id"]).alias("url"),
        F.lit(seen_at).alias("captured_at"), F.lit(seen_at).alias("last_seen_at"), F.lit(None).cast("string").alias("removed_at"),
    )
    fields = [c for c in made.columns if c not in ("order", "tweet_id")]
    return made.groupBy("tweet_id").agg(F.max_by(F.struct(*fields), "order").alias("last")).select("tweet_id", "last.*")


def _media_of(tweet: Column, owner: Column, shift: Column) -> Column:
    empty = F.array()

    def row(m: Column, i: Column) -> Column:
        clips = F.filter(m["video_info"]["variants"], lambda v: (v["content_type"] == "video/mp4") & (F.coalesce(v["url"], F.lit("")) != ""))
        rated = F.transform(clips, lambda v, j: F.struct(F.coalesce(v["bitrate"], F.lit(0)).alias("rate"), j.alias("j"), v["url"].alias("url"), v["bitrate"].alias("bitrate")))
        # a stable sort by rate: the last is the best, the first the smallest
        ranked = F.array_sort(rated)
        best, small = F.try_element_at(ranked, F.lit(-1)), F.try_element_at(ranked, F.lit(1))
        moving = m["type"].isin("video", "animated_gif")
        return F.struct(
            F.coalesce(tx.given(m["media_key"]), F.concat(owner, F.lit("-"), i.cast("string"))).alias("media_key"), owner.alias("tweet_id"), m["type"].alias("kind"),
            F.when(moving, best["url"]).otherwise(m["media_url_https"]).alias("url"), m["media_url_https"].alias("thumb_url"), m["ext_alt_text"].alias("alt_text"),
            m["original_info"]["width"].alias("width"), m["original_info"]["height"].alias("height"), m["video_info"]["duration_millis"].alias("duration_ms"),
            best["bitrate"].alias("bitrate"), small["url"].alias("small_url"), small["bitrate"].alias("small_bitrate"), i.cast("bigint").alias("position"),
        )

    made = F.transform(tweet["legacy"]["extended_entities"]["media"], row)
    return F.filter(made, lambda m: m["url"].isNotNull() & m["kind"].isNotNull())


def _last_versions(rows: DataFrame) -> DataFrame:
    """Of each post the row that was written last."""
    last = rows.groupBy(F.col("tweet.rest_id").alias("tweet_id")).agg(F.max(F.struct("seq", "instruction", "at")).alias("order"))
    return rows.withColumn("tweet_id", F.col("tweet.rest_id")).withColumn("order", F.struct("seq", "instruction", "at")).join(last, ["tweet_id", "order"], "left_semi")


def media(rows: DataFrame) -> DataFrame:
    """Media of each post's last version, those of a quoted post owned by it; the first writer keeps a shared key."""
    last = _last_versions(rows)
    own, other = (_media_of(F.col(side), F.col("tweet_id"), F.lit(0)) for side in ("tweet", "quoted"))
    kind = "array<struct<media_key:string,tweet_id:string,kind:string,url:string,thumb_url:string,alt_text:string,width:bigint,height:bigint,duration_ms:bigint,bitrate:bigint,small_url:string,small_bitrate:bigint,position:bigint>>"
    both = F.concat(*(F.coalesce(x, F.array().cast(kind)) for x in (own, other)))
    each = last.select("order", F.posexplode(both).alias("k", "m"))
    return each.groupBy("m.media_key").agg(F.min_by("m", F.struct("order", "k")).alias("m")).select("m.*")


def _links_of(tweet: Column, owner: Column) -> Column:
    """Links of one post by target: entities first, then the card on its target."""
    none = F.array().cast("array<struct<url:string,expanded_url:string>>")
    urls = F.concat(F.coalesce(tweet["legacy"]["entities"]["urls"], none), F.coalesce(tweet["note_tweet"]["note_tweet_results"]["result"]["entity_set"]["urls"], none))
    urls = F.filter(urls, lambda u: (F.coalesce(u["expanded_url"], F.lit("")) != "") & ~u["expanded_url"].contains("//x.com/") & ~u["expanded_url"].contains("//twitter.com/"))
    bindings = F.filter(tweet["card"]["legacy"]["binding_values"], lambda b: F.coalesce(b["key"], F.lit("")) != "")

    def said(key: str) -> Column:
        held = F.try_element_at(F.filter(bindings, lambda b: b["key"] == key), F.lit(-1))
        return F.coalesce(tx.given(held["value"]["string_value"]), tx.given(held["value"]["image_value"]["url"]))

    short = F.coalesce(said("card_url"), tx.given(tweet["card"]["legacy"]["url"]))
    named = F.try_element_at(F.filter(urls, lambda u: u["url"] == short), F.lit(-1))
    target = F.when((F.size(bindings) > 0) & ~short.startswith("card://"), F.coalesce(named["expanded_url"], short))
    thumb = F.coalesce(said("thumbnail_image_large"), said("thumbnail_image"), said("photo_image_full_size_large"))
    targets = F.array_distinct(F.concat(F.transform(urls, lambda u: u["expanded_url"]), F.when(target.isNotNull(), F.array(target)).otherwise(F.array().cast("array<string>"))))

    def row(t: Column) -> Column:
        of = F.coalesce(t == target, F.lit(False))
        url = tx.canonical_url(t)
        return F.struct(
            owner.alias("tweet_id"), url.alias("url"), tx.url_host(url).alias("domain"), F.when(of, said("title")).alias("title"),
            F.when(of, said("description")).alias("description"), F.when(of, thumb).alias("thumb_url"), of.cast("int").alias("from_card"),
        )

    return F.transform(targets, row)


def links(rows: DataFrame) -> DataFrame:
    """Links of each post's last version and of what it quotes, one row for each (tweet_id, url): later values fill or replace."""
    last = _last_versions(rows)
    kind = "array<struct<tweet_id:string,url:string,domain:string,title:string,description:string,thumb_url:string,from_card:int>>"
    both = F.concat(*(F.coalesce(_links_of(F.col(side), F.col("tweet_id")), F.array().cast(kind)) for side in ("tweet", "quoted")))
    return merged_links(last.select("order", F.posexplode(both).alias("k", "l")).select(F.struct("order", "k").alias("order"), "l.*"))


def merged_links(rows: DataFrame) -> DataFrame:
    """Fold repeated (tweet_id, url) rows in ``order``: the last value given of each text, the largest from_card."""
    later = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("order"))).alias(c)
    return rows.groupBy("tweet_id", "url").agg(F.min_by("domain", "order").alias("domain"), later("title"), later("description"), later("thumb_url"), F.max("from_card").alias("from_card"))


def removed(posts_: DataFrame, seen: DataFrame, at: str) -> DataFrame:
    """Live posts that a full walk didn't see, with the time of their removal."""
    return posts_.where("removed_at IS NULL").join(seen.select("tweet_id").distinct(), "tweet_id", "left_anti").withColumn("removed_at", F.lit(at))


def merged_attempts(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Keyed merge: new content replaces old, ``attempts`` grows by one, other columns stay as first written."""
    n = new.select(key, *(F.col(c).alias(f"new_{c}") for c in new.columns if c != key), F.lit(True).alias("is_new"))
    joined = old.withColumn("is_old", F.lit(True)).join(n, key, "full_outer")
    pick = lambda c: (F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)) if c in content else F.when(F.col("is_old"), F.col(c)).otherwise(F.col(f"new_{c}")))
    attempts = F.coalesce("attempts", F.lit(0)) + F.when(F.col("is_new"), 1).otherwise(0)
    return joined.select(key, *((attempts if c == "attempts" else pick(c)).alias(c) for c in old.columns if c != key))


def page_records(pages: DataFrame) -> DataFrame:
    """(seq, entry_count): how many readable posts each page holds, also those with none."""
    held = posts(pages).groupBy("seq").agg(F.count("*").alias("n"))
    return pages.select("seq").distinct().join(held, "seq", "left").select("seq", F.coalesce("n", F.lit(0)).cast("bigint").alias("entry_count"))


def tallies(pages: DataFrame) -> DataFrame:
    """One row: pages, and posts, media and links as they come, repeats included; ``distinct_posts`` counts a post once."""
    rows = posts(pages)
    none = F.lit(0)
    size = lambda made: F.greatest(F.coalesce(F.size(made), none), none)
    owner = F.col("tweet.rest_id")
    files = sum((size(_media_of(F.col(side), owner, none)) for side in ("tweet", "quoted")), none)
    targets = sum((size(_links_of(F.col(side), owner)) for side in ("tweet", "quoted")), none)
    counted = rows.select(owner.alias("tweet_id"), files.alias("media"), targets.alias("links"))
    total = lambda c: F.coalesce(F.sum(c), none).cast("bigint").alias(c)
    made = counted.agg(F.count("*").alias("posts"), total("media"), total("links"), F.count_distinct("tweet_id").alias("distinct_posts"))
    return pages.agg(F.count("*").alias("pages")).withColumn("one", none).join(made.withColumn("one", none), "one").drop("one")  # two single rows
