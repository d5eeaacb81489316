"""Reading a document by page or by passage, and one post in detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.chunking import owners, readable
from corpusloom.session import running

PAGE = 12_000


def find(documents: DataFrame, links: DataFrame, posts: DataFrame, target: str) -> DataFrame:
    """Readable documents of live posts, by URL (as given or canonical) if the target holds ://, else by post."""
    good = readable(documents)
    if "://" in target:
        rows = good.where((F.col("url") == target) | (F.col("url") == tx.canonical_url(F.lit(target))))
        owned = owners(rows, links)
    else:
        owned = owners(good, links).where(F.col("tweet_id") == target)
        rows = good.join(owned.select("url"), "url", "left_semi")
    live = owned.join(posts.select("tweet_id"), "tweet_id", "left_semi").select("url")
    return rows.join(live, "url", "left_semi")


def info(found: DataFrame) -> DataFrame:
    """(url, kind, title, word_count) of the documents, articles first, then by url."""
    return found.select("url", "kind", "title", "word_count").orderBy((F.col("kind") != "x_article"), "url")


def sections(found: DataFrame) -> DataFrame:
    """(article_last, url, doc_id, section): each document as a section under its title, with its source."""
    head = F.concat(F.lit("# "), F.coalesce(tx.given(F.col("title")), F.col("url")), F.lit("\n\nSource: "), F.col("url"), F.lit("\n\n"))
    return found.select((F.col("kind") != "x_article").alias("article_last"), "url", "doc_id", tx.once(F.concat(head, F.coalesce(tx.prose(F.col("body")), F.lit("")))).alias("section"))


def page(found: DataFrame, offset: int = 0, size: int = PAGE) -> DataFrame:
    """(text, next_offset, has_more): ``size`` characters of the documents' sections, articles first, a blank line between them.

    The places of the sections come from running sums over range-sorted tasks; a text is read where it reaches into the page.
    """
    if offset < 0:
        raise ValueError("the offset must not be negative")
    order = ("article_last", "url", "doc_id")
    texts = sections(found)
    end = offset + size
    places = running(texts.select(*order, (F.length("section") + 2).alias("n")), "places", "n", *order)
    total = places.agg(F.coalesce(F.max(F.col("before") + F.col("n")), F.lit(2)).alias("t")).select((F.col("t") - 2).alias("t"), F.lit(1).alias("one"))
    shown = places.where((F.col("before") < end) & (F.col("before") + F.col("n") > offset)).join(texts, [*order])
    # of each section only what lies on the page
    cut = F.substr(F.concat("section", F.lit("\n\n")), F.greatest(F.lit(offset) - F.col("before"), F.lit(0)).cast("int") + 1, F.least(F.lit(end) - F.greatest("before", F.lit(offset)), F.lit(size)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("before", cut.alias("s")))), lambda x: x["s"]), "")
    made = shown.agg(text.alias("text")).withColumn("one", F.lit(1)).join(total, "one")  # two single rows; the text has at most ``size`` characters
    return made.select(F.left("text", F.greatest(F.col("t") - offset, F.lit(0)).cast("int")).alias("text"), F.when(F.col("t") > end, end).alias("next_offset"), (F.col("t") > end).alias("has_more"))


def pages(documents: DataFrame, size: int = PAGE) -> DataFrame:
    """(doc_id, offset, page, next_offset, has_more): every page of every text, ``size`` characters each; an empty text has one empty page."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    rows = documents.where("text IS NOT NULL").select("doc_id", "text", F.explode(starts).alias("offset"))
    end = F.col("offset") + size
    more = F.length("text") > end
    return rows.select("doc_id", "offset", F.substr("text", F.col("offset") + 1, F.lit(size)).alias("page"), F.when(more, end).alias("next_offset"), more.alias("has_more"))


def passage_ids(chunks: DataFrame, urls: DataFrame) -> DataFrame:
    """Of the chunks of some documents, the one with the smallest id for each (ref, position): shared pages once."""
    rows = chunks.where(F.col("source").isin("article", "link", "video")).join(urls.select(F.col("url").alias("ref")).distinct(), "ref", "left_semi")
    return rows.groupBy("ref", "position").agg(F.min("id").alias("chunk_id"))


def details(posts: DataFrame, authors: DataFrame, links: DataFrame, media: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """Some posts with their author, links (by url) and media (by position), nested: for the reading tool, which asks for one post. For many posts use ``items``."""
    said = None if captions is None else captions.select("media_key", F.when(F.col("error").isNull(), F.col("text")).alias("caption"))
    pictures = media.withColumn("caption", F.lit(None).cast("string")) if said is None else media.join(said, "media_key", "left")
    link = links.groupBy("tweet_id").agg(F.array_sort(F.collect_list(F.struct("url", "domain", "title", "description", "from_card"))).alias("links"))
    picture = pictures.groupBy("tweet_id").agg(F.array_sort(F.collect_list(F.struct("position", "media_key", *(c for c in ("kind", "url", "alt_text", "caption", "width", "height", "duration_ms") if c in pictures.columns)))).alias("media"))
    who = authors.select("author_id", F.struct("author_id", "screen_name", "name", "verified", "description").alias("author"))
    return posts.join(who, "author_id", "left").join(link, "tweet_id", "left").join(picture, "tweet_id", "left")


def items(posts: DataFrame, authors: DataFrame, links: DataFrame, media: DataFrame) -> DataFrame:
    """(tweet_id, screen_name, item, place, title): a row for each link and picture of each post; no post is gathered."""
    who = posts.select("tweet_id", "author_id").join(authors.select("author_id", "screen_name"), "author_id", "left").select("tweet_id", "screen_name")
    parts = links.select("tweet_id", F.lit("link").alias("item"), F.col("url").alias("place"), "title").unionByName(
        media.select("tweet_id", F.lit("media").alias("item"), F.col("media_key").alias("place"), F.col("alt_text").alias("title"))
    )
    return who.join(parts, "tweet_id")
