"""Filtered candidates, exact vector ranking, BM25, rank fusion, and the best passage of each post.

Rankers return at most ``k`` rows, so everything after them is small and joins by broadcast; before them only filters
and one pass over vectors and over the postings of the query's terms happen. Filters come before ranking; the statistics of BM25 stay those of the whole index.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import postings
from corpusloom.operators.postings import TextIndex
from corpusloom.session import stored

CANDIDATES, FUSION, K1, B = 80, 60, 1.2, 0.75


def index_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks, a repeated row once."""
    return chunks.dropDuplicates(["id"])


def index_vectors(chunk_vec: DataFrame, width: int = 768) -> DataFrame:
    """Usable vectors. Rows may repeat: the rankers drop repeats after they have reduced a row to its distance."""
    return chunk_vec.where(F.size("embedding") == width)


def allowed(chunks: DataFrame, posts: DataFrame, authors: DataFrame, *, author: str | None = None, source: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame | None:
    """Ids of the chunks that the filters leave, of live posts; None without filters. Dates compare as text."""
    if author is source is after is before is None:
        return None
    rows = posts
    if after is not None:
        rows = rows.where(F.col("created_at") >= after)
    if before is not None:
        rows = rows.where(F.col("created_at") < before)
    if author is not None:
        named = authors.where(F.lower("screen_name") == author.lstrip("@").lower())
        rows = rows.join(named.select("author_id"), "author_id", "left_semi")
    kept = chunks if source is None else chunks.where(F.col("source") == source)
    return kept.join(rows.select("tweet_id"), "tweet_id", "left_semi").select(F.col("id").alias("chunk_id"))


def vector_ranks(vectors: DataFrame, query: list[float], k: int = CANDIDATES, among: DataFrame | None = None) -> DataFrame:
    """(chunk_id, distance, rank) of the k nearest, rank from 0, ties by id. A lone candidate is ranked even if it has no vector."""
    rows = vectors if among is None else vectors.join(among, "chunk_id", "left_semi")
    near = distances(rows.select("chunk_id", "embedding"), query).dropDuplicates(["chunk_id"]).orderBy("distance", "chunk_id").limit(k)
    if among is not None:
        lone = among.agg(F.min("chunk_id").alias("chunk_id"), F.max("chunk_id").alias("last")).where("chunk_id = last")
        near = near.unionByName(lone.select("chunk_id", F.lit(None).cast("double").alias("distance"))).groupBy("chunk_id").agg(F.min("distance").alias("distance"))
    order = (F.asc_nulls_last("distance"), "chunk_id")
    return near.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)  # at most k + 1 rows


def distances(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(chunk_id, distance) by Euclidean distance in double precision, a batch at a time; vectors of other lengths are left out."""
    at = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(at)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(((x - at) ** 2).sum(1)))], ["chunk_id", "distance"])

    return vectors.where(F.size("embedding") == len(at)).mapInArrow(run, "chunk_id bigint, distance double")


def query_terms(text: str) -> list[str]:
    """The terms of a query of more than one character; repeats are kept."""
    import regex

    return [t for t in regex.findall(r"[\p{L}\p{N}_']+", text.lower()) if len(t) > 1]


def lexical_scores(source: TextIndex | DataFrame, query: str, among: DataFrame | None = None) -> DataFrame:
    """(chunk_id, bm25) of the chunks that hold any term; statistics over the whole index. A frame of chunks is indexed for this search alone."""
    index = source if isinstance(source, TextIndex) else postings.over(source)
    terms = Counter(query_terms(query))
    found = index.of_terms(sorted(terms))
    if not terms or not index.words:
        return found.select("chunk_id", F.lit(0.0).alias("bm25")).where("false")
    held = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row for each term of the query
    weigh = {t: math.log(1 + (index.chunks - n + 0.5) / (n + 0.5)) * terms[t] * (K1 + 1) for t, n in held.items()}
    idf = F.coalesce(*(F.when(F.col("term") == t, F.lit(w)) for t, w in sorted(weigh.items())), F.lit(0.0))
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(index.words / index.chunks))
    rows = found if among is None else found.join(among, "chunk_id", "left_semi")
    return rows.groupBy("chunk_id").agg(F.sum(idf * F.col("tf") / (F.col("tf") + norm)).alias("bm25"))


def lexical_ranks(source: TextIndex | DataFrame, query: str, k: int = CANDIDATES, among: DataFrame | None = None) -> DataFrame:
    """(chunk_id, bm25, rank) of the k best, rank from 0; ties (to nine digits) by id."""
    best = lexical_scores(source, query, among).withColumn("bm25", F.round("bm25", 9)).orderBy(F.desc("bm25"), "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bm25"), "chunk_id")) - 1)


def fuse(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """(chunk_id, score, dense_rank, lexical_rank): reciprocal rank fusion of two short lists."""
    both = dense.select("chunk_id", F.col("rank").alias("d"), F.lit(None).cast("int").alias("l")).unionByName(lexical.select("chunk_id", F.lit(None).cast("int").alias("d"), F.col("rank").alias("l")))
    term = lambda c: F.coalesce(1.0 / (F.col(c) + FUSION + 1), F.lit(0.0))
    return both.groupBy("chunk_id").agg(F.round(F.sum(term("d") + term("l")), 12).alias("score"), F.max("d").alias("dense_rank"), F.max("l").alias("lexical_rank"))


def search(tables: dict[str, DataFrame], query: str, vector: list[float], *, limit: int = 10, index: TextIndex | None = None, **filters: str | None) -> DataFrame:
    """The best passage of each of the best posts, with the post and what it holds.

    ``tables``: chunks, vectors, posts (live), authors, documents, links, media. Without ``index`` the chunks are read for the search.
    """
    chunks, posts = tables["chunks"], tables["posts"]
    among = allowed(chunks, posts, tables["authors"], **filters)
    fused = F.broadcast(fuse(vector_ranks(tables["vectors"], vector, among=among), lexical_ranks(index or chunks, query, among=among)))  # at most 161 rows
    of_post = posts.select("tweet_id", "author_id", "created_at", "url", F.col("text").alias("post"), F.col("lang").alias("post_lang"))
    held = chunks.select("id", "tweet_id", "source", "ref", "source_text", F.col("text").alias("hit"))
    hits = index_chunks(held.join(fused, held["id"] == fused["chunk_id"])).join(of_post, "tweet_id")
    best = F.row_number().over(Window.partitionBy("tweet_id").orderBy(F.desc("score"), "chunk_id"))
    hits = stored(hits.withColumn("r", best).where("r = 1").orderBy(F.desc("score"), "chunk_id").limit(limit), "hits")  # ranked once, then looked up
    ids = F.broadcast(hits.select("tweet_id"))
    counts = chunks.join(ids, "tweet_id", "left_semi").groupBy("tweet_id").agg(F.count_distinct("id").alias("chunk_count"))
    kinds = tables["media"].join(ids, "tweet_id", "left_semi").groupBy("tweet_id").agg(F.array_sort(F.collect_set("kind")).alias("media"))
    attached = tables["documents"].select("url", F.col("tweet_id").alias("owner"), "word_count")
    links = tables["links"].join(ids, "tweet_id", "left_semi").select("tweet_id", "url")
    owned = attached.join(ids.withColumnRenamed("tweet_id", "owner"), "owner", "left_semi").select(F.col("owner").alias("tweet_id"), "url")
    words = owned.union(links).distinct().join(attached.select("url", "word_count"), "url").groupBy("tweet_id").agg(F.sum("word_count").alias("document_words"))
    out = F.broadcast(hits).join(counts, "tweet_id", "left").join(words, "tweet_id", "left").join(kinds, "tweet_id", "left").join(tables["authors"].select("author_id", "screen_name"), "author_id", "left")
    return out.select(
        "tweet_id", "url", "chunk_id", "source", "score", tx.handle(F.col("screen_name")).alias("handle"), "created_at", "chunk_count",
        F.coalesce(F.nullif("document_words", F.lit(0)), tx.word_count(F.col("post"))).cast("bigint").alias("words"), F.coalesce("media", F.array().cast("array<string>")).alias("media"),
        F.col("post").alias("text"), F.col("post_lang").alias("lang"), "ref", F.col("hit").alias("chunk"), "source_text", tx.snippet(F.col("hit")).alias("passage"),
    ).orderBy(F.desc("score"), "chunk_id")


def passages(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], within: DataFrame, limit: int = 5, index: TextIndex | None = None) -> DataFrame:
    """The best passages among some chunks; ties by the dense list, then the lexical."""
    among = within.select("chunk_id")
    fused = fuse(vector_ranks(vectors, vector, among=among), lexical_ranks(index or chunks, query, among=among))
    order = (F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), "chunk_id")
    top = fused.orderBy(*order).limit(limit)
    return index_chunks(chunks.join(F.broadcast(top), chunks["id"] == top["chunk_id"])).orderBy(*order).select("chunk_id", "tweet_id", "source", "ref", "position", "score", "text", "source_text")
