"""Incremental maintenance of the index: what to write, what to drop, what to embed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import text as tx
from corpusloom.session import ranked, stored

Embedder = Callable[[list[str]], list[list[float]]]


def without_sources(chunks: DataFrame, exclude: list[str]) -> DataFrame:
    return chunks.where(~F.col("source").isin(exclude)) if exclude else chunks


def translated(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with the cached translation of their text, if it has any: the original moves to source_text, the hash follows the text."""
    known = cache.where("text IS NOT NULL AND text <> ''").select("hash", F.col("text").alias("english"))
    rows = chunks.join(known, "hash", "left")
    made = rows.withColumn("source_text", F.when(F.col("english").isNotNull(), F.col("text")))
    made = made.withColumn("text", F.coalesce("english", "text")).drop("english")
    return made.withColumn("hash", tx.content_hash(F.col("text")))


def distinct_within(chunks: DataFrame, order: str = "slot") -> DataFrame:
    """One chunk for each (post, hash): in the place of the first, with the rest of the last."""
    rest = [c for c in chunks.columns if c not in ("tweet_id", "hash", order)]
    folded = chunks.groupBy("tweet_id", "hash").agg(F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("rest"))
    return folded.select("tweet_id", "hash", order, "rest.*")


def changes(want: DataFrame, have: DataFrame) -> DataFrame:
    """(tweet_id, change) of the posts whose set of hashes differs: add, remove or rewrite.

    Both sides are reduced to one row for each post and joined once; a set is compared by the sum and xor of its
    members' hashes and its size, so that a post with very many chunks needs no array.
    """
    side = lambda df, name: (
        df.select("tweet_id", F.xxhash64("hash").alias("h")).distinct().groupBy("tweet_id")
        .agg(F.struct(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s")).alias(name))
    )
    both = side(want, "w").join(side(have, "h"), "tweet_id", "full_outer")
    kind = F.when(F.col("h").isNull(), "add").when(F.col("w").isNull(), "remove").when(F.col("w") != F.col("h"), "rewrite")
    return both.select("tweet_id", kind.alias("change")).where("change IS NOT NULL")


def unembedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector."""
    have = vectors.where("embedding IS NOT NULL").select(F.col("chunk_id").alias("id"))
    return chunks.join(have, "id", "left_anti")


def embed(chunks: DataFrame, embedder: Embedder, batch: int = 32) -> DataFrame:
    """(chunk_id, embedding) by ``embedder``, a function from a list of at most ``batch`` framed texts to a list of vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf.pop("text").tolist()
            yield pdf.assign(embedding=[v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])])

    framed = chunks.select(F.col("id").alias("chunk_id"), tx.as_document(F.lit(None).cast("string"), F.col("text")).alias("text"))
    return framed.mapInPandas(run, "chunk_id bigint, embedding array<float>")


#: The columns of the index's chunks.
CHUNK = ("id", "tweet_id", "source", "ref", "position", "text", "source_text", "lang", "hash")


@dataclass
class Build:
    """The tables of a built index, the chunks that are new in it, the ids that left it, and its counts."""

    chunks: DataFrame
    vectors: DataFrame
    added: DataFrame
    dropped: DataFrame
    counts: DataFrame


def build(want: DataFrame, have: DataFrame, vectors: DataFrame, embedder: Embedder | None = None, *, rebuild: bool = False) -> Build:
    """Bring the index (``have`` with its ``vectors``) to the chunks in ``want`` (with ``kind`` and ``position`` as their order in a post).

    A post is written anew if its set of hashes differs, and goes if it wants no chunk; all others keep their rows, ids
    and vectors. New ids follow the largest one, by post and place. Chunks without a vector are embedded, if there is an
    ``embedder``. ``rebuild`` starts from nothing. Repeated rows of ``have`` count once.
    """
    have, vectors = (have.where("false"), vectors.where("false")) if rebuild else (have, vectors)
    have = have.select(*CHUNK).dropDuplicates(["id"])
    place = F.struct("kind", "position", F.xxhash64("ref", "text").alias("x")).alias("slot")
    want = distinct_within(want.withColumn("source_text", F.col("source_text") if "source_text" in want.columns else F.lit(None).cast("string")).select(place, *CHUNK[1:]))
    changed = stored(changes(want, have), "changes")
    fresh = ranked(want.join(changed.where("change <> 'remove'"), "tweet_id", "left_semi").withColumn("k", F.col("slot.kind")).withColumn("p", F.col("slot.position")), "fresh", "tweet_id", "k", "p", "hash")
    last = have.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    added = stored(fresh.join(F.broadcast(last)).withColumn("id", F.col("last") + 1 + F.col("rank")).select(*CHUNK), "added")  # one row is joined to each
    dropped = stored(have.join(changed.where("change <> 'add'"), "tweet_id", "left_semi").select(F.col("id").alias("chunk_id")), "dropped")
    chunks = stored(have.join(changed, "tweet_id", "left_anti").unionByName(added), "chunks")
    held = vectors.where("embedding IS NOT NULL").join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    if embedder is not None:
        held = held.select("chunk_id", "embedding").unionByName(embed(unembedded(chunks, held), embedder))
    held = stored(held.select("chunk_id", "embedding"), "vectors")
    parts = (chunks.agg(F.count("*").alias("chunks")), held.agg(F.count("*").alias("embedded")), added.agg(F.count("*").alias("added")), dropped.agg(F.count("*").alias("removed")))
    counts = parts[0]
    for more in parts[1:]:
        counts = counts.join(F.broadcast(more))  # single rows
    return Build(chunks, held, added, dropped, counts)


def saved_translations(cache: DataFrame, made: DataFrame) -> DataFrame:
    """The cache (hash, source_text, text, updated_at) with new answers; a known hash keeps its source and takes the later answer.

    A text of null says that the source was English already; a source without a row was never answered.
    """
    rows = cache.withColumn("turn", F.lit(0)).unionByName(made.withColumn("turn", F.lit(1)))
    order = F.struct("turn", "updated_at")
    answer = F.max_by(F.struct("text", "updated_at"), order).alias("last")
    return rows.groupBy("hash").agg(F.min_by("source_text", order).alias("source_text"), answer).select("hash", "source_text", "last.text", "last.updated_at")
