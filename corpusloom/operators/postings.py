"""An inverted index over chunks: postings by term, and the statistics that BM25 needs.

A posting is (bucket, term, chunk_id, tf, dl). Stored postings are partitioned by bucket and sorted by term, so that a
search reads the buckets of its own terms and no text at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import text as tx

#: Buckets of a stored index, and parts into which the postings of one term are spread when they are written.
BUCKETS, SALTS = 64, 8


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(chunks: DataFrame) -> DataFrame:
    """(bucket, term, chunk_id, tf, dl) of all terms of all chunks; a repeated chunk counts once.

    The terms of a row are counted before any shuffle, since they lie in one partition.
    """
    words = chunks.select(F.col("id").alias("chunk_id"), F.monotonically_increasing_id().alias("row"), tx.once(tx.tokens(F.col("text"))).alias("terms"))
    each = words.select("chunk_id", "row", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    counted = each.groupBy("row", "chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return counted.groupBy("term", "chunk_id").agg(F.max("tf").alias("tf"), F.max("dl").alias("dl")).select(bucket(F.col("term")).alias("bucket"), "term", "chunk_id", "tf", "dl")


@dataclass
class TextIndex:
    """Postings with the number of chunks and of their words."""

    postings: DataFrame
    chunks: int
    words: int

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: their buckets are told from the terms, so that a stored index reads only those."""
        spark = self.postings.sparkSession
        named = spark.createDataFrame([(t,) for t in terms], "term string").select(bucket(F.col("term")).alias("b"))
        places = sorted({r["b"] for r in named.collect()})  # at most one for each term of the query
        return self.postings.where(F.col("bucket").isin(places) & F.col("term").isin(terms))


def over(chunks: DataFrame) -> TextIndex:
    """An index that isn't stored: each search makes the postings of its terms from the texts."""
    sizes = chunks.select("id", F.size(tx.tokens(F.col("text"))).alias("dl")).dropDuplicates(["id"])
    n, words = sizes.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return TextIndex(postings(chunks), n, words)


def _write(rows: DataFrame, path: str) -> None:
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS))
    rows.repartition("bucket", salt).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def _opened(spark: SparkSession, path: str, chunks: DataFrame) -> TextIndex:
    held = spark.read.schema("term string, chunk_id bigint, tf bigint, dl int, bucket int").parquet(path)
    n = chunks.agg(F.count_distinct("id")).first()[0]
    return TextIndex(held, n, held.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0])


def build(chunks: DataFrame, path: str) -> TextIndex:
    """Write the postings of ``chunks`` to ``path`` and open them."""
    _write(postings(chunks), path)
    return _opened(chunks.sparkSession, path, chunks)


def update(old: TextIndex, chunks: DataFrame, dropped: DataFrame, added: DataFrame, path: str) -> TextIndex:
    """The index of ``chunks`` from an older one: postings of ``dropped`` ids (chunk_id) go, only the ``added`` chunks are read."""
    rest = old.postings.join(dropped.select("chunk_id"), "chunk_id", "left_anti").select("bucket", "term", "chunk_id", "tf", "dl")
    _write(rest.unionByName(postings(added)), path)
    return _opened(chunks.sparkSession, path, chunks)
