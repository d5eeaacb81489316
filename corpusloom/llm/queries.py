"""The queries of the numbered problems, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import encode, language, neardup, neighbours, packing, reading, residue, split
from corpusloom.session import kept, stored


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """The cases of residue among the documents, found once for the present files and kept as a table for the session."""
    make = lambda: stored(residue.cases(_read(spark, folder, "documents")).distinct(), "cases")
    return kept(spark, "residue cases", [f"{folder}/documents.parquet"], make)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that the splitter had to cut."""
    found = [
        split.oversized(split.split_texts(_read(spark, folder, table), key, text), key).select(
            F.lit(table).alias("item_table"), F.col(key).alias("item_key")
        )
        for table, key, text in (("documents", "doc_id", "body"), ("chunks", "id", "text"))
    ]
    return found[0].unionByName(found[1])


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all items, without their texts: place, length, and a hash of the content."""
    found = [
        split.split_texts(_read(spark, folder, table).select(key, text).distinct(), key, text).select(
            F.lit(table).alias("item_table"), F.col(key).alias("item_key"), "piece", "start", F.length("text").alias("length"), F.xxhash64("text").alias("content")
        )
        for table, key, text in (("documents", "doc_id", "body"), ("chunks", "id", "text"))
    ]
    return found[0].unionByName(found[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with template residue, filler, error text or a demand for scripts in place of content."""
    return _cases(spark, folder)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which either is among the ten most similar to the other."""
    return neighbours.pairs(neighbours.nearest(_read(spark, folder, "chunk_vec"), "chunk_id", "embedding"))


def _network(spark: SparkSession, folder: str) -> language.Network:
    """The language network of the documents and posts, trained once for the present files."""
    make = lambda: language.fit([(_read(spark, folder, t), key, "text", "lang") for t, key in (("documents", "doc_id"), ("bookmarks", "tweet_id"))])
    return kept(spark, "language network", [f"{folder}/{t}.parquet" for t in ("documents", "bookmarks")], make)


def _languages(spark: SparkSession, folder: str):
    documents, posts, chunks = (_read(spark, folder, t) for t in ("documents", "bookmarks", "chunks"))
    posts = posts.withColumn("item_key", F.expr("try_cast(tweet_id AS bigint)"))
    net = _network(spark, folder)
    for table, rows in (
        ("documents", documents.withColumn("item_key", F.col("doc_id"))),
        ("bookmarks", posts),
        ("chunks", chunks.withColumn("item_key", F.col("id"))),
    ):
        yield table, language.identify(rows.withColumn("label", F.col("lang")), "text", net, ["item_key", "label"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of texts whose label is missing, wrong or one for several."""
    bad = _cases(spark, folder)
    found = []
    for table, rows in _languages(spark, folder):
        cases = language.wrong(rows, "label").select("item_key", "lang")
        if table == "documents":
            cases = cases.join(bad.select(F.col("doc_id").alias("item_key")), "item_key", "left_anti")
        found.append(cases.distinct().select(F.lit(table).alias("item_table"), "item_key", "lang"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with its letters, languages and confidence, and the segments of mixed texts."""
    found = [rows.select(F.lit(table).alias("item_table"), "*") for table, rows in _languages(spark, folder)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _near(spark: SparkSession, folder: str, without: DataFrame | None = None):
    documents = _read(spark, folder, "documents")
    without = _cases(spark, folder) if without is None else without
    yield "documents", neardup.similar(documents, "doc_id", "body", least=400, without=without)
    posts = _read(spark, folder, "bookmarks").select(F.expr("try_cast(tweet_id AS bigint)").alias("tweet_id"), "text")
    yield "bookmarks", neardup.similar(posts, "tweet_id", "text", least=160)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of documents by body, and of posts by text, that share half of their runs of ten characters."""
    found = [neardup.expand(*parts).select(F.lit(table).alias("item_table"), "key_a", "key_b") for table, parts in _near(spark, folder)]
    return found[0].unionByName(found[1])


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and post that can be compared: its class of copies and its links to other classes."""
    found = [neardup.linked(*parts).select(F.lit(table).alias("item_table"), "*") for table, parts in _near(spark, folder)]
    return found[0].unionByName(found[1])


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text as ids of the public vocabulary."""
    return encode.encode_texts(_read(spark, folder, "documents"), "doc_id")


def p7_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, or part of one that exceeds a container, with its container of 2,048 ids."""
    sizes = stored(encode.encode_texts(_read(spark, folder, "documents"), "doc_id", counts_only=True), "sizes")
    return packing.pack(sizes, "doc_id", "n_tokens")


def _trees(spark: SparkSession, folder: str, net: language.Network) -> reading.Trees:
    """The trees of the documents wholly in English, trained once for the present files."""

    def make() -> reading.Trees:
        english = _read(spark, folder, "documents").where(language.label(F.col("lang")) == "en")
        known = language.identify(residue.sampled(english, "doc_id", reading.TRAIN_TEXTS), "text", net, ["doc_id", "text", "source"])
        return reading.fit(known.where((F.size("langs") == 1) & (F.col("langs")[0]["lang"] == "en")), "doc_id", "text", "source")

    return kept(spark, "reading trees", [f"{folder}/documents.parquet"], make)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers are filled: their number, the least number that could do, tokens, the share of space in use, and the fullest."""
    per = p7_boxes(spark, folder).groupBy("box").agg(F.sum("size").alias("held"))
    made = per.agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"), F.max("held").alias("fullest"))
    least = F.ceil(F.col("tokens") / packing.CAPACITY)
    return made.select("containers", least.alias("least"), "tokens", F.round(F.col("tokens") / (F.col("containers") * packing.CAPACITY), 4).alias("share"), "fullest")


def _graded(spark: SparkSession, folder: str, least: int = 1) -> DataFrame:
    """Every document with at least ``least`` words: its languages, words, grade and band."""
    documents = _read(spark, folder, "documents")
    net = _network(spark, folder)
    trees = _trees(spark, folder, net)
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    enough = documents.where(F.col("text").isNotNull()).select("doc_id", "text", "source", F.explode(F.array(words)).alias("words")).where(F.col("words") >= least)
    rows = language.identify(enough, "text", net, ["doc_id", "text", "source", "words"])
    return reading.grade(rows.withColumn("wholly", F.when(F.size("langs") == 1, F.col("langs")[0]["lang"])), "text", trees, ["doc_id", "source", "words", "wholly"])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The band of each document that is wholly in English, no case of residue, and has at least 80 words."""
    bad = _cases(spark, folder)
    rows = _graded(spark, folder, 80).where(F.col("wholly") == "en")
    return rows.join(bad, "doc_id", "left_anti").select("doc_id", "band")


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by source, language and band: documents, words and mean grade."""
    rows = _graded(spark, folder)
    return rows.groupBy("source", F.coalesce("wholly", F.lit("mixed or none")).alias("lang"), "band").agg(
        F.count("*").alias("documents"), F.sum("words").alias("words"), F.round(F.avg("grade"), 2).alias("grade")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p3_found, p4_found, p4_languages, p5_found, p5_groups, p6_ids, p7_boxes, p7_fill, p8_found, p8_profile)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT DISTINCT 'documents' AS item_table, doc_id AS item_key FROM documents WHERE length(body) > 4800
            UNION ALL
            SELECT DISTINCT 'chunks', id FROM chunks WHERE length(text) > 4800""",
    }
