"""A facade over one corpus folder: the reading tools, the report and the index, as DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, documents, indexing, normalize, postings, report, retrieval
from corpusloom.operators.indexing import Build, Embedder
from corpusloom.session import kept, own_dir, release, ship
from corpusloom.settings import SOURCES, known
from corpusloom.sources.tables import latest_posts, table


class Engine:
    """``embedder`` maps a list of texts to a list of vectors; without one, searches need a vector.

    Used with ``with``, it deletes what it has stored for itself at the end.
    """

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None):
        ship(spark)
        self.spark, self.folder, self.embedder = spark, folder, embedder
        self.tables = {n: table(spark, folder, n) for n in ("authors", "media", "documents", "chunks")}
        rows = table(spark, folder, "links")
        self.tables["links"] = normalize.merged_links(rows.withColumn("order", F.xxhash64(*rows.columns)))
        self.all_posts = latest_posts(table(spark, folder, "bookmarks"))
        self.tables["posts"] = self.all_posts.where("removed_at IS NULL")
        self.tables["vectors"] = retrieval.index_vectors(table(spark, folder, "chunk_vec"))

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        release(self.spark)

    def text_index(self) -> postings.TextIndex:
        """The postings of the chunks, made once for the present files."""
        return kept(self.spark, "text index", [f"{self.folder}/chunks.parquet"], lambda: postings.build(self.tables["chunks"], f"{own_dir(self.spark)}/postings-{uuid.uuid4().hex}"))

    def _asked(self, query: str, vector: list[float] | None) -> list[float]:
        if self.tables["vectors"].limit(1).count() == 0:
            raise ValueError("the index holds no vector; build it first")
        if vector is not None:
            return vector
        if self.embedder is None:
            raise ValueError("give a vector or an embedder")
        return self.embedder([tx.query_frame(query)])[0]

    def search(self, query: str, limit: int = 10, *, vector: list[float] | None = None, author: str | None = None, source: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
        """The best posts; an index without vectors is an error."""
        if not 1 <= limit <= 50:
            raise ValueError("the limit must be from 1 to 50")
        if source is not None:
            known([source])
        return retrieval.search(self.tables, query, self._asked(query, vector), limit=limit, index=self.text_index(), author=author, source=source, after=after, before=before)

    def last_sync(self) -> str | None:
        """When the newest row was seen: later posts can't be found yet."""
        return self.all_posts.agg(F.max("last_seen_at")).first()[0]

    def captions(self) -> DataFrame:
        """The table of captions, or the photos' descriptions where there is none."""
        return self.tables["media"].where("kind = 'photo' AND alt_text <> ''").select("media_key", F.col("alt_text").alias("text"), F.lit(None).cast("string").alias("error"))

    def bookmark(self, tweet_id: str) -> DataFrame:
        """One live post with its author, links and media; an unknown one is an error."""
        of = lambda name: self.tables[name].where(F.col("tweet_id") == tweet_id)
        made = documents.details(of("posts"), self.tables["authors"], of("links"), of("media"), self.captions())
        if made.limit(1).count() == 0:
            raise ValueError(f"no post {tweet_id}")
        return made

    def documents(self, target: str) -> DataFrame:
        """The readable documents of a post or under a URL; none is an error."""
        found = documents.find(self.tables["documents"], self.tables["links"], self.tables["posts"], target)
        if found.limit(1).count() == 0:
            raise ValueError(f"no readable document for {target}")
        return found

    def read(self, target: str, query: str | None = None, offset: int = 0, *, vector: list[float] | None = None) -> DataFrame:
        """``mode`` page: a page of the documents' text; with a query, ``mode`` search: their best passages. ``Engine.documents`` lists them."""
        found, query = self.documents(target), (query or "").strip()
        if not query:
            return documents.page(found, offset).select(F.lit("page").alias("mode"), F.lit(offset).alias("offset"), "*")
        vector, chunks = self._asked(query, vector), self.tables["chunks"]
        within = documents.passage_ids(chunks, found)
        if within.limit(1).count() == 0:
            raise ValueError(f"the documents of {target} are not in the index")
        return retrieval.passages(chunks, self.tables["vectors"], query, vector, within, index=self.text_index()).select(F.lit("search").alias("mode"), F.lit(query).alias("query"), "*")

    def wanted_chunks(self, captions: DataFrame | None = None, exclude: list[str] | None = None, translations: DataFrame | None = None) -> DataFrame:
        """The chunks that the index should hold."""
        t = self.tables
        captions = self.captions() if captions is None else captions
        made = indexing.without_sources(chunking.collect(t["posts"], t["authors"], t["links"], t["documents"], captions, t["media"]), exclude or [])
        return made if translations is None else indexing.translated(made, translations)

    def build_index(self, out: str | None = None, *, exclude: list[str] | None = None, translations: DataFrame | None = None, rebuild: bool = False) -> Build:
        """Bring the index to the posts; with ``out``, write its chunks, vectors and postings there."""
        built = indexing.build(self.wanted_chunks(exclude=exclude, translations=translations), self.tables["chunks"], table(self.spark, self.folder, "chunk_vec"), self.embedder, rebuild=rebuild)
        if out is not None:
            built.chunks.write.parquet(f"{out}/chunks.parquet")
            built.vectors.write.parquet(f"{out}/chunk_vec.parquet")
            if rebuild:
                postings.build(built.chunks, f"{out}/postings")
            else:
                postings.update(self.text_index(), built.chunks, built.dropped, built.added, f"{out}/postings")
        return built

    def report(self) -> str:
        t = self.tables
        return report.render(report.gather(self.all_posts, t["authors"], t["links"], t["media"], self.captions(), state={"last_sync_at": self.last_sync()}))


__all__ = ["SOURCES", "Engine"]
