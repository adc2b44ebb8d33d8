"""A library of documents: their triples in one table partitioned by document, and a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.operators.graph import TripleGraph
from normgraph.staging import Staged, _file_system

_MANIFEST = "doc string, jurisdiction string, format string, tags array<string>, status string, n_triples long"


class Library:
    """Documents under a folder: ``triples`` (s, p, o by doc) and ``manifest``, a log of which the last entry holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _entries(self, rows: DataFrame) -> None:
        rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def add(self, triples: DataFrame, jurisdiction: str = "", form: str = "", tags: Sequence[str] = ()) -> None:
        """Store the triples (s, p, o, doc) of some documents, in place of what was stored of them."""
        g = TripleGraph(triples).df.select("s", "p", "o", "doc").filter("doc is not null")
        g.repartition("doc").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(f"{self.path}/triples")
        made = self.load(None).groupBy("doc").agg(F.count(F.lit(1)).alias("n_triples")).join(g.select("doc").distinct(), "doc", "left_semi")
        self._entries(made.select("doc", F.lit(jurisdiction).alias("jurisdiction"), F.lit(form).alias("format"), F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"), F.lit("ready").alias("status"), "n_triples"))

    def ingest(self, documents: DataFrame, to_triples, force: bool = False, **kind) -> None:
        """Store the texts (doc, text) of documents and the triples (s, p, o, doc) that ``to_triples`` makes of them.

        Documents that are ready are left as they are unless ``force``. If making the triples fails, the
        documents are listed as failed and the error is raised.
        """
        docs = documents.select("doc", "text").filter("doc is not null").dropDuplicates(["doc"])
        if not force and self._has("manifest"):
            docs = docs.join(self.documents().filter("status = 'ready'").select("doc"), "doc", "left_anti")
        docs = Staged(docs, "texts", n=F.count(F.lit(1)))
        if not docs.seen["n"]:
            return
        docs.df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(f"{self.path}/texts")
        try:
            self.add(to_triples(docs.df), **kind)
            missing = docs.df.select("doc").join(self.documents().select("doc"), "doc", "left_anti")
            self._entries(missing.select("doc", F.lit("").alias("jurisdiction"), F.lit("").alias("format"), F.array().cast("array<string>").alias("tags"), F.lit("ready").alias("status"), F.lit(0).cast("long").alias("n_triples")))
        except Exception:
            self._entries(docs.df.select("doc", F.lit("").alias("jurisdiction"), F.lit("").alias("format"), F.array().cast("array<string>").alias("tags"), F.lit("failed").alias("status"), F.lit(0).cast("long").alias("n_triples")))
            raise

    def _has(self, part: str) -> bool:
        fs, target = _file_system(self.spark, f"{self.path}/{part}")
        return fs.exists(target)

    def texts(self, *docs: str) -> DataFrame:
        """(text, doc) of some documents, by default of all that are in the library."""
        t = self.spark.read.schema("text string, doc string").parquet(f"{self.path}/texts")
        return t.filter(F.col("doc").isin(list(docs))) if docs else t.join(self.documents().select("doc"), "doc", "left_semi")

    def remove(self, *docs: str) -> None:
        """Take documents out of the library; their files stay until their next addition."""
        self._entries(self.spark.createDataFrame([(d, "", "", [], "removed", 0) for d in docs], _MANIFEST))

    def documents(self) -> DataFrame:
        """The last manifest entry of each document that is in the library."""
        log = self.spark.read.parquet(f"{self.path}/manifest")
        last = log.groupBy("doc").agg(F.max(F.struct("at", "jurisdiction", "format", "tags", "status", "n_triples")).alias("e")).select("doc", "e.*")
        return last.filter("status <> 'removed'")

    def load(self, docs: Sequence[str] | None = ()) -> DataFrame:
        """(s, p, o, doc) of some documents, by default of all that are ready; None reads what is stored."""
        t = self.spark.read.schema("s string, p string, o string, doc string").parquet(f"{self.path}/triples")
        if docs is None:
            return t
        if docs:
            return t.filter(F.col("doc").isin(list(docs)))
        return t.join(self.documents().filter("status = 'ready'").select("doc"), "doc", "left_semi").select("s", "p", "o", "doc")

    def graph(self, *docs: str) -> TripleGraph:
        return TripleGraph(self.load(docs).select("s", "p", "o"))

    def stats(self) -> DataFrame:
        """(jurisdiction, status, n_documents, n_triples) with totals, whose keys are null."""
        return self.documents().rollup("jurisdiction", "status").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_triples").alias("n_triples"))
