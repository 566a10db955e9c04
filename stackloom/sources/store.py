"""Tables stored by bucket of their key: a change rewrites the buckets of its rows and leaves all other files as they are.

A store is a folder of Parquet with a subfolder for each bucket, a hash of the key.  A change reads only the buckets
of its rows, and replaces each by one rename of a folder (dynamic partition overwrite).  Changes are idempotent: one
that was broken off half-way is made whole by being made again.  One writer at a time, any number of readers.

The number of buckets is fixed when the store is first written.  It bounds what the driver sees of a change: the
list of its buckets.  ``files`` deals a bucket's rows over so many tasks and files, for buckets above a task's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom import schemas
from stackloom.checkpoints import cut, drop
from stackloom.operators import state

Merge = Callable[[DataFrame, DataFrame], DataFrame]
_BUCKET = "_bucket"


def bucket(key: Column, buckets: int) -> Column:
    """A key's bucket: the first 32 bits of its MD5, modulo ``buckets``; null keys count as empty ones."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") % buckets).cast("int")


class Store:
    """One table of ``schema`` under ``path``, by buckets of ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "doc_id", buckets: int = 64, files: int = 1):
        self.spark, self.path, self.schema, self.key, self.files = spark, path, schema, key, files
        self.buckets = self._number(buckets)

    def _number(self, buckets: int) -> int:
        """The stored number of buckets; ``buckets`` where nothing is stored yet."""
        try:
            return self.spark.read.schema("buckets int").json(f"{self.path}/_buckets").first().buckets
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return buckets

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_BUCKET}={number}")

    def _rows(self) -> DataFrame:
        stored = T.StructType([*self.schema, T.StructField(_BUCKET, T.IntegerType())])
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path), self._fs()
        if not fs.exists(path) or not any(x.getPath().getName().startswith(f"{_BUCKET}=") for x in fs.listStatus(path)):
            return self.spark.createDataFrame([], stored)
        self.spark.catalog.refreshByPath(self.path)
        rows = self.spark.read.parquet(self.path)
        return schemas.conform(rows, stored)

    def read(self) -> DataFrame:
        return self._rows().drop(_BUCKET)

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``; only their buckets are read."""
        named = keys.select(F.col(self.key)).distinct()
        return self._within(self._touched(named)).join(named, self.key, "left_semi").select(*self.schema.names)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(bucket(F.col(self.key), self.buckets)).distinct().collect())

    def _within(self, numbers: list[int]) -> DataFrame:
        return self._rows().filter(F.col(_BUCKET).isin(numbers)).drop(_BUCKET)

    def change(self, new: DataFrame, merge: Merge, shrinks: bool = False) -> list[int]:
        """``merge(old rows of the buckets of new, new)`` takes the place of these buckets; returns them.

        ``shrinks`` says that it may leave a bucket without rows.
        """
        new = cut(new)  # read twice, and made once
        touched = self._touched(new)
        if not touched:
            drop(new)
            return []
        merged = schemas.conform(merge(self._within(touched), new), self.schema).withColumn(_BUCKET, bucket(F.col(self.key), self.buckets))
        left = {r[0] for r in merged.select(_BUCKET).distinct().collect()} if shrinks else set(touched)
        dealt = [F.col(_BUCKET), F.pmod(F.xxhash64(*self.schema.names), F.lit(self.files))] if self.files > 1 else [F.col(_BUCKET)]
        spread = merged.repartition(len(touched) * self.files, *dealt)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)
        for number in set(touched) - left:
            self._fs().delete(self._folder(number), True)
        self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("ignore").json(f"{self.path}/_buckets")
        drop(new)
        return touched

    def upsert(self, new: DataFrame) -> list[int]:
        """``new`` rows in place of those with their key."""
        return self.change(new, lambda old, rows: state.upsert(old, rows, self.key))

    def delete(self, keys: DataFrame) -> list[int]:
        return self.change(keys.select(self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"), shrinks=True)


class Library:
    """The stores of one document library under a folder, and their writes."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        make = lambda name, schema, key: Store(spark, f"{folder}/{name}", schema, key, buckets)
        self.papers = make("papers", schemas.PAPERS, "id")
        self.chunks = make("chunks", schemas.CHUNKS, "doc_id")
        self.meta = make("index_meta", schemas.INDEX_META, "doc_id")
        self.details = make("details", schemas.DETAILS, "doc_id")

    def transition(self, outcomes: DataFrame) -> list[int]:
        """States after ``outcomes(id, new_status, new_error)``."""
        return self.papers.change(outcomes, state.transition)

    def save_details(self, new: DataFrame) -> list[int]:
        """Whole rows of details; empty new values of the carried columns keep the old ones."""
        return self.details.change(new, lambda old, rows: state.upsert(old, state.carry_forward(old, rows), "doc_id"))

    def replace_chunks(self, documents: DataFrame, chunks: DataFrame, now: Column) -> list[int]:
        """All chunks of ``documents(doc_id, md_hash)`` give way to ``chunks``; the documents count as not embedded.

        Chunks go first: where the second write fails, the old hash still says that the document needs an index.
        """
        named = cut(documents.select("doc_id", "md_hash"))
        own = cut(named.join(schemas.conform(chunks, schemas.CHUNKS), "doc_id", "left"))

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            kept = old.join(new.select("doc_id").distinct(), "doc_id", "left_anti")
            return kept.unionByName(new.filter("chunk_id is not null").select(*kept.columns))

        touched = self.chunks.change(own, merge, shrinks=True)
        counts = own.groupBy("doc_id").agg(F.count("chunk_id").cast("int").alias("n_chunks"))
        self.meta.upsert(named.join(counts, "doc_id").select("doc_id", "md_hash", "n_chunks", F.lit(False).alias("embedded"), now.cast("string").alias("indexed_at")))
        drop(named, own)
        return touched

    def save_embeddings(self, vectors: DataFrame, model: str) -> list[int]:
        """Vectors of ``vectors(doc_id, chunk_id, vector)``; documents whose chunks all have one then count as embedded.

        A null vector saves nothing: a document without chunks is named by it.
        """
        made = cut(vectors.select("doc_id", "chunk_id", "vector"))

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            joined = old.join(new.filter("vector is not null").select("chunk_id", F.col("vector").cast("array<float>")), "chunk_id", "left")
            values = {"embedding": F.coalesce("vector", "embedding"), "embedding_model": F.when(F.col("vector").isNotNull(), model).otherwise(F.col("embedding_model"))}
            return joined.select(*[values.get(c, F.col(c)).alias(c) for c in old.columns])

        touched = self.chunks.change(made, merge)
        named = made.select("doc_id").distinct()
        open_ = self.chunks.of(named).filter("embedding is null").select("doc_id").distinct()
        self.meta.change(named.join(open_, "doc_id", "left_anti"), lambda old, done: old.join(done.withColumn("_done", F.lit(True)), "doc_id", "left").withColumn("embedded", F.coalesce("_done", "embedded")).drop("_done"))
        drop(made)
        return touched
