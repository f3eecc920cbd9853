"""Tables kept as files: rewritten partition by partition, and pages stored by their document."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.incremental import replace_children, upsert
from corpusloom.sources.tables import shared_folder


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class StoredTable:
    """Rows at ``path``, dealt over partitions by a hash of the key. A change reads and writes the partitions of the keys that it
    touches; all other files stay as they are. New partitions are first written aside as a whole, and each change
    gives the same rows when it is made again, so a change that was broken off is made whole by repeating it."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def create(self, rows: DataFrame) -> StoredTable:
        rows.withColumn("_bucket", _bucket(self.key, self.buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("_bucket")

    def change(self, touched: DataFrame, made: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the rows of the partitions that hold a key of ``touched`` by ``made`` of them; gives these partitions' numbers."""
        hit = sorted(r["b"] for r in touched.filter(F.col(self.key).isNotNull()).select(_bucket(self.key, self.buckets).alias("b")).distinct().collect())  # as many as partitions, at most
        if not hit:
            return hit
        stored = self.spark.read.parquet(self.path).filter(F.col("_bucket").isin(hit)).drop("_bucket")
        aside = shared_folder(self.spark)
        made(stored).withColumn("_bucket", _bucket(self.key, self.buckets)).repartition("_bucket").write.parquet(aside)
        new = self.spark.read.parquet(aside)
        left = {r["_bucket"] for r in new.select("_bucket").distinct().collect()}
        if stray := left - set(hit):
            raise ValueError(f"rows of keys that are not touched, in partitions {sorted(stray)}")
        new.repartition("_bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("_bucket").parquet(self.path)
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for b in sorted(set(hit) - left):  # nothing is left of them
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_bucket={b}"), True)
        files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(aside), True)
        return hit

    def upsert(self, incoming: DataFrame, columns: Sequence[str], **how) -> list[int]:
        """``upsert`` of the incoming rows; ``how`` as there."""
        return self.change(incoming, lambda stored: upsert(stored, incoming, self.key, columns, **how).select(self.key, *columns))

    def replace(self, fresh: DataFrame) -> list[int]:
        """``replace_children``: all rows of the keys of ``fresh`` by its rows."""
        return self.change(fresh, lambda stored: replace_children(stored, fresh, self.key))

    def remove(self, keys: DataFrame) -> list[int]:
        return self.change(keys, lambda stored: stored.join(keys.select(self.key), self.key, "left_anti"))


def prune(docs: StoredTable, children: StoredTable, tombstones: StoredTable, old: Column) -> None:
    """Takes old documents out: first their tombstones are set, then their children go, then they themselves. Broken off between two
    of these, a repetition finds the documents still there and ends the work; ``children`` is keyed by the document."""
    gone = docs.read().filter(F.coalesce(old, F.lit(False)))
    marks = gone.select(F.col(tombstones.key)).distinct()
    tombstones.change(marks, lambda stored: stored.unionByName(marks.join(stored, tombstones.key, "left_anti"), allowMissingColumns=True))
    children.remove(gone.select(F.col(docs.key).alias(children.key)))
    docs.remove(gone.select(docs.key))


def save_pages(pages: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Pages (key, page, text) as a table bucketed and sorted by document: grouping by document and joins of per-document results with
    it read it without a shuffle. A task reads a bucket, so there are as many as shuffles have partitions, unless ``buckets`` says."""
    buckets = buckets or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = f"pages_{uuid.uuid4().hex}"
    pages.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, "page").option("path", shared_folder(pages.sparkSession)).saveAsTable(name)
    return pages.sparkSession.table(name)


def open_pages(spark: SparkSession, folder: str, key: str, buckets: int) -> DataFrame:
    """Pages that another session saved at ``folder``, with the same number of buckets."""
    name, columns = f"pages_{uuid.uuid4().hex}", ", ".join(f"{c} {t}" for c, t in spark.read.parquet(folder).dtypes)
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({key}) sorted by ({key}, page) into {buckets} buckets location '{folder}'")
    return spark.table(name)
