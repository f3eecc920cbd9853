"""What several operators need: the checkpoint folder, folds, and bounded labelled samples."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go where spark.checkpoint.dir says. A local session without it, as in tests, gets a folder of
    its own; on a cluster that would be another one on each machine, so there it is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no taken name equals it in any case."""
    lower, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        out.append(name)
    return out


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(c.cast("string").cast("binary")) % n).cast("int")


def thinned(rows: DataFrame, key: str, total: int, bound: int, seed: int) -> DataFrame:
    """About ``bound`` of ``total`` rows, chosen by a hash of the key: the same rows at every run."""
    share = 1.0 if total <= bound else bound / total
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int, seed: int = 7) -> list[tuple[str, int, float]]:
    """(text, label, weight) of at most about ``bound`` labelled training rows, half of each class where there are so many.

    Rows of the held-out fold are never read. Texts are whole, so that what a label is due to is in the sample
    wherever it stands. Rows that share a doc_id count once, with the least of their texts. The weights give the
    classes their shares in all labelled rows.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", folds) != held))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value, n in sorted(totals.items()):
        own = thinned(known.filter(F.col("label") == value), "doc_id", n, bound // 2, seed)
        chosen = own if chosen is None else chosen.unionByName(own)
    if chosen is None:
        return []
    # some 12 bytes for each of the bounded number of rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = texts.filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("doc_id", "text", "label").collect()
    rows = sorted((r["doc_id"], r["text"], r["label"]) for r in rows)
    got = {value: sum(r[2] == value for r in rows) for value in totals}
    share = {value: totals[value] / sum(totals.values()) / (got[value] / len(rows)) for value in totals if got[value]}
    return [(text, value, share[value]) for _, text, value in rows]


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place (0 on) in the given order within each group; no task holds a whole group.

    The rows are dealt by ranges of group and order, and kept with their place in the partition; a row for each
    partition and group then says how many of the group's rows come before. ``order`` should leave no ties.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    keys = [*(F.col(g) for g in group), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).checkpoint()
    parts = dealt.groupBy("_part", *group).agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("_part", *group, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"))
    return dealt.join(shifts, ["_part", *group]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
