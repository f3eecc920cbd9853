"""Joins and look-ups. The physical join is left to Spark, but for sides of a fixed or checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import shared_folder


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys, over as many partitions as shuffles have. A number that is given stays: adaptive execution joins partitions by
    their bytes, so narrow rows that compress well would become few tasks with large hash tables and sorts."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def first_few(rows: DataFrame, keys: Sequence[str], value: str, n: int, name: str) -> DataFrame:
    """(keys, name): the n least values of each key, in order. The rows are cut to n a key before they are grouped."""
    own = Window.partitionBy(*keys).orderBy(value)
    few = rows.select(*keys, value).filter(F.col(value).isNotNull()).distinct().withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= n)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))


def latest_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group by a full ordering. Spark cuts to one row a group and task before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def join_inner(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "inner")


def join_left_chain(base: DataFrame, *steps: tuple[DataFrame, Column]) -> DataFrame:
    """Left outer joins, one after another."""
    for right, on in steps:
        base = base.join(right, on, "left")
    return base


def with_reason(rows: DataFrame, reasons: DataFrame, key: str, required: bool) -> DataFrame:
    """Rows with the reason noted for their key; without one they are kept or, if it is required, dropped."""
    return rows.join(reasons, key, "inner" if required else "left")


def anti_worklist(rows: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Rows whose key is in none of the tables (each with a column named as the key)."""
    for d in done:
        rows = rows.join(d.select(key), key, "left_anti")
    return rows


def anti_versioned(rows: DataFrame, key: str, processed: DataFrame, version: str, current: int) -> DataFrame:
    """Rows not processed at the current version."""
    return rows.join(processed.filter(F.col(version) == current).select(key).distinct(), key, "left_anti")


def semi_ids(rows: DataFrame, key: str, ids: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi").orderBy(*order).limit(limit)


def join_array_ids(holders: DataFrame, json_ids: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands in a JSON array of the holders; malformed arrays are empty."""
    ids = F.from_json(json_ids, "array<bigint>")
    return holders.withColumn(key, F.explode(ids)).drop(json_ids).join(rows, key)


def join_latest(rows: DataFrame, keys: Sequence[str], newest: str, condition: Column) -> DataFrame:
    """The row with the greatest ``newest`` per key among those that meet the condition."""
    chosen = rows.filter(condition)
    best = chosen.groupBy(*keys).agg(F.max(newest).alias(newest))
    return chosen.join(best, [*keys, newest])


def join_fallback(entities: DataFrame, key: str, details: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """All entities with their details, or the defaults."""
    return entities.join(details, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


def label_lookup(dimension: DataFrame, key: str, *names: str) -> DataFrame:
    """Each name, or the key as text."""
    return dimension.select(key, *(F.coalesce(F.col(n), F.col(key).cast("string")).alias(n) for n in names))


def entity_detail(entities: DataFrame, extracts: DataFrame, children: DataFrame, entity: str, extract: str, order: Sequence[Column]) -> DataFrame:
    """Each entity with its newest extract, if any, and that extract's children."""
    newest = latest_per_group(extracts, [entity], order)
    return entities.join(newest, entity, "left").join(children, extract, "left")


def asof_instant(snapshots: DataFrame, key: str, at: str, instant: Column, tie: str) -> DataFrame:
    """Each key's newest snapshot at or before one instant."""
    return latest_per_group(snapshots.filter(F.col(at) <= instant), [key], [F.col(at).desc(), F.col(tie).desc()])


def asof_many(probes: DataFrame, snapshots: DataFrame, key: str, at: str, tie: str, values: Sequence[str]) -> DataFrame:
    """For each probe (key, at) the values of the newest snapshot at or before it; by one sorted pass, no range join.

    The pass is cut by ranges of key and time, so that a key with very many rows is no single task's: each range
    finds its own last values, and the last value that a key had before a range is carried over the cut.
    """
    spark = probes.sparkSession
    empty = F.lit(None).cast(snapshots.select(F.struct(*values)).schema[0].dataType).alias("_v")
    both = snapshots.select(key, at, tie, F.lit(0).alias("_probe"), F.struct(*values).alias("_v")).unionByName(probes.select(key, at, tie, F.lit(1).alias("_probe"), empty))
    folder = shared_folder(spark)  # the cuts are chosen by samples: written once, they are the same for both steps
    both.repartitionByRange(key, at, "_probe", tie).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    dealt = spark.read.parquet(folder)
    order = [at, "_probe", tie]
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = dealt.groupBy("_part", key).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range that the key is in
    carried = ends.select("_part", key, F.last("_end", ignorenulls=True).over(before).alias("_carried")).filter("_carried is not null")
    last = dealt.withColumn("_last", own).filter("_probe = 1").join(carried, ["_part", key], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return last.select(key, at, tie, *(F.col("_last")[v].alias(v) for v in values))


def mapping_join(rows: DataFrame, raw: str, mapping: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """The canonical name of a trimmed raw label; ``unmapped`` if missing, null or outside the vocabulary."""
    canonical = F.when(F.col("canonical").isin(*vocabulary), F.col("canonical"))
    known = mapping.select(F.trim("raw").alias("_raw"), canonical.alias("canonical"))
    return rows.join(known, F.trim(raw) == F.col("_raw"), "left").drop("_raw").withColumn("canonical", F.coalesce("canonical", F.lit("unmapped")))


def coverage_gap(entities: DataFrame, key: str, active: DataFrame, size: str) -> DataFrame:
    """Entities without an active source, larger ones first, an unknown size as 0."""
    return entities.join(active.select(key), key, "left_anti").orderBy(F.coalesce(size, F.lit(0.0)).desc(), key)


def orphan_check(children: Sequence[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """(table, column, id) of every child row whose non-null parent is missing.

    Each entry: table name, child rows, child id, foreign key, parent rows, parent key.
    """
    out = None
    for table, child, child_id, foreign, parent, parent_key in children:
        keys = parent.select(F.col(parent_key).alias("_parent")).distinct()
        lost = child.filter(F.col(foreign).isNotNull()).join(keys, F.col(foreign) == F.col("_parent"), "left_anti")
        lost = lost.select(F.lit(table).alias("table_name"), F.lit(foreign).alias("column_name"), F.col(child_id).cast("bigint").alias("id"))
        out = lost if out is None else out.unionByName(lost)
    return out


def row_digest(rows: DataFrame, columns: Sequence[str]) -> Column:
    """md5 over the columns in order; floats are rounded to six places, so noise below that is equal."""
    kinds = dict(rows.dtypes)
    texts = [F.round(c, 6).cast("string") if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *(F.coalesce(t, F.lit("\\N")) for t in texts)))


def dataset_diff(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], buckets: int = 4096) -> DataFrame:
    """(key, change): left_only, right_only or changed for rows, and one row with a null key and ``count_differs`` where the numbers
    of rows differ.

    Both sides are first brought down to a count and two sums of row digests for each bucket of keys; only the rows
    of buckets that differ are then joined, so two versions that are nearly equal are told apart without a shuffle of their rows.
    """

    def digested(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(key).alias("key"), row_digest(rows, columns).alias("digest"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"))

    def summed(rows: DataFrame, side: str) -> DataFrame:
        part = lambda at: F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("\\N")), "digest")), at, 15), 16, 10).cast("decimal(38,0)")
        return rows.groupBy("bucket").agg(F.struct(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b")).alias(side))

    a, b = digested(left), digested(right)
    totals = summed(a, "x").join(summed(b, "y"), "bucket", "full")
    unequal = F.broadcast(totals.filter(~F.col("x").eqNullSafe(F.col("y"))).select("bucket"))  # as many rows as buckets, at most
    a, b = (side.join(unequal, "bucket", "left_semi").select("key", F.col("digest").alias(name)) for side, name in ((a, "_a"), (b, "_b")))
    change = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when(F.col("_a") != F.col("_b"), "changed")
    rows = a.join(b, "key", "full").select("key", change.alias("change")).filter("change is not null")
    n = lambda side: F.sum(F.coalesce(F.col(f"{side}.n"), F.lit(0)))
    counts = totals.agg((n("x") != n("y")).alias("differ")).filter("differ").select(F.lit(None).cast(left.schema[key].dataType).alias("key"), F.lit("count_differs").alias("change"))
    return rows.unionByName(counts).withColumnRenamed("key", key)


def snapshot_hash_diff(left: DataFrame, right: DataFrame, key: str, digest: str, order: Sequence[Column]) -> DataFrame:
    """Keys whose newest digests differ or are missing on one side."""
    a, b = (latest_per_group(s, [key], order).select(key, F.col(digest).alias(n)) for s, n in ((left, "left_hash"), (right, "right_hash")))
    return a.join(b, key, "full").filter(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
