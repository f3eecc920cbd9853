"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.joins import dealt


def topk_nulls_last(rows: DataFrame, date: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.col(date).desc_nulls_last(), F.col(key).desc()).limit(k)


def multi_nulls_last(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.orderBy(*(F.col(c).desc_nulls_last() for c in columns))


def distinct_topk(rows: DataFrame, value: str, k: int) -> DataFrame:
    """All rows of the k greatest distinct values."""
    top = rows.select(value).distinct().orderBy(F.col(value).desc_nulls_last()).limit(k)
    return rows.join(F.broadcast(top), value, "left_semi")  # k rows


def resort_limited(rows: DataFrame, first: Sequence[Column], k: int, then: Sequence[Column]) -> DataFrame:
    """The top k by one order, shown in another."""
    return rows.orderBy(*first).limit(k).orderBy(*then)


def size_order(rows: DataFrame, size: str, name: str) -> DataFrame:
    """By size, unknown as 0, with a label like ``name ($1500)``."""
    value = F.coalesce(F.col(size), F.lit(0.0))
    return rows.withColumn("label", F.concat(F.col(name), F.lit(" ($"), F.floor(value).cast("string"), F.lit(")"))).orderBy(value.desc(), name)


def paged_results(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows, with the number of all."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))


def last_k_ascending(rows: DataFrame, within: Column, period: str, tie: str, k: int) -> DataFrame:
    """The last k periods within a range, oldest first."""
    return rows.filter(within).orderBy(F.col(period).desc(), F.col(tie).desc()).limit(k).orderBy(period, tie)


def label_union(*labels: Column | tuple[DataFrame, Column]) -> DataFrame:
    """Distinct stripped labels of several sources, blanks left out."""
    out = None
    for rows, label in labels:
        own = rows.select(F.trim(label).alias("label")).filter("label <> ''")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def new_labels(labels: DataFrame, label: str, mapping: DataFrame, raw: str, k: int) -> DataFrame:
    """Labels that the mapping lacks, sorted, the first k."""
    return labels.select(label).distinct().join(mapping.select(F.col(raw).alias(label)), label, "left_anti").orderBy(label).limit(k)


def key_symmetric_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only, from one grouping of both sides."""
    both = left.select(key, F.lit("left").alias("_side")).unionByName(right.select(key, F.lit("right").alias("_side")))
    sides = dealt(both, key).groupBy(key).agg(F.min("_side").alias("side"), F.max("_side").alias("_last"))
    return sides.filter("side = _last").select(key, "side")


def table_counts_compare(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table on both sides."""

    def counted(tables: dict[str, DataFrame], name: str) -> DataFrame:
        out = None
        for table, rows in tables.items():
            own = rows.agg(F.count("*").alias(name)).select(F.lit(table).alias("table_name"), name)
            out = own if out is None else out.unionByName(own)
        return out

    return counted(left, "n_left").join(counted(right, "n_right"), "table_name", "full").withColumn("same", F.col("n_left").eqNullSafe(F.col("n_right")))
