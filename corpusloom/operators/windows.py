"""Latest-per-group, running and representative rows. ``latest_per_group`` itself is with the joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import latest_per_group
from corpusloom.sources.tables import shared_folder


def latest_by_year(rows: DataFrame, key: str, year: str, tie: str) -> DataFrame:
    return latest_per_group(rows, [key], [F.col(year).desc_nulls_last(), F.col(tie).desc()])


def latest_report(rows: DataFrame, key: str, year: str, loaded: str, tie: str) -> DataFrame:
    """Unknown years and load dates count as oldest; the least id wins a tie."""
    floor = F.lit("1900-01-01").cast("date")
    return latest_per_group(rows, [key], [F.coalesce(year, F.lit(0)).desc(), F.coalesce(loaded, floor).desc(), F.col(tie).asc()])


def latest_preferred(rows: DataFrame, key: str, label: str, preferred: str, tie: str) -> DataFrame:
    """A row with exactly the preferred label first, then the greatest id."""
    return latest_per_group(rows, [key], [(F.coalesce(F.col(label) == preferred, F.lit(False))).desc(), F.col(tie).desc()])


def latest_nonempty(rows: DataFrame, key: str, text: str, date: str, tie: str) -> DataFrame:
    return latest_per_group(rows.filter(F.length(F.trim(text)) > 0), [key], [F.col(date).desc_nulls_last(), F.col(tie).desc()])


def latest_then_open(rows: DataFrame, key: str, dates: Sequence[str], tie: str, still_open: Column) -> DataFrame:
    """The newest row per key by the first known date; kept only if it is still open (an older open row is not)."""
    return latest_per_group(rows, [key], [F.coalesce(*dates).desc_nulls_last(), F.col(tie).desc()]).filter(still_open)


def representative_doc(rows: DataFrame, keys: Sequence[str], kind: str, key: str, first_choice: str, second: Sequence[str]) -> DataFrame:
    """Per group the greatest id of the first choice, else the least id of the second ones, else null."""
    best = F.max(F.when(F.col(kind) == first_choice, F.col(key)))
    other = F.min(F.when(F.col(kind).isin(*second), F.col(key)))
    return rows.groupBy(*keys).agg(F.coalesce(best, other).alias("representative"))


def meeting_assembly(docs: DataFrame, summaries: DataFrame, key: str, date: str) -> DataFrame:
    """One row per entity and date: documents in id order with their summaries."""
    rows = docs.join(summaries.select(F.col("document_id").alias("id"), F.col("id").alias("summary_id")), "id", "left")
    grouped = rows.groupBy(key, date).agg(F.sort_array(F.collect_list(F.struct("id", "doc_type", "summary_id"))).alias("documents"))
    floor = F.lit("1900-01-01").cast("date")
    return grouped.withColumn("n_summaries", F.size(F.filter("documents", lambda d: d["summary_id"].isNotNull()))).orderBy(F.coalesce(date, floor).desc(), F.col(key).desc())


def headline_per_entity(rows: DataFrame, key: str, text: str, date: str, tie: str) -> DataFrame:
    """The newest non-empty text of each entity, and its number of dates."""
    said = F.when(F.length(F.trim(text)) > 0, F.col(text))
    order = F.struct(F.coalesce(date, F.lit("1900-01-01").cast("date")), F.col(tie))
    return rows.groupBy(key).agg(F.max_by(said, F.when(said.isNotNull(), order)).alias("headline"), F.countDistinct(date).alias("n_meetings"))


def last_action_status(rows: DataFrame, keys: Sequence[str], action: str, order: Sequence[str], ended: str, now: Column, stale_days: int) -> DataFrame:
    """terminated if the last dated action ended it, else current if seen within the days, else unknown."""
    date = order[0]
    last = rows.groupBy(*keys).agg(F.max_by(action, F.when(F.col(date).isNotNull(), F.struct(*order))).alias("last_action"), F.max(date).alias("last_seen"))
    status = F.when(F.col("last_action") == ended, "terminated").when(F.col("last_seen") >= F.date_sub(now, stale_days), "current").otherwise("unknown")
    return last.withColumn("status", status)


def prior_gap(batch: DataFrame, history: DataFrame, key: str, date: str, days: int) -> DataFrame:
    """Entities of the batch whose last date before the whole batch's first is more than the days older."""
    start = batch.agg(F.min(date).alias("_t0"))  # one row
    before = history.join(batch.select(key).distinct(), key, "left_semi").crossJoin(F.broadcast(start)).filter(F.col(date) < F.col("_t0"))
    return before.groupBy(key).agg(F.max(date).alias("previous"), F.first("_t0").alias("_t0")).filter(F.datediff("_t0", "previous") > days).select(key, "previous")


def retention_keep(rows: DataFrame, key: str, at: str, tie: str, newest: int) -> DataFrame:
    """keep = among the newest of its key, or the first of its calendar month."""
    recent = F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc()))
    monthly = F.row_number().over(Window.partitionBy(key, F.date_trunc("month", F.col(at).cast("timestamp"))).orderBy(at, tie))
    return rows.withColumn("keep", (recent <= newest) | (monthly == 1))


def running_budget(rows: DataFrame, length: str, order: Sequence[Column], budget: int, parts: int | None = None) -> DataFrame:
    """Rows in order while their total length is within the budget.

    Two phases, so that no task holds all rows: totals within range partitions of the order, then
    the totals of the partitions before (one row each). There are as many partitions as shuffles have, unless ``parts`` says.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(rows.sparkSession)  # the cuts are chosen by samples: written once, they are the same for both phases
    rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    dealt = rows.sparkSession.read.parquet(folder)
    own = F.sum(length).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn("_own", own)
    per_part = dealt.groupBy("_part").agg(F.sum(length).alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # over a row a partition
    ahead = per_part.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    total = F.col("_own") + F.col("_before")
    return summed.join(F.broadcast(ahead), "_part").withColumn("running", total).filter(total <= budget).drop("_part", "_own", "_before")


def rank_sources(*sources: tuple[DataFrame, int], key: str, url: str, order: Sequence[Column]) -> DataFrame:
    """Candidates of several sources with a priority each; a url is kept once, from its best source, and ranked."""
    both = None
    for rows, priority in sources:
        rows = rows.select(key, url, "year").withColumn("priority", F.lit(priority))
        both = rows if both is None else both.unionByName(rows)
    first = latest_per_group(both, [key, url], [F.col("priority").asc(), F.coalesce("year", F.lit(0)).desc()])
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("priority", *order)))


def trailing_batch(rows: DataFrame, at: str, key: str, seconds: int) -> DataFrame:
    """(started, ended, n, key): the rows within the seconds before the newest row, with the batch's start, end and size."""
    newest = rows.agg(F.max(at).alias("_end"))  # one row
    last = rows.crossJoin(F.broadcast(newest)).filter(F.col(at) >= F.col("_end") - F.expr(f"interval {seconds} seconds"))
    facts = last.agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))  # one row
    return last.select(key).crossJoin(F.broadcast(facts))
