"""One row per entity, name and role from two families of evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import dealt

#: Documents that are kept as evidence.
EVIDENCE = 20


def _facts(named: DataFrame, **facts: tuple[Callable[[str | Column], Column], Column]) -> DataFrame:
    """(plan_id, name, mentions, doc_ids) and the facts, each (aggregate, values), from one shuffle: the rows are first brought to one
    a document, of which the first few by id are the evidence."""
    keys = ["plan_id", "name"]
    each = dealt(named.select(*keys, "doc_id", *(c.alias(n) for n, (_, c) in facts.items())), *keys).groupBy(*keys, "doc_id")
    each = each.agg(F.count("*").alias("mentions"), *(f(n).alias(n) for n, (f, _) in facts.items()))
    ranked = each.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last())))
    ids = F.sort_array(F.collect_list(F.when(F.col("_n") <= EVIDENCE, F.col("doc_id")))).alias("doc_ids")
    return ranked.groupBy(*keys).agg(F.sum("mentions").alias("mentions"), ids, *(f(n).alias(n) for n, (f, _) in facts.items()))


def from_actions(actions: DataFrame, mapping: DataFrame, now: Column, role: str = "manager", stale_days: int = 730) -> DataFrame:
    """actions (plan_id, manager, action, date, doc_id, ord); mapping (raw, canonical).

    Terminated if the last dated action is ``fire`` (by date, document, ordinal), else current if seen
    within the days, else unknown. Confidence is 0.9 from three mentions on, else 0.6.
    """
    named = actions.withColumn("raw", F.trim("manager")).filter("raw <> '' and raw <> 'N/A'").join(mapping, "raw", "left").withColumn("name", F.coalesce("canonical", "raw"))
    dated = F.when(F.col("date").isNotNull(), F.struct("date", "doc_id", "ord", F.coalesce("action", F.lit("")).alias("action")))
    grouped = _facts(named, last=(F.max, dated), last_seen=(F.max, F.col("date")))
    status = F.when(F.col("last.action") == "fire", "terminated").when(F.col("last_seen") >= F.date_sub(now, stale_days), "current").otherwise("unknown")
    return grouped.select("plan_id", "name", F.lit(role).alias("role"), status.alias("status"), "last_seen", "mentions", "doc_ids", F.when(F.col("mentions") >= 3, 0.9).otherwise(0.6).alias("confidence"))


def from_records(records: DataFrame, role: str = "manager") -> DataFrame:
    """records (plan_id, name, field, state, doc_id): an award counts 0.8 and is unknown if withdrawn or
    cancelled, an incumbent 0.5 and is current. Of several the best status stays: current, terminated, unknown."""
    status = F.when((F.col("field") == "awarded") & F.coalesce(F.col("state").isin("withdrawn", "cancelled"), F.lit(False)), "unknown").otherwise("current")
    rank = F.when(status == "current", 0).otherwise(2)
    named = records.withColumn("name", F.trim("name")).filter("name <> '' and name <> 'N/A'")
    confidence = F.when(F.col("field") == "awarded", 0.8).otherwise(0.5)
    # the status of the least rank
    facts = _facts(named, best=(F.min, F.struct(rank.alias("rank"), status.alias("status"))), confidence=(F.max, confidence))
    return facts.select("plan_id", "name", F.col("best.status").alias("status"), "mentions", "confidence", "doc_ids", F.lit(role).alias("role"))


def roster_reconcile(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first family's status and dates win; confidence is the larger, evidence is joined, mentions add up."""
    a, b = first.alias("a"), second.alias("b")
    keys = ["plan_id", "name", "role"]
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    ids = F.array_union(F.coalesce("a.doc_ids", F.array().cast("array<bigint>")), F.coalesce("b.doc_ids", F.array().cast("array<bigint>")))
    return both.select(
        *(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), F.coalesce("a.status", "b.status").alias("status"), F.col("a.last_seen").alias("last_seen"),
        (F.coalesce("a.mentions", F.lit(0)) + F.coalesce("b.mentions", F.lit(0))).alias("mentions"), F.greatest("a.confidence", "b.confidence").alias("confidence"), F.slice(F.sort_array(ids), 1, EVIDENCE).alias("doc_ids"),
    )
