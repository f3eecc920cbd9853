"""Grouped facts: coverage, status ladders, roll-ups and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import dealt, latest_per_group


def corpus_stats(**tables: tuple[DataFrame, Column]) -> DataFrame:
    """One row with one aggregate of each table; the cross joins are of single rows."""
    out = None
    for name, (rows, measure) in tables.items():
        one = rows.agg(measure.alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def coverage_by_entity(entities: DataFrame, docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per entity: documents, extracted ones, summaries and the newest download; zeros where there are none.

    entities (id, name), docs (id, plan_id, status, downloaded_on), summaries (document_id).
    Documents and summaries are counted before the join to the entities.
    """
    had = summaries.select(F.col("document_id").alias("id")).distinct().withColumn("_s", F.lit(1))
    per = docs.join(had, "id", "left").groupBy("plan_id").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("status") == "done").alias("n_done"), F.count("_s").alias("n_summaries"), F.max("downloaded_on").alias("last_download")
    )
    joined = entities.select(F.col("id").alias("plan_id"), "name").join(per, "plan_id", "left")
    return joined.select("plan_id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_done", "n_summaries")), "last_download")


def pipeline_status(coverage: DataFrame) -> DataFrame:
    return coverage.filter("n_docs > 0").select("plan_id", "name", "n_docs", "n_done", "n_summaries")


def coverage_status(entities: DataFrame, reports: DataFrame, extracts: DataFrame, aggregators: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Per entity the newest report, one of Missing, Aggregator, Pending, Extracted, the extract's year, and how many
    rows each table of ``parts`` (name -> extract_id) has for it. What an aggregator reports is never extracted.

    reports (plan_id, id, fiscal_year, downloaded_on), extracts (extract_id, document_id, extract_year), aggregators (plan_id).
    """
    order = [F.coalesce("fiscal_year", F.lit(0)).desc(), F.coalesce("downloaded_on", F.lit("1900-01-01").cast("date")).desc(), F.col("id").asc()]
    newest = latest_per_group(reports, ["plan_id"], order)
    had = latest_per_group(extracts, ["document_id"], [F.col("extract_id").desc()]).withColumnRenamed("document_id", "id")
    n = reports.groupBy("plan_id").agg(F.count("*").alias("n_reports"))
    flagged = aggregators.select("plan_id").distinct().withColumn("_aggregator", F.lit(True))
    joined = entities.select(F.col("id").alias("plan_id")).join(newest.join(had, "id", "left"), "plan_id", "left").join(n, "plan_id", "left").join(flagged, "plan_id", "left")
    status = F.when(F.col("id").isNull(), "Missing").when(F.col("_aggregator"), "Aggregator").when(F.col("extract_id").isNull(), "Pending").otherwise("Extracted")
    joined = joined.withColumn("status", status).withColumn("extract_id", F.when(F.col("status") == "Extracted", F.col("extract_id")))
    for name, rows in parts.items():
        joined = joined.join(rows.groupBy("extract_id").agg(F.count("*").alias(name)), "extract_id", "left")
    year = F.when(F.col("status") == "Extracted", F.col("extract_year")).alias("extract_year")
    return joined.select("plan_id", F.col("id").alias("report_id"), "fiscal_year", F.coalesce("n_reports", F.lit(0)).alias("n_reports"), "status", year, *(F.coalesce(c, F.lit(0)).alias(c) for c in parts))


def counts_by(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def latest_year_by_key(rows: DataFrame, key: str, year: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(year).alias("latest_year"))


def freshness_buckets(entities: DataFrame, latest: DataFrame, key: str, current: int) -> DataFrame:
    """Entities by the age of their latest year, with the share that is at most a year old in percent."""
    bucket = F.when(F.col("latest_year").isNull(), "none").when(F.col("latest_year") >= current, "current").when(F.col("latest_year") == current - 1, "previous").otherwise(F.concat(F.lit("stale "), F.col("latest_year").cast("string")))
    counted = entities.select(key).join(latest, key, "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("latest_year") >= current - 1).alias("_fresh"))
    total = counted.agg(F.sum("_fresh").alias("_f"), F.sum("n").alias("_n"))  # one row
    return counted.crossJoin(total).select("bucket", "n", F.floor(100 * F.col("_f") / F.col("_n")).cast("bigint").alias("fresh_percent"))


def gaps_first(entities: DataFrame, latest: DataFrame, key: str, name: str, current: int) -> DataFrame:
    """Entities without a year first, then stale ones by year, then current ones."""
    state = F.when(F.col("latest_year").isNull(), 0).when(F.col("latest_year") < current - 1, 1).otherwise(2)
    return entities.join(latest, key, "left").withColumn("state", state).orderBy("state", F.col("latest_year").asc_nulls_first(), name, key)


def year_range(rows: DataFrame, year: str) -> DataFrame:
    """(min, max) over known years; no row without any."""
    return rows.agg(F.min(year).alias("first_year"), F.max(year).alias("last_year")).filter("first_year is not null")


def mention_rollup(actions: DataFrame, name: str, action: str, entity: str, doc: str, date: str) -> DataFrame:
    """Per trimmed name: mentions, distinct entities, the sorted document ids and their number, histogram of actions, first and last date."""
    known = actions.withColumn("_name", F.trim(name)).filter(F.col("_name") != "").withColumn("_action", F.coalesce(F.lower(F.nullif(F.trim(action), F.lit(""))), F.lit("other")))
    each = known.groupBy("_name", "_action").agg(F.count("*").alias("n"), F.min(date).alias("_first"), F.max(date).alias("_last"))
    histogram = F.map_from_entries(F.sort_array(F.collect_list(F.struct("_action", "n")))).alias("actions")
    facts = each.groupBy("_name").agg(F.sum("n").alias("mentions"), F.min("_first").alias("first_date"), F.max("_last").alias("last_date"), histogram)
    entities = dealt(known.select("_name", entity), "_name", entity).distinct().groupBy("_name").agg(F.count(entity).alias("n_entities"))
    docs = mention_documents(actions, name, doc).groupBy(F.col("name").alias("_name")).agg(F.sort_array(F.collect_list(doc)).alias("doc_ids"))
    return facts.join(entities, "_name").join(docs.withColumn("n_docs", F.size("doc_ids").cast("bigint")), "_name").withColumnRenamed("_name", "name")


def mention_documents(actions: DataFrame, name: str, doc: str) -> DataFrame:
    """(name, document): the documents of each trimmed name, a row each, as a name may have any number."""
    return dealt(actions.select(F.trim(name).alias("name"), doc).filter("name != ''"), "name", doc).distinct()


def canonical_rollup(actions: DataFrame, name: str, mapping: DataFrame, entity: str) -> DataFrame:
    """Variants under their canonical name, recounted from the rows: sums of distinct counts would count twice.

    mapping (raw, canonical, is_manager): unmapped names stand for themselves; names that are no
    managers are only counted.
    """
    known = actions.withColumn("raw", F.trim(name)).filter(F.col("raw") != "").join(mapping, "raw", "left")
    kept = F.coalesce("is_manager", F.lit(True))
    rolled = known.filter(kept).groupBy(F.coalesce("canonical", "raw").alias("name")).agg(F.count("*").alias("mentions"), F.countDistinct(entity).alias("n_entities"), F.countDistinct("raw").alias("n_variants"))
    left_out = known.agg(F.countDistinct(F.when(~kept, F.col("raw"))).alias("n_excluded"))  # one row
    return rolled.crossJoin(left_out)


def action_mode(rows: DataFrame, keys: Sequence[str], label: str, doc: str) -> DataFrame:
    """The most frequent stripped label per group; ties go to the least document, then to the label."""
    counted = rows.withColumn("_l", F.trim(label)).filter("_l is not null").groupBy(*keys, "_l").agg(F.count("*").alias("_n"), F.min(doc).alias("_d"))
    return latest_per_group(counted, keys, [F.col("_n").desc(), F.col("_d").asc(), F.col("_l").asc()]).select(*keys, F.col("_l").alias(label))


def activity_timeline(actions: DataFrame, decisions: DataFrame, entity: str, date: str, ties: Sequence[str], limit: int) -> DataFrame:
    """Both kinds together, equal rows once, dated ones newest first and undated ones last, the first of each entity, with the total count."""
    both = actions.withColumn("kind", F.lit("action")).unionByName(decisions.withColumn("kind", F.lit("decision")), allowMissingColumns=True)
    both = dealt(both, *both.columns).distinct()
    order = Window.partitionBy(entity).orderBy(F.col(date).desc_nulls_last(), "kind", *ties)
    total = both.groupBy(entity).agg(F.count("*").alias("total"))
    return both.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).join(total, entity)


def status_histogram(rows: DataFrame, entity: str, payload: str, path: str = "$.status") -> DataFrame:
    """Counts of a status inside a JSON record; malformed records count as unknown."""
    status = F.try_variant_get(F.try_parse_json(payload), path, "string")
    return rows.groupBy(entity, F.coalesce(status, F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def governance_relations(rows: DataFrame, entity: str, roles: dict[str, str], priority: str) -> DataFrame:
    """(entity, role, name) from the columns of each role, the first by priority of each."""
    pairs = ", ".join(f"'{role}', trim({column})" for role, column in roles.items())
    long = rows.select(entity, priority, F.expr(f"stack({len(roles)}, {pairs}) as (role, name)")).filter("name <> '' and name <> 'N/A'")
    return long.groupBy(entity, "role", "name").agg(F.min(priority).alias("first_seen"))


def completeness_score(rows: DataFrame, present: Sequence[str], counted: dict[str, float], metrics: Sequence[str]) -> DataFrame:
    """Facet scores to two places: 1 for a present column, a capped share of a count, and the share of known metrics."""
    found = [F.col(c).isNotNull().cast("double").alias(f"{c}_score") for c in present]
    shares = [F.round(F.least(F.lit(1.0), F.col(c) / n), 2).alias(f"{c}_score") for c, n in counted.items()]
    known = sum((F.col(m).isNotNull().cast("int") for m in metrics), F.lit(0))
    return rows.select("*", *found, *shares, F.round(known / len(metrics), 2).alias("metrics_score"))


def freshness_date(rows: DataFrame, *dates: str) -> DataFrame:
    """The latest of the known dates; null without any."""
    return rows.withColumn("fresh_as_of", F.greatest(*dates))


def allocation_drift(rows: DataFrame, target: str, actual: str, low: str, high: str) -> DataFrame:
    """Actual less target, and whether the actual is out of its range; null where a part is unknown."""
    outside = F.when(F.col(actual).isNull() | F.col(low).isNull() | F.col(high).isNull(), None).otherwise((F.col(actual) < F.col(low)) | (F.col(actual) > F.col(high)))
    return rows.withColumn("drift", F.col(actual) - F.col(target)).withColumn("out_of_range", outside)


def target_sum_check(rows: DataFrame, key: str, target: str, whole: int, tolerance: int) -> DataFrame:
    return rows.groupBy(key).agg(F.sum(target).alias("target_sum")).filter("target_sum is not null").withColumn("off", F.abs(F.col("target_sum") - whole) > tolerance)


def excess_return(rows: DataFrame, own: str, benchmark: str) -> DataFrame:
    return rows.withColumn("excess", F.col(own) - F.col(benchmark))


def pivot_first(rows: DataFrame, row: str, column: str, values: Sequence, value: str, order: str) -> DataFrame:
    """One column per given value, each cell the first by order. The values are given, so no extra job looks for them."""
    cell = lambda v: F.min_by(value, F.when(F.col(column) == v, F.col(order))).alias(str(v))
    return dealt(rows, row).groupBy(row).agg(*map(cell, values))


def run_outcomes(rows: DataFrame, run: str, status: str, saved: Sequence[str], failed: Sequence[str]) -> DataFrame:
    """Per run: rows, those in the saved and failed statuses, and the saved share in whole percent."""
    n_saved, n_failed = F.count_if(F.col(status).isin(*saved)), F.count_if(F.col(status).isin(*failed))
    return rows.groupBy(run).agg(F.count("*").alias("n"), n_saved.alias("n_saved"), n_failed.alias("n_failed"), F.expr(f"count_if({status} in ({', '.join(repr(s) for s in saved)})) * 100 div count(*)").alias("saved_percent"))


def failure_rollup(failures: DataFrame, skips: DataFrame, entity: str, doc: str) -> DataFrame:
    """Per entity the sorted documents that failed and that were skipped, with the number and the first of each."""
    rows = failure_documents(failures, skips, entity, doc)
    of = lambda kind: F.when(F.col("kind") == kind, F.col(doc))
    lists = [F.sort_array(F.collect_list(of(k))).alias(k) for k in ("failed", "skipped")]
    return rows.groupBy(entity).agg(*(f(of(k)).alias(f"{n}_{k}") for k in ("failed", "skipped") for n, f in (("n", F.count), ("first", F.min))), *lists)


def failure_documents(failures: DataFrame, skips: DataFrame, entity: str, doc: str) -> DataFrame:
    """(entity, kind, document): failed and skipped documents, a row each."""
    return failures.select(entity, F.lit("failed").alias("kind"), doc).unionByName(skips.select(entity, F.lit("skipped").alias("kind"), doc))


def first_match(*rules: tuple[Column, str], default: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out


def period_totals(docs: DataFrame, entities: DataFrame, date: str, now: Column, size: str) -> DataFrame:
    """Entities with activity, their total size (unknown as 0), the date range up to now, and the documents."""
    active = docs.select("plan_id").distinct().join(entities.select(F.col("id").alias("plan_id"), size), "plan_id")
    sizes = active.agg(F.count("*").alias("n_entities"), F.sum(F.coalesce(size, F.lit(0))).alias("total_size"))
    return sizes.crossJoin(docs.agg(F.min(date).alias("first_date"), F.least(F.max(date), now).alias("last_date"), F.count("*").alias("n_docs")))  # one row each


def conditional_counts(rows: DataFrame, *keys: str, **conditions: Column) -> DataFrame:
    """Rows, and rows that meet each condition, per key or in all."""
    counts = [F.count("*").alias("n"), *(F.count_if(c).alias(n) for n, c in conditions.items())]
    return rows.groupBy(*keys).agg(*counts) if keys else rows.agg(*counts)


def url_mining_counts(rows: DataFrame, keys: Sequence[str], url: str, doc: str) -> DataFrame:
    """Per key and url the number of distinct documents that name it, and the least of them."""
    return rows.groupBy(*keys, url).agg(F.countDistinct(doc).alias("n_docs"), F.min(doc).alias("sample"))


def run_membership(rows: DataFrame, runs: DataFrame, run: str, start: str, end: str, at: str, key: str) -> DataFrame:
    """(run, key, n, seconds): the ids created from a run's start to its end, the run's size and its seconds; one row with
    a null id for a run without any. Runs may overlap; they are matched by the days that they touch, so no task
    compares all rows with all runs."""
    day = lambda c: F.to_date(c)
    days = runs.withColumn("_day", F.explode(F.sequence(day(F.col(start)), day(F.col(end)))))
    inside = rows.select(key, at, day(F.col(at)).alias("_day")).join(days, "_day").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).select(run, key)
    n = inside.groupBy(run).agg(F.count("*").alias("n"))
    seconds = F.timestamp_diff("SECOND", F.col(start), F.col(end))
    return runs.select(run, seconds.alias("seconds")).join(n, run, "left").join(inside, run, "left").select(run, key, F.coalesce("n", F.lit(0)).alias("n"), "seconds")
