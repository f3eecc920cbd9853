"""Queries for grouped facts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import aggregates as op
from corpusloom.operators.joins import dealt
from corpusloom.plans.registry import query
from corpusloom.plans.views import Views


def now():
    return F.lit("2000-01-01").cast("date")


@query("select (select count(*) from plan) as plans, (select count(*) from doc) as docs, (select count(*) from doc where status = 'done') as extracted, (select count(*) from summ) as summaries")
def corpus_stats(v: Views) -> DataFrame:
    n = F.count("*")
    return op.corpus_stats(plans=(v.plan, n), docs=(v.doc, n), extracted=(v.doc, F.count_if(F.col("status") == "done")), summaries=(v.summ, n))


_COVERAGE = """with c as (select p.id as plan_id, p.name, count(distinct d.id) as n_docs, count(distinct case when d.status = 'done' then d.id end) as n_done,
count(distinct s.id) as n_summaries, max(d.downloaded_on) as last_download from plan p left join doc d on d.plan_id = p.id left join summ s on s.document_id = d.id group by 1, 2) """


@query(_COVERAGE + "select * from c")
def coverage_by_entity(v: Views) -> DataFrame:
    return op.coverage_by_entity(v.plan, v.doc, v.summ)


@query(_COVERAGE + "select plan_id, name, n_docs, n_done, n_summaries from c where n_docs > 0")
def pipeline_status(v: Views) -> DataFrame:
    return op.pipeline_status(op.coverage_by_entity(v.plan, v.doc, v.summ))


_STATUS = """with r as (select plan_id, id, fiscal_year, count(*) over (partition by plan_id) as n_reports,
row_number() over (partition by plan_id order by coalesce(fiscal_year, 0) desc, coalesce(downloaded_on, date '1900-01-01') desc, id) as n from doc where doc_type = 'cafr'),
g as (select p.id as plan_id, r.id as report_id, r.fiscal_year, coalesce(r.n_reports, 0) as n_reports, s.id as summary_id,
case when r.id is null then 'Missing' when p.id % 6 = 0 then 'Aggregator' when s.id is null then 'Pending' else 'Extracted' end as status
from plan p left join r on r.plan_id = p.id and r.n = 1 left join summ s on s.document_id = r.id),
c as (select plan_id, report_id, fiscal_year, n_reports, status, case when status = 'Extracted' then cast(2000 + summary_id % 25 as int) end as extract_year,
case when status = 'Extracted' then (select count(*) from alloc where extract_id = report_id) else 0 end as n_allocations,
case when status = 'Extracted' then (select count(*) from act where doc_id = report_id and action = 'hire') else 0 end as n_performance from g) """


def _status(v: Views) -> DataFrame:
    extracts = v.summ.select(F.col("document_id").alias("extract_id"), "document_id", (2000 + F.col("id") % 25).cast("int").alias("extract_year"))
    parts = {"n_allocations": v.alloc, "n_performance": v.act.filter("action = 'hire'").select(F.col("doc_id").alias("extract_id"))}
    return op.coverage_status(v.plan, v.doc.filter("doc_type = 'cafr'"), extracts, v.plan.filter("id % 6 = 0").select(F.col("id").alias("plan_id")), parts)


@query(_STATUS + "select * from c")
def coverage_status(v: Views) -> DataFrame:
    return _status(v)


@query(_STATUS + "select status, count(*) as n from c group by 1")
def coverage_counts(v: Views) -> DataFrame:
    return op.counts_by(_status(v), "status")


@query("select plan_id, max(fiscal_year) as latest_year, cast(count(*) as bigint) as n from doc group by 1")
def latest_year_by_key(v: Views) -> DataFrame:
    return op.latest_year_by_key(v.doc, "plan_id", "fiscal_year").join(op.counts_by(v.doc, "plan_id"), "plan_id")


_FRESH = """with y as (select p.id, p.name, max(d.fiscal_year) as latest_year from plan p left join doc d on d.plan_id = p.id and d.doc_type = 'cafr' group by 1, 2) """


def _years(v: Views) -> DataFrame:
    return op.latest_year_by_key(v.doc.filter("doc_type = 'cafr'"), "plan_id", "fiscal_year").withColumnRenamed("plan_id", "id")


@query(_FRESH + """, b as (select case when latest_year is null then 'none' when latest_year >= 2001 then 'current' when latest_year = 2000 then 'previous' else concat('stale ', cast(latest_year as varchar)) end as bucket, latest_year from y)
select bucket, count(*) as n, (select cast(floor(100.0 * count(*) filter (where latest_year >= 2000) / count(*)) as bigint) from y) as fresh_percent from b group by 1""")
def freshness_buckets(v: Views) -> DataFrame:
    return op.freshness_buckets(v.plan.select("id"), _years(v), "id", 2001)


@query(_FRESH + "select id, name, latest_year, case when latest_year is null then 0 when latest_year < 2000 then 1 else 2 end as state from y order by state, latest_year nulls first, name, id")
def gaps_first_detail(v: Views) -> DataFrame:
    return op.gaps_first(v.plan.select("id", "name"), _years(v), "id", "name", 2001)


@query("select min(fiscal_year) as first_year, max(fiscal_year) as last_year from doc where doc_type = 'cafr'")
def year_range(v: Views) -> DataFrame:
    return op.year_range(v.doc.filter("doc_type = 'cafr'"), "fiscal_year")


def _dated_actions(v: Views) -> DataFrame:
    return v.act.join(v.doc.select(F.col("id").alias("doc_id"), "plan_id", "meeting_date"), "doc_id")


@query("""with a as (select trim(manager) as name, coalesce(lower(nullif(trim(action), '')), 'other') as action, doc_id, plan_id, meeting_date from act join doc on doc.id = act.doc_id where trim(manager) <> '')
select name, count(*) as mentions, count(distinct plan_id) as n_entities, count(distinct doc_id) as n_docs, array_to_string(list_sort(list_distinct(list(doc_id))), ' ') as docs, min(meeting_date) as first_date, max(meeting_date) as last_date,
count(*) filter (where action = 'hire') as n_hire, count(*) filter (where action = 'other') as n_other from a group by 1""")
def mention_rollup(v: Views) -> DataFrame:
    rolled = op.mention_rollup(_dated_actions(v), "manager", "action", "plan_id", "doc_id", "meeting_date")
    of = lambda a: F.coalesce(F.col("actions")[a], F.lit(0)).alias(f"n_{a}")
    return rolled.select("name", "mentions", "n_entities", "n_docs", F.array_join(F.col("doc_ids").cast("array<string>"), " ").alias("docs"), "first_date", "last_date", of("hire"), of("other"))


@query("""with a as (select trim(manager) as raw, plan_id from act join doc on doc.id = act.doc_id where trim(manager) <> ''),
m as (select *, case when raw = 'N/A' then false else true end as is_manager, case when length(raw) <= 2 then 'short' else raw end as canonical from a)
select canonical as name, count(*) as mentions, count(distinct plan_id) as n_entities, count(distinct raw) as n_variants, (select count(distinct raw) from m where not is_manager) as n_excluded from m where is_manager group by 1""")
def canonical_rollup(v: Views) -> DataFrame:
    names = v.act.select(F.trim("manager").alias("raw")).filter("raw <> ''").distinct()
    mapping = names.filter("length(raw) <= 2 or raw = 'N/A'").select("raw", F.when(F.length("raw") <= 2, "short").alias("canonical"), (F.col("raw") != "N/A").alias("is_manager"))
    return op.canonical_rollup(_dated_actions(v), "manager", mapping, "plan_id")


@query("""with c as (select plan_id, trim(manager) as manager, count(*) as n, min(doc_id) as d from act join doc on doc.id = act.doc_id where manager is not null group by 1, 2),
r as (select *, row_number() over (partition by plan_id order by n desc, d, manager) as k from c) select plan_id, manager from r where k = 1""")
def action_mode(v: Views) -> DataFrame:
    return op.action_mode(_dated_actions(v), ["plan_id"], "manager", "doc_id")


@query("""with b as (select plan_id, doc_id, cast(ord as int) as ord, meeting_date, 'action' as kind from act join doc on doc.id = act.doc_id where action is not null
union all select plan_id, id, 0, meeting_date, 'decision' from doc where doc_type = 'minutes'),
d as (select distinct * from b), r as (select *, row_number() over (partition by plan_id order by meeting_date desc nulls last, kind, doc_id, ord) as position, count(*) over (partition by plan_id) as total from d)
select plan_id, doc_id, ord, meeting_date, kind, cast(position as int) as position, total from r where position <= 15""")
def activity_timeline(v: Views) -> DataFrame:
    actions = _dated_actions(v).filter("action is not null").select("plan_id", "doc_id", "ord", "meeting_date")
    decisions = v.doc.filter("doc_type = 'minutes'").select("plan_id", F.col("id").alias("doc_id"), F.lit(0).alias("ord"), "meeting_date")
    return op.activity_timeline(actions, decisions, "plan_id", "meeting_date", ["doc_id", "ord"], 15)


@query("""with r as (select entity_id, case when id % 13 = 0 then '{bad' else concat('{"status": "', status, '"}') end as payload, status, id from ev)
select entity_id, case when id % 13 = 0 then 'unknown' else status end as status, count(*) as n from r group by 1, 2""")
def status_histogram(v: Views) -> DataFrame:
    payload = F.when(F.col("id") % 13 == 0, "{bad").otherwise(F.concat(F.lit('{"status": "'), "status", F.lit('"}')))
    return op.status_histogram(v.ev.select("entity_id", payload.alias("payload")), "entity_id", "payload")


@query("""with w as (select plan_id, doc_id, case when action = 'hire' then manager end as awarded, case when action = 'fire' then manager end as incumbent from act join doc on doc.id = act.doc_id),
l as (select plan_id, doc_id, 'awarded' as role, trim(awarded) as name from w union all select plan_id, doc_id, 'incumbent', trim(incumbent) from w)
select plan_id, role, name, min(doc_id) as first_seen from l where name <> '' and name <> 'N/A' group by 1, 2, 3""")
def governance_relations(v: Views) -> DataFrame:
    rows = _dated_actions(v).select("plan_id", "doc_id", F.when(F.col("action") == "hire", F.col("manager")).alias("awarded"), F.when(F.col("action") == "fire", F.col("manager")).alias("incumbent"))
    return op.governance_relations(rows, "plan_id", {"awarded": "awarded", "incumbent": "incumbent"}, "doc_id")


_FACETS = "(select plan_id, max(fiscal_year) as fiscal_year, max(meeting_date) as meeting_date, max(case when doc_type = 'cafr' then downloaded_on end) as report_date, count(*) as docs, count(doc_type) as typed from doc group by 1)"


def _facets(v: Views) -> DataFrame:
    report = F.max(F.when(F.col("doc_type") == "cafr", F.col("downloaded_on")))
    return v.doc.groupBy("plan_id").agg(F.max("fiscal_year").alias("fiscal_year"), F.max("meeting_date").alias("meeting_date"), report.alias("report_date"), F.count("*").alias("docs"), F.count("doc_type").alias("typed"))


@query(f"""select plan_id, cast(case when report_date is null then 0 else 1 end as double) as report_date_score, round(least(1.0, docs / 5.0), 2) as docs_score,
round(least(1.0, typed / 20.0), 2) as typed_score, round((cast(fiscal_year is not null as int) + cast(meeting_date is not null as int) + cast(report_date is not null as int)) / 3.0, 2) as metrics_score from {_FACETS} f""")
def completeness_score(v: Views) -> DataFrame:
    scored = op.completeness_score(_facets(v), ["report_date"], {"docs": 5.0, "typed": 20.0}, ["fiscal_year", "meeting_date", "report_date"])
    return scored.select("plan_id", "report_date_score", "docs_score", "typed_score", "metrics_score")


@query(f"select plan_id, greatest(meeting_date, report_date) as fresh_as_of from {_FACETS} f")
def freshness_date(v: Views) -> DataFrame:
    return op.freshness_date(_facets(v), "meeting_date", "report_date").select("plan_id", "fresh_as_of")


@query("""select extract_id, seq, target_bp, actual_bp, actual_bp - target_bp as drift,
case when actual_bp is null then null else actual_bp < range_low * 20 or actual_bp > range_high * 20 end as out_of_range from alloc""")
def allocation_drift(v: Views) -> DataFrame:
    rows = v.alloc.withColumn("low", F.col("range_low") * 20).withColumn("high", F.col("range_high") * 20)
    return op.allocation_drift(rows, "target_bp", "actual_bp", "low", "high").select("extract_id", "seq", "target_bp", "actual_bp", "drift", "out_of_range")


@query("select extract_id, cast(sum(target_bp) as bigint) as target_sum, abs(sum(target_bp) - 1000) > 100 as off from alloc group by 1 having sum(target_bp) is not null")
def target_sum_check(v: Views) -> DataFrame:
    return op.target_sum_check(v.alloc, "extract_id", "target_bp", 1000, 100)


@query("select extract_id, seq, actual_bp - target_bp as excess from alloc")
def excess_return(v: Views) -> DataFrame:
    return op.excess_return(v.alloc, "actual_bp", "target_bp").select("extract_id", "seq", "excess")


@query("""select extract_id, arg_min(actual_bp, seq) filter (where seq = 1) as "1", arg_min(actual_bp, seq) filter (where seq = 2) as "2", arg_min(actual_bp, seq) filter (where seq = 3) as "3"
from (select extract_id, seq, max(actual_bp) as actual_bp from alloc group by 1, 2) a group by 1""")
def pivot_first(v: Views) -> DataFrame:
    cells = dealt(v.alloc.select("extract_id", "seq", "actual_bp"), "extract_id").groupBy("extract_id", "seq").agg(F.max("actual_bp").alias("actual_bp"))
    return op.pivot_first(cells, "extract_id", "seq", [1, 2, 3], "actual_bp", "seq")


@query("""select entity_id, count(*) as n, count(*) filter (where status in ('click', 'view')) as n_saved, count(*) filter (where status in ('purchase', 'error')) as n_failed,
cast(count(*) filter (where status in ('click', 'view')) * 100 // count(*) as bigint) as saved_percent from ev group by 1""")
def run_outcomes(v: Views) -> DataFrame:
    return op.run_outcomes(v.ev, "entity_id", "status", ["click", "view"], ["purchase", "error"])


@query("""select plan_id, count(*) filter (where status = 'failed') as n_failed, min(id) filter (where status = 'failed') as first_failed, count(*) filter (where id % 4 = 0) as n_skipped, min(id) filter (where id % 4 = 0) as first_skipped,
coalesce(string_agg(case when status = 'failed' then cast(id as varchar) end, ' ' order by id), '') as failed, coalesce(string_agg(case when id % 4 = 0 then cast(id as varchar) end, ' ' order by id), '') as skipped from doc group by 1 having count(*) filter (where status = 'failed' or id % 4 = 0) > 0""")
def failure_rollup(v: Views) -> DataFrame:
    rows = v.doc.select("plan_id", "id", "status")
    rolled = op.failure_rollup(rows.filter("status = 'failed'"), rows.filter("id % 4 = 0"), "plan_id", "id")
    listed = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("failed", "skipped")]
    return rolled.select("plan_id", "n_failed", "first_failed", "n_skipped", "first_skipped", *listed)


@query("select plan_id, 'failed' as kind, id from doc where status = 'failed' union all select plan_id, 'skipped', id from doc where id % 4 = 0")
def failure_documents(v: Views) -> DataFrame:
    rows = v.doc.select("plan_id", "id", "status")
    return op.failure_documents(rows.filter("status = 'failed'"), rows.filter("id % 4 = 0"), "plan_id", "id")


@query("select distinct trim(manager) as name, doc_id from act join doc on doc.id = act.doc_id where trim(manager) <> ''")
def mention_documents(v: Views) -> DataFrame:
    return op.mention_documents(_dated_actions(v), "manager", "doc_id")


@query("""select case when doc_type is null then 'untyped' when amount < 50000 then 'too small' when meeting_date is null then 'undated' else 'unknown' end as reason, count(*) as n from doc where status = 'failed' group by 1""")
def reason_counts(v: Views) -> DataFrame:
    reason = op.first_match((F.col("doc_type").isNull(), "untyped"), (F.col("amount") < 50_000, "too small"), (F.col("meeting_date").isNull(), "undated"), default="unknown")
    return op.counts_by(v.doc.filter("status = 'failed'").withColumn("reason", reason), "reason")


@query("""select d.id, case when s.id is not null then 'summarised' when d.doc_type is null then 'untyped' when d.status <> 'done' then 'not extracted' else 'waiting' end as outcome from doc d left join summ s on s.document_id = d.id""")
def report_split(v: Views) -> DataFrame:
    rows = v.doc.join(v.summ.select(F.col("document_id").alias("id"), F.col("id").alias("summary_id")), "id", "left")
    outcome = op.first_match((F.col("summary_id").isNotNull(), "summarised"), (F.col("doc_type").isNull(), "untyped"), (F.col("status") != "done", "not extracted"), default="waiting")
    return rows.select("id", outcome.alias("outcome"))


@query("select count(*) as n, cast(sum(amount_cents) as bigint) as total_cents, count(distinct plan_id) as n_plans from act join doc on doc.id = act.doc_id where action in ('hire', 'commitment')")
def deployment_totals(v: Views) -> DataFrame:
    return _dated_actions(v).filter("action in ('hire', 'commitment')").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total_cents"), F.countDistinct("plan_id").alias("n_plans"))


@query("""with d as (select * from doc where downloaded_on >= date '1999-06-01')
select (select count(*) from plan where id in (select plan_id from d)) as n_entities, (select cast(sum(coalesce(cast(round(size * 100) as bigint), 0)) as bigint) from plan where id in (select plan_id from d)) as total_size,
min(meeting_date) as first_date, least(max(meeting_date), date '2000-01-01') as last_date, count(*) as n_docs from d""")
def period_totals(v: Views) -> DataFrame:
    plans = v.plan.withColumn("cents", F.round(F.col("size") * 100).cast("bigint"))
    return op.period_totals(v.doc.filter("downloaded_on >= date'1999-06-01'"), plans, "meeting_date", now(), "cents")


@query("select entity_id, count(*) as n, count(*) filter (where value > 50) as n_active, count(*) filter (where status = 'click') as n_done, count(distinct status) as n_platforms, bool_or(value > 90) as any_live from ev group by 1")
def recording_metrics(v: Views) -> DataFrame:
    counts = op.conditional_counts(v.ev, "entity_id", n_active=F.col("value") > 50, n_done=F.col("status") == "click")
    platforms = v.ev.groupBy("entity_id").agg(F.size(F.collect_set("status")).cast("bigint").alias("n_platforms"), F.bool_or(F.col("value") > 90).alias("any_live"))
    return counts.join(platforms, "entity_id")


@query("select count(*) as n, count(*) filter (where status = 'click') as confirmed, count(*) filter (where status = 'view') as pending from ev")
def subscriber_counts(v: Views) -> DataFrame:
    return op.conditional_counts(v.ev, confirmed=F.col("status") == "click", pending=F.col("status") == "view")


@query("select url, count(distinct plan_id) as n_docs, min(plan_id) as sample, doc_type from doc group by url, doc_type")
def url_mining_counts(v: Views) -> DataFrame:
    return op.url_mining_counts(v.doc, ["doc_type"], "url", "plan_id")


@query("""with r as (select cast(i as bigint) as run_id, timestamp '2024-01-01' + to_hours(cast(i * 24 as int)) as s, timestamp '2024-01-01' + to_hours(cast(i * 24 + 6 as int)) as e from range(0, 10) t(i))
select run_id, ev.id, count(ev.id) over (partition by run_id) as n, cast(21600 as bigint) as seconds from r left join ev on ts >= s and ts < e""")
def run_membership(v: Views) -> DataFrame:
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    runs = v.spark.range(10).select(F.col("id").alias("run_id"), (day + F.make_dt_interval(F.col("id").cast("int"))).alias("s"), (day + F.make_dt_interval(F.col("id").cast("int"), F.lit(6))).alias("e"))
    return op.run_membership(v.ev, runs, "run_id", "s", "e", "ts", "id")


@query("""with a as (select plan_id, case when length(trim(manager)) <= 2 then 'short' else trim(manager) end as name, coalesce(action, '') as action, meeting_date, doc_id, ord from act join doc on doc.id = act.doc_id where trim(manager) <> '' and trim(manager) <> 'N/A'),
f as (select plan_id, name, max((meeting_date, doc_id, ord, action)) filter (where meeting_date is not null) as last, max(meeting_date) as last_seen, count(*) as mentions, list_sort(list_distinct(list(doc_id)))[1:20] as docs from a group by 1, 2),
f1 as (select plan_id, name, case when last[4] = 'fire' then 'terminated' when last_seen >= date '2000-01-01' - 730 then 'current' else 'unknown' end as status, last_seen, mentions, docs, case when mentions >= 3 then 0.9 else 0.6 end as confidence from f),
r as (select plan_id, trim(manager) as name, case when ord % 2 = 0 then 'awarded' else 'incumbent' end as field, case when doc.status = 'failed' then 'withdrawn' end as state, doc_id from act join doc on doc.id = act.doc_id where doc_type = 'cafr' and trim(manager) <> '' and trim(manager) <> 'N/A'),
f2 as (select plan_id, name, case when bool_or(not (field = 'awarded' and coalesce(state, '') = 'withdrawn')) then 'current' else 'unknown' end as status, count(*) as mentions, max(case when field = 'awarded' then 0.8 else 0.5 end) as confidence, list_sort(list_distinct(list(doc_id)))[1:20] as docs from r group by 1, 2)
select coalesce(f1.plan_id, f2.plan_id) as plan_id, coalesce(f1.name, f2.name) as name, coalesce(f1.status, f2.status) as status, f1.last_seen, coalesce(f1.mentions, 0) + coalesce(f2.mentions, 0) as mentions,
cast(greatest(f1.confidence, f2.confidence) as double) as confidence, array_to_string(list_sort(list_distinct(list_concat(coalesce(f1.docs, []), coalesce(f2.docs, []))))[1:20], ' ') as docs from f1 full join f2 on f2.plan_id = f1.plan_id and f2.name = f1.name""")
def roster_reconcile(v: Views) -> DataFrame:
    from corpusloom.operators import roster

    docs = v.doc.select(F.col("id").alias("doc_id"), "plan_id", F.col("meeting_date").alias("date"), "doc_type", "status")
    actions = v.act.join(docs, "doc_id")
    mapping = v.act.select(F.trim("manager").alias("raw")).filter("length(raw) between 1 and 2").distinct().withColumn("canonical", F.lit("short"))
    field = F.when(F.col("ord") % 2 == 0, "awarded").otherwise("incumbent")
    records = actions.filter("doc_type = 'cafr'").select("plan_id", F.col("manager").alias("name"), field.alias("field"), F.when(F.col("status") == "failed", "withdrawn").alias("state"), "doc_id")
    made = roster.roster_reconcile(roster.from_actions(actions, mapping, now()), roster.from_records(records))
    return made.select("plan_id", "name", "status", "last_seen", "mentions", "confidence", F.array_join(F.col("doc_ids").cast("array<string>"), " ").alias("docs"))
