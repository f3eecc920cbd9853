"""Queries for filters and predicates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import filters as op
from corpusloom.plans.registry import query
from corpusloom.plans.views import Views


def now():
    return F.lit("2000-01-01").cast("date")


def stamp():
    return F.lit("2024-01-25").cast("timestamp_ntz")


@query("""select d.id, d.plan_id, d.doc_type, d.meeting_date, s.id as summary_id from doc d join summ s on s.document_id = d.id
where doc_type not in ('cafr', 'performance') and (meeting_date is null or meeting_date <= date '2000-01-01' + 60)""")
def feed_filter(v: Views) -> DataFrame:
    rows = v.doc.alias("d").join(v.summ.alias("s"), F.col("s.document_id") == F.col("d.id")).select("d.id", "plan_id", "doc_type", "meeting_date", F.col("s.id").alias("summary_id"))
    return op.feed_filter(rows, ["cafr", "performance"], now(), 60)


@query("select id, plan_id, downloaded_on from doc where downloaded_on >= date '2000-01-01' - 30")
def lookback_filter(v: Views) -> DataFrame:
    return op.lookback_filter(v.doc.select("id", "plan_id", "downloaded_on"), now(), 30, "downloaded_on")


@query("""select t.id, l.quality, cast(least(n_chars, 2000) as double) / 2000 as confidence, cast(least(n_chars, 2000) as double) / 2000 < 0.7 as needs_review
from txt t join lab l on l.doc_id = t.id""")
def review_threshold(v: Views) -> DataFrame:
    rows = v.txt.join(v.lab, F.col("doc_id") == F.col("id")).select("id", "quality", (F.least("n_chars", F.lit(2000)).cast("double") / 2000).alias("confidence"))
    return op.review_threshold(rows, "confidence", 0.7)


@query("""select extract_id, seq, asset_class, target_bp, actual_bp from alloc where (lower(asset_class) like '%brass%' or lower(asset_class) like 'promo%')
and lower(asset_class) not like '%plated%' and target_bp is not null and actual_bp is not null""")
def pattern_filter(v: Views) -> DataFrame:
    return op.pattern_filter(v.alloc, "asset_class", ["%brass%", "promo%"], ["%plated%"], ["target_bp", "actual_bp"]).select("extract_id", "seq", "asset_class", "target_bp", "actual_bp")


@query("""with p as (select id, meeting_date, case when id % 13 = 0 then null when id % 7 = 0 then '[]' else concat('[{"n":', cast(id as varchar), '}]') end as payload from doc)
select id, meeting_date, payload from p where payload is not null and payload <> '[]' and meeting_date >= date '1999-01-01' order by meeting_date desc, id desc""")
def nonempty_json(v: Views) -> DataFrame:
    payload = F.when(F.col("id") % 13 == 0, None).when(F.col("id") % 7 == 0, "[]").otherwise(F.concat(F.lit('[{"n":'), F.col("id").cast("string"), F.lit("}]")))
    return op.nonempty_json(v.doc.select("id", "meeting_date", payload.alias("payload")), "payload", "meeting_date", F.lit("1999-01-01").cast("date"))


@query("""select doc_id, ord, manager, action, case when action in ('hire', 'fire', 'commitment') then 'deployment' else 'policy' end as stream,
try_cast(case when doc_id % 5 = 0 then 'n/a' else cast(amount_cents as varchar) end as bigint) as cents from act""")
def action_split(v: Views) -> DataFrame:
    raw = F.when(F.col("doc_id") % 5 == 0, "n/a").otherwise(F.col("amount_cents").cast("string"))
    rows = v.act.withColumn("cents", raw.try_cast("bigint"))
    return op.action_split(rows, "action", ["hire", "fire", "commitment"]).select("doc_id", "ord", "manager", "action", "stream", "cents")


@query("select doc_id, ord, action, amount_cents from act where amount_cents >= 5000000 and action in ('hire', 'commitment')")
def deployment_filter(v: Views) -> DataFrame:
    return op.deployment_filter(v.act, "amount_cents", 5_000_000, "action", ["hire", "commitment"]).select("doc_id", "ord", "action", "amount_cents")


@query("select doc_id, ord, action from act where action is not null and trim(action) <> '' and action <> 'other'")
def policy_filter(v: Views) -> DataFrame:
    return op.policy_filter(v.act, "action").select("doc_id", "ord", "action")


@query("""with g as (select lower(manager) as name, count(*) as mentions, list_sort(list(distinct manager)) as variants from act where manager is not null group by 1)
select name, cast(mentions as bigint) as mentions from g where mentions >= 20 and (contains(name, 's1') or len(list_filter(variants, lambda x: contains(lower(x), 's1'))) > 0)""")
def any_variant_filter(v: Views) -> DataFrame:
    groups = v.act.filter("manager is not null").groupBy(F.lower("manager").alias("name")).agg(F.count("*").alias("mentions"), F.sort_array(F.collect_set("manager")).alias("variants"))
    return op.any_variant_filter(groups, "name", "variants", "mentions", "S1", 20).select("name", "mentions")


@query("""select doc_id, cast(count(*) as bigint) as n_kept from act where coalesce(action not in ('other', 'fire'), true) group by 1""")
def basis_filter(v: Views) -> DataFrame:
    items = v.act.groupBy("doc_id").agg(F.collect_list(F.struct("ord", "action")).alias("items"))
    return op.basis_filter(items, "items", "action", ["other", "fire"]).select("doc_id", F.size("items").cast("bigint").alias("n_kept")).filter("n_kept > 0")


@query("select id, plan_id, case when status = 'failed' then 'pending' else status end as status from doc where status in ('pending', 'failed')")
def status_worklist(v: Views) -> DataFrame:
    return op.status_worklist(op.reset_failed(v.doc.select("id", "plan_id", "status")))


@query("select id, entity_id from ev where status = 'purchase' and value > 50")
def recipients(v: Views) -> DataFrame:
    return op.recipients(v.ev.withColumn("wants_daily", F.col("value") > 50), "status", "purchase", "wants_daily").select("id", "entity_id")


@query("""with k as (select distinct lower(trim(cast(entity_id as varchar))) as email from ev),
r as (select lower(trim(cast(entity_id as varchar))) as email, count(*) as n from ev where ts > timestamp '2024-01-24' and ts <= timestamp '2024-01-25' group by 1)
select k.email, cast(coalesce(n, 0) as bigint) as recent, coalesce(n, 0) < 3 as allowed from k left join r on r.email = k.email""")
def signup_throttle(v: Views) -> DataFrame:
    rows = v.ev.select(F.col("entity_id").cast("string").alias("email"), "ts")
    return op.signup_throttle(rows, rows, "email", "ts", stamp(), 86_400, 3)


@query("select id, name, segment from plan where segment = 'BUILDING' order by name, id")
def entity_list(v: Views) -> DataFrame:
    return op.entity_list(v.plan, "name", "id", key="segment", value="BUILDING").select("id", "name", "segment")


@query("select id, status, meeting_date from doc where status in ('done', 'pending') and doc_type = 'agenda' order by meeting_date desc nulls last, id desc")
def publications_by_status(v: Views) -> DataFrame:
    return op.publications_by_status(v.doc.filter("doc_type = 'agenda'"), "status", ["done", "pending"], "meeting_date").select("id", "status", "meeting_date")


@query("select id, plan_id, meeting_date from doc where meeting_date is null or meeting_date >= date '2000-01-01'")
def min_date_gate(v: Views) -> DataFrame:
    return op.min_date_gate(v.doc.select("id", "plan_id", "meeting_date"), "meeting_date", now())
