"""Queries for incremental operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import incremental as op
from corpusloom.plans.registry import query
from corpusloom.sources.stored import StoredTable, prune
from corpusloom.sources.tables import shared_folder
from corpusloom.plans.views import Views


def stamp():
    return F.lit("2024-01-25").cast("timestamp_ntz")


def mark():
    return F.lit("2024-01-23").cast("timestamp_ntz")


@query("select id, entity_id, ts from ev where ts > timestamp '2024-01-23' and ts < timestamp '2024-01-25'")
def new_since(v: Views) -> DataFrame:
    return op.new_since(v.ev.select("id", "entity_id", "ts"), "ts", mark(), stamp())


@query("""with b as (select * from ev where ts > timestamp '2024-01-24' and ts < timestamp '2024-01-25'), t as (select min(ts) as t0 from b),
l as (select entity_id, max(ts) as last from ev, t where ts < t0 and entity_id in (select entity_id from b) group by 1)
select count(*) as n, count(*) > 10 as high_volume, min(case when status in ('purchase', 'error') then id end) as first_hit, (select count(*) from l where last < timestamp '2024-01-25' - interval 3 day) as n_reappear from b""")
def batch_triggers(v: Views) -> DataFrame:
    return op.batch_triggers(op.new_since(v.ev, "ts", None, stamp()), "status", ["Purchase", "error"], 10, v.ev, now=stamp(), days=3)


@query("select plan_id, count(*) as n, string_agg(concat(coalesce(doc_type, 'document'), ' ', url), chr(10) order by downloaded_on, id) as body from doc where downloaded_on >= date '2001-06-01' group by 1 union all select null, 0, 'No new documents.' from (select count(*) as n from doc where downloaded_on >= date '2101-01-01') q where n = 0")
def digest_rows(v: Views) -> DataFrame:
    line = F.concat_ws(" ", F.coalesce("doc_type", F.lit("document")), "url")
    made = [op.digest_rows(v.doc.filter(f"downloaded_on >= date'{day}'"), "plan_id", line, ["downloaded_on", "id"]) for day in ("2001-06-01", "2101-01-01")]
    return made[0].unionByName(made[1])


@query("""with c as (select *, row_number() over (partition by plan_id order by id, url) as n from doc)
select plan_id, id, url from c where n <= 5 and url not in (select url from doc where id % 10 = 0) and url not in (select url from doc where id % 9 = 0)""")
def ingest_dedupe(v: Views) -> DataFrame:
    return op.ingest_dedupe(v.doc.select("plan_id", "id", "url"), "plan_id", "url", "id", v.doc.filter("id % 10 = 0"), v.doc.filter("id % 9 = 0"), 5)


@query("""with t as (select id, source, md5(text) as digest from txt), s as (select distinct source, digest from t where id % 4 = 0), n as (select * from t where id % 4 <> 0)
select id, case when (source, digest) not in (select source, digest from s) and row_number() over (partition by source, digest order by id) = 1 then 'new' else 'already_have' end as outcome from n""")
def content_version(v: Views) -> DataFrame:
    rows = v.txt.select("id", "source", F.md5("text").alias("digest"))
    return op.content_version(rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0"), ["source", "digest"], [F.col("id")]).select("id", "outcome")


@query("select id, case when id % 3 = 0 then 'insert' when id % 5 = 0 or id % 7 = 0 then 'replace' else 'skip' end as outcome from txt")
def reextract_gate(v: Views) -> DataFrame:
    now = v.txt.select("id", F.md5("text").alias("digest"), F.lit(2).alias("version"))
    stored = now.filter("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("digest")).alias("digest"), F.when(F.col("id") % 7 == 0, 1).otherwise(2).alias("version"))
    return op.reextract_gate(now, stored, "id").select("id", "outcome")


@query("select extract_id, seq, asset_class, actual_bp from alloc where extract_id % 6 <> 0 union all select distinct extract_id, 99, 'NEW', 0 from alloc where extract_id % 6 = 0")
def replace_children(v: Views) -> DataFrame:
    rows = v.alloc.select("extract_id", "seq", "asset_class", "actual_bp")
    fresh = rows.filter("extract_id % 6 = 0").select("extract_id").distinct().select("extract_id", F.lit(99).alias("seq"), F.lit("NEW").alias("asset_class"), F.lit(0).alias("actual_bp"))
    return op.replace_children(rows, fresh, "extract_id")


@query("""with o as (select entity_id, status, id % 3 as grade, row_number() over (partition by entity_id order by ts desc, id desc) as n from ev where ts < timestamp '2024-01-15'),
i as (select entity_id, status, id % 3 as grade, row_number() over (partition by entity_id order by ts desc, id desc) as n from ev)
select i.entity_id, i.status, i.grade, concat(case when i.status is distinct from o.status then 'status' else '' end, case when i.grade is distinct from o.grade then 'grade' else '' end) as changed
from i left join (select * from o where n = 1) o on o.entity_id = i.entity_id where i.n = 1 and (o.entity_id is null or i.status <> o.status or i.grade <> o.grade)""")
def snapshot_on_change(v: Views) -> DataFrame:
    from corpusloom.operators.joins import latest_per_group

    order = [F.col("ts").desc(), F.col("id").desc()]
    rows = v.ev.withColumn("grade", F.col("id") % 3)
    now = latest_per_group(rows, ["entity_id"], order).select("entity_id", "status", "grade")
    out = op.snapshot_on_change(rows.filter("ts < timestamp_ntz'2024-01-15'"), now, "entity_id", ["status", "grade"], order)
    return out.withColumn("changed", F.array_join("changed", ""))


_BOTH = """with s as (select id, status, case when id % 4 = 0 then null else amount end as amount from doc where id % 5 <> 0),
i as (select id, case when id % 6 = 0 then 'done' else status end as status, case when id % 3 = 0 then null else amount end as amount from doc where id % 7 <> 0),"""


def _both(v: Views) -> tuple[DataFrame, DataFrame]:
    stored = v.doc.filter("id % 5 <> 0").select("id", "status", F.when(F.col("id") % 4 != 0, F.col("amount")).alias("amount"))
    incoming = v.doc.filter("id % 7 <> 0").select("id", F.when(F.col("id") % 6 == 0, "done").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 3 != 0, F.col("amount")).alias("amount"))
    return stored, incoming


@query(_BOTH + """ m as (select coalesce(s.id, i.id) as id, coalesce(i.status, s.status) as status, coalesce(i.amount, s.amount) as amount, s.id as a, i.id as b, s.status as os, s.amount as oa from s full join i on i.id = s.id)
select id, status, amount, case when a is null then 'I' when b is null or (status is not distinct from os and amount is not distinct from oa) then '=' else 'U' end as op from m""")
def upsert_update(v: Views) -> DataFrame:
    return op.upsert(*_both(v), "id", ["status", "amount"])


@query("select id, plan_id, 'old' as origin from doc where id % 5 <> 0 union all select id, plan_id, 'new' from doc where id % 5 = 0")
def upsert_insert_only(v: Views) -> DataFrame:
    rows = v.doc.select("id", "plan_id")
    return op.upsert_insert_only(rows.filter("id % 5 <> 0").withColumn("origin", F.lit("old")), rows.withColumn("origin", F.lit("new")), "id")


@query(_BOTH + """ k as (select i.status in ('done') and s.status in ('pending', 'failed') or i.status = 'pending' and s.status = 'failed' as better, s.id as a, i.id as b, s.status as os, s.amount as oa, i.status as ns, i.amount as na from s full join i on i.id = s.id),
m as (select coalesce(a, b) as id, case when a % 11 = 0 then os when better then ns else coalesce(os, ns) end as status, case when a % 11 = 0 then oa else coalesce(oa, na) end as amount, a, b, os, oa from k)
select id, status, amount, case when a is null then 'I' when b is null or (status is not distinct from os and amount is not distinct from oa) then '=' else 'U' end as op from m""")
def upsert_fill_null(v: Views) -> DataFrame:
    return op.upsert(*_both(v), "id", ["status", "amount"], fill_only=True, protected=F.col("id") % 11 == 0, ranked=("status", ["done", "pending", "failed"]))


@query(_BOTH + """ m as (select coalesce(s.id, i.id) as id, case when s.id is null then 'I' when i.id is null then 'D' when s.status is not distinct from i.status and s.amount is not distinct from i.amount then '=' else 'U' end as op from s full join i on i.id = s.id) select * from m""")
def upsert_changed_only(v: Views) -> DataFrame:
    return op.upsert_changed_only(*_both(v), "id", ["status", "amount"])


@query("select id, 'old' as reason from doc where id % 4 = 0 and id % 6 <> 0 union all select id, 'short' from doc where id % 6 = 0 and id % 12 <> 0")
def detail_sync(v: Views) -> DataFrame:
    details = v.doc.filter("id % 4 = 0").select("id", F.lit("old").alias("reason"))
    passes = v.doc.filter("id % 6 = 0").select("id", F.when(F.col("id") % 12 != 0, "short").alias("reason"))
    return op.detail_sync(details, passes, "id")


_OLD = "coalesce(coalesce(meeting_date, downloaded_on) < date '1996-01-01', false)"


@query(f"""select 'docs' as table_name, count(*) as n from doc where not {_OLD} union all select 'children', count(*) from summ where document_id not in (select id from doc where {_OLD})
union all select 'tombstones', count(*) from (select url from doc where id % 1000 = 0 and id < 9000 union select url from doc where {_OLD}) t""")
def prune_with_tombstone(v: Views) -> DataFrame:
    old = F.coalesce("meeting_date", "downloaded_on") < F.lit("1996-01-01").cast("date")
    tombs = v.doc.filter("id % 1000 = 0 and id < 9000").select("url").distinct()
    parts = op.prune_with_tombstone(v.doc, v.summ, tombs, "id", "document_id", "url", old)
    counts = [p.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, p in zip(("docs", "children", "tombstones"), parts, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""select id, case when text_id in (select id from txt where id % 30 <> 0) then text_id end as text_id, 'null' as policy from summ
union all select id, text_id, 'delete' from summ where text_id is null or text_id in (select id from txt where id % 30 <> 0)""")
def orphan_repair(v: Views) -> DataFrame:
    rows, parents = v.summ.select("id", "text_id"), v.txt.filter("id % 30 <> 0")
    out = [op.orphan_repair(rows, "text_id", parents, "id", p).withColumn("policy", F.lit(p)) for p in ("null", "delete")]
    return out[0].unionByName(out[1])


@query("""with r as (select id, status, case when id % 3 = 0 then 'done' when id % 3 = 1 then 'pending' else 'failed' end as wanted from doc),
a as (select *, (status = 'pending' and wanted in ('done', 'failed')) or (status = 'failed' and wanted = 'pending') as accepted from r) select id, case when accepted then wanted else status end as status, accepted from a""")
def status_transition(v: Views) -> DataFrame:
    wanted = F.when(F.col("id") % 3 == 0, "done").when(F.col("id") % 3 == 1, "pending").otherwise("failed")
    return op.status_transition(v.doc, v.doc.select("id", wanted.alias("wanted")), "id", {"pending": ["done", "failed"], "failed": ["pending"]})


@query("""with w as (select distinct cast(date_trunc('week', downloaded_on) as date) as period from doc) select 'weekly' as cadence, period, case when day(period) <= 15 then 'kept' end as note, day(period) > 15 as created from w""")
def find_or_create(v: Views) -> DataFrame:
    wanted = v.doc.select(F.lit("weekly").alias("cadence"), F.trunc("downloaded_on", "week").alias("period"))
    return op.find_or_create(wanted.distinct().filter("day(period) <= 15").withColumn("note", F.lit("kept")), wanted, ["cadence", "period"])


@query("""with l as (select id % 3 as run_id, plan_id, min(id) as d from doc where id % 4 = 0 group by 1, 2),
a as (select r.i as run_id, p.id as plan_id, case when l.plan_id is null then 'pending' when d % 5 = 0 then 'failed' when d % 7 = 0 then 'fetching' else 'succeeded' end as status from plan p cross join (select cast(i as bigint) as i from range(0, 3) t(i)) r left join l on l.run_id = r.i and l.plan_id = p.id)
select *, status in ('pending', 'fetching') as resume, count(*) over (partition by run_id) as total, count(*) filter (where status = 'succeeded') over (partition by run_id) as completed, count(*) filter (where status in ('pending', 'fetching')) over (partition by run_id) as open from a""")
def run_ledger(v: Views) -> DataFrame:
    rows = v.doc.filter("id % 4 = 0").groupBy((F.col("id") % 3).alias("run_id"), "plan_id").agg(F.min("id").alias("d"))
    ledger = rows.withColumn("status", F.when(F.col("d") % 5 == 0, "failed").when(F.col("d") % 7 == 0, "fetching").otherwise("succeeded"))
    runs = v.doc.select((F.col("id") % 3).alias("run_id")).distinct()
    filled = op.run_ledger(runs, v.plan.select(F.col("id").alias("plan_id")), ledger, "run_id", "plan_id")
    return filled.join(op.run_progress(filled, "run_id"), "run_id")


@query("""with w as (select id from ev where id % 3 <> 0 and value >= 40), f as (select ev.id from ev join w on w.id = ev.id order by ts, ev.id limit 15)
select id, 'first' as run, id in (select id from f) as alerted, id not in (select id from w) or id in (select id from f) as sent from ev
union all select id, 'few', false, id not in (select id from w) from ev union all select id, 'baseline', id in (select id from w), true from ev""")
def pending_alerts(v: Views) -> DataFrame:
    rows = v.ev.select("id", "ts", ((F.col("id") % 3 == 0) | (F.col("value") < 40) | F.col("value").isNull()).alias("sent"))
    order, out = [F.col("ts"), F.col("id")], None
    for run, alerts in (("first", op.pending_alerts(rows, "sent", order, 15)), ("few", op.pending_alerts(rows, "sent", order, 15, min_count=1_000_000_000)), ("baseline", None)):
        made = op.mark_sent(rows, "sent", "id", alerts, stamp()).select("id", F.lit(run).alias("run"), F.col("sent_at").isNotNull().alias("alerted"), "sent")
        out = made if out is None else out.unionByName(made)
    return out


@query("""with a as (select entity_id, id, status, row_number() over (partition by entity_id order by id) as attempt, coalesce(sum(case when status in ('purchase', 'error') then 1 end) over (partition by entity_id order by id rows between unbounded preceding and 1 preceding), 0) as ended from ev),
m as (select * from a where ended = 0) select entity_id, id, status, cast(attempt as bigint) as attempt, attempt = max(attempt) over (partition by entity_id) as final from m""")
def outcome_ladder(v: Views) -> DataFrame:
    attempts, stops = v.ev.select("entity_id", "id", "status"), F.col("status").isin("purchase", "error")
    last = op.outcome_ladder(attempts, "entity_id", "id", stops).select("entity_id", F.col("attempt").alias("_last"))
    log = op.outcome_log(attempts, "entity_id", "id", stops).join(last, "entity_id")
    return log.select("entity_id", "id", "status", F.col("attempt").cast("bigint").alias("attempt"), (F.col("attempt") == F.col("_last")).alias("final"))


@query("""select id, case when segment = 'MACHINERY' and id % 2 = 0 and id % 3 = 0 then 'noisy; was ok' else 'was ok' end as notes, id % 3 = 0 and not (segment = 'MACHINERY' and id % 2 = 0) as active from plan""")
def deactivate_noise(v: Views) -> DataFrame:
    rows = v.plan.select("id", "segment", F.lit("was ok").alias("notes"), (F.col("id") % 3 == 0).alias("active"))
    return op.deactivate(rows, (F.col("segment") == "MACHINERY") & (F.col("id") % 2 == 0), "noisy").select("id", "notes", "active")


@query("""with w as (select date_trunc('week', downloaded_on)::date as start, count(*) as docs from doc group by 1), k as (select *, date_trunc('month', start)::date as period from w where docs % 5 <> 0 and date_trunc('month', start) = date_trunc('month', start + 6)),
f as (select *, row_number() over (partition by period order by start desc) as n from k),
m as (select period, string_agg(strftime(start, '%Y%m%d'), ' ' order by start) as sources, count(*) as n, string_agg(concat('=== ', strftime(start, '%B %-d, %Y'), ' ===', chr(10), cast(docs as varchar), ' documents'), chr(10) || chr(10) order by start) as block from f where n <= 4 group by 1),
q as (select date_trunc('quarter', period)::date as q, string_agg(strftime(period, '%Y%m%d'), ' ' order by period) as sources, count(*) as n, string_agg(concat('=== ', strftime(period, '%B %-d, %Y'), ' ===', chr(10), block), chr(10) || chr(10) order by period) as block from m group by 1)
select 'month' as cadence, period, sources, n, block from m union all select 'quarter', q, sources, n, block from q""")
def cascade_rollup(v: Views) -> DataFrame:
    weeks = v.doc.groupBy(F.trunc("downloaded_on", "week").alias("start")).agg(F.count("*").alias("docs"))
    weeks = weeks.select(F.date_format("start", "yyyyMMdd").alias("key"), "start", F.date_add("start", 6).alias("end"), F.when(F.col("docs") % 5 == 0, "draft").otherwise("approved").alias("status"), F.concat(F.col("docs").cast("string"), F.lit(" documents ")).alias("text"))
    approved = F.col("status").isin("approved", "published")
    months = op.cascade_rollup(weeks, F.trunc("start", "month"), approved & (F.trunc("start", "month") == F.trunc("end", "month")), 4)
    parts = months.select(F.date_format("period", "yyyyMMdd").alias("key"), F.col("period").alias("start"), F.lit("approved").alias("status"), F.col("block").alias("text"))
    quarters = op.cascade_rollup(parts, F.trunc("start", "quarter"), approved)
    named = [x.select(F.lit(c).alias("cadence"), "period", F.array_join("sources", " ").alias("sources"), "n", "block") for c, x in (("month", months), ("quarter", quarters))]
    return named[0].unionByName(named[1])


@query(_BOTH + """ m as (select coalesce(s.id, i.id) as id, coalesce(i.status, s.status) as status, coalesce(i.amount, s.amount) as amount from s full join (select * from i where id % 9 = 0) i on i.id = s.id) select * from m""")
def upsert_partitions(v: Views) -> DataFrame:
    stored, incoming = _both(v)
    table = StoredTable(v.spark, shared_folder(v.spark), "id", 16).create(stored)
    table.upsert(incoming.filter("id % 9 = 0"), ["status", "amount"])
    return table.read()


@query("""select 'doc' as kind, cast(id as varchar) as key, 1 as n from doc where downloaded_on >= date '1998-01-01' union all
select 'summ', cast(document_id as varchar), count(*) from summ where document_id in (select id from doc where downloaded_on >= date '1998-01-01') group by 2 union all
select 'stone', url, 1 from (select url from doc where downloaded_on < date '1998-01-01' union select 'https://h/1.pdf')""")
def prune_partitions(v: Views) -> DataFrame:
    docs = StoredTable(v.spark, shared_folder(v.spark), "id", 16).create(v.doc.select("id", "url", "downloaded_on"))
    children = StoredTable(v.spark, shared_folder(v.spark), "document_id", 16).create(v.summ.select("document_id", "id"))
    stones = StoredTable(v.spark, shared_folder(v.spark), "url", 16).create(v.spark.createDataFrame([("https://h/1.pdf",)], "url string"))
    prune(docs, children, stones, F.col("downloaded_on") < F.lit("1998-01-01").cast("date"))
    one = F.lit(1).cast("bigint").alias("n")
    kept = docs.read().select(F.lit("doc").alias("kind"), F.col("id").cast("string").alias("key"), one)
    held = children.read().groupBy("document_id").agg(F.count("*").alias("n")).select(F.lit("summ").alias("kind"), F.col("document_id").cast("string").alias("key"), "n")
    return kept.unionByName(held).unionByName(stones.read().select(F.lit("stone").alias("kind"), F.col("url").alias("key"), one))
