"""Queries for latest-per-group, running and representative rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.expressions import title_match
from corpusloom.operators import windows as op
from corpusloom.plans.registry import query
from corpusloom.plans.views import Views


def now():
    return F.lit("2000-01-01").cast("date")


@query("with r as (select plan_id, id, fiscal_year, row_number() over (partition by plan_id order by fiscal_year desc nulls last, id desc) as n from doc) select plan_id, id, fiscal_year from r where n = 1")
def latest_by_year(v: Views) -> DataFrame:
    return op.latest_by_year(v.doc.select("plan_id", "id", "fiscal_year"), "plan_id", "fiscal_year", "id")


@query("""with r as (select plan_id, id, fiscal_year, downloaded_on, row_number() over (partition by plan_id order by coalesce(fiscal_year, 0) desc, coalesce(downloaded_on, date '1900-01-01') desc, id) as n from doc)
select plan_id, id, fiscal_year, downloaded_on from r where n = 1""")
def latest_report(v: Views) -> DataFrame:
    return op.latest_report(v.doc.select("plan_id", "id", "fiscal_year", "downloaded_on"), "plan_id", "fiscal_year", "downloaded_on", "id")


@query("""with r as (select extract_id, seq, asset_class, actual_bp, row_number() over (partition by extract_id order by coalesce(seq = 2, false) desc, seq desc, asset_class desc, actual_bp desc nulls last) as n from alloc)
select extract_id, seq, asset_class, actual_bp from r where n = 1""")
def latest_preferred(v: Views) -> DataFrame:
    rows = v.alloc.select("extract_id", "seq", "asset_class", "actual_bp")
    tied = rows.withColumn("tie", F.struct("seq", "asset_class", F.coalesce("actual_bp", F.lit(-1))))
    return op.latest_preferred(tied.withColumn("label", F.col("seq").cast("string")), "extract_id", "label", "2", "tie").drop("tie", "label")


@query("""with r as (select d.plan_id, d.id, d.meeting_date, row_number() over (partition by d.plan_id order by d.meeting_date desc nulls last, d.id desc) as n
from doc d join summ s on s.document_id = d.id join txt t on t.id = s.text_id where length(trim(t.text)) > 0 and t.lang = 'en') select plan_id, id, meeting_date from r where n = 1""")
def latest_nonempty(v: Views) -> DataFrame:
    texts = v.txt.select(F.col("id").alias("text_id"), F.when(F.col("lang") == "en", F.col("text")).alias("text"))
    rows = v.doc.select("plan_id", "id", "meeting_date").join(v.summ.select(F.col("document_id").alias("id"), "text_id"), "id").join(texts, "text_id")
    return op.latest_nonempty(rows, "plan_id", "text", "meeting_date", "id").select("plan_id", "id", "meeting_date")


@query("""with t as (select *, case when doc_type = 'board_pack' then 'Board of Trustees' when doc_type = 'minutes' then 'Regular  Meeting' when id % 2 = 0 then 'Quick tip' end as title from doc),
r as (select plan_id, id, status, row_number() over (partition by plan_id order by coalesce(meeting_date, downloaded_on) desc nulls last, id desc) as n from t where title in ('Board of Trustees', 'Regular  Meeting'))
select plan_id, id, status from r where n = 1 and status in ('pending', 'failed') and id % 5 < 3""")
def latest_meeting_recording(v: Views) -> DataFrame:
    title = F.when(F.col("doc_type") == "board_pack", "Board of Trustees").when(F.col("doc_type") == "minutes", "Regular  Meeting").when(F.col("id") % 2 == 0, "Quick tip")
    rows = v.doc.withColumn("title", title).withColumn("attempts", F.col("id") % 5).filter(title_match("title"))
    needed = F.col("status").isin("pending", "failed") & (F.coalesce("attempts", F.lit(0)) < 3)
    return op.latest_then_open(rows, "plan_id", ["meeting_date", "downloaded_on"], "id", needed).select("plan_id", "id", "status")


@query("""select plan_id, meeting_date, coalesce(max(case when doc_type = 'agenda' then id end), min(case when doc_type in ('board_pack', 'minutes') then id end)) as representative from doc group by 1, 2""")
def representative_doc(v: Views) -> DataFrame:
    return op.representative_doc(v.doc, ["plan_id", "meeting_date"], "doc_type", "id", "agenda", ["board_pack", "minutes"])


@query("""select plan_id, meeting_date, count(*) as n_docs, count(s.id) as n_summaries, min(d.id) as first_doc from doc d left join summ s on s.document_id = d.id where doc_type not in ('cafr', 'performance') group by 1, 2 order by coalesce(meeting_date, date '1900-01-01') desc, plan_id desc""")
def meeting_assembly(v: Views) -> DataFrame:
    made = op.meeting_assembly(v.doc.filter("doc_type not in ('cafr', 'performance')"), v.summ, "plan_id", "meeting_date")
    return made.select("plan_id", "meeting_date", F.size("documents").cast("bigint").alias("n_docs"), F.col("n_summaries").cast("bigint").alias("n_summaries"), F.col("documents")[0]["id"].alias("first_doc"))


@query("""select plan_id, meeting_date, count(*) as n_docs, count(s.id) as n_summaries from doc d left join summ s on s.document_id = d.id where meeting_date between date '1999-01-01' and date '1999-03-31' group by 1, 2""")
def meeting_assembly_by_date(v: Views) -> DataFrame:
    made = op.meeting_assembly(v.doc.filter("meeting_date between date'1999-01-01' and date'1999-03-31'"), v.summ, "plan_id", "meeting_date")
    return made.select("plan_id", "meeting_date", F.size("documents").cast("bigint").alias("n_docs"), F.col("n_summaries").cast("bigint").alias("n_summaries"))


@query("""with r as (select plan_id, case when id % 4 = 0 then ' ' else url end as url, meeting_date, id from doc)
select plan_id, arg_max(url, (coalesce(meeting_date, date '1900-01-01'), id)) filter (where trim(url) <> '') as headline, count(distinct meeting_date) as n_meetings from r group by 1""")
def headline_per_entity(v: Views) -> DataFrame:
    rows = v.doc.select("plan_id", F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("url")).alias("url"), "meeting_date", "id")
    return op.headline_per_entity(rows, "plan_id", "url", "meeting_date", "id")


@query("""with a as (select distinct plan_id, manager, coalesce(action, '') as action, meeting_date, doc_id, ord from act join doc on doc.id = act.doc_id where manager is not null),
g as (select plan_id, manager, arg_max(action, (meeting_date, doc_id, ord, action)) filter (where meeting_date is not null) as last_action, max(meeting_date) as last_seen from a group by 1, 2)
select *, case when last_action = 'fire' then 'terminated' when last_seen >= date '2000-01-01' - 730 then 'current' else 'unknown' end as status from g""")
def last_action_status(v: Views) -> DataFrame:
    rows = v.act.filter("manager is not null").join(v.doc.select(F.col("id").alias("doc_id"), "plan_id", "meeting_date"), "doc_id").withColumn("action", F.coalesce("action", F.lit("")))
    return op.last_action_status(rows, ["plan_id", "manager"], "action", ["meeting_date", "doc_id", "ord", "action"], "fire", now(), 730)


@query("""with b as (select * from doc where downloaded_on >= date '2000-06-01'), t as (select min(downloaded_on) as t0 from b),
p as (select plan_id, max(downloaded_on) as previous from doc, t where downloaded_on < t0 and plan_id in (select plan_id from b) group by 1) select plan_id, previous from p, t where t0 - previous > 30""")
def prior_gap(v: Views) -> DataFrame:
    return op.prior_gap(v.doc.filter("downloaded_on >= date'2000-06-01'"), v.doc, "plan_id", "downloaded_on", 30)


@query("""select entity_id, id, row_number() over (partition by entity_id order by ts desc, id desc) <= 8 or row_number() over (partition by entity_id, date_trunc('month', ts) order by ts, id) = 1 as keep from ev""")
def retention_keep(v: Views) -> DataFrame:
    return op.retention_keep(v.ev, "entity_id", "ts", "id", 8).select("entity_id", "id", "keep")


@query("with r as (select id, n_chars, sum(n_chars) over (order by n_chars desc, id) as running from txt) select id, n_chars, cast(running as bigint) as running from r where running <= 1000000")
def running_budget(v: Views) -> DataFrame:
    return op.running_budget(v.txt.select("id", "n_chars"), "n_chars", [F.col("n_chars").desc(), F.col("id").asc()], 1_000_000)


@query("""with b as (select plan_id, url, fiscal_year as year, case when id % 3 = 0 then 0 when id % 3 = 1 then 1 else 2 end as priority from doc),
f as (select *, row_number() over (partition by plan_id, url order by priority, coalesce(year, 0) desc) as k from b)
select plan_id, url, year, priority, row_number() over (partition by plan_id order by priority, coalesce(year, 0) desc, url) as rank from f where k = 1""")
def rank_sources(v: Views) -> DataFrame:
    rows = v.doc.withColumn("year", F.col("fiscal_year"))
    ranked = op.rank_sources(*((rows.filter(f"id % 3 = {i}"), i) for i in range(3)), key="plan_id", url="url", order=[F.coalesce("year", F.lit(0)).desc(), F.col("url").asc()])
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


@query("with e as (select max(ts) as t from ev), r as (select ev.* from ev, e where ts >= t - interval 1 hour) select id, min(ts) over () as started, max(ts) over () as ended, count(*) over () as n from r")
def trailing_batch(v: Views) -> DataFrame:
    return op.trailing_batch(v.ev, "ts", "id", 3600)
