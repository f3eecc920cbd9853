"""Queries for sorts, limits, top-k and set operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import ordering as op
from corpusloom.plans.registry import query
from corpusloom.plans.views import Views


@query("select id, plan_id, meeting_date from doc order by meeting_date desc nulls last, id desc limit 50")
def topk_nulls_last(v: Views) -> DataFrame:
    return op.topk_nulls_last(v.doc.select("id", "plan_id", "meeting_date"), "meeting_date", "id", 50)


@query("select id, meeting_date, downloaded_on from doc order by meeting_date desc nulls last, downloaded_on desc nulls last, id desc")
def multi_nulls_last(v: Views) -> DataFrame:
    return op.multi_nulls_last(v.doc.select("id", "meeting_date", "downloaded_on"), "meeting_date", "downloaded_on", "id")


@query("select id, entity_id, ts from ev order by ts desc, id desc limit 25")
def recent_runs(v: Views) -> DataFrame:
    return op.topk_nulls_last(v.ev.select("id", "entity_id", "ts"), "ts", "id", 25)


@query("select id, downloaded_on from doc where downloaded_on in (select distinct downloaded_on from doc order by 1 desc nulls last limit 12)")
def distinct_topk(v: Views) -> DataFrame:
    return op.distinct_topk(v.doc.select("id", "downloaded_on"), "downloaded_on", 12)


@query("select * from (select d.id, p.name, d.meeting_date from doc d join plan p on p.id = d.plan_id order by meeting_date desc nulls last, d.id desc limit 30) t order by lower(name), id")
def resort_limited(v: Views) -> DataFrame:
    rows = v.doc.join(v.plan.select(F.col("id").alias("plan_id"), "name"), "plan_id").select("id", "name", "meeting_date")
    return op.resort_limited(rows, [F.col("meeting_date").desc_nulls_last(), F.col("id").desc()], 30, [F.lower("name"), F.col("id")])


@query("select id, name, concat(name, ' ($', cast(cast(floor(coalesce(size, 0)) as bigint) as varchar), ')') as label from plan order by coalesce(size, 0) desc, name")
def size_order(v: Views) -> DataFrame:
    return op.size_order(v.plan.select("id", "name", "size"), "size", "name").select("id", "name", "label")


@query("select id, meeting_date, (select count(*) from doc where doc_type = 'minutes') as total from doc where doc_type = 'minutes' order by meeting_date desc nulls last, id desc limit 20")
def paged_results(v: Views) -> DataFrame:
    return op.paged_results(v.doc.filter("doc_type = 'minutes'").select("id", "meeting_date"), [F.col("meeting_date").desc_nulls_last(), F.col("id").desc()], 20)


@query("select * from (select id, downloaded_on, status from doc where status in ('done', 'pending') and downloaded_on between date '1998-01-01' and date '1998-12-31' order by downloaded_on desc, id desc limit 12) t order by downloaded_on, id")
def last_k_period_asc(v: Views) -> DataFrame:
    within = F.col("status").isin("done", "pending") & F.col("downloaded_on").between("1998-01-01", "1998-12-31")
    return op.last_k_ascending(v.doc.select("id", "downloaded_on", "status"), within, "downloaded_on", "id", 12)


@query("""with l as (select asset_class as label from act union all select manager from act union all select segment from plan union all select props from ev union all select concat(' ', asset_class, ' ') from alloc)
select distinct trim(label) as label from l where trim(label) <> ''""")
def label_union(v: Views) -> DataFrame:
    inner = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return op.label_union((v.act, F.col("asset_class")), (v.act, F.col("manager")), (v.plan, F.col("segment")), (v.ev, inner), (v.alloc, F.concat(F.lit(" "), "asset_class", F.lit(" "))))


@query("select distinct manager as label from act where manager is not null and manager not in (select concat('S', cast(id as varchar)) from plan where id < 40) order by 1 limit 20")
def new_labels(v: Views) -> DataFrame:
    mapping = v.plan.filter("id < 40").select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("raw"))
    return op.new_labels(v.act.select(F.col("manager").alias("label")).filter("label is not null"), "label", mapping, "raw", 20)


@query("""select id, 'left' as side from (select id from doc where id % 5 <> 0 except select id from doc where id % 7 <> 0) a union all
select id, 'right' from (select id from doc where id % 7 <> 0 except select id from doc where id % 5 <> 0) b""")
def key_symmetric_diff(v: Views) -> DataFrame:
    return op.key_symmetric_diff(v.doc.filter("id % 5 <> 0"), v.doc.filter("id % 7 <> 0"), "id")


@query("""select 'doc' as table_name, (select count(*) from doc) as n_left, (select count(*) from doc where id % 9 <> 0) as n_right, false as same
union all select 'plan', (select count(*) from plan), (select count(*) from plan), true union all select 'summ', (select count(*) from summ), null, false""")
def table_counts_compare(v: Views) -> DataFrame:
    return op.table_counts_compare({"doc": v.doc, "plan": v.plan, "summ": v.summ}, {"doc": v.doc.filter("id % 9 <> 0"), "plan": v.plan})


@query("with r as (select url, id, row_number() over (partition by url order by id) as n from doc) select url, id from r where n = 1")
def distinct_first(v: Views) -> DataFrame:
    from corpusloom.operators.joins import latest_per_group

    return latest_per_group(v.doc.select("url", "id"), ["url"], [F.col("id").asc()])
