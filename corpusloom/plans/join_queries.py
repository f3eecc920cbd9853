"""Queries for joins and look-ups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import claims
from corpusloom.operators import joins as op
from corpusloom.plans.registry import query
from corpusloom.plans.views import Views


def now():
    return F.lit("2000-01-01").cast("date")


@query("select d.id, d.plan_id, s.id as summary_id from doc d join summ s on s.document_id = d.id")
def join_inner(v: Views) -> DataFrame:
    return op.join_inner(v.doc.alias("d"), v.summ.alias("s"), F.col("s.document_id") == F.col("d.id")).select("d.id", "plan_id", F.col("s.id").alias("summary_id"))


@query("select p.id as plan_id, d.id as doc_id, s.id as summary_id from plan p left join doc d on d.plan_id = p.id left join summ s on s.document_id = d.id")
def join_left_chain(v: Views) -> DataFrame:
    rows = op.join_left_chain(v.plan.alias("p"), (v.doc.alias("d"), F.col("d.plan_id") == F.col("p.id")), (v.summ.alias("s"), F.col("s.document_id") == F.col("d.id")))
    return rows.select(F.col("p.id").alias("plan_id"), F.col("d.id").alias("doc_id"), F.col("s.id").alias("summary_id"))


def _reasons(v: Views) -> DataFrame:
    return v.doc.filter("id % 4 = 0").select("id", F.concat(F.lit("r"), (F.col("id") % 5).cast("string")).alias("reason"))


@query("""with r as (select id, concat('r', cast(id % 5 as varchar)) as reason from doc where id % 4 = 0)
select d.id, p.name, r.reason from doc d join plan p on p.id = d.plan_id left join r on r.id = d.id where d.status = 'failed'""")
def failed_with_reason(v: Views) -> DataFrame:
    failed = v.doc.filter("status = 'failed'").join(v.plan.select(F.col("id").alias("plan_id"), "name"), "plan_id")
    return op.with_reason(failed, _reasons(v), "id", required=False).select("id", "name", "reason")


@query("""with r as (select id, concat('r', cast(id % 5 as varchar)) as reason from doc where id % 4 = 0)
select d.id, p.name, r.reason from doc d join plan p on p.id = d.plan_id join r on r.id = d.id""")
def skipped_with_reason(v: Views) -> DataFrame:
    rows = v.doc.join(v.plan.select(F.col("id").alias("plan_id"), "name"), "plan_id")
    return op.with_reason(rows, _reasons(v), "id", required=True).select("id", "name", "reason")


@query("select id, plan_id from doc where status = 'done' and id not in (select document_id from summ) and id not in (select id from doc where id % 4 = 0)")
def anti_worklist(v: Views) -> DataFrame:
    return op.anti_worklist(v.doc.filter("status = 'done'").select("id", "plan_id"), "id", v.summ.select(F.col("document_id").alias("id")), _reasons(v))


@query("""with x as (select document_id as id, text_id % 3 as version from summ)
select id, meeting_date from doc where status = 'done' and id not in (select id from x where version = 2)""")
def anti_versioned(v: Views) -> DataFrame:
    processed = v.summ.select(F.col("document_id").alias("id"), (F.col("text_id") % 3).alias("version"))
    return op.anti_versioned(v.doc.filter("status = 'done'").select("id", "meeting_date"), "id", processed, "version", 2)


@query("select id, meeting_date from doc where id in (select document_id from summ where text_id < 50) order by meeting_date desc nulls last, id desc limit 40")
def semi_ids(v: Views) -> DataFrame:
    ids = v.summ.filter("text_id < 50").select(F.col("document_id").alias("id"))
    return op.semi_ids(v.doc.select("id", "meeting_date"), "id", ids, [F.col("meeting_date").desc_nulls_last(), F.col("id").desc()], 40)


@query("""with r as (select id as run_id, case when id % 13 = 0 then null else [id * 2, id * 2 + 1] end as ids from ev), e as (select run_id, unnest(ids) as id from r)
select e.run_id, e.id, d.plan_id from e join doc d on d.id = e.id""")
def join_array_ids(v: Views) -> DataFrame:
    text = F.when(F.col("id") % 13 == 0, "{bad").otherwise(F.format_string("[%d, %d]", F.col("id") * 2, F.col("id") * 2 + 1))
    return op.join_array_ids(v.ev.select(F.col("id").alias("run_id"), text.alias("ids")), "ids", v.doc.select("id", "plan_id"), "id").select("run_id", "id", "plan_id")


@query("""with x as (select plan_id, max(id) as id from doc where fiscal_year >= 1998 group by 1)
select d.plan_id, d.id, d.fiscal_year from doc d join x on x.plan_id = d.plan_id and x.id = d.id""")
def join_latest(v: Views) -> DataFrame:
    return op.join_latest(v.doc.select("plan_id", "id", "fiscal_year"), ["plan_id"], "id", F.col("fiscal_year") >= 1998)


@query("""with r as (select plan_id, id, downloaded_on, row_number() over (partition by plan_id order by downloaded_on desc, id desc) as n from doc)
select p.name, r.id, r.downloaded_on from plan p join r on r.plan_id = p.id where n = 1""")
def join_latest_ordered(v: Views) -> DataFrame:
    newest = op.latest_per_group(v.doc.select("plan_id", "id", "downloaded_on"), ["plan_id"], [F.col("downloaded_on").desc(), F.col("id").desc()])
    return v.plan.select(F.col("id").alias("plan_id"), "name").join(newest, "plan_id").select("name", "id", "downloaded_on")


@query("""with s as (select plan_id, cast(count(*) as bigint) as n, cast(round(100.0 * count(fiscal_year) / count(*)) as bigint) as completeness from doc where status = 'done' group by 1)
select p.id as plan_id, coalesce(cast(s.n as varchar), '—') as n, coalesce(s.completeness, 0) as completeness from plan p left join s on s.plan_id = p.id""")
def join_fallback(v: Views) -> DataFrame:
    built = v.doc.filter("status = 'done'").groupBy("plan_id").agg(F.count("*").cast("string").alias("n"), F.round(100.0 * F.count("fiscal_year") / F.count("*")).cast("bigint").alias("completeness"))
    return op.join_fallback(v.plan.select(F.col("id").alias("plan_id")), "plan_id", built, {"n": "—", "completeness": 0})


@query("select id, coalesce(abbreviation, cast(id as varchar)) as abbreviation, coalesce(name, cast(id as varchar)) as name from plan")
def label_lookup(v: Views) -> DataFrame:
    return op.label_lookup(v.plan, "id", "abbreviation", "name")


@query("""with x as (select plan_id, id as extract_id, fiscal_year, row_number() over (partition by plan_id order by fiscal_year desc nulls last, id desc) as n from doc where doc_type = 'cafr')
select p.id as plan_id, x.extract_id, x.fiscal_year, a.seq, a.asset_class, a.actual_bp from plan p left join (select * from x where n = 1) x on x.plan_id = p.id left join alloc a on a.extract_id = x.extract_id""")
def entity_detail(v: Views) -> DataFrame:
    plans = v.plan.select(F.col("id").alias("plan_id"))
    extracts = v.doc.filter("doc_type = 'cafr'").select("plan_id", F.col("id").alias("extract_id"), "fiscal_year")
    return op.entity_detail(plans, extracts, v.alloc.select("extract_id", "seq", "asset_class", "actual_bp"), "plan_id", "extract_id", [F.col("fiscal_year").desc_nulls_last(), F.col("extract_id").desc()])


@query("select d.id, p.name, s.text_id from doc d left join plan p on p.id = d.plan_id left join summ s on s.document_id = d.id where d.id in (7, 32, 33)")
def context_lookup(v: Views) -> DataFrame:
    docs = v.doc.filter("id in (7, 32, 33)").alias("d")
    return op.join_left_chain(docs, (v.plan.alias("p"), F.col("p.id") == F.col("d.plan_id")), (v.summ.alias("s"), F.col("s.document_id") == F.col("d.id"))).select("d.id", "p.name", "s.text_id")


@query("""with r as (select entity_id, id, value, row_number() over (partition by entity_id order by ts desc, id desc) as n from ev where ts <= timestamp '2024-01-15')
select entity_id, id, value from r where n = 1""")
def asof_snapshot(v: Views) -> DataFrame:
    return op.asof_instant(v.ev, "entity_id", "ts", F.lit("2024-01-15").cast("timestamp_ntz"), "id").select("entity_id", "id", "value")


@query("""with s as (select * from ev where status <> 'click'), p as (select * from ev where status = 'click'),
r as (select p.entity_id, p.id, s.id as snapshot_id, row_number() over (partition by p.id order by s.ts desc, s.id desc) as n from p left join s on s.entity_id = p.entity_id and s.ts <= p.ts)
select entity_id, id, snapshot_id from r where n = 1""")
def asof_many(v: Views) -> DataFrame:
    snapshots = v.ev.filter("status <> 'click'").withColumn("snapshot_id", F.col("id"))
    return op.asof_many(v.ev.filter("status = 'click'"), snapshots, "entity_id", "ts", "id", ["snapshot_id"]).select("entity_id", "id", "snapshot_id")


def _mapping(v: Views) -> DataFrame:
    classes = v.act.select("asset_class").distinct()
    return classes.select(F.concat(F.lit(" "), "asset_class").alias("raw"), F.when(F.length("asset_class") % 4 == 0, None).otherwise(F.lower("asset_class")).alias("canonical"))


@query("""select doc_id, ord, case when length(asset_class) % 4 <> 0 and lower(asset_class) in ('brass', 'promo', 'steel', 'small') then lower(asset_class) else 'unmapped' end as canonical from act""")
def mapping_join(v: Views) -> DataFrame:
    return op.mapping_join(v.act, "asset_class", _mapping(v), ["brass", "promo", "steel", "small"]).select("doc_id", "ord", "canonical")


@query("select id, name, coalesce(size, 0) as size from plan where id not in (select plan_id from doc where status = 'done') order by coalesce(size, 0) desc, id")
def coverage_gap(v: Views) -> DataFrame:
    active = v.doc.filter("status = 'done'").select(F.col("plan_id").alias("id"))
    return op.coverage_gap(v.plan.select("id", "name", "size"), "id", active, "size").withColumn("size", F.coalesce("size", F.lit(0.0)))


# the four quarters of an item are its claims, the last with the rest, some letters in capitals; so is its first word, and one word of the corpus in another's place
@query("""with q as (select item_id, i, length(text) // 4 as n, text from bench, (select unnest([0, 1, 2, 3]) as i) t),
c as (select concat(item_id, ':', i) as claim, case when i < 3 then substr(text, i * n + 1, n) else substr(text, 3 * n + 1) end as part from q
  union all select concat(item_id, ':word'), split_part(text, ' ', 1) from bench union all select concat(item_id, ':pair'), concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 1)) from bench)
select claim, exists (select 1 from txt where contains(lower(txt.text), lower(c.part))) as supported from c""")
def claim_check(v: Views) -> DataFrame:
    n = F.floor(F.length("text") / 4).cast("int")
    quarters = [F.substring("text", i * n + 1, n) for i in range(3)] + [F.substring("text", 3 * n + 1, F.length("text"))]
    word = F.split("text", " ")
    parts = [*((F.lit(str(i)), F.translate(x, "abcdefgh", "ABCDEFGH")) for i, x in enumerate(quarters)), (F.lit("word"), word[0]), (F.lit("pair"), F.concat_ws(" ", word[1], word[0]))]
    each = v.bench.select("item_id", F.explode(F.array(*(F.struct(k.alias("kind"), x.alias("part")) for k, x in parts))).alias("p"))
    rows = each.select(F.concat_ws(":", "item_id", "p.kind").alias("claim"), F.array("p.part").alias("variants"))
    return claims.claim_check(rows, "claim", "variants", v.txt, "text")


@query("""select 'doc' as table_name, 'plan_id' as column_name, id from doc where plan_id is not null and plan_id not in (select id from plan where id % 50 <> 0)
union all select 'summ', 'text_id', id from summ where text_id is not null and text_id not in (select id from txt where id % 30 <> 0)""")
def orphan_check(v: Views) -> DataFrame:
    return op.orphan_check([("doc", v.doc, "id", "plan_id", v.plan.filter("id % 50 <> 0"), "id"), ("summ", v.summ, "id", "text_id", v.txt.filter("id % 30 <> 0"), "id")])


@query("""with b as (select id, plan_id, status, case when id % 9 = 0 then amount + 1 else amount + 0.00000001 end as amount from doc where id % 8 <> 0 union all select -id, plan_id, status, amount from doc where id % 100 = 0)
select coalesce(d.id, b.id) as id, case when b.id is null then 'left_only' when d.id is null then 'right_only' else 'changed' end as change
from doc d full join b on b.id = d.id where b.id is null or d.id is null or abs(b.amount - d.amount) > 0.000001
union all select null, 'count_differs' where (select count(*) from doc) <> (select count(*) from b)""")
def dataset_diff(v: Views) -> DataFrame:
    left = v.doc.select("id", "plan_id", "status", "amount")
    right = left.filter("id % 8 <> 0").withColumn("amount", F.when(F.col("id") % 9 == 0, F.col("amount") + 1).otherwise(F.col("amount") + 1e-8))
    right = right.unionByName(left.filter("id % 100 = 0").withColumn("id", -F.col("id")))
    return op.dataset_diff(left, right, "id", ["plan_id", "status", "amount"])


@query("""with h as (select entity_id, id, ts, md5(concat(cast(id % 7 as varchar), status)) as hash from ev),
a as (select *, row_number() over (partition by entity_id order by ts desc, id desc) as n from h where entity_id % 11 <> 0),
b as (select *, row_number() over (partition by entity_id order by ts desc, id desc) as n from h where entity_id % 13 <> 0 and id % 3 <> 0)
select coalesce(a.entity_id, b.entity_id) as entity_id, a.hash as left_hash, b.hash as right_hash from (select * from a where n = 1) a full join (select * from b where n = 1) b on a.entity_id = b.entity_id
where a.hash is distinct from b.hash""")
def snapshot_hash_diff(v: Views) -> DataFrame:
    rows = v.ev.withColumn("hash", F.md5(F.concat((F.col("id") % 7).cast("string"), "status")))
    order = [F.col("ts").desc(), F.col("id").desc()]
    return op.snapshot_hash_diff(rows.filter("entity_id % 11 <> 0"), rows.filter("entity_id % 13 <> 0 and id % 3 <> 0"), "entity_id", "hash", order)
