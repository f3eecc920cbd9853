"""Queries for scans and sinks. Files are derived from the tables and written to the shared folder first."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.plans.views import Views
from corpusloom.sources import tables as src


@query("select o_orderkey, o_custkey, o_orderstatus, cast(null as varchar) as note from orders")
def scan_table(v: Views) -> DataFrame:
    return src.scan_table(v.spark, f"{v.dir}/orders.parquet", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, note string")


@query("select id, name from plan where segment = 'BUILDING'")
def scan_json_registry(v: Views) -> DataFrame:
    path = src.shared_folder(v.spark)
    objects = v.plan.select(F.struct("id", "name", F.initcap("segment").alias("segment")).alias("o"), F.floor(F.col("id") / 1000).alias("file"))  # a file has at most 1000 objects, however many there are
    objects.groupBy("file").agg(F.to_json(F.collect_list("o")).alias("value")).write.partitionBy("file").text(path)
    return src.scan_json_registry(v.spark, path, "id bigint, name string, segment string", "segment", "building").select("id", "name")


@query("""select distinct manager as raw, case when length(manager) <= 2 then 'short' else manager end as canonical, manager <> 'N/A' as is_manager from act where manager is not null""")
def scan_mapping(v: Views) -> DataFrame:
    names = v.act.select("manager").filter("manager is not null").distinct()
    short = F.when(F.length("manager") <= 2, '"short"').otherwise("null")
    value = F.concat(F.lit('{"canonical": '), short, F.lit(', "is_manager": '), (F.col("manager") != "N/A").cast("string"), F.lit("}"))
    text = names.select(F.concat(F.lit('{"'), "manager", F.lit('": '), F.when(F.length("manager") % 2 == 0, value).otherwise(F.when(F.col("manager") == "N/A", value).otherwise(F.concat(F.lit('"'), F.when(F.length("manager") <= 2, "short").otherwise(F.col("manager")), F.lit('"')))), F.lit("}")).alias("text"))
    return src.scan_mapping(text, "text", fall_back=True)


@query("select id, name from plan where id not in (3, 7, 11)")
def scan_block_list(v: Views) -> DataFrame:
    return src.scan_block_list(v.plan.select("id", "name"), "id", [3, 7, 11])


@query("""with p as (select case when id % 50 = 0 then null when id % 40 = 0 then -id else id end as id, case when id % 30 = 0 then 'nonsense' when id % 4 = 0 then 'BUILDING' else segment end as segment from plan)
select cast(p.id as varchar) as id, p.segment, case when p.id is null then 'blank key' when p.segment = 'nonsense' then 'invalid' when plan.id is null then 'unknown key' when plan.segment = p.segment then 'unchanged' else 'updated' end as outcome from p left join plan on plan.id = p.id""")
def scan_csv_patch(v: Views) -> DataFrame:
    path = src.shared_folder(v.spark)
    key = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 40 == 0, -F.col("id")).otherwise(F.col("id"))
    segment = F.when(F.col("id") % 30 == 0, "nonsense").when(F.col("id") % 4 == 0, "BUILDING").otherwise(F.col("segment"))
    src.sink_csv(v.plan.select(key.alias("id"), segment.alias("segment")), path)
    allowed = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return src.scan_csv_patch(v.spark, path, ["id", "segment"], v.plan, "id", "segment", allowed)


@query("select cast(id as varchar) as id, url, doc_type from doc")
def sink_csv(v: Views) -> DataFrame:
    path = src.shared_folder(v.spark)
    src.sink_csv(v.doc.select("id", "url", "doc_type"), path)
    return v.spark.read.option("header", True).csv(path)


@query("select id, entity_id, status from ev")
def sink_table_copy(v: Views) -> DataFrame:
    folder = src.shared_folder(v.spark)
    src.sink_table_copy({"ev": v.ev, "plan": v.plan}, folder)
    return v.spark.read.parquet(f"{folder}/ev.parquet").select("id", "entity_id", "status")


@query("""with l as (select extract_id, seq, concat(cast(seq as varchar), ' ', asset_class, ' ', coalesce(cast(target_bp as varchar), '-')) as line, target_bp from alloc)
select extract_id, concat('# ', cast(extract_id as varchar), chr(10), string_agg(line, chr(10) order by seq, line), chr(10),
case when sum(target_bp) is null then 'no targets' when abs(sum(target_bp) - 1000) > 10 then concat('targets sum to ', cast(sum(target_bp) as varchar)) else 'targets sum up' end) as body from l group by 1
union all select extract_id, concat('| [Report ', cast(extract_id as varchar), '](', cast(extract_id as varchar), '.md) | ', count(*), ' | ', count(target_bp), ' |') from alloc group by 1""")
def sink_report_rows(v: Views) -> DataFrame:
    line = F.concat_ws(" ", F.col("seq").cast("string"), "asset_class", F.coalesce(F.col("target_bp").cast("string"), F.lit("-")))
    rows = src.report_rows(v.alloc, "extract_id", "seq", line, "target_bp", 1000)
    index = src.report_index(v.alloc, "extract_id", F.concat(F.lit("Report "), F.col("extract_id").cast("string")), "target_bp").withColumnRenamed("line", "body")
    folder = src.shared_folder(v.spark)
    rows.write.parquet(f"{folder}/part=body")
    index.write.parquet(f"{folder}/part=index")
    return v.spark.read.parquet(folder).drop("part")


@query("select segment as title, date '2024-01-01' + cast(length(segment) % 9 as int) as generated from (select distinct segment from plan) p order by generated desc, title")
def note_index(v: Views) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.length("segment") % 9).cast("string")
    notes = v.plan.select("segment").distinct().select("segment", F.concat(F.lit("# "), "segment", F.lit("\n\nGenerated: "), day).alias("value"))
    folder = src.shared_folder(v.spark)
    notes.write.partitionBy("segment").text(folder)
    return src.note_index(v.spark, f"{folder}/*").select("title", "generated")
