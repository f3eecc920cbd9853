"""Queries that run the incremental operators as streams over the event files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.plans.views import Views
from corpusloom.sources.tables import shared_folder
from corpusloom.streaming import incremental as op

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(v: Views) -> DataFrame:
    return op.read_files(v.spark, f"{v.dir}/events*.parquet", _EVENTS, "ts")


@query("select event_id as id, user_id as entity_id from events where ts < timestamp '2024-01-25'")
def stream_new_since(v: Views) -> DataFrame:
    rows = op.new_since(_events(v), "ts", F.lit("2024-01-25").cast("timestamp"))
    return op.run_once(rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id")), shared_folder(v.spark))


@query("select distinct user_id as entity_id, event_type as status from events")
def stream_dedupe(v: Views) -> DataFrame:
    first = op.dedupe(_events(v), ["user_id", "event_type"], "ts", "60 days")
    return op.run_once(first.select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("status")), shared_folder(v.spark))


def _files(v: Views, part: Column, rows: DataFrame | None = None, closing: bool = False) -> str:
    """The events written file after file by their part (0 to 5): a stream that comes in six batches. ``closing`` adds a row
    of the far future, by which the watermark passes all others."""
    folder, rows = shared_folder(v.spark), v.table("events") if rows is None else rows
    rows = rows.withColumn("part", part).persist()
    for i in range(6):
        rows.filter(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{folder}/{i}")
    if closing:
        last = v.spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2030-01-01").cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
        last.write.parquet(f"{folder}/6")
    rows.unpersist()
    return f"{folder}/*"


_PART = "least(5, (day(ts) - 1) div 6)"


def _late(v: Views) -> DataFrame:
    """Every third event comes one file after its time."""
    part = F.expr(f"least(5, {_PART} + if(event_id % 3 = 0, 1, 0))")
    return op.read_files(v.spark, _files(v, part, closing=True), _EVENTS, "ts", 1)


@query("""with l as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
select user_id as entity, event_id as id, event_type as value from l where before is null or before <> event_type""")
def stream_snapshot_on_change(v: Views) -> DataFrame:
    return op.run_once(op.snapshot_on_change(_late(v), "user_id", "event_id", "event_type", "ts", "14 days"), shared_folder(v.spark)).filter("entity >= 0")


@query("""with recursive e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select user_id, event_id, n, event_type as status, true as accepted from e where n = 1
union all select e.user_id, e.event_id, e.n, case when concat(r.status, '>', e.event_type) in ('view>click', 'click>purchase', 'click>view', 'purchase>view') then e.event_type else r.status end,
concat(r.status, '>', e.event_type) in ('view>click', 'click>purchase', 'click>view', 'purchase>view') from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id as entity, event_id as id, status, accepted from r""")
def stream_status_transition(v: Views) -> DataFrame:
    allowed = {"view": ["click"], "click": ["purchase", "view"], "purchase": ["view"]}
    return op.run_once(op.status_transition(_late(v), "user_id", "event_id", "event_type", "ts", allowed, "14 days"), shared_folder(v.spark)).filter("entity >= 0")


# users come in every fourth batch only, so that some reappear
@query("""with e as (select *, least(5, (day(ts) - 1) // 6) as part from events where (user_id + least(5, (day(ts) - 1) // 6)) % 4 = 0),
b as (select part, count(*) as n, min(ts) as began, max(ts) as ended from e group by 1),
k as (select part, event_type, row_number() over (partition by part order by user_id, ts desc, event_id) as r from e where event_type in ('purchase', 'click')),
s as (select distinct u.part, u.user_id, (select max(p.ts) from e p where p.user_id = u.user_id and p.part < u.part) as last from e u)
select part as batch, concat('volume:', n) as reason from b where n > 40
union all select part, concat('keyword:', event_type) from k where r = 1
union all select s.part, concat('reappear:', user_id) from s join b on b.part = s.part where last < began and last < ended - interval 22 days""")
def stream_batch_triggers(v: Views) -> DataFrame:
    rows = v.table("events").filter(F.expr(f"(user_id + {_PART}) % 4 = 0"))
    events = op.read_files(v.spark, _files(v, F.expr(_PART), rows), _EVENTS, "ts", 1)
    order = [F.col("user_id"), F.col("ts").desc(), F.col("event_id")]
    return op.trigger_batches(events, shared_folder(v.spark), "event_type", ["Purchase", "CLICK"], 40, 22, "user_id", "ts", order).select("batch", "reason")


_URL = "concat('https://h/', user_id % 40, '/', event_id % 300)"


@query(f"""with e as (select event_id, user_id % 40 as plan, {_URL} as url, least(5, (day(ts) - 1) // 6) as part from events),
u as (select plan, url, part, min(event_id) as event_id from e group by 1, 2, 3),
c as (select *, row_number() over (partition by part, plan order by event_id, url) as n from u),
k as (select * from c where n <= 5 and event_id % 300 <> 7 and not (part >= 3 and event_id % 300 = 11)),
f as (select *, row_number() over (partition by url order by part) as first from k)
select event_id, plan, url, cast(part as bigint) as batch from f where first = 1""")
def stream_ingest_dedupe(v: Views) -> DataFrame:
    events = op.read_files(v.spark, _files(v, F.expr(_PART)), _EVENTS, "ts", 1)
    rows = events.select("event_id", (F.col("user_id") % 40).alias("plan"), F.expr(_URL).alias("url"))
    known = v.spark.range(40).select(F.concat(F.lit("https://h/"), F.col("id").cast("string"), F.lit("/7")).alias("url"))
    asked = []

    def pruned() -> DataFrame:
        asked.append(1)  # from the fourth batch on
        return v.spark.range(40).filter(F.lit(len(asked) > 3)).select(F.concat(F.lit("https://h/"), F.col("id").cast("string"), F.lit("/11")).alias("url"))

    return op.ingest_batches(rows, shared_folder(v.spark), "plan", "url", "event_id", known, pruned, 5).select("event_id", "plan", "url", "batch")


@query("""with e as (select event_id, user_id % 50 as plan, md5(concat(cast(event_id % 60 as varchar), event_type)) as digest, least(5, (day(ts) - 1) // 6) as part from events),
o as (select *, row_number() over (partition by plan, digest order by part, event_id) as nth from e),
n as (select plan, digest, row_number() over (partition by plan order by part, event_id) as version from o where nth = 1)
select o.event_id, o.plan, case when nth = 1 then 'new' else 'already_have' end as outcome, n.version, cast(part as bigint) as batch from o join n on n.plan = o.plan and n.digest = o.digest""")
def stream_content_version(v: Views) -> DataFrame:
    events = op.read_files(v.spark, _files(v, F.expr(_PART)), _EVENTS, "ts", 1)
    digest = F.md5(F.concat((F.col("event_id") % 60).cast("string"), "event_type")).alias("digest")
    rows = events.select("event_id", (F.col("user_id") % 50).alias("plan"), digest)
    return op.version_batches(rows, shared_folder(v.spark), "plan", "digest", ["event_id"]).select("event_id", "plan", "outcome", "version", "batch")
