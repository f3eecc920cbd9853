"""Grouping steps keep the number of partitions that they are given, and streams the order and entities of their rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import aggregates, ordering
from corpusloom.streaming import incremental
from tests.test_streams import stage


@pytest.mark.parametrize("make", [
    lambda r: ordering.key_symmetric_diff(r.filter("id % 5 <> 0"), r.filter("id % 7 <> 0"), "id"),
    lambda r: aggregates.pivot_first(r, "id", "n", [1, 2], "id", "n"),
    lambda r: aggregates.mention_documents(r.withColumn("name", F.col("id").cast("string")), "name", "id"),
    lambda r: aggregates.activity_timeline(r, r, "n", "id", ["id"], 5000),
])
def test_narrow_groups_stay_dealt(spark, make):
    rows = spark.range(2000).withColumn("n", F.col("id") % 3)
    made = make(rows)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan, plan


def test_symmetric_diff_takes_null_and_copies_as_one_key(spark):
    a, b = (spark.createDataFrame([(x,) for x in r], "id long") for r in ([1, 1, 2, None, None], [2, 2, 3, 3]))
    assert sorted(map(tuple, ordering.key_symmetric_diff(a, b, "id").collect()), key=str) == [(1, "left"), (3, "right"), (None, "left")]


def test_pivot_without_a_wanted_value_keeps_its_row(spark):
    rows = spark.createDataFrame([(1, 1, 5, 2), (1, 1, 6, 1), (1, 2, None, 1), (2, 9, 7, 1)], "r long, c int, v int, o int")
    made = aggregates.pivot_first(rows, "r", "c", [1, 2], "v", "o")
    assert made.columns == ["r", "1", "2"] and sorted(map(tuple, made.collect())) == [(1, 6, None), (2, None, None)]


def test_stream_state_is_kept_for_groups_of_entities(spark, tmp_path):
    batches = [[(i, i % 3, i % 2500, "ab"[i % 3 == 0]) for i in range(5000)], [(9000, 100, None, "a"), (9001, 101, None, "a"), (9002, 102, None, "b")], [(9999, 400, -1, "end")]]
    out = incremental.run_once(incremental.snapshot_on_change(stage(spark, str(tmp_path / "in"), batches), "user_id", "event_id", "event_type", "ts", "5 days"), str(tmp_path / "out"))
    got = out.filter("entity is null or entity >= 0").collect()
    rows = sorted((u, d, k, t) for k, d, u, t in batches[0])
    want = {(u, k, t) for i, (u, _, k, t) in enumerate(rows) if not i or rows[i - 1][0] != u or rows[i - 1][3] != t}
    assert {tuple(r) for r in got} == want | {(None, 9000, "a"), (None, 9002, "b")} and len(got) == len(want) + 2
    state = spark.read.format("statestore").load(f"{tmp_path / 'out'}-state")
    assert state.count() <= incremental.GROUPS
