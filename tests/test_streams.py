"""Streams in several batches: batches that fail and run again, late rows, and entities that are forgotten."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import incremental as op

DAY = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"


def stage(spark, folder, batches):
    """A file a batch of (event_id, day, user_id, event_type)."""
    for i, rows in enumerate(batches):
        made = [(k, DAY + timedelta(days=d), u, t) for k, d, u, t in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    return op.read_files(spark, f"{folder}/*", SCHEMA, "ts", 1)


BATCHES = [
    [(1, 0, 1, "view"), (2, 0, 2, "view"), (3, 0, 3, "error report")],
    [(4, 10, 1, "view"), (5, 10, 4, "Purchase plan")],
    [(6, 45, 1, "click"), (7, 45, 2, "view"), (8, 45, 5, "view")],
    [(9, 50, 1, "view"), (10, 50, 3, "view")],
]
REASONS = {(0, "volume:3"), (0, "keyword:error"), (1, "keyword:purchase"), (2, "volume:3"), (2, "reappear:1"), (2, "reappear:2"), (3, "reappear:3")}


@pytest.mark.parametrize("every", [None, 2])
def test_triggers_of_a_batch_that_runs_again(spark, tmp_path, monkeypatch, every):
    events, failed, plain = stage(spark, str(tmp_path / "in"), BATCHES), [], op.BatchTable.write

    def write(self, rows, batch):
        self.every = every if self.merge else None
        plain(self, rows, batch)
        if batch == 2 and self.folder.endswith("seen") and not failed:
            failed.append(1)
            raise RuntimeError("lost after the tables were written")

    monkeypatch.setattr(op.BatchTable, "write", write)
    args = (str(tmp_path / "out"), "event_type", ["Purchase", "error"], 2, 30, "user_id", "ts")
    with pytest.raises(Exception, match="lost after"):
        op.trigger_batches(events, *args)
    again = op.trigger_batches(events, *args)  # batch 2 once more, then 3
    assert {tuple(r) for r in again.select("batch", "reason").collect()} == REASONS and again.count() == len(REASONS)
    before = again.count()
    assert op.trigger_batches(events, *args).count() == before  # nothing new


def test_late_rows_take_their_place_and_silent_entities_are_forgotten(spark, tmp_path):
    events = stage(spark, str(tmp_path / "in"), [
        [(1, 0, 1, "a"), (3, 4, 1, "a"), (20, 0, 2, "x")],
        [(2, 2, 1, "b"), (4, 6, 1, "a")],  # event 2 lies between two rows of the first batch
        [(30, 60, 9, "end")],
        [(31, 61, 9, "end")],
        [(40, 62, 9, "end"), (21, 61, 2, "x")],  # entity 2 was silent for longer than it is remembered
        [(50, 200, 9, "end")],
        [(51, 400, 9, "end")],
    ])
    out = op.run_once(op.snapshot_on_change(events, "user_id", "event_id", "event_type", "ts", "5 days", forget_days=30), str(tmp_path / "out"))
    got = {(r.entity, r.id, r.value) for r in out.filter("entity < 9").collect()}
    assert got == {(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 20, "x"), (2, 21, "x")}
    moved = op.run_once(op.status_transition(events, "user_id", "event_id", "event_type", "ts", {"a": ["b"], "b": ["a"], "x": []}, "5 days", 3650), str(tmp_path / "moves"))
    assert {(r.id, r.status, r.accepted) for r in moved.filter("entity < 9").collect()} == {(1, "a", True), (2, "b", True), (3, "a", True), (4, "a", False), (20, "x", True), (21, "x", False)}


def test_caps_and_versions_across_batches(spark, tmp_path):
    rows = stage(spark, str(tmp_path / "in"), [[(1, 0, 1, "u1"), (2, 0, 1, "u2"), (3, 0, 1, "u3"), (4, 0, 2, "u1")], [(5, 1, 1, "u2"), (6, 1, 1, "u3"), (7, 1, 2, "u9")]])
    events = rows.select("event_id", F.col("user_id").alias("plan"), F.concat("user_id", "event_type").alias("url"))
    none = spark.createDataFrame([], "url string")
    taken = op.ingest_batches(events, str(tmp_path / "a"), "plan", "url", "event_id", none, lambda: spark.createDataFrame([("2u9",)], "url string"), 2)
    assert {(r.event_id, r.batch) for r in taken.collect()} == {(1, 0), (2, 0), (4, 0), (6, 1)}
    digests = rows.select("event_id", F.col("user_id").alias("plan"), F.col("event_type").alias("digest"))
    made = op.version_batches(digests, str(tmp_path / "b"), "plan", "digest", ["event_id"])
    assert {(r.event_id, r.outcome, r.version) for r in made.collect()} == {(1, "new", 1), (2, "new", 2), (3, "new", 3), (4, "new", 1), (5, "already_have", 2), (6, "already_have", 3), (7, "new", 2)}
