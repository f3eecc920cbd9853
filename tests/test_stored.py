"""Tables that are rewritten partition by partition, and pages stored by document."""

import os

from pyspark.sql import functions as F

from corpusloom.operators import textsearch
from corpusloom.sources.stored import StoredTable, open_pages, prune, save_pages


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_only_touched_partitions_are_written(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), "id", 16).create(spark.range(200).selectExpr("id", "cast(id * 2 as string) as v", "cast(null as int) as w"))
    before = files(tmp_path / "t")
    incoming = spark.createDataFrame([(3, "new", 1), (500, "more", None)], "id long, v string, w int")
    hit = table.upsert(incoming, ["v", "w"])
    after = files(tmp_path / "t")
    assert len(hit) <= 2 and all(after.get(f) == m for f, m in before.items() if not any(f"_bucket={b}/" in f for b in hit))
    want = {i: (i, str(i * 2), None) for i in range(200)} | {3: (3, "new", 1), 500: (500, "more", None)}
    assert rows(table) == sorted(want.values(), key=lambda r: r[0])
    assert table.upsert(incoming, ["v", "w"]) == hit and rows(table) == sorted(want.values(), key=lambda r: r[0])  # again: the same
    assert table.upsert(incoming.limit(0), ["v", "w"]) == []


def test_a_partition_that_is_emptied_goes(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), "id", 8).create(spark.range(20).selectExpr("id", "'x' as v"))
    table.remove(spark.range(19))
    assert rows(table) == [(19, "x")]
    table.replace(spark.createDataFrame([(19, "a"), (19, "b")], "id long, v string"))
    assert rows(table) == [(19, "a"), (19, "b")]


def test_prune_that_was_broken_off(spark, tmp_path, monkeypatch):
    docs = StoredTable(spark, str(tmp_path / "d"), "id", 4).create(spark.range(30).selectExpr("id", "concat('u', id) as url"))
    children = StoredTable(spark, str(tmp_path / "c"), "document_id", 4).create(spark.range(60).selectExpr("id div 2 as document_id", "id as child"))
    stones = StoredTable(spark, str(tmp_path / "s"), "url", 4).create(spark.createDataFrame([("u1",), ("zz",)], "url string"))
    plain = StoredTable.remove
    monkeypatch.setattr(StoredTable, "remove", lambda self, keys: (_ for _ in ()).throw(OSError("lost")) if self is docs else plain(self, keys))
    try:
        prune(docs, children, stones, F.col("id") < 10)
    except OSError:
        assert docs.read().count() == 30 and children.read().count() == 40
    monkeypatch.setattr(StoredTable, "remove", plain)
    prune(docs, children, stones, F.col("id") < 10)
    assert [r[0] for r in rows(docs)] == list(range(10, 30)) and children.read().count() == 40
    assert rows(stones) == sorted([("zz",), *((f"u{i}",) for i in range(10))])


def test_stored_pages_are_read_without_a_shuffle(spark, tmp_path):
    pages = spark.range(300).selectExpr("id % 30 as id", "cast(id div 30 as int) as page", "if(id % 7 = 0, 'start', if(id % 5 = 0, 'end', 'x')) as text")
    stored = save_pages(pages, "id", 8)
    found = textsearch.section_range(stored, "id", "start", "end")
    made = textsearch.section_concat(stored, found, "id", 100)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, textsearch.section_concat(pages, textsearch.section_range(pages, "id", "start", "end"), "id", 100).collect()))
    plain = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plain, plain
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    again = open_pages(spark, folder, "id", 8)
    assert again.count() == 300 and "hashpartitioning" not in again.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
