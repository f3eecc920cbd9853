"""Roll-ups give the whole lists behind their counts."""

import duckdb

from corpusloom.operators import aggregates as op
from corpusloom.plans import catalog


def test_every_document_of_a_name_is_listed(spark):
    rows = [(" a ", "hire", 1, d, None) for d in (30, 7, 7, None)] + [("a", None, 2, 100 - i, None) for i in range(40)] + [("b", "fire", 3, 5, None), (" ", "fire", 3, 6, None)]
    actions = spark.createDataFrame(rows, "manager string, action string, plan_id long, doc_id long, day date")
    got = {r.name: r for r in op.mention_rollup(actions, "manager", "action", "plan_id", "doc_id", "day").collect()}
    want = sorted({30, 7, *(100 - i for i in range(40))})
    assert set(got) == {"a", "b"} and got["a"].doc_ids == want and got["b"].doc_ids == [5]
    assert (got["a"].mentions, got["a"].n_entities, got["a"].n_docs, got["a"].actions) == (44, 2, len(want), {"hire": 4, "other": 40})


def test_every_failed_and_skipped_document_is_listed(spark):
    failed, skipped = (spark.createDataFrame(r, "plan_id long, id long") for r in ([(1, 9), (1, 3), (2, 4)], [(1, 3), (3, 8), (3, 2)]))
    got = {r.plan_id: (r.n_failed, r.first_failed, r.failed, r.n_skipped, r.first_skipped, r.skipped) for r in op.failure_rollup(failed, skipped, "plan_id", "id").collect()}
    assert got == {1: (2, 3, [3, 9], 1, 3, [3]), 2: (1, 4, [4], 0, None, []), 3: (0, None, [], 2, 2, [2, 8])}


def test_the_queries_return_the_lists(spark):
    sf = "/root/testdata/sf0.001"
    assert all(len(r.docs.split()) == r.n_docs for r in catalog.QUERIES["mention_rollup"](spark, sf).collect())
    assert all(len(r.failed.split()) == r.n_failed for r in catalog.QUERIES["failure_rollup"](spark, sf).collect())


def test_the_failure_query_lists_failed_and_skipped_documents(spark, tmp_path):
    orders = [(k, 1, "P" if k % 3 == 0 else "F") for k in range(40, 0, -1)] + [(8, 1, "P"), (100, 2, "P"), (101, 2, "P"), (16, 3, "O"), (9, 4, "F"), (4, None, "P"), (6, None, "P")]
    con = duckdb.connect()
    con.execute("create table orders (o_orderkey bigint, o_custkey bigint, o_orderstatus varchar, o_totalprice double, o_orderdate timestamp, o_orderpriority varchar)")
    con.executemany("insert into orders values (?, ?, ?, 1.0, '1999-01-02', '2-HIGH')", orders)
    con.execute(f"copy orders to '{tmp_path}/orders.parquet'")
    ids = lambda plan, kept: " ".join(str(k) for k in sorted(k for k, p, s in orders if p == plan and kept(k, s)))
    want = {p: (ids(p, lambda k, s: s == "P"), ids(p, lambda k, s: k % 4 == 0)) for p in (1, 2, 3, None)}
    assert want[1][1] == "4 8 8 12 16 20 24 28 32 36 40" and want[3] == ("", "16") and want[None] == ("4 6", "4")
    rows = catalog.QUERIES["failure_rollup"](spark, str(tmp_path))
    assert {r.plan_id: (r.failed, r.skipped) for r in rows.collect()} == want
    assert all(len(r.skipped.split()) == r.n_skipped and len(r.failed.split()) == r.n_failed for r in rows.collect())
    theirs = con.sql(catalog.ORACLE["failure_rollup"])
    assert sorted(theirs.fetchall(), key=str) == sorted(map(tuple, rows.select(*theirs.columns).collect()), key=str)
