"""Every catalog query against its SQL on the smallest tables, in order where the SQL has one, and that all of them are registered alike."""

import math
from collections import Counter
from datetime import date, datetime

import duckdb
import pytest

from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their last ``order by`` has brackets.
ORDERED = {"size_order", "coverage_gap", "resort_limited", "meeting_assembly"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    mine = catalog.QUERIES[name](spark, SF)
    rows = [tuple(plain(v) for v in r) for r in mine.collect()]
    if name in catalog.ORACLE:
        theirs = con.sql(catalog.ORACLE[name])
        assert sorted(theirs.columns) == sorted(mine.columns)
        order = [theirs.columns.index(c) for c in mine.columns]
        expected = [tuple(plain(r[i]) for i in order) for r in theirs.fetchall()]
        assert Counter(rows) == Counter(expected)
        if "order by" in catalog.ORACLE[name].lower().rsplit(")", 1)[-1] or name in ORDERED:
            assert rows == expected
    else:
        assert rows


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
