"""Small rows with the edge cases that the operators are there for."""

from datetime import date, datetime

from pyspark.sql import functions as F

from corpusloom.functions import expressions as fn
from corpusloom.operators import aggregates, incremental, joins, windows
from corpusloom.operators import searchindex as ranked
from corpusloom.operators import textsearch as search
from corpusloom.sources import links


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_tolerant_json(spark):
    texts = [None, "{bad", '{"a": 1}', "[]", '[1, {"a": 1}, "x"]']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(fn.json_list_tolerant("t")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 0, 0, 1]


def test_dates_and_names(spark):
    for name, day in {"a 2024-03-05.pdf": date(2024, 3, 5), "b_03-05-2024": date(2024, 3, 5), "20240305": date(2024, 3, 5), "03052024 x": date(2024, 3, 5), "March 5, 2024": date(2024, 3, 5), "2024-13-05": None, "1999-01-01": None, "none": None}.items():
        assert one(spark, fn.date_from_name("n"), n=name) == day, name
    for url, want in {"https://h/x/Agenda.pdf?v=1": "Agenda.pdf", "https://h/doc/download": "doc.pdf", "https://h/a%20b.docx": "a%20b.docx", "https://h": "Minutes-of-May.pdf"}.items():
        assert one(spark, fn.make_filename("u", "t"), u=url, t="Minutes of May") == want, url


def test_week_end_is_the_saturday_before(spark):
    for day, want in {"2024-01-07": date(2024, 1, 6), "2024-01-10": date(2024, 1, 6), "2024-01-13": date(2024, 1, 6)}.items():
        assert one(spark, fn.week_end(F.col("d").cast("date")), d=day) == want


def test_preview_ends_at_a_sentence(spark):
    text = "One sentence. " * 60
    got = one(spark, fn.preview("t", 100), t=text)
    assert got.endswith(". …") and len(got) <= 102 and one(spark, fn.preview("t", 10), t="abcdefghijklmno") == "abcdefghij …"


def test_pages_and_sections(spark):
    rows = spark.createDataFrame([(1, "cover [Page 1]\nContents [Page 2]\nInvestments begin[Page 3] more [Page 4] Actuarial")], "id long, text string")
    pages = search.page_split(rows, "id", "text")
    assert [(r.page, r.text.strip()) for r in pages.orderBy("page").collect()] == [(1, "Contents"), (2, "Investments begin"), (3, "more"), (4, "Actuarial")]
    assert search.section_range(pages, "id", "Investments", "Actuarial").first()[1:] == (2, 3)
    assert search.section_range(pages, "id", "Investments", "missing").first()[1:] == (2, 4)
    assert search.phrase_span(pages, "id", "more", 3, 80).first()[1:] == (1, 4)


def test_keyword_excerpt_merges_windows(spark):
    text = "a" * 50 + "x" * 100 + "KEY" + "y" * 10 + "KEY" + "z" * 100 + "b" * 50
    got = search.keyword_excerpt(spark.createDataFrame([(1, text), (2, "short")], "id long, t string"), "id", "t", "KEY", 10, 50, 50, 150)
    by = {r.id: r.excerpt for r in got.collect()}
    assert by[1] == "a" * 50 + "\n\n[...]\n\nxxxxxKEYyy\n\n[...]\n\nyyyyyKEYzz\n\n[...]\n\n" + "b" * 50 and by[2] == "short"


def test_search_needs_all_terms_and_folds_accents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Pension réform vote"), (2, "pension vote vote"), (3, "reform"), (4, None)], "id long, t string")
    index = ranked.save_index(docs, str(tmp_path / "index"), "id", "t")
    assert [r.key for r in ranked.search_bm25(index, "VOTE (pension)", 10).collect()] == [2, 1]
    assert [r.key for r in ranked.search_web(index, '"pension reform"', 10).collect()] == [1]
    assert ranked.search_web(index, "vote -reform", 10).count() == 1 and ranked.search_bm25(index, " ", 5).count() == 0


def test_drift_and_range(spark):
    rows = spark.createDataFrame([(40, 45, 35, 44), (40, None, 35, 44), (None, 40, 35, 44)], "t int, a int, lo int, hi int")
    assert [(r.drift, r.out_of_range) for r in aggregates.allocation_drift(rows, "t", "a", "lo", "hi").collect()] == [(5, True), (None, None), (None, False)]


def test_new_since_is_strict(spark):
    at = [datetime(2024, 1, 1), datetime(2024, 1, 1, 1), None, datetime(2025, 1, 1)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "id long, at timestamp_ntz")
    got = incremental.new_since(rows, "at", F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-06-01").cast("timestamp_ntz"))
    assert [r.id for r in got.collect()] == [1]


def test_prior_gap_needs_a_prior(spark):
    history = spark.createDataFrame([(1, date(2024, 1, 1)), (1, date(2024, 3, 1)), (2, date(2024, 2, 20)), (2, date(2024, 3, 2)), (3, date(2024, 3, 1))], "k long, d date")
    assert [r.k for r in windows.prior_gap(history.filter("d >= date'2024-03-01'"), history, "k", "d", 30).collect()] == [1]


def test_asof_many_takes_the_latest_before(spark):
    snapshots = spark.createDataFrame([(1, 10, 1, "a"), (1, 20, 2, "b")], "k long, at long, id long, v string")
    probes = spark.createDataFrame([(1, 5, 7), (1, 10, 8), (1, 99, 9)], "k long, at long, id long")
    assert [(r.id, r.v) for r in joins.asof_many(probes, snapshots, "k", "at", "id", ["v"]).orderBy("id").collect()] == [(7, None), (8, "a"), (9, "b")]


def test_upsert_ops(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id long, v string")
    b = spark.createDataFrame([(1, "y"), (2, "n"), (4, "w")], "id long, v string")
    got = lambda **k: {r.id: (r.v, r.op) for r in incremental.upsert(a, b, "id", ["v"], **k).collect()}
    assert got() == {1: ("y", "U"), 2: ("n", "U"), 3: ("z", "="), 4: ("w", "I")}
    assert got(fill_only=True) == {1: ("x", "="), 2: ("n", "U"), 3: ("z", "="), 4: ("w", "I")}


def test_links_become_absolute(spark):
    html = '<a href="/x.pdf">A <b>b</b></a><a href="y?z=1">c</a><a href="//o/q">d</a><a>none</a><iframe src="https://youtu.be/abcdefghijk"></iframe>'
    got = links.anchors(spark.createDataFrame([(1, "https://h/p/index.html?k", html), (2, "https://h", None)], "id long, url string, html string")).orderBy("position").collect()
    assert [(r.target, r.link_text) for r in got] == [("https://h/x.pdf", "A b"), ("https://h/p/y?z=1", "c"), ("https://o/q", "d"), ("https://youtu.be/abcdefghijk", "")]
