"""The rules that name, class, date and shorten, on the cases that they were made for."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import expressions as fn
from corpusloom.operators import textsearch


def each(spark, column, cases, schema):
    """Results in the order of the cases."""
    rows = spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)], f"i int, {schema}")
    return [r.out for r in rows.select("i", column.alias("out")).orderBy("i").collect()]


def test_file_names(spark):
    cases = {
        ("https://example.com/board/2026-01_minutes.pdf", ""): "2026-01_minutes.pdf",
        ("https://example.com/agendas/april.docx", ""): "april.docx",
        ("https://example.com/files/report.pdf?download=1", ""): "report.pdf",
        ("https://t.gov/DocumentDownload.ashx?id=4567", "March 2026 Board Materials"): "March-2026-Board-Materials.pdf",
        ("https://example.com/reports/2026-q1/DocumentDownload.ashx", ""): "2026-q1.pdf",
        ("https://example.com/files/Default.aspx?id=7", "January Investment Committee"): "files.pdf",
        ("https://h/governance/boarddocs/15-2025-acfr/open", "2025 ACFR"): "15-2025-acfr.pdf",
        ("https://example.com/reports/q1-board-pack/download", ""): "q1-board-pack.pdf",
        ("https://example.com/files/2026-budget/view", None): "2026-budget.pdf",
        ("https://example.com/files/april-board", ""): "april-board.pdf",
        ("https://example.com/files/april-board", "April Board Pack april-board.docx"): "april-board.docx",
        ("https://example.com/a/réunion d'été", ""): "réunion-d-été.pdf",
        ("https://example.com/get.ashx", ""): None,
    }
    got = each(spark, fn.make_filename("url", "said"), list(cases), "url string, said string")
    for (url, _), want, name in zip(cases, cases.values(), got):
        assert name == want if want else len(name) == 16 and "get" not in name, url


def test_titles_of_meetings(spark):
    yes = ["Board Meeting", "BOARD  OF TRUSTEES", "Investment Committee - May", "Audit committee", "Regular Meeting", "Special\tmeeting", "Trustee Meeting", "Retirement Board", "public meeting"]
    no = ["Quick Tip: Plan Benefits", "", None, "Board of Regents", "Meeting", "Town hall"]
    assert each(spark, fn.title_match("t"), yes + no, "t string") == [True] * len(yes) + [False] * len(no)


def test_fiscal_years(spark):
    cases = {
        "For the fiscal year ended June 30, 2024. Copyright 2026": 2024, "For Fiscal Year Ending December 31 2023": 2023, "Fiscal Year 2024 outlook to 2031": 2024, "FY2022 and FY 2023": 2022,
        "2022 ACFR, target 2030": 2022, "ACFR 2021, in 2025": 2021, "Comprehensive Annual\nFinancial Report for 2020 and 2024": 2020, "Fiscal year 2095, then 2018": 2018, "2017, 2019 and 2045": 2019,
        "none": None, None: None, "x" * 5000 + " 2015": None, "120241": None,
    }
    assert each(spark, fn.fiscal_year_text("t", 2000, 2027), list(cases), "t string") == list(cases.values())


def test_errors_and_blocks(spark):
    cases = {
        "ERROR: [youtube] X: Video unavailable. This content isn't available, try again later. The current session has been rate-limited.": "transient",
        "ERROR: [youtube] 4ewaCzzm3r0: Video unavailable": "gone", "Private video. Sign in if you've been granted access": "gone", "This video has been removed by the uploader": "gone",
        "HTTP Error 500: Internal Server Error": "transient", "": "transient", None: "transient",
    }
    assert each(spark, fn.error_class("m"), list(cases), "m string") == list(cases.values())
    blocks = {
        (403, "Just a moment..."): "HTTP 403 (Cloudflare 'Just a moment' challenge)", (429, "hello"): "HTTP 429 (no WAF fingerprint, but blocked status)", (503, None): "HTTP 503 (no WAF fingerprint, but blocked status)",
        (200, "access denied"): None, (404, "akamai"): None, (403, "x" * 4000 + "datadome"): "HTTP 403 (no WAF fingerprint, but blocked status)",
    }
    assert each(spark, fn.block_detect("s", F.lit(None).cast("map<string,string>"), "b"), list(blocks), "s int, b string") == list(blocks.values())
    assert each(spark, fn.block_detect(F.lit(403), F.create_map(F.lit("Server"), "h"), F.lit("")), ["AkamaiGHost"], "h string") == ["HTTP 403 (Akamai bot mitigation)"]


def test_tiers_and_skips(spark):
    texts = ["investment " * 900, "investment " * 1900, "x" * 4990 + " risk" + "y" * 16_000, "x" * 5000 + " risk" + "y" * 16_000, "private-equity" + "z" * 20_000, None]
    assert each(spark, fn.route_by_size("t"), texts, "t string") == ["small", "large", "large", "small", "large", "small"]
    cases = {(" " * 200 + "x" * 99, "a.pdf"): "insufficient text", ("x" * 100, "Meeting Calendar.pdf"): "non-substantive filename (Meeting Calendar.pdf)", ("x" * 100, "notice only.pdf"): "non-substantive filename (notice only.pdf)", ("x" * 100, "board.pdf"): None, ("x" * 100, None): None, (None, "board.pdf"): "insufficient text"}
    assert each(spark, fn.skip_reason("t", "n"), list(cases), "t string, n string") == list(cases.values())


def test_previews(spark):
    prose = "A sentence of some length, said again and again. " * 20
    cases = {
        "# T\n\n*Generated: 2026-05-02*\n\n---\n\nBody **here**.": "Body here.",
        "# T\nintro\n## TL;DR\n\n- one\n- two\n\n## Next\nmore": "one\ntwo",
        "# T\n## summary\nshort\n": "short",
        "## Findings\ntext": "Findings\ntext",
        "": "", None: "",
        "x" * 800: "x" * 700 + " …",
        "\n\n# Only a title": "",
    }
    assert each(spark, fn.preview("t"), list(cases), "t string") == list(cases.values())
    [cut] = each(spark, fn.preview("t"), [prose], "t string")
    assert cut.endswith("again. …") and 420 < len(cut) <= 703
    [early] = each(spark, fn.preview("t"), ["Short one. " + "y" * 900], "t string")
    assert early == ("Short one. " + "y" * 900)[:700] + " …"


def test_periods_cuts_and_paths(spark):
    periods = {(date(2026, 4, 26), date(2026, 5, 2)): "Apr 26 – May 2, 2026", (date(2026, 5, 3), date(2026, 5, 9)): "May 3–9, 2026", (date(2025, 12, 28), date(2026, 1, 3)): "Dec 28, 2025 – Jan 3, 2026"}
    assert each(spark, fn.period_label("a", "b"), list(periods), "a date, b date") == list(periods.values())
    assert [tuple(x) for x in each(spark, fn.truncate_words("t", 2), ["a  b", " a\nb c", ""], "t string")] == [("a  b", False), ("a b…", True), ("", False)]
    assert each(spark, fn.excerpt("t", 3), ["\nab\n", "ab cd", None, "a\nbc"], "t string") == ["ab", "ab…", "", "a b…"]
    paths = {("plan x", "v/1", date(2024, 1, 5), None): "plan_x/2024-01-05_v1.mp4", ("../..", "é", None, date(2024, 2, 1)): "..../2024-02-01_x.mp4", ("p", "1", None, None): "p/undated_1.mp4"}
    assert each(spark, fn.safe_path("e", "k", "m", "p", F.lit(".mp4")), list(paths), "e string, k string, m date, p date") == list(paths.values())
    urls = {("youtube", "a", "r"): "https://www.youtube.com/watch?v=a", ("vimeo", "7", None): "https://vimeo.com/7", ("granicus", "7", "https://r"): "https://r", ("granicus", "7", None): "7", (None, "7", ""): "7"}
    assert each(spark, fn.video_url("p", "k", "r"), list(urls), "p string, k string, r string") == list(urls.values())
    assert each(spark, fn.year_from_url("u", 2027), ["/1999/2031", "/1985", "/12021x", None], "u string") == [1999, None, 2021, None]


@pytest.mark.parametrize("budget", [1100, 1130, 1160])
def test_the_chunk_that_meets_the_budget_is_cut(spark, budget):
    text = "h" * 500 + "a" * 100 + "KEY" + "b" * 200 + "KEY" + "c" * 30 + "KEY" + "d" * 100 + "t" * 500
    [r] = textsearch.keyword_excerpt(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", "KEY", 40, 500, 500, budget).collect()
    middle, chunks, used = text[500:-500], [], 0
    for a, b in ((80, 120), (283, 356)):
        chunk = middle[a:b]
        if used + len(chunk) > budget - 1000:
            chunks.append(chunk[: budget - 1000 - used])
            break
        chunks.append(chunk)
        used += len(chunk)
    mark = "\n\n[...]\n\n"
    assert r.excerpt == "h" * 500 + mark + mark.join(chunks) + mark + "t" * 500


def test_a_lone_hit_behind_the_front_matter(spark):
    pages = [(1, p, "Net  Pension\nLiability" if p in (2, 30) else "x") for p in range(1, 61)]
    pages += [(2, 1, "net pension liability")] + [(3, p, "net pension liability" if p in (12, 50) else "") for p in range(1, 61)]
    got = textsearch.phrase_span(spark.createDataFrame(pages, "id long, page int, text string"), "id", "net pension liability", 3, 20, 10)
    assert {(r.id, r.first, r.last) for r in got.collect()} == {(1, 27, 33), (2, 1, 1), (3, 12, 31)}
