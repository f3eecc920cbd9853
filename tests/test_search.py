"""Stems, the query grammar, ranked phrases and pruned ranking, against known stems and plain loops."""

import math
import random

import pytest

from corpusloom.functions.english import STOP_WORDS, stem
from corpusloom.operators import searchindex as search

STEMS = """running run ponies poni caresses caress hopping hop hoping hope relational relat conditional condit investments invest investing invest
management manag managers manag happy happi dying die skies sky agreed agre plastered plaster falling fall triplicate triplic electrical electr
adjustment adjust adoption adopt communication communic general general generously generous policies polici allocation alloc retirement retir
equities equiti quarterly quarter consistency consist knackeries knackeri kneel kneel gas gas gaps gap kiwis kiwi bled bled national nation
exceeding exceed universities univers controlling control beautiful beauti decisions decis ties tie cries cri feed feed daily daili by by
votes vote voted vote voting vote boards board été été 2024s 2024s""".split()


def test_stems():
    assert [(w, stem(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2]))
    assert "the" in STOP_WORDS and len(STOP_WORDS) == 127


def test_any_text_is_a_query():
    clauses = search.web_clauses('board -"hedge fund" or equity OR "open phrase')
    assert clauses == [([["board"]], [["hedge", "fund"]]), ([["equity"]], []), ([["open", "phrase"]], [])]
    assert search.web_clauses("a-b -c-d") == [([["a", "b"]], [["c", "d"]])]
    for odd in (None, "", " ", '"', '""', "-", "--", "or", "or or", '-"', "(*:^)", "' OR 1=1 --", '"a "b" c"', "\\", "& | !", "- or -"):
        for required, excluded in search.web_clauses(odd):
            assert required or excluded
    assert search.plain_query('star* colon:value (a-b) "').slots == [["star"], ["colon"], ["value"], ["a"], ["b"]]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    forms = "vote votes voting board boards fund funds funding pension pensions the of and equity equities hedge manager managed".split()
    rows = [(i, " ".join(rng.choice(forms) for _ in range(rng.randrange(0, 14))), rng.choice(["fund vote", "", None, "board"]), "ab"[i % 2], None if i % 5 == 0 else i % 9) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string, topics string, plan string, day int")
    return rows, docs, search.save_index(docs, str(tmp_path_factory.mktemp("index")), "id", "text", "topics")


def tokens(row):
    """(place, word) of both columns, the second one after a gap."""
    one, two = ((t or "").split() for t in row[1:3])
    return [*enumerate(one), *((len(one) + search._GAP + i, w) for i, w in enumerate(two))]


def holds(row, phrase):
    """First and last place of each hit of a phrase of (stem, distance)."""
    at = {p: stem(w) for p, w in tokens(row)}
    return [(p, p + phrase[-1][1]) for p in at if all(at.get(p + d) == s for s, d in phrase)]


def density(row, phrases):
    hits = [holds(row, p) for p in phrases]
    if not all(hits):
        return None
    spans = []
    for end in sorted({e for h in hits for _, e in h}):
        starts = [max((s for s, e in h if e <= end), default=None) for h in hits]
        if None not in starts:
            spans.append((min(starts), end))
    best = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    words = sum(len(p) for p in phrases)
    return sum(0.1 / (1 + max(e - s + 1 - words, 0)) for s, e in best)


def test_ranked_web_search_equals_plain_loops(spark, corpus):
    rows, docs, index = corpus
    for text, alternatives in {
        "voting boards": [([[("vote", 0)], [("board", 0)]], [])],
        '"voted of the board"': [([[("vote", 0), ("board", 3)]], [])],
        'managers -"pension fund" or "hedge funds" -vote': [([[("manag", 0)]], [[("pension", 0), ("fund", 1)]]), ([[("hedg", 0), ("fund", 1)]], [[("vote", 0)]])],
        "equity the equities": [([[("equiti", 0)]], [])],
        "fund vote pension": [([[("fund", 0)], [("vote", 0)], [("pension", 0)]], [])],
        "-fund": [([], [[("fund", 0)]])],
        "the of": [],
        "nothing like it": None,
    }.items():
        want = {}
        for r in rows if alternatives else []:
            scores = [density(r, req) if req else 0.0 for req, exc in alternatives if (not req or density(r, req) is not None) and not any(holds(r, p) for p in exc) and tokens(r)]
            if scores:
                want[r[0]] = max(scores)
        got = search.search_web(index, text, None, docs, "id", date="day").collect()
        assert {r.key: pytest.approx(r.score, abs=1e-5) for r in got} == want, text
        order = [(-r.score, r.date is None, -(r.date or 0), r.key) for r in got]
        assert order == sorted(order)
        assert search.count_matches(index, search.web_query(index, text)).first().n == len(want)
        assert {r.key for r in search.search_web(index, text, None, docs, "id", "plan", "a").collect()} == {k for k in want if k % 2 == 0}


def test_pruned_ranking_equals_scoring_everything(spark, corpus, tmp_path, monkeypatch):
    rows, docs, _ = corpus
    monkeypatch.setattr(search, "SEGMENT", 8)
    index = search.save_index(docs.repartition(1), str(tmp_path / "small"), "id", "text", "topics")
    n, average = sum(bool(tokens(r)) for r in rows), sum(len(tokens(r)) for r in rows) / sum(bool(tokens(r)) for r in rows)
    assert (index.n_docs, round(index.average, 9)) == (n, round(average, 9))
    read, plain = [], search.matching
    monkeypatch.setattr(search, "matching", lambda i, q, s=None: read.append(s.count()) or plain(i, q, s))
    for text, parts in {"vote fund": [["vote"], ["fund"]], "pension": [["pension"]], "the-of vote": [["the", "of"], ["vote"]], "hedge absent": [["hedge"], ["absent"]]}.items():
        hits = []
        for p in parts:
            at = {r[0]: {q: w for q, w in tokens(r)} for r in rows}
            hits.append({d: k for d, own in at.items() if (k := sum(all(own.get(q + j) == w for j, w in enumerate(p)) for q in own))})
        want = {}
        for r in rows:
            if all(r[0] in h for h in hits):
                size = len(tokens(r))
                want[r[0]] = round(sum(max(math.log((n - len(h) + 0.5) / (len(h) + 0.5)), 1e-6) * h[r[0]] * 2.2 / (h[r[0]] + 1.2 * (0.25 + 0.75 * size / average)) for h in hits), 12)
        for entity, limit, first in ((None, 10, 2), ("a", 10, 3), (None, 1000, 2), (None, 5, 1000)):
            monkeypatch.setattr(search, "FIRST", first)
            mine = search.search_bm25(index, text, limit, docs, "id", "plan", entity, "day").collect()
            order = sorted((k for k in want if entity is None or k % 2 == 0), key=lambda k: (-want[k], rows[k][4] is None, -(rows[k][4] or 0), k))[:limit]
            assert [(r.key, r.score) for r in mine] == [(k, pytest.approx(want[k], abs=2e-6)) for k in order], (text, entity, limit)
    assert search.search_bm25(index, " ", 5).count() == 0 and search.search_bm25(index, "*()", 5, docs, "id", date="day").count() == 0


def test_few_segments_are_read_where_lengths_differ(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SEGMENT", 8)
    monkeypatch.setattr(search, "FIRST", 2)
    docs = spark.createDataFrame([(i, "vote " * (i % 4 == 0) + "filler " * (1 + i % 100)) for i in range(400)], "id long, text string").repartition(1)
    index = search.save_index(docs, str(tmp_path / "index"), "id", "text")
    read, plain = [], search.matching
    monkeypatch.setattr(search, "matching", lambda i, q, s=None: read.append(s.count()) or plain(i, q, s))
    assert [r.key for r in search.search_bm25(index, "vote", 3).collect()] == [0, 100, 200]
    assert read[0] == 2 and read[1] <= 4 and index.blocks.select("segment").distinct().count() == 50
