"""The transformation against a plain loop, and on every kind of text."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import fill_in_middle as fim
from tests.llm.test_operators import docs

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_equals_a_plain_loop_and_restores(spark):
    rng = random.Random(5)
    odd = [" ", "\t\n ", "a", " a", "a ", "é ü x  \x0b y", "<", "<<P", "P><S", "M> <", "<S", "\x00 \x00", "\U0001f600 \U0001f600"]
    rows = [(i, "".join(rng.choice(odd + ["word ", "\r\n", "été ", "<S", ">"]) for _ in range(rng.randrange(0, 30)))) for i in range(300)]
    rows += [(400 + i, t) for i, t in enumerate(odd)] + [(500, None), (501, ""), (502, "a <P> b"), (503, "x<M>"), (None, "no id at all"), (None, None)]
    rows += [(504, "long word\n" * 200_000), (505, "x" * 1_500_000), (506, " " * 1_200_000), (7, "again the same id"), (7, "again the same id")]
    made = fim.fill_in_middle(docs(spark, rows)).withColumn("back", fim.restored("output", "form"))
    got = made.collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(brute(*r) for r in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((d, t or "") for d, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_parameters_and_empty_table(spark):
    rows = docs(spark, [(i, f"one two three {i}") for i in range(200)])
    assert {r.form for r in fim.fill_in_middle(rows, rate=100, spm_rate=0).collect()} == {"psm"}
    assert {r.form for r in fim.fill_in_middle(rows, rate=0).collect()} == {"plain"}
    assert fim.fill_in_middle(rows, seed=1).exceptAll(fim.fill_in_middle(rows)).count() > 20
    assert fim.fill_in_middle(rows.limit(0)).count() == 0
    plan = fim.fill_in_middle(rows).select(F.col("form"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
