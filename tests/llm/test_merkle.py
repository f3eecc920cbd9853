"""Trees, proofs and tampering against a plain recursion over runs of two."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rank int, tree string, path string, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def ways(nodes):
    """(root, for each node its [(is right, sibling or None)]) of a list of digests."""
    at, found = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for way, p in zip(found, at):
            way.append((p % 2 == 1, nodes[p ^ 1] if p ^ 1 < len(nodes) else None))
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [p // 2 for p in at]
    return nodes[0], found


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    order = sorted(trees, key=str.encode)
    for t in order:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    low = {t: ways([leaf(r) for r in trees[t]]) for t in order}
    root, high = ways([low[t][0] for t in order])
    out = Counter()
    for t, above in zip(order, high):
        for r, way in zip(trees[t], low[t][1]):
            way = way + above
            own = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                own[4] += 1
            fold = leaf(own)
            for right, sibling in way:
                fold = h(sibling, fold) if right else h(fold, sibling or "")
            out[r[0], leaf(r), low[t][0], root, h(*(s for _, s in way if s)), fold, fold == root] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "t", "p", "l") for r in rows], SCHEMA)


def result(docs):
    found = merkle.proofs(merkle.build(docs)).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof"), merkle.folded("tampered").alias("fold"))
    return Counter(tuple(r) for r in found.withColumn("ok", F.col("fold") == F.col("root")).collect())


def made(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i * 3, f"text {rng.random()} é\n", rng.choice(langs), rng.choice(["a", None, ""]), rng.randrange(99)) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [2, 8])
def test_equals_a_plain_recursion(spark, monkeypatch, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    rows = made(75, ["en", "fr", None, "", "é"])
    rows += [(7, None, "en", "s", None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (None, "x", "en", None, 1), (0, "a", "zz", "s", 1), (14, "b" * 300_000, "fr", "s", 2**63 - 1)]
    got = result(table(spark, rows))
    assert got == brute(rows) and {k[-1] for k in got} == {True, False}


def test_trees_of_many_records_and_of_one_leaf(spark):
    rows = made(1500, ["en"], 2) + made(256, ["b"], 3) + made(257, ["c"], 4) + [(1, "t", f"l{i}", "s", 1) for i in range(300)]
    assert result(table(spark, rows)) == brute(rows)
    assert result(table(spark, rows[:1])) == brute(rows[:1])
    assert result(table(spark, rows).limit(0)) == Counter()


def test_requests_are_answered_from_the_records_alone(spark):
    rows = made(700, ["en", "fr"])
    built = merkle.build(table(spark, rows))
    every = {(r.tree, r["rank"]): r for r in merkle.proofs(built).collect()}
    asked = [(t, k) for t, k in sorted(every) if k in (0, 3, 255, 256, 300)] + [("=en", 9999), ("=xx", 0)]
    requests = spark.createDataFrame([(t, k, f"{t}{k}") for t, k in asked], "tree string, rank long, note string")
    got = merkle.proofs(built, requests).collect()
    assert {(r.tree, r["rank"], r.note) for r in got} == {(t, k, f"{t}{k}") for t, k in asked if (t, k) in every}
    for r in got:
        own = every[r.tree, r["rank"]]
        assert (r.leaf, r.path, r.root, r.subroot) == (own.leaf, own.path, own.root, own.subroot)
    # a record's digest is that of its children, hashed level by level
    for record in built.records[0].collect():
        nodes = record.children
        for _ in range(record.height):
            nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        assert nodes == [record.digest]
