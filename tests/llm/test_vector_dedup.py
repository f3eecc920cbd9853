"""Links and components against all pairs, with blocks that are small beside the groups."""

import numpy as np
import pytest

from corpusloom.llm import graph, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string, links long, kind string, block int, salt int, class string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "n", 1, "k", 2, 3, "c") for i, v, y in rows], SCHEMA)


def brute(rows, similarity=0.93):
    """(vec_id, links, component) by row, over all pairs."""
    ok = [i is not None and y is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, y in rows]
    at = [k for k, good in enumerate(ok) if good]
    links, name = [0] * len(rows), [r[0] for r in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for n, a in enumerate(at):
        for b in at[n + 1 :]:
            x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= similarity:
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    for k in at:
        name[k] = min(rows[j][0] for j in at if top(j) == top(k))
    return [(r[0], n, c) for r, n, c in zip(rows, links, name)]


def vectors(rng, n, spread, dim=16, groups=1):
    centres = rng.standard_normal((groups, dim))
    return [[float(np.float32(x)) for x in centres[i % groups] + spread * rng.standard_normal(dim)] for i in range(n)]


@pytest.mark.parametrize("block", [8, 512])
def test_edges_and_groups_equal_all_pairs(spark, monkeypatch, block):
    for name, value in (("BLOCK", block), ("BLOCKS", 2), ("CHUNK", 3 * block)):
        monkeypatch.setattr(vector_dedup, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, v, 1) for i, v in enumerate(vectors(rng, 150, 0.05))]  # one large group of near copies
    rows += [(200 + i, v, i % 3) for i, v in enumerate(vectors(rng, 90, 0.03, groups=25))]
    rows += [(300 + i, v, i % 3) for i, v in enumerate(vectors(rng, 60, 1.0))]
    rows += [(400 + i, rows[5][1], 1) for i in range(20)] + [(430, [2 * x for x in rows[5][1]], 1), (431, rows[5][1], 2), (5, rows[5][1], 1), (5, rows[200][1], 2)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0], [2.0], [1.0, 2.0], [1e30, 1e30], [1e-40, 1e-40]]
    rows += [(500 + i, v, 1) for i, v in enumerate(odd)] + [(None, rows[5][1], 1), (520, rows[5][1], None), (521, rows[5][1], None)]
    got = vector_dedup.near_vectors(table(spark, rows), recall=0.9999999 if block == 8 else 0.98).collect()
    want = brute(rows)
    assert sorted(map(repr, ((r.vec_id, r.n_links, r.component_id) for r in got))) == sorted(map(repr, want))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert {w[1] for w in want} >= {0, 1} and max(w[1] for w in want) > 150


def test_recall_at_the_similarity(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((400, 32))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = 0.932 * base + np.sqrt(1 - 0.932**2) * side
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.r_[base, near])]
    found = vector_dedup.near_vectors(table(spark, rows)).filter("vec_id >= 400 and component_id = vec_id - 400 and n_links = 1").count()
    assert found >= 0.96 * 400  # RECALL is 0.98
    none = vector_dedup.near_vectors(table(spark, rows), similarity=0.94).agg({"n_links": "sum"}).first()[0]
    assert none == 0


def test_empty_table_and_very_long_vectors(spark):
    rows = [(i, [float(i % 2)] * 20_000 + [1.0], 0) for i in range(4)]
    assert vector_dedup.near_vectors(table(spark, rows).limit(0)).count() == 0
    assert {(r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_vectors(table(spark, rows)).collect()} == {(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1)}


def test_components_with_hubs_and_chains(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001), (2001, 2000), (1500, 299)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in [*range(300), 1500]} == {0} and {got[i] for i in range(1000, 1061)} == {1000} and got[2001] == 2000
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
