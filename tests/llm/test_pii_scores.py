"""The graph's scores against plain loops, and an identifier of a listed kind that only its contexts tell."""

import math
import random
import re
from collections import defaultdict

from corpusloom.llm import pii
from tests.llm.test_operators import docs


def fits(value):
    digits = len(re.sub("[^0-9]", "", value))
    return [k for k, ok in {
        "email": "@" in value, "ip": re.search(r"^[0-9a-fA-F]+([.:]+[0-9a-fA-F]+){3,}$", value), "card": re.search(r"^[0-9][0-9 .:/-]*$", value) and 12 <= digits <= 19,
        "phone": re.search(r"^[+(0-9][0-9 ().:/-]*$", value) and 7 <= digits <= 15, "secret": len(value) >= 16 and re.search("[0-9]", value) and re.search("[A-Za-z]", value) and "@" not in value,
    }.items() if ok]


def brute(rows, min_seeds, confident, rounds):
    edges = {}
    for _, _, _, _, kind, value, pattern in rows:
        edges[pattern, value] = min(kind, edges.get((pattern, value), kind))
    total, seeds = defaultdict(int), defaultdict(int)
    for (pattern, _), kind in edges.items():
        total[pattern] += 1
        if kind != "token":
            seeds[pattern, kind] += 1
    known = {k: n for k, n in seeds.items() if n >= min_seeds}
    graph = {(p, v, k): 0.0 for (p, v), kind in edges.items() if kind == "token" for k in fits(v) if (p, k) in known}
    sure = {}
    for _ in range(rounds):
        sure = {pk: min(round((known[pk] + sum(s for (p, _, k), s in graph.items() if (p, k) == pk)) / total[pk[0]], 9), 1.0) for pk in {(p, k) for p, _, k in graph}}
        scores = defaultdict(float)
        for p, v, k in graph:
            scores[v, k] += math.log(max(1 - sure[p, k], 1e-12))
        graph = {(p, v, k): round(1 - math.exp(scores[v, k]), 9) for p, v, k in graph}
    accepted = {}
    for (p, v, k), s in graph.items():
        if sure[p, k] >= confident and s >= confident:
            accepted[p, v] = max(accepted.get((p, v), (0, "")), (s, k))
    found = defaultdict(set)
    for doc, key, start, end, kind, value, pattern in rows:
        if kind == "token" and (pattern, value) in accepted:
            found[doc, key, start, end].add(accepted[pattern, value][1])
        if kind == "secret" and (pattern, "secret") in known and sure.get((pattern, "secret"), known[pattern, "secret"] / total[pattern]) >= confident:
            found[doc, key, start, end].add("secret")
    return {(*k, min(v)) for k, v in found.items()}


def test_scores_equal_plain_loops(spark):
    schema = "doc_id long, key long, start long, end long, kind string, value string, pattern string"
    sizes = []
    for seed in range(3):
        rng = random.Random(seed)
        tokens = [f"{rng.randrange(10**7, 10**9)}" for _ in range(12)] + [f"x{i}@y" for i in range(5)] + [f"{i}.{i}.3.4" for i in range(4)] + [f"{rng.getrandbits(128):032X}" for _ in range(5)] + ["4000 1234 5678 901"]
        own = {"email": [f"a{i}@b.c" for i in range(6)], "phone": [f"+1 555 010 00{i}" for i in range(6)], "secret": [f"{rng.getrandbits(128):032x}" for _ in range(6)], "card": [f"411111111111111{i}" for i in range(3)]}
        rows = []
        for i in range(160):
            kind = rng.choice(["token", "token", *own])
            # patterns lean to a kind, so that some are confident and some are not
            at = {"email": 0, "phone": 1, "secret": 2, "card": 3}.get(kind, rng.randrange(6))
            pattern = f"p{at if rng.random() < 0.85 else rng.randrange(6)}"
            rows.append((i % 40, i % 40, i, i + 9, kind, rng.choice(tokens if kind == "token" else own[kind]), pattern))
        for confident in (0.3, 0.55, 0.8):
            want = brute(rows, 3, confident, 3)
            got = {tuple(r) for r in pii._discovered(spark.createDataFrame(rows, schema), 3, confident, 3).select("doc_id", "key", "start", "end", "kind").collect()}
            assert got == want, (seed, confident)
            sizes.append(len(want))
    assert len(set(sizes)) > 3 and max(sizes) > 20 and {k[-1] for k in want} | {"secret"}


def test_identifiers_without_a_base_form_are_found_by_their_contexts(spark):
    """Phone numbers without a plus, addresses without a dot, and cards that fail the check digit, each where others of their kind stand."""
    rows = []
    for i in range(12):
        rows.append((3 * i, f"Please call me under (number: +1 555 010 {1000 + i}) soon. " * (i < 9) + f"Please call me under (number: 020 7946 {1000 + i}) soon." * (i >= 9)))
        rows.append((3 * i + 1, f"send it by mail to <box{i}@example.org> today" if i < 9 else f"send it by mail to <box{i}@intranet> today"))
        rows.append((3 * i + 2, f"paid with card no. 411111111111111{1} yesterday {i}" if i < 9 else f"the room {i}234 5678 is free"))
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if (s.start, s.kind) not in {(b.start, b.kind) for b in r.base}] for r in pii.find_pii(docs(spark, rows)).collect()}
    text = dict(rows)
    assert {(d, k, text[d][a:b]) for d, spans in found.items() for k, a, b in spans} >= {(27 + 3 * j, "phone", f"020 7946 {1009 + j}") for j in range(3)} | {(28 + 3 * j, "email", f"box{9 + j}@intranet") for j in range(3)}
    assert not any(found[29 + 3 * j] for j in range(3))
