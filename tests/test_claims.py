"""Claims against a plain search, short and many, and what the plan moves."""

import random

from corpusloom.operators import claims


def test_equals_a_plain_search(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, "", "AUM of $1.2 Billion", "x" * 1_200_000 + "end of it"]
    rows = [(f"c{i}", [word() if i % 3 else f"{word()} {word()}", (texts[i % 80] or "")[5 : 5 + i % 40].upper()]) for i in range(400)]
    rows += [("none", []), ("null", None), ("blank", ["", None]), ("money", ["$9", "$1.2 billion"]), ("end", ["END OF IT"]), ("one", ["$"]), ("across", ["it" + (texts[0] or "")]), ("twice", ["zzz"]), ("twice", ["end"])]
    table = spark.createDataFrame(rows, "claim string, variants array<string>")
    corpus = spark.createDataFrame([(t, 1) for t in texts], "body string, claim int")
    got = {r.claim: r.supported for r in claims.claim_check(table, "claim", "variants", corpus, "body").collect()}
    want = {}
    for c, vs in rows:
        want[c] = want.get(c, False) or any(v and any(t is not None and v.lower() in t.lower() for t in texts) for v in vs or [])
    assert got == want and set(want.values()) == {True, False}


def test_no_text_is_moved(spark):
    table = spark.createDataFrame([("a", ["x"]), ("b", ["two words of it"])], "claim string, variants array<string>")
    corpus = spark.createDataFrame([("x y",)], "body string")
    out = claims.claim_check(table, "claim", "variants", corpus, "body")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # what is exchanged below the join are digests and claims
    assert all(c not in plan.split("MapInArrow")[0] for c in ("body",))


def test_very_many_claims(spark):
    """100,000 claims over two texts: the broadcast tables stay as they are."""
    rows = spark.range(100_000).selectExpr("cast(id as string) as claim", "array(concat('claim number ', id, ' of many')) as variants")
    corpus = spark.createDataFrame([("It holds Claim Number 77 of many and claim number 99999 of many.",), ("claim number 5 of",)], "body string")
    out = claims.claim_check(rows, "claim", "variants", corpus, "body")
    assert sorted(r.claim for r in out.filter("supported").collect()) == ["77", "99999"] and out.count() == 100_000
