"""Hand-worked and brute-force versions of the trained operators, their samples, and nulls, ties and long texts in the stages."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import byte_quality, language_id, near_dedup, pii, shared, textarrays, toxicity, url_filter
from tests.llm.test_operators import DOCS, docs, words

# --- folds and samples


def test_fold_is_crc32_of_the_decimal_text(spark):
    ids = [0, 1, 7, 10, 123456789, -5, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", shared.fold("doc_id", 5).alias("f")).collect()
    assert {r.doc_id: r.f for r in rows} == {i: None if i is None else zlib.crc32(str(i).encode()) % 5 for i in ids}


def test_labelled_sample(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(7, "aaa"), (7, "zzz"), (500, None), (None, "x"), (501, "".join(chr(97 + i // 1000) for i in range(10_000)))]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "t") for i in [*range(400), 500, 501]] + [(None, 1, "t")] + [(3, None, "t"), (9, 5, "t")], "doc_id long, toxic int, text string")
    sample = shared.labelled_sample(docs(spark, rows), labels, "toxic", 5, 0, 60)
    every = shared.labelled_sample(docs(spark, rows), labels, "toxic", 5, 0, 10_000)
    texts = [t for t, _, _ in every]
    wanted = {i for i in [*range(400), 501] if zlib.crc32(str(i).encode()) % 5}
    assert len(texts) == len(set(texts)) == len(wanted)  # no held-out row, no null text, each doc_id once
    assert {t for t in texts if t.startswith("text ")} == {f"text {i}" for i in wanted if i not in (7, 501)} and ("aaa" in texts) == (7 in wanted)
    long = [t for t in texts if len(t) > 100]
    assert (501 in wanted) == bool(long) and all(t == rows[-1][1] for t in long)  # whole, however long
    of = Counter(y for _, y, _ in sample)
    assert 10 <= of[0] <= 50 and 10 <= of[1] <= 50
    share = sum(w for _, y, w in sample if y) / sum(w for _, _, w in sample)
    assert abs(share - sum(i % 4 == 0 for i in wanted) / len(wanted)) < 0.02
    assert shared.labelled_sample(docs(spark, rows), labels.limit(0), "toxic", 5, 0, 60) == []


# --- 5


def test_naive_bayes_scores_by_hand():
    texts = ["abab", "", "bca"]
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, (language_id.BUCKETS, 3)).astype(float)
    model = language_id.NaiveBayes(["x", "y", "z"], counts, np.array([1.0, 2.0, 5.0]))
    best, top, total = model.predict(texts)
    score = np.exp(np.array(top) - total)
    sums = [[math.log(n / 8) for n in (1, 2, 5)] for _ in texts]
    totals = (counts + language_id.SMOOTHING).sum(0)
    for buckets, rows in language_id._grams(texts):
        for b, r in zip(buckets, rows, strict=True):
            for j in range(3):
                sums[r][j] += math.log((counts[b, j] + language_id.SMOOTHING) / totals[j])
    for i, s in enumerate(sums):
        assert best[i] == s.index(max(s)) and abs(score[i] - 1 / sum(math.exp(x - max(s)) for x in s)) < 1e-4


@pytest.mark.parametrize("block", [1, 2, 4])
def test_languages_in_blocks_equal_one_matrix(spark, monkeypatch, block):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 20, 30)) + " " + x * 3, x) for i, x in enumerate(rng.choice("abcdefg") for _ in range(150))] + [(900, None, "a"), (901, "123", "b")]
    table = docs(spark, rows)
    whole = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(table, table).collect()}
    monkeypatch.setattr(language_id, "BLOCK", block)
    parts = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(table, table).collect()}
    assert {d: x for d, (x, _) in whole.items()} == {d: x for d, (x, _) in parts.items()}
    assert all(abs(parts[d][1] - s) < 1e-6 for d, (_, s) in whole.items()) and parts[900] == parts[901] == ("und", 0.0)


def test_a_thousand_and_one_languages(spark):
    """Each has one row and a word of its own; none is left out."""
    word = lambda i: "".join(chr(0x4E00 + i * 7 + k) for k in range(6))
    table = docs(spark, [(i, f"{word(i)} {word(i)}", f"l{i:04}") for i in range(1001)])
    out = language_id.identify(table, table).collect()
    assert len(out) == 1001 and all(r.lang_pred == r.lang for r in out)
    assert language_id.identify(table.limit(0), table.limit(0)).count() == 0
    assert [r.lang_pred for r in language_id.identify(table.limit(1), table.limit(0)).collect()] == ["und"]


# --- 6


def test_gated_net_by_plain_loops():
    net = toxicity.GatedNet(9)
    text = " ".join(words(random.Random(2), 70)) + " Ünd so"
    v, sigma, k = toxicity.Vocabulary(pa.array([text])), lambda x: 1 / (1 + np.exp(-x)), toxicity.HIDDEN
    inputs = net.embed(v).astype(float)
    p = {n: x.astype(float) for n, x in net.p.items()}
    best = -math.inf
    for start, size in zip(v.window_start, v.window_size, strict=True):
        x = [inputs[v.index[start + i]] for i in range(size)]
        states = []
        for d, order in (("f", range(size)), ("b", range(size - 1, -1, -1))):
            h, out = np.zeros(k), {}
            for t in order:
                a = x[t] @ p[f"w{d}"] + p[f"b{d}"]
                z, r = sigma(a[:k] + h @ p[f"u{d}"][:, :k]), sigma(a[k : 2 * k] + h @ p[f"u{d}"][:, k : 2 * k])
                h = (1 - z) * h + z * np.tanh(a[2 * k :] + (r * h) @ p[f"u{d}"][:, 2 * k :])
                out[t] = h
            states.append(out)
        both = np.array([np.r_[states[0][t], states[1][t]] for t in range(size)])
        weight = np.exp(both @ p["att"])
        best = max(best, float((weight / weight.sum()) @ both @ p["out"] + p["bias"][0]))
    assert abs(net.score(pa.array([text]))[0] - sigma(best)) < 1e-4


# --- 8


def test_byte_net_by_plain_loops_and_gradients():
    net = byte_quality.ByteNet(4)
    net.p = {n: x.astype(float) for n, x in net.p.items()}
    p, texts = net.p, [b"short", bytes(random.Random(3).randrange(256) for _ in range(700)), b""]

    def plain(t):
        blocks = max(1, -(-len(t) // byte_quality.BLOCK))
        padded = t + bytes(blocks * byte_quality.BLOCK + 8 - len(t))
        hit = lambda at: p["emb"][list(padded[at : at + 8])].ravel() @ p["w"]
        most = [np.max([hit(b * byte_quality.BLOCK + 4 * i) for i in range(byte_quality.BLOCK // 4)], axis=0) for b in range(blocks)]
        chunks = [np.maximum(most[c], most[min(c + 1, blocks - 1)]) for c in range(max(1, blocks - 1))]
        hidden = np.tanh(np.maximum(np.array(chunks) + p["b"], 0) @ p["wh"] + p["bh"])
        return 1 / (1 + math.exp(-float(np.r_[hidden.max(0), hidden.mean(0)] @ p["wo"] + p["bo"][0])))

    assert np.allclose(net.score(texts), [plain(t) for t in texts], atol=1e-6)
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = net.score(texts)
        return float(np.mean(-(y * np.log(s) + (1 - y) * np.log(1 - s)) * w))

    g, rng = net._gradients(texts, y, w), np.random.default_rng(0)
    for name in p:
        flat = p[name].reshape(-1)
        hot = np.flatnonzero(np.abs(g[name].reshape(-1)) > 1e-5)
        for i in rng.choice(hot, min(4, len(hot)), replace=False):
            old, e = flat[i], 1e-6
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - g[name].reshape(-1)[i]) < 1e-5 + 0.01 * abs(g[name].reshape(-1)[i]), name


# --- 7


def test_vocabulary_table(spark):
    table = spark.createDataFrame([("Mild", 0.5, 1), ("mild", 1.5, 1), ("hard", 2.0, 1), ("", 9.0, 1), (None, 9.0, 1), ("void", None, 1), ("low", -1.0, 1), ("weak", 0.5, 1)], "term string, weight double, url int")
    terms = url_filter.vocabulary(table)
    assert terms == {"mild": 1.5, "hard": 2.0, "weak": 0.5}
    pages = spark.createDataFrame([(1, "http://a.b/MILD"), (2, "http://a.b/mild-weak"), (3, "http://a.b/hard"), (4, "http://a.b/mild/mild"), (5, None)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, (), terms).collect()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert {r.verdict for r in url_filter.judge(pages, (), {}).collect()} == {"allow"}


# --- 9


def test_near_classes_against_all_weighted_pairs(spark):
    """Classes are the components of all pairs of at least the weighted similarity, over similarities from 0.6 to 1."""
    rng, rows = random.Random(31), []
    for g in range(30):
        base = words(rng, rng.randrange(80, 160), 6000)
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    table = docs(spark, rows)
    weights = near_dedup.document_frequencies(table.select("text"))
    own, hashes, counts = near_dedup.shingles(pa.array([t for _, t in rows]))
    bags = defaultdict(dict)
    for r, h, w in zip(own, hashes, weights(hashes, counts), strict=True):
        bags[r][h] = float(w)

    def similarity(a, b):
        least = sum(min(w, b[h]) for h, w in a.items() if h in b)
        return least / (sum(a.values()) + sum(b.values()) - least)

    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bands = Counter()
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(table).collect()}
    for i in range(len(rows)):
        for j in range(i // 8 * 8, i):
            s = similarity(bags[i], bags[j])
            bands[round(s - 0.05, 1)] += 1
            if s >= near_dedup.SIMILARITY:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert min(bands[0.6], bands[0.7], bands[0.8]) > 20
    assert got == {i: find(i) for i in range(len(rows))}


def test_many_nodes_near_the_similarity_are_compared_by_blocks(spark, monkeypatch):
    """One bucket of 120 nodes with blocks of 10: the pairs found are those that one block finds."""
    rng = np.random.default_rng(5)
    base = rng.integers(-128, 128, near_dedup.SKETCH)
    sketch = np.where(rng.random((120, near_dedup.SKETCH)) < 0.9, base, rng.integers(-128, 128, (120, near_dedup.SKETCH)))
    nodes = spark.createDataFrame([(f"{i:03d}".encode(), f"{i:03d}".encode(), 1.0, sketch[i].tolist()) for i in range(120)], "node binary, class binary, weight double, sketch array<tinyint>")
    mixed = lambda n: nodes.select("node", "class", F.lit(0).alias("band"), F.lit(1).cast("long").alias("key"), F.lit(n).alias("n"))
    want = {(bytes(r.a), bytes(r.b)) for r in near_dedup._rest(mixed(120), nodes, 0.8).collect()}
    monkeypatch.setattr(near_dedup, "SPLIT", 10)
    got = {(bytes(r.a), bytes(r.b)) for r in near_dedup._rest(mixed(120), nodes, 0.8).collect()}
    assert got == want and len(want) > 1000


# --- 10


def test_secrets_come_from_their_contexts(spark):
    rng = random.Random(8)
    key = lambda n=40: "a1" + "".join(rng.choice("0123456789abcdef") for _ in range(n - 2))
    rows = [(i, f'lorem {key()[:3]} set token = "{key()}" here') for i in range(8)]
    upper = (20, 'we say token = "' + key().upper() + '" here')
    lone = (21, f"the digest {key(64)} of a file")
    number = [(30 + i, f"call desk: ({200 + i}) 555 01{i}7") for i in range(3)] + [(40 + i, f"call desk: +1 202 555 01{i}{i}") for i in range(20)]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(docs(spark, [*rows, upper, lone, *number])).collect()}
    assert all([k for k, _, _ in found[i]] == ["secret"] for i in range(8)) and found[21] == []
    assert found[20] == [("secret", 16, 56)]
    assert all([k for k, _, _ in found[30 + i]] == ["phone"] and found[30 + i][0][1] == 11 for i in range(3))
    assert all(s in pii.ALL_KINDS for x in found.values() for s, _, _ in x)


def test_a_long_text_costs_little_more_than_its_length(spark):
    import time

    text = "é " + " ".join(f"u{i}@mail.example.com {100000 + i} 10.0.0.{i % 300}" for i in range(12_000))
    table = docs(spark, [(1, text), (2, "x")]).coalesce(1)
    began = time.time()
    found = pii.find_pii(table)
    row = next(r for r in found.collect() if r.doc_id == 1)
    want = [m for i in range(12_000) for m in ["email"] + ["ip"] * (i % 300 < 256)]
    assert [s.kind for s in row.base] == want
    assert all(text[s.start : s.end].startswith("u") for s in row.base if s.kind == "email")
    masked = next(r.text for r in pii.masked(table, found).collect() if r.doc_id == 1)
    assert masked.startswith("é <EMAIL> 100000 <IP> <EMAIL>") and masked.count("<EMAIL>") == 12_000
    assert time.time() - began < 90  # quadratic: many minutes


# --- the stages


NASTY = [(1, "Plain words of some length in a document that has them"), (1, "Plain words of some length in a document that has them"), (2, None), (3, ""), (4, "12 !!"), (None, "a row without an id but with words"), (5, "very long " * 30_000), (6, "mail me at a.b@example.com or not")]


@pytest.mark.parametrize("rows", [NASTY, []])
def test_stages_on_nulls_ties_and_long_texts(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame([(1, "an item of ten words that no document holds at all"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        got = out.collect()
        if name != "packing":
            assert out.columns == table.columns
        if not rows:
            assert got == []
        elif name == "language_id":
            assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 5, 6]
        elif name == "near_dedup":
            assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 4, 5, 6]
        elif name == "decontamination":
            assert Counter(r.text for r in got) == Counter(t for _, t in rows)
        elif name == "pii":
            assert sorted(r.text or "" for r in got) == sorted((t or "").replace("a.b@example.com", "<EMAIL>") for _, t in rows)
            assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
        else:
            ends = Counter()
            for r in got:
                ends[r.sequence_id] += r.length
            assert {r.doc_id for r in got} == {d for d, _ in rows} and max(ends.values()) <= 2048
    assert DOCS.count(",") + 1 == len(table.columns)


def test_word_bounds_of_nothing():
    buf, offs = textarrays.utf8(pa.array([None, ""], pa.string()))
    assert [len(x) for x in textarrays.word_bounds(buf, offs)[:2]] == [0, 0]
