"""Rows that an operator once did less than its whole job for."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import pyarrow as pa
from corpusloom.llm import byte_quality, language_id, near_dedup, packing, shared
from tests.llm.test_operators import docs, words

# --- 3, packing


def test_packing_finds_added_tokens_as_the_tokenizers_file_does(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(21)
    bits = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "it's", " word", "é", "12", "\t ", "<|ENDOFTEXT|>", "<|"]
    texts = ["a <|endoftext|> it's", "<|endoftext|>", "<|endoftext|><|endoftext|> ", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(400))]
    docs(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {r.doc_id: (r.length, r.ids_crc32) for r in packing.op3_bin_packing(spark, str(tmp_path)).collect()} == want


def test_distinct_words_are_encoded_together(monkeypatch):
    """Texts of 3,000 distinct words take some calls of the encoder, not one a word, and ids are those of whole texts."""
    rng, words = random.Random(51), packing._WordIds(None)
    names = ["".join(rng.choice("abcdeé1'.-\n\u00a0\u4e2d") for _ in range(rng.randrange(1, 9))).strip() or "x" for _ in range(3000)]
    texts = [" ".join(rng.choices(names, k=200)) for _ in range(60)] + [" ".join(names), "", None, " lead", "trail ", "a\n b", "tail\n", " ", "a  b", "x\u00a0", "a <|endoftext|> b"]
    plain, calls = words.encode, []
    want = [np.array(plain(t or ""), "<u4").tobytes() for t in texts]
    monkeypatch.setattr(words, "encode", lambda t: calls.append(t) or plain(t))
    assert words.texts(pa.array(texts), {}) == want
    assert len(calls) < 100
    assert words.texts(pa.array([], pa.string()), {}) == [] and words.texts(pa.array([None, ""], pa.string()), {}) == [b"", b""]
    monkeypatch.setattr(packing, "TOGETHER", 7)
    assert packing._WordIds.texts(words, pa.array(texts), {}) == want


# --- 9, near-duplicates


def test_pairs_with_one_common_band_in_a_large_bucket(spark):
    """2,000 nodes share one bucket and nothing else; of 300 pairs among them each sample agrees with a chance of 0.8."""
    rng = np.random.default_rng(22)
    n, pairs, bands = 2000, 300, near_dedup.BANDS
    sketch = rng.integers(-(1 << 15), 1 << 15, (n, near_dedup.SKETCH))
    keep = rng.random((pairs, near_dedup.SKETCH)) < 0.8
    sketch[1 : 2 * pairs : 2] = np.where(keep, sketch[: 2 * pairs : 2], sketch[1 : 2 * pairs : 2])
    keys = rng.integers(0, 1 << 62, (n, bands))
    keys[:, 3] = 7
    name = lambda i: f"{i:05d}".encode()
    nodes = spark.createDataFrame([(name(i), 1.0, keys[i].tolist(), sketch[i].tolist()) for i in range(n)], "node binary, weight double, bands array<long>, sketch array<smallint>")
    members = nodes.selectExpr("node", "posexplode(bands) as (band, key)").filter("band = 3")
    classes = spark.createDataFrame([], "node binary, class binary")
    got = [(bytes(r.a), bytes(r.b)) for r in near_dedup._rest(near_dedup._mixed(members, classes), nodes.withColumn("class", F.col("node")), 0.8).collect()]
    agree = (sketch[: 2 * pairs : 2] == sketch[1 : 2 * pairs : 2]).sum(1)
    need = int(near_dedup.SKETCH * 0.8 - near_dedup.SLACK * (near_dedup.SKETCH * 0.8 * 0.2) ** 0.5)
    want = {(name(2 * i), name(2 * i + 1)) for i in np.flatnonzero(agree >= need)}
    assert len(want) >= 290 and len(got) == len(set(got)) and set(got) == want


def rows_made(spark, node, seen=-1):
    """(most rows that an operator of the name put out in one execution after ``seen``, the last execution)."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(runs.size()):
        if (run := runs.apply(i).executionId()) > seen:
            values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
            for n in (nodes.apply(k) for k in range(nodes.size())):
                for m in (n.metrics().apply(k) for k in range(n.metrics().size()) if n.name() == node):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, max([seen, *(runs.apply(i).executionId() for i in range(runs.size()))])


def test_near_copies_just_below_the_similarity_do_not_become_pairs(spark):
    """100 texts of one origin, some 0.75 alike, and for every tenth a copy with one word changed: each has links with its copies only,
    and no step has more rows than the 14 bands of all nodes."""
    rng = random.Random(41)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(1200)], []
    for i in range(100):
        copy = list(base)
        for at in rng.sample(range(1200), 17):
            copy[at] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*copy[:-1], "end"])))
    _, seen = rows_made(spark, "MapInArrow")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d % 1000 for d, _ in rows}
    assert 0 < rows_made(spark, "MapInArrow", seen)[0] <= near_dedup.BANDS * len(rows)


# --- 5, language


def test_rare_languages_are_learned_whatever_the_table_size(spark):
    """A language with 6 of 6,006 rows, and a bound of 200."""
    rng = random.Random(23)
    alphabets = {"xx": "abcde", "yy": "efghé", "zz": "uvwxy"}
    make = lambda lang: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(6)) for _ in range(15))
    rows = [(i, make(lang), lang) for i, lang in enumerate(["xx"] * 5000 + ["yy"] * 1000 + ["zz"] * 6)]
    unseen = [(10_000 + i, make("zz" if i % 2 else "xx")) for i in range(40)]
    [model] = language_id.train(docs(spark, rows), 200)
    assert model.languages == ["xx", "yy", "zz"]
    assert np.allclose(model.priors, np.log(np.array([5000, 1000, 6]) / 6006))
    # all six rows of zz are counted: no bucket of theirs is at the smoothing alone
    own = {int(b) for buckets, _ in language_id._grams([t for _, t, lang in rows if lang == "zz"]) for b in buckets}
    assert (model.logs[sorted(own), 2] > model.logs[:, 2].min()).all()
    out = language_id.identify(docs(spark, unseen).select("doc_id", "text"), docs(spark, rows), 200).collect()
    assert all(r.lang_pred == ("zz" if r.doc_id % 2 else "xx") for r in out) and len(out) == 40


def test_most_rows_of_a_language_fill_the_bound():
    rng = random.Random(24)
    for _ in range(300):
        counts, bound = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 9))], rng.randrange(9, 300)
        most = language_id._most(counts, bound)
        assert sum(min(n, most) for n in counts) <= bound
        assert max(counts) <= most or sum(min(n, most + 1) for n in counts) > bound


# --- 8, quality


@pytest.mark.parametrize("size", [0, 5, 252, 253, 256, 257, 600, 1024, 256 * 1024])
def test_byte_net_scores_a_text_alike_beside_any_neighbour(size):
    rng = np.random.default_rng(25)
    net = byte_quality.ByteNet()
    # filters that answer to the bytes after a gap
    net.p["w"][: byte_quality.STRIDE * byte_quality.EMBED] = 0
    text = rng.integers(97, 123, size).astype(np.uint8).tobytes()
    alone = net.score([text])[0]
    for other in (b"", b"\xff" * 300, b"zzzz", rng.integers(1, 256, 900).astype(np.uint8).tobytes()):
        assert np.allclose(net.score([text, other])[0], alone, rtol=0, atol=1e-6)
        assert np.allclose(net.score([other, text, other, text])[[1, 3]], alone, rtol=0, atol=1e-6)


def test_byte_net_gradients_stop_at_a_texts_end():
    net = byte_quality.ByteNet()
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    rng = np.random.default_rng(26)
    texts = [rng.integers(97, 123, 256).astype(np.uint8).tobytes() for _ in range(4)]
    y, w = np.array([1.0, 0.0, 1.0, 0.0]), np.ones(4)
    net.p["w"][: byte_quality.STRIDE * byte_quality.EMBED] *= 0.1
    net.p["emb"][0] *= 6  # blanks matter

    def loss():
        p = net.score(texts)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    g = net._gradients(texts, y, w)
    for name in ("w", "emb"):
        flat = net.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g[name].reshape(-1)))[:12]:
            old, e = flat[i], 1e-5
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - g[name].reshape(-1)[i]) < 1e-4 + 0.02 * abs(g[name].reshape(-1)[i]), name


# --- long texts and clashing columns


def test_a_cause_in_the_middle_of_a_long_text_is_sampled(spark):
    """The only toxic words of the toxic texts stand near their middle, among 9,000 characters; whole texts are sampled."""
    rng = random.Random(31)
    long = lambda n, cause: " ".join(words(rng, n, 200)) + f" {cause} " + " ".join(words(rng, n, 200))
    rows = [(i, long(1100, "zzqxj zzqxj zzqxj" if i % 2 else "w1 w2 w3")) for i in range(1, 60)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    sample = shared.labelled_sample(docs(spark, rows), labels, "toxic", 5, 0, 1000)
    assert {t for t, _, _ in sample} <= {t for _, t in rows} and all(("zzqxj" in t) == (y == 1) for t, y, _ in sample)
    assert max(len(t) for t, _, _ in sample) > 8_000
    fresh = [long(9000, "zzqxj"), long(9000, "w4")]
    assert np.allclose(byte_quality.ByteNet().score([t.encode() for t in fresh]), [byte_quality.ByteNet().score([t.encode()])[0] for t in fresh], atol=1e-5)


def test_stages_pass_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(32)
    text = lambda i: " ".join(words(rng, 60, 2000)) + f" mail a{i}@example.org phone +1 555 010 0{i:03}"
    names = "chunks _cut cut _own own _doc _key hash digest least _score _language language probability top total node key spans seed salt class Chunks2".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    rows = [(i, text(i), "en", "s", 9, *(f"{c}{i}" for c in names)) for i in range(40)]
    rows += [(90, rows[3][1], "en", "s", 9, *("copy" for _ in names)), (91, None, "en", "s", 0, *("x" for _ in names))]
    spark.createDataFrame([(1, " ".join(words(rng, 30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table, at = spark.createDataFrame(rows, schema), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, table if at is None else at, str(tmp_path)).checkpoint()
        assert at.columns == table.columns, name
    out = {r.doc_id: r for r in at.collect()}
    assert set(out) == set(range(40))
    for r in rows[:40]:
        assert out[r[0]][5:] == r[5:] and "<EMAIL>" in out[r[0]].text
    assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() >= 40
