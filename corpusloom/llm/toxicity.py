"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a word vector (a row of a hashed table) and a character vector
(the mean of the hashed vectors of its character n-grams, with marks for the
word's edges). Gated recurrent units read windows of words in both directions;
attention pools a window's states into one score. Windows overlap and cover the
whole text; a document's score is that of its most toxic window.

The network is trained by back-propagation through time and Adam on a bounded
sample of labelled rows: of each document its highest-scoring window, looked for in
the whole text in every third reading and among the highest ones of that in the others.

Training makes ``STEPS`` updates, whatever the number of rows. Without a labelled
row the network stays as it was drawn.

Rows: null and empty texts are scored as a window without words. Rows are
scored one by one, so repeated rows get equal scores; columns beyond doc_id and
text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta
from corpusloom.llm.shared import fold, labelled_sample

#: Words of a window, and of two neighbours' overlap.
WINDOW = 32
OVERLAP = 4
HIDDEN = 8
DIM = 8
WORD_ROWS = 1 << 13
CHAR_ROWS = 1 << 13
GRAMS = (3, 4, 5)
#: Labelled rows that are trained on, at most (about), and the updates made.
TRAIN_ROWS = 2400
STEPS = 300
#: Of every so many readings of a text in training one is in full; the others are of its ``TOP`` highest windows in that one.
FULL = 3
TOP = 4
_BATCH = 1 << 18
f32 = np.float32


class Vocabulary:
    """The distinct words of a slice: hashes, character n-gram rows, and the windows over the slice's words."""

    def __init__(self, texts: pa.Array):
        buf, offs = ta.utf8(texts)
        buf = ta.LOWER[buf]
        starts, ends, first = ta.word_bounds(buf, offs, ta.ALNUM)
        self.buf, self.starts, self.ends = buf, starts, ends
        hashes, at, self.index = np.unique(ta.word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        self.word_row = (hashes & ta.U64(WORD_ROWS - 1)).astype(np.int64)
        # the distinct words side by side, each between two zero bytes
        a, size = starts[at], (ends - starts)[at]
        base = np.r_[0, np.cumsum(size + 2)]
        flat = np.zeros(base[-1], ta.U64)
        inner = np.repeat(base[:-1] + 1 - np.r_[0, np.cumsum(size)][:-1], size) + np.arange(size.sum())
        flat[inner] = buf[np.repeat(a - np.r_[0, np.cumsum(size)][:-1], size) + np.arange(size.sum())]
        rows, owner = [], []
        for n in GRAMS:
            m = len(flat) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, ta.U64)
            for i in range(n):
                h = (h ^ flat[i : i + m]) * ta.U64(0x9E3779B97F4A7C15)
                h ^= h >> ta.U64(31)
            who = np.repeat(np.arange(len(at)), size + 2)[:m]
            ok = np.arange(m) + n <= base[1:][who]
            rows.append((ta.mix(h[ok]) & ta.U64(CHAR_ROWS - 1)).astype(np.int64))
            owner.append(who[ok])
        rows, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, owner))
        order = np.argsort(owner, kind="stable")
        self.char_row, self.char_owner = rows[order], owner[order]
        self.char_count = np.maximum(np.bincount(self.char_owner, minlength=len(at)), 1).astype(f32)
        # windows: every (WINDOW - OVERLAP) words, the last one shorter; a text without words has one empty window
        words, step = np.diff(first), WINDOW - OVERLAP
        self.per_text = np.maximum(1, -(-(words - OVERLAP) // step))
        self.text_start = np.r_[0, np.cumsum(self.per_text)]
        self.window_text = np.repeat(np.arange(len(words)), self.per_text)
        nth = np.arange(self.text_start[-1]) - self.text_start[self.window_text]
        self.window_start = first[self.window_text] + nth * step
        self.window_size = np.clip(first[self.window_text + 1] - self.window_start, 0, WINDOW)

    def highest(self, text: int, logit: np.ndarray, n: int) -> list[str]:
        """The n windows of the text with the highest log-odds, as texts of one window each."""
        at = np.arange(self.text_start[text], self.text_start[text + 1])
        at = at[np.argsort(-logit[at], kind="stable")[:n]]
        at = at[self.window_size[at] > 0]
        return [bytes(self.buf[self.starts[w] : self.ends[w + k - 1]]).decode() for w, k in zip(self.window_start[at], self.window_size[at], strict=True)]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (windows x WINDOW) and which of them are there."""
        there = np.arange(WINDOW) < self.window_size[chosen][:, None]
        if not len(self.index):
            return np.zeros(there.shape, np.int64), there
        at = np.minimum(self.window_start[chosen][:, None] + np.arange(WINDOW), len(self.index) - 1)
        return self.index[at], there


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class GatedNet:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        n = lambda *s, scale=0.3: r.normal(0, scale, s).astype(f32)
        self.p = {"word": n(WORD_ROWS, DIM, scale=0.1), "char": n(CHAR_ROWS, DIM, scale=0.3), "att": n(2 * HIDDEN), "out": n(2 * HIDDEN), "bias": np.full(1, -1, f32)}
        for d in "fb":
            self.p |= {f"w{d}": n(2 * DIM, 3 * HIDDEN), f"u{d}": n(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, f32)}

    def embed(self, v: Vocabulary) -> np.ndarray:
        chars = np.zeros((len(v.word_row), DIM), f32)
        if len(v.char_row):
            at = np.flatnonzero(np.r_[True, v.char_owner[1:] != v.char_owner[:-1]])
            chars[v.char_owner[at]] = np.add.reduceat(self.p["char"][v.char_row], at, axis=0)
        return np.hstack([self.p["word"][v.word_row], chars / v.char_count[:, None] * 3])

    def _run(self, x: np.ndarray, there: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (WINDOW x windows x HIDDEN) of one direction; x holds the projected inputs in time order."""
        h = np.zeros((x.shape[1], HIDDEN), f32)
        out = np.empty((WINDOW, x.shape[1], HIDDEN), f32)
        u, k = self.p[f"u{d}"], HIDDEN
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            zr = _sigmoid(x[t, :, : 2 * k] + h @ u[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(x[t, :, 2 * k :] + (r * h) @ u[:, 2 * k :])
            m = there[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, c, m))
            h = np.where(m, h + z * (c - h), h)
            out[t] = h
        return out

    def forward(self, table: np.ndarray, words: np.ndarray, there: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log-odds of each window; ``table`` has the word numbers' projected inputs of both directions."""
        w, m = words.T, there.T
        x = table[w]
        k = {d: [] for d in "fb"} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([self._run(x[:, :, : 3 * HIDDEN], m, "f", k["f"]), self._run(x[:, :, 3 * HIDDEN :], m, "b", k["b"])], axis=2)
        score = np.where(m, h @ self.p["att"], f32(-1e9))
        score = np.exp(score - score.max(0))
        weight = np.where(m, score, 0)
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", weight, h)
        if keep is not None:
            keep |= {"h": h, "weight": weight, "pooled": pooled, "steps": k, "words": w, "there": m}
        return pooled @ self.p["out"] + self.p["bias"]

    def project(self, embedded: np.ndarray) -> np.ndarray:
        return np.hstack([embedded @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb"])

    def logits(self, v: Vocabulary) -> np.ndarray:
        table = self.project(self.embed(v)) if len(v.word_row) else np.zeros((1, 6 * HIDDEN), f32)
        n, step = len(v.window_text), 2048
        return np.concatenate([self.forward(table, *v.windows(np.arange(i, min(i + step, n)))) for i in range(0, n, step)]) if n else np.zeros(0, f32)

    def score(self, texts: pa.Array) -> np.ndarray:
        v = Vocabulary(texts)
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.maximum.reduceat(self.logits(v), v.text_start[:-1]).astype(np.float64)))

    def _gradients(self, v: Vocabulary, chosen: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, k = self.p, HIDDEN
        embedded = self.embed(v)
        keep: dict = {}
        logit = self.forward(self.project(embedded), *v.windows(chosen), keep)
        dz = ((_sigmoid(logit) - y) * weight / len(y)).astype(f32)
        g = {n: np.zeros_like(x) for n, x in p.items()}
        h, a, there = keep["h"], keep["weight"], keep["there"]
        g["out"], g["bias"] = keep["pooled"].T @ dz, dz.sum(keepdims=True)
        dpool = np.outer(dz, p["out"])
        da = np.einsum("tnk,nk->tn", h, dpool)
        ds = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tn,tnk->k", ds, h)
        dh_all = a[:, :, None] * dpool + ds[:, :, None] * p["att"]
        dtable = np.zeros((len(v.word_row), 6 * k), f32)
        for j, d in enumerate("fb"):
            u, dh = p[f"u{d}"], np.zeros((len(y), k), f32)
            for t, old, z, r, c, m in reversed(keep["steps"][d]):
                dh = dh + dh_all[t, :, j * k : (j + 1) * k]
                dn = np.where(m, dh, 0)
                dc = dn * z * (1 - c * c)
                drh = dc @ u[:, 2 * k :].T
                dzr = np.hstack([dn * (c - old) * z * (1 - z), drh * old * r * (1 - r)])
                g[f"u{d}"][:, : 2 * k] += old.T @ dzr
                g[f"u{d}"][:, 2 * k :] += (r * old).T @ dc
                np.add.at(dtable[:, 3 * k * j : 3 * k * (j + 1)], keep["words"][t], np.hstack([dzr, dc]))
                dh = np.where(m, dh * (1 - z) + drh * r + dzr @ u[:, : 2 * k].T, dh)
        demb = np.zeros_like(embedded)
        for j, d in enumerate("fb"):
            own = dtable[:, 3 * k * j : 3 * k * (j + 1)]
            g[f"w{d}"], g[f"b{d}"] = embedded.T @ own, own.sum(0)
            demb += own @ p[f"w{d}"].T
        np.add.at(g["word"], v.word_row, demb[:, :DIM])
        np.add.at(g["char"], v.char_row, (demb[:, DIM:] * 3 / v.char_count[:, None])[v.char_owner])
        del there
        return g

    def fit(self, rows: list[tuple[str, int, float]], steps: int = STEPS, size: int = 64, rate: float = 0.02, seed: int = 13) -> GatedNet:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        t, steps, reading = 0, steps if rows else 0, 0
        highest: list[list[str]] = [[] for _ in rows]
        while t < steps:
            order, full = rng.permutation(len(rows)), reading % FULL == 0
            reading += 1
            for i in range(0, len(order), size):
                part = [rows[j] for j in order[i : i + size]]
                if t == steps:
                    break
                texts = [[x[0]] if full else highest[j] or [""] for j, x in zip(order[i : i + size], part, strict=True)]
                vocabulary = Vocabulary(pa.array([x for own in texts for x in own], pa.string()))
                if not len(vocabulary.word_row):
                    steps -= 1  # a part without a word teaches nothing
                    continue
                logit = self.logits(vocabulary)
                cuts = vocabulary.text_start[np.r_[0, np.cumsum([len(own) for own in texts])]]
                chosen = np.array([a + int(logit[a:b].argmax()) for a, b in zip(cuts, cuts[1:], strict=False)])
                if full:
                    for k, j in enumerate(order[i : i + size]):
                        highest[j] = vocabulary.highest(k, logit, TOP)
                g = self._gradients(vocabulary, chosen, np.array([x[1] for x in part], f32), np.array([x[2] for x in part], f32))
                t += 1
                lr = rate * (1 - t / (steps + 1))
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(f32)
        return self


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in ta.slices(whole, limit=_BATCH * 4):
            keep = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(model.value.score(part.column("text")))], names=[*keep, "score"])


def score_toxicity(docs: DataFrame, sample: list[tuple[str, int, float]]) -> DataFrame:
    """doc_id, score of every row of ``docs``, by a network fitted to the sample's (text, label, weight)."""
    model = docs.sparkSession.sparkContext.broadcast(GatedNet().fit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, model), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", 5, 0, TRAIN_ROWS)
    found = score_toxicity(docs, sample)
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
