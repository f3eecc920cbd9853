"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of 8 bytes run over the text in steps of 4.
A text is covered by overlapping chunks of two 256-byte blocks; each filter is
max-pooled over a chunk, a hidden layer reads the pooled filters, and the
document's probability comes from the chunks' largest and mean hidden values.

The network is trained by Adam on a bounded sample of labelled rows, with ``STEPS``
updates whatever the number of rows; scoring reads whole texts, in pieces of bounded
size. Without a labelled row the network stays as it was drawn.

Rows: null and empty texts are scored as one blank chunk. Blanks follow every
text, whatever text is next to it, so a row's score is its own (but for the
rounding of float32 products); columns beyond doc_id and text are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta
from corpusloom.llm.shared import fold, labelled_sample

BLOCK = 256
STRIDE = 4
EMBED = 8
FILTERS = 24
HIDDEN = 12
#: Labelled rows that are trained on, at most (about), and the updates made.
TRAIN_ROWS = 3000
STEPS = 1000
_POSITIONS = BLOCK // STRIDE


def _blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts side by side, each padded to whole blocks, and each text's first block (one more entry than texts)."""
    sizes = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    first = np.r_[0, np.cumsum(sizes)]
    flat = np.zeros(first[-1] * BLOCK + 2 * STRIDE, np.uint8)
    for at, t in zip(first[:-1] * BLOCK, texts, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return flat, first


def _chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk its two blocks, and each text's first chunk. A text of one block is one chunk."""
    sizes = np.maximum(np.diff(first) - 1, 1)
    starts = np.r_[0, np.cumsum(sizes)]
    left = np.repeat(first[:-1], sizes) + np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
    right = np.minimum(left + 1, np.repeat(first[1:] - 1, sizes))
    return left, right, starts


class ByteNet:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "emb": r.normal(0, 0.5, (256, EMBED)).astype(f), "w": r.normal(0, 0.2, (2 * STRIDE * EMBED, FILTERS)).astype(f), "b": np.zeros(FILTERS, f),
            "wh": r.normal(0, 0.3, (FILTERS, HIDDEN)).astype(f), "bh": np.zeros(HIDDEN, f), "wo": r.normal(0, 0.3, 2 * HIDDEN).astype(f), "bo": np.zeros(1, f),
        }

    def _conv(self, flat: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Responses by block and position. ``last`` are the blocks that end a text: blanks follow them."""
        x = self.p["emb"][flat].reshape(-1, STRIDE * EMBED)
        half = STRIDE * EMBED
        after = x[1:-1] @ self.p["w"][half:]
        after[(last + 1) * _POSITIONS - 1] = np.tile(self.p["emb"][0], STRIDE) @ self.p["w"][half:]
        return (x[:-2] @ self.p["w"][:half] + after).reshape(-1, _POSITIONS, FILTERS)

    def _head(self, pooled: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        hidden = np.tanh(pooled @ self.p["wh"] + self.p["bh"])
        top = np.maximum.reduceat(hidden, starts[:-1], axis=0)
        mean = np.add.reduceat(hidden, starts[:-1], axis=0) / np.diff(starts)[:, None]
        z = np.hstack([top, mean]) @ self.p["wo"] + self.p["bo"]
        return hidden, top, mean, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _parts(self, flat: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """Responses of a bounded number of blocks at a time, for texts of any length."""
        step = 1024
        for at in range(0, first[-1], step):
            to = min(at + step, first[-1])
            last = first[1:] - 1
            last = last[(last >= at) & (last < to)] - at
            yield self._conv(flat[at * BLOCK : to * BLOCK + 2 * STRIDE], last)

    def score(self, texts: list[bytes]) -> np.ndarray:
        flat, first = _blocks(texts)
        blocks = np.maximum(np.concatenate([x.max(1) for x in self._parts(flat, first)]) + self.p["b"], 0)
        left, right, starts = _chunks(first)
        return self._head(np.maximum(blocks[left], blocks[right]), starts)[-1]

    def _gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        flat, first = _blocks(texts)
        where, most = (np.concatenate(x) for x in zip(*((x.argmax(1), x.max(1)) for x in self._parts(flat, first)), strict=True))
        left, right, starts = _chunks(first)
        use_right = most[right] > most[left]
        pooled = np.maximum(np.where(use_right, most[right], most[left]) + p["b"], 0)
        hidden, top, mean, prob = self._head(pooled, starts)
        dz = ((prob - y) * weight / len(y)).astype(np.float32)
        g = {"wo": np.hstack([top, mean]).T @ dz, "bo": dz.sum(keepdims=True)}
        n = np.diff(starts)
        dtop, dmean = np.outer(dz, p["wo"][:HIDDEN]), np.outer(dz, p["wo"][HIDDEN:]) / n[:, None]
        dh = np.repeat(dmean, n, axis=0) + np.where(hidden == np.repeat(top, n, axis=0), np.repeat(dtop, n, axis=0), 0)
        dh *= 1 - hidden**2
        g["wh"], g["bh"] = pooled.T @ dh, dh.sum(0)
        dp = (dh @ p["wh"].T) * (pooled > 0)
        g["b"] = dp.sum(0)
        block = np.where(use_right, right[:, None], left[:, None])
        at = where[block, np.arange(FILTERS)]
        place = block * BLOCK + at * STRIDE
        edge = np.isin(block, first[1:] - 1) & (at == _POSITIONS - 1)
        g["w"], g["emb"] = np.zeros_like(p["w"]), np.zeros_like(p["emb"])
        w = p["w"].reshape(2 * STRIDE, EMBED, FILTERS)
        for i in range(2 * STRIDE):
            byte = flat[place + i] if i < STRIDE else np.where(edge, 0, flat[place + i])
            g["w"].reshape(2 * STRIDE, EMBED, FILTERS)[i] = np.einsum("cf,cfe->ef", dp, p["emb"][byte])
            np.add.at(g["emb"], byte, dp[..., None] * w[i].T)
        return g

    def fit(self, rows: list[tuple[str, int, float]], epochs: int | None = None, size: int = 16, rate: float = 4e-3, seed: int = 11) -> ByteNet:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        t = 0
        data = [(text.encode(), y, w) for text, y, w in rows]
        steps = STEPS if epochs is None else epochs * -(-len(data) // size)
        while t < steps and data:
            order = rng.permutation(len(data))
            for i in range(0, len(order), size):
                part = [data[j] for j in order[i : i + size]]
                if t == steps:
                    break
                g = self._gradients([x[0] for x in part], np.array([x[1] for x in part], np.float32), np.array([x[2] for x in part], np.float32))
                t += 1
                lr = rate * (1 - t / (steps + 1))
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in ta.slices(whole, limit=1 << 20):
            score = model.value.score([(t or "").encode() for t in part.column("text").to_pylist()])
            keep = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score.astype(np.float64))], names=[*keep, "score"])


def score_quality(docs: DataFrame, sample: list[tuple[str, int, float]]) -> DataFrame:
    """doc_id, score of every row of ``docs``, by a network fitted to the sample's (text, label, weight)."""
    model = docs.sparkSession.sparkContext.broadcast(ByteNet().fit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, model), "doc_id long, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 5, 0, TRAIN_ROWS)
    found = score_quality(docs, sample)
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE: dict[str, str] = {}
