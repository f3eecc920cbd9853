"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of a bounded sample of labelled rows in
Spark, chosen by language, so that rare languages are learned from all their
rows however large the table; the priors are the languages' shares in all
labelled rows. The log-probability matrix has a fixed number of buckets for each
language and is broadcast, in blocks of ``BLOCK`` languages: where there are more,
the rows go through one block after another with their best language so far, so that
neither the driver nor a task holds more than a block, and every language is learned.
A batch is scored sparsely in numpy: the matrix rows of the n-grams that a text
holds, summed by document, a bounded number of n-grams at a time.

Rows: null text, and text without a letter, is ``und`` with score 0. A null
doc_id is not held out and never trained on. Rows are scored one by one, so
repeated rows get equal results. Very long texts are read as a whole. Columns pass
through, but for those named like the new ones, which are replaced. An empty table
gives an empty result; without a training row all texts are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textarrays as ta
from corpusloom.llm.shared import ensure_checkpoint_dir, fold, fresh

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled rows that the model is fitted on, at most (about).
TRAIN_ROWS = 12_000
#: Added to each count.
SMOOTHING = 0.5
#: Languages of one broadcast matrix.
BLOCK = 512
#: Languages up to which their shares of the sample are broadcast.
_SHARES = 100_000
_STEP = 1 << 19


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text index) of the n-grams, a bounded number at a time. An n-gram is counted where it starts."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in lower])
    owner = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    for at in range(0, len(points), _STEP):
        for n in ORDERS:
            starts = np.arange(at, min(at + _STEP, len(points) - n + 1))
            if not len(starts):
                continue
            rows = owner[starts]
            starts = starts[starts + n <= ends[rows]]
            h = np.full(len(starts), n, np.uint64)
            for i in range(n):
                h = (h ^ points[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64) % BUCKETS, owner[starts]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for whole in batches:
        for part in ta.slices(whole):
            langs = part.column("lang").to_pylist()
            for lang in set(langs):
                own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                texts = [t for t, x in zip(part.column("text").to_pylist(), langs, strict=True) if x == lang]
                for buckets, _ in _grams(texts):
                    own += np.bincount(buckets, minlength=BUCKETS)
    for lang, own in totals.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])


class NaiveBayes:
    """Languages, the log-probability of each bucket (rows) in each of them (columns), and their priors' logs.
    docs: the languages' numbers of rows, of ``total`` in all, which other blocks may hold a part of."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray, total: float | None = None):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.logs = np.log(smooth / smooth.sum(0)).astype(np.float32)
        self.priors = np.log(docs / (docs.sum() if total is None else total)) if len(docs) else np.zeros(0)

    def joint(self, texts: list[str]) -> np.ndarray:
        """ln of prior times likelihood, texts by languages."""
        sums = np.tile(self.priors, (len(texts), 1))
        for buckets, rows in _grams(texts):
            at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
            if len(at):
                sums[rows[at]] += np.add.reduceat(self.logs[buckets], at, axis=0, dtype=np.float64)
        return sums

    def predict(self, texts: list[str]) -> tuple[list[int], list[float], list[float]]:
        """The best language, its joint, and the ln of all joints' sum."""
        sums = self.joint(texts)
        top = sums.max(1)
        return sums.argmax(1).tolist(), top.tolist(), (top + np.log(np.exp(sums - top[:, None]).sum(1))).tolist()


def _most(counts: list[int], bound: int) -> int:
    """The most rows of a language with which all languages together stay within the bound; one at least."""
    most = 1
    for i, n in enumerate(sorted(counts)):
        most = max(1, bound // (len(counts) - i))
        if n > most:
            break
        bound -= n
    return most


def train(docs: DataFrame, bound: int = TRAIN_ROWS) -> Iterator[NaiveBayes]:
    """Fits text -> lang on about ``bound`` of the rows that ``docs`` has with a doc_id, a text and a lang: all
    rows of rare languages, and about as many of each other language, chosen by a hash of the doc_id. Gives the
    model in blocks of languages, by name."""
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    by_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(by_lang)
    most, full = _most(list(by_lang.values()), bound), 1 << 20
    shares = docs.sparkSession.createDataFrame([(x, n <= most, most / n) for x, n in by_lang.items()], "lang string, all boolean, share double")
    chosen = F.col("all") | (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(full)) < F.col("share") * full)
    sample = rows.join(F.broadcast(shares) if len(languages) <= _SHARES else shares, "lang").filter(chosen).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if len(languages) > BLOCK:
        ensure_checkpoint_dir(docs.sparkSession)
        counted = counted.checkpoint()
    for first in range(0, len(languages), BLOCK):
        own = languages[first : first + BLOCK]
        counts, at = np.zeros((BUCKETS, len(own))), {x: i for i, x in enumerate(own)}
        for r in counted.filter(F.col("lang").between(own[0], own[-1])).collect():  # at most BUCKETS rows a language of the block
            counts[r["bucket"], at[r["lang"]]] = r["n"]
        yield NaiveBayes(own, counts, np.array([by_lang[x] for x in own], float), float(sum(by_lang.values())))


def _predict(batches: Iterator[pa.RecordBatch], model, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds, or updates, the columns ``names``: the best language, its joint, and the ln of all joints' sum."""
    languages = model.value.languages
    for whole in batches:
        for part in ta.slices(whole, text, 1 << 20):
            texts = part.column(text).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
            lang, top, total = (part.column(c).to_pylist() if c in part.schema.names else [x] * len(texts) for c, x in zip(names, ("und", None, None), strict=True))
            for i, best, own, all_own in zip(at, *model.value.predict([texts[i] for i in at]), strict=True) if at else ():
                if top[i] is None or own > top[i]:
                    lang[i], top[i] = languages[best], own
                total[i] = all_own if total[i] is None else float(np.logaddexp(total[i], all_own))
            new = [pa.array(lang, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())]
            keep = [c for c in part.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], names=[*keep, *names])
        ta.release()


def identify(docs: DataFrame, training: DataFrame, bound: int = TRAIN_ROWS, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns more, the predicted language and its probability, by a model fitted
    on ``training`` (doc_id, text, lang). ``names`` are the new columns' names; columns that have them are replaced."""
    docs = docs.drop(*names)
    state = [names[0], *fresh([*docs.columns, *names], "top", "total")]
    schema = T.StructType([*docs.schema.fields, T.StructField(state[0], T.StringType()), *(T.StructField(c, T.DoubleType()) for c in state[1:])])
    found, blocks = None, 0
    for model in train(training, bound):
        if blocks:
            found = found.checkpoint()  # so that the block before it is needed no more
        shared, blocks = docs.sparkSession.sparkContext.broadcast(model), blocks + 1
        found = (docs if found is None else found).mapInArrow(lambda it, shared=shared: _predict(it, shared, "text", state), schema)
    if found is None:
        return docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)})
    return found.withColumn(names[1], F.coalesce(F.exp(F.col(state[1]) - F.col(state[2])), F.lit(0.0))).drop(*state[1:])


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: all but those whose crc32 of the id is 2 modulo 4."""
    return docs.filter(fold("doc_id", 4) != 2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), training_rows(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
