"""Substring dedup: repeated fixed-length word windows become removal intervals.

Every window of ``window`` words gets a Rabin-Karp hash. Windows are dealt by
hash; for each hash the smallest doc_id is found, and a window is repeated if
its document has a larger doc_id than that. Repeated windows that overlap or
touch merge into maximal removal intervals of their document.

Before the exchange each slice of documents is settled by itself: of a hash
that several documents of the slice hold, only the smallest document's entry
travels on, and the others are known to be repeated. So a passage that a third
of all rows share sends one entry a slice, not one a row.

Rows: null text has no words. A null doc_id has no order, so such a row
neither removes nor loses words. Rows that share a doc_id do not remove from
each other. Two different windows share a 64-bit hash with probability 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta

WINDOW = 50
#: Bytes of text that are settled together before the exchange.
SLICE = 4 << 20
_ENTRY = "bucket int, kind int, hashes binary, docs binary, keys binary, counts binary, places binary"
_FLAG = "home int, docs binary, keys binary, counts binary, places binary"
_INTERVALS = "doc_id long, text_key long, starts array<long>, ends array<long>"
_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:long,end:long>>, kept_text string"


def _runs(*rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of neighbours that are equal in all arrays."""
    if not len(rows[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(len(rows[0]) - 1, bool)
    for r in rows:
        new |= r[1:] != r[:-1]
    at = np.flatnonzero(np.r_[True, new])
    return at, np.diff(np.r_[at, len(rows[0])])


def _packed(values: np.ndarray) -> bytes:
    """Differences of neighbours, byte plane by byte plane, compressed: most planes are zero."""
    step = np.diff(values, prepend=values[:1] * 0)
    return zstandard.compress(step.view(np.uint8).reshape(len(step), -1).T.tobytes(), 1)


def _unpacked(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel(), dtype=dtype)


def _fields(docs: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Windows in document order as one run for each document: docs, keys, counts, places."""
    at, count = _runs(docs, keys)
    return _packed(docs[at]), keys[at].tobytes(), _packed(count.astype(np.uint32)), _packed(places.astype(np.uint32))


def _windows(docs: list[bytes], keys: list[bytes], counts: list[bytes], places: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = [_unpacked(x, np.uint32) for x in counts]
    return (
        np.concatenate([np.repeat(_unpacked(d, np.int64), c) for d, c in zip(docs, n, strict=True)]),
        np.concatenate([np.repeat(np.frombuffer(k, np.int32), c) for k, c in zip(keys, n, strict=True)]),
        np.concatenate([_unpacked(p, np.uint32) for p in places]).astype(np.int64),
    )


def _entries(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("hashes", "docs", "keys", "counts", "places"))])
    for whole in batches:
        for part in ta.slices(whole, limit=SLICE):
            buf, offs = ta.utf8(part.column("text"))
            starts, ends, first = ta.word_bounds(buf, offs)
            hashes, rows, places = ta.windows(ta.word_hashes(buf, starts, ends), first, k)
            if not len(hashes):
                continue
            docs = part.column("doc_id").to_numpy(zero_copy_only=False)[rows]
            keys = part.column("text_key").to_numpy(zero_copy_only=False)[rows]
            order = np.argsort(hashes, kind="stable")
            at, size = _runs(hashes[order])
            least = np.empty(len(hashes), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(docs[order], at), size)
            beaten = docs > least
            bucket = (hashes >> ta.U64(40)).astype(np.int64) % buckets
            out: list[tuple] = []
            sent = np.flatnonzero(~beaten)
            sent = sent[np.argsort(bucket[sent], kind="stable")]
            for i, n in zip(*_runs(bucket[sent]), strict=True):
                own = sent[i : i + n]
                out.append((int(bucket[own[0]]), 0, hashes[own].tobytes(), *_fields(docs[own], keys[own], places[own])))
            if len(own := np.flatnonzero(beaten)):
                out.append((int(keys[own[0]]) % buckets, 1, b"", *_fields(docs[own], keys[own], places[own])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _settle(table: pa.Table, homes: int) -> pa.Table:
    """The repeated windows among one bucket's entries, gathered by the home of their documents."""
    found = []
    for kind in (0, 1):
        own = table.filter(pc.equal(table.column("kind"), kind))
        if not own.num_rows:
            continue
        d, k, p = _windows(*(own.column(c).to_pylist() for c in ("docs", "keys", "counts", "places")))
        if not kind:
            hashes = np.frombuffer(b"".join(own.column("hashes").to_pylist()), ta.U64)
            order = np.argsort(hashes)
            at, size = _runs(hashes[order])
            beaten = np.zeros(len(d), bool)
            beaten[order] = d[order] > np.repeat(np.minimum.reduceat(d[order], at), size)
            d, k, p = d[beaten], k[beaten], p[beaten]
        found.append((d, k, p))
    d, k, p = (np.concatenate(x) for x in zip(*found, strict=True))
    home = (ta.mix(d.astype(ta.U64)) % ta.U64(homes)).astype(np.int32)
    order = np.lexsort((p, k, d, home))
    d, k, p, home = d[order], k[order], p[order], home[order]
    rows = [(int(home[i]), *_fields(d[i : i + n], k[i : i + n], p[i : i + n])) for i, n in zip(*_runs(home), strict=True)]
    types = [pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["home", "docs", "keys", "counts", "places"])


def _merge(table: pa.Table, window: int) -> pa.Table:
    """One home's repeated windows as maximal intervals of each document."""
    d, k, p = _windows(*(table.column(c).to_pylist() for c in ("docs", "keys", "counts", "places")))
    order = np.lexsort((p, k, d))
    d, k, p = d[order], k[order], p[order]
    rows = []
    for i, n in zip(*_runs(d, k), strict=True):
        own = p[i : i + n]
        gap = np.flatnonzero(own[1:] > own[:-1] + window)
        rows.append((int(d[i]), int(k[i]), own[np.r_[0, gap + 1]], own[np.r_[gap, n - 1]] + window))
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "text_key", "starts", "ends"])


def _rows(docs: DataFrame) -> DataFrame:
    """The text key is a 32-bit hash of the text: rows that share a doc_id but not a text stay apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.hash(text).cast("long").alias("text_key"))


def removal_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, starts, ends) of each document that has repeated windows, in words."""
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _rows(docs).filter("doc_id is not null and text is not null").withColumn("text_key", F.col("text_key").cast("int"))
    flags = rows.mapInArrow(lambda it: _entries(it, window, buckets), _ENTRY).groupBy("bucket").applyInArrow(lambda t: _settle(t, buckets), _FLAG)
    return flags.groupBy("home").applyInArrow(lambda t: _merge(t, window), _INTERVALS)


def _keep(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, kept_texts, removed = [], [], [], []
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        for text, a, b in zip(batch.column("text"), starts, ends, strict=True):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            for i, j in zip(reversed(a or []), reversed(b or []), strict=True):
                del words[i:j]
            removed.append(counts[-1] - len(words))
            kept = b" ".join(words)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode() if with_text else None)
        spans = [[{"start": i, "end": j} for i, j in zip(a or [], b or [], strict=True)] for a, b in zip(starts, ends, strict=True)]
        spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), spans, pa.array(kept_texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "intervals", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, the removed word
    intervals (start, end exclusive) and, if asked for, the kept text (words joined by one space).

    An empty table gives an empty result; columns beyond doc_id and text are ignored.
    """
    joined = _rows(docs).join(removal_intervals(docs, window), ["doc_id", "text_key"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(lambda it: _keep(it, with_text), _KEPT)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("intervals").cast("long").alias("n_intervals"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE: dict[str, str] = {}
