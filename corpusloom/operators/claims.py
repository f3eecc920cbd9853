"""Which claims does a corpus hold? Many substrings looked for in one scan of the texts.

The claims' variants become two tables of fixed size, which are broadcast: by the hash of a
variant's first bytes the lengths to look at, and by the hash of the whole variant whether
any has it. A scan takes rolling hashes of each text; where both tables agree, the digest
of the stretch is a hit. Only digests leave the scan, each once for a slice of texts; they
are joined with the digests of the variants. So neither texts nor claims are broadcast or
shuffled, short variants need no other way, and the tables' size bounds no number of claims:
with very many of them more stretches are digested for nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes at a variant's start that choose its row of the first table.
GRAM = 6
#: Rows of the two tables, as powers of two.
_GRAM_BITS, _WHOLE_BITS = 20, 22
#: Bytes of text that are hashed at a time.
_SLICE = 1 << 20
U64 = np.uint64
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial of the bytes, and the inverse powers that make stretches comparable wherever they stand."""
    n = len(data) + 1
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, _SLICE), b, U64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    sums = np.zeros(n, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _powers[0][: n - 1], out=sums[1:])
    return sums, _powers[1]


def _mixed(x: np.ndarray, size: int) -> np.ndarray:
    x = (x ^ U64(size)) * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def _hashes(sums: np.ndarray, down: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return _mixed((sums[at + size] - sums[at]) * down[at], size)


def _rows(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row of the first table, row of the second, size, gram's size) of each variant."""
    for batch in batches:
        grams, wholes, sizes = [], [], []
        for v in batch.column("variant").to_pylist():
            data = np.frombuffer(v.encode(), np.uint8)
            sums, down = _sums(data)
            start = np.zeros(1, np.int64)
            grams.append(_rows(_hashes(sums, down, start, min(GRAM, len(data))), _GRAM_BITS)[0])
            wholes.append(_rows(_hashes(sums, down, start, len(data)), _WHOLE_BITS)[0])
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (grams, wholes, sizes)], names=["gram", "whole", "size"])


def _scan(batches: Iterator[pa.RecordBatch], tables) -> Iterator[pa.RecordBatch]:
    classes, bitmap, sizes = tables.value
    grams = sorted({min(GRAM, s) for s in sizes})
    for batch in batches:
        column = batch.column("text").cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        at = 0
        while at < batch.num_rows:  # rows whose texts together stay within a slice; a longer text is one by itself
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")))
            texts = column.slice(at, to - at).to_pylist()
            raw, at = b"".join(texts), to
            data = np.frombuffer(raw, np.uint8)
            last = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])  # where the text of each byte ends
            sums, down = _sums(data)
            found: set[bytes] = set()
            for g in grams:
                here = np.arange(max(len(data) - g + 1, 0))
                here = here[here + g <= last[here]]
                mask = classes[_rows(_hashes(sums, down, here, g), _GRAM_BITS)]
                here, mask = here[mask != 0], mask[mask != 0]
                for size in (s for s in sizes if min(GRAM, s) == g):
                    own = here[(mask >> U64(size % 64) & U64(1)).astype(bool)]
                    own = own[own + size <= last[own]]
                    h = _hashes(sums, down, own, size)
                    row = _rows(h, _WHOLE_BITS)
                    hit = np.flatnonzero(bitmap[row >> 3] >> (row & 7).astype(np.uint8) & 1)
                    _, first = np.unique(h[hit], return_index=True)
                    found.update(hashlib.md5(raw[i : i + size]).digest() for i in own[hit[first]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], names=["digest"])


def claim_check(claims: DataFrame, claim: str, variants: str, corpus: DataFrame, text: str) -> DataFrame:
    """(claim, supported): whether any variant of a claim is a substring of any text, whatever the case. Null and empty
    variants support nothing; a claim that several rows hold has all their variants."""
    probes = claims.select(F.col(claim).alias("claim"), F.explode(variants).alias("variant")).filter("variant != ''").withColumn("variant", F.lower("variant"))
    rows = probes.select("variant").distinct().mapInArrow(_keys, "gram long, whole long, size long").distinct()
    classes, bitmap = np.zeros(1 << _GRAM_BITS, U64), np.zeros(1 << _WHOLE_BITS - 3, np.uint8)
    # a number for each row of a table of fixed size
    for r in rows.groupBy("gram").agg(F.expr("bit_or(shiftleft(1L, cast(size % 64 as int)))").alias("mask")).toArrow().to_batches():
        classes[r.column("gram").to_numpy()] = r.column("mask").to_numpy().view(U64)
    for r in rows.select("whole").distinct().toArrow().to_batches():
        whole = r.column("whole").to_numpy()
        np.bitwise_or.at(bitmap, whole >> 3, (1 << (whole & 7)).astype(np.uint8))
    sizes = sorted(r["size"] for r in rows.select("size").distinct().collect())
    tables = claims.sparkSession.sparkContext.broadcast((classes, bitmap, sizes))
    texts = corpus.select(F.lower(F.col(text)).alias("text")).filter("text is not null")
    found = texts.mapInArrow(lambda it: _scan(it, tables), "digest binary").distinct()
    held = probes.withColumn("digest", F.unhex(F.md5("variant"))).join(found, "digest").select("claim").distinct().withColumn("hit", F.lit(True))
    out = claims.select(F.col(claim).alias("claim")).distinct().join(held, "claim", "left")
    return out.select(F.col("claim").alias(claim), F.coalesce("hit", F.lit(False)).alias("supported"))
