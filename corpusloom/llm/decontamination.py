"""Benchmark decontamination by greedy string tiling.

Texts are words of letters and digits, lower-cased. Documents and benchmark
items are joined on *seeds*, hashes of ``min_match`` consecutive words; a bitmap
of the benchmark's seeds, of fixed size, keeps the seeds that no item has out of
the join. Each pair that shares a seed is tiled: the longest common run of words
that no earlier tile touches is marked, again and again, found by Karp-Rabin
hashes of search lengths that fall to ``min_match``. A document is contaminated
by an item if the tiles cover at least ``threshold`` of the item's words, in
whatever order they stand.

Every common run of at least ``min_match`` words is a run of common seeds, so
the seeds and their places are all that tiling needs of the texts.

Of runs that are equally long, the one that starts first in the item is marked, then
the one that starts first in the document. The length of a text costs no more than
its seeds: a pair is tiled from the seeds in common alone.

Rows: null and empty texts, and items of fewer than ``min_match`` words, match
nothing. Rows that share a doc_id (or item_id) are tiled by themselves; equal
pairs are reported once. A null id is kept as null. An empty table on either
side gives an empty result; columns beyond the ids and texts are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta
from corpusloom.llm.shared import ensure_checkpoint_dir

MIN_MATCH = 5
THRESHOLD = 0.5
#: Bits of a seed that number its place in the bitmap, and the bytes of a bitmap row.
BITMAP_BITS = 26
_ROW_BITS = 13
_SALTS = 32
_SEEDS = "id long, text_key long, n_words long, seed long, places array<int>"


def _seeds(batches: Iterator[pa.RecordBatch], k: int, bitmap) -> Iterator[pa.RecordBatch]:
    """Each text's distinct seeds with their places; with a bitmap, only those whose bit is set."""
    for whole in batches:
        for part in ta.slices(whole):
            buf, offs = ta.utf8(pc.utf8_lower(pc.fill_null(part.column("text"), "")))
            starts, ends, first = ta.word_bounds(buf, offs, ta.ALNUM)
            hashes, rows, places = ta.windows(ta.word_hashes(buf, starts, ends), first, k)
            if bitmap is not None:
                bit = hashes >> ta.U64(64 - BITMAP_BITS)
                at = np.flatnonzero(bitmap.value[(bit >> ta.U64(3)).astype(np.int64)] >> (bit & ta.U64(7)).astype(np.uint8) & 1)
                hashes, rows, places = hashes[at], rows[at], places[at]
            order = np.lexsort((places, hashes, rows))
            hashes, rows, places = hashes[order], rows[order], places[order]
            new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(rows) else np.zeros(0, np.int64)
            r = pa.array(rows[new])
            words = np.diff(first)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(rows)].astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("id").take(r), part.column("text_key").take(r), pa.array(words[rows[new]]), pa.array(hashes[new].view(np.int64)), lists], names=["id", "text_key", "n_words", "seed", "places"])


def _bitmap_rows(table: pa.Table) -> pa.Table:
    bits = table.column("bit").to_numpy()
    row = np.zeros(1 << _ROW_BITS, np.uint8)
    row[bits & ((1 << _ROW_BITS) - 1)] = 1
    return pa.table({"row": pa.array([int(bits[0]) >> _ROW_BITS], pa.int32()), "data": pa.array([np.packbits(row, bitorder="little").tobytes()], pa.binary())})


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """One bit for each seed prefix that occurs: 8 MB whatever the size of the benchmark."""
    bits = seeds.select(F.shiftrightunsigned("seed", 64 - BITMAP_BITS).cast("int").alias("bit")).distinct()
    rows = bits.groupBy(F.shiftright("bit", _ROW_BITS)).applyInArrow(_bitmap_rows, "row int, data binary").collect()
    out = np.zeros((1 << BITMAP_BITS - _ROW_BITS, 1 << _ROW_BITS - 3), np.uint8)
    for r in rows:
        out[r["row"]] = np.frombuffer(r["data"], np.uint8)
    return out.ravel()


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, length: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(place in a, place in b, words) of the maximal common runs of at least ``length`` unmarked words.

    a and b hold at each word the number of the seed that starts there, or a number of its own where none does.
    """
    w = length - k + 1
    if min(len(a), len(b)) < length:
        return
    free = lambda f: np.flatnonzero(np.convolve(~f, np.ones(length, np.int64))[length - 1 :][: len(f) - length + 1] == 0)
    ha, hb = ta.window_hashes(a, w), ta.window_hashes(b, w)
    at_a, at_b = free(free_a), free(free_b)
    known: dict[int, list[int]] = {}
    for i in at_a.tolist():
        known.setdefault(int(ha[i]), []).append(i)
    hit = np.isin(hb[at_b], ha[at_a])
    for j in at_b[hit].tolist():
        for i in known[int(hb[j])]:
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                continue  # not maximal: it starts earlier
            n = length
            while i + n < len(free_a) and j + n < len(free_b) and free_a[i + n] and free_b[j + n] and a[i + n - k + 1] == b[j + n - k + 1]:
                n += 1
            if (a[i : i + n - k + 1] == b[j : j + n - k + 1]).all():
                yield i, j, n


def tile(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two seed sequences: (place in a, place in b, words) of each tile."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    tiles, length = [], max(k, len(a))
    while True:
        found = sorted(_matches(a, b, free_a, free_b, length, k), key=lambda m: (-m[2], m[0], m[1]))
        clash = False
        for i, j, n in found:
            if clash := not (free_a[i : i + n].all() and free_b[j : j + n].all()):
                break  # what is left of this run may still be longer than the next one
            free_a[i : i + n] = free_b[j : j + n] = False
            tiles.append((i, j, n))
        if clash:
            continue
        if length == k:
            return tiles
        length = max(k, length // 2)


def _sequence(seeds: list[int], places: list[list[int]], numbers: dict[int, int], n_words: int | None, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed numbers in word order, and the words' places. Without n_words, words that no seed covers are left out."""
    at = np.array([p for ps in places for p in ps], np.int64)
    number = np.array([numbers[s] for s, ps in zip(seeds, places, strict=True) for _ in ps], np.int64)
    words = np.arange(n_words) if n_words is not None else np.unique((at[:, None] + np.arange(k)).ravel())
    out = own + np.arange(len(words))
    out[np.searchsorted(words, at)] = number
    return out.astype(ta.U64), words


def _tile_pairs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_item, rows = batch.column("n_item").to_pylist(), []
        for m, shared in zip(n_item, batch.column("shared").to_pylist(), strict=True):
            seeds = [s["seed"] for s in shared]
            numbers = {s: i for i, s in enumerate(dict.fromkeys(seeds))}
            a, _ = _sequence(seeds, [s["in_item"] for s in shared], numbers, m, k, 1 << 40)
            b, words = _sequence(seeds, [s["in_doc"] for s in shared], numbers, None, k, 1 << 41)
            # words that stand apart in the document are no neighbours: a seed ends before the gap
            tiles = tile(a, b, k)
            rows.append((sum(t[2] for t in tiles), len(tiles), max((t[2] for t in tiles), default=0), [{"item_word": i, "doc_word": int(words[j]), "words": n} for i, j, n in sorted(tiles)]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())]))]
        keep = ["doc_id", "doc_key", "item_id", "n_item"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=[*keep, "n_covered", "n_tiles", "longest", "tiles"])


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and benchmark item whose tiles cover the threshold: doc_id, doc_key (xxhash64 of
    the text), item_id, n_item (words), n_covered, n_tiles, longest, coverage, and the tiles themselves."""
    sc = docs.sparkSession.sparkContext
    side = lambda rows, name: rows.select(F.col(name).cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key")).filter("text is not null")
    items = side(benchmark, "item_id").distinct().mapInArrow(lambda it: _seeds(it, min_match, None), _SEEDS)
    bitmap = sc.broadcast(_bitmap(items))
    ensure_checkpoint_dir(docs.sparkSession)
    found = side(docs, "doc_id").mapInArrow(lambda it: _seeds(it, min_match, bitmap), _SEEDS).checkpoint()  # it is joined and counted
    left = found.select(F.col("id").alias("doc_id"), F.col("text_key").alias("doc_key"), "seed", F.col("places").alias("in_doc"))
    right = items.select(F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), F.col("n_words").alias("n_item"), "seed", F.col("places").alias("in_item"))
    # a seed that many documents hold is dealt over several tasks, and its items go to those that have it
    left = left.withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_key"), F.lit(_SALTS)).cast("int"))
    held = left.groupBy("seed").agg(F.expr("bit_or(shiftleft(1L, salt))").alias("mask"))
    right = right.join(held, "seed").withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {_SALTS - 1}), i -> mask & shiftleft(1L, i) != 0)"))).drop("mask")
    pairs = left.join(right, ["seed", "salt"]).groupBy("doc_id", "doc_key", "item_id", "item_key", "n_item").agg(F.collect_list(F.struct("seed", "in_doc", "in_item")).alias("shared"))
    # n seeds in common cover n + min_match - 1 words a run at most, so min_match * n in all
    pairs = pairs.filter(F.aggregate("shared", F.lit(0), lambda n, s: n + F.size(s["in_item"])) * min_match >= F.col("n_item") * threshold)
    tiled = pairs.mapInArrow(lambda it: _tile_pairs(it, min_match), "doc_id long, doc_key long, item_id long, n_item long, n_covered long, n_tiles long, longest long, tiles array<struct<item_word:long,doc_word:long,words:long>>")
    return tiled.withColumn("coverage", F.col("n_covered") / F.col("n_item")).filter(F.col("coverage") >= threshold).dropDuplicates(["doc_id", "doc_key", "item_id", "n_item", "n_covered", "n_tiles", "longest"])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that some benchmark item contaminates."""
    bad = contaminated_pairs(docs, benchmark, min_match, threshold).select(F.col("doc_id").alias("_doc"), F.col("doc_key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_doc"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_key"]), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return pairs.select("doc_id", "item_id", "n_item", "n_covered", "n_tiles", "longest", "coverage")


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE: dict[str, str] = {}
