"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its shingles, five lower-cased words each (all its
words, if fewer). A shingle weighs (1 + ln tf) * (1 + 0.1 * ln(N / df) / ln N):
the document frequency df is counted over all rows in a fixed number of hashed
buckets, and the share of the idf is small, so that an edit does not outweigh
the many shingles that large groups of copies have in common.

Equal texts are one node. A node's samples, drawn so that two nodes agree on one
with a probability of their weighted Jaccard similarity, are cut into bands;
nodes that agree on a whole band share a bucket. Links are looked for in two steps:

1. every node of a bucket is verified against the bucket's first document and
   its most central node, the one whose buckets are largest, which in a group of
   edited copies is the original: as many pairs as nodes, whatever the size;
2. in buckets that still hold several classes, nodes of different classes whose
   longer sketches and weights make a link possible are verified. Only the nodes of
   such buckets get a sketch. The nodes of buckets of over ``SPLIT`` nodes, which a
   common passage alone can fill, are compared where they agree on one of ``FINE``
   finer bands, made of the samples that the bands leave over: of the pairs at the
   similarity these miss one in 22,000, while 14 bands miss one in 1,600. Groups of
   over ``SPLIT`` nodes that agree on such a band are compared block by block, so
   that no task holds more than the pairs of two blocks. What may be a link is
   verified where its cell's texts meet, and a cell gives only links that join what
   its links before have not: fewer than it has nodes, however many pairs are compared.

Rows of a large bucket, and the pairs of a node with many partners, are dealt over
``_SALTS`` tasks before they are joined.

Verification computes the weighted Jaccard similarity from the texts. Classes
are the connected components of the verified links.

Rows: null text is in no class but its own; empty texts are equal texts, so one
class, as are texts without a word if equal. Rows that share a doc_id but not a text are judged by their
texts. A class is named by its least doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta
from corpusloom.llm.graph import components
from corpusloom.llm.shared import ensure_checkpoint_dir, fresh

WORDS = 5
SIMILARITY = 0.8
BANDS = 14
ROWS = 4
SPLIT = 200
#: Samples compared before texts are; the first BANDS * ROWS make the bands.
SKETCH = 512
#: Finer bands for the nodes of large buckets, of the samples after the bands'.
FINE_ROWS = 6
FINE = 33
#: Standard deviations that a sketch may stay below the wanted similarity.
SLACK = 3.5
DF_BUCKETS = 1 << 20
IDF_SHARE = 0.1
_CHUNK = 1 << 12
_SALTS = 32
_PAIRS = 256
_CELL = ("cell", "fine", "x", "y")
_TABLE_BITS = 13
_TABLE = 1 << _TABLE_BITS
_STEP = 1 << 20
_tables: list[tuple[np.ndarray, ...]] = []
_rng = np.random.default_rng(20)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of the distinct shingles, by row."""
    buf, offs = ta.utf8(texts)
    buf = ta.LOWER[buf]
    starts, ends, first = ta.word_bounds(buf, offs)
    words = ta.word_hashes(buf, starts, ends)
    hashes, rows, _ = ta.windows(words, first, WORDS)
    size = np.diff(first)
    for k in range(1, WORDS):  # short texts: all their words
        short = np.flatnonzero(size == k)
        if len(short):
            own = words[first[short][:, None] + np.arange(k)]
            h = np.full(len(short), k, ta.U64)
            for i in range(k):
                h = ta.mix(h ^ own[:, i]) * ta.U64(0x9E3779B97F4A7C15)
            hashes, rows = np.r_[hashes, h], np.r_[rows, short]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows[new], hashes[new], np.diff(np.r_[new, len(rows)])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> ta.U64(40)).astype(np.int64) & (DF_BUCKETS - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows, salt = np.zeros(DF_BUCKETS, np.int64), 0, 0
    for whole in batches:
        for part in ta.slices(whole):
            _, hashes, _ = shingles(part.column("text"))
            total += np.bincount(_bucket(hashes), minlength=DF_BUCKETS)
            rows += part.num_rows
            salt = int(hashes[0]) % _SALTS if len(hashes) and not salt else salt
        ta.release()
    if rows:
        chunks = total.reshape(-1, _CHUNK)
        at = np.flatnonzero(chunks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([salt] * len(at), pa.int32()), pa.array([zstandard.compress(chunks[i].tobytes(), 1) for i in at], pa.binary())], names=["chunk", "salt", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})


class Weights:
    """ln of the idf factor by bucket: a table of fixed size."""

    def __init__(self, n: int, df: np.ndarray):
        n = max(n, 2)
        self.idf = (1 + IDF_SHARE * np.clip(np.log(n / np.maximum(df, 1)) / np.log(n), 0, 1)).astype(np.float32)

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts, dtype=np.float32)) * self.idf[_bucket(hashes)]


def document_frequencies(texts: DataFrame) -> Weights:
    counted = texts.select("text").mapInArrow(_count, "chunk int, salt int, counts binary")
    for keys in (["chunk", "salt"], ["chunk"]):
        counted = counted.groupBy(*keys).applyInArrow(_add, "chunk int, counts binary")
    df = np.zeros((DF_BUCKETS // _CHUNK, _CHUNK), np.int64)
    for r in counted.collect():  # DF_BUCKETS counts in all
        df[r["chunk"]] = np.frombuffer(zstandard.decompress(r["counts"]), np.int64)
    return Weights(texts.count(), df.ravel())


def _draws(n: int) -> list[tuple[np.ndarray, ...]]:
    """For each of n samples: an odd multiplier, and tables of r, 1/r, beta and ln c, looked up by the shingle's hash.
    A worker keeps no more of them than it has needed; all ``SKETCH`` take 67 MB."""
    while len(_tables) < n:
        r, c = _rng.gamma(2, 1, _TABLE), _rng.gamma(2, 1, _TABLE)
        f = np.float32
        _tables.append((ta.U64(int(_rng.integers(1 << 62)) * 2 + 1), r.astype(f), (1 / r).astype(f), _rng.random(_TABLE).astype(f), np.log(c).astype(f)))
    return _tables[:n]


def samples(hashes: np.ndarray, log_weights: np.ndarray, starts: np.ndarray, n: int = SKETCH) -> np.ndarray:
    """Each row's first n samples, one column each: the shingle and the quantised weight with the least ln a."""
    out = np.empty((len(starts), n), ta.U64)
    low = hashes >> ta.U64(32)
    for i, (odd, r, inverse, beta, log_c) in enumerate(_draws(n)):
        at = (hashes * odd >> ta.U64(64 - _TABLE_BITS)).astype(np.int64)
        b = beta[at]
        ln_a = log_c[at] - r[at] * (np.floor(log_weights * inverse[at] + b) - b + np.float32(1))
        bits = ln_a.view(np.int32)
        bits = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)  # in the order of the floats
        out[:, i] = np.minimum.reduceat((bits.astype(ta.U64) << ta.U64(32)) | low, starts)
    return ta.mix(out)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each row of a table."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def _sampled(part: pa.RecordBatch, weights, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row, weight, samples) of the rows with a shingle; None without any."""
    rows, hashes, counts = shingles(part.column("text"))
    if not len(rows):
        return None
    w = weights.value(hashes, counts)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[starts], np.add.reduceat(w, starts).astype(np.float64), samples(hashes, np.log(w), starts, n)


def _sign(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in ta.slices(whole, limit=_STEP):
            if (got := _sampled(part, weights, BANDS * ROWS)) is None:
                continue
            rows, weight, found = got
            bands = found.reshape(-1, BANDS, ROWS)
            key = bands[:, :, 0]
            for i in range(1, ROWS):
                key = ta.mix(key ^ bands[:, :, i]) * ta.U64(0x9E3779B97F4A7C15)
            keep = [part.column(c).take(pa.array(rows)) for c in ("node", "doc_id")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(weight), _lists(key.view(np.int64), pa.int64())], names=["node", "doc_id", "weight", "bands"])
        ta.release()


def _sketch(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    """Adds 8 bits of each sample to rows that have a shingle."""
    for whole in batches:
        for part in ta.slices(whole, limit=_STEP):
            if (got := _sampled(part, weights, SKETCH)) is None:
                continue
            keep = [c for c in part.schema.names if c != "text"]
            short = (got[2] >> ta.U64(56)).astype(np.uint8).view(np.int8)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(got[0])) for c in keep), _lists(short, pa.int8())], names=[*keep, "sketch"])
        ta.release()


def _similarity(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in ta.slices(whole, "text_a", _STEP):
            sides = []
            for c in ("text_a", "text_b"):
                rows, hashes, counts = shingles(part.column(c))
                sides.append((rows, hashes, weights.value(hashes, counts)))
            (ra, ha, wa), (rb, hb, wb) = sides
            rows, hashes = np.r_[ra, rb], np.r_[ha, hb]
            order = np.lexsort((hashes, rows))
            rows, hashes, w = rows[order], hashes[order], np.r_[wa, wb][order].astype(np.float64)
            both = np.flatnonzero((rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1]))
            least = np.bincount(rows[both], np.minimum(w[both], w[both + 1]), part.num_rows)
            total = np.bincount(rows, w, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(least / np.maximum(total - least, 1e-12))], names=["a", "b", "similarity"])
        ta.release()


def _salt(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(_SALTS)).cast("int")


def _salts() -> Column:
    """The salts whose bits are set in ``mask``: a row for each salt that occurs, and no other."""
    return F.explode(F.expr(f"filter(sequence(0, {_SALTS - 1}), i -> mask & shiftleft(1L, i) != 0)"))


def _verified(pairs: DataFrame, texts: DataFrame, weights, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least the similarity, computed from their texts. The pairs of an a with over
    ``_PAIRS`` of them are dealt over several tasks."""
    salted = pairs.withColumn("salt", _salt("b"))
    many = salted.groupBy("a", "salt").agg(F.count("*").alias("n")).groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") > _PAIRS).select("a")
    spread = many.select("a", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"), F.lit(True).alias("many"))
    dealt = salted.join(spread, ["a", "salt"], "left").withColumn("salt", F.when(F.col("many"), F.col("salt")).otherwise(0)).drop("many")
    side = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(many.withColumn("many", F.lit(True)), "a", "left")
    side = side.select("a", "text_a", F.explode(F.when(F.col("many"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    with_a = dealt.join(side, ["a", "salt"])
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda it: _similarity(it, weights), "a binary, b binary, similarity double").filter(F.col("similarity") >= similarity)


def _mixed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, class, band, key, n): the members of the buckets that still hold several classes."""
    own = members.select("node", "band", "key", _salt("node").alias("salt")).join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = own.groupBy("band", "key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, salt))").alias("mask")).filter("x != y")
    return own.join(mixed.select("band", "key", "n", _salts().alias("salt")), ["band", "key", "salt"]).select("node", "class", "band", "key", "n")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of rows sorted by ``_CELL``, a table for each cell."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in _CELL])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if kept and any(kept[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in _CELL):
            cuts = np.r_[0, cuts]
        for at, to in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            if to > at:
                kept.append(batch.slice(at, to - at))
            if to < batch.num_rows:  # the group ends here
                if kept:
                    yield pa.Table.from_batches(kept)
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def _numbered(values: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(v, len(numbers)) for v in values], np.int64)


def _likely(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``_CELL``, the nodes of a cell that may have a link between its blocks x and y, with their
    places in the cell and the places of their ``partners``: nodes of different classes, of weights that allow the similarity,
    and of sketches that agree often enough. A pair is in one of its lists, and of two finer bands in the first."""
    need = int(SKETCH * similarity - SLACK * (SKETCH * similarity * (1 - similarity)) ** 0.5)
    for cell in _cells(batches):
        own, classes = cell.column("own").to_numpy(), _numbered(cell.column("class").to_pylist())
        w, x, y, fine = cell.column("weight").to_numpy(), *(cell.column(c)[0].as_py() for c in ("x", "y", "fine"))
        sketch = pc.list_flatten(cell.column("sketch").combine_chunks()).to_numpy().reshape(len(own), -1)
        left = np.flatnonzero(own == x)
        right = left if x == y else np.flatnonzero(own == y)
        may = (classes[left][:, None] != classes[right]) & (np.minimum(w[left][:, None], w[right]) >= similarity * np.maximum(w[left][:, None], w[right]))
        i, j = np.nonzero(np.triu(may) if x == y else may)
        i, j = left[i], right[j]
        ok = np.zeros(len(i), bool)
        for at in range(0, len(i), _STEP // SKETCH):
            part_of = slice(at, at + _STEP // SKETCH)
            same = sketch[i[part_of]] == sketch[j[part_of]]
            ok[part_of] = same.sum(1) >= need
            if fine > 0:
                ok[part_of] &= ~same[:, BANDS * ROWS : BANDS * ROWS + fine * FINE_ROWS].reshape(-1, fine, FINE_ROWS).all(2).any(1)
        i, j = i[ok], j[ok]  # by i
        at = np.unique(np.r_[i, j])
        if len(at):
            partners = pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(i, at), len(i)], pa.int32()), pa.array(j, pa.int32()))
            rows = cell.select([*_CELL, "node", "class"]).take(pa.array(at)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at, pa.int32()), partners], names=[*rows.schema.names, "place", "partners"])


def _linked(batches: Iterator[pa.RecordBatch], weights, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows of ``_likely`` with their texts, sorted by ``_CELL``, the pairs (a, b) of classes that verified links of a cell's
    nodes join: a link whose classes the links before have joined is left out."""
    for cell in _cells(batches):
        names, parts, done = cell.column("class").to_pylist(), [], 0
        for batch in cell.select(["text"]).to_batches():
            for part in ta.slices(batch, limit=_STEP):
                rows, hashes, counts = shingles(part.column("text"))
                parts.append((rows + done, hashes, weights.value(hashes, counts)))
                done += part.num_rows
        rows, hashes, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        w = w.astype(np.float64)
        different, ids = np.unique(hashes, return_inverse=True)
        first = np.searchsorted(rows, np.arange(len(names) + 1))
        total, mine = np.add.reduceat(w, first[:-1]), np.zeros(len(different))
        classes, where = _numbered(names), {p: k for k, p in enumerate(cell.column("place").to_pylist())}
        found: list[tuple[bytes, bytes]] = []
        for i, partners in enumerate(cell.column("partners").to_pylist()):
            others = np.array([where[p] for p in partners], np.int64)
            own = slice(first[i], first[i + 1])
            mine[ids[own]] = w[own]
            while len(others := others[classes[others] != classes[i]]):
                # as many at a time as have about _STEP shingles
                sizes = first[others + 1] - first[others]
                n = max(1, int(np.searchsorted(np.cumsum(sizes), _STEP, "right")))
                now, others, sizes = others[:n], others[n:], sizes[:n]
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) + np.repeat(first[now] - (ends - sizes), sizes)
                least = np.add.reduceat(np.minimum(mine[ids[at]], w[at]), ends - sizes)
                for j in now[least / np.maximum(total[i] + total[now] - least, 1e-12) >= similarity]:
                    if classes[j] != classes[i]:
                        classes[classes == classes[j]] = classes[i]
                        found.append((names[i], names[j]))
            mine[ids[own]] = 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
        ta.release()


def _candidates(mixed: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """By cell, the nodes that share a bucket, or in large buckets a finer band, with nodes of other classes whose
    samples and weights allow a link; see ``_likely``. sketched: (node, class, weight, sketch) of every node of ``mixed``."""
    small = mixed.filter(F.col("n") <= SPLIT).select("node", F.xxhash64("band", "key").alias("cell"), F.lit(-1).alias("fine"), *(F.lit(0).alias(c) for c in ("x", "y", "own")))
    keys = F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda i: F.xxhash64(i, F.slice("sketch", i * FINE_ROWS + BANDS * ROWS + 1, FINE_ROWS)))
    large = mixed.filter(F.col("n") > SPLIT).select("node").distinct().join(sketched, "node")
    fine = large.select("node", "class", F.posexplode(keys).alias("fine", "cell")).withColumn("salt", _salt("node"))
    # nodes only go where several classes agree, and to as many pairs of blocks as the cell needs
    split = fine.groupBy("fine", "cell").agg(F.min("class").alias("u"), F.max("class").alias("v"), F.count("*").alias("m"), F.expr("bit_or(shiftleft(1L, salt))").alias("mask")).filter("u != v")
    split = split.select("fine", "cell", F.ceil(F.col("m") / SPLIT).cast("int").alias("blocks"), _salts().alias("salt"))
    fine = fine.join(split, ["fine", "cell", "salt"]).withColumn("own", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int"))
    fine = fine.select("node", "fine", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("node", "cell", "fine", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    cells = small.unionByName(fine).join(sketched, "node").select("cell", "fine", "x", "y", "own", "node", "class", "weight", "sketch")
    dealt = cells.repartition(*_CELL).sortWithinPartitions(*_CELL)
    return dealt.mapInArrow(lambda it: _likely(it, similarity), "cell long, fine int, x int, y int, node binary, class binary, place int, partners array<int>")


def _rest(mixed: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of ``_candidates``, a row each: what ``_links`` compares without making rows of it."""
    likely = _candidates(mixed, sketched, similarity).withColumn("row", F.struct(*_CELL))
    pairs = likely.select("row", "node", F.explode("partners").alias("place")).join(likely.select("row", "place", F.col("node").alias("other")), ["row", "place"])
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _links(candidates: DataFrame, texts: DataFrame, weights, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes that join all that verified links of the candidates join, fewer than a cell has nodes."""
    rows = candidates.join(texts, "node").select(*_CELL, "class", "place", "partners", "text")
    dealt = rows.repartition(*_CELL).sortWithinPartitions(*_CELL)
    return dealt.mapInArrow(lambda it: _linked(it, weights, similarity), "a binary, b binary")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node (a digest of the text), class_id (the least doc_id of the class) and class_node (a digest
    that names the class even where rows share a doc_id). Node and class_node of a null text are null."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("node"))
    present = rows.filter("text is not null")
    weights = spark.sparkContext.broadcast(document_frequencies(present))
    signed = present.select("node", "doc_id", "text").mapInArrow(lambda it: _sign(it, weights), "node binary, doc_id long, weight double, bands array<long>")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("weight").alias("weight"), F.first("bands").alias("bands")).checkpoint()

    banded = nodes.select("node", "doc_id", F.posexplode("bands").alias("band", "key")).withColumn("salt", _salt("node"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, salt))").alias("mask")).filter("n > 1")
    shared = banded.join(buckets.select("band", "key", "n", "mask", _salts().alias("salt")), ["band", "key", "salt"])
    central = shared.groupBy("node").agg(F.sum("n").alias("score"))
    members = shared.join(central, "node").select("node", "doc_id", "band", "key", "salt", "mask", "score").checkpoint()
    # one row a node: copies are spread by their doc_id, and the node's least one is taken
    chosen = members.select("node", "doc_id").distinct()
    of_rows = present.select("node", F.coalesce("doc_id", F.lit(-1 << 63)).alias("doc_id"), "text")
    texts = of_rows.join(chosen.select("node", F.coalesce("doc_id", F.lit(-1 << 63)).alias("doc_id")), ["node", "doc_id"], "left_semi").groupBy("node").agg(F.first("text").alias("text")).checkpoint()

    pivots = members.groupBy("band", "key").agg(F.min_by("node", F.struct("doc_id", "node")).alias("first"), F.max_by("node", F.struct("score", "node")).alias("center"), F.first("mask").alias("mask"))
    pivots = pivots.select("band", "key", "first", "center", _salts().alias("salt"))
    pairs = members.select("band", "key", "salt", F.col("node").alias("b")).join(pivots, ["band", "key", "salt"]).select("b", F.explode(F.array("first", "center")).alias("a")).filter("a != b").distinct()
    links = _verified(pairs, texts, weights, similarity).select("a", "b").checkpoint()
    classes = components(links).withColumnRenamed("component", "class")
    mixed = _mixed(members, classes).checkpoint()
    unsure = mixed.select("node", "class").distinct().join(nodes.select("node", "weight"), "node").join(texts, "node").select("node", "class", "weight", "text")
    sketched = unsure.mapInArrow(lambda it: _sketch(it, weights), "node binary, class binary, weight double, sketch array<tinyint>").checkpoint()
    more = _links(_candidates(mixed, sketched, similarity), texts, weights, similarity).checkpoint()

    ids = rows.select("doc_id", "node")
    least = ids.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    if not more.isEmpty():  # classes become one by few links between them
        least = least.join(components(more).withColumnRenamed("node", "class"), "class", "left").select("node", "least", F.coalesce("component", "class").alias("class"))
    named = least.groupBy("class").agg(F.min("least").alias("class_id"))
    named = least.select("node", "class").join(named, "class").select("node", "class_id", F.col("class").alias("class_node"))
    return ids.join(named, "node", "left").select("doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), "class_node")


def one_of_each_class(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the least doc_id stays, once. Rows with null text stay.
    Columns pass through, whatever their names."""
    own, doc, key = fresh(docs.columns, "own", "least", "digest")
    classes = near_classes(docs, similarity).select("doc_id", "node", "class_node").checkpoint()
    node = F.unhex(F.md5(F.col("text").cast("string").cast("binary")))
    kept = classes.filter("class_node is not null").groupBy("class_node").agg(F.min_by(F.struct("doc_id", "node"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k")).select(F.col("k.doc_id").alias(doc), F.col("k.node").alias(key))
    rows = docs.withColumn(own, node)
    same = rows["doc_id"].cast("long").eqNullSafe(kept[doc]) & (rows[own] == kept[key])
    once = rows.filter("text is not null").join(kept, same, "left_semi")
    if not classes.filter("class_node is not null").groupBy("doc_id", "node").count().filter("count > 1").isEmpty():
        once = once.dropDuplicates(["doc_id", own])
    return once.unionByName(rows.filter("text is null")).drop(own)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE: dict[str, str] = {}
