"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key, the signs of its projections on random directions
one after another, and all vectors of a label are ordered by that key. Near vectors
agree on the first signs more often than others and so lie close to each other: the
order is cut into blocks of ``BLOCK`` rows, and each block is compared with itself and
the next one. The links of all passes together are the result.

A vector is compared with a bounded window in each pass, but no group is cut short by it:
where over ``BLOCK`` vectors share the first signs (so many of them that few vectors would
share them by chance), all of these are compared, in pairs of chunks of ``CHUNK`` rows.
So a pair at the similarity is found with a probability of ``RECALL`` at least, whatever
the number of vectors or the size of its group; the number of passes follows from it.

No pair becomes a row. A task counts the links of its vectors and leaves one edge for each
vector that joins its links' components; a pair that several passes find counts in the
first only, which its places in all passes tell. Equal vectors of a label are one node with
a number. Cosines are taken in double precision from the vectors themselves.

Rows: a null label, and a null, empty or zero vector or one with a null, NaN or infinite
component links with nothing. So do a null id's vectors, whose component is null. Vectors of
different lengths are not compared. Repeated rows are vectors of their own that link with
each other. Very long vectors are compared like others. An empty table gives an empty
result; columns beyond vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.graph import components
from corpusloom.llm.shared import ensure_checkpoint_dir, ranked

SIMILARITY = 0.93
#: Of the pairs at exactly the similarity, the share that is found at least.
RECALL = 0.98
BLOCK = 512
#: Blocks in a task, and rows in a chunk of a large group.
BLOCKS = 16
CHUNK = 4096
BITS = 32
_TILE = 1 << 19
_SALTS = 32
_KEPT = "node binary, links long, root binary"


def _passes(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(signs that make a cell, passes) for n vectors of a label: a cell of evenly spread vectors is half a block."""
    signs = min(BITS, max(0, math.ceil(math.log2(max(n, 1) / BLOCK)) + 1))
    one = (1 - math.acos(similarity) / math.pi) ** signs
    return signs, 1 if one == 1 else math.ceil(math.log(1 - recall) / math.log(1 - one))


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) for each length of vector."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        own = pc.list_flatten(column.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)
        own = own / np.abs(own).max(1)[:, None]  # so that no square overflows
        yield rows, own / np.sqrt((own * own).sum(1))[:, None]


def _keys(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            keys = np.empty((part.num_rows, passes), np.int64)
            for rows, own in _units(part.column("vector")):
                n = own.shape[1]
                if n not in planes:
                    planes[n] = np.random.default_rng([11, n]).standard_normal((passes * BITS, n)).T
                keys[rows] = ((own @ planes[n]).reshape(len(rows), passes, BITS) > 0) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * passes), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("kind"), lists], names=["node", "kind", "keys"])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the pairs (i, j) join it to."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, least[i], low)
        np.minimum.at(new, least[j], low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


class _Task:
    """The rows of a task, and what is found among them."""

    def __init__(self, table: pa.Table, now: int, similarity: float):
        self.table, self.now, self.similarity = table, now, similarity
        column = lambda c: table.column(c).combine_chunks()
        self.blocks, self.cells = (pc.list_flatten(column(c)).to_numpy().reshape(table.num_rows, -1) for c in ("blocks", "cells"))
        self.copies = table.column("n").to_numpy()
        self.kind = column("kind").dictionary_encode().indices.to_numpy()
        self.vectors = column("vector")
        self.links, self.edges = np.zeros(table.num_rows, np.int64), []

    def compare(self, rows: np.ndarray, pairs) -> None:
        """rows: of one kind. pairs: (left, right, may) by places in rows; may(i, j) says which pairs are this task's to count."""
        (_, x), *_ = _units(self.vectors.take(pa.array(rows)))
        for left, right, may in pairs:
            step = max(1, _TILE // max(1, len(right)))
            for at in range(0, len(left), step):
                own = left[at : at + step]
                i, j = np.nonzero(x[own] @ x[right].T >= self.similarity)
                i, j = own[i], right[j]
                ok = may(i, j)
                i, j = rows[i[ok]], rows[j[ok]]
                new = np.ones(len(i), bool)
                for q in range(self.now):  # an earlier pass has compared them
                    new &= (np.abs(self.blocks[i, q] - self.blocks[j, q]) > 1) & (self.cells[i, q] != self.cells[j, q])
                i, j = i[new], j[new]
                if len(i):
                    self.links += np.bincount(i, self.copies[j], len(self.links)).astype(np.int64) + np.bincount(j, self.copies[i], len(self.links)).astype(np.int64)
                    least = _forest(len(self.links), i, j)
                    joined = np.flatnonzero(least != np.arange(len(least)))
                    self.edges.append((joined, least[joined]))

    def kept(self) -> pa.Table:
        rows, root = np.flatnonzero(self.links), np.arange(len(self.links))
        if self.edges:
            root = _forest(len(root), *(np.concatenate(e) for e in zip(*self.edges, strict=True)))
        node = self.table.column("node").combine_chunks()
        return pa.table({"node": node.take(pa.array(rows)), "links": pa.array(self.links[rows]), "root": node.take(pa.array(root[rows]))})


def _window(table: pa.Table, now: int, similarity: float) -> pa.Table:
    """Blocks of one part, and the first one after it: each own block with itself and the next."""
    task, block, own = _Task(table, now, similarity), table.column("block").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
    order = np.lexsort((block, task.kind))
    cuts = np.flatnonzero(np.r_[True, task.kind[order][1:] != task.kind[order][:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            rows = order[a:b]
            at = block[rows]

            def pairs(at=at, mine=own[rows]):
                for first in np.unique(at[mine]):
                    lo, mid, hi = np.searchsorted(at, [first, first + 1, first + 2])
                    yield np.arange(lo, mid), np.arange(lo, hi), lambda i, j: i < j

            task.compare(rows, pairs())
    return task.kept()


def _chunks(table: pa.Table, now: int, similarity: float) -> pa.Table:
    """Two chunks, or one, of a large cell: the pairs that no window of this pass holds."""
    task = _Task(table, now, similarity)
    own, x, y = table.column("chunk").to_numpy(), table.column("x")[0].as_py(), table.column("y")[0].as_py()
    block = task.blocks[:, now]
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    apart = lambda i, j: (np.abs(block[i] - block[j]) > 1) & ((i < j) if x == y else True)
    if len(left) and len(right):
        task.compare(np.arange(table.num_rows), [(left, right, apart)])
    return task.kept()


def _placed(nodes: DataFrame, signs: int, passes: int) -> tuple[DataFrame, set[int]]:
    """The nodes with their places in all passes: blocks, cells, and for cells over a block (first rank, own chunk,
    chunks), else null; and the passes that have such cells."""
    keyed = nodes.select("node", "kind", "vector").mapInArrow(lambda it: _keys(it, passes), "node binary, kind string, keys array<long>")
    spread = keyed.select("node", "kind", F.posexplode("keys").alias("pass", "key"))
    order = ranked(spread, ["pass"], [F.col("kind"), F.col("key"), F.col("node")])
    order = order.select("node", "kind", "pass", "rank", F.floor(F.col("rank") / BLOCK).cast("int").alias("block"), F.shiftright("key", BITS - signs).alias("cell"))
    large = order.groupBy("pass", "kind", "cell").agg(F.min("rank").alias("first"), F.count("*").alias("size")).filter(F.col("size") > BLOCK).checkpoint()
    which = {r["pass"] for r in large.select("pass").distinct().collect()}  # numbers of passes
    if which:
        # joined by block, so that no key has more rows than a block
        held = large.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK).cast("int"), F.floor((F.col("first") + F.col("size") - 1) / BLOCK).cast("int"))))
        order = order.join(held, ["pass", "kind", "cell", "block"], "left")
    else:
        order = order.withColumn("first", F.lit(None).cast("long")).withColumn("size", F.lit(None).cast("long"))
    chunk = F.when(F.col("first").isNotNull(), F.struct("first", F.floor((F.col("rank") - F.col("first")) / CHUNK).cast("int").alias("own"), F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")))
    places = order.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pass", "block", "cell", chunk.alias("chunk")))).alias("p"))
    return nodes.join(places.select("node", F.col("p.block").alias("blocks"), F.col("p.cell").alias("cells"), F.col("p.chunk").alias("large")), "node").checkpoint(), which


def _links(nodes: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """((node, links), edges (a, b)) over the nodes (node, kind, vector, n)."""
    most = nodes.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    signs, passes = _passes(most, similarity, recall)
    placed, large = _placed(nodes, signs, passes)
    kept = None

    def task(f, now: int):
        return lambda table: f(table, now, similarity)

    for now in range(passes):
        at = placed.select("node", "kind", "vector", "n", "blocks", "cells", F.col("blocks")[now].alias("block"), F.col("large")[now].alias("large"))
        part = F.floor(F.col("block") / BLOCKS).cast("int")
        to = F.when((F.col("block") % BLOCKS == 0) & (F.col("block") > 0), F.array(part, part - 1)).otherwise(F.array(part))
        near = at.drop("large").select("*", F.explode(to).alias("part")).withColumn("own", part == F.col("part"))
        found = near.groupBy("part").applyInArrow(task(_window, now), _KEPT)
        if now in large:
            wide = at.filter("large is not null").select("*", F.col("large.first").alias("first"), F.col("large.own").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("large.chunks") - 1)).alias("other"))
            wide = wide.withColumn("x", F.least("chunk", "other")).withColumn("y", F.greatest("chunk", "other")).drop("large", "other", "block")
            found = found.unionByName(wide.groupBy("first", "x", "y").applyInArrow(task(_chunks, now), _KEPT))
        found = found.checkpoint()  # pass after pass, so that one pass's rows are on disk at a time
        kept = found if kept is None else kept.unionByName(found)
    return kept.groupBy("node").agg(F.sum("links").alias("links")), kept.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links (other vectors of the label with a cosine of at least ``similarity``), component_id (the least
    vec_id that links lead to, its own without links) and kept (whether that is its own), for each row."""
    ensure_checkpoint_dir(vectors.sparkSession)
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists("vector", lambda x: x != 0)
    kind = F.concat_ws(" ", F.size("vector").cast("string"), F.col("label").cast("string"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), "label")
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite
    digest = F.unhex(F.md5(F.concat_ws(" ", kind, *(F.hex(F.xxhash64(F.lit(seed), "vector")) for seed in (11, 29))).cast("binary")))
    rows = rows.withColumn("node", F.when(known, digest)).withColumn("kind", kind)
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).cast("int")
    present = rows.filter("node is not null").select("node", "kind", "vector", "vec_id", salt.alias("salt"))
    nodes = present.groupBy("node").agg(F.first("kind").alias("kind"), F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("least"), F.expr("bit_or(shiftleft(1L, salt))").alias("mask")).checkpoint()

    links, edges = _links(nodes.select("node", "kind", "vector", "n"), similarity, recall)
    classes = components(edges).withColumnRenamed("component", "class")
    joined = nodes.select("node", "n", "least", "mask").join(links, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    named = joined.groupBy("class").agg(F.min("least").alias("component_id"), F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(node), 32) as int)))").alias("users"))
    each = F.explode(F.expr(f"filter(sequence(0, {_SALTS - 1}), i -> mask & shiftleft(1L, i) != 0)")).alias("salt")
    named = named.select("class", "component_id", F.explode(F.expr("filter(sequence(0, 31), i -> users & shiftleft(1L, i) != 0)")).alias("user"))
    told = joined.withColumn("user", F.expr("cast(pmod(xxhash64(node), 32) as int)")).join(named, ["class", "user"])
    told = told.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), each)
    ids = rows.select("vec_id", "node", salt.alias("salt")).join(told, ["node", "salt"], "left")
    ids = ids.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return ids.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_vector_dedup": op11_vector_dedup}
ORACLE: dict[str, str] = {}
