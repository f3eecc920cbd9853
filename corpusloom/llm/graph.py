"""Connected components of an undirected graph, by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks over which the edges of one node, or the members of one component, are dealt.
_SALTS = 62


def _salt(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(_SALTS)).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its least node.

    Each round takes the least name among a node's neighbours and then the name of that
    name, so chains halve; it ends when no name changes. The state is checkpointed every round.
    A node with many edges meets them in up to ``_SALTS`` tasks: its name goes to those that have any, which
    its edges tell once for all rounds. Members of a component ask for its name's name in rows
    of two names, which adaptive execution splits where a component has very many.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct().withColumn("salt", _salt("node")).checkpoint()
    asked = F.expr("bit_or(shiftleft(1L, asking))").alias("mask")
    names = both.withColumn("asking", _salt("other")).groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component"), asked).checkpoint()
    each = F.explode(F.expr(f"filter(sequence(0, {_SALTS - 1}), i -> mask & shiftleft(1L, i) != 0)")).alias("salt")
    while True:
        told = names.select(F.col("node").alias("other"), F.col("component").alias("heard"), each)
        heard = both.join(told, ["other", "salt"]).groupBy("node").agg(F.min("heard").alias("heard"))
        lower = names.join(heard, "node").select("node", "mask", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        of = names.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = lower.join(of, "component", "left").select("node", "mask", "old", F.least("component", F.coalesce("further", "component")).alias("component")).checkpoint()
        names = moved.select("node", "component", "mask")
        if moved.filter("component != old").isEmpty():
            return names.select("node", "component")
