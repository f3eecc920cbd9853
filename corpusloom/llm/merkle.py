"""A Merkle manifest of a table: content-addressed records, and proofs by descent from the root.

A row's leaf is the digest of its fields. The leaves of a language, by doc_id, are
hashed two by two, level upon level, to the language's subroot; the subroots, by
language, likewise to the root. ``SPAN`` levels at a time are worked out in one row: a
*record* says which nodes, 2 ** SPAN at most, lie ``height`` levels below a digest. A
table of any size so takes a few shuffles of digests, each 1/256 of the one before, and
texts are read once and never shuffled.

Proofs are made from the records alone. Requested leaves descend together: from the
root, the digits of their ranks (base 2 ** SPAN) say which children of a record are wanted;
the unselected sibling of each level on the way is collected, from the root down. Each
node is opened once, however many requests pass through it. At the leaves the segments
of the way are reversed, so that a proof reads from leaf to root.

Rows: a null field is ``-``, so null and empty texts differ; a null lang is a tree of its
own, before the others. Rows that share lang and doc_id are ordered by their leaves, a null
doc_id comes first; equal rows are leaves of their own. Very long texts are hashed whole. An empty
table gives an empty result; columns beyond those of documents are neither hashed nor used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import ensure_checkpoint_dir, fold, ranked

#: Levels in one record.
SPAN = 8
#: Of the rows' folds, the one whose rows are tampered with.
TAMPERED = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<right:boolean,sibling:string>>"


@dataclass
class Manifest:
    """leaves: (tree, rank, doc_id, leaf, tampered). records: for each step, the nodes' records (digest, children, height),
    the first step's children being leaves. tops: (tree, step, digest), the record that each tree ends in. trees: the
    manifest of the subroots, whose only tree is ``-``; None for itself."""

    leaves: DataFrame
    records: list[DataFrame]
    tops: DataFrame
    trees: Manifest | None = None


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, some of them changed."""
    texts = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return _hash(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _levels(children: str, height: str) -> Column:
    """All levels of a record, its children first and its digest, alone, last."""

    def above(level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(level) - 1, 1))
        return F.transform(pairs, lambda i: _hash(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.lit(""))))

    steps = F.slice(F.sequence(F.lit(0), F.col(height)), F.lit(2), F.col(height))
    first = F.array(F.col(children)).cast("array<array<string>>")
    return F.aggregate(steps, first, lambda made, _: F.concat(made, F.array(above(F.element_at(made, -1)))))


def grow(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(records of each step, tops) over the leaves (tree, rank, leaf)."""
    nodes, records, tops = leaves.select("tree", "rank", F.col("leaf").alias("digest")), [], None
    while True:
        # the node after a tree's first record goes there as well, to tell that the tree goes on
        own = F.when(F.col("rank") == 1 << SPAN, F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).otherwise(F.array(F.shiftright("rank", SPAN)))
        dealt = nodes.select("tree", "rank", "digest", F.explode(own).alias("at"))
        held = dealt.groupBy("tree", "at").agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("held"))
        held = held.select("tree", "at", ((F.col("at") > 0) | (F.element_at("held", -1)["rank"] >= 1 << SPAN)).alias("more"), F.slice(F.col("held.digest"), 1, 1 << SPAN).alias("children"))
        size = F.size("children")
        height = F.when(F.col("more"), SPAN).when(size == 1, 0).otherwise(F.length(F.bin((size - 1).cast("long"))))
        made = held.withColumn("height", height).withColumn("digest", F.element_at(_levels("children", "height"), -1)[0]).checkpoint()
        done = made.filter(~F.col("more")).select("tree", F.lit(len(records)).alias("step"), "digest")
        tops = done if tops is None else tops.unionByName(done)
        records.append(made.groupBy("digest").agg(F.first("children").alias("children"), F.first("height").alias("height")))
        nodes = made.filter("more").select("tree", F.col("at").alias("rank"), "digest")
        if nodes.isEmpty():
            return records, tops


def build(docs: DataFrame) -> Manifest:
    ensure_checkpoint_dir(docs.sparkSession)
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    tampered = F.when(fold("doc_id", TAMPERED) == 0, leaf(n_chars=more)).otherwise(F.col("leaf"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select(*FIELDS).withColumn("leaf", leaf()).select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), "leaf", tampered.alias("tampered")).checkpoint()
    leaves = ranked(rows, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    records, tops = grow(leaves)
    own = ranked(tops.select("tree", F.col("digest").alias("leaf")), [], [F.col("tree")])
    trees = own.select(F.lit("-").alias("tree"), "rank", F.col("tree").alias("name"), "leaf")
    return Manifest(leaves, records, tops, Manifest(trees, *grow(trees)))


def _descend(manifest: Manifest, tops: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests (tree, rank, and more) with their leaf's ``digest`` and ``path``, from the root down, and the columns
    of their tree's row in tops (tree, step, digest, path, and more). Requests for ranks that a tree lacks give no row."""
    fields = [c for c in requests.columns if c not in ("tree", "rank")]
    carried = [c for c in tops.columns if c not in ("tree", "step", "digest", "path")]
    digit = lambda c: (F.col(c) % (1 << SPAN)).cast("int").alias("digit")
    asked = [requests.groupBy("tree", F.shiftright("rank", SPAN).alias("at")).agg(F.collect_list(F.struct(digit("rank"), *fields)).alias("asked"))]
    for _ in manifest.records[1:]:
        below = asked[-1].select("tree", "at")
        asked.append(below.groupBy("tree", F.shiftright("at", SPAN).alias("above")).agg(F.collect_list(F.struct(digit("at"))).alias("asked")).withColumnRenamed("above", "at"))
    front = None
    for step in reversed(range(len(manifest.records))):
        new = tops.filter(F.col("step") == step).drop("step").withColumn("at", F.lit(0).cast("long"))
        front = new if front is None else front.unionByName(new)
        opened = front.join(manifest.records[step], "digest").join(asked[step], ["tree", "at"]).withColumn("levels", _levels("children", "height"))

        def way(a: Column) -> Column:
            """The siblings of this digit's node, from the record's digest down."""
            down = F.slice(F.reverse(F.sequence(F.lit(0), F.col("height"))), F.lit(2), F.col("height"))

            def sibling(level: Column) -> Column:
                place = F.floor(a["digit"] / F.pow(F.lit(2), level)).cast("int")
                return F.struct((place % 2 == 1).alias("right"), F.get(F.get("levels", level), place + 1 - place % 2 * 2).alias("sibling"))

            return F.concat(F.col("path"), F.transform(down, sibling).cast(_PATH))

        kept = fields if step == 0 else []
        each = F.transform("asked", lambda a: F.struct(*(a[c].alias(c) for c in kept), a["digit"].alias("digit"), F.get("children", a["digit"]).alias("digest"), way(a).alias("path")))
        front = opened.select("tree", "at", *carried, F.explode(each).alias("e")).filter("e.digest is not null")
        front = front.select("tree", (F.col("at") * (1 << SPAN) + F.col("e.digit")).alias("at"), *carried, *(F.col(f"e.{c}").alias(c) for c in [*kept, "digest", "path"]))
    return front.withColumnRenamed("at", "rank")


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The requested leaves (tree, rank, and further columns; by default all) with leaf, subroot, root and path: of each
    level from the leaf up to the root, whether the node is the right one, and its sibling (null without one)."""
    top = manifest.trees
    root = top.tops.select("tree", "step", "digest", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    # the subroots are the leaves of the upper tree, and where the languages' trees are entered
    ways = _descend(top, root, top.leaves.select("tree", "rank", "name")).select(F.col("name").alias("tree"), "root", "path", F.col("digest").alias("subroot"))
    entered = manifest.tops.join(ways, "tree")
    found = _descend(manifest, entered, manifest.leaves.select("tree", "rank", "doc_id", "tampered") if requests is None else requests)
    return found.withColumn("path", F.reverse("path")).withColumnRenamed("digest", "leaf")


def folded(digest: str, path: str = "path") -> Column:
    """The root that a leaf's digest leads to by this path."""
    return F.aggregate(F.col(path), F.col(digest), lambda own, s: F.when(s["right"], _hash(s["sibling"], own)).otherwise(_hash(own, F.coalesce(s["sibling"], F.lit("")))))


def proof_digest(path: str = "path") -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proofs(build(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded("tampered").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(c: str) -> str:
    return f"coalesce(cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar), '-')"


def _leaf_sql(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


#: crc32 of the decimal id: its bytes, each followed by the eight shifts.
_CRC_SQL = """xor(4294967295, list_reduce(flatten(list_transform(range(length(cast(doc_id as varchar))), lambda i: [ord(cast(doc_id as varchar)[i + 1]), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end, 4294967295))"""


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {
    "op12_merkle_manifest": f"""
with recursive hashed as (select doc_id, coalesce('=' || lang, '') as tree, {_leaf_sql()} as leaf, {_leaf_sql("(n_chars + 1)")} as other from documents),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as rank, count(*) over (partition by tree) as size from hashed),
low as (
  select tree, 0 as level, rank as pos, leaf as digest, size as n from leaves
  union all
  select tree, level + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 1) // 2 from low where n > 1 group by tree, level, pos // 2),
subroots as (select tree, digest, row_number() over (order by tree) - 1 as rank, count(*) over () as size from low where n = 1),
high as (
  select 0 as level, rank as pos, digest, size as n from subroots
  union all
  select level + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 1) // 2 from high where n > 1 group by level, pos // 2),
high_ways as (
  select s.tree, list(cast((s.rank >> h.level) % 2 as varchar) || coalesce(o.digest, '') order by h.level) as way
  from subroots s join (select distinct level from high where n > 1) h on true left join high o on o.level = h.level and o.pos = xor(s.rank >> h.level, 1) group by s.tree),
low_ways as (
  select l.tree, l.rank, list(cast((l.rank >> h.level) % 2 as varchar) || coalesce(o.digest, '') order by h.level) as way
  from leaves l join (select distinct tree, level from low where n > 1) h on h.tree = l.tree left join low o on o.tree = l.tree and o.level = h.level and o.pos = xor(l.rank >> h.level, 1)
  group by l.tree, l.rank),
ways as (
  select l.*, s.digest as subroot, (select digest from high where n = 1) as root, list_concat(coalesce(w.way, []), coalesce(h.way, [])) as way
  from leaves l join subroots s on s.tree = l.tree left join low_ways w on w.tree = l.tree and w.rank = l.rank left join high_ways h on h.tree = l.tree),
done as (
  select *, list_reduce(way, lambda own, x: case when x[1] = '1' then sha256(x[2:] || own) else sha256(own || x[2:]) end,
                        case when {_CRC_SQL} % {TAMPERED} = 0 then other else leaf end) as folded_root from ways)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: x[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from done"""
}
