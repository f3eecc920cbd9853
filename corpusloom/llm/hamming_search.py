"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit for the sign of each of its first 64 dimensions.
Codes are cut into m segments, each with a hash index: a row for each segment and
value with the list of the codes that hold it. The search radius grows by one in
all segments at a time: a round looks up the values that differ from the query's
segment in exactly r bits. Two codes at most m * (r + 1) - 1 apart agree to within
r bits in some segment, so once the k-th verified distance is no larger, the query
is done, ties included. A code of a list is verified only if it may still be among
the query's k nearest. Segments are short, about as many values as there are codes
or fewer, so the look-ups of a query at all radii together stay within the number
of values: a query far from everything ends like any other, after more rounds.

Equal codes are one entry, and equal query codes are one query, so that a vector
that a third of the rows hold costs as much as any other. The list of a value that
many codes share is cut into shares of about ``SHARE`` codes.

Rows: a null or empty embedding has no code and takes no part; a null element
counts as not positive; a null id takes no part. Rows that share an id and a
code count once. Ties go to the smaller id. Tables with fewer than k vectors
return them all. An empty table gives an empty result; columns beyond the id and
embedding are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import ensure_checkpoint_dir

BITS = 64
K = 10
#: Codes in one row of the index (about).
SHARE = 512
#: What verifying a code of a list costs, a look-up being 1.
_VERIFY = 0.02
_SALTS = 16


def sign_codes(vectors: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """(id, code): bit i of the code is set if dimension i is positive."""
    code = F.expr(f"aggregate(slice(embedding, 1, {BITS}), struct(0L as code, 0 as i), (a, x) -> struct(if(coalesce(x, 0) > 0, a.code | shiftleft(1L, a.i), a.code) as code, a.i + 1 as i), a -> a.code)")
    return vectors.filter(F.col(id_column).isNotNull() & (F.size("embedding") > 0)).select(F.col(id_column).cast("long").alias("id"), code.alias("code"))


def _entries(codes: DataFrame, k: int) -> DataFrame:
    """(code, ids): each code's k least ids. Salted, so that no code's rows meet in one task before they are cut to k."""
    first = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    rows = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
    rows = rows.groupBy("code", "salt", "id").agg(F.lit(1).alias("one")).withColumn("n", first(["code", "salt"])).filter(F.col("n") <= k)
    rows = rows.select("code", "id").withColumn("n", first(["code"])).filter(F.col("n") <= k)
    return rows.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _segments(n_codes: int, k: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments: as many as make a query cheapest, were the codes spread evenly.
    More segments need a smaller radius, but each look-up then finds a longer list."""
    within, distance = 0.0, -1
    while within < k and distance < BITS:
        distance += 1
        within += math.comb(BITS, distance) / 2**BITS * n_codes

    def cut(m: int) -> list[tuple[int, int]]:
        cuts = [BITS * i // m for i in range(m + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]

    def cost(m: int) -> float:
        return sum(sum(math.comb(n, r) for r in range(distance // m + 1)) * (1 + _VERIFY * n_codes / 2**n) for _, n in cut(m))

    least = max(2, -(-BITS // max(4, n_codes.bit_length())))  # no more values than codes
    return cut(min(range(least, max(17, least + 1)), key=cost))


def _part(code: str, at: int, size: int) -> str:
    return f"(shiftrightunsigned({code}, {at}) & {(1 << size) - 1}L)"


def _index(codes: DataFrame, segments: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(segment, value, share, codes): the codes (code, least, n) that hold the value, in shares of bounded size;
    and (segment, value, shares) of the values that have several."""
    parts = F.array(*(F.expr(_part("code", a, n)) for a, n in segments))
    held = codes.select(F.struct("code", "least", "n").alias("c"), F.posexplode(parts).alias("segment", "value"))
    shares = held.groupBy("segment", "value").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")).filter("shares > 1").checkpoint()
    held = held.join(shares, ["segment", "value"], "left").withColumn("share", F.pmod(F.xxhash64("c.code"), F.coalesce("shares", F.lit(1))).cast("int"))
    return held.groupBy("segment", "value", "share").agg(F.collect_list("c").alias("codes")), shares


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best codes of each query, by distance and least id: the k best ids are among theirs."""
    best = Window.partitionBy("query").orderBy("distance", "least")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of ``codes`` (id, code) for each row of ``queries`` (id, code)."""
    spark = codes.sparkSession
    ensure_checkpoint_dir(spark)
    entries = _entries(codes, k).checkpoint()
    segments = _segments(entries.count(), k)
    m = len(segments)
    index, shares = _index(entries.select("code", F.col("ids")[0].alias("least"), F.size("ids").alias("n")), segments)
    index = index.checkpoint()
    parts = [f"bit_count({_part('(query ^ c.code)', a, n)})" for a, n in segments]
    least = f"least({', '.join(parts)})"
    first = f"array_position(array({', '.join(parts)}), {least}) - 1"

    # limit: no code farther than this can be among the k nearest
    open_queries = queries.select(F.col("code").alias("query"), F.lit(BITS).alias("limit")).distinct().checkpoint()
    found = open_queries.select("query", F.lit(0).alias("distance"), F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("least"), F.lit(0).alias("n")).limit(0)
    done: list[DataFrame] = []
    own = F.array(*(F.struct(F.expr(_part("query", a, n)).alias("value"), F.lit(n).alias("size")) for a, n in segments))
    probes = open_queries.select("query", F.posexplode(own).alias("segment", "s")).select("query", "segment", "s.value", "s.size", F.lit(-1).alias("last"))
    radius = 0
    while not open_queries.isEmpty():
        if radius > max(n for _, n in segments):  # every value of every segment was looked up: fewer than k codes
            done.append(found)
            break
        # the values at exactly this radius grow from those before: bits are flipped in ascending order, so each value comes once
        if radius:
            flips = F.expr("filter(sequence(0, size - 1), b -> b > last)")
            probes = probes.join(open_queries.select("query"), "query", "left_semi").select("query", "segment", "value", "size", F.explode(flips).alias("last"))
            probes = probes.withColumn("value", F.expr("value ^ shiftleft(1L, last)")).checkpoint()
        asked = probes.select("query", "segment", "value").join(open_queries, "query")
        # a code that several segments find is taken from the first of its closest segments only
        near = f"""slice(array_sort(transform(filter(codes, c -> bit_count(query ^ c.code) <= limit and {least} = {radius} and {first} = segment),
            c -> struct(bit_count(query ^ c.code) as distance, c.least as least, c.code as code, c.n as n))), 1, {k})"""
        # every share of a frequent value is looked up under a key of its own
        asked = asked.join(shares, ["segment", "value"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
        hits = asked.join(index, ["segment", "value", "share"]).select("query", F.expr(near).alias("near")).filter(F.size("near") > 0)
        hits = hits.select("query", F.inline("near")).select("query", "distance", "code", "least", "n")
        found = _nearest(found.unionByName(hits), k).checkpoint()
        known = found.groupBy("query").agg(F.sum("n").alias("known"), F.sum(F.when(F.col("distance") <= m * (radius + 1) - 1, F.col("n"))).alias("covered"), F.max("distance").alias("farthest"))
        over = known.filter(F.col("covered") >= k).select("query")
        done.append(found.join(over, "query", "left_semi"))
        limit = F.when(F.col("known") >= k, F.least("limit", "farthest")).otherwise(F.col("limit"))
        left = open_queries.join(over, "query", "left_anti").join(known, "query", "left")
        open_queries = left.select("query", F.coalesce(limit, "limit").alias("limit")).checkpoint()
        found = found.join(open_queries.select("query"), "query", "left_semi")
        radius += 1
    results = found.limit(0)
    for part in done:
        results = results.unionByName(part)
    results = results.select("query", "distance", "code").join(entries, "code")
    ranked = results.select("query", "distance", F.explode("ids").alias("id"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).filter(F.col("rank") <= k)
    # one row with all hits of a query code, so that the join carries each query id once
    listed = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance"))).alias("hits"))
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return asked.join(listed, "query").select("query_id", F.inline("hits")).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.col("distance").cast("long").alias("distance"))


def op2_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(codes, codes.filter("id % 100 = 0")).withColumnRenamed("id", "vec_id")


QUERIES = {"op2_topk_hamming": op2_topk_hamming}
ORACLE = {
    "op2_topk_hamming": f"""
with codes as (select vec_id, list_transform(embedding[1:{BITS}], lambda x: coalesce(x, 0) > 0) as code from embeddings where vec_id is not null and len(embedding) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(len(list_filter(list_zip(q.code, c.code), lambda p: p[1] <> p[2])) as bigint) as distance
  from codes q, codes c where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs)
select query_id, cast(rank as bigint) as rank, vec_id, distance from ranked where rank <= {K}"""
}
