"""Substring search, page and section location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def search_substring(docs: DataFrame, text: Sequence[str], needle: str, order: Sequence[Column]) -> DataFrame:
    """Documents any of whose columns contains the needle, whatever the case; none for a blank needle."""
    if not needle.strip():
        return docs.limit(0)
    hit = F.lit(False)
    for t in text:
        hit = hit | F.coalesce(F.contains(F.lower(t), F.lit(needle.lower())), F.lit(False))
    return docs.filter(hit).orderBy(*order)


def page_split(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, text) from ``[Page N]`` markers; what stands before the first marker is dropped."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[Page ([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))
    parts = F.split(text, r"\[Page [0-9]+\]", -1)
    bodies = F.slice(parts, F.lit(2), F.size(parts))
    pages = docs.select(key, F.explode(F.arrays_zip(numbers.alias("page"), bodies.alias("text"))).alias("p"))
    return pages.select(key, F.col("p.page").alias("page"), F.trim("p.text").alias("text"))


def line_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, text) with every line as a page, from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def section_range(pages: DataFrame, key: str, start: str, ends: str) -> DataFrame:
    """(key, first, last): from the first page with the start header to the page before the first end header after it, else the last page."""
    first = pages.filter(F.col("text").rlike(start)).groupBy(key).agg(F.min("page").alias("first"))
    rows = pages.join(first, key)
    stop = F.min(F.when((F.col("page") > F.col("first")) & F.col("text").rlike(ends), F.col("page")))
    return rows.groupBy(key).agg(F.first("first").alias("first"), F.coalesce(stop - 1, F.max("page")).alias("last"))


def section_range_ranked(pages: DataFrame, key: str, strong: str, weak: str, ends: str, skip: int, sparse: int, most: int) -> DataFrame:
    """As above, from page ``skip`` on: a strong header wins anywhere, a weak one only on a sparse page; without an end at most ``most`` pages."""
    late = pages.filter(F.col("page") >= skip)
    is_weak = F.col("text").rlike(weak) & (F.length("text") <= sparse)
    first = late.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("text").rlike(strong), F.col("page"))), F.min(F.when(is_weak, F.col("page")))).alias("first")).filter("first is not null")
    rows = late.join(first, key)
    stop = F.min(F.when((F.col("page") > F.col("first")) & F.col("text").rlike(ends), F.col("page")))
    return rows.groupBy(key).agg(F.first("first").alias("first"), F.coalesce(stop - 1, F.least(F.max("page"), F.first("first") + most - 1)).alias("last"))


def phrase_span(pages: DataFrame, key: str, phrase: str, around: int, most: int, front: int = 1) -> DataFrame:
    """(key, first, last) page with the phrase, whatever the case and the blanks between its words; a single hit gets pages around
    it; at most ``most`` pages. Pages before ``front`` are not searched in documents that go beyond it: a contents page names the phrase."""
    words = [F.lower(F.lit(w)) for w in phrase.split()]
    low = F.regexp_replace(F.lower("text"), r"\s+", " ")
    ends = pages.groupBy(key).agg(F.max("page").alias("end"))
    hits = pages.filter(low.contains(F.concat_ws(" ", *words))).join(ends, key).filter((F.col("page") >= front) | (F.col("end") <= front))
    hits = hits.groupBy(key).agg(F.min("page").alias("a"), F.max("page").alias("b"), F.count("*").alias("n"), F.first("end").alias("end"))
    one = F.col("n") == 1
    first, last = F.when(one, F.greatest(F.col("a") - around, F.lit(1))).otherwise(F.col("a")), F.when(one, F.col("b") + around).otherwise(F.col("b"))
    return hits.select(key, first.alias("first"), F.least(last, F.col("end")).alias("last")).withColumn("last", F.least("last", F.col("first") + most - 1))


def text_density(pages: DataFrame, ranges: DataFrame, key: str, per_page: int) -> DataFrame:
    """Characters of a page range, and whether they reach so many a page."""
    inside = pages.join(ranges, key).filter(F.col("page").between(F.col("first"), F.col("last")))
    return inside.groupBy(key).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("pages")).withColumn("dense", F.col("chars") >= per_page * F.col("pages"))


def section_concat(pages: DataFrame, ranges: DataFrame, key: str, cap: int) -> DataFrame:
    """The range's text in page order, hashed whole and then cut."""
    inside = pages.join(ranges, key).filter(F.col("page").between(F.col("first"), F.col("last")))
    whole = inside.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("_t"))
    return whole.select(key, F.md5("_t").alias("digest"), F.left("_t", F.lit(cap)).alias("text"))


def keyword_excerpt(docs: DataFrame, key: str, text: str, pattern: str, window: int, head: int, tail: int, target: int) -> DataFrame:
    """(key, excerpt): texts of over ``target`` characters as head, merged windows around the keywords between, and tail; others whole.

    A window reaches half its size to both sides of a keyword's start. Windows are taken in order while they
    fit into what head and tail leave; the first one that does not is cut there and is the last.
    """
    size = F.length(text)
    middle = F.substring(text, F.lit(head + 1), size - head - tail)
    long = docs.filter(size > target).select(key, middle.alias("_middle"))
    between, hits = F.split("_middle", pattern, -1), F.regexp_extract_all("_middle", F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.transform(between, F.length).alias("b"), F.transform(hits, F.length).alias("h"))
    rows = long.select(key, F.length("_middle").alias("_size"), F.slice(steps, F.lit(1), F.size(hits)).alias("_steps")).filter(F.size("_steps") > 0)
    # only lengths leave the row; a running sum gives the offsets
    each = rows.select(key, "_size", F.posexplode("_steps").alias("_i", "_s"))
    end = F.sum(F.col("_s.b") + F.col("_s.h")).over(Window.partitionBy(key).orderBy("_i"))
    start = (end - F.col("_s.h")).cast("int")
    spots = each.select(key, F.greatest(start - window // 2, F.lit(0)).alias("a"), F.least(start + window // 2, F.col("_size")).alias("b"))
    w = Window.partitionBy(key).orderBy("a", "b")
    new = (F.col("a") > F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    islands = spots.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w)).groupBy(key, "_g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    room = target - head - tail
    used = F.coalesce(F.sum(F.col("b") - F.col("a")).over(Window.partitionBy(key).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fitting = islands.withColumn("_used", used).filter(F.col("_used") <= room).withColumn("b", F.least(F.col("b"), (F.col("a") + room - F.col("_used")).cast("int")))
    kept = fitting.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_spans"))
    mark = "\n\n[...]\n\n"
    chunks = F.transform("_spans", lambda s: F.substring(text, s["a"] + head + 1, s["b"] - s["a"]))
    cut = F.concat_ws(mark, F.left(text, F.lit(head)), F.nullif(F.array_join(chunks, mark), F.lit("")), F.right(text, F.lit(tail)))
    return docs.join(kept, key, "left").select(key, F.when(size <= target, F.col(text)).otherwise(cut).alias("excerpt"))


def dedup_by_hash(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each document's digest, the least key with the same text, and whether its result is reused."""
    keyed = docs.select(key, F.md5(text).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min(key).alias("source"))
    return keyed.join(first, "digest").withColumn("reused", F.col(key) != F.col("source"))
