"""Ranked full-text search over a stored index of posting blocks.

Documents are cut into *segments* of documents of like length. A block holds what one term
has in one segment: the documents, the frequencies and the positions, with the largest
frequency and the least length, from which a bound of any score in it follows. Blocks are
made where the documents are read, so that only blocks are shuffled, and are stored by
ranges of term and segment: a query reads the files of its terms, and a frequent term lies
in several of them.

A ranked query reads the bounds first. It scores the segments that promise most, and then
those others whose bound reaches the score of the last result so far: the result is that of
scoring everything.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.english import STOP_WORDS, stem

#: Letters with accents and what they fold to.
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Documents of a segment.
SEGMENT = 256
#: Segments that a ranked query scores before it knows a score to beat.
FIRST = 16
#: Positions between two columns of a document, so that no phrase of so many words goes across.
_GAP = 10
#: The term of the blocks that list all documents with a token.
_ALL = ""


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def words_of(text: str) -> list[str]:
    """The folded tokens of a query's text, in order."""
    return [t for t in re.split(r"[^\w]+|_", text.lower().translate(str.maketrans(_ACCENTED, _PLAIN))) if t]


@dataclass(frozen=True)
class Index:
    """blocks: (term, segment, n, occurrences, max_tf, min_length, keys, tfs, lengths, positions); words: a row a
    term (term, stem, df, occurrences); and the documents with a token, and their average length."""

    blocks: DataFrame
    words: DataFrame
    n_docs: int
    average: float


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.list_value_length(batch.column("tokens")).to_numpy()
        order = np.argsort(lengths, kind="stable")
        for first in range(0, len(order), size):
            part = batch.take(pa.array(order[first : first + size]))
            keys, tokens, own = part.column("key"), part.column("tokens"), lengths[order[first : first + size]]
            segment = int.from_bytes(hashlib.blake2b(repr(keys.to_pylist()).encode(), digest_size=8).digest(), "little", signed=True)
            words = pc.list_flatten(tokens).dictionary_encode()
            docs = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
            places = pc.list_flatten(part.column("places")).to_numpy()
            term = words.indices.to_numpy().astype(np.int64)
            at = np.lexsort((places, docs, term))
            term, docs, places = term[at], docs[at], places[at]
            pairs = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (docs[1:] != docs[:-1])])
            tfs = np.diff(np.r_[pairs, len(term)])
            cuts = np.flatnonzero(np.r_[True, term[pairs][1:] != term[pairs][:-1]])
            sizes = np.diff(np.r_[cuts, len(pairs)])
            n = len(cuts)
            lists = lambda values, bounds: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
            bounds, who = np.r_[cuts, len(pairs)], docs[pairs]
            columns = [
                words.dictionary.take(pa.array(term[pairs][cuts])), pa.array([segment] * n, pa.int64()), pa.array(sizes), pa.array(np.add.reduceat(tfs, cuts)), pa.array(np.maximum.reduceat(tfs, cuts)),
                pa.array(np.minimum.reduceat(own[who], cuts).astype(np.int64)), lists(keys.take(pa.array(who)), bounds), lists(pa.array(tfs), bounds), lists(pa.array(own[who].astype(np.int64)), bounds),
                lists(lists(pa.array(places), np.r_[pairs, len(places)]), bounds),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
            every = np.array([0, len(keys)])
            nothing = pa.ListArray.from_arrays(pa.array(np.zeros(len(keys) + 1, np.int32)), pa.array([], pa.int32()))
            one = [pa.array([_ALL]), pa.array([segment], pa.int64()), *(pa.array([x], pa.int64()) for x in (len(keys), int(own.sum()), 0, int(own.min())))]
            yield pa.RecordBatch.from_arrays([*one, lists(keys, every), lists(pa.array(np.zeros(len(keys), np.int64)), every), lists(pa.array(own.astype(np.int64)), every), lists(nothing, every)], names=_NAMES)


_NAMES = ["term", "segment", "n", "occurrences", "max_tf", "min_length", "keys", "tfs", "lengths", "positions"]


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([stem(t) for t in batch.column("term").to_pylist()], pa.string())], names=[*batch.schema.names, "stem"])


def posting_blocks(docs: DataFrame, key: str, *texts: str) -> DataFrame:
    """The blocks of the folded texts. Tokens are runs of letters and digits; each column's positions stand apart."""
    tokens = [F.regexp_extract_all(folded(F.coalesce(F.col(t).cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias(f"c{i}") for i, t in enumerate(texts)]
    rows = docs.select(F.col(key).alias("key"), *tokens)
    first, places = F.lit(0), []
    for i in range(len(texts)):
        size = F.size(f"c{i}")
        places.append(F.when(size > 0, F.sequence(first, first + size - 1)).otherwise(F.array().cast("array<int>")))
        first = first + size + _GAP
    rows = rows.select("key", F.concat(*(f"c{i}" for i in range(len(texts)))).alias("tokens"), F.concat(*places).cast("array<int>").alias("places")).filter(F.size("tokens") > 0)
    of = lambda t: T.ArrayType(t)
    types = [T.StringType(), *[T.LongType()] * 5, of(docs.schema[key].dataType), of(T.LongType()), of(T.LongType()), of(of(T.IntegerType()))]
    size = SEGMENT
    return rows.mapInArrow(lambda it: _blocks(it, size), T.StructType([T.StructField(n, t) for n, t in zip(_NAMES, types, strict=True)]))


def save_index(docs: DataFrame, folder: str, key: str, *texts: str) -> Index:
    # a number that is given stays: adaptive execution would make few large partitions, which the sort spills
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posting_blocks(docs, key, *texts).repartitionByRange(parts, "term", "segment").sortWithinPartitions("term", "segment").write.parquet(f"{folder}/blocks")
    stored = docs.sparkSession.read.parquet(f"{folder}/blocks")
    words = stored.filter(F.col("term") != _ALL).groupBy("term").agg(F.sum("n").alias("df"), F.sum("occurrences").alias("occurrences"))
    words = words.mapInArrow(_stems, "term string, df long, occurrences long, stem string")
    words.repartitionByRange("stem").sortWithinPartitions("stem").write.parquet(f"{folder}/words")
    return open_index(docs.sparkSession, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    blocks = spark.read.parquet(f"{folder}/blocks")
    n, total = blocks.filter(F.col("term") == _ALL).agg(F.sum("n"), F.sum("occurrences")).first()
    return Index(blocks, spark.read.parquet(f"{folder}/words"), n or 0, (total or 0) / max(n or 1, 1))


# --- queries


@dataclass
class Phrase:
    """Words at fixed distances: (slot, words after the first) for each."""

    words: list[tuple[int, int]]


@dataclass
class Query:
    """Alternatives of phrases that must, and phrases that must not, be there. slots: the terms that stand for each word."""

    alternatives: list[tuple[list[Phrase], list[Phrase]]] = field(default_factory=list)
    slots: list[list[str]] = field(default_factory=list)


def plain_query(text: str) -> Query:
    """All of the blank-separated parts, special characters aside; a part of several words is a phrase of them."""
    made: dict[str, int] = {}
    required = []
    for part in re.sub(r'["*():^]', " ", text or "").split():
        own = [(made.setdefault(w, len(made)), i) for i, w in enumerate(words_of(part))]
        if own and own not in [p.words for p in required]:
            required.append(Phrase(own))
    return Query([(required, [])] if required else [], [[w] for w in made])


def web_clauses(text: str) -> list[tuple[list[list[str]], list[list[str]]]]:
    """Alternatives (words of each phrase asked for, and excluded) of a web-style query: ``"a phrase"``, ``-without``, ``a or b``.
    Every text is a query: marks that mean nothing where they stand are left out."""
    out: list[tuple[list[list[str]], list[list[str]]]] = [([], [])]
    for sign, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text or ""):
        if not sign and bare.lower() == "or":
            out.append(([], []))
        elif words := words_of(quoted or bare):
            out[-1][bool(sign)].append(words)
    return [x for x in out if x[0] or x[1]]


def web_query(index: Index, text: str) -> Query:
    """The same over stems: a word stands for all terms of the index with its stem. Stop words ask for nothing, but keep their place in a phrase."""
    clauses = web_clauses(text)
    slots: dict[str, int] = {}

    def phrase(words: list[str]) -> list[tuple[int, int]]:
        at = [(i, w) for i, w in enumerate(words) if w not in STOP_WORDS]
        return [(slots.setdefault(stem(w), len(slots)), i - at[0][0]) for i, w in at]

    made = [tuple([Phrase(p) for p in map(phrase, side) if p] for side in clause) for clause in clauses]
    known: dict[str, list[str]] = {s: [] for s in slots}
    if slots:
        for r in index.words.filter(F.col("stem").isin(*slots)).select("stem", "term").collect():  # the forms of the query's words
            known[r["stem"]].append(r["term"])
    return Query([c for c in made if c[0] or c[1]], list(known.values()))


def _documents(index: Index, query: Query, segments: DataFrame | None) -> DataFrame:
    """(key, length, slots: for each slot the sorted positions) of the documents with any of the query's words; of all
    documents if an alternative only excludes."""
    slot = {t: i for i, terms in enumerate(query.slots) for t in terms}
    terms = [*slot, *([_ALL] if any(not required for required, _ in query.alternatives) else [])]
    blocks = index.blocks.filter(F.col("term").isin(*terms))
    if segments is not None:
        blocks = blocks.join(segments, "segment", "left_semi")
    number = F.coalesce(F.create_map(*(F.lit(x) for t, i in slot.items() for x in (t, i)))[F.col("term")], F.lit(-1)) if slot else F.lit(-1)
    rows = blocks.select(number.alias("slot"), F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("lengths").alias("length"), F.col("positions").alias("positions"))))
    held = rows.groupBy("key").agg(F.first("length").alias("length"), F.collect_list(F.struct("slot", "positions")).alias("held"))
    of = lambda i: F.array_sort(F.flatten(F.transform(F.filter("held", lambda h: h["slot"] == i), lambda h: h["positions"])))
    return held.select("key", "length", F.array(*(of(i) for i in range(len(query.slots)))).cast("array<array<int>>").alias("slots"))


def _starts(phrase: Phrase) -> Column:
    """The positions of the phrase's first word."""
    (first, _), *others = phrase.words
    return F.filter(F.col("slots")[first], lambda p: reduce(lambda a, b: a & b, (F.array_contains(F.col("slots")[s], p + at) for s, at in others), F.lit(True)))


def _holds(alternative: tuple[list[Phrase], list[Phrase]]) -> Column:
    required, excluded = alternative
    return reduce(lambda a, b: a & b, [*(F.size(_starts(p)) > 0 for p in required), *(F.size(_starts(p)) == 0 for p in excluded)], F.lit(True))


def matching(index: Index, query: Query, segments: DataFrame | None = None) -> DataFrame:
    """(key, length, slots) of the documents that an alternative of the query holds for; none for an empty query."""
    rows = _documents(index, query, segments)
    return rows.filter(reduce(lambda a, b: a | b, map(_holds, query.alternatives), F.lit(False)))


def _attributes(docs: DataFrame, key: str, entity: str | None, wanted: object, date: str | None) -> DataFrame | None:
    """(key, date) of the documents of the wanted entity."""
    if date is None and wanted is None:
        return None
    rows = docs if wanted is None else docs.filter(F.col(entity) == F.lit(wanted))
    return rows.select(F.col(key).alias("key"), (F.col(date) if date else F.lit(None)).alias("date"))


def _top(scored: DataFrame, attributes: DataFrame | None, limit: int | None) -> DataFrame:
    rows = scored if attributes is None else scored.join(attributes, "key")
    order = [F.col("score").desc(), *([F.col("date").desc_nulls_last()] if attributes is not None else []), F.col("key")]
    best = rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(limit)
    return best.withColumn("score", F.round("score", 6))


def _gain(tf: Column, length: Column, average: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def search_bm25(index: Index, text: str, limit: int, docs: DataFrame | None = None, key: str = "id", entity: str | None = None, wanted: object = None, date: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score), with ``docs`` also date: the documents with all parts of the query, best first, ties by the newest date and
    then by key. ``wanted`` keeps one entity's documents."""
    query = plain_query(text)
    attributes = None if docs is None else _attributes(docs, key, entity, wanted, date)
    if not query.alternatives:
        return _top(_documents(index, Query([([], [])]), None).limit(0).select("key", F.lit(0.0).alias("score")), attributes, limit)
    (phrases, _), *_ = query.alternatives
    df = {r["term"]: r["df"] for r in index.words.filter(F.col("term").isin(*(t for [t] in query.slots))).select("term", "df").collect()}
    held = [df.get(query.slots[p.words[0][0]][0], 0) if len(p.words) == 1 else None for p in phrases]
    if None in held:  # how many documents hold a phrase, only the positions tell
        counted = _documents(index, query, None).agg(*(F.count(F.when(F.size(_starts(p)) > 0, 1)).alias(f"n{i}") for i, p in enumerate(phrases))).first()
        held = [counted[i] if n is None else n for i, n in enumerate(held)]
    idf = [max(float(np.log((index.n_docs - n + 0.5) / (n + 0.5))), 1e-6) for n in held]
    score = F.round(sum((w * _gain(F.size(_starts(p)).cast("double"), F.col("length"), index.average, k1, b) for p, w in zip(phrases, idf, strict=True)), F.lit(0.0)), 12).alias("score")

    def scored(segments: DataFrame | None) -> DataFrame:
        return matching(index, query, segments).select("key", score)

    # the bound of a segment: each phrase as often as its rarest word's largest frequency there, in the shortest document
    bounds = index.blocks.filter(F.col("term").isin(*(t for [t] in query.slots))).groupBy("segment").agg(
        *(F.max(F.when(F.col("term") == t, F.col("max_tf"))).alias(f"t{i}") for i, [t] in enumerate(query.slots)), F.min("min_length").alias("length")
    )
    most = [F.least(*(F.col(f"t{s}") for s, _ in p.words)) if len(p.words) > 1 else F.col(f"t{p.words[0][0]}") for p in phrases]
    bound = sum((w * _gain(m.cast("double"), F.col("length"), index.average, k1, b) for m, w in zip(most, idf, strict=True)), F.lit(0.0))
    bounds = bounds.dropna().select("segment", bound.alias("bound"))
    best = bounds.orderBy(F.col("bound").desc(), "segment").limit(FIRST).collect()
    first = index.blocks.sparkSession.createDataFrame([(r["segment"],) for r in best], "segment long")
    # FIRST segments at most, and limit rows of them
    low = _top(scored(first), attributes, limit).select("score").collect()
    if len(best) < FIRST:
        return _top(scored(first), attributes, limit)
    beat = low[-1]["score"] if len(low) == limit else -1.0
    return _top(scored(bounds.filter(F.col("bound") >= beat - 1e-6).select("segment")), attributes, limit)


def search_web(index: Index, text: str, limit: int | None, docs: DataFrame | None = None, key: str = "id", entity: str | None = None, wanted: object = None, date: str | None = None) -> DataFrame:
    """(key, score), with ``docs`` also date, of the documents that a web-style query over stems matches, by cover density: each
    shortest stretch that holds all that an alternative asks for counts 0.1, divided by one more than its other words."""
    query = web_query(index, text)
    attributes = None if docs is None else _attributes(docs, key, entity, wanted, date)
    rows = matching(index, query)

    def density(required: list[Phrase]) -> Column:
        if not required:
            return F.lit(0.0)
        words = sum(len(p.words) for p in required)

        def places(i: int, phrase: Phrase) -> Column:
            return F.transform(_starts(phrase), lambda s: F.struct((s + phrase.words[-1][1]).alias("end"), s.alias("start"), F.lit(i).alias("part")))

        spans = F.array_sort(F.flatten(F.array(*(places(i, p) for i, p in enumerate(required)))))
        none = F.struct(F.array_repeat(F.lit(-1), len(required)).alias("last"), F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))

        def step(a: Column, s: Column) -> Column:
            last = F.transform(a["last"], lambda x, i: F.when(i == s["part"], s["start"]).otherwise(x))
            start = F.array_min(last)
            # an earlier stretch from the same start is shorter
            new = start > a["before"]
            gain = 0.1 / (1 + F.greatest(s["end"] - start + 1 - words, F.lit(0)))
            return F.struct(last.alias("last"), F.when(new, start).otherwise(a["before"]).alias("before"), F.when(new, a["sum"] + gain).otherwise(a["sum"]).alias("sum"))

        return F.aggregate(spans, none, step, lambda a: a["sum"])

    if not query.alternatives:
        return _top(rows.limit(0).select("key", F.lit(0.0).alias("score")), attributes, limit)
    each = [F.when(_holds(a), density(a[0])) for a in query.alternatives]
    return _top(rows.select("key", F.round(F.greatest(*each) if len(each) > 1 else each[0], 12).alias("score")), attributes, limit)


def count_matches(index: Index, query: Query, docs: DataFrame | None = None, key: str = "id", entity: str | None = None, wanted: object = None) -> DataFrame:
    """(n): the documents that match, without ranking them."""
    rows = matching(index, query).select("key")
    if wanted is not None:
        rows = rows.join(docs.filter(F.col(entity) == F.lit(wanted)).select(F.col(key).alias("key")), "key", "left_semi")
    return rows.agg(F.count("*").alias("n"))
