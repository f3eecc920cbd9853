"""Best-fit packing of tokenised documents into fixed-length sequences, by minimum bin slack.

A document's tokens are cut into pieces of ``capacity`` (the first may be
shorter). What packing needs to know of the pieces is how many there are of
each length: at most ``capacity`` counts, whatever the size of the corpus, so
these counts are what the driver gets. For each bin, subset-sum dynamic
programming over bitsets finds the fullest feasible combination of available
lengths around the longest piece left; the combination is removed as often as
the counts allow. That makes at most capacity * ln(capacity) combinations.

Pieces then find their place without being gathered: a piece's rank among those
of its length is its rank within a small cell of rows plus the counts of the
cells before, and the rank alone decides sequence and offset.

Rows: null text is empty and still yields the end token; rows that share a
doc_id are packed as separate documents; an empty table gives an empty result.

The registered query takes ids as the tokenizer's file gives them by default: the
content of an added token, such as ``<|endoftext|>``, is that token wherever it
stands in a text. Without ``added`` it is plain text, as under the tokenizer's
``encode_special_tokens``.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta
from corpusloom.llm.shared import ensure_checkpoint_dir

CAPACITY = 2048
END_ID = 0
#: Distinct words a task remembers the ids of.
CACHE_WORDS = 100_000
#: Bytes of text whose distinct words are encoded together, and how many words at a time.
SLICE = 1 << 22
TOGETHER = 1 << 15
_SPACE_RUN = re.compile(r"\s ")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def added_tokens(path: str | None = None) -> dict[str, int]:
    """Content -> id of a tokenizer file's added tokens; None takes the installed byte-level BPE with 50k entries."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match their exact content are known")
    return {t["content"]: t["id"] for t in added}


class _WordIds(dict):
    """The packed token ids of a blank-led word, remembered up to a limit."""

    def __init__(self, ranks_path: str | None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids

    def whole(self, text: str, added: dict[str, int]) -> bytes:
        """Ids of a whole text. Added tokens cut it into parts that are encoded by themselves."""
        if not any(t in text for t in added):
            return self.text(text)
        parts = re.split(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})", text)
        return b"".join(np.array([added[p]], "<u4").tobytes() if i % 2 else self.text(p) for i, p in enumerate(parts))

    def text(self, text: str) -> bytes:
        """Ids of a text without added tokens. A token never spans the gap between a non-blank and a blank, so
        words are encoded by themselves, unless blanks stand in runs that end in a space."""
        if _SPACE_RUN.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        return (self[head] if head else b"") + b"".join(map(self.__getitem__, map(" ".__add__, rest)))


    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first of each word, how many) of blank-led words, encoded as one text: its tokens end where words end, unless
        a word ends in a blank. Words that do are encoded by themselves."""
        odd = [k for k, w in enumerate(words) if w[-1].isspace()]
        order = np.r_[np.delete(np.arange(len(words)), odd), np.array(odd, np.int64)]
        parts, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(words) - len(odd), TOGETHER):
            own = [words[k] for k in order[at : min(at + TOGETHER, len(words) - len(odd))]]
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in own])
            parts.append(np.array(self.encode("".join(own)), "<u4"))
            stops = np.cumsum(self.sizes[parts[-1]])
            last = np.searchsorted(stops, ends)
            if not np.array_equal(stops[last], ends):
                raise ValueError("a token spans two words")
            counts.append(np.diff(last, prepend=-1))
        parts += [np.frombuffer(self[words[k]], "<u4") for k in odd]
        counts.append(np.array([len(x) for x in parts[len(parts) - len(odd) :]], np.int64))
        first, n = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        n[order] = in_order = np.concatenate(counts)
        first[order] = np.cumsum(in_order) - in_order
        return np.concatenate(parts), first, n

    def texts(self, column: pa.Array, added: dict[str, int]) -> list[bytes]:
        """Ids of whole texts, as ``whole`` gives them; each distinct word is encoded once."""
        values = [v or "" for v in column.to_pylist()]
        plain = [i for i, v in enumerate(values) if v and not _SPACE_RUN.search(v) and not any(t in v for t in added)]
        out = [b""] * len(values)
        for i in set(range(len(values))).difference(plain):
            out[i] = self.whole(values[i], added)
        lists = pc.split_pattern(column.take(pa.array(plain, pa.int64())), " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        heads = lists.values.take(pa.array(first[:-1])).to_pylist()
        kept = np.ones(len(lists.values), bool)
        kept[first[:-1]] = False  # a text's first word has no blank before it
        words = lists.values.filter(pa.array(kept)).dictionary_encode()
        code = words.indices.to_numpy()
        ids, start, count = self.joined([" " + w for w in words.dictionary.to_pylist()])
        n = count[code]
        ends = np.cumsum(n)
        tokens = ids[np.arange(n.sum()) + np.repeat(start[code] - (ends - n), n)]
        cuts = np.r_[0, ends][first - np.arange(len(first))]
        for k, i in enumerate(plain):
            out[i] = (self[heads[k]] if heads[k] else b"") + tokens[cuts[k] : cuts[k + 1]].tobytes()
        return out


_encoders: dict[str | None, _WordIds] = {}


def _tokenise(batches: Iterator[pa.RecordBatch], capacity: int, ranks_path: str | None, with_ids: bool, added: dict[str, int]) -> Iterator[pa.RecordBatch]:
    if ranks_path not in _encoders:
        _encoders[ranks_path] = _WordIds(ranks_path)
    words, end = _encoders[ranks_path], np.array([END_ID], "<u4").tobytes()
    for part in (part for batch in batches for part in ta.slices(batch, limit=SLICE)):
        rows: list[tuple] = []
        for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.texts(part.column("text"), added), strict=True):
            ids += end
            n = len(ids) // 4
            first = (n - 1) % capacity + 1
            for piece, start in enumerate([0, *range(first, n, capacity)]):
                own = ids[4 * start : 4 * (start + (capacity if piece else first))]
                rows.append((doc_id, piece, start, len(own) // 4, zlib.crc32(own), own if with_ids else None))
        if rows:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


def tokenise(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the packed 32-bit ids of every piece.

    ``ranks_path`` is the vocabulary as ranks; None takes the installed byte-level BPE with 50k entries.
    ``added`` are the tokens (content -> id) that are found inside texts; None finds none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _tokenise(it, capacity, ranks_path, with_ids, added or {}), _PIECES)


def fullest(room: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """The combination of available lengths with the largest sum that fits the room; longer lengths first.

    ``lengths`` is in descending order. Bit s of a reach is set if some combination sums to s.
    """
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, step = min(counts[length], room // length), 1
        while left > 0:
            step = min(step, left)
            steps.append((length, step, reach))
            reach |= (reach << length * step) & mask
            left -= step
            step *= 2
            if reach >> room:
                break
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, step, before in reversed(steps):
        if not before >> total & 1:
            total -= length * step
            chosen[length] = chosen.get(length, 0) + step
    return chosen


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, how often) until every piece is placed."""
    counts = {k: n for k, n in counts.items() if n}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        combo = fullest(capacity - top, counts, lengths)
        counts[top] += 1
        combo[top] = combo.get(top, 0) + 1
        times = min(counts[k] // c for k, c in combo.items())
        for k, c in combo.items():
            counts[k] -= c * times
        out.append((combo, times))
        lengths = [k for k in lengths if counts[k]]
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each length: first rank of each share, and its (copies per sequence, first sequence, first offset)."""
    used: dict[int, int] = {}
    table: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    sequence = 0
    for combo, times in patterns:
        offset = 0
        for length, copies in sorted(combo.items(), reverse=True):
            starts, shares = table.setdefault(length, ([], []))
            starts.append(used.get(length, 0))
            shares.append((copies, sequence, offset))
            used[length] = starts[-1] + copies * times
            offset += length * copies
        sequence += times
    return table


def _place(batches: Iterator[pa.RecordBatch], table: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sequences, offsets = [], []
        for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
            starts, shares = table[length]
            i = bisect_right(starts, rank) - 1
            copies, sequence, offset = shares[i]
            nth, copy = divmod(rank - starts[i], copies)
            sequences.append(sequence + nth)
            offsets.append(offset + copy * length)
        keep = [c for c in batch.schema.names if c != "rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*keep, "sequence_id", "offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    cells = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row number is fixed by the checkpoint, so a rerun task ranks its rows as before
    pieces = tokenise(docs, capacity, ranks_path, with_ids, added).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int"))
    by_cell = pieces.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = by_cell.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "cell", F.coalesce("before", F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_cell.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = _places(minimum_slack(counts, capacity))
    rank = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row")) - 1
    ranked = pieces.withColumn("rank", rank).join(before, ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long, {'ids binary, ' * with_ids}sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(lambda it: _place(it, table), schema)


def op3_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), added=added_tokens())


QUERIES = {"op3_bin_packing": op3_bin_packing}
ORACLE: dict[str, str] = {}
