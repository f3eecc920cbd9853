"""Fill-in-the-middle transformation of texts, as a pyarrow.compute pipeline.

A text is cut into units, each a word with the blanks before it, or the blanks at the
end. Two draws from the document's id cut the units into prefix, middle and suffix. A
batch goes through Arrow's kernels as a whole: the units of all texts are one flat array
with the index of each unit's text; a unit's ordinal in its text gives its role; each
role's units are filtered, made into a list for each text again and joined to a piece.

Forms: ``plain`` leaves the text as it is; ``psm`` is prefix, suffix, middle and ``spm``
suffix, prefix, middle, each piece after its sentinel. A sentinel cannot arise where
pieces meet, as none overlaps itself or another, so ``restored`` gives back the exact text.

Rows: a null text is an empty one; empty texts, and texts that hold a sentinel, are
plain. A null doc_id draws like an empty id. Rows that share a doc_id are each
transformed. Very long texts are worked on as a whole, a slice of a batch for themselves.
An empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed, and of these the ones in suffix-prefix-middle order.
RATE, SPM_RATE, SEED = 50, 80, 42
#: A byte that UTF-8 never has.
_CUT = b"\xff"
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _modulo(x: pa.Array, n: pa.Array | int) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, n), n))


def _pieces(flat: pa.Array, parents: pa.Array, wanted: pa.Array, rows: int) -> pa.Array:
    """The wanted units of each text, joined."""
    own = pc.filter(parents, wanted)
    counted = pc.value_counts(own)
    sizes = pc.fill_null(pc.take(counted.field("counts"), pc.index_in(pa.array(np.arange(rows)), counted.field("values"))), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)])
    lists = pa.LargeListArray.from_arrays(offsets, pc.filter(flat, wanted))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


def _transform(part: pa.RecordBatch, rate: int, spm_rate: int) -> pa.RecordBatch:
    text = pc.fill_null(part.column("text").cast(pa.large_string()), "")
    rows, raw = part.num_rows, text.cast(pa.large_binary())
    # every unit ends in a cut, so that a split gives the units and one empty rest
    lists = pc.split_pattern(pc.replace_substring_regex(raw, pattern=f"({UNIT})", replacement=b"\\1" + _CUT), _CUT)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    sizes = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
    n1 = pc.add(sizes, 1)
    starts = pc.subtract(pc.cumulative_sum(n1), n1)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parents))
    cuts = [_modulo(part.column(h), n1) for h in ("h1", "h2")]
    a, b = (pc.take(f(*cuts), parents) for f in (pc.min_element_wise, pc.max_element_wise))
    before, until = pc.less(ordinal, a), pc.less(ordinal, b)
    prefix, middle, suffix = (_pieces(flat, parents, wanted, rows) for wanted in (before, pc.and_not(until, before), pc.invert(until)))

    marked = [pc.match_substring(text, s) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = pc.or_(pc.or_(pc.or_(*marked[:2]), marked[2]), pc.or_(pc.equal(sizes, 0), pc.greater_equal(_modulo(part.column("h3"), 100), rate)))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(_modulo(part.column("h4"), 100), spm_rate), "spm", "psm"))
    sentinels = [pa.scalar(s.encode(), pa.large_binary()) for s in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = (pc.binary_join_element_wise(x, y, pa.scalar(b"", pa.large_binary())) for x, y in zip(sentinels, (prefix, suffix, middle), strict=True))
    joined = (pc.binary_join_element_wise(*x, pa.scalar(b"", pa.large_binary())) for x in ((p, s, m), (s, p, m)))
    psm, spm = (x.cast(pa.large_string()) for x in joined)
    output = pc.if_else(plain, text, pc.if_else(pc.equal(form, "spm"), spm, psm))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64())) for x in (prefix, middle)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, form, *chars, output.cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output of this form was made of."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.instr(text, mark) + len(mark), F.length(text))

    def until(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    last = after(out, MIDDLE)
    psm = F.concat(until(after(out, PREFIX), SUFFIX), last, until(after(out, SUFFIX), MIDDLE))
    spm = F.concat(until(after(out, PREFIX), MIDDLE), last, until(after(out, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output, for each row. ``rate`` percent of
    the texts are transformed, ``spm_rate`` percent of these with the suffix first; both by the id and the seed alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *draws)
    return rows.mapInArrow(lambda it: _batches(it, rate, spm_rate), _OUT)


def _batches(batches: Iterator[pa.RecordBatch], rate: int, spm_rate: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in ta.slices(whole):
            yield _transform(part, rate, spm_rate)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLE = {
    "op13_fill_in_middle": rf"""
with drawn as (
  select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as digest,
         regexp_extract_all(coalesce(text, ''), '{UNIT}') as units from documents),
cut as (
  select *, len(units) as n, cast('0x' || digest[1:8] as bigint) % (len(units) + 1) as x, cast('0x' || digest[9:16] as bigint) % (len(units) + 1) as y,
         case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or cast('0x' || digest[17:24] as bigint) % 100 >= {RATE} then 'plain'
              when cast('0x' || digest[25:32] as bigint) % 100 < {SPM_RATE} then 'spm' else 'psm' end as form from drawn),
pieces as (
  select *, array_to_string(units[1:least(x, y)], '') as prefix, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') as middle, array_to_string(units[greatest(x, y) + 1:], '') as suffix from cut)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end) as output_sha256, sha256(text) as restored_sha256
from pieces"""
}
