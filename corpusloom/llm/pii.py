"""Personal data: fixed patterns, and spans that bootstrapped contexts add. DataFrame functions only.

The base finds e-mail addresses, IP addresses, card and phone numbers by their
form. Those found are *seeds*, and so are long lower-case hexadecimal numbers,
for a fifth kind, ``secret``. The words left of a seed, the word on each side of
it, and the word before it with the marks between (``token = "``) are its
lexical patterns; tokens with digits and runs of digit groups that no base span
touches are candidates, and share patterns with seeds. On the graph of patterns
and instances two scores feed each other for a few rounds: a pattern's score for
a kind is the mean score of the instances it occurs with, and a candidate's
score is the noisy-or of its patterns'. Candidates that a confident pattern
proposes, and whose form fits the kind, become spans of that kind; a hexadecimal
seed becomes one where a confident pattern holds it, and nowhere else.

Offsets come from running sums, and contexts from chunks of the text, so a text
with n matches costs about n log n, however long it is.

Rows: null text is empty. Offsets are code points, the end exclusive. Rows that
share a doc_id but not a text are kept apart; equal rows get equal results. An
empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import ensure_checkpoint_dir, fresh

#: Java patterns. Guards and possessive loops keep them linear; they match what the plain forms match.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind.
_NEEDS = {"email": "@", "ip": "[0-9][.]", "card": "[0-9]", "phone": "[+][0-9]", "token": "[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_VALID = {
    "email": "true",
    "ip": rf"get(m, i) rlike '^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$'",
    "card": """length(translate(get(m, i), ' -', '')) between 12 and 19 and aggregate(
        transform(split(reverse(translate(get(m, i), ' -', '')), ''), (d, j) -> if(j % 2 = 0, int(d), if(int(d) > 4, 2 * int(d) - 9, 2 * int(d)))), 0, (s, d) -> s + d) % 10 = 0""",
    "phone": "length(translate(get(m, i), '+ ().-', '')) between 9 and 15",
}
#: Runs of digit groups, and words with a digit.
CANDIDATE = (
    r"(?<![A-Za-z0-9@._+:/-])(?:[A-Za-z@._+:/-]++(?=[0-9])|(?=[0-9(]))"
    r"(?:\(?[0-9]++(?:[ .()-]{1,2}+[0-9]++)*+(?![A-Za-z0-9@_])|[0-9](?:[A-Za-z0-9@._+:/-]*[A-Za-z0-9])?)"
)
#: What a candidate must look like to be of a kind.
_FITS = {
    "email": "value like '%@%'",
    "ip": "value rlike '^[0-9a-fA-F]+([.:]+[0-9a-fA-F]+){3,}$'",
    "card": "value rlike '^[0-9][0-9 .:/-]*$' and length(regexp_replace(value, '[^0-9]', '')) between 12 and 19",
    "phone": "value rlike '^[+(0-9][0-9 ().:/-]*$' and length(regexp_replace(value, '[^0-9]', '')) between 7 and 15",
    "secret": "length(value) >= 16 and value rlike '[0-9]' and value rlike '[A-Za-z]' and value not like '%@%'",
}
#: Candidates of this form are seeds of the kind: long lower-case hexadecimal numbers.
_SECRET = "value rlike '^[0-9a-f]{32,}$' and value rlike '[a-f]'"
#: All kinds, in the order of their spans; the last is found by its contexts alone.
ALL_KINDS = (*KINDS, "secret")
#: Seeds that a pattern needs, the score it needs, and the rounds of scoring.
MIN_SEEDS = 3
CONFIDENT = 0.8
ROUNDS = 3
#: Characters on each side of an instance that its patterns are read from.
CONTEXT = 48
#: Texts are cut into chunks of so many characters, so that a span deep inside is reached without a scan from the start.
_CHUNK = 512
_SALTS = 16
_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _running(values: str, first: str, op: str) -> str:
    """SQL of an array's running ``op`` (of a and b), by doubling steps: n log n, where one fold a place would be n * n."""
    return f"""aggregate(filter(sequence(0, 30), k -> shiftleft(1L, k) < size({values})), {values},
        (s, k) -> zip_with(s, concat(array_repeat({first}, shiftleft(1, k)), slice(s, 1, size(s) - shiftleft(1, k))), (a, b) -> {op}))"""


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, so that the value is worked out once and not at each use inside a loop."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _cut(start: str, end: str, chunks: str = "chunks") -> str:
    """SQL of the characters from ``start`` up to ``end`` of the text in ``chunks``."""
    return f"substring(array_join(slice({chunks}, int({start} div {_CHUNK}) + 1, int(greatest({end} - 1, 0) div {_CHUNK} - {start} div {_CHUNK}) + 1), ''), int({start} % {_CHUNK}) + 1, int(greatest({end} - {start}, 0)))"


def _chunks() -> Column:
    return F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _found(name: str, pattern: str, needs: str) -> list[Column]:
    """The matches, and the text between them: the empty list and the whole text where a needed character is missing."""
    has = F.col("text").rlike(needs)
    matches = F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.when(has, F.split("text", pattern, -1)).otherwise(F.array("text"))
    return [matches.alias(f"m_{name}"), between.alias(f"p_{name}")]


def _placed(name: str, valid: str, kind: str, rank: int) -> Column:
    """The valid matches with their offsets: a match ends after all text and all matches up to it."""
    m, p = f"m_{name}", f"p_{name}"
    numbers = f"filter(sequence(0, greatest(size({m}) - 1, 0)), i -> i < size({m}))"
    sizes = f"transform({numbers}, i -> bigint(length(get({p}, i)) + length(get({m}, i))))"
    spans = f"""transform(filter({numbers}, i -> {valid.replace("(m,", f"({m},")}),
        i -> named_struct('start', get(e, i) - length(get({m}, i)), 'rank', {rank}, 'kind', '{kind}', 'end', get(e, i), 'value', get({m}, i)))"""
    return F.expr(_let("e", _running(sizes, "0L", "a + b"), spans)).alias(f"s_{name}")


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), base spans in order, and the candidates' and seeds' contexts; no text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    searches = [(k, p, _NEEDS[k]) for k, p in KINDS.items()] + [("token", CANDIDATE, _NEEDS["token"])]
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("key"), *(c for s in searches for c in _found(*s)))
    placed = [_placed(k, _VALID[k], k, i) for i, k in enumerate(KINDS)] + [_placed("token", "length(get(m, i)) >= 6", "token", 9)]
    rows = rows.select("doc_id", "key", "text", *placed)
    rows = rows.select("doc_id", "key", "text", F.array_sort(F.concat(*(f"s_{k}" for k in KINDS))).alias("base"), F.col("s_token").alias("tokens"))
    # a token is free if no base span that starts before it reaches into it, and none starts inside it
    rows = rows.select("*", F.expr("if(size(tokens) = 0, base, array_sort(concat(base, tokens)))").alias("all"))
    reach = _running("transform(all, s -> if(s.rank < 9, s.end, 0L))", "0L", "greatest(a, b)")
    ahead = _running("reverse(transform(all, s -> if(s.rank < 9, s.start, 9223372036854775807L)))", "9223372036854775807L", "least(a, b)")
    free = "filter(all, (s, i) -> s.rank < 9 or (get(b.reach, i) <= s.start and get(b.ahead, i) >= s.end))"
    seen = F.expr(f"if(size(tokens) = 0, base, {_let('b', f'struct({reach} as reach, reverse({ahead}) as ahead)', free)})")
    rows = rows.select("doc_id", "key", "text", "base", seen.alias("seen"))
    rows = rows.select("doc_id", "key", "base", "seen", F.when(F.size("seen") > 0, _chunks()).alias("chunks"))
    context = f"""transform(seen, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'value', s.value,
        'left', lower({_cut(f"greatest(s.start - {CONTEXT}, 0L)", "s.start")}), 'right', lower({_cut("s.end", f"(s.end + {CONTEXT})")})))"""
    return rows.select("doc_id", "key", F.expr("transform(base, s -> struct(s.start, s.rank, s.kind, s.end))").alias("base"), F.expr(context).alias("seen"))


def _occurrences(scan: DataFrame) -> DataFrame:
    """One row per occurrence and lexical pattern: the two words before it, the words on both sides, and the
    word before it with the marks between them (``token = "``), if there is more than blanks between them."""
    one = scan.select("doc_id", "key", F.inline("seen")).withColumn("kind", F.expr(f"if(kind = 'token' and {_SECRET}, 'secret', kind)"))
    word = r"[\p{L}]+[^\s]*"
    one = one.select(
        "doc_id", "key", "start", "end", "kind", "value",
        F.regexp_extract("left", rf"(?:^|\s)({word}\s+[^\s]+)\s*$", 1).alias("two"),
        F.regexp_extract("left", rf"(?:^|\s)({word})\s*[^\s]?\s*$", 1).alias("before"),
        F.regexp_extract("right", rf"^[^\s]?\s*({word})", 1).alias("after"),
        F.regexp_extract("left", r"([\p{L}]+[^\p{L}\p{N}]{0,8})$", 1).alias("cue"),
    )
    patterns = F.array(
        F.when(F.col("two") != "", F.concat(F.lit("two: "), "two")),
        F.when((F.col("before") != "") & (F.col("after") != ""), F.concat(F.lit("sides: "), "before", F.lit(" | "), "after")),
        F.when(F.col("cue").rlike(r"[^\p{L}\s]"), F.concat(F.lit("cue: "), "cue")),
    )
    return one.select("doc_id", "key", "start", "end", "kind", "value", F.explode(F.array_compact(patterns)).alias("pattern"))


def _spread(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Inner join with the rows of a frequent key dealt by a hash of ``by``: the smaller right side is there once for each share."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(_SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def _discovered(occurrences: DataFrame, min_seeds: int, confident: float, rounds: int) -> DataFrame:
    """(doc_id, key, start, end, kind) of the candidates that confident patterns propose, and of the secrets that they hold."""
    if rounds < 1:
        return occurrences.select("doc_id", "key", "start", "end", "kind").limit(0)
    edges = occurrences.groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    total = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = edges.filter("kind != 'token'").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= min_seeds)
    known = seeds.join(total, "pattern").checkpoint()
    fits = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(kind)) for kind, rule in _FITS.items())))
    open_edges = edges.filter("kind = 'token'").select("pattern", "value", F.explode(fits).alias("kind"))
    graph = _spread(open_edges, known, ["pattern", "kind"], ["value"]).withColumn("score", F.lit(0.0)).checkpoint()
    for _ in range(rounds):
        pattern = graph.groupBy("pattern", "kind").agg(F.least(F.round((F.max("seeds") + F.sum("score")) / F.max("total"), 9), F.lit(1.0)).alias("p"))
        linked = _spread(graph.drop("p", "score"), pattern, ["pattern", "kind"], ["value"])
        value = linked.groupBy("value", "kind").agg(F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-12))))), 9).alias("score"))
        graph = linked.join(value, ["value", "kind"]).checkpoint()
    accepted = graph.filter((F.col("p") >= confident) & (F.col("score") >= confident)).groupBy("pattern", "value").agg(F.max_by("kind", F.struct("score", "kind")).alias("found"))
    hits = _spread(occurrences.filter("kind = 'token'"), accepted, ["pattern", "value"], ["doc_id", "start"])
    # a seed that is no base span counts where a confident pattern of its kind holds it
    sure = known.filter("kind = 'secret'").join(graph.groupBy("pattern", "kind").agg(F.max("p").alias("p")), ["pattern", "kind"], "left")
    sure = sure.filter(F.coalesce("p", F.col("seeds") / F.col("total")) >= confident).select("pattern", F.col("kind").alias("found"))
    held = _spread(occurrences.filter("kind = 'secret'"), sure, ["pattern"], ["doc_id", "start", "value"])
    both = hits.select("doc_id", "key", "start", "end", "found").unionByName(held.select("doc_id", "key", "start", "end", "found"))
    return both.groupBy("doc_id", "key", "start", "end").agg(F.min("found").alias("kind"))


def find_pii(docs: DataFrame, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, key (xxhash64 of the text), base and spans, arrays of (start, rank, kind, end) in order."""
    ensure_checkpoint_dir(docs.sparkSession)
    scan = _scan(docs).checkpoint()
    found = _discovered(_occurrences(scan), min_seeds, confident, rounds)
    rank = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")).cast("int") - 1
    added = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end")).alias("added"))
    base = scan.select("doc_id", "key", "base").alias("b")
    joined = base.join(added.alias("a"), F.col("b.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("b.key") == F.col("a.key")), "left")
    return joined.select("b.doc_id", "b.key", "b.base", F.array_sort(F.concat(F.col("base").cast(_SPANS), F.coalesce(F.col("added").cast(_SPANS), F.array().cast(_SPANS)))).alias("spans"))


def _written(name: str) -> Column:
    return F.expr(f"array_join(transform({name}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def masked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the found spans of each text replaced by their kind in angle brackets. Overlapping spans are one."""
    doc, key, cut, chunks = fresh(docs.columns, "doc", "hash", "cut", "chunks")
    spans = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias(doc), F.col("key").alias(key), "spans").dropDuplicates([doc, key])
    starts = "filter(sequence(0, size(spans) - 1), i -> i = 0 or get(spans, i).start >= get(r, i - 1))"
    islands = """transform(f, (i, n) -> named_struct('start', get(spans, i).start, 'kind', get(spans, i).kind,
        'end', get(r, coalesce(get(f, n + 1), size(spans)) - 1)))"""
    islands = _let("r", _running("transform(spans, s -> s.end)", "0L", "greatest(a, b)"), _let("f", starts, islands))
    spans = spans.select(doc, key, F.expr(islands).alias(cut))
    rows = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(spans[doc]) & (F.xxhash64(docs["text"].cast("string")) == spans[key]), "left")
    rows = rows.withColumn(chunks, F.when(F.col(cut).isNotNull(), F.regexp_extract_all(docs["text"], F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))))
    text = F.expr(f"""concat(
        array_join(transform({cut}, (s, i) -> concat({_cut(f"if(i = 0, 0L, get({cut}, i - 1).end)", "s.start", chunks)}, '<', upper(s.kind), '>')), ''),
        {_cut(f"element_at({cut}, -1).end", f"bigint(greatest(size({chunks}), 1)) * " + str(_CHUNK), chunks)})""")
    masked_text = F.when(F.col(cut).isNull(), docs["text"]).otherwise(text)
    return rows.select(*(masked_text.alias(c) if c == "text" else docs[c] for c in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    n_added = (F.size("spans") - F.size("base")).cast("bigint").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"), n_added)


QUERIES = {"op10_pii": op10_pii}
ORACLE: dict[str, str] = {}
