"""URL filter: a weighted vocabulary of URL terms, found by an Aho-Corasick automaton.

Each term has a weight. A URL is rejected if the weights of its distinct terms reach
``LIMIT``: a strict term does so by itself, soft terms when several distinct ones
occur. A hit counts only between boundaries: no ASCII letter or digit may touch it.
Host and path rules, where one fits, come before the vocabulary. The vocabulary is
a parameter, as a dictionary or, by ``vocabulary``, from a table of terms and weights.

Rows: a null url, or one without ``://``, has an empty host and path, fits no
rule, and is judged by its terms alone (null: allowed). The url is matched with
A-Z lower-cased and otherwise as it is. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The terms of the default vocabulary.
STRICT = ("bestiality", "camgirls", "escorts", "hentai", "hardcore", "milf", "nude", "nudes", "porn", "porno", "pornhub", "xxx")
SOFT = (
    "ads", "adserver", "adult", "babes", "banner", "bet", "bets", "betting", "bonus", "casino", "casinos", "clickbait", "dating", "erotic", "free", "gambling", "hot", "jackpot", "lingerie",
    "livecam", "lottery", "naked", "poker", "popup", "roulette", "sex", "sexy", "slots", "spin", "sportsbook", "teen", "torrent", "track", "tracker", "viagra", "warez", "webcam", "win", "winner",
)
#: Weights that reject a url together.
LIMIT = 2.0
VOCABULARY = {**dict.fromkeys(STRICT, 2.0), **dict.fromkeys(SOFT, 1.0)}
#: Terms of a vocabulary, at most: each task holds the automaton.
MAX_TERMS = 100_000

#: (host, path, verdict): for the host and its subdomains, where the path starts so.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_automata: dict = {}


def vocabulary(table: DataFrame) -> dict[str, float]:
    """Term -> weight of a table (term, weight). Null and empty terms, and weights that are not positive, count for
    nothing; of a repeated term the largest weight counts. Terms are matched with A-Z lower-cased."""
    low = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("term")
    known = table.filter("term <> '' and weight > 0").groupBy(low).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    rows = known.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"over {MAX_TERMS} terms")
    return {r["term"]: r["weight"] for r in rows}


def _automaton(terms: tuple[str, ...]):
    if terms not in _automata:
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in terms:
            found.add_word(term, term)
        found.make_automaton()
        _automata.clear()
        _automata[terms] = found
    return _automata[terms]


def _count(batches: Iterator[pa.RecordBatch], terms: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Adds the distinct terms of each url, in order."""
    find = _automaton(terms) if terms else None
    edge = lambda c: not ("a" <= c <= "z" or "0" <= c <= "9")
    for batch in batches:
        found = []
        for url in batch.column("url_lower").to_pylist():
            seen = set()
            for end, term in find.iter(url) if find and url else ():
                start = end - len(term) + 1
                if (start == 0 or edge(url[start - 1])) and (end + 1 == len(url) or edge(url[end + 1])):
                    seen.add(term)
            found.append(sorted(seen))
        keep = [c for c in batch.schema.names if c != "url_lower"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.string()))], names=[*keep, "terms"])


def split_url(url: str = "url") -> tuple:
    """Columns (host, path): the host is what follows the first ``://`` up to ``/ ? #``, the path what follows that up to ``? #``."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def judge(pages: DataFrame, rules: tuple = RULES, terms: dict[str, float] | None = None, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, the distinct strict and soft terms found, and their weight.

    An empty table gives an empty result; columns beyond page_id and url are ignored, whatever their names.
    """
    terms = VOCABULARY if terms is None else terms
    host, path = split_url()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), F.translate("url", upper, lower).alias("url_lower"))
    names = tuple(sorted(terms))
    found = urls.mapInArrow(lambda it: _count(it, names), "page_id long, host string, path string, terms array<string>")
    # a map with an entry for each term of the bounded vocabulary
    weights = F.map_from_arrays(F.lit(list(names)), F.lit([float(terms[n]) for n in names])) if names else F.lit(None).cast("map<string,double>")
    weigh = lambda t: weights[t]
    found = found.withColumn("weight", F.aggregate("terms", F.lit(0.0), lambda s, t: s + weigh(t)))
    strict, soft = F.filter("terms", lambda t: weigh(t) >= limit), F.filter("terms", lambda t: weigh(t) < limit)
    found = found.select("page_id", "host", "path", strict.alias("strict_terms"), soft.alias("soft_terms"), "weight")
    rule = F.lit(None).cast("string")
    verdict = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    # the longest rule is asked first, so it stands outermost
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "strict_terms", "soft_terms", "weight")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.size("strict_terms").cast("long").alias("n_strict"), F.size("soft_terms").cast("long").alias("n_soft"))


def _oracle() -> str:
    hits = lambda terms: " + ".join(f"cast(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as bigint)" for t in terms)
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with parts as (
  select page_id, translate(url, '{upper}', '{lower}') as u,
         case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, coalesce(u, '') as u, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{upper}', '{lower}') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from parts),
hits as (select *, {hits(STRICT)} as n_strict, {hits(SOFT)} as n_soft from split)
select page_id, host, path,
  case {" ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in rules)} end as rule,
  case {" ".join(f"when {fits(h, p)} then '{says}'" for h, p, says in rules)}
       when 2 * n_strict + n_soft >= {LIMIT} then 'block' else 'allow' end as verdict,
  n_strict, n_soft
from hits"""


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE = {"op7_url_filter": _oracle()}
