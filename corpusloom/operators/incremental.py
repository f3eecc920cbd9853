"""Incremental operators: upserts, gates, ledgers, snapshots, tombstones. State comes in and goes out as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import latest_per_group


def new_since(rows: DataFrame, at: str, mark: Column | None, now: Column, fallback_hours: int = 24) -> DataFrame:
    """Rows after the mark (strictly) and before now; without a mark, of the last hours."""
    start = mark if mark is not None else now - F.expr(f"interval {fallback_hours} hours")
    return rows.filter((F.col(at) > start) & (F.col(at) < now))


def batch_triggers(batch: DataFrame, title: str, keywords: Sequence[str], volume: int, history: DataFrame | None = None, entity: str = "entity_id", at: str = "ts", now: Column | None = None, days: int = 30) -> DataFrame:
    """One row: size, whether it is over the volume, the first row that names a keyword (literally, whatever the case), and
    how many entities reappear: whose newest row of ``history`` before the whole batch is over so many days before
    ``now``. Entities without such a row are new and do not count."""
    low, hit = F.lower(title), F.lit(False)
    for k in keywords:
        hit = hit | F.coalesce(low.contains(k.lower()), F.lit(False))
    facts = batch.agg(F.count("*").alias("n"), (F.count("*") > volume).alias("high_volume"), F.min(F.when(hit, F.col("id"))).alias("first_hit"))
    if history is None:
        return facts.withColumn("n_reappear", F.lit(0).cast("bigint"))
    began = batch.agg(F.min(at).alias("_began"))  # one row
    prior = history.select(entity, at).join(batch.select(entity).distinct(), entity, "left_semi").crossJoin(F.broadcast(began)).filter(F.col(at) < F.col("_began"))
    last = prior.groupBy(entity).agg(F.max(at).alias("_last"))
    late = last.filter(F.col("_last") < (now if now is not None else F.current_timestamp()) - F.expr(f"interval {days} days"))
    return facts.crossJoin(late.agg(F.count("*").alias("n_reappear")))


def trigger_reasons(batch: DataFrame, title: str, keywords: Sequence[str], volume: int, last_seen: DataFrame, entity: str = "entity_id", at: str = "ts", days: int = 30, order: Sequence[Column] = ()) -> DataFrame:
    """(reason): ``volume:n`` for a batch of more rows than allowed, ``keyword:k`` for the first row in order that names a keyword
    (literally, whatever the case; the first such keyword), and ``reappear:e`` for each entity whose row in ``last_seen``
    (entity, at) is before the whole batch and over so many days before its newest row. No row for an empty batch."""
    low = F.lower(title)
    named = F.coalesce(*(F.when(low.contains(k.lower()), F.lit(k.lower())) for k in keywords)) if keywords else F.lit(None).cast("string")
    facts = batch.agg(F.count("*").alias("n"), F.min(at).alias("began"), F.max(at).alias("ended"))
    loud = facts.filter(F.col("n") > volume).select(F.concat(F.lit("volume:"), "n").alias("reason"))
    hit = batch.withColumn("_k", named).filter("_k is not null").orderBy(*(order or [F.col(entity), F.col(at).desc()])).limit(1).select(F.concat(F.lit("keyword:"), "_k").alias("reason"))
    seen = last_seen.select(entity, F.col(at).alias("_last")).join(batch.select(entity).distinct(), entity).crossJoin(F.broadcast(facts))  # facts: one row
    late = seen.filter((F.col("_last") < F.col("began")) & (F.col("_last") < F.col("ended") - F.expr(f"interval {days} days")))
    return loud.unionByName(hit).unionByName(late.select(F.concat(F.lit("reappear:"), F.col(entity).cast("string")).alias("reason")))


def digest_rows(batch: DataFrame, key: str, line: Column, order: Sequence[str], quiet: str = "No new documents.") -> DataFrame:
    """One text per entity with a line for each document; one row with a null key that says so for an empty batch."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    rows = batch.groupBy(key).agg(F.count("*").alias("n"), lines.alias("body"))
    kind = dict(batch.dtypes)[key]
    none = batch.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast(kind).alias(key), "n", F.lit(quiet).alias("body"))
    return rows.unionByName(none)


def ingest_dedupe(candidates: DataFrame, key: str, url: str, order: str, existing: DataFrame, tombstones: DataFrame, most: int) -> DataFrame:
    """New urls: the first so many of each entity, then without known and pruned ones. The cap comes first, as it limits work."""
    first = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order, url))).filter(F.col("_n") <= most).drop("_n")
    return first.join(existing.select(url), url, "left_anti").join(tombstones.select(url), url, "left_anti")


def content_version(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """outcome: new for the first row of a (key, digest) not stored, already_have for all others."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    known = stored.select(*keys).distinct().withColumn("_have", F.lit(True))
    return incoming.withColumn("_first", first).join(known, list(keys), "left").withColumn("outcome", F.when(F.col("_have").isNull() & F.col("_first"), "new").otherwise("already_have")).drop("_first", "_have")


def reextract_gate(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """outcome: skip if digest and version are as stored, replace if stored otherwise, insert if not stored."""
    have = stored.select(key, F.col("digest").alias("_d"), F.col("version").alias("_v"))
    same = F.col("digest").eqNullSafe(F.col("_d")) & F.col("version").eqNullSafe(F.col("_v"))
    return incoming.join(have, key, "left").withColumn("outcome", F.when(F.col("_v").isNull(), "insert").when(same, "skip").otherwise("replace")).drop("_d", "_v")


def replace_children(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The stored rows without those of the incoming keys, and the incoming rows."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def snapshot_on_change(history: DataFrame, incoming: DataFrame, key: str, facets: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The incoming snapshots that differ from the newest stored one, with the facets that changed."""
    last = latest_per_group(history, [key], order).select(key, *(F.col(f).alias(f"_{f}") for f in facets), F.lit(True).alias("_had"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in facets)))
    return incoming.join(last, key, "left").withColumn("changed", changed).filter(F.col("_had").isNull() | (F.size("changed") > 0)).select(*incoming.columns, "changed")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str], stamp: Column | None = None, fill_only: bool = False, protected: Column | None = None, ranked: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows of both by key: incoming values win, or with ``fill_only`` only fill nulls. Rows that
    ``protected`` (on the stored columns) holds for stay as they are. ``op``: I, U or =.

    ``ranked`` names one of the columns and its values, best first: an incoming value that ranks higher than the
    stored one replaces it under ``fill_only`` too. Values that are not named rank last.
    """
    guard = protected if protected is not None else F.lit(False)
    a = stored.select(key, *(F.col(c).alias(f"_old_{c}") for c in columns), F.lit(True).alias("_s"), guard.alias("_guard"))
    b = incoming.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_i"))
    both = a.join(b, key, "full")

    def merged(c: str) -> Column:
        old, new = F.col(f"_old_{c}"), F.col(f"_new_{c}")
        value = F.coalesce(old, new) if fill_only else F.coalesce(new, old)
        if ranked and c == ranked[0]:
            place = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranked[1])), x), F.lit(0)), F.lit(len(ranked[1]) + 1))
            value = F.when(place(new) < place(old), new).otherwise(F.coalesce(old, new))
        return F.when(F.coalesce("_guard", F.lit(False)), old).otherwise(value)

    same = F.lit(True)
    for c in columns:
        same = same & merged(c).eqNullSafe(F.col(f"_old_{c}"))
    op = F.when(F.col("_s").isNull(), "I").when(F.col("_i").isNull() | same, "=").otherwise("U")
    out = both.select(key, *(merged(c).alias(c) for c in columns), op.alias("op"))
    return out if stamp is None else out.withColumn("updated", F.when(F.col("op") != "=", stamp))


def upsert_insert_only(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return stored.unionByName(incoming.join(stored.select(key), key, "left_anti"))


def upsert_changed_only(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, op): I inserted, U changed, D vanished, = as stored."""
    a, b = (rows.select(key, F.struct(*columns).alias(n)) for rows, n in ((stored, "_a"), (incoming, "_b")))
    op = F.when(F.col("_a").isNull(), "I").when(F.col("_b").isNull(), "D").when(F.col("_a") == F.col("_b"), "=").otherwise("U")
    return a.join(b, key, "full").select(key, op.alias("op"))


def detail_sync(details: DataFrame, passes: DataFrame, key: str) -> DataFrame:
    """A shortfall sets the reason, a clean pass (null reason) removes it."""
    kept = details.join(passes.select(key), key, "left_anti")
    return kept.unionByName(passes.filter("reason is not null").select(*details.columns))


def prune_with_tombstone(docs: DataFrame, children: DataFrame, tombstones: DataFrame, key: str, foreign: str, url: str, old: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents kept, children kept, tombstones): old documents leave a tombstone each, and take their children along."""
    gone = docs.filter(F.coalesce(old, F.lit(False)))
    more = gone.select(url).distinct().join(tombstones.select(url), url, "left_anti")
    return docs.join(gone.select(key), key, "left_anti"), children.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti"), tombstones.select(url).unionByName(more)


def orphan_repair(children: DataFrame, foreign: str, parents: DataFrame, key: str, policy: str) -> DataFrame:
    """Children of missing parents lose the key (``null``) or go (``delete``)."""
    if policy not in ("null", "delete"):
        raise ValueError(f"no such policy: {policy}")
    have = parents.select(F.col(key).alias("_p")).distinct()
    joined = children.join(have, F.col(foreign) == F.col("_p"), "left")
    if policy == "delete":
        return joined.filter(F.col(foreign).isNull() | F.col("_p").isNotNull()).drop("_p")
    return joined.withColumn(foreign, F.col("_p")).drop("_p")


def status_transition(rows: DataFrame, requests: DataFrame, key: str, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """(key, status, accepted): the wanted status if the map allows it from the present one."""
    ok = F.lit(False)
    for source, targets in allowed.items():
        ok = ok | ((F.col("status") == source) & F.col("wanted").isin(*targets))
    joined = rows.select(key, "status").join(requests.select(key, "wanted"), key)
    return joined.select(key, F.when(ok, F.col("wanted")).otherwise(F.col("status")).alias("status"), ok.alias("accepted"))


def find_or_create(stored: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows, and one row for each wanted key that has none, with nulls in all other columns. ``created`` tells them apart."""
    new = wanted.select(*keys).distinct().join(stored.select(*keys), list(keys), "left_anti")
    return stored.withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)), allowMissingColumns=True)


def run_ledger(runs: DataFrame, entities: DataFrame, ledger: DataFrame, run: str, entity: str) -> DataFrame:
    """The ledger with a pending row for every missing (run, entity), and whether a resumed run has to take it up: all but
    succeeded and failed rows are. Every run has a row of every entity, as many as the result."""
    wanted = runs.select(run).crossJoin(entities.select(entity))
    missing = wanted.join(ledger.select(run, entity), [run, entity], "left_anti").withColumn("status", F.lit("pending"))
    rows = ledger.select(run, entity, "status").unionByName(missing.select(run, entity, "status"))
    return rows.withColumn("resume", ~F.col("status").isin("succeeded", "failed"))


def run_progress(ledger: DataFrame, run: str) -> DataFrame:
    """(run, total, completed, open): rows of each run, those that succeeded, and those a resumed run takes up."""
    return ledger.groupBy(run).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "succeeded").alias("completed"), F.count_if("resume").alias("open"))


def pending_alerts(rows: DataFrame, sent: str, order: Sequence[Column], cap: int, min_count: int = 1) -> DataFrame:
    """The first unsent rows; none where fewer than ``min_count`` are unsent."""
    waiting = rows.filter(~F.col(sent))
    enough = waiting.agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_count).select(F.lit(1).alias("_one"))  # one row or none
    return waiting.orderBy(*order).limit(cap).join(F.broadcast(enough), F.lit(True), "left_semi")


def mark_sent(rows: DataFrame, sent: str, key: str, alerts: DataFrame | None, stamp: Column) -> DataFrame:
    """The rows with those of ``alerts`` marked as sent at the stamp; with None, the baseline, all that are unsent."""
    if alerts is None:
        return rows.withColumn("sent_at", F.when(~F.col(sent), stamp)).withColumn(sent, F.lit(True))
    hit = alerts.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn("sent_at", F.when(F.col("_hit"), stamp)).withColumn(sent, F.col(sent) | F.coalesce("_hit", F.lit(False))).drop("_hit")


def outcome_log(attempts: DataFrame, key: str, order: str, stops: Column) -> DataFrame:
    """The attempts that were made, numbered: of each entity those up to the first whose outcome ends its ladder."""
    w = Window.partitionBy(key).orderBy(order)
    ended = F.sum(F.coalesce(stops, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    made = attempts.withColumn("attempt", F.row_number().over(w)).withColumn("_ended", F.coalesce(ended, F.lit(0)))
    return made.filter("_ended = 0").drop("_ended")


def outcome_ladder(attempts: DataFrame, key: str, order: str, stops: Column) -> DataFrame:
    """Each entity's outcome: the attempt that ended its ladder, else its last one."""
    return latest_per_group(outcome_log(attempts, key, order, stops), [key], [F.col("attempt").desc()])


def deactivate(rows: DataFrame, noisy: Column, note: str) -> DataFrame:
    """Noisy active rows become inactive, with a note before theirs."""
    hit = F.coalesce(noisy & F.col("active"), F.lit(False))
    return rows.withColumn("notes", F.when(hit, F.concat_ws("; ", F.lit(note), "notes")).otherwise(F.col("notes"))).withColumn("active", F.col("active") & ~hit)


def cascade_rollup(parts: DataFrame, period: Column, wanted: Column, most: int | None = None) -> DataFrame:
    """One level of a chain of periods: parts (key, start, end, status, text) to (start, sources, n, block).

    A part counts in the period that holds its start and its end, if ``wanted`` holds for it; of over ``most`` parts the
    newest count. The block has the parts' texts oldest first, each under its own start's label, so gaps keep
    their names. The result's parts feed the next level once they have a key, an end and a status.
    """
    inside = parts.filter(wanted).withColumn("period", period)
    if most:
        inside = inside.withColumn("_n", F.row_number().over(Window.partitionBy("period").orderBy(F.col("start").desc(), F.col("key").desc()))).filter(F.col("_n") <= most)
    grouped = inside.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("start", "key", "text"))).alias("p"))
    block = F.array_join(F.transform("p", lambda x: F.concat(F.lit("=== "), F.date_format(x["start"], "MMMM d, yyyy"), F.lit(" ===\n"), F.trim(x["text"]))), "\n\n")
    return grouped.select("period", F.transform("p", lambda x: x["key"]).alias("sources"), F.size("p").cast("bigint").alias("n"), block.alias("block"))
