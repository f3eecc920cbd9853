"""The incremental operators over streams of files. Each run takes what is new and stops (``availableNow``).

Two ways keep state. Where an entity's rows must be taken in the order of their event times, rows wait in
the entity's state until the watermark has passed them, so that late and unordered files give the result
that all rows together would give; an entity that stays silent for long enough is forgotten. Where a batch is
judged as a whole, what earlier batches decided lies in tables with a part for each batch: a batch reads the
parts before its own and overwrites its own, so that a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.incremental import content_version, ingest_dedupe, trigger_reasons


def read_files(spark: SparkSession, path: str, schema: str, at: str, most: int | None = None) -> DataFrame:
    """A stream of Parquet files, at most so many a batch; the event time becomes an instant, as watermarks need one."""
    reader = spark.readStream.schema(schema)
    if most:
        reader = reader.option("maxFilesPerTrigger", most)
    return reader.parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def run_once(rows: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there, into Parquet at ``out``, and returns what was written.

    State and offsets are kept next to it, so a later run goes on where this one stopped.
    """
    spark = rows.sparkSession
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode(mode).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def dedupe(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """First occurrences; a key is remembered while the watermark allows."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def new_since(rows: DataFrame, at: str, now: Column) -> DataFrame:
    """Rows before now; those of earlier runs are behind the checkpoint."""
    return rows.filter(F.col(at) < now)


# --- rows in the order of their event times


#: Groups that entities are dealt into; a stream that goes on needs the same number.
GROUPS = 1024
_STATE = "known binary, waiting binary"
_KNOWN = pa.schema({"entity": pa.int64(), "last": pa.string(), "until": pa.int64()})
_WAITING = pa.schema({"entity": pa.int64(), "at": pa.int64(), "id": pa.int64(), "value": pa.string()})


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _in_order(take: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], forget_ms: int) -> Callable:
    """The state function of a group of entities, whose state lies together, as a call for each entity costs more than its rows. Rows
    wait until the watermark has passed them and are then taken by entity, time and id. ``take`` gets the rows now due and, for
    each, its entity's last value; it gives the output, and puts the value after each row into the column ``now`` of the due rows."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = [pa.ipc.open_stream(b).read_all().to_pandas() for b in state.get] if state.exists else [s.empty_table().to_pandas() for s in (_KNOWN, _WAITING)]
        known, held = stored[0].set_index("entity"), stored[1]
        if not state.hasTimedOut:
            new = pd.concat([p[_WAITING.names] for p in parts])
            fresh = pd.Index(new["entity"].unique())
            held = pd.concat([held, new]) if len(held) else new
        else:
            fresh = pd.Index([], dtype="int64")
        mark = state.getCurrentWatermarkMs()
        held = held.astype({"entity": "int64", "value": "object"}).sort_values(["entity", "at", "id"], kind="stable", ignore_index=True)
        ready = held["at"] < mark * 1000
        due, held = held[ready].reset_index(drop=True), held[~ready]
        # silent for as long as they are remembered
        gone = known.index[(known["until"] < mark).to_numpy() & ~known.index.isin(fresh) & ~known.index.isin(due["entity"]) & ~known.index.isin(held["entity"])]
        known = known.drop(gone)
        if len(due):
            yield take(due, due["entity"].map(known["last"]))
        ends = due.drop_duplicates("entity", keep="last").set_index("entity")
        touched = fresh.union(ends.index)
        known = known.reindex(known.index.union(touched))
        known.loc[ends.index, "last"] = ends["now"] if len(ends) else None
        known.loc[touched, "until"] = mark + forget_ms
        known = known.astype({"until": "int64", "last": "object"})
        if not len(known) and not len(held):
            state.remove()
            return
        state.update((_packed(known.rename_axis("entity").reset_index(), _KNOWN), _packed(held, _WAITING)))
        idle = known["until"][~known.index.isin(held["entity"])]
        wake = min([*([held["at"].min() // 1000] if len(held) else []), *([idle.min()] if len(idle) else [])])
        state.setTimeoutTimestamp(int(max(wake, mark + 1)))

    return step


def _ordered(rows: DataFrame, entity: str, key: str, value: str, at: str, delay: str, forget_days: int, take: Callable, out: str) -> DataFrame:
    none = F.lit(-(2**63))  # stands for the entity null inside the state
    shaped = rows.withWatermark(at, delay).select(F.coalesce(F.col(entity).cast("long"), none).alias("entity"), F.col(key).cast("long").alias("id"), F.col(value).cast("string").alias("value"), F.unix_micros(at).alias("at"), F.col(at).alias("_event"))
    grouped = shaped.withColumn("_group", F.pmod(F.xxhash64("entity"), F.lit(GROUPS))).groupBy("_group")
    made = grouped.applyInPandasWithState(_in_order(take, forget_days * 86_400_000), out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.withColumn("entity", F.nullif("entity", none))


def _changed(due: pd.DataFrame, last: pd.Series) -> pd.DataFrame:
    first = due["entity"] != due["entity"].shift()
    before = due["value"].shift().where(~first, last)
    due["now"] = due["value"]
    return due.loc[(due["value"] != before) | before.isna(), ["entity", "id", "value"]]


def snapshot_on_change(rows: DataFrame, entity: str, key: str, value: str, at: str, delay: str = "7 days", forget_days: int = 3650) -> DataFrame:
    """(entity, id, value) of the rows whose value is not that of the entity's row before, by event time, across batches.
    Rows wait ``delay`` for late ones; an entity without a row for ``forget_days`` starts anew."""
    return _ordered(rows, entity, key, value, at, delay, forget_days, _changed, "entity long, id long, value string")


def status_transition(rows: DataFrame, entity: str, key: str, wanted: str, at: str, allowed: dict[str, list[str]], delay: str = "7 days", forget_days: int = 3650) -> DataFrame:
    """(entity, id, status, accepted): each request, by event time, against the status that the ones before it left; the first is accepted."""

    def judged(due: pd.DataFrame, last: pd.Series) -> pd.DataFrame:
        status, accepted, entity, now = [], [], object(), None
        for e, value, stored in zip(due["entity"].tolist(), due["value"].tolist(), last.astype(object).where(last.notna(), None).tolist(), strict=True):
            entity, now = e, (now if e == entity else stored)
            accepted.append(now is None or value in allowed.get(now, ()))
            now = value if accepted[-1] else now
            status.append(now)
        due["now"] = pd.Series(status, dtype=object)
        return pd.DataFrame({"entity": due["entity"], "id": due["id"], "status": due["now"], "accepted": accepted})

    return _ordered(rows, entity, key, wanted, at, delay, forget_days, judged, "entity long, id long, status string, accepted boolean")


# --- batches with kept tables


class BatchTable:
    """A table with a part for each batch. Where ``every`` is given, the part of each so-manyth batch holds all that
    ``merge`` makes of the parts before it, so that a batch reads few parts however many there were."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, every: int | None = None, merge: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.folder, self.schema, self.every, self.merge = spark, folder, schema, every, merge

    def before(self, batch: int) -> DataFrame:
        rows = self.all()
        start = (batch - 1) // self.every * self.every if self.every else 0
        return rows.filter((F.col("batch") >= start) & (F.col("batch") < batch)).drop("batch")

    def all(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        rows = self.spark.read.schema(f"{self.schema}, batch long").parquet(self.folder) if there else self.spark.createDataFrame([], f"{self.schema}, batch long")
        return rows

    def write(self, rows: DataFrame, batch: int) -> None:
        if self.every and batch % self.every == 0 and batch:
            rows = self.merge(self.before(batch).unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")


def in_batches(rows: DataFrame, handle: Callable[[DataFrame, int], None], state: str) -> None:
    """Hands each batch with its number to ``handle`` until nothing new is left."""
    query = rows.writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def trigger_batches(rows: DataFrame, folder: str, title: str, keywords: Sequence[str], volume: int, days: int, entity: str = "entity_id", at: str = "ts", order: Sequence[Column] = ()) -> DataFrame:
    """(batch, reason) of each batch's triggers. An entity reappears if its newest row of earlier batches is over ``days`` before
    the batch's newest row; the newest row of each entity is kept, and no other row of earlier batches is read."""
    kind = dict(rows.dtypes)[entity]
    newest = lambda x: x.groupBy(entity).agg(F.max(at).alias(at))
    seen = BatchTable(rows.sparkSession, f"{folder}/seen", f"{entity} {kind}, {at} timestamp", 16, newest)
    found = BatchTable(rows.sparkSession, f"{folder}/triggers", "reason string")

    def handle(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        found.write(trigger_reasons(batch, title, keywords, volume, newest(seen.before(n)), entity, at, days, order), n)
        seen.write(newest(batch), n)
        batch.unpersist()

    in_batches(rows, handle, f"{folder}/state")
    return found.all()


def ingest_batches(rows: DataFrame, folder: str, key: str, url: str, order: str, existing: DataFrame, tombstones: Callable[[], DataFrame], most: int) -> DataFrame:
    """The new urls of each batch, with ``batch``: the first ``most`` candidates of each entity and batch, without those that exist, that an
    earlier batch took, or that are pruned by then (``tombstones`` is asked at each batch, as it grows)."""
    kinds = dict(rows.dtypes)
    taken = BatchTable(rows.sparkSession, f"{folder}/taken", ", ".join(f"{c} {kinds[c]}" for c in rows.columns))

    def handle(batch: DataFrame, n: int) -> None:
        first = batch.groupBy(key, url).agg(F.min_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
        known = existing.select(url).unionByName(taken.before(n).select(url))
        taken.write(ingest_dedupe(first, key, url, order, known, tombstones(), most).select(*rows.columns), n)

    in_batches(rows, handle, f"{folder}/state")
    return taken.all()


def version_batches(rows: DataFrame, folder: str, key: str, digest: str, order: Sequence[str]) -> DataFrame:
    """Each row's outcome (new, already_have) against all earlier batches and rows, and the entity's version number that it made or
    has, with ``batch``. Versions count on over batches."""
    kinds = dict(rows.dtypes)
    versions = BatchTable(rows.sparkSession, f"{folder}/versions", f"{key} {kinds[key]}, {digest} {kinds[digest]}, version long")
    outcomes = BatchTable(rows.sparkSession, f"{folder}/outcomes", ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", outcome string, version long")

    def handle(batch: DataFrame, n: int) -> None:
        from pyspark.sql import Window

        stored = versions.before(n)
        judged = content_version(batch, stored, [key, digest], [F.col(c) for c in order]).persist()
        last = stored.groupBy(key).agg(F.max("version").alias("_last"))
        new = judged.filter("outcome = 'new'").join(last, key, "left")
        number = F.row_number().over(Window.partitionBy(key).orderBy(*order)) + F.coalesce("_last", F.lit(0))
        versions.write(new.select(key, digest, number.cast("long").alias("version")), n)
        known = versions.all().filter(F.col("batch") <= n).drop("batch")
        outcomes.write(judged.join(known, [key, digest], "left").select(*rows.columns, "outcome", "version"), n)
        judged.unpersist()

    in_batches(rows, handle, f"{folder}/state")
    return outcomes.all()
