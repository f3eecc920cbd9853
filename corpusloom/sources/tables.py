"""Tables, registries and reports as files: scans with declared schemas, and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see, under spark.checkpoint.dir. A local session without it, as in tests, gets a
    temporary one; on a cluster that would be another one on each machine, so there it is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/scratch-{uuid.uuid4().hex}"


def scan_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with its declared columns; columns that a file lacks are null."""
    return spark.read.schema(schema).parquet(path)


def scan_json_registry(spark: SparkSession, path: str, schema: str, key: str, wanted: str) -> DataFrame:
    """Objects of a JSON array with optional keys, filtered on a lower-cased key."""
    return spark.read.option("multiLine", True).schema(schema).json(path).filter(F.lower(F.coalesce(key, F.lit(""))) == wanted)


def scan_mapping(rows: DataFrame, text: str, fall_back: bool) -> DataFrame:
    """(raw, canonical, is_manager) of a JSON object whose values are objects or strings. An explicit
    null canonical falls back to the raw name, or stays null."""
    pairs = rows.select(F.explode(F.from_json(text, "map<string,variant>")).alias("raw", "_v"))
    is_object = F.schema_of_variant("_v").like("OBJECT%")
    canonical = F.when(is_object, F.try_variant_get("_v", "$.canonical", "string")).otherwise(F.try_variant_get("_v", "$", "string"))
    flag = F.when(is_object, F.try_variant_get("_v", "$.is_manager", "boolean"))
    return pairs.select("raw", (F.coalesce(canonical, "raw") if fall_back else canonical).alias("canonical"), F.coalesce(flag, F.lit(True)).alias("is_manager"))


def scan_block_list(registry: DataFrame, key: str, blocked: Sequence[int], explicit: Sequence[int] | None = None) -> DataFrame:
    """Explicit ids win; else the registry without the blocked ids."""
    return registry.filter(F.col(key).isin(*explicit)) if explicit else registry.filter(~F.col(key).isin(*blocked))


def scan_csv_patch(spark: SparkSession, path: str, required: Sequence[str], target: DataFrame, key: str, column: str, allowed: Sequence[str]) -> DataFrame:
    """(key, column, outcome) of a CSV of changes: invalid, blank key, unknown key, unchanged or updated."""
    patch = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in patch.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    known = target.select(F.col(key).cast("string").alias("_k"), F.col(column).alias("_old"))
    joined = patch.join(known, F.trim(key) == F.col("_k"), "left")
    outcome = (
        F.when(F.coalesce(F.trim(key), F.lit("")) == "", "blank key").when(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)), "invalid").when(F.col("_k").isNull(), "unknown key").when(F.col("_old").eqNullSafe(F.col(column)), "unchanged").otherwise("updated")
    )
    return joined.select(F.trim(key).alias(key), column, outcome.alias("outcome"))


def sink_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').csv(path)


def sink_table_copy(tables: dict[str, DataFrame], folder: str, replace: bool = False) -> None:
    """Copies the tables, times as UTC instants; refuses a folder that has them unless ``replace``."""
    for name, rows in tables.items():
        zoned = rows.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes))
        zoned.write.mode("overwrite" if replace else "errorifexists").parquet(f"{folder}/{name}.parquet")


def report_rows(rows: DataFrame, key: str, order: str, line: Column, target: str, whole: int) -> DataFrame:
    """(key, body): a header, one line for each row in order, and a note on whether the targets sum up."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("_l")))), lambda x: x["_l"]), "\n")
    total = F.sum(target)
    note = F.when(total.isNull(), "no targets").when(F.abs(total - whole) > whole / 100, F.concat(F.lit("targets sum to "), total.cast("string"))).otherwise("targets sum up")
    return rows.groupBy(key).agg(F.concat_ws("\n", F.concat(F.lit("# "), F.first(F.col(key).cast("string"))), lines, note).alias("body"))


def report_index(rows: DataFrame, key: str, label: Column, target: str) -> DataFrame:
    """(key, line): beside the bodies a row of a Markdown table for each entity, a link to its report, its lines and those with a target."""
    facts = rows.groupBy(key, label.alias("_label")).agg(F.count("*").alias("n"), F.count(target).alias("n_targets"))
    cells = [F.concat(F.lit("["), "_label", F.lit("]("), F.col(key).cast("string"), F.lit(".md)")), F.col("n").cast("string"), F.col("n_targets").cast("string")]
    return facts.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def note_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, title, generated) of text files: the title is the first heading, else the name; newest first."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
    title = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^# +(.+)$", 1), F.lit("")), "name")
    marked = F.try_to_date(F.regexp_extract("text", r"Generated: ([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    named = F.try_to_date(F.regexp_extract("name", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    return files.select("name", title.alias("title"), F.coalesce(marked, named).alias("generated")).orderBy(F.col("generated").desc_nulls_last(), "name")
