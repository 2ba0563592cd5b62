"""Reading and writing the loop's tables. Schemas are declared; missing paths read as empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom import schemas
from lossloom.functions import text as tx
from lossloom.operators import examples as ex
from lossloom.operators.ledger import keep_last
from lossloom.operators.ranking import number_rows
from lossloom.params import DEFAULTS
from lossloom.plans.workspace import path_exists, settle


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table with a declared schema; an empty frame where the path does not exist.

    JSON may be a file holding one array, or one object per line.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if fmt == "json":
        return reader.option("multiLine", True).json(path)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.parquet(path)


def write_partitions(df: DataFrame, path: str, by: tuple[str, ...] = ("section_id", "round_id")) -> None:
    """Write and replace only the partitions present in ``df``: other sections and rounds stay, and a rerun changes nothing.

    Rows go to their partition's task first, and Spark parts the large ones and joins the small ones by size, so a partition
    gets as many files as its bytes call for, however many tasks the rows come from.
    """
    df.hint("rebalance", *(F.col(c) for c in by)).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_ledger(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.LEDGER, fmt)


def write_ledger(rows: DataFrame, path: str) -> None:
    write_partitions(rows.select(*schemas.columns(schemas.LEDGER)), path)


def read_vault(spark: SparkSession, path: str, round_id: int | None = None) -> DataFrame:
    """Vault snapshots; one round's if given."""
    table = read_table(spark, path, schemas.VAULT + ", round_id int")
    return table if round_id is None else table.where(F.col("round_id") == round_id).drop("round_id")


def write_vault(vault: DataFrame, path: str) -> None:
    """Snapshot per section and round; ``vault`` carries ``round_id``."""
    write_partitions(vault, path)


def read_state(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Section state with defaults for what older writers left out."""
    state = read_table(spark, path, schemas.STATE, fmt)
    defaults = {
        "current_round": F.lit(0), "consecutive_no_recycle": F.lit(0), "example_format": F.lit("auto"),
        "task_mode": F.lit("auto"), "bad_round_streak": F.lit(0),
    }
    return state.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def write_state(state: DataFrame, path: str) -> None:
    state.select(*schemas.columns(schemas.STATE)).write.mode("overwrite").parquet(path)


def write_events(events: DataFrame, path: str, stage: str) -> None:
    """Write a stage's events as JSON lines; columns beyond the three fixed ones make the payload.

    ``stage`` names what wrote them (for instance a step of the loop); writing a stage again replaces its events.
    """
    extra = [c for c in events.columns if c not in ("timestamp", "section_id", "event_type")]
    line = F.to_json(F.struct("timestamp", "section_id", "event_type", *extra))
    rows = events.select(line.alias("value"), F.lit(stage).alias("stage"))
    rows.write.partitionBy("stage").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def read_events(spark: SparkSession, path: str, fields: str = "payload string") -> DataFrame:
    return read_table(spark, path, f"timestamp timestamp, section_id string, event_type string, {fields}", "jsonl")


def read_example_files(spark: SparkSession, glob: str) -> DataFrame:
    """One row per file with its whole text."""
    return spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("file"), "value")


def read_examples_json(spark: SparkSession, glob: str, fmt: str = "auto") -> DataFrame:
    return ex.parse_examples_json(read_example_files(spark, glob), fmt=fmt)


def read_examples_text(spark: SparkSession, glob: str, fmt: str = "auto") -> DataFrame:
    return ex.parse_examples_text(read_example_files(spark, glob), fmt=fmt)


def read_eval_losses(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.EVAL_LOSS, "csv")


def number_requests(
    requests: DataFrame, existing: DataFrame | None = None, order: tuple[str, ...] = ("round_id", "slot_id")
) -> DataFrame:
    """Consecutive request numbers per section, by round and slot, after the highest one already written."""
    numbered = number_rows(requests, ["section_id"], order, "_pos")
    if existing is None:
        return numbered.withColumn("request_no", F.col("_pos") + 1).drop("_pos")
    top = existing.groupBy("section_id").agg(F.max("request_no").alias("_top"))
    return (
        numbered.join(top, "section_id", "left")
        .withColumn("request_no", F.coalesce("_top", F.lit(0)) + F.col("_pos") + 1)
        .drop("_pos", "_top")
    )


def write_requests(requests: DataFrame, path: str) -> None:
    write_partitions(requests, path)


def write_responses(responses: DataFrame, path: str) -> None:
    write_partitions(responses, path)


def pair_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their responses, by section and number."""
    return requests.join(
        responses.select("section_id", "request_no", "response"), ["section_id", "request_no"], "left"
    )


def write_cache(responses: DataFrame, path: str) -> None:
    """Append responses whose key is not stored yet; blank responses are not stored.

    ``responses`` holds the cache columns; of several answers to one key one is kept.
    """
    spark = responses.sparkSession
    names = schemas.columns(schemas.CACHE)
    stored = read_table(spark, path, schemas.CACHE).select("cache_key")
    rest = [c for c in names if c != "cache_key"]
    fresh = (
        responses.where(~tx.is_blank("response"))
        .withColumn("response", tx.strip("response"))
        .groupBy("cache_key")
        .agg(F.min(F.struct(*rest)).alias("r"))
        .select("cache_key", "r.*")
        .join(stored, "cache_key", "left_anti")
    )
    fresh.select(*names).write.mode("append").parquet(path)


def write_planner_history(snapshots: DataFrame, path: str, keep: int = DEFAULTS.history_limit) -> None:
    """Add snapshots and keep the newest ``keep`` per section in the table, one partition per section.

    Only the sections in ``snapshots`` are read and rewritten, at most ``keep`` rows each besides the new ones; a snapshot of
    a round that is there already replaces it.
    """
    spark = snapshots.sparkSession
    rows = snapshots
    if path_exists(spark, path):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in snapshots.schema)
        sections = snapshots.select("section_id").distinct()
        old = read_table(spark, path, schema).join(sections, "section_id", "left_semi")
        rows = old.join(snapshots.select("section_id", "round_id"), ["section_id", "round_id"], "left_anti").unionByName(snapshots)
    write_partitions(settle(keep_last(rows, keep)), path, ("section_id",))
