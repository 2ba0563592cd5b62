"""Round trips through the table formats, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossloom import schemas
from lossloom.catalog import sql as q
from lossloom.catalog.adapters import Tables
from lossloom.catalog.registry import register
from lossloom.plans.workspace import scratch_table
from lossloom.sources import files as fl

_LEDGER = "section_id, ledger_id, sample, instruct, gold_summary, '' AS student_ans, token_length, round(loss, 6) AS loss, tag, round_id, source, source_ledger_id"


def _some(section: str = "section_id"):
    """About half of the sections, for writing a table in parts."""
    return F.substring(section, 9, 3).cast("int") % 2 == 0


def _ledger(t: Tables):
    """Written by sections, each round of a section on its own, and one round again."""
    path = scratch_table(t.spark, "ledger")
    ledger, early = t.ledger(), F.col("round_id") < 7
    for part in (_some() & early, ~_some() & early, _some() & ~early, ~_some() & ~early, _some() & (F.col("round_id") == 3)):
        fl.write_ledger(ledger.where(part), path)
    return fl.read_ledger(t.spark, path)


register("write_ledger", _ledger, f"SELECT {_LEDGER} FROM ledger")


def _ledger_json(t: Tables):
    """The ledger as JSON lines, read back with the declared schema."""
    path = scratch_table(t.spark, "ledger-json")
    t.ledger().write.json(path)
    return fl.read_ledger(t.spark, path, "jsonl")


register("read_ledger_json", _ledger_json, f"SELECT {_LEDGER} FROM ledger")


def _vault(t: Tables):
    """Two rounds, the second section by section and once too large, then again."""
    path = scratch_table(t.spark, "vault")
    vault, short = t.vault(), F.col("pos") <= 4
    fl.write_vault(vault.withColumn("round_id", F.lit(1)), path)
    second = vault.withColumn("round_id", F.lit(2))
    fl.write_vault(second.where(_some()), path)
    for part in (_some() & short, ~_some() & short):
        fl.write_vault(second.where(part), path)
    return fl.read_vault(t.spark, path).select("round_id", "section_id", "pos", "ledger_id", "tag", "loss", "active", "recycle_count")


register(
    "write_vault",
    _vault,
    "SELECT r AS round_id, section_id, pos, ledger_id, tag, round(loss, 6) AS loss, active, recycle_count FROM vault, (VALUES (1), (2)) x(r) WHERE r = 1 OR pos <= 4",
)


def _state(t: Tables):
    path = scratch_table(t.spark, "state")
    t.next_rounds().write.json(path)  # as an older writer left it: most fields are missing
    fl.write_state(fl.read_state(t.spark, path, "jsonl"), path + "-new")
    return fl.read_state(t.spark, path + "-new").select(
        "section_id", "current_round", "consecutive_no_recycle", "example_format", "task_mode", "bad_round_streak", "best_round_id"
    )


register(
    "write_state",
    _state,
    "SELECT section_id, current_round + 1 AS current_round, 0 AS consecutive_no_recycle, 'auto' AS example_format, 'auto' AS task_mode, 0 AS bad_round_streak, NULL::INTEGER AS best_round_id FROM rounds",
)


def _events(t: Tables):
    path = scratch_table(t.spark, "events")
    rows = t.read("events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("section_id"), "event_type", "value", "props"
    )
    for stage, part in (("low", F.col("value") < 50), ("high", F.col("value") >= 50), ("low", F.col("value") < 50)):  # one stage again
        fl.write_events(rows.where(part), path, stage)
    return fl.read_events(t.spark, path, "value double, props string").groupBy("section_id", "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.max("props").alias("props")
    )


register(
    "write_events",
    _events,
    "SELECT CAST(user_id AS VARCHAR) AS section_id, event_type, count(*) AS n, round(sum(value), 6) AS total, max(props) AS props FROM events GROUP BY 1, 2",
)


def _eval_losses(t: Tables):
    path = scratch_table(t.spark, "losses")
    t.ledger().select(F.col("tag").alias("run"), F.col("ledger_id").cast("int").alias("batch_index"), "loss").write.option("header", True).csv(path)
    return fl.read_eval_losses(t.spark, path)


register("read_eval_losses", _eval_losses, "SELECT tag AS run, CAST(ledger_id AS INTEGER) AS batch_index, round(loss, 6) AS loss FROM ledger")


def _example_files(t: Tables, text: bool):
    """Files of many pairs each: a list of objects, or blocks one after another."""
    path = scratch_table(t.spark, "examples")
    block = F.concat(F.lit("Sample:\n"), "instruct", F.lit("\nOutput:\n"), "gold_summary")
    obj = F.to_json(F.struct(F.col("instruct").alias("sample"), F.col("gold_summary").alias("output")))
    body = F.regexp_replace(block if text else obj, "\r", "")
    bundle = F.floor((F.col("conv_id") * 64 + F.col("turn")) / 16)  # at most 16 pairs, whatever the size of the table
    bundles = t.pairs().groupBy(bundle.alias("b")).agg(F.collect_list(body).alias("l"))
    whole = F.array_join("l", "\n\n") if text else F.concat(F.lit("["), F.array_join("l", ","), F.lit("]"))
    bundles.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = fl.read_examples_text if text else fl.read_examples_json
    return read(t.spark, path).select("sample", "output", "mode")


_PAIRS = f"SELECT {q.strip('instruct')} AS sample, {q.strip('gold_summary')} AS output, 'plain' AS mode FROM pairs"
register("read_examples_text", lambda t: _example_files(t, True), _PAIRS)
register("read_examples_json", lambda t: _example_files(t, False), _PAIRS)


def _numbered(t: Tables):
    rows = t.ledger().select("section_id", "round_id", F.col("ledger_id").alias("slot_id"), F.col("sample").alias("prompt"))
    early = fl.number_requests(rows.where(F.col("round_id") < 10))
    path = scratch_table(t.spark, "requests")
    fl.write_requests(early, path)
    late = fl.number_requests(rows.where(F.col("round_id") >= 10), t.spark.read.parquet(path))
    fl.write_requests(late, path)
    sent = t.spark.read.parquet(path)
    answers = scratch_table(t.spark, "responses")
    fl.write_responses(sent.where(F.col("request_no") % 2 == 0).select("section_id", "round_id", "request_no", F.upper("prompt").alias("response")), answers)
    return fl.pair_responses(sent, t.spark.read.parquet(answers)).select("section_id", "slot_id", "request_no", "response")


register(
    "write_requests",
    _numbered,
    "SELECT section_id, ledger_id AS slot_id, row_number() OVER w AS request_no, CASE WHEN row_number() OVER w % 2 = 0 THEN upper(sample) END AS response "
    "FROM ledger WINDOW w AS (PARTITION BY section_id ORDER BY round_id, ledger_id)",
)


def _cache(t: Tables):
    path = scratch_table(t.spark, "cache")
    rows = t.ledger().select(
        F.sha2("sample", 256).alias("cache_key"), F.lit("v").alias("cache_version"), F.lit("m").alias("model_id"), F.col("sample").alias("prompt"),
        F.when(F.col("token_length") % 5 == 0, " ").otherwise(F.concat(F.lit(" a"), F.col("token_length").cast("string"))).alias("response"),
    )
    fl.write_cache(rows.where(F.col("token_length") < 60), path)
    fl.write_cache(rows.where(F.col("token_length") > 30), path)
    return fl.read_table(t.spark, path, schemas.CACHE).select("cache_key", "prompt", "response")


register(
    "write_cache",
    _cache,
    "SELECT DISTINCT sha256(sample) AS cache_key, sample AS prompt, 'a' || token_length AS response FROM ledger WHERE token_length % 5 <> 0",
)


def _history(t: Tables):
    path = scratch_table(t.spark, "history")
    for part in (F.col("round_id") < 9, _some() & (F.col("round_id") >= 9), ~_some() & (F.col("round_id") >= 9), F.col("round_id") > 25):
        fl.write_planner_history(t.round_losses().where(part), path, keep=12)
    return t.spark.read.parquet(path).select("section_id", "round_id", "decision_loss")


register(
    "write_planner_history",
    _history,
    "SELECT section_id, round_id, round(decision_loss, 6) AS decision_loss FROM health_in QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY round_id DESC) <= 12",
)

