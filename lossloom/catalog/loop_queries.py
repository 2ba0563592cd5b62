"""Streaming queries run to completion, and the round loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom import schemas
from lossloom.catalog import sql as q
from lossloom.catalog.adapters import Tables, section_of
from lossloom.catalog.core_queries import VAULT_SQL, pressure_scores
from lossloom.catalog.registry import register
from lossloom.operators import sums as sm
from lossloom.plans.loop import run_generated, run_rounds
from lossloom.plans.workspace import scratch_table, settle
from lossloom.sources.files import read_vault, write_ledger, write_vault
from lossloom.streaming import streams as st


def _finish(df: DataFrame, t: Tables) -> DataFrame:
    """Run a stream over what is there now into a table, and read that table."""
    path = scratch_table(t.spark, "stream")
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-log").trigger(
        availableNow=True
    ).start().awaitTermination()
    return t.spark.read.schema(df.schema).parquet(path)


def _stream(t: Tables) -> DataFrame:
    """Evaluations as a stream; every event arrives twice."""
    schema = t.read("events").schema
    events = t.spark.readStream.schema(schema).parquet(f"{t.dir}/events*.parquet")
    e = F.col("event_id")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), section_of(e).alias("section_id"), e.alias("slot_id"), F.col("event_type").alias("tag"),
        F.when(e % 97 == 0, "nan").otherwise((F.col("value") / 97).cast("string")).alias("loss"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"),
    ).drop("copy")


register(
    "stream_ledger",
    lambda t: _finish(st.stream_ledger(_stream(t)), t).select("section_id", "slot_id", "tag", "finite", "loss"),
    f"SELECT {q.section('event_id')} AS section_id, event_id AS slot_id, event_type AS tag, event_id % 97 <> 0 AS finite, "
    "CASE WHEN event_id % 97 <> 0 THEN round(value / 97, 6) END AS loss FROM events",
)
q.PARTS["stream_rows"] = f"SELECT ts, {q.section('event_id')} AS section_id, event_type AS tag, value / 97 AS loss FROM events WHERE event_id % 97 <> 0"
_MONITOR = (
    "SELECT CAST(epoch(s) AS BIGINT) AS window_start, section_id, tag, 2 * count(*) AS n, round(avg(loss), 6) AS avg_loss, round(max(loss), 6) AS max_loss "
    "FROM {src} WHERE s + {len} <= (SELECT max(ts) FROM stream_rows) - INTERVAL 10 MINUTE GROUP BY ALL"
)


def _epoch(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.unix_timestamp("window_start")).drop("window_end")


register(
    "stream_loss_monitor",
    lambda t: _epoch(_finish(st.stream_loss_monitor(_stream(t)), t)),
    _MONITOR.format(src="(SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS s FROM stream_rows)", len="INTERVAL 1 DAY"),
)
register(
    "stream_loss_sliding",
    lambda t: _epoch(_finish(st.stream_loss_monitor(_stream(t), "2 days", "1 day"), t)),
    _MONITOR.format(
        src="(SELECT r.*, time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * k AS s FROM stream_rows r, (VALUES (0), (1)) x(k))", len="INTERVAL 2 DAY"
    ),
)
register(
    "stream_loss_sessions",
    lambda t: _epoch(_finish(st.stream_loss_monitor(_stream(t), session_gap="6 hours"), t)),
    """SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS window_start, section_id, tag, 2 * count(*) AS n, round(avg(loss), 6) AS avg_loss, round(max(loss), 6) AS max_loss
       FROM (SELECT *, sum(fresh) OVER (PARTITION BY section_id, tag ORDER BY ts) AS g FROM (
         SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY section_id, tag ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM stream_rows))
       GROUP BY section_id, tag, g HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM stream_rows) - INTERVAL 10 MINUTE""",
)


def _health(t: Tables) -> DataFrame:
    path = scratch_table(t.spark, "rounds")
    t.round_losses().select("section_id", F.col("round_id").cast("int").alias("round_id"), "decision_loss", "complete").write.parquet(path)
    return _finish(st.stream_round_health(t.spark.readStream.schema(schemas.ROUND_LOSS).parquet(path)), t)


register(
    "stream_round_health",
    _health,
    "SELECT section_id, round_id, round(decision_loss, 6) AS decision_loss, round(best, 6) AS best_eval_loss, best_round AS best_round_id, "
    "streak AS bad_round_streak, override AS base_override_round, action FROM health",
)


def _ordered_health(t: Tables) -> DataFrame:
    """Rounds that arrive up to two days late and out of order; a last one of a section of its own moves the watermark on."""
    source = scratch_table(t.spark, "shuffled-rounds")
    day = F.col("round_id").cast("int")
    rows = t.round_losses().select("section_id", day.alias("round_id"), "decision_loss", "complete", F.timestamp_seconds((day + 1000) * 86400).alias("ts"))
    rows = settle(rows.withColumn("day", day + F.pmod(F.crc32(F.concat("section_id", day).cast("binary")), F.lit(3))))
    for k in [r[0] for r in rows.select(F.floor(F.col("day") / 4).alias("k")).distinct().orderBy("k").collect()]:
        rows.where(F.floor(F.col("day") / 4) == k).drop("day").coalesce(1).write.mode("append").parquet(source)
    t.spark.range(1).select(
        F.lit("the last").alias("section_id"), F.lit(0).alias("round_id"), F.lit(1.0).alias("decision_loss"), F.lit(True).alias("complete"), F.timestamp_seconds(F.lit(86400 * 1400)).alias("ts")
    ).write.mode("append").parquet(source)
    arriving = t.spark.readStream.schema(schemas.ROUND_LOSS + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    name, before = "spark.sql.streaming.stateStore.providerClass", t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set(name, st.ROCKS)
    try:
        return _finish(st.stream_ordered_health(arriving), t).where("section_id <> 'the last'")
    finally:
        t.spark.conf.set(name, before)


register(
    "stream_ordered_health",
    _ordered_health,
    "SELECT section_id, round_id, round(decision_loss, 6) AS decision_loss, round(best, 6) AS best_eval_loss, best_round AS best_round_id, "
    "streak AS bad_round_streak, override AS base_override_round, action FROM health",
)


def _vault(t: Tables) -> DataFrame:
    """The last round of every section arrives in two micro-batches; the snapshot before it is three rounds older."""
    source, ledger, vault = (scratch_table(t.spark, n) for n in ("source", "ledger", "vault"))
    names, last = schemas.columns(schemas.LEDGER), t.rounds()
    rows = t.ledger().join(last, "section_id")
    write_ledger(rows.where("round_id < current_round").select(*names), ledger)
    write_vault(t.vault().join(last, "section_id").withColumn("round_id", F.col("current_round") - 3), vault)
    again = t.recycled_evaluations().withColumn("ledger_id", F.col("slot_id"))
    missing = {c: F.lit("") for c in names if c not in again.columns}
    new = rows.where("round_id = current_round and source <> 'recycled'").select(*names).unionByName(again.withColumns(missing).select(*names))
    half = F.col("ledger_id") % 2
    for part in (half == 0, half == 1):
        new.where(part).coalesce(1).write.mode("append").parquet(source)
    arriving = t.spark.readStream.schema(schemas.LEDGER).option("maxFilesPerTrigger", 1).parquet(source)
    st.stream_vault(arriving, ledger, vault, vault + "-log").awaitTermination()
    return read_vault(t.spark, vault).join(last.withColumnRenamed("current_round", "round_id"), ["section_id", "round_id"]).select(*schemas.columns(schemas.VAULT))


register("stream_vault", _vault, f"SELECT {VAULT_SQL} FROM new_vault")


def _score(batch: DataFrame) -> DataFrame:
    """Loss and length from the text alone, so that runs can be repeated."""
    return batch.withColumn("token_length", F.length("sample")).withColumn(
        "loss", F.pmod(F.xxhash64("sample", "instruct", "round_id"), F.lit(4000)) / 1000
    )


def _loop(t: Tables) -> DataFrame:
    """Three rounds for every section, filled from all documents."""
    pool = t.documents().select(
        section_of(F.col("doc_id")).alias("section_id"), F.col("doc_id").alias("sample_id"), F.concat("lang", F.lit("_"), "source").alias("tag"),
        F.col("n_chars").cast("double").alias("score"), F.col("text").alias("sample"), F.lit("Summarize the text.").alias("instruct"),
        F.coalesce("lang", F.lit("none")).alias("gold_summary"),
    )
    sections = t.documents().select(section_of(F.col("doc_id")).alias("section_id")).distinct()
    losses = sections.withColumn("round_id", F.explode(F.array(*(F.lit(k) for k in range(3))))).select("section_id", "round_id", (2.0 + F.col("round_id") / 10).alias("validation_loss"))
    tables = run_rounds(t.spark, scratch_table(t.spark, "loop"), pool, _score, 3, validation=losses)
    ledger = tables.upto("ledger", 3, schemas.LEDGER)
    return ledger.groupBy("section_id", "round_id").agg(
        F.count("*").alias("records"), F.count_if(F.col("source") == "recycled").alias("recycled"), F.avg("loss").alias("avg_loss")
    )


register("run_rounds", _loop)


# --- state carried from round to round --------------------------------------------------------


def _rolled(t: Tables, rows: DataFrame, schema: str, step) -> DataFrame:
    """The new rows of a state that takes one round after the other."""
    rows = settle(rows)
    state, out = t.spark.createDataFrame([], schema), None
    for k in [r[0] for r in rows.select("round_id").distinct().orderBy("round_id").collect()]:
        state = settle(step(state, rows.where(F.col("round_id") == k)))
        now = sm.last_round(state).where(F.col("round_id") == k)
        out = now if out is None else out.unionByName(now)
    return out


def _rolled_metrics(t: Tables) -> DataFrame:
    """Sums over the ledger added up in five parts, and what they say about tags and sections."""
    ledger = t.ledger()
    tags, sections = t.spark.createDataFrame([], sm.TAG_SUMS), t.spark.createDataFrame([], sm.SECTION_SUMS)
    for k in range(5):
        part = ledger.where(F.col("round_id") % 5 == k)
        tags, sections = settle(sm.add_tag_sums(tags, part)), settle(sm.add_section_sums(sections, part))
    rows = sm.counts_of(tags).withColumnRenamed("n", "records").join(sm.metrics_of(tags), ["section_id", "tag"], "left")
    declared = sm.declared_of(tags).withColumnRenamed("n", "declared")
    return rows.join(declared, ["section_id", "tag"], "left").join(sections.select("section_id", "last_ledger_id", "last_round"), "section_id")


register(
    "rolled_metrics",
    _rolled_metrics,
    """SELECT l.section_id, l.tag, count(*) AS records, any_value(round(m.avg_loss, 6)) AS avg_loss, any_value(m.n) AS n, any_value(m.oldest_ledger_id) AS oldest_ledger_id,
         nullif(count(*) FILTER (WHERE coalesce(l.source, 'generated') = 'generated'), 0) AS declared, any_value(s.last) AS last_ledger_id, any_value(s.r) AS last_round
       FROM ledger l LEFT JOIN metrics m USING (section_id, tag) JOIN (SELECT section_id, max(ledger_id) AS last, CAST(max(round_id) AS INTEGER) AS r FROM ledger GROUP BY 1) s USING (section_id) GROUP BY 1, 2""",
)
register(
    "rolled_health",
    lambda t: _rolled(t, t.round_losses().withColumn("round_id", F.col("round_id").cast("int")), sm.HEALTH_STATE, sm.health_step).where("action is not null").drop("complete", "events"),
    "SELECT section_id, round_id, round(decision_loss, 6) AS decision_loss, round(best, 6) AS best_eval_loss, best_round AS best_round_id, "
    "streak AS bad_round_streak, override AS base_override_round, action FROM health",
)
register(
    "rolled_pressure",
    lambda t: _rolled(t, pressure_scores(t), sm.PRESSURE_STATE, sm.pressure_step).select("section_id", "round_id", "score", "candidate", "hits", "hard_active", "cooldown_until"),
    "SELECT section_id, round_id, round(score, 6) AS score, candidate, hits, hard_active, cooldown_until FROM pressure",
)


def _generate(requests: DataFrame) -> DataFrame:
    """Every slot gets a tag of its own; batches leave slots out, and some slots are only answered the third time, or never."""
    def one(slot):
        text = F.concat(F.lit("sample "), slot, F.lit(" of "), "section_id", F.lit(" "), "round_id")
        tag = F.when(slot == 1, "contextual_qa").otherwise(F.concat(F.lit("kind_"), "round_id", F.lit("_"), slot))
        row = F.struct(slot.alias("slot_id"), text.alias("sample"), F.lit("Do it.").alias("instruct"), F.lit("done").alias("gold_summary"), tag.alias("tag"))
        return F.to_json(row)

    slots = F.filter(F.from_json("prompt", "array<struct<slot_id: int>>"), lambda s: s["slot_id"] % 3 != 0)
    listed = F.concat(F.lit("["), F.array_join(F.transform(slots, lambda s: one(s["slot_id"])), ","), F.lit("]"))
    silent = (F.col("slot_id") == 9) | ((F.col("slot_id") == 3) & (F.col("attempt") == 1))
    single = F.when(silent, "no").otherwise(one(F.col("slot_id")))
    return requests.withColumn("response", F.when(F.col("attempt") == 0, listed).otherwise(single))


def _generated(t: Tables) -> DataFrame:
    """A round with an outside generator: how many slots each attempt filled, and which stay open."""
    batch = lambda df: df.withColumn("token_length", F.length("sample")).withColumn("loss", F.lit(1.0) + F.col("slot_id") / 10)
    tables, _ = run_generated(t.spark, scratch_table(t.spark, "generated"), settle(t.examples()), batch, 1, _generate)
    rows = tables.at("ledger", 1, schemas.LEDGER).select("section_id", "round_id", F.lit("filled").alias("what"))
    problems = tables.at("batch_problems", 1, "section_id string, round_id int, slot_id int, reason string").where("slot_id is not null")
    rows = rows.unionByName(problems.select("section_id", "round_id", F.concat(F.lit("open "), "reason").alias("what")))
    for k in range(3):
        judged = tables.at(f"attempts_{k}", 1, "section_id string, round_id int, status string")
        rows = rows.unionByName(judged.select("section_id", "round_id", F.concat(F.lit(f"{k} "), "status").alias("what")))
    return rows.groupBy("section_id", "round_id", "what").agg(F.count("*").alias("n"))


register(
    "run_generated",
    _generated,
    """SELECT section_id, v.round_id, v.what, v.n::BIGINT AS n FROM (SELECT DISTINCT section_id FROM examples) e, (VALUES
         (0, 'filled', 9), (0, 'open invalid_json', 1), (0, '0 accepted', 7), (0, '0 missing', 3), (0, '1 accepted', 1), (0, '1 missing', 2), (0, '2 accepted', 1), (0, '2 missing', 1) ) v(round_id, what, n)""",
)
