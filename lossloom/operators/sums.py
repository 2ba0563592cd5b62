"""What a round leaves behind for the next one, so that no step reads more than the step before it.

``tag_sums`` and ``section_sums`` merge by adding; ``health_step`` and ``pressure_step`` carry their state in the last few rounds of a
section. Each gives what the operator over the whole history gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossloom.functions import text as tx
from lossloom.params import DEFAULTS, Params

TAG_SUMS = "section_id string, tag string, records bigint, declared bigint, generated bigint, loss_sum double, oldest_ledger_id bigint"
SECTION_SUMS = "section_id string, last_ledger_id bigint, last_round int, records bigint"
_HEALTH = (
    "struct<round_id: int, decision_loss: double, complete: boolean, action: string, events: bigint, best_eval_loss: double, "
    "best_round_id: int, bad_round_streak: int, base_override_round: int>"
)
_PRESSURE = "struct<round_id: int, score: double, candidate: boolean, hits: bigint, hard_active: boolean, cooldown_until: int>"
HEALTH_STATE = f"section_id string, rounds array<{_HEALTH}>"
PRESSURE_STATE = f"section_id string, rounds array<{_PRESSURE}>"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


# --- sums -------------------------------------------------------------------------------------


def tag_sums(rows: DataFrame) -> DataFrame:
    """Per section and tag of ledger rows: all, those declared generated, and losses of those not recycled."""
    source = F.col("source")
    generated = ~source.eqNullSafe("recycled")
    return rows.groupBy("section_id", "tag").agg(
        F.count("*").alias("records"), F.count_if(F.coalesce(source, F.lit("generated")) == "generated").alias("declared"),
        F.count_if(generated).alias("generated"), F.sum(F.when(generated, F.col("loss"))).alias("loss_sum"),
        F.min(F.when(generated, F.col("ledger_id"))).alias("oldest_ledger_id"),
    )


def add_tag_sums(before: DataFrame, rows: DataFrame) -> DataFrame:
    """The sums with those of new ledger rows added; as long as the tag vocabulary, whatever the number of rows."""
    both = before.unionByName(tag_sums(rows)).groupBy("section_id", "tag")
    add = {c: F.sum(c).alias(c) for c in ("records", "declared", "generated", "loss_sum")}
    return both.agg(*add.values(), F.min("oldest_ledger_id").alias("oldest_ledger_id")).select(*_names(TAG_SUMS))


def add_section_sums(before: DataFrame, rows: DataFrame) -> DataFrame:
    """Highest ledger id, last round and number of records per section."""
    new = rows.groupBy("section_id").agg(
        F.max("ledger_id").alias("last_ledger_id"), F.max("round_id").alias("last_round"), F.count("*").alias("records")
    )
    return before.unionByName(new).groupBy("section_id").agg(
        F.max("last_ledger_id").alias("last_ledger_id"), F.max("last_round").alias("last_round"), F.sum("records").alias("records")
    )


def counts_of(sums: DataFrame) -> DataFrame:
    """Tag counts, as from the ledger."""
    return sums.where(tx.blank_to_null("tag").isNotNull()).select("section_id", "tag", F.col("records").alias("n"))


def declared_of(sums: DataFrame) -> DataFrame:
    """Rows declared generated per metric tag, for the shape gap."""
    return sums.where(tx.is_metric_tag("tag") & (F.col("declared") > 0)).select("section_id", "tag", F.col("declared").alias("n"))


def metrics_of(sums: DataFrame) -> DataFrame:
    """Loss metrics per tag, as from the ledger."""
    return sums.where(tx.is_metric_tag("tag") & (F.col("generated") > 0)).select(
        "section_id", "tag", (F.col("loss_sum") / F.col("generated")).alias("avg_loss"), F.col("generated").alias("n"), "oldest_ledger_id"
    )


# --- state of a few rounds --------------------------------------------------------------------


def _pushed(rounds: Column, new: Column, kind: str, keep: int) -> Column:
    """An array of rounds with a new one behind it, cut to the last few."""
    both = F.concat(F.coalesce(rounds, F.array().cast(f"array<{kind}>")), F.array(new.cast(kind)))
    return F.slice(both, F.greatest(F.lit(1), F.size(both) - keep + 1), keep)


def last_round(state: DataFrame) -> DataFrame:
    """The last round of every section as columns."""
    return state.select("section_id", F.element_at("rounds", -1).alias("_last")).select("section_id", "_last.*")


def health_step(before: DataFrame, rounds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The state after one more round: ``rounds`` has ``section_id, round_id, decision_loss, complete`` of the new round.

    A state row holds a section's last rounds, each with the state after it: as many as rollback and plateau look back. A
    section without a new round keeps its row; a round without a loss only passes the state on. One join by section.
    """
    new = rounds.select("section_id", F.col("round_id").cast("int").alias("_round"), F.col("decision_loss").alias("_loss"), F.col("complete").alias("_whole"))
    rows = before.join(new, "section_id", "full_outer")
    back = F.filter("rounds", lambda r: r["complete"] & r["round_id"].between(F.col("_round") - p.rollback_lookback, F.col("_round") - 1))
    rows = rows.withColumn("_back", back).withColumn("_state", F.when(F.size("rounds") > 0, F.element_at("rounds", -1)))
    scored = F.array_min(F.transform(F.filter("_back", lambda r: r["decision_loss"].isNotNull()), lambda r: F.struct(r["decision_loss"].alias("l"), (-r["round_id"]).alias("r"))))
    rows = rows.withColumn("_target", F.coalesce(-scored["r"], F.array_max(F.transform("_back", lambda r: r["round_id"]))))
    loss, best = F.col("_loss"), F.col("_state.best_eval_loss")
    held = F.coalesce("_state.bad_round_streak", F.lit(0))
    action = (
        F.when(loss.isNull(), F.lit(None).cast("string"))
        .when(best.isNull() | (loss < best * (1.0 - p.health_min_delta)), "new_best")
        .when(~(loss > best * (1.0 + p.health_min_delta)), "stable")
        .when(held + 1 < p.health_patience, "degraded")
        .when(F.col("_target").isNull(), "rollback_unavailable")
        .otherwise("rollback_next")
    )
    rows = rows.withColumn("_action", action)
    gained, rolled = F.coalesce(F.col("_action") == "new_best", F.lit(False)), F.coalesce(F.col("_action") == "rollback_next", F.lit(False))
    worse = F.col("_action").isin("degraded", "rollback_unavailable")
    after = F.struct(
        F.col("_round").alias("round_id"), loss.alias("decision_loss"), F.col("_whole").alias("complete"), F.col("_action").alias("action"),
        (F.coalesce("_state.events", F.lit(0)) + F.when(loss.isNull(), 0).otherwise(1)).alias("events"),
        F.when(gained, loss).otherwise(best).alias("best_eval_loss"),
        F.when(gained, F.col("_round")).otherwise(F.col("_state.best_round_id")).alias("best_round_id"),
        F.when(worse, held + 1).when(F.col("_action").isNotNull(), 0).otherwise(held).alias("bad_round_streak"),
        F.when(gained, F.lit(None)).when(rolled, F.col("_target")).otherwise(F.col("_state.base_override_round")).alias("base_override_round"),
    )
    kept = F.when(F.col("_round").isNull(), F.col("rounds")).otherwise(_pushed(F.col("rounds"), after, _HEALTH, max(p.rollback_lookback, 3) + 1))
    return rows.select("section_id", kept.alias("rounds"))


def health_now(state: DataFrame) -> DataFrame:
    """Of every section's last scored round: action, override, improvement over the scored round before, and plateau score."""
    rows = state.withColumn("_events", F.filter("rounds", lambda r: r["action"].isNotNull())).where(F.size("_events") > 0)
    rows = rows.withColumn("_last", F.element_at("_events", -1)).withColumn("_before", F.try_element_at("_events", F.lit(-2))["decision_loss"])
    since = F.col("_last.round_id") + 1 - F.col("_last.best_round_id")
    recent = F.slice("_events", F.greatest(F.lit(1), F.size("_events") - 2), 3)
    degraded = F.size(F.filter(recent, lambda r: r["action"].isin("degraded", "rollback_next")))
    gain = F.when(F.col("_before") > 0, (F.col("_before") - F.col("_last.decision_loss")) / F.col("_before"))
    return rows.select(
        "section_id", F.col("_last.round_id").alias("round_id"), F.col("_last.action").alias("latest_action"),
        F.col("_last.base_override_round").alias("base_override_round"), gain.alias("improvement"),
        plateau(since, degraded, F.col("_last.action"), F.col("_last.events")).alias("validation_plateau"),
    )


def plateau(since: Column, degraded: Column, action: Column, events: Column) -> Column:
    score = (
        F.when(since >= 3, 0.45).otherwise(0.0) + F.when(since >= 5, 0.25).otherwise(0.0)
        + F.when(degraded >= 1, 0.25).otherwise(0.0) + F.when((action == "stable") & (since != 0), 0.10).otherwise(0.0)
    )
    return F.when(events < 2, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def complete_rounds(before: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per section the last complete round, ``section_id, last_complete``."""
    new = rounds.where("complete").groupBy("section_id").agg(F.max("round_id").alias("last_complete"))
    return before.unionByName(new).groupBy("section_id").agg(F.max("last_complete").alias("last_complete"))


def base_of(complete: DataFrame, now: DataFrame, rounds: DataFrame) -> DataFrame:
    """The checkpoint that the next round starts from: the override of the last health event, else the last complete round.

    An override was complete when it was chosen, and checkpoints do not go away, so it needs no second look.
    """
    joined = rounds.join(now.select("section_id", "base_override_round"), "section_id", "left").join(complete, "section_id", "left")
    override = F.when(F.col("current_round") > 0, F.col("base_override_round"))
    return joined.select(
        "section_id", "current_round", F.coalesce(override, "last_complete").alias("base_round"), override.isNotNull().alias("used_override")
    )


def pressure_step(before: DataFrame, scores: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Learning pressure of one more round: ``scores`` has the four components of the new round of a section.

    A state row holds a section's last ``pressure_window`` rounds; the new one is the last.
    """
    total = None
    for name in ("vault_starvation", "easy_batch", "validation_plateau", "shape_gap"):
        term = F.lit(p.pressure_weights[name]) * F.col(name)
        total = term if total is None else total + term
    new = scores.select("section_id", F.col("round_id").cast("int").alias("_round"), total.alias("_score"))
    rows = before.join(new, "section_id", "full_outer").withColumns(
        {
            "_candidate": (F.col("_round") >= p.pressure_min_round) & (F.col("_score") >= p.pressure_threshold),
            "_until": F.coalesce(F.when(F.size("rounds") > 0, F.element_at("rounds", -1)["cooldown_until"]), F.lit(-1)),
        }
    )
    recent = F.slice("rounds", F.greatest(F.lit(1), F.size("rounds") - p.pressure_window + 2), p.pressure_window - 1)
    hits = F.greatest(F.lit(0), F.size(F.filter(recent, lambda r: r["candidate"]))) + F.when(F.col("_candidate"), 1).otherwise(0)
    rows = rows.withColumn("_hits", hits)
    active = F.coalesce(F.col("_candidate") & (F.col("_hits") >= p.pressure_min_hits) & (F.col("_round") > F.col("_until")), F.lit(False))
    after = F.struct(
        F.col("_round").alias("round_id"), F.col("_score").alias("score"), F.col("_candidate").alias("candidate"), F.col("_hits").alias("hits"),
        active.alias("hard_active"), F.when(active, F.col("_round") + p.pressure_cooldown).otherwise(F.col("_until")).alias("cooldown_until"),
    )
    kept = F.when(F.col("_round").isNull(), F.col("rounds")).otherwise(_pushed(F.col("rounds"), after, _PRESSURE, p.pressure_window))
    return rows.select("section_id", kept.alias("rounds"))


def new_recycled(recipe: DataFrame, known: DataFrame) -> DataFrame:
    """Ledger ids that a recipe recycles for the first time: ``section_id, ledger_id, round_id``; ``known`` has all before."""
    used = recipe.where("command = 'recycle'").groupBy("section_id", F.col("failure_ledger_id").alias("ledger_id")).agg(F.min("round_id").alias("round_id"))
    return used.join(known.select("section_id", "ledger_id"), ["section_id", "ledger_id"], "left_anti")
