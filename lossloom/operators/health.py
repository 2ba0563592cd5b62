"""Round health: best-so-far, degradation streaks and rollback targets.

Input is one row per section and round, so windows and folds here are bounded by the number of
rounds a section has run, never by its number of records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom.functions import text as tx
from lossloom.operators.folds import fold_rounds
from lossloom.params import DEFAULTS, Params


def _by_round():
    return Window.partitionBy("section_id").orderBy("round_id")


def round_losses(ledger: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """Decision loss per section and round: the validation loss where there is one, else the average finite training loss.

    ``validation``: ``section_id, round_id, validation_loss``; of several finite losses of a round the average counts.
    """
    trained = (
        ledger.where(tx.is_finite("loss"))
        .groupBy("section_id", "round_id")
        .agg(F.avg("loss").alias("decision_loss"))
    )
    if validation is None:
        return trained
    valid = (
        validation.where(tx.is_finite("validation_loss"))
        .groupBy("section_id", F.col("round_id").cast("int").alias("round_id"))
        .agg(F.avg(tx.finite_or_null("validation_loss")).alias("_valid"))
    )
    return trained.join(valid, ["section_id", "round_id"], "left").select(
        "section_id", "round_id", F.coalesce("_valid", "decision_loss").alias("decision_loss")
    )


def running_best(rounds: DataFrame, loss: str = "decision_loss") -> DataFrame:
    """Smallest loss so far and the round it was first seen in."""
    upto = _by_round().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rounds.withColumns(
        {
            "best_so_far": F.min(loss).over(upto),
            "best_so_far_round": F.min(
                F.when(F.col(loss).isNotNull(), F.struct(F.col(loss), F.col("round_id")))
            ).over(upto)["round_id"],
        }
    )


def improvement(rounds: DataFrame, loss: str = "decision_loss") -> DataFrame:
    """Relative gain over the previous scored round; null without a positive previous loss."""
    prev = F.lag(loss).over(_by_round())
    return rounds.where(F.col(loss).isNotNull()).withColumn(
        "improvement", F.when(prev > 0, (prev - F.col(loss)) / prev)
    )


def rollback_target(rounds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Best complete round within the lookback of every round.

    The lowest loss wins, the later round on ties; without any scored round, the latest complete
    one. A range frame over rounds does the lookback join.
    """
    back = _by_round().rangeBetween(-p.rollback_lookback, -1)
    scored = F.min(
        F.when(
            F.col("complete") & F.col("decision_loss").isNotNull(),
            F.struct(F.col("decision_loss").alias("l"), (-F.col("round_id")).alias("r")),
        )
    ).over(back)
    latest = F.max(F.when(F.col("complete"), F.col("round_id"))).over(back)
    return (
        rounds.withColumn("_s", scored)
        .withColumn("_f", latest)
        .withColumns(
            {
                "target_round": F.coalesce(-F.col("_s.r"), F.col("_f")),
                "target_loss": F.col("_s.l"),
            }
        )
        .drop("_s", "_f")
    )


def judge_round(state: tuple, round_id: int, loss: float, target: int | None, p: Params) -> tuple[tuple, str]:
    """State (best loss, its round, bad streak, override) after a scored round, and the action it calls for."""
    best, best_round, streak, override = state
    if best is None or loss < best * (1.0 - p.health_min_delta):
        return (loss, round_id, 0, None), "new_best"
    if not loss > best * (1.0 + p.health_min_delta):
        return (best, best_round, 0, override), "stable"
    streak += 1
    if streak < p.health_patience:
        return (best, best_round, streak, override), "degraded"
    if target is None:
        return (best, best_round, streak, override), "rollback_unavailable"
    return (best, best_round, 0, target), "rollback_next"


_EVENT = (
    "decision_loss double, previous_best_loss double, previous_raw_best_loss double, best_eval_loss double, best_round_id int, "
    "raw_best_eval_loss double, raw_best_round_id int, bad_round_streak int, base_override_round int, rollback_round int, action string"
)


def round_health(rounds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Action per round from an ordered fold: best loss, bad streak and rollback override.

    The best loss moves only on a material gain, so each step needs the state before it. The
    rollback target does not depend on that state and is found beforehand by a window.
    """

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        judged, raw, raw_round = state
        loss, target = float(row.loss), None if pd.isna(row.target) else int(row.target)
        after, action = judge_round(judged, int(row.round_id), loss, target, p)
        lower = raw is None or loss < raw
        raw_after = (loss, int(row.round_id)) if lower else (raw, raw_round)
        best, best_round, streak, override = after
        rolled = target if action == "rollback_next" else None
        return (after, *raw_after), (loss, judged[0], raw, best, best_round, *raw_after, streak, override, rolled, action)

    steps = (
        rollback_target(rounds, p)
        .where(F.col("decision_loss").isNotNull())
        .select(
            "section_id", F.col("round_id").cast("int").alias("round_id"), F.col("decision_loss").alias("loss"),
            F.col("target_round").cast("int").alias("target"),
        )
    )
    return fold_rounds(steps, step, ((None, None, 0, None), None, None), _EVENT)


def latest_health(health: DataFrame) -> DataFrame:
    """Last health event of every section."""
    last = health.groupBy("section_id").agg(F.max("round_id").alias("round_id"))
    return health.join(last, ["section_id", "round_id"])


def plateau_score(health: DataFrame) -> DataFrame:
    """Validation-plateau score as it stood after each health event."""
    recent = _by_round().rowsBetween(-2, Window.currentRow)
    since = F.col("round_id") + 1 - F.col("best_round_id")
    degraded = F.count_if(F.col("action").isin("degraded", "rollback_next")).over(recent)
    score = (
        F.when(since >= 3, 0.45).otherwise(0.0)
        + F.when(since >= 5, 0.25).otherwise(0.0)
        + F.when(degraded >= 1, 0.25).otherwise(0.0)
        + F.when((F.col("action") == "stable") & (since != 0), 0.10).otherwise(0.0)
    )
    seen = F.row_number().over(_by_round())
    return health.select(
        "section_id", "round_id", since.alias("rounds_since_best"), degraded.alias("recent_degraded"),
        F.when(seen < 2, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score)).alias("validation_plateau"),
    )


def base_checkpoint(checkpoints: DataFrame, state: DataFrame) -> DataFrame:
    """Checkpoint the next round starts from: a complete override, else the latest complete round."""
    joined = state.select("section_id", "current_round", "base_override_round").join(
        checkpoints.where(F.col("complete")).select("section_id", "round_id"), "section_id", "left"
    )
    return joined.groupBy("section_id", "current_round", "base_override_round").agg(
        F.max(F.when(F.col("round_id") == F.col("base_override_round"), F.col("round_id"))).alias("_o"),
        F.max(F.when(F.col("round_id") < F.col("current_round"), F.col("round_id"))).alias("_l"),
    ).select(
        "section_id", "current_round",
        F.coalesce(F.when(F.col("current_round") > 0, F.col("_o")), F.col("_l")).alias("base_round"),
        (F.coalesce(F.when(F.col("current_round") > 0, F.col("_o")).isNotNull(), F.lit(False))).alias("used_override"),
    )
