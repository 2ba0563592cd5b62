"""Roll-ups and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossloom.functions import shape as sh
from lossloom.operators.ranking import top_n
from lossloom.params import DEFAULTS, Params


def _sources() -> list[Column]:
    recycled = F.col("source").eqNullSafe("recycled")
    return [
        F.count_if(~recycled).alias("generated_records"),
        F.count_if(recycled).alias("recycled_records"),
    ]


def round_summary(ledger: DataFrame) -> DataFrame:
    """Per section and round: counts, losses and the five most frequent tags as text.

    The ledger is read once into (section, round, tag) partial sums; all else comes from those.
    """
    recycled = F.col("source").eqNullSafe("recycled")
    per_tag = ledger.groupBy("section_id", "round_id", "tag").agg(
        F.count("*").alias("n"), F.sum("loss").alias("s"), F.count("loss").alias("k"),
        F.min("loss").alias("lo"), F.max("loss").alias("hi"), F.count_if(recycled).alias("r"),
        F.min("ledger_id").alias("first_id"),
    )
    top = top_n(per_tag, ["section_id", "round_id"], [F.col("n").desc(), F.col("first_id")], 5, "_rn")
    tags = top.groupBy("section_id", "round_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_rn", "tag", "n"))),
                lambda x: F.concat(x["tag"], F.lit(":"), x["n"].cast("string")),
            ),
            "; ",
        ).alias("top_tags")
    )
    return per_tag.groupBy("section_id", "round_id").agg(
        F.sum("n").alias("records"), (F.sum("s") / F.sum("k")).alias("avg_loss"),
        F.min("lo").alias("min_loss"), F.max("hi").alias("max_loss"),
        (F.sum("n") - F.sum("r")).alias("generated_records"), F.sum("r").alias("recycled_records"),
    ).join(tags, ["section_id", "round_id"])


def tag_summary(ledger: DataFrame, *keys: str) -> DataFrame:
    return ledger.groupBy(*(keys or ("section_id",)), "tag").agg(
        F.count("*").alias("records"), F.avg("loss").alias("avg_loss"), F.max("loss").alias("max_loss"),
        *_sources(),
    )


def ledger_rollup(ledger: DataFrame) -> DataFrame:
    """Totals at section, round and tag level; ``level`` counts the keys in use.

    The ledger is read once into (section, round, tag) partial sums, and only those are rolled up.
    """
    recycled = F.col("source").eqNullSafe("recycled")
    per_tag = ledger.groupBy("section_id", "round_id", "tag").agg(
        F.count("*").alias("n"), F.sum("loss").alias("s"), F.count("loss").alias("k"), F.count_if(recycled).alias("r")
    )
    return per_tag.rollup("section_id", "round_id", "tag").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), (F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("avg_loss"),
        F.coalesce(F.sum("n") - F.sum("r"), F.lit(0)).alias("generated_records"), F.coalesce(F.sum("r"), F.lit(0)).alias("recycled_records"),
        F.grouping_id().alias("_g"),
    ).withColumn(
        "level", F.when(F.col("_g") == 0, 3).when(F.col("_g") == 1, 2).when(F.col("_g") == 3, 1).otherwise(0)
    ).drop("_g")


def eval_summary(losses: DataFrame, baseline: str, keys: tuple[str, ...] = ("eval_set",)) -> DataFrame:
    """Per evaluation set and run: batches, first/last by index, avg/min/max, gap to the baseline."""
    stats = losses.groupBy(*keys, "run").agg(
        F.count("*").alias("batches"),
        F.min_by("loss", "batch_index").alias("first_loss"),
        F.avg("loss").alias("avg_loss"),
        F.min("loss").alias("min_loss"),
        F.max("loss").alias("max_loss"),
        F.max_by("loss", "batch_index").alias("last_loss"),
    )
    return eval_vs_baseline(stats, baseline, keys)


def eval_vs_baseline(stats: DataFrame, baseline: str, keys: tuple[str, ...] = ("eval_set",)) -> DataFrame:
    base = stats.where(F.col("run") == baseline).select(*keys, F.col("avg_loss").alias("_base"))
    return stats.join(base, list(keys), "left").withColumns(
        {
            "delta_vs_baseline": F.col("avg_loss") - F.col("_base"),
            "pct_gap_vs_baseline": (F.col("avg_loss") - F.col("_base")) / F.col("_base"),
        }
    ).drop("_base")


def validation_weakness(evals: DataFrame, p: Params = DEFAULTS, classified: bool = False) -> DataFrame:
    """Weakest task shapes per section among evaluation rows with text and loss, or ``classified`` ones with shape and loss."""
    shaped = (evals if classified else sh.classify_shape(sh.coalesce_fields(evals))).groupBy("section_id", "shape_id").agg(
        F.avg("loss").alias("avg_loss"), F.max("loss").alias("max_loss"), F.count("*").alias("n")
    )
    totals = shaped.groupBy("section_id").agg(F.sum("n").alias("_total"))
    ranked = top_n(
        shaped, ["section_id"], [F.col("avg_loss").desc(), F.col("shape_id")], p.weakness_categories, "rank"
    )
    return sh.describe_shapes(ranked.join(totals, "section_id")).select(
        "section_id", "rank", F.col("focus_tag").alias("tag"), "shape_id", "avg_loss", "max_loss", "n",
        (F.col("n") / F.col("_total")).alias("share"), "input_shape", "output_shape", "reasoning_pattern",
    )


def round_trend(recipe_rounds: DataFrame, ledger: DataFrame, health: DataFrame) -> DataFrame:
    """Per round: slots by command, training and decision loss, best so far, action."""
    from lossloom.operators.health import running_best

    slots = recipe_rounds.groupBy("section_id", "round_id").agg(
        F.count_if(F.col("command") == "generate").alias("generated_slots"),
        F.count_if(F.col("command") == "recycle").alias("recycle_slots"),
    )
    training = ledger.groupBy("section_id", "round_id").agg(
        F.avg("loss").alias("training_avg_loss"), F.count("*").alias("new_ledger_records")
    )
    best = running_best(health.select("section_id", "round_id", "decision_loss", "action"))
    return (
        training.join(slots, ["section_id", "round_id"], "left")
        .join(best, ["section_id", "round_id"], "left")
        .select(
            "section_id", "round_id", "generated_slots", "recycle_slots", "training_avg_loss",
            F.col("decision_loss").alias("validation_avg_loss"), F.col("best_so_far").alias("best_validation_so_far"),
            F.col("action").alias("health_action"), "new_ledger_records",
        )
    )
