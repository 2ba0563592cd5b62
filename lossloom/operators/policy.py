"""From ledger, vault and health to the next recipe of every section.

Once metrics are cut to the handful of tags and rows a recipe can use, the rest runs on arrays of at
most ``batch_size`` elements in one row per section: no further shuffles, and sums are taken in a
fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom import fixed_values as fx
from lossloom import schemas
from lossloom.functions import text as tx
from lossloom.operators import vault as vt
from lossloom.operators.ledger import declared_generated, generated_only, ordered_union
from lossloom.operators.ranking import percentile_nr, top_n
from lossloom.operators.folds import fold_rounds
from lossloom.params import DEFAULTS, Params

_STRINGS = "array<string>"


# --- tag metrics ------------------------------------------------------------------------------


def _metrics(df: DataFrame) -> DataFrame:
    return df.where(tx.is_metric_tag("tag")).groupBy("section_id", "tag").agg(
        F.avg("loss").alias("avg_loss"),
        F.count("*").alias("n"),
        F.min("ledger_id").alias("oldest_ledger_id"),
    )


def per_tag_loss(ledger: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """Loss metrics per tag over generated rows; sections without any fall back to their vault."""
    exact = _metrics(generated_only(ledger))
    return exact if vault is None else with_vault_metrics(exact, vault)


def with_vault_metrics(exact: DataFrame, vault: DataFrame) -> DataFrame:
    """Metrics with those of the vault for sections that have none."""
    return exact.unionByName(
        _metrics(vault).join(exact.select("section_id").distinct(), "section_id", "left_anti")
    )


def apply_tag_groups(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """Replace exact metrics by a supplied grouping ``(section_id, tag, avg_loss, source_tags)``.

    Sections without a grouping keep their exact metrics. The count is the number of source tags.
    """
    exact = metrics.select(
        "section_id", F.col("tag").alias("source_tag"), F.col("oldest_ledger_id").alias("_oldest")
    )
    named = groups.where(~tx.is_blank("tag")).withColumn("tag", tx.strip("tag"))
    tags = F.filter(
        F.transform(F.col("source_tags"), lambda t: tx.strip(t)), lambda t: t != ""
    )
    listed = F.col("source_tags").isNotNull()
    parts = named.withColumn("_tags", F.when(listed, tags).otherwise(F.array("tag")))
    grouped = (
        parts.withColumn("source_tag", F.explode_outer("_tags"))
        .join(exact, ["section_id", "source_tag"], "left")
        .groupBy("section_id", "tag", "avg_loss")
        .agg(
            F.greatest(F.lit(1), F.count("source_tag")).alias("n"),
            F.coalesce(F.min("_oldest"), F.lit(0)).cast("bigint").alias("oldest_ledger_id"),
        )
    )
    return metrics.join(named.select("section_id").distinct(), "section_id", "left_anti").unionByName(
        grouped.select(*metrics.columns)
    )


def _metric_order() -> list[Column]:
    return [
        F.col("avg_loss").desc(),
        F.coalesce(F.nullif("oldest_ledger_id", F.lit(0)), F.lit(10**12)),
        F.col("n").desc(),
        F.col("tag"),
    ]


def order_metrics(metrics: DataFrame) -> DataFrame:
    """Rank tags per section: highest loss first, then the oldest, then the most frequent."""
    w = Window.partitionBy("section_id").orderBy(*_metric_order())
    return metrics.withColumn("metric_rank", F.row_number().over(w))


# --- slot allocation and tag plan -------------------------------------------------------------


def allocate_slots(metrics: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Share the focused slots among the worst tags by largest remainder.

    Every tag gets one slot, the rest follow the loss share; what is left goes to the largest
    remainders (then higher loss, then tag, all descending). One row per section and tag.
    """
    n_slots = p.focused_slots()
    usable = metrics.where(
        tx.is_metric_tag(tx.strip("tag")) & ~tx.is_exploration("tag")
    )
    top = top_n(usable, ["section_id"], _metric_order(), n_slots, "metric_rank")
    rows = top.groupBy("section_id").agg(
        F.array_sort(F.collect_list(F.struct("metric_rank", "tag", "avg_loss"))).alias("m")
    )
    add = lambda a, x: a + x
    rest = F.lit(n_slots) - F.size("m")
    shared = rows.withColumn(
        "_total", F.aggregate(F.transform("m", lambda x: x["avg_loss"]), F.lit(0.0), add)
    ).withColumn(
        "_raw",
        F.when(
            (rest > 0) & (F.col("_total") > 0),
            F.transform("m", lambda x: x["avg_loss"] / F.col("_total") * rest),
        ).otherwise(F.transform("m", lambda x: F.lit(0.0))),
    )
    whole = F.aggregate(F.transform("_raw", lambda r: F.floor(r).cast("int")), F.lit(0), add)
    remainders = F.reverse(
        F.array_sort(
            F.zip_with(
                "m", "_raw",
                lambda x, r: F.struct(
                    (r - F.floor(r)).alias("frac"), x["avg_loss"].alias("l"), x["tag"].alias("t"),
                    x["metric_rank"].alias("rank"),
                ),
            )
        )
    )
    lucky = F.when(
        (rest > 0) & (F.col("_total") > 0),
        F.transform(F.slice(remainders, F.lit(1), rest - whole), lambda x: x["rank"]),
    ).otherwise(F.array().cast("array<int>"))
    return (
        shared.withColumn("_lucky", lucky)
        .select(
            "section_id",
            F.explode(
                F.zip_with(
                    "m", "_raw",
                    lambda x, r: F.struct(
                        x["metric_rank"].alias("metric_rank"),
                        x["tag"].alias("tag"),
                        x["avg_loss"].alias("avg_loss"),
                        (
                            1 + F.floor(r).cast("int")
                            + F.array_contains("_lucky", x["metric_rank"]).cast("int")
                        ).alias("slots"),
                    ),
                )
            ).alias("x"),
        )
        .select("section_id", "x.*")
    )


def cycle_to(tags: Column, n: int | Column) -> Column:
    """Repeat an array round-robin to length ``n``; empty stays empty."""
    size = F.lit(n) if isinstance(n, int) else n
    filled = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.element_at(tags, i % F.size(tags) + 1))
    return F.when((F.size(tags) > 0) & (size > 0), filled).otherwise(F.array().cast(_STRINGS))


def fallback_tags(counts: DataFrame, p: Params = DEFAULTS, n: int | None = None) -> DataFrame:
    """Most counted tags per section as an array; equal counts go by tag name."""
    usable = counts.where(tx.is_metric_tag("tag") & ~tx.is_exploration("tag"))
    ranked = top_n(
        usable, ["section_id"], [F.col("n").desc(), F.col("tag")], n or p.focused_slots(), "_rn"
    )
    return ranked.groupBy("section_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rn", "tag"))), lambda x: x["tag"]
        ).alias("fallback")
    )


def tag_plan(
    sections: DataFrame, allocations: DataFrame, counts: DataFrame | None = None, p: Params = DEFAULTS
) -> DataFrame:
    """Array ``plan`` of ``batch_size`` tags per section, exploration slots first."""
    n_slots = p.focused_slots()
    defaults = F.array(*[F.lit(t) for t in p.default_tags]).cast(_STRINGS)
    focus = allocations.groupBy("section_id").agg(
        F.array_sort(F.collect_list(F.struct("metric_rank", "tag", "slots"))).alias("a")
    ).select(
        "section_id",
        F.transform("a", lambda x: x["tag"]).alias("_tags"),
        F.flatten(F.transform("a", lambda x: F.array_repeat(x["tag"], x["slots"]))).alias("_focus"),
    )
    joined = sections.select("section_id").join(focus, "section_id", "left")
    if counts is None:
        joined = joined.withColumn("fallback", defaults)
    else:
        joined = joined.join(fallback_tags(counts, p), "section_id", "left").withColumn(
            "fallback", F.coalesce("fallback", defaults)
        )
    pad = F.when(F.size("fallback") > 0, F.col("fallback")).otherwise(F.col("_tags"))
    focused = F.when(F.col("_focus").isNull(), cycle_to(F.col("fallback"), n_slots)).otherwise(
        F.slice(F.concat("_focus", cycle_to(pad, n_slots)), 1, n_slots)
    )
    open_tag = F.lit(fx.WIDE_VARIETY)
    return joined.withColumn("_f", focused).select(
        "section_id",
        F.when(F.size("_f") == 0, F.array_repeat(open_tag, p.batch_size))
        .otherwise(F.concat(F.array_repeat(open_tag, p.exploration_slots()), "_f"))
        .alias("plan"),
    )


def explode_plan(plan: DataFrame) -> DataFrame:
    return plan.select("section_id", F.posexplode("plan").alias("i", "tag")).select(
        "section_id", (F.col("i") + 1).alias("slot_id"), "tag"
    )


# --- learning pressure ------------------------------------------------------------------------


def starvation_score(vault: DataFrame, rounds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """How short a section's vault is of rows worth recycling."""
    usable = vt.recyclable(vault, rounds, p).groupBy("section_id").agg(
        F.count("*").alias("usable_count"), F.avg("loss").alias("usable_avg_loss")
    )
    n = F.col("usable_count")
    return (
        rounds.select("section_id", "current_round")
        .join(usable, "section_id", "left")
        .withColumn("usable_count", F.coalesce("usable_count", F.lit(0)))
        .withColumn(
            "vault_starvation",
            F.when(F.col("current_round") == 0, 0.0)
            .when(n == 0, 1.0)
            .when(n < p.starvation_usable_target, 0.85)
            .when(F.col("usable_avg_loss") < p.starvation_easy_loss, 0.65)
            .otherwise(0.0),
        )
        .drop("current_round")
    )


def easy_batch_score(records: DataFrame, *keys: str, p: Params = DEFAULTS) -> DataFrame:
    """How easy a batch was, from average, 75th percentile and maximum loss per key."""
    keys = list(keys) or ["section_id"]
    rows = declared_generated(records).where(F.col("loss").isNotNull()).select(*keys, "loss")
    p75 = percentile_nr(rows, keys, "loss", 0.75, "p75_loss")
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("record_count"), F.avg("loss").alias("avg_loss"), F.max("loss").alias("max_loss")
    )
    score = (
        F.when(F.col("avg_loss") < p.easy_avg_loss, 0.45).otherwise(0.0)
        + F.when(F.col("p75_loss") < p.easy_p75_loss, 0.35).otherwise(0.0)
        + F.when(F.col("max_loss") < p.easy_max_loss, 0.20).otherwise(0.0)
    )
    return stats.join(p75, keys).withColumn("easy_batch", F.least(F.lit(1.0), score))


def shape_gap_score(ledger: DataFrame, profiles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """How rare the target shape is among generated rows.

    ``profiles`` holds ``section_id, shape_id, confidence, tag_aliases``. Rows are first counted per
    (section, tag); aliases are then looked up in that small table.
    """
    per_tag = (
        declared_generated(ledger)
        .where(tx.is_metric_tag("tag"))
        .groupBy("section_id", "tag")
        .agg(F.count("*").alias("n"))
    )
    return shape_gap_of_counts(per_tag, profiles, p)


def shape_gap_of_counts(per_tag: DataFrame, profiles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """:func:`shape_gap_score` from ``section_id, tag, n``."""
    matched = per_tag.join(profiles.select("section_id", "tag_aliases"), "section_id").groupBy(
        "section_id"
    ).agg(
        F.sum("n").alias("total"),
        F.sum(
            F.when(F.array_contains("tag_aliases", tx.normalize_tag("tag")), F.col("n")).otherwise(0)
        ).alias("matching"),
    )
    share = F.col("matching") / F.col("total")
    score = (
        F.when((F.coalesce(F.col("confidence"), F.lit(0.0)) < p.shape_min_confidence), 0.0)
        .when(tx.blank_to_null("shape_id").isNull(), 0.0)
        .when(F.coalesce(F.col("total"), F.lit(0)) == 0, 0.55)
        .when(share < p.shape_low_share, F.least(F.lit(1.0), 0.55 + F.col("confidence") * 0.45))
        .when(share < p.shape_low_share * 1.75, 0.45)
        .otherwise(0.0)
    )
    return profiles.join(matched, "section_id", "left").select(
        "section_id", "shape_id", "confidence",
        F.coalesce("total", F.lit(0)).alias("generated_count"),
        F.coalesce("matching", F.lit(0)).alias("matching_count"),
        F.coalesce(F.when(F.col("total") > 0, share), F.lit(0.0)).alias("matching_share"),
        score.alias("shape_gap"),
    )


def learning_pressure(scores: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Weighted pressure per round and whether hard generation is on.

    ``scores`` has one row per section and round with the four component columns. The candidate
    test and its recent hits are windows; only the cooldown feeds back on itself and is folded.
    """
    w = p.pressure_weights
    total = None
    for name in ("vault_starvation", "easy_batch", "validation_plateau", "shape_gap"):
        term = F.lit(w[name]) * F.col(name)
        total = term if total is None else total + term
    by_round = Window.partitionBy("section_id").orderBy("round_id")
    recent = by_round.rowsBetween(-(p.pressure_window - 1), Window.currentRow)
    judged = (
        scores.withColumn("score", total)
        .withColumn(
            "candidate",
            (F.col("round_id") >= p.pressure_min_round) & (F.col("score") >= p.pressure_threshold),
        )
        .withColumn("hits", F.count_if("candidate").over(recent))
    )

    def step(until: int, row) -> tuple[int, tuple]:
        active = bool(row.ready) and row.round_id > until
        until = int(row.round_id) + p.pressure_cooldown if active else until
        return until, (active, until)

    ready = F.coalesce(F.col("candidate") & (F.col("hits") >= p.pressure_min_hits), F.lit(False))
    steps = judged.select("section_id", F.col("round_id").cast("int").alias("round_id"), ready.alias("ready"))
    folded = fold_rounds(steps, step, -1, "hard_active boolean, cooldown_until int")
    return judged.join(folded, ["section_id", "round_id"]).withColumn(
        "hard_slots", F.when(F.col("hard_active"), min(p.hard_slots, p.batch_size)).otherwise(0)
    )


def hard_focus_tag(profile_tag: Column | str, modal_tag: Column | str) -> Column:
    """Profile tag unless open-ended, else the vault's most frequent tag, else open-ended."""
    tag = F.nullif(tx.blank_to_null(tx.strip(profile_tag)), F.lit(fx.WIDE_VARIETY))
    return F.coalesce(tag, tx.blank_to_null(modal_tag), F.lit(fx.WIDE_VARIETY))


# --- validation weakness ----------------------------------------------------------------------


def weakness_slots(sections: DataFrame, categories: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Slots reserved for weak validation categories.

    ``sections`` holds ``section_id, capacity, latest_action, improvement, easy_batch,
    validation_plateau``; ``categories`` holds ``section_id, rank, tag``.
    """
    named = categories.where(~tx.is_blank("tag") & ~tx.is_exploration("tag"))
    top = top_n(named, ["section_id"], [F.col("rank")], p.weakness_categories, "_rn")
    tags = top.groupBy("section_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rn", "tag"))), lambda x: tx.strip(x["tag"])
        ).alias("_tags")
    )
    action = F.coalesce("latest_action", F.lit(""))
    bad = action.isin("degraded", "rollback_next", "rollback_unavailable")
    flat = (F.coalesce("easy_batch", F.lit(0.0)) >= 0.80) & (
        F.coalesce("validation_plateau", F.lit(0.0)) >= 0.80
    )
    gain = F.coalesce("improvement", F.lit(0.0))
    rising = (gain >= p.weakness_improvement_delta) | (action == "new_best")
    off = (F.col("capacity") <= 0) | F.col("_tags").isNull()

    def pick(bad_v, flat_v, rising_v, slight_v, base_v, off_v):  # one rule order for both columns
        return (
            F.when(off, off_v).when(bad, bad_v).when(flat, flat_v).when(rising, rising_v)
            .when(gain > 0, slight_v).otherwise(base_v)
        )

    fraction = pick(
        F.lit(p.weakness_degraded), F.lit(p.weakness_plateau), F.lit(p.weakness_improving),
        F.lit(p.weakness_slight), F.lit(p.weakness_base), F.lit(0.0),
    )
    reason = pick(
        F.concat(F.lit("health_"), action), F.lit("easy_training_validation_plateau"),
        F.lit("validation_improving"), F.lit("validation_slightly_improving"), F.lit("base"),
        F.lit("no_capacity_or_profile"),
    )
    wanted = F.least(
        F.greatest(
            F.lit(p.weakness_min_slots), tx.round_half_even(F.col("capacity") * F.col("fraction"))
        ),
        F.col("capacity"),
        F.lit(p.weakness_max_slots),
    )
    return (
        sections.join(tags, "section_id", "left")
        .withColumn("fraction", fraction)
        .withColumn("reason", reason)
        .withColumn("slot_count", F.when(off, 0).otherwise(wanted))
        .withColumn(
            "weakness_tags",
            cycle_to(F.coalesce("_tags", F.array().cast(_STRINGS)), F.col("slot_count")),
        )
        .drop("_tags")
    )


# --- recipe -----------------------------------------------------------------------------------


def recycle_picks(
    vault: DataFrame, ledger: DataFrame, rounds: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """Best recycle candidates per section as an array; rows must still exist in the ledger."""
    usable = vt.recyclable(vault, rounds, p).join(
        ledger.select("section_id", "ledger_id"), ["section_id", "ledger_id"], "left_semi"
    )
    order = [F.col("loss").desc(), F.col("recycle_count"), F.col("ledger_id")]
    picked = top_n(usable, ["section_id"], order, min(p.max_recycle_slots, p.batch_size), "_rn")
    return picked.groupBy("section_id").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "tag", "ledger_id"))).alias("picks")
    )


def build_recipe(
    rounds: DataFrame, plan: DataFrame, picks: DataFrame, weakness_input: DataFrame,
    categories: DataFrame, pressure: DataFrame, p: Params = DEFAULTS,
) -> DataFrame:
    """The next recipe: recycled rows, weakness slots, hard slots, then the tag plan, cut to size.

    ``pressure`` holds ``section_id, hard_slots, hard_focus_tag``; ``weakness_input`` the columns of
    :func:`weakness_slots` except ``capacity``.
    """
    hard_n = F.coalesce("hard_slots", F.lit(0))
    limit = F.when(hard_n > 0, min(p.max_recycle_slots, p.hard_max_recycle_slots)).otherwise(
        p.max_recycle_slots
    )
    no_picks = F.array().cast("array<struct<_rn:int,tag:string,ledger_id:bigint>>")
    base = (
        rounds.select("section_id", F.col("current_round").alias("round_id"))
        .join(plan, "section_id")
        .join(picks, "section_id", "left")
        .join(pressure.select("section_id", "hard_slots", "hard_focus_tag"), "section_id", "left")
        .join(weakness_input, "section_id", "left")
        .withColumn("picks", F.slice(F.coalesce("picks", no_picks), F.lit(1), limit))
        .withColumn("capacity", F.lit(p.batch_size) - F.size("picks"))
    )
    weak = weakness_slots(base, categories, p)
    generate = F.concat(
        F.transform("weakness_tags", lambda t: tx.validation_tag(t)),
        F.array_repeat(tx.hard_tag(F.coalesce("hard_focus_tag", F.lit(fx.WIDE_VARIETY))), hard_n),
        F.col("plan"),
        F.col("plan"),  # the plan starts over when it is too short
    )
    slot = lambda command, tag, ledger_id: F.struct(
        command.alias("command"), tag.alias("tag"), ledger_id.cast("bigint").alias("failure_ledger_id")
    )
    slots = F.slice(
        F.concat(
            F.transform("picks", lambda x: slot(F.lit("recycle"), x["tag"], x["ledger_id"])),
            F.transform(generate, lambda t: slot(F.lit("generate"), t, F.lit(None))),
        ),
        1, p.batch_size,
    )
    return weak.select("section_id", "round_id", F.posexplode(slots).alias("i", "s")).select(
        "section_id", "round_id", (F.col("i") + 1).alias("slot_id"), "s.command", "s.tag",
        "s.failure_ledger_id",
    )


def first_recipe(rounds: DataFrame, counts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """All-generation recipe for sections that have no ledger yet."""
    empty = counts.sparkSession.createDataFrame(
        [], "section_id string, metric_rank int, tag string, avg_loss double, slots int"
    )
    plan = tag_plan(rounds, empty, counts, p)
    return (
        explode_plan(plan)
        .join(rounds.select("section_id", F.col("current_round").alias("round_id")), "section_id")
        .select(
            "section_id", "round_id", "slot_id", F.lit("generate").alias("command"), "tag",
            F.lit(None).cast("bigint").alias("failure_ledger_id"),
        )
    )


def commit_recipe(
    recipe: DataFrame, vault: DataFrame, state: DataFrame, p: Params = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """(vault, state) after a recipe is taken: recycle counters, streak and used ids.

    ``state`` holds ``section_id, current_round, consecutive_no_recycle`` and may hold ``recycled_ids``.
    """
    used = recipe.groupBy("section_id").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("command") == "recycle", F.struct("slot_id", "failure_ledger_id")))
        ).alias("_u")
    )
    ids = F.transform("_u", lambda x: x["failure_ledger_id"])
    columns = {
        "consecutive_no_recycle": F.when(F.col("_u").isNull(), F.col("consecutive_no_recycle"))
        .when(F.size("_ids") > 0, 0)
        .otherwise(F.col("consecutive_no_recycle") + 1),
    }
    if "recycled_ids" in state.columns:
        columns["recycled_ids"] = ordered_union(F.coalesce("recycled_ids", F.array().cast("array<bigint>")), F.col("_ids"))
    new_state = (
        state.join(used, "section_id", "left")
        .withColumn("_ids", F.coalesce(ids, F.array().cast("array<bigint>")))
        .withColumns(columns)
        .drop("_u", "_ids")
    )
    return vt.mark_recycled(vault, recipe, state, p), new_state


def validate_recipe(recipe: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row per recipe with the number of slots and of broken slots, and an overall verdict."""
    bad = (
        ~F.col("slot_id").between(1, p.batch_size)
        | ~F.col("command").isin("generate", "recycle")
        | ((F.col("command") == "recycle") & F.col("failure_ledger_id").isNull())
    )
    return recipe.groupBy("section_id", "round_id").agg(
        F.count("*").alias("slot_count"),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_slots"),
        F.count_distinct("slot_id").alias("distinct_slots"),
    ).withColumn(
        "valid",
        (F.col("slot_count") == p.batch_size)
        & (F.col("distinct_slots") == p.batch_size)
        & (F.col("bad_slots") == 0),
    )


RECIPE_COLUMNS = schemas.columns(schemas.RECIPE)
