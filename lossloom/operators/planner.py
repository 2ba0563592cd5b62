"""Generation blueprints: what each generate slot should ask for.

Everything a slot needs from its section is one row (a few short arrays), so a plan is two or three
equi-joins on the section and a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom import fixed_values as fx
from lossloom.functions import text as tx
from lossloom.operators.ledger import ordered_union, recent_distinct
from lossloom.operators.ranking import top_n
from lossloom.params import DEFAULTS, Params

_STRINGS = "array<string>"


def _lits(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(_STRINGS)


def planner_counts(counts: DataFrame) -> DataFrame:
    """Counts per normalised tag, without the open-ended tag."""
    return (
        counts.withColumn("tag", tx.normalize_tag("tag"))
        .where((F.col("tag") != "") & (F.col("tag") != fx.WIDE_VARIETY))
        .groupBy("section_id", "tag")
        .agg(F.sum("n").alias("n"))
    )


def _with_totals(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("section_id").agg(
        F.sum("n").alias("total"), F.min("n").alias("least")
    )
    return counts.join(totals, "section_id")


def overused_tags(counts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Tags with a large count and share; at most a few exist per section."""
    return _with_totals(planner_counts(counts)).where(
        (F.col("n") >= p.overused_count) & (F.col("n") / F.col("total") >= p.overused_share)
    ).select("section_id", "tag", "n", (F.col("n") / F.col("total")).alias("share"))


def dominant_tags(categories: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return _with_totals(categories).where(
        (F.col("n") >= p.dominant_count) & (F.col("n") / F.col("total") >= p.dominant_share)
    ).select("section_id", "tag", "n", (F.col("n") / F.col("total")).alias("share"))


def rare_tags(counts: DataFrame, avoid: DataFrame | None = None, p: Params = DEFAULTS, limit: int | None = None) -> DataFrame:
    """Least used tags in order of (count, tag), leaving out ``avoid (section_id, tag)``."""
    rows = _with_totals(planner_counts(counts)).where(F.col("n") <= F.col("least") + 1)
    if avoid is not None:
        rows = rows.join(avoid.select("section_id", "tag"), ["section_id", "tag"], "left_anti")
    return top_n(
        rows, ["section_id"], [F.col("n"), F.col("tag")], limit or p.rare_tag_limit, "rare_rank"
    ).select("section_id", "rare_rank", "tag", "n")


def section_tag_lists(counts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per section: overused tags, and enough rare tags to still have four after any avoidance.

    A slot avoids at most the overused, recycled and blocked tags, which bounds how many rare
    candidates can fall away.
    """
    most_avoided = int(1 / p.overused_share) + p.batch_size + len(fx.VISUAL_TAGS)
    over = overused_tags(counts, p).groupBy("section_id").agg(
        F.sort_array(F.collect_list("tag")).alias("overused")
    )
    rare = rare_tags(counts, None, p, p.rare_tag_limit + most_avoided).groupBy("section_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rare_rank", "tag"))), lambda x: x["tag"]
        ).alias("rare")
    )
    return rare.join(over, "section_id", "left")


def effective_profile(profiles: DataFrame, modes: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """The section's shape profile, unless a confident question-answering validation profile wins.

    All frames have one row per section; ``validation`` has ``shape_id, confidence, source``.
    """
    own = profiles.select("section_id", "shape_id", "confidence", "source", "focus_tag", "hard_levers")
    if validation is None:
        return own
    val = validation.select(
        "section_id", F.col("shape_id").alias("_shape"), F.col("confidence").alias("_conf"),
        F.col("source").alias("_source"),
    )
    wins = (
        (F.col("resolved_task_mode") == "text")
        & (F.col("_shape") == fx.ASSISTANT_QA)
        & (F.col("_conf") >= 0.55)
    )
    joined = own.join(modes.select("section_id", "resolved_task_mode"), "section_id", "left").join(
        val, "section_id", "left"
    ).withColumn("_wins", F.coalesce(wins, F.lit(False)))
    pick = lambda a, b: F.when(F.col("_wins"), a).otherwise(b)
    return joined.select(
        "section_id",
        pick(F.col("_shape"), F.col("shape_id")).alias("shape_id"),
        pick(F.col("_conf"), F.col("confidence")).alias("confidence"),
        pick(
            ordered_union(F.col("_source"), F.array(F.lit("original_user_examples"))), F.col("source")
        ).alias("source"),
        pick(F.lit(fx.SHAPE_DESCRIPTORS[fx.ASSISTANT_QA][5]), F.col("focus_tag")).alias("focus_tag"),
        pick(_lits(fx.HARD_LEVERS[fx.ASSISTANT_QA]), F.col("hard_levers")).alias("hard_levers"),
    )


def weakness_profile_for(slots: DataFrame, categories: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Weakness category for every slot: the one matching its focus tag, else the first.

    ``categories`` has at most three rows per section, carried as one array.
    """
    top = top_n(categories, ["section_id"], [F.col("rank")], p.weakness_categories, "_rn")
    listed = top.groupBy("section_id").agg(
        F.array_sort(
            F.collect_list(F.struct("_rn", "tag", "shape_id", "avg_loss", "max_loss"))
        ).alias("_cats")
    )
    focus = tx.normalize_tag(tx.base_tag("tag"))
    match = F.filter("_cats", lambda c: (tx.normalize_tag(c["tag"]) == focus) & (focus != ""))
    return (
        slots.join(listed, "section_id", "left")
        .withColumn("category", F.coalesce(F.get(match, F.lit(0)), F.get("_cats", F.lit(0))))
        .drop("_cats")
    )


def generation_items(recipe: DataFrame) -> DataFrame:
    """Generate slots with their 0-based index; a recipe has at most ``batch_size`` rows."""
    w = Window.partitionBy("section_id", "round_id").orderBy("slot_id")
    return recipe.where(F.col("command") == "generate").withColumn(
        "generation_index", F.row_number().over(w) - 1
    )


def _recent_lists(ledger: DataFrame) -> DataFrame:
    def listed(col: str, out: str) -> DataFrame:
        return recent_distinct(ledger, col).groupBy("section_id").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]
            ).alias(out)
        )

    return listed("instruct", "avoid_recent_instructions").join(
        listed("sample", "avoid_recent_sample_shapes"), "section_id", "full_outer"
    )


def plan_blueprints(
    recipe: DataFrame, counts: DataFrame, modes: DataFrame, profiles: DataFrame,
    categories: DataFrame, contextual: DataFrame, ledger: DataFrame, attempt: int = 1,
    p: Params = DEFAULTS,
) -> DataFrame:
    """One blueprint per generate slot.

    ``modes`` from ``resolve_task_mode``, ``profiles`` from :func:`effective_profile`,
    ``contextual`` from ``contextual_slot``.
    """
    round_tags = (
        recipe.where(F.col("command") == "recycle")
        .groupBy("section_id", "round_id")
        .agg(F.array_sort(F.collect_list(F.struct("slot_id", "tag"))).alias("_r"))
        .select(
            "section_id", "round_id",
            F.array_distinct(
                F.filter(F.transform("_r", lambda x: tx.normalize_tag(x["tag"])), lambda t: t != "")
            ).alias("round_tags"),
        )
    )
    items = (
        weakness_profile_for(generation_items(recipe), categories, p)
        .join(round_tags, ["section_id", "round_id"], "left")
        .join(contextual, ["section_id", "round_id"], "left")
        .join(section_tag_lists(counts, p), "section_id", "left")
        .join(modes.select("section_id", "task_mode", "resolved_task_mode", "mode_confidence"), "section_id")
        .join(profiles, "section_id", "left")
        .join(_recent_lists(ledger), "section_id", "left")
    )
    none = F.array().cast(_STRINGS)
    c = F.col
    step1 = items.withColumns(
        {
            "intent": tx.split_intent("tag")["intent"],
            "base": tx.split_intent("tag")["base"],
            "forced": F.coalesce(c("slot_id") == c("contextual_slot_id"), F.lit(False)),
        }
    ).withColumns(
        {
            "focus": F.coalesce(tx.blank_to_null(tx.normalize_tag("base")), c("base")),
        }
    )
    # profile of the slot: validation slots take the weak category's shape where it fits the mode
    val_shape = F.coalesce(tx.blank_to_null("category.shape_id"), c("shape_id"), F.lit(fx.GENERIC_TEXT))
    use_val = F.coalesce(
        (c("intent") == "validation")
        & c("category").isNotNull()
        & ~((c("resolved_task_mode") == "text") & (val_shape == fx.VISUAL_GENERATION)),
        F.lit(False),
    )
    focus_of = F.create_map(*[F.lit(x) for s, d in fx.SHAPE_DESCRIPTORS.items() for x in (s, d[5])])
    levers_of = F.create_map(
        *[x for s, levers in fx.HARD_LEVERS.items() for x in (F.lit(s), _lits(levers))]
    )
    step2 = step1.withColumn("_val", use_val).withColumns(
        {
            "profile_shape": F.when(c("_val"), val_shape).otherwise(
                F.coalesce("shape_id", F.lit(fx.GENERIC_TEXT))
            ),
            "profile_focus": F.when(
                c("_val"),
                F.coalesce(tx.blank_to_null("category.tag"), F.element_at(focus_of, val_shape)),
            ).otherwise(F.coalesce("focus_tag", F.lit(fx.WIDE_VARIETY))),
            "profile_source": F.when(
                c("_val"),
                ordered_union(F.array(F.lit("shared_validation_loss")), F.coalesce("source", none)),
            ).otherwise(F.coalesce("source", none)),
            "profile_levers": F.when(
                c("_val"),
                F.coalesce(
                    F.try_element_at(levers_of, val_shape), _lits(fx.HARD_LEVERS[fx.STRUCTURED_TEXT])
                ),
            ).otherwise(F.coalesce("hard_levers", none)),
            "profile_confidence": F.coalesce("confidence", F.lit(0.0)),
            "explore": c("focus") == fx.WIDE_VARIETY,
        }
    )
    blocked = F.when(c("resolved_task_mode") == "text", _lits(fx.VISUAL_TAGS)).otherwise(none)
    listed = ordered_union(F.coalesce("overused", none), F.coalesce("round_tags", none), blocked)
    own = F.when(c("explore"), none).otherwise(F.array("focus"))
    kept = F.when(c("forced"), _lits(fx.CONTEXTUAL_KEEP_TAGS)).otherwise(none)
    step3 = step2.withColumn("_avoid", F.array_except(listed, F.concat(own, kept))).withColumn(
        "_rare",
        F.slice(F.array_except(F.coalesce("rare", none), c("_avoid")), 1, p.rare_tag_limit),
    )
    seed = [
        c("section_id"), c("round_id"), c("slot_id"), c("generation_index"), c("base"), c("intent"),
        F.lit(attempt),
    ]
    pick = lambda options, name: tx.choose_rotated(options, *seed, F.lit(name))
    steered = c("intent").isin("hard", "validation")
    asks = (c("focus") == fx.ASSISTANT_QA) | (c("profile_shape") == fx.ASSISTANT_QA)
    grounded = (c("focus") == fx.CONTEXTUAL_QA) | (c("profile_shape") == fx.CONTEXTUAL_QA)
    visual_focus = c("focus").isin(fx.VISUAL_TAGS)
    by_mode = (
        F.when(c("resolved_task_mode") == "visual", "visual_generation")
        .when(c("resolved_task_mode") == "text", "example_aligned_text")
        .when(visual_focus, "visual_generation")
        .when(
            c("explore") & (tx.stable_index(3, *seed, F.lit("mixed_modality")) == 0), "visual_generation"
        )
        .otherwise("example_aligned_text")
    )
    first = (
        F.when(steered & asks, "text_assistant_qa")
        .when(steered & grounded, "text_contextual_qa")
        .otherwise(by_mode)
    )
    draws = (visual_focus | (c("profile_shape") == fx.VISUAL_GENERATION)) & steered
    step4 = step3.withColumn("_m", first).withColumns(
        {
            "modality_hint": F.when(c("forced"), "text_contextual_qa")
            .when(steered & asks, "text_assistant_qa")
            .when(steered & grounded, "text_contextual_qa")
            .when(draws, "visual_generation")
            .otherwise(c("_m")),
            "_pictures": c("_m") == "visual_generation",
        }
    )

    def option(forced: str, qa: list[str], grounded_v: str, visual: list[str], plain: list[str], name: str) -> Column:
        return (
            F.when(c("forced"), F.lit(forced))
            .when(steered & asks, pick(qa, f"hard_{name}"))
            .when(steered & grounded, F.lit(grounded_v))
            .when(draws, pick(visual, f"hard_{name}"))
            .when(steered, pick(plain, f"hard_{name}"))
            .when(c("_pictures"), pick(visual, name))
            .otherwise(pick(plain, name))
        )

    ctx = fx.CONTEXTUAL_SHAPE
    step5 = step4.withColumns(
        {
            "input_shape": option(
                ctx["input"], fx.QA_INPUT_SHAPES, ctx["input"], fx.VISUAL_INPUT_SHAPES, fx.INPUT_SHAPES, "input"
            ),
            "output_shape": option(
                ctx["forced_output"], fx.QA_OUTPUT_SHAPES, ctx["hard_output"], fx.VISUAL_OUTPUT_SHAPES,
                fx.OUTPUT_SHAPES, "output",
            ),
            "reasoning_requirement": option(
                ctx["reasoning"], fx.QA_REASONING, ctx["reasoning"], fx.VISUAL_REASONING, fx.REASONING,
                "reasoning",
            ),
            "domain_hint": F.when(
                c("modality_hint") == "visual_generation", pick(fx.VISUAL_DOMAINS, "domain")
            ).otherwise(pick(fx.TEXT_DOMAINS, "domain")),
            "difficulty": F.when(c("intent") == "hard", pick(fx.DIFFICULTY["hard"], "difficulty"))
            .when(c("intent") == "validation", pick(fx.DIFFICULTY["validation"], "difficulty"))
            .when(c("round_id") >= fx.DIFFICULTY_LATE_ROUND, pick(fx.DIFFICULTY["late"], "difficulty"))
            .when(c("round_id") >= fx.DIFFICULTY_MIDDLE_ROUND, pick(fx.DIFFICULTY["middle"], "difficulty"))
            .otherwise(pick(fx.DIFFICULTY["early"], "difficulty")),
            "target_tag_hint": F.when(c("forced"), F.lit(fx.TAG_HINT_FORCED))
            .when(steered & ~c("explore") & (c("focus") != ""), c("focus"))
            .when(steered & (c("profile_focus") != ""), c("profile_focus"))
            .when(
                c("explore") & (F.size("_rare") > 0),
                F.concat(F.lit(fx.TAG_HINT_RARE), F.array_join("_rare", ", ")),
            )
            .when(c("explore"), F.lit(fx.TAG_HINT_OPEN))
            .otherwise(c("focus")),
            "novelty_goal": F.when(c("intent") == "hard", F.lit(fx.NOVELTY["hard"]))
            .when(c("intent") == "validation", F.lit(fx.NOVELTY["validation"]))
            .when(c("explore") & (F.size("_rare") > 0), F.lit(fx.NOVELTY["rare"]))
            .when(c("explore"), F.lit(fx.NOVELTY["open"]))
            .otherwise(F.lit(fx.NOVELTY["focused"])),
        }
    ).withColumn("context_policy", tx.context_policy(c("forced"), c("input_shape"), c("profile_shape")))
    return step5.select(
        "section_id", "round_id", "slot_id", "generation_index",
        c("tag").alias("curriculum_focus"), c("intent").alias("generation_intent"), "forced",
        c("profile_shape").alias("shape_id"), c("profile_confidence").alias("shape_confidence"),
        c("profile_source").alias("shape_source"), c("profile_levers").alias("hard_levers"),
        "target_tag_hint", "novelty_goal", "difficulty", "domain_hint", "input_shape",
        "output_shape", "reasoning_requirement", "context_policy", "modality_hint", "task_mode",
        "resolved_task_mode", "mode_confidence",
        F.slice("_avoid", 1, 5).alias("avoid_tags"),
        F.coalesce("avoid_recent_instructions", none).alias("avoid_recent_instructions"),
        F.coalesce("avoid_recent_sample_shapes", none).alias("avoid_recent_sample_shapes"),
    )


# --- constraint text --------------------------------------------------------------------------

MODE_NOTES = {
    "text": "Write a text task; leave pictures, posters, logos and image prompts out.",
    "visual": "Write a visual task: an image, a visual prompt, an asset or an edit.",
    "mixed": "Text and visual tasks are both fine; keep the item true to its modality.",
}
HARD_NOTE = "Make this one harder than recent samples, but solvable and of the same task shape."
VALIDATION_NOTE = "Match the weak validation shape above with new facts and wording."
QUESTION_NOTE = "Ask a standalone question; add no separate context."
CLOSING_NOTE = "Invent new details; reuse no wording from this plan."


def _labelled(label: str, value: Column) -> Column:
    return F.array(F.concat(F.lit(f"{label}: "), value, F.lit(".")))


def _bullets(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")


def constraints_text(blueprints: DataFrame) -> DataFrame:
    """Add ``constraints``: the blueprint as bullet lines, leaving out what does not apply."""
    c = F.col
    none = F.array().cast(_STRINGS)
    only = lambda cond, lines: F.when(cond, lines).otherwise(none)
    indent = lambda col: F.transform(col, lambda x: F.concat(F.lit("  - "), x))
    number = lambda col: F.format_number(col, 2)
    lines = F.concat(
        _labelled("Generation intent", c("generation_intent")),
        _labelled(
            "Task shape",
            F.concat(
                "shape_id", F.lit(" (source="), F.array_join("shape_source", ", "),
                F.lit(", confidence="), number("shape_confidence"), F.lit(")"),
            ),
        ),
        _labelled("Target tag", c("target_tag_hint")),
        _labelled("Novelty goal", c("novelty_goal")),
        _labelled("Difficulty", c("difficulty")),
        _labelled("Domain", c("domain_hint")),
        _labelled("Input shape", c("input_shape")),
        _labelled("Output shape", c("output_shape")),
        _labelled("Reasoning", c("reasoning_requirement")),
        _labelled("Context policy", c("context_policy")),
        _labelled("Modality", c("modality_hint")),
        _labelled(
            "Task mode",
            F.concat(
                "resolved_task_mode", F.lit(" (configured="), "task_mode", F.lit(", confidence="),
                number("mode_confidence"), F.lit(")"),
            ),
        ),
        F.array(
            F.when(c("resolved_task_mode") == "text", MODE_NOTES["text"])
            .when(c("resolved_task_mode") == "visual", MODE_NOTES["visual"])
            .otherwise(MODE_NOTES["mixed"])
        ),
        only(
            c("generation_intent") == "hard",
            F.concat(F.array(F.lit(HARD_NOTE)), indent(F.slice("hard_levers", 1, 5))),
        ),
        only(c("generation_intent") == "validation", F.array(F.lit(VALIDATION_NOTE))),
        only(c("shape_id") == fx.ASSISTANT_QA, F.array(F.lit(QUESTION_NOTE))),
        only(F.size("avoid_tags") > 0, _labelled("Avoid overused tags", F.array_join("avoid_tags", ", "))),
        only(
            F.size("avoid_recent_instructions") > 0,
            F.concat(F.array(F.lit("Stay away from these recent instructions:")), indent("avoid_recent_instructions")),
        ),
        only(
            F.size("avoid_recent_sample_shapes") > 0,
            F.concat(F.array(F.lit("Stay away from these recent samples:")), indent("avoid_recent_sample_shapes")),
        ),
        F.array(F.lit(CLOSING_NOTE)),
    )
    return blueprints.withColumn("constraints", _bullets(lines))


def exploration_text(round_tags: Column, dominant: Column, forced: Column, rejected: Column | None = None) -> Column:
    """Bullet lines for an exploration slot: tags to avoid, and attempts already rejected.

    ``rejected`` is an array of structs ``tag, reason, instruct, sample``.
    """
    none = F.array().cast(_STRINGS)
    only = lambda cond, lines: F.when(cond, lines).otherwise(none)
    lines = [
        F.array(
            F.lit("Explore: choose a task unlike those already in this round."),
            F.lit("Name the category yourself; a rare or new one is best."),
        ),
        only(
            forced,
            F.array(
                F.lit("Put a short factual passage in the sample and ask one question it answers."),
                F.lit("Answer only from that passage; tag it contextual_qa or factual_qa."),
            ),
        ),
        only(F.size(round_tags) > 0, _labelled("Tags used in this round", F.array_join(F.sort_array(round_tags), ", "))),
        only(F.size(dominant) > 0, _labelled("Categories that dominate", F.array_join(F.sort_array(dominant), ", "))),
    ]
    if rejected is not None:
        shown = F.transform(
            rejected,
            lambda x, i: F.concat(
                (i + 1).cast("string"), F.lit(". tag="), x["tag"], F.lit("; reason="), x["reason"],
                F.lit("; instruction="), x["instruct"], F.lit("; sample="), x["sample"],
            ),
        )
        lines.append(only(F.size(rejected) > 0, F.concat(F.array(F.lit("Rejected so far:")), shown)))
    return _bullets(F.concat(*lines))


def combine_constraints(*parts: Column) -> Column:
    """Non-blank parts joined by an empty line; the placeholder text counts as blank."""
    cleaned = [F.nullif(tx.blank_to_null(tx.strip(x)), F.lit(fx.NO_CONSTRAINTS)) for x in parts]
    return F.coalesce(tx.blank_to_null(F.concat_ws("\n\n", *cleaned)), F.lit(fx.NO_CONSTRAINTS))


def planner_snapshot(blueprints: DataFrame, modes: DataFrame) -> DataFrame:
    """One row per section and round: mode, blocked tags and the slots as JSON (a recipe's worth)."""
    slots = blueprints.groupBy("section_id", "round_id").agg(
        F.to_json(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "slot_id", "curriculum_focus", "generation_intent", "shape_id", "forced",
                        "input_shape", "output_shape", "reasoning_requirement", "difficulty",
                        "domain_hint", "target_tag_hint",
                    )
                )
            )
        ).alias("generation_slots")
    )
    return slots.join(modes, "section_id").withColumns(
        {
            "blocked_tags": F.when(
                F.col("resolved_task_mode") == "text", _lits(fx.VISUAL_TAGS)
            ).otherwise(F.array().cast(_STRINGS)),
            "mode_source": F.when(F.col("task_mode") != "auto", "explicit_task_mode").otherwise(
                "original_user_examples"
            ),
        }
    )
