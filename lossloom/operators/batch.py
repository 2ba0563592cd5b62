"""Building a training batch: recycled rows, generator responses, pool rows and their checks.

Bad rows are not raised but returned with a reason, so one section cannot stop the others.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lossloom import fixed_values as fx
from lossloom import schemas
from lossloom.functions import text as tx
from lossloom.operators import planner as pl
from lossloom.operators.ledger import known_categories, render_tag_counts
from lossloom.operators.ranking import top_n
from lossloom.params import DEFAULTS, Params
from lossloom.plans.workspace import settle

_STRINGS = "array<string>"


# --- recycled rows ----------------------------------------------------------------------------


def fetch_recycled(recipe: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, missing): ledger text for every recycle slot, and slots whose row is gone."""
    slots = recipe.where(F.col("command") == "recycle").select(
        "section_id", F.col("round_id").alias("recipe_round"), "slot_id",
        F.col("failure_ledger_id").alias("ledger_id"),
    )
    rows = ledger.select("section_id", "ledger_id", "sample", "instruct", "gold_summary", "tag")
    joined = slots.join(rows.withColumn("_found", F.lit(True)), ["section_id", "ledger_id"], "left")
    samples = joined.where("_found").select(
        "section_id", F.col("recipe_round").alias("round_id"), "slot_id", "sample", "instruct",
        "gold_summary", "tag", F.lit("recycled").alias("source"),
        F.col("ledger_id").alias("source_ledger_id"),
    )
    missing = joined.where(F.col("_found").isNull()).select(
        "section_id", F.col("recipe_round").alias("round_id"), "slot_id",
        F.col("ledger_id").alias("failure_ledger_id"),
        F.when(F.col("ledger_id").isNull(), "missing_failure_ledger_id")
        .otherwise("ledger_row_not_found").alias("reason"),
    )
    return samples, missing


# --- validation -------------------------------------------------------------------------------


def validate_batch(batch: DataFrame) -> DataFrame:
    """Add ``violations``: which of sample, instruct, gold_summary and tag are blank."""
    names = ["sample", "instruct", "gold_summary", "tag"]
    rules = [F.when(tx.is_blank(n), F.lit(f"missing_{n}")) for n in names]
    return batch.withColumn("violations", F.array_compact(F.array(*rules)))


def validate_batch_size(batch: DataFrame, p: Params = DEFAULTS, check_size: bool = True) -> DataFrame:
    """Per batch: its size, whether it is exact, how many rows miss their gold answer, and at which slots.

    With ``check_size`` a wrong size is the first error, so slots are listed for batches of the expected size only; without
    it they are listed for every batch. :func:`oversize_rows` gives the rows beyond the expected size.
    """
    missing = tx.is_blank("gold_summary")
    keys = ["section_id", "round_id"]
    sizes = batch.groupBy(*keys).agg(F.count("*").alias("size"), F.count_if(missing).alias("missing_gold"))
    sizes = sizes.withColumn("exact", F.col("size") == p.batch_size)
    wanted = sizes.where("exact") if check_size else sizes
    listed = (
        batch.where(missing)
        .join(wanted.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.array_join(F.sort_array(F.collect_list("slot_id")).cast(_STRINGS), ", ").alias("positions"))
    )
    return sizes.join(listed, keys, "left")


def oversize_rows(batch: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows of a batch beyond the expected size, in slot order, with the reason ``batch_too_large``."""
    keys = ["section_id", "round_id"]
    large = batch.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > p.batch_size).select(*keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("slot_id"))
    rows = batch.join(large, keys, "left_semi").withColumn("_place", place).where(F.col("_place") > p.batch_size)
    return rows.drop("_place").withColumn("reason", F.lit("batch_too_large"))


# --- generator responses ----------------------------------------------------------------------


def ingest_responses(
    raw: DataFrame, items: DataFrame, counts: DataFrame | None = None, p: Params = DEFAULTS, own_ids: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) from raw generator output.

    ``raw``: ``section_id, round_id, response`` and, where a batch may be answered more than once, ``response_no``: of several
    rows for a slot the last of the last response wins. With ``counts`` (tag counts of the sections) the rows' tags are
    conformed to the known categories, which adds ``tag_match``. ``items``: ``section_id, round_id, slot_id,
    generation_index, tag`` for the requested slots. A response may be a JSON array, an object with
    ``samples`` or ``items``, or a single object; it may be fenced or surrounded by chatter. Rows
    without a slot id take the slot at their position, and so do all rows without ``own_ids``.
    """
    keys = ["section_id", "round_id"]
    if "response_no" not in raw.columns:
        raw = raw.withColumn("response_no", F.lit(0))
    slots = items.groupBy(*keys).agg(  # a recipe's worth of slots
        F.array_sort(F.collect_list(F.struct("generation_index", "slot_id", "tag"))).alias("_items")
    )
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    filled = lambda v: F.when(F.size(v) > 0, v)
    parsed = tx.parse_response(raw, "response").withColumns(
        {
            "_object": F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False)),
            "_samples": as_list(F.try_variant_get("value", "$.samples", "variant")),
            "_listed": as_list(F.try_variant_get("value", "$.items", "variant")),
            "_single": F.try_variant_get("value", "$.sample", "variant").isNotNull(),
        }
    )
    wrapped = F.coalesce(filled(F.col("_samples")), F.col("_listed"))
    rows = (
        F.when(F.col("_object") & wrapped.isNotNull(), wrapped)
        .when(F.col("_object") & F.col("_single"), F.array("value"))
        .when(~F.col("_object"), as_list(F.col("value")))
    )
    listed = parsed.withColumn("_rows", rows)
    # Outer explode: a response without rows stays as one row and is judged with the others, so no
    # filter sits above the parsing stages (the optimizer would copy the parsing into it).
    elements = listed.select(
        *keys, "response_no", "error", F.col("_rows").isNull().alias("_broken"), "payload",
        F.posexplode_outer("_rows").alias("row_index", "_e"),
    )

    def text(name: str) -> Column:
        return F.try_variant_get("_e", f"$.{name}", "string")

    at = F.get("_items", F.col("row_index"))
    fields = elements.join(slots, keys, "left").select(
        *keys, "response_no", "row_index", "_items", "error", "_broken", "payload",
        F.schema_of_variant("_e").startswith("OBJECT").alias("_object"),
        F.when(
            F.col("row_index").isNotNull(),
            F.coalesce(*([text("slot_id")] if own_ids else []), at["slot_id"].cast("string")),
        ).alias("_slot"),
        tx.strip(text("sample")).alias("sample"),
        tx.strip(text("instruct")).alias("instruct"),
        F.coalesce(*[tx.blank_to_null(text(n)) for n in ("gold_summary", "summary", "output")]).alias("gold_summary"),
        tx.blank_to_null(text("tag")).alias("_tag"),
    ).withColumn("slot_id", tx.strip("_slot").try_cast("int"))
    own = F.get(F.filter("_items", lambda x: x["slot_id"] == F.col("slot_id")), F.lit(0))
    known = fields.withColumn("_item", own)
    reason = (
        F.when(F.col("_broken") & F.col("error").isNotNull(), "invalid_json")
        .when(F.col("_broken"), "not_a_list")
        .when(F.col("row_index").isNull(), "empty_list")
        .when(~F.coalesce("_object", F.lit(False)), "not_an_object")
        .when(F.col("slot_id").isNull(), "no_numeric_slot_id")
        .when(F.col("_item").isNull(), "unknown_slot_id")
        .when(F.col("sample").isNull(), "missing_sample")
        .when(tx.is_blank("instruct"), "missing_instruct")
        .when(tx.is_meta_instruction("instruct"), "meta_instruction")
        .when(tx.is_meta_instruction("sample"), "meta_sample")
        .when(tx.is_blank("gold_summary"), "missing_gold")
        .otherwise("")
    )
    # The window also keeps the checks from being copied into every filter below. Rows that are rejected anyway are spread,
    # as all broken responses of a batch share a null slot and one reason.
    spread = F.when(F.col("reason") == "", F.lit(0)).otherwise(F.pmod(F.xxhash64("payload", "row_index", "response_no"), F.lit(1 << 20)))
    last = Window.partitionBy(*keys, "slot_id", "reason", "_spread").orderBy(F.col("response_no").desc(), F.col("row_index").desc())
    judged = known.withColumn("reason", reason).withColumn("_spread", spread).withColumn("_rn", F.row_number().over(last))
    good = judged.where((F.col("reason") == "") & (F.col("_rn") == 1)).select(
        *keys, "slot_id", "sample", "instruct", "gold_summary",
        F.coalesce("_tag", "_item.tag").alias("tag"), F.lit("generated").alias("source"),
        F.lit(None).cast("bigint").alias("source_ledger_id"),
    )
    if counts is not None:
        good = conform_tags(good, counts, p)
    repeated = (F.col("reason") == "") & (F.col("_rn") > 1)
    rejected = judged.where((F.col("reason") != "") | repeated).select(
        *keys, "slot_id", "row_index",
        F.when(F.col("reason") == "", "duplicate_slot_id").otherwise(F.col("reason")).alias("reason"),
        F.coalesce("error", F.substring(F.coalesce("sample", "payload"), 1, 240)).alias("detail"),
    )
    return good, rejected


# --- tag vocabulary ---------------------------------------------------------------------------


def _candidates(tags: DataFrame) -> DataFrame:
    """Adds the category that each distinct raw tag names, if any, one table per step so that no expression grows large."""
    named = settle(tags.withColumn("_base", tx.base_tag("tag")))
    named = settle(named.withColumn("_norm", tx.normalize_tag("_base")))
    named = settle(named.withColumn("_norm", F.regexp_replace("_norm", r"\Ahard_", "")))
    bad = (F.col("_norm") == "") | ~tx.is_category("_norm") | F.col("_norm").startswith(fx.WIDE_VARIETY + "_")
    return settle(named.select(*tags.columns, F.when(~bad, F.col("_norm")).alias("_cand")))


def _close_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of distinct strings ``a``/``b`` that may reach the similarity cutoff, per section.

    A ratio of at least ``cutoff`` means at most ``t = (1-cutoff)(|a|+|b|)`` insertions and
    deletions. Cut ``b`` into more pieces than the largest possible ``t``: one piece must appear in
    ``a`` unchanged and no further than ``t`` from its place. So the pieces are joined by equality
    to the substrings of ``a``, and lengths and places are tested inside the join. No group of tags
    is ever paired with itself.
    """
    slack = 1.0 - cutoff
    longest = (2 - cutoff) / cutoff  # |a| is at most this many times |b|
    max_edits = F.floor(F.length("b") * slack * (1 + longest) + 1e-9).cast("int")
    pieces = (
        right.withColumn("_k", max_edits + 1)
        .where(F.length("b") >= F.col("_k"))
        .select("section_id", "b", "_k", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_i"))
        .withColumn("_at", F.floor(F.col("_i") * F.length("b") / F.col("_k")).cast("int") + 1)
        .withColumn("_to", F.floor((F.col("_i") + 1) * F.length("b") / F.col("_k")).cast("int"))
        .withColumn("_piece", F.expr("substring(b, _at, _to - _at + 1)"))
        .select("section_id", "b", "_at", "_piece")
    )
    # A string of length n has about 0.17 n pieces, so no piece is longer than this.
    bound = int(1 / (slack * (1 + longest))) + 2
    grams = (
        left.select(
            "section_id", "a",
            F.explode(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), F.length("a")),
                        lambda s: F.transform(
                            F.sequence(F.lit(1), F.least(F.lit(bound), F.length("a") - s + 1)),
                            lambda n: F.struct(
                                s.alias("_s"), F.substring(F.col("a"), s, n).alias("_piece")
                            ),
                        ),
                    )
                )
            ).alias("g"),
        )
        .select("section_id", "a", "g._s", "g._piece")
    )
    total = F.length("a") + F.length("b")
    edits = F.lit(slack) * total + 1e-9
    near = (
        (grams["section_id"] == pieces["section_id"])
        & (grams["_piece"] == pieces["_piece"])
        & (F.abs(F.length("a") - F.length("b")) <= edits)
        & (F.abs(F.col("_s") - F.col("_at")) <= edits)
        & (F.col("a") != F.col("b"))
    )
    return (
        grams.join(pieces, near)
        .select(grams["section_id"], "a", "b")
        .distinct()
        .where(F.levenshtein("a", "b") <= F.floor(edits).cast("int"))
    )


@F.pandas_udf(T.DoubleType())
def _match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of the pairs that survive the exact filters (a few per distinct new tag)."""
    return pd.Series(
        [difflib.SequenceMatcher(None, known, new).ratio() for new, known in zip(a, b, strict=True)],
        dtype="float64",
    )


def conform_tags(df: DataFrame, counts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Replace ``tag`` by its known category and add ``tag_match``.

    All work is done on the distinct raw tags of a section: exact matches first, then the closest known category at or
    above the cutoff (ties go to the last in the alphabet), else the tag stays as a new category. The rows are joined to the
    finished mapping once.
    """
    known = settle(known_categories(counts).select("section_id", F.col("tag").alias("b")))
    named = _candidates(df.select("section_id", "tag").distinct())
    distinct = named.where(F.col("_cand").isNotNull()).select("section_id", F.col("_cand").alias("a")).distinct()
    exact = distinct.join(
        known.withColumnRenamed("b", "a"), ["section_id", "a"], "left_semi"
    ).select("section_id", "a", F.col("a").alias("_tag"), F.lit("exact").alias("_match"))
    open_tags = distinct.join(known.withColumnRenamed("b", "a"), ["section_id", "a"], "left_anti")
    fuzzy = (
        _close_pairs(open_tags, known, p.tag_similarity)
        .withColumn("_r", _match_ratio("a", "b"))
        .where(F.col("_r") >= p.tag_similarity)
        .groupBy("section_id", "a")
        .agg(F.max(F.struct("_r", "b")).alias("_m"))
        .select("section_id", "a", F.col("_m.b").alias("_tag"), F.lit("fuzzy").alias("_match"))
    )
    found = exact.unionByName(fuzzy).withColumnRenamed("a", "_cand")
    none = F.col("_cand").isNull()
    mapping = settle(
        named.join(found, ["section_id", "_cand"], "left").select(
            F.col("section_id").alias("_section"), F.col("tag").alias("_raw"),
            F.when(none, "uncategorized").otherwise(F.coalesce("_tag", "_cand")).alias("_tag"),
            F.when(none, "uncategorized").otherwise(F.coalesce("_match", F.lit("new"))).alias("tag_match"),
        )
    )
    same = F.col("section_id").eqNullSafe(F.col("_section")) & F.col("tag").eqNullSafe(F.col("_raw"))
    return df.join(mapping, same).withColumn("tag", F.col("_tag")).drop("_section", "_raw", "_tag")


# --- diversity --------------------------------------------------------------------------------


def accept_diverse(
    batch: DataFrame, counts: DataFrame, round_tags: DataFrame | None = None, p: Params = DEFAULTS
) -> DataFrame:
    """Add ``accepted`` and ``reject_reason`` to every generated row, judged in slot order.

    ``batch``: rows with ``slot_id``, ``tag``, ``is_exploration`` and ``forced``. Slots outside the batch are rejected as
    ``slot_out_of_range``; of several rows for a slot the first by tag is judged and the others are ``duplicate_slot``. A
    judged row's verdict depends on the rows accepted before it, so each batch is folded; at most ``batch_size`` rows of it
    are. ``round_tags`` are tags already used by recycled rows, one row per use; a tag may be used ``tags_per_round`` times. A
    row's tag counts for the section from the moment it is accepted.
    """
    keys = ["section_id", "round_id"]
    known = known_categories(counts)
    totals = known.groupBy("section_id").agg(F.sum("n").alias("_total"))
    in_range = F.coalesce(F.col("slot_id").between(1, p.batch_size), F.lit(False))
    outside = batch.where(~in_range).withColumn("reject_reason", F.lit("slot_out_of_range"))
    first = F.row_number().over(Window.partitionBy(*keys, "slot_id").orderBy("tag"))
    ranked = settle(batch.where(in_range).withColumn("_rn", first))  # read twice; which of equal rows is first must not change
    one_per_slot = ranked.where("_rn = 1")
    repeated = ranked.where("_rn > 1").drop("_rn").withColumn("reject_reason", F.lit("duplicate_slot"))
    rows = (
        one_per_slot.select(*keys, "slot_id", "tag", "is_exploration", "forced")
        .join(known.withColumnRenamed("n", "_n"), ["section_id", "tag"], "left")
        .join(totals, "section_id", "left")
        .groupBy(*keys)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "slot_id", "tag", F.col("is_exploration").alias("explore"), "forced",
                        F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_total", F.lit(0)).alias("total"),
                        tx.normalize_tag("tag").alias("norm"), tx.is_category(tx.normalize_tag("tag")).alias("cat"),
                    )
                )
            ).alias("_rows")
        )
    )
    if round_tags is not None:
        used = round_tags.groupBy(*keys).agg(F.collect_list("tag").alias("_seen"))
        rows = rows.join(used, keys, "left")
    else:
        rows = rows.withColumn("_seen", F.lit(None).cast(_STRINGS))
    allowed = ", ".join(f"'{t}'" for t in fx.CONTEXTUAL_TAGS)
    banned = ", ".join(f"'{t}'" for t in fx.CONTEXTUAL_BANNED_TAGS)
    own = "size(filter(a.added, t -> t = x.tag))"
    why = (
        "CASE WHEN NOT x.explore THEN NULL "
        f"WHEN x.forced THEN if(x.norm IN ({banned}) OR x.norm NOT IN ({allowed}), 'not_contextual', NULL) "
        f"WHEN size(filter(a.seen, t -> t = x.tag)) >= {p.tags_per_round} THEN 'tag_in_round' "
        f"WHEN x.total + size(a.added) > 0 AND x.n + {own} >= {p.dominant_count} "
        f"AND (x.n + {own}) / (x.total + size(a.added)) >= {p.dominant_share}D THEN 'tag_dominates_section' END"
    )
    fold = (
        "aggregate(_rows, named_struct('seen', coalesce(_seen, CAST(array() AS array<string>)), "
        "'added', CAST(array() AS array<string>), 'out', CAST(array() AS array<struct<slot_id:int,reason:string>>)), "
        f"(a, x) -> named_struct('seen', if(({why}) IS NULL, concat(a.seen, array(x.tag)), a.seen), "
        f"'added', if(({why}) IS NULL AND x.cat, concat(a.added, array(x.norm)), a.added), "
        f"'out', concat(a.out, array(named_struct('slot_id', x.slot_id, 'reason', {why})))), a -> a.out)"
    )
    verdicts = rows.select(*keys, F.explode(F.expr(fold)).alias("v")).select(
        *keys, F.col("v.slot_id").alias("slot_id"), F.col("v.reason").alias("reject_reason")
    )
    judged = one_per_slot.drop("_rn").join(verdicts, [*keys, "slot_id"]).select(*repeated.columns)
    rows = judged.unionByName(repeated).unionByName(outside.select(*repeated.columns))
    return rows.withColumn("accepted", F.col("reject_reason").isNull())


# --- pool selection ---------------------------------------------------------------------------


def select_from_pool(
    recipe: DataFrame, pool: DataFrame, counts: DataFrame, used: DataFrame | None = None,
    hardest_first: bool = True, p: Params = DEFAULTS,
) -> DataFrame:
    """Fill generate slots from a candidate pool ``(section_id, sample_id, tag, score)``.

    A focused slot takes the next best row of its tag. Exploration slots take the best row of tags
    not used in the round otherwise, least counted tags first, one row per tag. Rows in ``used``
    (``section_id, sample_id``) are not taken again, nor does one call give a row to two rounds. Each
    (section, tag) is cut to the rows that its rounds can take before it is shuffled. Slots the pool cannot fill come back with a null ``sample_id``.
    """
    fresh = pool if used is None else pool.join(
        used.select("section_id", "sample_id"), ["section_id", "sample_id"], "left_anti"
    )
    order = (
        [F.col("score").desc_nulls_last(), F.col("sample_id")]
        if hardest_first
        else [F.xxhash64("section_id", "sample_id"), F.col("sample_id")]
    )
    slots = recipe.where(F.col("command") == "generate").select(
        "section_id", "round_id", "slot_id", F.col("tag").alias("slot_tag"),
        tx.normalize_tag(tx.base_tag("tag")).alias("tag"), tx.is_wide_variety("tag").alias("explore"),
    )
    # Windows over a section's slots hold the recipes of one call; a row is given out once, also over several rounds.
    turn = F.dense_rank().over(Window.partitionBy("section_id").orderBy("round_id")) - 1
    slots = settle(slots.withColumn("_turn", turn))
    rounds = (slots.agg(F.max("_turn")).first()[0] or 0) + 1
    best = top_n(
        fresh.withColumn("tag", tx.normalize_tag("tag")).select("section_id", "tag", "sample_id", "score"),
        ["section_id", "tag"], order, p.batch_size * rounds + rounds, "tag_rank",
    )
    by_tag = Window.partitionBy("section_id", "tag").orderBy("round_id", "slot_id")
    focused = slots.where(~F.col("explore")).withColumn("tag_rank", F.row_number().over(by_tag))
    fill = focused.join(best, ["section_id", "tag", "tag_rank"], "left").select(
        "section_id", "round_id", "slot_id", "slot_tag", F.when(F.col("sample_id").isNotNull(), F.col("tag")).alias("tag"),
        "sample_id", "score",
    )
    taken = recipe.where(~tx.is_wide_variety("tag")).select(
        "section_id", "round_id", tx.normalize_tag(tx.base_tag("tag")).alias("tag")
    ).distinct()
    explore = slots.where("explore").drop("tag")
    known = known_categories(counts)
    # a tag's rows are given to its focused slots first, then one to each round that explores
    spent = focused.groupBy("section_id", "tag").agg(F.count("*").alias("_spent"))
    open_tags = (
        best.join(spent, ["section_id", "tag"], "left")
        .join(explore.select("section_id", "round_id", "_turn").distinct(), "section_id")
        .where(F.col("tag_rank") == F.coalesce("_spent", F.lit(0)) + F.col("_turn") + 1)
        .join(taken, ["section_id", "round_id", "tag"], "left_anti")
        .join(known, ["section_id", "tag"], "left")
    )
    choice = top_n(
        open_tags, ["section_id", "round_id"], [F.coalesce("n", F.lit(0)), F.col("tag")], p.batch_size, "_rank"
    ).select("section_id", "round_id", "_rank", "tag", "sample_id", "score")
    by_slot = Window.partitionBy("section_id", "round_id").orderBy("slot_id")
    explored = explore.withColumn("_rank", F.row_number().over(by_slot)).join(
        choice, ["section_id", "round_id", "_rank"], "left"
    ).select(*fill.columns)
    return fill.unionByName(explored)


# --- assembly ---------------------------------------------------------------------------------


def shuffle_batch(batch: DataFrame, seed: int = 0) -> DataFrame:
    """Order each batch by a SHA-256 of seed and slot; repeatable on any engine, unlike a random shuffle."""
    mark = F.sha2(F.concat_ws("|", F.lit(seed), "section_id", "round_id", "slot_id"), 256)
    w = Window.partitionBy("section_id", "round_id").orderBy(mark, "slot_id")
    return batch.withColumn("batch_pos", F.row_number().over(w))


def assemble_batch(recycled: DataFrame, generated: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(batch, rejected): recycled and generated rows together, checked and shuffled."""
    names = schemas.columns(schemas.BATCH)
    checked = validate_batch(recycled.select(*names).unionByName(generated.select(*names)))
    good = checked.where(F.size("violations") == 0).drop("violations")
    return shuffle_batch(good, seed), checked.where(F.size("violations") > 0)


# --- requests and response cache --------------------------------------------------------------

DATA_TEMPLATE = """Write one training sample for a student model.

Instruction for you:
***instruct***

Focus:
***tag***

Tags written so far:
***tag_counts***

Known categories:
***known_categories***

Constraints:
***generation_constraints***

Answer with one JSON object holding sample, instruct, gold_summary and tag. Use a known category as
tag when one fits; never use the open-ended focus itself. Keep the instruction above out of the sample.
"""

INSTRUCTION_TEMPLATE = """Write one instruction for making training data.

Example:
***example_block***

Focus:
***tag***

Tags written so far:
***tag_counts***

Known categories:
***known_categories***

Constraints:
***generation_constraints***

Answer with one paragraph in the spirit of the example. Do not write the sample itself yet.
"""


def generation_requests(
    blueprints: DataFrame, counts: DataFrame, instructions: DataFrame | None = None,
    cache: DataFrame | None = None, template: str = DATA_TEMPLATE, p: Params = DEFAULTS,
) -> DataFrame:
    """One request row per generate slot: prompt, cache key, and the cached response if there is one.

    ``instructions`` may hold ``section_id, round_id, slot_id, instruct, example_block``. Blueprints may have a column
    ``extra_constraints``, which is put before the blueprint's own lines.
    """
    keys = ["section_id", "round_id", "slot_id"]
    extra = "extra_constraints" if "extra_constraints" in blueprints.columns else F.lit(None).cast("string")
    rows = pl.constraints_text(blueprints).withColumn("constraints", pl.combine_constraints(extra, "constraints")).join(render_tag_counts(counts, p), "section_id", "left")
    if instructions is not None:
        rows = rows.join(instructions, keys, "left")
    for name in ("instruct", "example_block"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(""))
    values = {
        "instruct": F.coalesce("instruct", F.lit("")),
        "example_block": F.coalesce("example_block", F.lit("")),
        "tag": tx.base_tag("curriculum_focus"),
        "tag_counts": F.coalesce("tag_counts_text", F.lit(fx.EMPTY_TAG_COUNTS)),
        "known_categories": F.coalesce("categories_text", F.lit(fx.EMPTY_CATEGORIES)),
        "generation_constraints": tx.first_filled("constraints", F.lit(fx.NO_CONSTRAINTS)),
    }
    requests = rows.withColumn("prompt", tx.render(template, values)).select(
        *keys, "curriculum_focus", "generation_intent", "prompt",
        tx.has_unfilled("prompt").alias("unfilled"),
        tx.request_key("prompt", p.model_id, p.cache_version, p.temperature).alias("cache_key"),
    )
    return requests if cache is None else cache_lookup(requests, cache)


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``cached`` and ``response``; a blank cached response is a miss."""
    hits = cache.where(~tx.is_blank("response")).groupBy("cache_key").agg(
        F.min(tx.strip("response")).alias("response")
    )
    return requests.join(hits, "cache_key", "left").withColumn("cached", F.col("response").isNotNull())


def request_payload(requests: DataFrame) -> DataFrame:
    """All slots of a recipe as one JSON document, for generators that take a batch."""
    return requests.groupBy("section_id", "round_id").agg(
        F.count("*").alias("slots"),
        F.to_json(
            F.array_sort(F.collect_list(F.struct("slot_id", "curriculum_focus", "generation_intent", "prompt")))
        ).alias("payload"),
    )


def answer_requests(requests: DataFrame, generate) -> DataFrame:
    """Run a user's generator over request rows.

    ``generate`` takes and yields pandas frames (``mapInPandas``) and adds a ``response`` column.
    """
    schema = T.StructType([f for f in requests.schema if f.name != "response"]).add("response", "string")
    return requests.mapInPandas(generate, schema)
