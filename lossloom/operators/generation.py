"""Asking an outside generator: requests per attempt, judged answers, and grouped tag lists.

A round's generate slots are asked for together first (attempt 0). Slots that got no usable answer, and exploration slots
whose answer was rejected, are asked for one by one (attempt 1), with what was rejected in the prompt; exploration slots have
``generation_attempts`` single attempts and keep the last usable answer, others have one. Every attempt leaves one row per slot it
was to fill, so what is still wanted is an anti-join and a run can stop between a request and its answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom import fixed_values as fx
from lossloom.functions import text as tx
from lossloom.operators import batch as bt
from lossloom.operators import planner as pl
from lossloom.operators.ledger import known_categories
from lossloom.operators.policy import apply_tag_groups
from lossloom.operators.ranking import top_n
from lossloom.params import DEFAULTS, Params
from lossloom.plans.workspace import settle

SLOT = ["section_id", "round_id", "slot_id"]
ATTEMPT = (
    "section_id string, round_id int, slot_id int, attempt int, status string, reason string, sample string, "
    "instruct string, gold_summary string, tag string"
)
REQUEST = "section_id string, round_id int, slot_id int, attempt int, slots bigint, prompt string, cache_key string"


# --- slots and attempts -----------------------------------------------------------------------


def wanted_slots(recipe: DataFrame, contextual: DataFrame | None = None) -> DataFrame:
    """The generate slots of a recipe, whether each explores, and the one that must hold a passage (``contextual``)."""
    items = pl.generation_items(recipe)
    if contextual is None:
        items = items.withColumn("contextual_slot_id", F.lit(None).cast("int"))
    else:
        items = items.join(contextual, ["section_id", "round_id"], "left")
    explores = tx.is_wide_variety("tag")
    return items.select(
        *SLOT, "generation_index", "tag", explores.alias("is_exploration"),
        (explores & F.coalesce(F.col("slot_id") == F.col("contextual_slot_id"), F.lit(False))).alias("forced"),
    )


def open_slots(wanted: DataFrame, attempts: DataFrame, attempt: int, p: Params = DEFAULTS) -> DataFrame:
    """Wanted slots that no attempt has filled and that may still be asked for."""
    filled = attempts.where("status = 'accepted'").select(*SLOT)
    may = F.lit(True) if attempt <= 1 else F.col("is_exploration") & (attempt <= p.generation_attempts)
    return wanted.where(may).join(filled, SLOT, "left_anti")


def accepted_rows(attempts: DataFrame) -> DataFrame:
    return attempts.where("status = 'accepted'")


def judge_answers(
    wanted: DataFrame, attempts: DataFrame, answers: DataFrame, counts: DataFrame, round_tags: DataFrame,
    attempt: int, p: Params = DEFAULTS,
) -> DataFrame:
    """One row per open slot: ``status`` accepted, rejected (by the diversity rules) or missing, and why.

    ``answers``: ``section_id, round_id, response`` and, after attempt 0, ``slot_id``. ``attempts`` are the rows of earlier
    attempts; what they accepted counts as used in the round and in the section. An answer row whose content is not usable
    leaves its slot missing under the reason of the row; a slot without any row has ``no_answer``, or the fault of the whole
    response. On the last attempt a rejected exploration answer is accepted as ``after_limit: <rule>``.
    """
    here = settle(open_slots(wanted, attempts, attempt, p))
    taken = accepted_rows(attempts).select("section_id", "round_id", "tag")
    now = counts.select("section_id", "tag", "n").unionByName(taken.groupBy("section_id", "tag").agg(F.count("*").alias("n")))
    now = settle(now.groupBy("section_id", "tag").agg(F.sum("n").alias("n")))
    raw, items = answers.select("section_id", "round_id", "response", *(["slot_id"] if attempt else [])), here
    if attempt:  # an answer to a single request is for its slot, whatever it says; each is read as a batch of one
        raw, items = _single(raw), _single(here)
    good, bad = bt.ingest_responses(raw, items.select(*SLOT, "generation_index", "tag"), None, p, own_ids=not attempt)
    if attempt:
        good, bad = _whole(good), _whole(bad)
    blank = tx.is_blank("sample")  # a batch refuses it, so it is asked for again
    bad = bad.select(*SLOT, "row_index", "reason").unionByName(
        good.where(blank).select(*SLOT, F.lit(None).cast("int").alias("row_index"), F.lit("missing_sample").alias("reason"))
    )
    good = bt.conform_tags(good.where(~blank), now, p)
    rows = good.join(here.select(*SLOT, "is_exploration", "forced"), SLOT)
    used = round_tags.select("section_id", "round_id", "tag").unionByName(taken)
    judged = settle(bt.accept_diverse(rows, now, used, p))
    last = attempt >= p.generation_attempts
    status = F.when(F.col("accepted") | F.lit(last), "accepted").otherwise("rejected")
    why = F.when(F.col("accepted"), F.lit(None)).when(F.lit(last), F.concat(F.lit("after_limit: "), "reject_reason")).otherwise(F.col("reject_reason"))
    answered = judged.select(*SLOT, status.alias("status"), why.alias("reason"), "sample", "instruct", "gold_summary", "tag")
    faults = bad.where("reason <> 'duplicate_slot_id'").groupBy(*SLOT).agg(F.max_by("reason", F.coalesce("row_index", F.lit(-1))).alias("_fault"))
    whole = faults.where("slot_id is null").select("section_id", "round_id", F.col("_fault").alias("_whole"))
    missing = (
        here.select(*SLOT).join(answered.select(*SLOT), SLOT, "left_anti")
        .join(faults, SLOT, "left").join(whole, ["section_id", "round_id"], "left")
        .select(*SLOT, F.lit("missing").alias("status"), F.coalesce("_fault", "_whole", F.lit("no_answer")).alias("reason"))
    )
    rows = answered.unionByName(missing, allowMissingColumns=True).withColumn("attempt", F.lit(attempt))
    return rows.select(*(c.split()[0] for c in ATTEMPT.split(", ")))


def _single(df: DataFrame) -> DataFrame:
    """Every slot as a section of its own."""
    return df.withColumn("section_id", F.to_json(F.struct("section_id", "slot_id")))


def _whole(df: DataFrame) -> DataFrame:
    named = F.from_json("section_id", "section_id string, slot_id int")  # _single undone
    return df.withColumn("_named", named).withColumns({"section_id": F.col("_named.section_id"), "slot_id": F.col("_named.slot_id")}).drop("_named")


def unfilled(wanted: DataFrame, attempts: DataFrame) -> DataFrame:
    """Slots that every attempt left open, with the reason of the last one."""
    left = wanted.select(*SLOT).join(accepted_rows(attempts).select(*SLOT), SLOT, "left_anti")
    last = attempts.groupBy(*SLOT).agg(F.max_by("reason", "attempt").alias("reason"))
    return left.join(last, SLOT, "left").select(*SLOT, F.coalesce("reason", F.lit("not_requested")).alias("reason"))


# --- requests ---------------------------------------------------------------------------------


def attempt_requests(
    wanted: DataFrame, attempts: DataFrame, blueprints: DataFrame, counts: DataFrame, round_tags: DataFrame,
    attempt: int, instructions: DataFrame | None = None, cache: DataFrame | None = None, p: Params = DEFAULTS,
) -> DataFrame:
    """Requests for the slots that are open: one per batch at attempt 0, one per slot after that.

    Exploration slots are told which tags the round has used, which dominate the section, and which of their attempts were
    rejected. With ``cache`` single requests carry ``cached`` and ``response``.
    """
    here = open_slots(wanted, attempts, attempt, p)
    used = round_tags.select("section_id", "round_id", "tag").unionByName(accepted_rows(attempts).select("section_id", "round_id", "tag"))
    used = used.groupBy("section_id", "round_id", "tag").agg(F.count("*").alias("_n")).where(F.col("_n") >= p.tags_per_round)
    used = used.groupBy("section_id", "round_id").agg(F.collect_list("tag").alias("_used"))  # tags of one round's rows
    dominant = pl.dominant_tags(known_categories(counts), p).groupBy("section_id").agg(F.collect_list("tag").alias("_dominant"))  # 1 / share of them
    cut = lambda name, n: F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), "\n", " "), 1, n).alias(name)
    tried = attempts.where("status = 'rejected'").groupBy(*SLOT).agg(
        F.array_sort(F.collect_list(F.struct("attempt", cut("tag", 80), cut("reason", 160), cut("instruct", 220), cut("sample", 220)))).alias("_tried")
    )
    none = F.array().cast("array<string>")
    empty = F.array().cast("array<struct<attempt:int,tag:string,reason:string,instruct:string,sample:string>>")
    rows = (
        blueprints.join(here.select(*SLOT, "is_exploration"), SLOT)
        .join(used, ["section_id", "round_id"], "left").join(dominant, "section_id", "left").join(tried, SLOT, "left")
    )
    lines = pl.exploration_text(F.coalesce("_used", none), F.coalesce("_dominant", none), F.col("forced"), F.coalesce("_tried", empty))
    rows = rows.withColumn("extra_constraints", F.when(F.col("is_exploration"), lines)).drop("is_exploration", "_used", "_dominant", "_tried")
    asked = bt.generation_requests(rows, counts, instructions, None, p=p)
    if attempt:
        single = asked.select(*SLOT, F.lit(attempt).alias("attempt"), F.lit(1).cast("bigint").alias("slots"), "prompt", "cache_key")
        return single if cache is None else bt.cache_lookup(single, cache)
    batch = bt.request_payload(asked)
    key = tx.request_key("payload", p.model_id, p.cache_version, p.temperature)
    return batch.select(
        "section_id", "round_id", F.lit(None).cast("int").alias("slot_id"), F.lit(0).alias("attempt"), "slots",
        F.col("payload").alias("prompt"), key.alias("cache_key"),
    )


# --- grouped tags -----------------------------------------------------------------------------

TAG_LIST_TEMPLATE = """These are tags of training samples with their average loss, worst first.

***tag_list***

Join tags that name the same weakness. Answer with one JSON object: "top_tags", a list of at most ***limit***
objects with "tag", "avg_loss" (the mean over the group) and "source_tags" (names from the list, each at most once).
"""


def tag_list_requests(metrics: DataFrame, template: str = TAG_LIST_TEMPLATE, p: Params = DEFAULTS) -> DataFrame:
    """One request per section: its ``tag_list_limit`` worst tags as JSON, to be grouped by an outside model."""
    order = [F.col("avg_loss").desc(), F.col("oldest_ledger_id"), F.col("tag")]
    listed = top_n(metrics, ["section_id"], order, p.tag_list_limit, "_place").groupBy("section_id").agg(
        F.array_sort(F.collect_list(F.struct("_place", "tag", F.round("avg_loss", 6).alias("loss")))).alias("_rows")
    )
    rows = F.to_json(F.transform("_rows", lambda x: F.struct(x["tag"].alias("tag"), x["loss"].alias("loss"))))
    prompt = tx.render(template, {"tag_list": rows, "limit": F.lit(p.tag_group_limit)})
    asked = listed.select("section_id", F.size("_rows").alias("tags"), prompt.alias("prompt"))
    return asked.withColumn("cache_key", tx.request_key("prompt", p.model_id, p.cache_version, p.temperature))


def parse_tag_groups(answers: DataFrame, metrics: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(groups, problems) from one answer per section (``section_id, response``; of several the last by text is read).

    An answer is refused as a whole: ``invalid_json``, ``no_top_tags`` (not a list), ``no_avg_loss`` (an entry without a
    number) or ``no_groups`` (no entry is an object with a tag). With ``strict`` also ``unknown_source_tag`` and
    ``repeated_source_tag``. Entries that are no objects or have no tag are passed over. Without a list of source tags an
    entry stands for the tag of its own name.
    """
    one = answers.groupBy("section_id").agg(F.max("response").alias("response"))
    parsed = one.withColumn("value", tx.strict_json(tx.strip("response")))
    entries = F.try_variant_get("value", "$.top_tags", "array<variant>")
    rows = parsed.withColumn("_entries", entries).select(
        "section_id", F.col("value").isNull().alias("_broken"), F.col("_entries").isNull().alias("_none"), F.posexplode_outer("_entries").alias("_at", "_e")
    )
    tag = tx.blank_to_null(tx.strip(F.try_variant_get("_e", "$.tag", "string")))
    sources = F.try_variant_get("_e", "$.source_tags", "array<string>")
    cleaned = F.filter(F.transform("_sources", lambda x: tx.strip(x)), lambda x: x != "")
    entry = rows.select(
        "section_id", "_broken", "_none", "_at", tag.alias("tag"), F.try_variant_get("_e", "$.avg_loss", "double").alias("avg_loss"), sources.alias("_sources")
    ).withColumn("source_tags", cleaned)
    entry = settle(entry.drop("_sources"))  # a few entries a section, read several times below
    named = entry.where("tag is not null")
    faults = entry.groupBy("section_id").agg(
        F.bool_or("_broken").alias("_broken"), F.bool_or("_none").alias("_none"), F.count("tag").alias("_named"),
        F.count_if(F.col("tag").isNotNull() & (F.col("avg_loss").isNull() | F.isnan("avg_loss"))).alias("_numberless"),
    )
    reason = (
        F.when(F.col("_broken"), "invalid_json").when(F.col("_none"), "no_top_tags").when(F.col("_numberless") > 0, "no_avg_loss")
        .when(F.col("_named") == 0, "no_groups")
    )
    told = faults.select("section_id", reason.alias("reason"))
    if strict:
        used = named.select("section_id", F.explode(F.coalesce("source_tags", F.array("tag"))).alias("tag")).groupBy("section_id", "tag").agg(F.count("*").alias("_n"))
        known = metrics.select("section_id", "tag", F.lit(True).alias("_known"))
        checked = used.join(known, ["section_id", "tag"], "left").groupBy("section_id").agg(
            F.bool_or(F.col("_known").isNull()).alias("_unknown"), F.max("_n").alias("_most")
        )
        own = F.when(F.col("_unknown"), "unknown_source_tag").when(F.col("_most") > 1, "repeated_source_tag")
        told = told.join(checked, "section_id", "left").select("section_id", F.coalesce("reason", own).alias("reason"))
    told = settle(told)
    groups = named.join(told.where("reason is null").select("section_id"), "section_id", "left_semi")
    return groups.select("section_id", "tag", "avg_loss", "source_tags"), told.where("reason is not null")


def grouped_metrics(metrics: DataFrame, answers: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(metrics, problems): grouped where a section's answer holds, the section's own metrics where it fails or is not there.

    ``problems`` lists every section that falls back, with ``no_answer`` for those without one.
    """
    groups, problems = parse_tag_groups(answers, metrics, strict)
    silent = metrics.select("section_id").distinct().join(answers.select("section_id"), "section_id", "left_anti")
    return apply_tag_groups(metrics, groups), problems.unionByName(silent.withColumn("reason", F.lit("no_answer")))
