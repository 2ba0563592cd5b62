"""The resumable round loop over stage tables.

Each step closes one round of every section. A stage is done when its table for the step is there,
so an interrupted run goes on where it stopped, and repeating a step rewrites only its own tables.
What a step needs of the past it finds in the tables of the step before (see ``operators.sums``), so a step costs the same
however many there were.
Sections may be at different rounds: ``step`` numbers runs of the loop, ``round_id`` is per section.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom import schemas
from lossloom.functions import shape as sh
from lossloom.operators import batch as bt
from lossloom.operators import examples as ex
from lossloom.operators import generation as gen
from lossloom.operators import health as hl
from lossloom.operators import ledger as lg
from lossloom.operators import planner as pl
from lossloom.operators import policy as po
from lossloom.operators import sums as sm
from lossloom.operators import vault as vt
from lossloom.params import DEFAULTS, Params
from lossloom.plans.workspace import path_exists, settle
from lossloom.sources.files import read_table

_STATE = "section_id string, current_round int, consecutive_no_recycle int"
_EASY = "section_id string, easy_batch double"
_COMPLETE = "section_id string, last_complete int"
_RECYCLED = "section_id string, ledger_id bigint, round_id int"
_TEXTS = "section_id string, ledger_id bigint, sample string, instruct string, gold_summary string, tag string"
_BATCH = schemas.BATCH + ", sample_id bigint, batch_pos int"


class StageTables:
    """Stage tables under one root: ``root/<table>/step=<n>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def done(self, table: str, step: int) -> bool:
        return path_exists(self.spark, f"{self.root}/{table}/step={step}/_SUCCESS")

    def write(self, df: DataFrame, table: str, step: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/step={step}")

    def at(self, table: str, step: int, schema: str) -> DataFrame:
        return read_table(self.spark, f"{self.root}/{table}/step={step}", schema)

    def upto(self, table: str, step: int, schema: str) -> DataFrame:
        """All rows of the steps up to ``step``, pruned by partition."""
        table_path = f"{self.root}/{table}"
        return read_table(self.spark, table_path, schema + ", step int").where(F.col("step") <= step).drop("step")

    def next_step(self) -> int:
        step = 1
        while self.done("state", step):
            step += 1
        return step


def start(tables: StageTables, sections: DataFrame) -> None:
    """Write step 0: every section at round 0. The other tables of step 0 are empty and are not written."""
    if not tables.done("state", 0):
        first = sections.select("section_id").distinct()
        tables.write(first.select("section_id", F.lit(0).alias("current_round"), F.lit(0).alias("consecutive_no_recycle")), "state", 0)


def plan_recipe(
    tables: StageTables, step: int, profiles: DataFrame | None, weakness: DataFrame | None, p: Params,
    tag_answers: DataFrame | None = None,
) -> None:
    """The recipe of a step, from the tables that the step before left; no earlier step is read.

    With ``tag_answers`` (``section_id, response``) tags are grouped as the answers say, section by section.
    """
    spark = tables.spark
    state, vault = tables.at("state", step - 1, _STATE), tables.at("vault", step - 1, schemas.VAULT)
    sums = tables.at("tag_sums", step - 1, sm.TAG_SUMS)
    counts = sm.counts_of(sums)
    rounds = state.select("section_id", "current_round")
    if profiles is None:
        profiles = spark.createDataFrame(
            [], "section_id string, shape_id string, confidence double, focus_tag string, tag_aliases array<string>"
        )
    if weakness is None:
        weakness = spark.createDataFrame([], "section_id string, rank int, tag string")

    now = settle(sm.health_now(tables.at("health", step - 1, sm.HEALTH_STATE)))  # one row per section
    tables.write(sm.base_of(tables.at("complete", step - 1, _COMPLETE), now, rounds), "base_checkpoints", step)  # where training starts from
    zero = F.lit(0.0)
    if not tables.done("pressure", step):
        scores = (
            po.starvation_score(vault, rounds, p)
            .join(tables.at("easy", step - 1, _EASY), "section_id", "left")
            .join(now.select("section_id", "validation_plateau"), "section_id", "left")
            .join(po.shape_gap_of_counts(sm.declared_of(sums), profiles, p).select("section_id", "shape_gap"), "section_id", "left")
            .join(rounds, "section_id")
            .select(
                "section_id", F.col("current_round").alias("round_id"), "vault_starvation",
                *(F.coalesce(c, zero).alias(c) for c in ("easy_batch", "validation_plateau", "shape_gap")),
            )
        )
        tables.write(sm.pressure_step(tables.at("pressure", step - 1, sm.PRESSURE_STATE), scores, p), "pressure", step)
    modal = vt.vault_analytics(vault, rounds, p).select("section_id", "most_problematic_category")
    pressure = (
        sm.last_round(tables.at("pressure", step, sm.PRESSURE_STATE))
        .join(rounds.withColumnRenamed("current_round", "round_id"), ["section_id", "round_id"])
        .withColumn("hard_slots", F.when(F.col("hard_active"), min(p.hard_slots, p.batch_size)).otherwise(0))
        .join(profiles.select("section_id", "focus_tag"), "section_id", "left")
        .join(modal, "section_id", "left")
        .withColumn("hard_focus_tag", po.hard_focus_tag("focus_tag", "most_problematic_category"))
    )
    pressure = settle(pressure)  # one row per section
    weakness_input = now.select("section_id", "latest_action", "improvement", "validation_plateau").join(
        tables.at("easy", step - 1, _EASY), "section_id", "left"
    ).select("section_id", "latest_action", "improvement", F.coalesce("easy_batch", zero).alias("easy_batch"), "validation_plateau")
    metrics = po.with_vault_metrics(sm.metrics_of(sums), vault)
    if tag_answers is not None:
        metrics, problems = gen.grouped_metrics(settle(metrics), tag_answers)
        tables.write(problems, "tag_problems", step)
    plan = po.tag_plan(rounds, po.allocate_slots(metrics, p), counts, p)
    there = tables.at("vault_texts", step - 1, _TEXTS)
    later = po.build_recipe(rounds, plan, po.recycle_picks(vault, there, rounds, p), weakness_input, weakness, pressure, p)
    seen = tables.at("section_sums", step - 1, sm.SECTION_SUMS).select("section_id")
    first = po.first_recipe(rounds.join(seen, "section_id", "left_anti"), counts, p)
    tables.write(later.join(seen, "section_id", "left_semi").unionByName(first.select(*later.columns)), "recipe", step)


def fill_batch(tables: StageTables, step: int, pool: DataFrame, p: Params) -> None:
    """Recycled rows and pool rows; text is joined last."""
    recipe = tables.at("recipe", step, schemas.RECIPE)
    used = tables.upto("batch", step - 1, _BATCH).where(F.col("sample_id").isNotNull())  # only the ids are read
    counts = sm.counts_of(tables.at("tag_sums", step - 1, sm.TAG_SUMS))
    # a few rows per section, read four times below; settled, its size is known before the pool's texts are joined
    chosen = settle(bt.select_from_pool(recipe, pool, counts, used.select("section_id", "sample_id"), p=p))
    text = pool.select("section_id", "sample_id", "sample", "instruct", "gold_summary")
    generated = chosen.where(F.col("sample_id").isNotNull()).join(text, ["section_id", "sample_id"]).withColumns(
        {"source": F.lit("generated"), "source_ledger_id": F.lit(None).cast("bigint")}
    )
    ids = chosen.select("section_id", "round_id", "slot_id", "sample_id")
    open_ = chosen.where(F.col("sample_id").isNull()).select("section_id", "round_id", "slot_id", F.lit("pool_exhausted").alias("reason"))
    _write_batch(tables, step, generated, ids, open_, p)


def _recycled(tables: StageTables, step: int) -> tuple[DataFrame, DataFrame]:
    return bt.fetch_recycled(tables.at("recipe", step, schemas.RECIPE), tables.at("vault_texts", step - 1, _TEXTS))


def _write_batch(tables: StageTables, step: int, generated: DataFrame, ids: DataFrame, open_: DataFrame, p: Params) -> None:
    recycled, missing = _recycled(tables, step)
    batch, rejected = bt.assemble_batch(recycled, generated, step)
    keys = ["section_id", "round_id", "slot_id"]
    problems = (
        missing.select(*keys, "reason")
        .unionByName(open_)
        .unionByName(rejected.select(*keys, F.array_join("violations", ",").alias("reason")))
    )
    tables.write(batch.join(ids, keys, "left").select(*schemas.columns(_BATCH)), "batch", step)
    gates = gate_problems(tables.at("recipe", step, schemas.RECIPE), tables.at("batch", step, _BATCH), p)
    tables.write(problems.unionByName(gates), "batch_problems", step)


def fill_from_generator(
    tables: StageTables, step: int, examples: DataFrame, profiles: DataFrame, modes: DataFrame, weakness: DataFrame | None, p: Params,
    generate: Callable[[DataFrame], DataFrame] | None = None,
) -> bool:
    """Fill the generate slots from an outside generator; False while an answer is awaited.

    For each attempt there is a table ``requests_<attempt>`` (gen.REQUEST) and, once someone has written it, a table
    ``responses_<attempt>`` (``section_id, round_id, slot_id, response``) of the step; ``generate`` may make the second from the
    first. Judged answers are kept in ``attempts_<attempt>``. Nothing that is there is done again.
    """
    spark = tables.spark
    recipe = tables.at("recipe", step, schemas.RECIPE)
    counts = sm.counts_of(tables.at("tag_sums", step - 1, sm.TAG_SUMS))
    contextual = ex.contextual_slot(recipe, examples)
    wanted = settle(gen.wanted_slots(recipe, contextual))
    round_tags = _recycled(tables, step)[0].select("section_id", "round_id", "tag")
    if not tables.done("blueprints", step):
        categories = weakness if weakness is not None and "shape_id" in weakness.columns else spark.createDataFrame([], "section_id string, rank int, tag string, shape_id string, avg_loss double, max_loss double")
        recent = spark.createDataFrame([], schemas.LEDGER)
        for k in range(max(1, step - p.vault_refill_rounds), step):  # what recent texts the planner shows come from the last rounds
            recent = recent.unionByName(tables.at("ledger", k, schemas.LEDGER))
        shape = pl.effective_profile(profiles, modes)
        tables.write(pl.plan_blueprints(recipe, counts, modes, shape, categories, contextual, recent, p=p), "blueprints", step)
    blueprints = spark.read.parquet(f"{tables.root}/blueprints/step={step}")
    done = spark.createDataFrame([], gen.ATTEMPT)
    answer = "section_id string, round_id int, slot_id int, response string"
    for attempt in range(p.generation_attempts + 1):
        asked, told, judged = (f"{name}_{attempt}" for name in ("requests", "responses", "attempts"))
        if not tables.done(asked, step):
            rows = gen.attempt_requests(wanted, done, blueprints, counts, round_tags, attempt, p=p)
            tables.write(rows.select(*schemas.columns(gen.REQUEST)), asked, step)
        requests = tables.at(asked, step, gen.REQUEST)
        if not tables.done(told, step):
            if not requests.isEmpty():
                if generate is None:
                    return False
                tables.write(generate(requests).select(*schemas.columns(answer)), told, step)
        if not tables.done(judged, step):
            answers = tables.at(told, step, answer) if tables.done(told, step) else spark.createDataFrame([], answer)
            tables.write(gen.judge_answers(wanted, done, answers, counts, round_tags, attempt, p), judged, step)
        done = done.unionByName(tables.at(judged, step, gen.ATTEMPT))
    generated = gen.accepted_rows(done).select(*gen.SLOT, "sample", "instruct", "gold_summary", "tag").withColumns(
        {"source": F.lit("generated"), "source_ledger_id": F.lit(None).cast("bigint")}
    )
    ids = wanted.select(*gen.SLOT, F.lit(None).cast("bigint").alias("sample_id"))
    _write_batch(tables, step, generated, ids, gen.unfilled(wanted, done), p)
    return True


def gate_problems(recipe: DataFrame, batch: DataFrame, p: Params) -> DataFrame:
    """Recipes and batches that break a rule: ``section_id, round_id, slot_id, reason``, without a slot."""
    no_slot = F.lit(None).cast("int").alias("slot_id")
    broken = po.validate_recipe(recipe, p).where("not valid")
    told = F.format_string("invalid_recipe: %d slots, %d broken", "slot_count", "bad_slots")
    sizes = bt.validate_batch_size(batch, p)
    wrong = sizes.where("not exact or missing_gold > 0")
    size = F.format_string("batch_of_%d: %d without gold", "size", "missing_gold")
    return broken.select("section_id", "round_id", no_slot, told.alias("reason")).unionByName(
        wrong.select("section_id", "round_id", no_slot, size.alias("reason"))
    )


def close_round(
    tables: StageTables, step: int, p: Params = DEFAULTS, validation: DataFrame | None = None, checkpoints: DataFrame | None = None
) -> None:
    """Append finite evaluations, add them to the sums, rebuild the vault, judge the round and advance.

    Reads the step before, and the ledger of as many steps as the vault is refilled from. ``checkpoints`` (``section_id,
    round_id, complete``) says which rounds left a whole checkpoint; without it all did, with it those that it names as complete.
    The state table is written last and marks the step as done.
    """
    state = tables.at("state", step - 1, _STATE)
    recipe = tables.at("recipe", step, schemas.RECIPE)
    totals = tables.at("section_sums", step - 1, sm.SECTION_SUMS)
    kept, dropped = lg.split_finite(tables.at("evaluations", step, schemas.EVALUATION))
    if not tables.done("ledger", step):
        highest = totals.select("section_id", F.col("last_ledger_id").alias("ledger_id"))
        tables.write(lg.assign_ids(kept, highest).select(*schemas.columns(schemas.LEDGER)), "ledger", step)
        tables.write(lg.evaluation_events(dropped), "events", step)
    new = tables.at("ledger", step, schemas.LEDGER)
    tables.write(sm.add_tag_sums(tables.at("tag_sums", step - 1, sm.TAG_SUMS), new), "tag_sums", step)
    tables.write(sm.add_section_sums(totals, new), "section_sums", step)
    easy = po.easy_batch_score(new, "section_id", p=p).select("section_id", "easy_batch")
    idle = tables.at("easy", step - 1, _EASY).join(new.select("section_id").distinct(), "section_id", "left_anti")
    tables.write(easy.unionByName(idle), "easy", step)
    tables.write(sm.new_recycled(recipe, tables.upto("recycled", step - 1, _RECYCLED)), "recycled", step)
    committed, advanced = po.commit_recipe(recipe, tables.at("vault", step - 1, schemas.VAULT), state, p)
    rounds = state.select("section_id", "current_round")
    recent = new
    for k in range(max(1, step - p.vault_refill_rounds + 1), step):
        recent = recent.unionByName(tables.at("ledger", k, schemas.LEDGER))
    if not tables.done("vault", step):
        tables.write(vt.build_vault(recent, kept, committed, rounds, p), "vault", step)
    vault = tables.at("vault", step, schemas.VAULT)
    names = schemas.columns(_TEXTS)
    texts = tables.at("vault_texts", step - 1, _TEXTS).join(recent.select("section_id", "ledger_id"), ["section_id", "ledger_id"], "left_anti")
    texts = texts.select(*names).unionByName(recent.select(*names))
    tables.write(texts.join(vault.select("section_id", "ledger_id"), ["section_id", "ledger_id"], "left_semi").select(*names), "vault_texts", step)
    if not tables.done("round_losses", step):
        losses = hl.round_losses(new, validation)
        if checkpoints is None:
            losses = losses.withColumn("complete", F.lit(True))
        else:
            whole = checkpoints.where("complete").select("section_id", F.col("round_id").cast("int").alias("round_id"), F.lit(True).alias("complete")).distinct()
            losses = losses.join(whole, ["section_id", "round_id"], "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
        tables.write(losses.select(*schemas.columns(schemas.ROUND_LOSS)), "round_losses", step)
    losses = tables.at("round_losses", step, schemas.ROUND_LOSS)
    tables.write(sm.health_step(tables.at("health", step - 1, sm.HEALTH_STATE), losses, p), "health", step)
    tables.write(sm.complete_rounds(tables.at("complete", step - 1, _COMPLETE), losses), "complete", step)
    tables.write(
        advanced.select("section_id", (F.col("current_round") + 1).alias("current_round"), "consecutive_no_recycle"), "state", step
    )


def run_rounds(
    spark: SparkSession, root: str, pool: DataFrame, score: Callable[[DataFrame], DataFrame], n: int = 1,
    examples: DataFrame | None = None, weakness: DataFrame | None = None, stop_after_batch: bool = False,
    p: Params = DEFAULTS, validation: DataFrame | None = None, checkpoints: DataFrame | None = None,
) -> StageTables:
    """Run ``n`` rounds of every section in the pool, resuming what is unfinished.

    ``pool``: ``section_id, sample_id, tag, score, sample, instruct, gold_summary``. ``score`` adds
    ``loss`` and ``token_length`` to batch rows. ``validation`` (``section_id, round_id, validation_loss``) decides on health
    and rollback where it has a loss for a round, and ``checkpoints`` on which rounds can be gone back to. Short batches and
    broken recipes are noted in ``batch_problems``; the checkpoint each step starts from is in ``base_checkpoints``.
    """
    tables = StageTables(spark, root)
    start(tables, pool)
    profiles = _profiles(examples)
    for _ in range(n):
        step = tables.next_step()
        if not tables.done("recipe", step):
            plan_recipe(tables, step, profiles, weakness, p)
        if not tables.done("batch_problems", step):
            fill_batch(tables, step, pool, p)
        if stop_after_batch:
            break
        _score_and_close(tables, step, score, p, validation, checkpoints)
    return tables


def _profiles(examples: DataFrame | None) -> DataFrame | None:
    return None if examples is None else sh.shape_profile(examples, "section_id", pos="pos", source="original_user_examples")


def _score_and_close(tables, step, score, p, validation, checkpoints) -> None:
    if not tables.done("evaluations", step):
        scored = score(tables.at("batch", step, _BATCH)).withColumn("student_ans", F.lit(""))
        names = schemas.columns(schemas.EVALUATION)
        typed = scored.withColumn("slot_id", F.col("slot_id").cast("bigint"))
        tables.write(typed.select(*names), "evaluations", step)
    close_round(tables, step, p, validation, checkpoints)


def run_generated(
    spark: SparkSession, root: str, examples: DataFrame, score: Callable[[DataFrame], DataFrame], n: int = 1,
    generate: Callable[[DataFrame], DataFrame] | None = None, weakness: DataFrame | None = None, modes: DataFrame | None = None,
    p: Params = DEFAULTS, validation: DataFrame | None = None, checkpoints: DataFrame | None = None,
    tag_answers: DataFrame | None = None,
) -> tuple[StageTables, bool]:
    """Run rounds of every section in ``examples`` whose samples an outside generator writes.

    ``examples`` are a section's seed examples (``section_id, pos, sample, output, instruct, context, mode``). With ``generate``,
    which adds ``response`` to request rows, all ``n`` rounds run through. ``modes`` may configure a section's task mode. Without it the run stops where an answer is awaited
    and returns False; once ``responses_<attempt>`` is written, the same call goes on. ``tag_answers`` group the tags of the
    next recipe.
    """
    tables = StageTables(spark, root)
    start(tables, examples)
    profiles = settle(_profiles(examples))
    modes = settle(ex.resolve_task_mode(examples, modes))
    for _ in range(n):
        step = tables.next_step()
        if not tables.done("recipe", step):
            plan_recipe(tables, step, profiles, weakness, p, tag_answers)
        if not tables.done("batch_problems", step) and not fill_from_generator(tables, step, examples, profiles, modes, weakness, p, generate):
            return tables, False
        _score_and_close(tables, step, score, p, validation, checkpoints)
    return tables, True
