"""Queries over examples, recipes, blueprints, responses, pools and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossloom import fixed_values as fx
from lossloom import schemas
from lossloom.catalog import sql as q
from lossloom.catalog.adapters import Tables, section_of
from lossloom.catalog.core_queries import new_vault, pressure_scores
from lossloom.catalog.registry import register, text
from lossloom.catalog.text_queries import weakness
from lossloom.functions import shape as sh
from lossloom.functions import text as tx
from lossloom.operators import batch as bt
from lossloom.operators import examples as ex
from lossloom.operators import health as hl
from lossloom.operators import ledger as lg
from lossloom.operators import planner as pl
from lossloom.operators import policy as po
from lossloom.operators import score as sc

# --- recipe -----------------------------------------------------------------------------------


def weakness_input(t: Tables):
    """Latest action, improvement and scores of every section."""
    rounds = t.round_losses()
    last = hl.latest_health(hl.round_health(rounds)).select("section_id", "round_id", F.col("action").alias("latest_action"))
    return (
        last.join(hl.improvement(rounds).select("section_id", "round_id", "improvement"), ["section_id", "round_id"], "left")
        .join(t.once("pressure_in", lambda: pressure_scores(t)).select("section_id", "round_id", "easy_batch", "validation_plateau"), ["section_id", "round_id"], "left")
        .drop("round_id")
    )


q.PARTS["weak_in"] = """
    SELECT h.section_id, h.round_id, h.action AS latest_action, e.easy_batch, e.validation_plateau,
           (p.decision_loss - h.decision_loss) / p.decision_loss AS improvement
    FROM (SELECT * FROM health QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY round_id DESC) = 1) h
    LEFT JOIN health_in p ON p.section_id = h.section_id AND p.round_id = h.round_id - 1
    LEFT JOIN pressure_in e ON e.section_id = h.section_id AND e.round_id = h.round_id"""
q.PARTS["weak_tags"] = f"""
    SELECT section_id, list({q.strip('tag')} ORDER BY rank) AS tags FROM (
      SELECT * FROM weakness WHERE NOT {q.explore('tag')} QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY rank) <= 3) GROUP BY 1"""


def weak_sql(capacity: str, source: str) -> str:
    """Slots and tags for weak categories, as columns over ``source`` joined with the inputs."""
    bad = "i.latest_action IN ('degraded', 'rollback_next', 'rollback_unavailable')"
    flat = "coalesce(i.easy_batch, 0) >= 0.8 AND coalesce(i.validation_plateau, 0) >= 0.8"
    up = "coalesce(i.improvement, 0) >= 0.03 OR i.latest_action = 'new_best'"
    return f"""SELECT s.*, w.tags,
        CASE WHEN {capacity} <= 0 OR w.tags IS NULL THEN 0.0 WHEN {bad} THEN 0.2 WHEN {flat} THEN 0.5 WHEN {up} THEN 0.45
             WHEN coalesce(i.improvement, 0) > 0 THEN 0.35 ELSE 0.3 END::DOUBLE AS fraction,
        CASE WHEN {capacity} <= 0 OR w.tags IS NULL THEN 'no_capacity_or_profile' WHEN {bad} THEN 'health_' || i.latest_action
             WHEN {flat} THEN 'easy_training_validation_plateau' WHEN {up} THEN 'validation_improving'
             WHEN coalesce(i.improvement, 0) > 0 THEN 'validation_slightly_improving' ELSE 'base' END AS reason
        FROM {source} s LEFT JOIN weak_in i USING (section_id) LEFT JOIN weak_tags w USING (section_id)"""


WEAK_COUNT = "CASE WHEN reason = 'no_capacity_or_profile' THEN 0 ELSE CAST(least(greatest(1, round_even({c} * fraction, 0)), {c}, 4) AS INTEGER) END"
WEAK_LIST = "list_resize(list_concat(tags, tags, tags, tags), " + WEAK_COUNT + ")"

register(
    "weakness_slots",
    lambda t: po.weakness_slots(
        weakness_input(t).withColumn("capacity", F.substring("section_id", 9, 3).cast("int") % 11), weakness(t)
    ).select("section_id", "fraction", "reason", "slot_count", text("weakness_tags")),
    f"""SELECT section_id, fraction, reason, {WEAK_COUNT.format(c='cap')} AS slot_count,
        coalesce(array_to_string({WEAK_LIST.format(c='cap')}, '|'), '') AS weakness_tags
        FROM ({weak_sql('s.cap', "(SELECT section_id, CAST(substr(section_id, 9, 3) AS INTEGER) % 11 AS cap FROM rounds)")})""",
)


def pressure_now(t: Tables):
    """Hard slots of the last round; the focus tag comes from the shape profile or the vault."""
    last = po.learning_pressure(t.once("pressure_in", lambda: pressure_scores(t))).join(
        t.rounds().select("section_id", F.col("current_round").alias("round_id")), ["section_id", "round_id"]
    )
    profile = sh.shape_profile(t.shaped_records(), "section_id", pos="record_id", source="x", classified=True).select("section_id", "focus_tag")
    modal = t.vault().groupBy("section_id").agg(F.max_by("tag", "ledger_id").alias("modal"))
    return last.join(profile, "section_id", "left").join(modal, "section_id", "left").select(
        "section_id", "hard_slots", po.hard_focus_tag("focus_tag", "modal").alias("hard_focus_tag")
    )


_FOCUS = "(VALUES " + ", ".join(f"('{s}', '{d[5]}')" for s, d in fx.SHAPE_DESCRIPTORS.items()) + ") AS d(s, focus)"
q.PARTS["pressure_now"] = f"""
    SELECT p.section_id, CASE WHEN hard_active THEN 3 ELSE 0 END AS hard_slots,
           coalesce(nullif(d.focus, 'wide_variety'), m.tag) AS hard_focus_tag
    FROM pressure p JOIN rounds r ON r.section_id = p.section_id AND r.current_round = p.round_id
    LEFT JOIN profiles f ON f.section_id = p.section_id LEFT JOIN {_FOCUS} ON d.s = f.shape_id
    LEFT JOIN (SELECT section_id, arg_max(tag, ledger_id) AS tag FROM vault GROUP BY 1) m ON m.section_id = p.section_id"""
register(
    "hard_focus_tag",
    lambda t: pressure_now(t),
    "SELECT section_id, hard_slots, hard_focus_tag FROM pressure_now",
)


def recipe(t: Tables):
    def build():
        plan = po.tag_plan(t.next_rounds(), po.allocate_slots(po.per_tag_loss(t.shared_ledger())))
        vault = t.once("new_vault", lambda: new_vault(t))
        return po.build_recipe(
            t.next_rounds(), plan, po.recycle_picks(vault, t.shared_ledger(), t.next_rounds()),
            weakness_input(t), t.once("weakness", lambda: weakness(t)), pressure_now(t),
        )

    return t.once("recipe", build)


q.PARTS["pickable"] = f"""
    SELECT v.section_id, v.tag, v.ledger_id, row_number() OVER (PARTITION BY v.section_id ORDER BY v.loss DESC, v.recycle_count, v.ledger_id) AS rn
    FROM new_vault v JOIN rounds r USING (section_id) WHERE {q.status('r.current_round + 1', 'v.')} = 'usable'"""
q.PARTS["picked"] = """
    SELECT r.section_id, r.current_round + 1 AS round_id, p.hard_slots, p.hard_focus_tag, l.plan,
           coalesce((SELECT list({'command': 'recycle', 'tag': k.tag, 'id': k.ledger_id} ORDER BY k.rn) FROM pickable k
                     WHERE k.section_id = r.section_id AND k.rn <= CASE WHEN p.hard_slots > 0 THEN 2 ELSE 3 END), []) AS picks
    FROM rounds r JOIN pressure_now p USING (section_id) JOIN plan l USING (section_id)"""
q.PARTS["recipe_lists"] = f"""
    SELECT section_id, round_id, list_concat(picks, list_transform(list_concat(
             list_transform(coalesce({WEAK_LIST.format(c='(10 - len(picks))')}, []), lambda x: 'validation:' || x),
             list_resize(CAST([] AS VARCHAR[]), hard_slots, 'hard:' || hard_focus_tag), plan, plan),
             lambda x: {{'command': 'generate', 'tag': x, 'id': NULL::BIGINT}}))[1:10] AS slots
    FROM ({weak_sql('(10 - len(s.picks))', 'picked')})"""
q.PARTS["recipe"] = """
    SELECT section_id, round_id, CAST(i AS INTEGER) AS slot_id, s.command AS command, s.tag AS tag, s.id AS failure_ledger_id
    FROM (SELECT section_id, round_id, unnest(slots) AS s, unnest(range(1, 11)) AS i FROM recipe_lists)"""
register("recycle_picks",
         lambda t: po.recycle_picks(t.once("new_vault", lambda: new_vault(t)), t.shared_ledger(), t.next_rounds()).select(
             "section_id", F.array_join(F.transform("picks", lambda x: F.concat(x["tag"], F.lit(":"), x["ledger_id"].cast("string"))), "|").alias("picks")),
         "SELECT section_id, string_agg(tag || ':' || ledger_id, '|' ORDER BY rn) AS picks FROM pickable WHERE rn <= 3 GROUP BY 1")
register("build_recipe", recipe, "SELECT * FROM recipe")
register(
    "validate_recipe",
    lambda t: po.validate_recipe(
        recipe(t).withColumn("slot_id", F.when(F.col("section_id") == "section_003", F.col("slot_id") + 1).otherwise(F.col("slot_id")))
    ),
    "SELECT section_id, round_id, count(*) AS slot_count, CASE WHEN section_id = 'section_003' THEN 1 ELSE 0 END::BIGINT AS bad_slots, "
    "count(DISTINCT slot_id) AS distinct_slots, section_id <> 'section_003' AS valid FROM recipe GROUP BY 1, 2",
)


def _state(t: Tables):
    return t.next_rounds().select(
        "section_id", "current_round", (F.col("current_round") % 3).alias("consecutive_no_recycle"),
        F.array(F.lit(7).cast("bigint"), F.lit(4).cast("bigint")).alias("recycled_ids"),
    )


register(
    "commit_recipe",
    lambda t: po.commit_recipe(recipe(t), t.once("new_vault", lambda: new_vault(t)), _state(t))[0].select(
        "section_id", "ledger_id", "recycle_count", "last_recycled_round", "active", "retired_reason"
    ),
    """SELECT v.section_id, v.ledger_id, CAST(v.recycle_count + (p.failure_ledger_id IS NOT NULL)::INTEGER AS INTEGER) AS recycle_count,
       CASE WHEN p.failure_ledger_id IS NOT NULL THEN r.current_round + 1 ELSE v.last_recycled_round END AS last_recycled_round,
       v.active AND v.recycle_count + (p.failure_ledger_id IS NOT NULL)::INTEGER < 2 AS active,
       CASE WHEN v.recycle_count + (p.failure_ledger_id IS NOT NULL)::INTEGER < 2 THEN v.retired_reason
            WHEN p.failure_ledger_id IS NOT NULL THEN 'max_recycle_count' ELSE coalesce(v.retired_reason, 'max_recycle_count') END AS retired_reason
       FROM new_vault v JOIN rounds r USING (section_id)
       LEFT JOIN recipe p ON p.section_id = v.section_id AND p.failure_ledger_id = v.ledger_id""",
)
register(
    "commit_state",
    lambda t: po.commit_recipe(recipe(t), t.once("new_vault", lambda: new_vault(t)), _state(t))[1].select(
        "section_id", "consecutive_no_recycle", text("recycled_ids")
    ),
    """SELECT r.section_id, CASE WHEN count(p.failure_ledger_id) > 0 THEN 0 ELSE (r.current_round + 1) % 3 + 1 END AS consecutive_no_recycle,
       '7|4' || coalesce(string_agg('|' || p.failure_ledger_id, '' ORDER BY p.slot_id) FILTER (WHERE p.failure_ledger_id NOT IN (7, 4)), '') AS recycled_ids
       FROM rounds r LEFT JOIN recipe p USING (section_id) GROUP BY r.section_id, r.current_round""",
)


def _profile(t: Tables):
    return sh.shape_profile(t.shaped_records(), "section_id", pos="record_id", source="original_user_examples", classified=True)


register(
    "shape_gap_score",
    lambda t: po.shape_gap_score(
        t.ledger().withColumn("tag", F.when(F.col("ledger_id") % 8 == 0, "Reading Comprehension").when(F.col("ledger_id") % 9 == 0, "Structured-Text Task").otherwise(F.col("tag"))),
        _profile(t),
    ),
    """SELECT f.section_id, f.shape_id, f.confidence, total AS generated_count, m AS matching_count, round(m / total, 6) AS matching_share,
       round(CASE WHEN confidence < 0.5 THEN 0 WHEN m / total < 0.15 THEN least(1.0, 0.55 + confidence * 0.45::DOUBLE)
         WHEN m / total < 0.2625 THEN 0.45 ELSE 0 END::DOUBLE, 6) AS shape_gap
       FROM (SELECT p.*, total, CASE shape_id WHEN 'contextual_qa' THEN c WHEN 'structured_text_task' THEN s ELSE 0 END AS m FROM profiles p JOIN
         (SELECT section_id, count(*) AS total, count(*) FILTER (WHERE ledger_id % 8 = 0) AS c, count(*) FILTER (WHERE ledger_id % 8 <> 0 AND ledger_id % 9 = 0) AS s
          FROM gen GROUP BY 1) USING (section_id)) f""",
)

# --- examples ---------------------------------------------------------------------------------


def _example_files(t: Tables, fmt: str):
    """One text per conversation holding its pairs as example blocks or JSON."""
    k = F.col("conv_id") % 5
    if fmt == "text":
        part = F.when(k == 0, F.concat(F.lit("Question: "), F.regexp_replace("instruct", "\n", " "), F.lit("\nINPUT:\n"), "gold_summary", F.lit("\nOutput:\nyes\n"))).when(
            k == 1, F.concat(F.lit("sample:\n"), "instruct", F.lit("\n\n  Output :"), "gold_summary", F.lit("\n"))
        ).otherwise(F.concat(F.lit("Sample:\n"), "instruct", F.lit("\nOutput:\n"), "gold_summary"))
        joiner, wrap = "\n\n", lambda c: F.when(k == 4, F.concat(c, F.lit("\n\nSample:\nno output here"))).otherwise(c)
    else:
        part = F.when(
            k == 0, F.to_json(F.struct(F.col("instruct").alias("question"), F.col("gold_summary").alias("input"), F.lit("yes").alias("output")))
        ).otherwise(F.to_json(F.struct(F.col("instruct").alias("sample"), F.lit("").alias("output"), F.col("gold_summary"))))
        joiner = ", "
        wrap = lambda c: (
            F.when(k == 1, F.concat(F.lit('{"examples": ['), c, F.lit("]}")))
            .when(k == 4, F.concat(F.lit("["), c, F.lit(', {"sample": "x"}]')))
            .otherwise(F.concat(F.lit("["), c, F.lit("]")))
        )
    return t.pairs().select("conv_id", "turn", part.alias("part")).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), joiner).alias("value")
    ).withColumn("value", wrap(F.col("value")))


_FILES = """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
    CASE WHEN conv_id % 5 = 0 THEN {g} ELSE {i} END AS sample, CASE WHEN conv_id % 5 = 0 THEN 'yes' ELSE {g} END AS output,
    CASE WHEN conv_id % 5 = 0 THEN {q} END AS instruct, CASE WHEN conv_id % 5 = 0 THEN {g} END AS context,
    CASE WHEN conv_id % 5 = 0 THEN 'contextual' ELSE 'plain' END AS mode FROM pairs WHERE conv_id % 5 <> 4"""
register(
    "parse_examples_text",
    lambda t: ex.parse_examples_text(_example_files(t, "text")),
    _FILES.format(i=q.strip("instruct"), g=q.strip("gold_summary"), q=q.strip("replace(instruct, chr(10), ' ')")),
)
register(
    "parse_examples_json",
    lambda t: ex.parse_examples_json(_example_files(t, "json")),
    _FILES.format(i=q.strip("instruct"), g=q.strip("gold_summary"), q=q.strip("instruct")),
)
register(
    "new_examples",
    lambda t: ex.new_examples(
        t.examples(), t.examples().where(F.col("pos") % 3 == 0).withColumn("sample", F.when(F.col("pos") % 6 == 0, F.col("sample")).otherwise(F.lit(None)))
    ).select("section_id", "pos", "mode"),
    "SELECT section_id, pos, mode FROM examples e WHERE NOT EXISTS (SELECT 1 FROM examples k WHERE k.section_id = e.section_id AND k.pos % 6 = 0 "
    "AND k.sample = e.sample AND k.output = e.output AND k.instruct IS NOT DISTINCT FROM e.instruct AND k.context IS NOT DISTINCT FROM e.context AND k.mode = e.mode)",
)
register(
    "contextual_examples",
    lambda t: ex.contextual_examples(t.examples()).select("section_id", "pos"),
    "SELECT section_id, pos FROM examples WHERE mode = 'contextual' AND coalesce(nullif(context, ''), nullif(sample, '')) IS NOT NULL AND coalesce(instruct, '') <> ''",
)
q.PARTS["ctx_slot"] = f"""
    SELECT section_id, round_id, min(slot_id) AS contextual_slot_id FROM recipe
    WHERE command = 'generate' AND {q.explore('tag')} AND section_id IN (SELECT section_id FROM examples WHERE mode = 'contextual' AND coalesce(instruct, '') <> '')
    GROUP BY 1, 2"""
register("contextual_slot", lambda t: ex.contextual_slot(recipe(t), t.examples()), "SELECT * FROM ctx_slot")
q.PARTS["items"] = """
    SELECT r.*, row_number() OVER (PARTITION BY section_id, round_id ORDER BY slot_id) - 1 AS generation_index,
           coalesce(slot_id = contextual_slot_id, false) AS forced
    FROM recipe r LEFT JOIN ctx_slot c USING (section_id, round_id) WHERE command = 'generate'"""


def items(t: Tables):
    return pl.generation_items(recipe(t)).join(ex.contextual_slot(recipe(t), t.examples()), ["section_id", "round_id"], "left").withColumn(
        "forced", F.coalesce(F.col("slot_id") == F.col("contextual_slot_id"), F.lit(False))
    )


register(
    "assign_examples",
    lambda t: ex.assign_examples(items(t), t.examples()).select("section_id", "slot_id", "forced", "sample"),
    """SELECT i.section_id, i.slot_id, i.forced, e.sample FROM items i
       JOIN (SELECT section_id, sample, false AS f, pos, count(*) OVER (PARTITION BY section_id) AS n FROM examples UNION ALL
             SELECT section_id, sample, true, row_number() OVER (PARTITION BY section_id ORDER BY pos) - 1, count(*) OVER (PARTITION BY section_id)
             FROM examples WHERE mode = 'contextual' AND coalesce(instruct, '') <> '') e
       ON e.section_id = i.section_id AND e.f = i.forced AND e.pos = i.generation_index % e.n""",
)


def _mode_examples(t: Tables):
    """Examples with marker words inside texts and across the joint of two examples."""
    s, n = F.substring("section_id", 9, 3).cast("int"), F.col("pos")
    return t.examples().withColumn(
        "output",
        F.when((s % 4 == 1) & (n == 0), F.concat("output", F.lit(" negative"))).when((s % 4 == 2) & (n == 1), F.concat("output", F.lit(" photograph with lighting")))
        .otherwise(F.col("output")),
    ).withColumn(
        "sample", F.when((s % 4 == 1) & (n == 1), F.concat(F.lit("Prompt "), "sample")).otherwise(F.col("sample"))
    )


def modes(t: Tables):
    s = F.substring("section_id", 9, 3).cast("int")
    configured = t.examples().select("section_id").distinct().select("section_id", F.when(s % 5 == 0, "mixed").when(s % 5 == 1, "auto").alias("task_mode"))
    return ex.resolve_task_mode(_mode_examples(t), configured)


q.PARTS["mode_texts"] = """
    SELECT section_id, pos, lower(concat_ws(' ', nullif(CASE WHEN s % 4 = 1 AND pos = 1 THEN 'Prompt ' || sample ELSE sample END, ''), nullif(instruct, ''),
             nullif(context, ''), CASE WHEN s % 4 = 1 AND pos = 0 THEN output || ' negative' WHEN s % 4 = 2 AND pos = 1 THEN output || ' photograph with lighting' ELSE output END)) AS txt
    FROM (SELECT *, CAST(substr(section_id, 9, 3) AS INTEGER) AS s FROM examples)"""
q.PARTS["mode_text"] = """
    SELECT section_id, string_agg(txt, ' ' ORDER BY pos) AS txt,
           printf('%016x', CAST(sum(CAST('0x' || substr(sha256(pos || '|' || txt), 1, 13) AS BIGINT)) % 1152921504606846976 AS BIGINT)) AS example_hash
    FROM mode_texts GROUP BY 1"""
q.PARTS["mode_hits"] = f"""
    SELECT section_id, {q.markers('txt', fx.VISUAL_MARKERS)} AS v, {q.markers('txt', fx.TEXT_MARKERS)} AS t, example_hash,
           CASE CAST(substr(section_id, 9, 3) AS INTEGER) % 5 WHEN 0 THEN 'mixed' ELSE 'auto' END AS task_mode FROM mode_text"""
q.PARTS["modes"] = f"""
    SELECT *, CASE WHEN task_mode = 'mixed' THEN 'mixed' WHEN vs >= 3 AND ts >= 2 THEN 'mixed' WHEN vs >= 3 THEN 'visual' ELSE 'text' END AS resolved_task_mode,
           CASE WHEN task_mode = 'mixed' THEN 1.0 WHEN vs >= 3 AND ts >= 2 THEN 0.75 WHEN vs >= 3 THEN 0.85 WHEN ts > 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS mode_confidence
    FROM (SELECT *, {q.weight('v', fx.VISUAL_MARKERS)} AS vs, {q.weight('t', fx.TEXT_MARKERS)} AS ts FROM mode_hits)"""
register(
    "resolve_task_mode",
    lambda t: modes(t).withColumn("mode_evidence", F.array_join("mode_evidence", "|")),
    "SELECT section_id, task_mode, resolved_task_mode, mode_confidence, CAST(vs AS INTEGER) AS visual_score, CAST(ts AS INTEGER) AS text_score, example_hash, "
    "CASE WHEN len(v) + len(t) > 0 THEN array_to_string(list_concat(list_transform(v, lambda m: 'visual:' || m), list_transform(t, lambda m: 'text:' || m)), '|') "
    "WHEN task_mode = 'mixed' THEN 'explicit:mixed' ELSE 'default:text_no_strong_visual_evidence' END AS mode_evidence FROM modes",
)

# --- planner ----------------------------------------------------------------------------------


def counts(t: Tables):
    return lg.sync_tag_counts(t.state_counts(), t.shared_ledger())


q.PARTS["plan_counts"] = f"""
    SELECT *, sum(n) OVER (PARTITION BY section_id) AS total, min(n) OVER (PARTITION BY section_id) AS least FROM (
      SELECT section_id, {q.norm('tag')} AS tag, CAST(sum(n) AS BIGINT) AS n FROM sync_counts WHERE {q.norm('tag')} NOT IN ('', 'wide_variety') GROUP BY 1, 2)"""
register("overused_tags", lambda t: pl.overused_tags(counts(t)),
         "SELECT section_id, tag, n, round(n / total, 6) AS share FROM plan_counts WHERE n >= 3 AND n / total >= 0.3")
register("dominant_tags", lambda t: pl.dominant_tags(lg.known_categories(counts(t))),
         "SELECT section_id, tag, n, round(n / total, 6) AS share FROM plan_counts WHERE n >= 3 AND n / total >= 0.35")
register("rare_tags", lambda t: pl.rare_tags(counts(t), pl.overused_tags(counts(t))),
         "SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY n, tag) AS INTEGER) AS rare_rank, tag, n FROM plan_counts "
         "WHERE n <= least + 1 AND NOT (n >= 3 AND n / total >= 0.3) QUALIFY rare_rank <= 4")
register(
    "weakness_profile_for",
    lambda t: pl.weakness_profile_for(pl.generation_items(recipe(t)), t.once("weakness", lambda: weakness(t))).select(
        "section_id", "slot_id", F.col("category.tag").alias("category_tag"), F.col("category.shape_id").alias("category_shape")
    ),
    f"""SELECT i.section_id, i.slot_id, coalesce(m.tag, f.tag) AS category_tag, coalesce(m.shape_id, f.shape_id) AS category_shape
        FROM items i LEFT JOIN weakness m ON m.section_id = i.section_id AND {q.norm('m.tag')} = {q.norm(q.base('i.tag'))}
        LEFT JOIN weakness f ON f.section_id = i.section_id AND f.rank = 1""",
)
register(
    "effective_profile",
    lambda t: pl.effective_profile(
        _profile(t), modes(t),
        _profile(t).select("section_id", F.lit(fx.ASSISTANT_QA).alias("shape_id"), (F.substring("section_id", 9, 3).cast("int") / 20).alias("confidence"), F.array(F.lit("validation")).alias("source")),
    ).select("section_id", "shape_id", "confidence", text("source"), "focus_tag"),
    f"""SELECT p.section_id, CASE WHEN w THEN 'assistant_qa' ELSE shape_id END AS shape_id, CASE WHEN w THEN n / 20 ELSE confidence END AS confidence,
        CASE WHEN w THEN 'validation|original_user_examples' ELSE 'original_user_examples' END AS source, CASE WHEN w THEN 'assistant_qa' ELSE d.focus END AS focus_tag
        FROM (SELECT f.*, CAST(substr(f.section_id, 9, 3) AS INTEGER) AS n,
              coalesce(m.resolved_task_mode = 'text' AND CAST(substr(f.section_id, 9, 3) AS INTEGER) / 20 >= 0.55, false) AS w
              FROM profiles f LEFT JOIN modes m USING (section_id)) p JOIN {_FOCUS} ON d.s = p.shape_id""",
)


def blueprints(t: Tables):
    def build():
        mode = t.once("modes", lambda: modes(t))
        profile = t.once("effective", lambda: pl.effective_profile(_profile(t), mode))
        return pl.plan_blueprints(
            recipe(t), counts(t), mode, profile, t.once("weakness", lambda: weakness(t)),
            ex.contextual_slot(recipe(t), t.examples()), t.shared_ledger(),
        )

    return t.once("blueprints", build)


def _pick(options: list[str], name: str) -> str:
    return f"({q.lits(options)})[{q.pick('seed || ' + repr('|' + name), len(options))} + 1]"


def _option(forced: str, qa, grounded: str, visual, plain, name: str) -> str:
    return (
        f"CASE WHEN forced THEN '{forced}' WHEN steered AND asks THEN {_pick(qa, 'hard_' + name)} WHEN steered AND grounded THEN '{grounded}' "
        f"WHEN draws THEN {_pick(visual, 'hard_' + name)} WHEN steered THEN {_pick(plain, 'hard_' + name)} "
        f"WHEN first = 'visual_generation' THEN {_pick(visual, name)} ELSE {_pick(plain, name)} END"
    )


q.PARTS["bp1"] = f"""
    SELECT i.*, {q.intent('i.tag')} AS intent, {q.base('i.tag')} AS base, {q.norm(q.base('i.tag'))} AS focus, m.resolved_task_mode, m.mode_confidence,
           p.shape_id AS own_shape, d.focus AS own_focus, coalesce(w.tag, w1.tag) AS cat_tag, coalesce(w.shape_id, w1.shape_id) AS cat_shape,
           i.section_id || '|' || i.round_id || '|' || i.slot_id || '|' || i.generation_index || '|' || {q.base('i.tag')} || '|' || {q.intent('i.tag')} || '|1' AS seed
    FROM items i JOIN modes m USING (section_id) LEFT JOIN profiles p USING (section_id) LEFT JOIN {_FOCUS} ON d.s = p.shape_id
    LEFT JOIN weakness w ON w.section_id = i.section_id AND {q.norm('w.tag')} = {q.norm(q.base('i.tag'))}
    LEFT JOIN weakness w1 ON w1.section_id = i.section_id AND w1.rank = 1"""
q.PARTS["bp2"] = """
    SELECT *, CASE WHEN val THEN cat_shape ELSE own_shape END AS shape, CASE WHEN val THEN cat_tag ELSE own_focus END AS pfocus,
           intent IN ('hard', 'validation') AS steered, focus = 'wide_variety' AS explore FROM (
      SELECT *, coalesce(intent = 'validation' AND cat_shape IS NOT NULL AND NOT (resolved_task_mode = 'text' AND cat_shape = 'visual_generation'), false) AS val FROM bp1)"""
q.PARTS["bp3"] = f"""
    SELECT *, focus = 'assistant_qa' OR shape = 'assistant_qa' AS asks, focus = 'contextual_qa' OR shape = 'contextual_qa' AS grounded,
           steered AND (focus IN {tuple(fx.VISUAL_TAGS)} OR shape = 'visual_generation') AS draws,
           CASE WHEN steered AND (focus = 'assistant_qa' OR shape = 'assistant_qa') THEN 'text_assistant_qa'
                WHEN steered AND (focus = 'contextual_qa' OR shape = 'contextual_qa') THEN 'text_contextual_qa'
                WHEN resolved_task_mode = 'visual' THEN 'visual_generation' WHEN resolved_task_mode = 'text' THEN 'example_aligned_text'
                WHEN focus IN {tuple(fx.VISUAL_TAGS)} THEN 'visual_generation'
                WHEN explore AND {q.pick("seed || '|mixed_modality'", 3)} = 0 THEN 'visual_generation' ELSE 'example_aligned_text' END AS first
    FROM bp2"""
q.PARTS["round_tags"] = f"""
    SELECT section_id, list(DISTINCT {q.norm('tag')}) AS used FROM recipe WHERE command = 'recycle' GROUP BY 1"""
q.PARTS["avoid"] = f"""
    SELECT b.section_id, b.slot_id, list(a.tag ORDER BY a.kind, a.o) AS tags FROM bp3 b JOIN (
      SELECT section_id, tag, min(kind) AS kind, arg_min(o, kind) AS o FROM (
        SELECT section_id, tag, 1 AS kind, tag AS o FROM plan_counts WHERE n >= 3 AND n / total >= 0.3
        UNION ALL SELECT section_id, {q.norm('tag')}, 2, lpad(CAST(min(slot_id) AS VARCHAR), 2, '0') FROM recipe WHERE command = 'recycle' GROUP BY 1, 2
        UNION ALL SELECT m.section_id, v.tag, 3, v.tag FROM modes m, (SELECT unnest({q.lits(fx.VISUAL_TAGS)}) AS tag) v WHERE m.resolved_task_mode = 'text') GROUP BY 1, 2) a
      ON a.section_id = b.section_id AND (b.explore OR a.tag <> b.focus) AND NOT (b.forced AND a.tag IN {tuple(fx.CONTEXTUAL_KEEP_TAGS)})
    GROUP BY 1, 2"""
q.PARTS["rares"] = """
    SELECT section_id, slot_id, string_agg(tag, ', ' ORDER BY n, tag) AS rare FROM (
      SELECT b.section_id, b.slot_id, c.tag, c.n, row_number() OVER (PARTITION BY b.section_id, b.slot_id ORDER BY c.n, c.tag) AS rn
      FROM bp3 b JOIN plan_counts c ON c.section_id = b.section_id AND c.n <= c.least + 1
      LEFT JOIN avoid a ON a.section_id = b.section_id AND a.slot_id = b.slot_id WHERE NOT coalesce(list_contains(a.tags, c.tag), false)) WHERE rn <= 4 GROUP BY 1, 2"""
q.PARTS["blueprints"] = f"""
    SELECT section_id, round_id, slot_id, CAST(generation_index AS INTEGER) AS generation_index, tag AS curriculum_focus, intent AS generation_intent, forced, shape AS shape_id,
      resolved_task_mode, modality AS modality_hint, input_shape,
      {_option('one concise sentence', fx.QA_OUTPUT_SHAPES, 'grounded direct answer', fx.VISUAL_OUTPUT_SHAPES, fx.OUTPUT_SHAPES, 'output')} AS output_shape,
      {_option(fx.CONTEXTUAL_SHAPE['reasoning'], fx.QA_REASONING, fx.CONTEXTUAL_SHAPE['reasoning'], fx.VISUAL_REASONING, fx.REASONING, 'reasoning')} AS reasoning_requirement,
      CASE WHEN modality = 'visual_generation' THEN {_pick(fx.VISUAL_DOMAINS, 'domain')} ELSE {_pick(fx.TEXT_DOMAINS, 'domain')} END AS domain_hint,
      CASE WHEN intent = 'hard' THEN {_pick(fx.DIFFICULTY['hard'], 'difficulty')} WHEN intent = 'validation' THEN {_pick(fx.DIFFICULTY['validation'], 'difficulty')}
           ELSE {_pick(fx.DIFFICULTY['late'], 'difficulty')} END AS difficulty,
      CASE WHEN forced THEN 'contextual_qa or factual_qa' WHEN steered AND NOT explore THEN focus WHEN steered THEN pfocus
           WHEN explore AND rare IS NOT NULL THEN '{fx.TAG_HINT_RARE}' || rare WHEN explore THEN '{fx.TAG_HINT_OPEN}' ELSE focus END AS target_tag_hint,
      CASE WHEN intent IN ('hard', 'validation') THEN CASE intent WHEN 'hard' THEN '{fx.NOVELTY['hard']}' ELSE '{fx.NOVELTY['validation']}' END
           WHEN explore AND rare IS NOT NULL THEN '{fx.NOVELTY['rare']}' WHEN explore THEN '{fx.NOVELTY['open']}' ELSE '{fx.NOVELTY['focused']}' END AS novelty_goal,
      CASE WHEN forced THEN '{fx.CONTEXT_POLICY['forced']}' WHEN shape = 'assistant_qa' THEN '{fx.CONTEXT_POLICY['question']}'
           WHEN contains(input_shape, 'context') OR contains(input_shape, 'facts') OR contains(input_shape, 'log') THEN '{fx.CONTEXT_POLICY['grounded']}'
           ELSE '{fx.CONTEXT_POLICY['optional']}' END AS context_policy,
      coalesce(array_to_string(avoid_tags[1:5], '|'), '') AS avoid_tags
    FROM (SELECT b.*, a.tags AS avoid_tags, r.rare,
            CASE WHEN forced THEN 'text_contextual_qa' WHEN steered AND asks THEN 'text_assistant_qa' WHEN steered AND grounded THEN 'text_contextual_qa'
                 WHEN draws THEN 'visual_generation' ELSE first END AS modality,
            {_option(fx.CONTEXTUAL_SHAPE['input'], fx.QA_INPUT_SHAPES, fx.CONTEXTUAL_SHAPE['input'], fx.VISUAL_INPUT_SHAPES, fx.INPUT_SHAPES, 'input')} AS input_shape
          FROM bp3 b LEFT JOIN avoid a USING (section_id, slot_id) LEFT JOIN rares r USING (section_id, slot_id))"""
BP_COLS = [
    "section_id", "round_id", "slot_id", "generation_index", "curriculum_focus", "generation_intent", "forced", "shape_id", "resolved_task_mode",
    "modality_hint", "input_shape", "output_shape", "reasoning_requirement", "domain_hint", "difficulty", "target_tag_hint", "novelty_goal", "context_policy",
]
register(
    "plan_blueprints",
    lambda t: blueprints(t).select(*BP_COLS, text("avoid_tags")),
    "SELECT * FROM blueprints",
)
def _shown(constraints: str = "constraints"):
    """Constraint lines without the two that print confidences and the indented lists."""
    hidden = lambda x: x.startswith("- Task shape: ") | x.startswith("- Task mode: ") | x.startswith("-   - ")
    return F.array_join(F.filter(F.split(constraints, "\n"), lambda x: ~hidden(x)), "\n")


def _labels() -> str:
    named = {
        "Generation intent": "generation_intent", "Target tag": "target_tag_hint", "Novelty goal": "novelty_goal", "Difficulty": "difficulty", "Domain": "domain_hint",
        "Input shape": "input_shape", "Output shape": "output_shape", "Reasoning": "reasoning_requirement", "Context policy": "context_policy", "Modality": "modality_hint",
    }
    return ", ".join(f"'{label}: ' || {column} || '.'" for label, column in named.items())


register(
    "constraints_text",
    lambda t: pl.constraints_text(blueprints(t)).select("section_id", "slot_id", _shown().alias("shown"), F.size(F.split("constraints", "\n")).alias("lines")),
    # 14 fixed lines, plus what applies
    f"""SELECT section_id, slot_id, CAST(14 + CASE WHEN generation_intent = 'hard' THEN 1 + CASE WHEN shape_id = 'assistant_qa' THEN 5 ELSE 4 END ELSE 0 END
       + (generation_intent = 'validation')::INTEGER + (shape_id = 'assistant_qa')::INTEGER + (avoid_tags <> '')::INTEGER + 1 + ni + 1 + ns AS INTEGER) AS lines,
       array_to_string(list_transform(list_filter([{_labels()},
         CASE resolved_task_mode WHEN 'text' THEN '{pl.MODE_NOTES["text"]}' WHEN 'visual' THEN '{pl.MODE_NOTES["visual"]}' ELSE '{pl.MODE_NOTES["mixed"]}' END,
         CASE WHEN generation_intent = 'hard' THEN '{pl.HARD_NOTE}' END, CASE WHEN generation_intent = 'validation' THEN '{pl.VALIDATION_NOTE}' END,
         CASE WHEN shape_id = 'assistant_qa' THEN '{pl.QUESTION_NOTE}' END, CASE WHEN avoid_tags <> '' THEN 'Avoid overused tags: ' || replace(avoid_tags, '|', ', ') || '.' END,
         CASE WHEN ni > 0 THEN 'Stay away from these recent instructions:' END, CASE WHEN ns > 0 THEN 'Stay away from these recent samples:' END, '{pl.CLOSING_NOTE}'],
         lambda x: x IS NOT NULL), lambda x: '- ' || x), chr(10)) AS shown
       FROM (SELECT b.*, (SELECT least(3, count(DISTINCT substr(instruct, 1, 140))) FROM recent25 r WHERE r.section_id = b.section_id) AS ni,
                    (SELECT least(3, count(DISTINCT sample)) FROM recent25 r WHERE r.section_id = b.section_id) AS ns FROM blueprints b)""",
)
q.PARTS["recent25"] = "SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY ledger_id DESC) <= 25"


_SLOTS = (
    "array<struct<slot_id: int, curriculum_focus: string, generation_intent: string, shape_id: string, forced: boolean, input_shape: string, "
    "output_shape: string, reasoning_requirement: string, difficulty: string, domain_hint: string, target_tag_hint: string>>"
)


def _exploration(t: Tables):
    none = F.array().cast("array<struct<tag:string,reason:string,instruct:string,sample:string>>")
    tried = F.when(
        F.col("slot_id") % 2 == 0,
        F.array(F.struct(F.lit("view").alias("tag"), F.lit("tag_in_round").alias("reason"), F.lit("i").alias("instruct"), F.lit("s").alias("sample"))),
    ).otherwise(none)
    dominant = pl.dominant_tags(lg.known_categories(counts(t))).groupBy("section_id").agg(F.collect_set("tag").alias("dominant"))
    used = recipe(t).where(F.col("command") == "recycle").groupBy("section_id").agg(F.collect_set("tag").alias("used"))
    empty = F.array().cast("array<string>")
    lines = pl.exploration_text(F.coalesce("used", empty), F.coalesce("dominant", empty), F.col("forced"), tried)
    return blueprints(t).join(dominant, "section_id", "left").join(used, "section_id", "left").select(
        "section_id", "slot_id", pl.combine_constraints(lines, F.lit("  "), F.lit(fx.NO_CONSTRAINTS)).alias("lines")
    )


register(
    "exploration_text",
    _exploration,
    """SELECT section_id, slot_id, array_to_string(list_transform(list_filter([
         'Explore: choose a task unlike those already in this round.', 'Name the category yourself; a rare or new one is best.',
         CASE WHEN forced THEN 'Put a short factual passage in the sample and ask one question it answers.' END,
         CASE WHEN forced THEN 'Answer only from that passage; tag it contextual_qa or factual_qa.' END,
         'Tags used in this round: ' || used || '.', 'Categories that dominate: ' || dominant || '.',
         CASE WHEN slot_id % 2 = 0 THEN 'Rejected so far:' END, CASE WHEN slot_id % 2 = 0 THEN '1. tag=view; reason=tag_in_round; instruction=i; sample=s' END],
         lambda x: x IS NOT NULL), lambda x: '- ' || x), chr(10)) AS lines
       FROM (SELECT b.*, (SELECT string_agg(DISTINCT tag, ', ' ORDER BY tag) FROM recipe u WHERE u.section_id = b.section_id AND u.command = 'recycle') AS used,
               (SELECT string_agg(tag, ', ' ORDER BY tag) FROM plan_counts c WHERE c.section_id = b.section_id AND c.n >= 3 AND c.n / c.total >= 0.35) AS dominant FROM blueprints b)""",
)
register(
    "planner_snapshot",
    lambda t: pl.planner_snapshot(blueprints(t), t.once("modes", lambda: modes(t))).select(
        "section_id", "round_id", "resolved_task_mode", "mode_source", text("blocked_tags"), F.inline(F.from_json("generation_slots", _SLOTS))
    ),
    "SELECT b.section_id, b.round_id, m.resolved_task_mode, CASE WHEN m.task_mode <> 'auto' THEN 'explicit_task_mode' ELSE 'original_user_examples' END AS mode_source, "
    f"CASE WHEN m.resolved_task_mode = 'text' THEN '{'|'.join(fx.VISUAL_TAGS)}' ELSE '' END AS blocked_tags, b.slot_id, b.curriculum_focus, b.generation_intent, b.shape_id, "
    "b.forced, b.input_shape, b.output_shape, b.reasoning_requirement, b.difficulty, b.domain_hint, b.target_tag_hint FROM blueprints b JOIN modes m USING (section_id)",
)

# --- requests and cache -----------------------------------------------------------------------


def _requests(t: Tables):
    return bt.generation_requests(blueprints(t), counts(t), t.once("instructions", lambda: _instructions(t)), template="Make ***tag*** from ***instruct***.\n***tag_counts***")


def _instructions(t: Tables):
    return blueprints(t).select("section_id", "round_id", "slot_id", F.concat(F.lit("plan "), (F.col("slot_id") % 2).cast("string")).alias("instruct"), F.lit("").alias("example_block"))


q.PARTS["requests"] = f"""
    SELECT *, sha256('{{"cache_version":"dynamic_tags_v5","kind":"instruction_response","model_id":"external-generator","prompt":' || CAST(to_json({q.strip('prompt')}) AS VARCHAR)
      || ',"temperature":0.7}}') AS cache_key FROM (
      SELECT b.section_id, b.round_id, b.slot_id, b.curriculum_focus, b.generation_intent,
           'Make ' || {q.base('b.curriculum_focus')} || ' from plan ' || (b.slot_id % 2) || '.' || chr(10) || c.txt AS prompt
      FROM blueprints b JOIN (SELECT section_id, string_agg('- ' || tag || ': ' || n, chr(10) ORDER BY tag) AS txt FROM sync_counts GROUP BY 1) c USING (section_id))"""
register(
    "generation_requests",
    lambda t: _requests(t),
    "SELECT section_id, round_id, slot_id, curriculum_focus, generation_intent, prompt, false AS unfilled, cache_key FROM requests",
)


def _cache(t: Tables):
    return _requests(t).where(F.col("slot_id") % 3 == 0).select(
        "cache_key", F.when(F.col("section_id") < "section_005", "  ").otherwise(F.concat(F.lit(" answer for "), "section_id")).alias("response")
    ).distinct()


register(
    "cache_lookup",
    lambda t: bt.cache_lookup(_requests(t), _cache(t)).select("section_id", "slot_id", "cached", "response"),
    "SELECT r.section_id, r.slot_id, c.k IS NOT NULL AS cached, CASE WHEN c.k IS NOT NULL THEN 'answer for ' || c.s END AS response FROM requests r "
    "LEFT JOIN (SELECT cache_key AS k, min(section_id) AS s FROM requests WHERE slot_id % 3 = 0 AND section_id >= 'section_005' GROUP BY 1) c ON c.k = r.cache_key",
)
register(
    "request_payload",
    lambda t: bt.request_payload(_requests(t)).select(
        "section_id", "slots", F.inline(F.from_json("payload", "array<struct<slot_id: int, curriculum_focus: string, generation_intent: string, prompt: string>>"))
    ),
    "SELECT section_id, count(*) OVER (PARTITION BY section_id) AS slots, slot_id, curriculum_focus, generation_intent, prompt FROM requests",
)

# --- batch ------------------------------------------------------------------------------------

register(
    "fetch_recycled",
    lambda t: bt.fetch_recycled(_with_missing(t), t.ledger())[0].select("section_id", "slot_id", "sample", "gold_summary", "tag", "source", "source_ledger_id"),
    "SELECT r.section_id, r.slot_id, l.sample, l.gold_summary, l.tag, 'recycled' AS source, l.ledger_id AS source_ledger_id FROM recipe r "
    "JOIN ledger l ON l.section_id = r.section_id AND l.ledger_id = r.failure_ledger_id WHERE r.section_id <> 'section_002'",
)
register(
    "fetch_recycled_missing",
    lambda t: bt.fetch_recycled(_with_missing(t), t.ledger())[1].select("section_id", "slot_id", "reason"),
    "SELECT section_id, slot_id, 'ledger_row_not_found' AS reason FROM recipe WHERE command = 'recycle' AND section_id = 'section_002'",
)


def _with_missing(t: Tables):
    return recipe(t).withColumn(
        "failure_ledger_id", F.when(F.col("section_id") == "section_002", -F.col("failure_ledger_id")).otherwise(F.col("failure_ledger_id"))
    )


def _holes(t: Tables):
    """Ledger rows as a batch with some blank fields."""
    n = F.col("ledger_id")
    return t.ledger().select(
        "section_id", "round_id", n.alias("slot_id"), F.when(n % 13 == 0, " \n").otherwise(F.col("sample")).alias("sample"), "instruct",
        F.when(n % 17 != 0, F.col("gold_summary")).alias("gold_summary"), F.when(n % 19 == 0, "").otherwise(F.col("tag")).alias("tag"),
    )


register(
    "validate_batch",
    lambda t: bt.validate_batch(_holes(t)).select("slot_id", text("violations")),
    "SELECT ledger_id AS slot_id, array_to_string(list_filter([CASE WHEN ledger_id % 13 = 0 THEN 'missing_sample' END, CASE WHEN ledger_id % 17 = 0 THEN 'missing_gold_summary' END, "
    "CASE WHEN ledger_id % 19 = 0 THEN 'missing_tag' END], lambda x: x IS NOT NULL), '|') AS violations FROM ledger",
)
register(
    "validate_batch_size",
    lambda t: bt.validate_batch_size(_holes(t)),
    "SELECT section_id, round_id, count(*) AS size, count(*) FILTER (WHERE ledger_id % 17 = 0) AS missing_gold, count(*) = 10 AS exact, "
    "CASE WHEN count(*) = 10 THEN string_agg(CAST(ledger_id AS VARCHAR), ', ' ORDER BY ledger_id) FILTER (WHERE ledger_id % 17 = 0) END AS positions FROM ledger GROUP BY 1, 2",
)


def _responses(t: Tables):
    """One response per conversation in the shapes generators return; some broken."""
    k = F.col("conv_id") % 7
    row = F.to_json(
        F.struct(
            F.when(k != 6, F.col("slot_id")).alias("slot_id"),
            F.concat(F.lit(" S "), F.col("instruct")).alias("sample"),
            F.when((k == 5) & (F.col("slot_id") == 1), "You generate a row").when(F.col("slot_id") == 3, "").otherwise(F.concat(F.lit("Answer "), "turn")).alias("instruct"),
            F.when(F.col("slot_id") == 2, "").otherwise(F.col("gold_summary")).alias("gold_summary"),
            F.col("gold_summary").alias("output"),
            F.when(F.col("turn") % 4 != 0, F.lit("Row Tag")).alias("tag"),
        )
    )
    listed = _slots(t).withColumn("_row", row).groupBy("section_id", "conv_id", "round_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot_id", "_row"))), lambda x: x["_row"]), ", ").alias("rows")
    )
    arr = F.concat(F.lit("["), "rows", F.lit("]"))
    return listed.select(
        "section_id", "round_id",
        F.when(k == 1, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit('{"samples": '), arr, F.lit("}")))
        .when(k == 3, F.concat(F.lit("Here you are: "), arr, F.lit(" - done.")))
        .when(k == 4, F.concat(F.lit("["), "rows"))
        .otherwise(arr).alias("response"),
    )


def _slots(t: Tables):
    """Pairs of a conversation as requested slots, numbered by turn."""
    return t.pairs().select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("section_id"), "conv_id", F.lit(0).alias("round_id"),
        (F.floor(F.col("turn") / 2) + 1).cast("int").alias("slot_id"), F.floor(F.col("turn") / 2).cast("int").alias("generation_index"),
        "turn", "instruct", "gold_summary", F.lit("slot_tag").alias("tag"),
    )


register(
    "ingest_responses",
    lambda t: bt.ingest_responses(_responses(t), _slots(t))[0].select("section_id", "round_id", "slot_id", "sample", "instruct", "gold_summary", "tag", "source"),
    f"""SELECT 'conv_' || conv_id AS section_id, 0 AS round_id, CAST(turn // 2 + 1 AS INTEGER) AS slot_id, 'S ' || {q.strip('instruct')} AS sample, 'Answer ' || turn AS instruct,
        gold_summary, CASE WHEN turn % 4 = 0 THEN 'slot_tag' ELSE 'Row Tag' END AS tag, 'generated' AS source
        FROM pairs WHERE conv_id % 7 <> 4 AND turn // 2 <> 2 AND NOT (conv_id % 7 = 5 AND turn < 2)""",
)
register(
    "ingest_quarantine",
    lambda t: bt.ingest_responses(_responses(t), _slots(t))[1].select("section_id", "slot_id", "reason"),
    """SELECT 'conv_' || conv_id AS section_id, CAST(turn // 2 + 1 AS INTEGER) AS slot_id, CASE WHEN turn // 2 = 2 THEN 'missing_instruct' ELSE 'meta_instruction' END AS reason
       FROM pairs WHERE conv_id % 7 <> 4 AND (turn // 2 = 2 OR (conv_id % 7 = 5 AND turn < 2))
       UNION ALL SELECT DISTINCT 'conv_' || conv_id, NULL::INTEGER, 'invalid_json' FROM pairs WHERE conv_id % 7 = 4""",
)
register(
    "strip_fences",
    lambda t: tx.parse_response(_responses(t), "response").select(
        F.regexp_extract("section_id", "_([0-9]+)", 1).cast("bigint").alias("conv_id"), F.substring("payload", 1, 1).alias("first"), F.col("error").isNotNull().alias("failed")
    ),
    "SELECT DISTINCT conv_id, CASE conv_id % 7 WHEN 2 THEN '{' WHEN 3 THEN 'H' ELSE '[' END AS first, conv_id % 7 = 4 AS failed FROM pairs",
)


def _typed_tags(t: Tables):
    """Messy tags plus long tags with a letter missing."""
    e = F.col("ledger_id")
    return t.ledger().select(
        "section_id", "ledger_id",
        F.when(e % 6 == 0, F.concat("tag", F.lit("_question_answerng"))).when(e % 6 == 1, F.concat(F.lit("hard:"), "tag", F.lit(" Question-Answering")))
        .when(e % 6 == 2, F.concat(F.lit("brand new "), "tag")).when(e % 6 == 3, "wide variety 2").when(e % 6 == 4, "hard_good").otherwise(F.col("tag")).alias("tag"),
    )


def _vocabulary(t: Tables):
    base = counts(t)
    return base.unionByName(base.select("section_id", F.concat("tag", F.lit("_question_answering")).alias("tag"), "n"))


register(
    "conform_tags",
    lambda t: bt.conform_tags(_typed_tags(t), _vocabulary(t)),
    "SELECT section_id, ledger_id, CASE ledger_id % 6 WHEN 0 THEN tag || '_question_answering' WHEN 1 THEN tag || '_question_answering' WHEN 2 THEN 'brand_new_' || tag "
    "WHEN 3 THEN 'uncategorized' WHEN 4 THEN 'uncategorized' ELSE tag END AS tag, CASE ledger_id % 6 WHEN 0 THEN 'fuzzy' WHEN 1 THEN 'exact' WHEN 2 THEN 'new' "
    "WHEN 3 THEN 'uncategorized' WHEN 4 THEN 'uncategorized' ELSE 'exact' END AS tag_match FROM ledger",
)


def _slot_rows(t: Tables):
    """Every record as a row for one of twelve slots: two of them are outside the batch, and each has several rows."""
    slot = (F.col("ledger_id") % 12 + 1).cast("int")
    return t.ledger().select(
        "section_id", "round_id", slot.alias("slot_id"), "ledger_id",
        F.when((slot == 1) & (F.col("round_id") % 2 == 0), "contextual_qa").otherwise(F.col("tag")).alias("tag"),
        (slot % 3 != 0).alias("is_exploration"), (slot == 1).alias("forced"),
    )


q.PARTS["slot_rows"] = """
    SELECT *, row_number() OVER (PARTITION BY section_id, round_id, slot_id ORDER BY tag) AS rn FROM (
      SELECT section_id, round_id, CAST(ledger_id % 12 + 1 AS INTEGER) AS slot_id, ledger_id,
             CASE WHEN ledger_id % 12 = 0 AND round_id % 2 = 0 THEN 'contextual_qa' ELSE tag END AS tag,
             (ledger_id % 12 + 1) % 3 <> 0 AS explore, ledger_id % 12 = 0 AS forced FROM ledger)"""
q.PARTS["slotted"] = "SELECT section_id, round_id, slot_id, tag, explore, forced FROM slot_rows WHERE rn = 1 AND slot_id <= 10"
q.PARTS["slot_steps"] = """
    SELECT s.*, coalesce(c.n, 0) AS n, t.total, row_number() OVER (PARTITION BY s.section_id, s.round_id ORDER BY slot_id) AS step
    FROM slotted s LEFT JOIN categories c ON c.section_id = s.section_id AND c.tag = s.tag
    JOIN (SELECT section_id, sum(n) AS total FROM categories GROUP BY 1) t ON t.section_id = s.section_id"""
_WHY = (
    "CASE WHEN NOT s.explore THEN NULL WHEN s.forced THEN CASE WHEN s.tag NOT IN {ok} THEN 'not_contextual' END "
    "WHEN list_contains({seen}, s.tag) THEN 'tag_in_round' WHEN s.n >= 3 AND s.n / (s.total + {added}) >= 0.35 THEN 'tag_dominates_section' END"
)
_START = _WHY.format(ok=tuple(fx.CONTEXTUAL_TAGS), seen="['error']", added="0")
_NEXT = _WHY.format(ok=tuple(fx.CONTEXTUAL_TAGS), seen="f.seen", added="f.added")
register(
    "accept_diverse",
    lambda t: bt.accept_diverse(
        _slot_rows(t), counts(t), t.ledger().select("section_id", "round_id", F.lit("error").alias("tag")).distinct()
    ).select("section_id", "round_id", "slot_id", "tag", "accepted", "reject_reason"),
    f"""SELECT * FROM (WITH RECURSIVE f AS (
        SELECT s.section_id, s.round_id, s.slot_id, s.tag, s.step, {_START} AS reject_reason,
               CASE WHEN ({_START}) IS NULL THEN ['error', s.tag] ELSE ['error'] END AS seen, CASE WHEN ({_START}) IS NULL THEN 1 ELSE 0 END AS added
        FROM slot_steps s WHERE s.step = 1
        UNION ALL
        SELECT s.section_id, s.round_id, s.slot_id, s.tag, s.step, {_NEXT},
               CASE WHEN ({_NEXT}) IS NULL THEN list_append(f.seen, s.tag) ELSE f.seen END, f.added + CASE WHEN ({_NEXT}) IS NULL THEN 1 ELSE 0 END
        FROM f JOIN slot_steps s ON s.section_id = f.section_id AND s.round_id = f.round_id AND s.step = f.step + 1)
        SELECT section_id, round_id, slot_id, tag, reject_reason IS NULL AS accepted, reject_reason FROM f)
        UNION ALL SELECT section_id, round_id, slot_id, tag, false, CASE WHEN slot_id > 10 THEN 'slot_out_of_range' ELSE 'duplicate_slot' END
        FROM slot_rows WHERE slot_id > 10 OR rn > 1""",
)

# --- pool -------------------------------------------------------------------------------------


def _pool(t: Tables):
    return t.documents().select(
        section_of(F.col("doc_id")).alias("section_id"), F.col("doc_id").alias("sample_id"), F.concat("lang", F.lit("_"), "source").alias("tag"),
        F.col("n_chars").cast("double").alias("score"),
    )


def _pool_counts(t: Tables):
    return _pool(t).groupBy("section_id", "tag").agg(F.count("*").alias("n"))


def _pool_recipe(t: Tables):
    sections = _pool(t).select("section_id", F.lit(0).alias("current_round")).distinct()
    return po.first_recipe(sections, _pool_counts(t))


q.PARTS["pool"] = f"SELECT {q.section('doc_id')} AS section_id, doc_id AS sample_id, {q.norm("lang || '_' || source")} AS tag, lang || '_' || source AS raw_tag, CAST(n_chars AS DOUBLE) AS score FROM documents"
q.PARTS["pool_counts"] = "SELECT section_id, tag, raw_tag, count(*) AS n FROM pool GROUP BY 1, 2, 3"
q.PARTS["pool_slots"] = """
    SELECT section_id, CAST(i AS INTEGER) AS slot_id, tag FROM (SELECT section_id, unnest(range(5, 11)) AS i, unnest(list_resize(list_concat(l, l, l, l, l, l), 6)) AS tag
      FROM (SELECT section_id, list(tag ORDER BY n DESC, raw_tag) AS l FROM pool_counts GROUP BY 1))"""
q.PARTS["pool_best"] = "SELECT *, row_number() OVER (PARTITION BY section_id, tag ORDER BY score DESC, sample_id) AS rn FROM pool WHERE sample_id % 10 <> 0"
register(
    "select_from_pool",
    lambda t: bt.select_from_pool(_pool_recipe(t), _pool(t), _pool_counts(t), _pool(t).where(F.col("sample_id") % 10 == 0)).select("section_id", "slot_id", "tag", "sample_id", "score"),
    """SELECT s.section_id, s.slot_id, CASE WHEN b.sample_id IS NOT NULL THEN s.tag END AS tag, b.sample_id, round(b.score, 6) AS score
       FROM (SELECT *, row_number() OVER (PARTITION BY section_id, tag ORDER BY slot_id) AS rn FROM pool_slots) s
       LEFT JOIN pool_best b ON b.section_id = s.section_id AND b.tag = s.tag AND b.rn = s.rn
       UNION ALL
       SELECT x.section_id, CAST(x.i AS INTEGER), o.tag, o.sample_id, round(o.score, 6) FROM (SELECT section_id, unnest([1, 2, 3, 4]) AS i FROM (SELECT DISTINCT section_id FROM pool)) x
       LEFT JOIN (SELECT b.*, row_number() OVER (PARTITION BY b.section_id ORDER BY c.n, b.tag) AS k FROM pool_best b
                  JOIN pool_counts c ON c.section_id = b.section_id AND c.tag = b.tag WHERE b.rn = 1
                  AND NOT EXISTS (SELECT 1 FROM pool_slots p WHERE p.section_id = b.section_id AND p.tag = b.tag)) o ON o.section_id = x.section_id AND o.k = x.i""",
)
register(
    "assemble_batch",
    lambda t: bt.assemble_batch(_batch_half(t, "recycled"), _batch_half(t, "generated"), 7)[0].select(
        "section_id", "round_id", "slot_id", "tag", "sample", "gold_summary", "source", "batch_pos"
    ),
    "SELECT section_id, round_id, ledger_id AS slot_id, tag, sample, gold_summary, source, CAST(row_number() OVER (PARTITION BY section_id, round_id "
    "ORDER BY sha256('7|' || section_id || '|' || round_id || '|' || ledger_id), ledger_id) AS INTEGER) AS batch_pos "
    "FROM ledger WHERE ledger_id % 17 <> 0 AND ledger_id % 13 <> 0 AND ledger_id % 19 <> 0",
)
register(
    "shuffle_batch",
    lambda t: bt.shuffle_batch(t.ledger().withColumn("slot_id", F.col("ledger_id")), 3).select("section_id", "round_id", "slot_id", "batch_pos"),
    "SELECT section_id, round_id, ledger_id AS slot_id, CAST(row_number() OVER (PARTITION BY section_id, round_id "
    "ORDER BY sha256('3|' || section_id || '|' || round_id || '|' || ledger_id), ledger_id) AS INTEGER) AS batch_pos FROM ledger",
)


def _batch_half(t: Tables, source: str):
    rows = _holes(t).join(t.ledger().select("section_id", F.col("ledger_id").alias("slot_id"), "source", "source_ledger_id"), ["section_id", "slot_id"])
    return rows.where(F.col("source") == source).select(*schemas.columns(schemas.BATCH))


# --- scores -----------------------------------------------------------------------------------


def _answers(t: Tables):
    return t.task_records().withColumnRenamed("output", "gold_summary").withColumnRenamed("record_id", "row_id")


q.PARTS["answers"] = f"""
    SELECT record_id AS row_id, sample, instruct, output AS gold_summary,
           string_split({q.squeeze("lower('### Instruction: ' || instruct || CASE WHEN " + q.strip('sample') + " = '' THEN '' ELSE ' ### Input: ' || sample END || ' ### Output:')")}, ' ') AS p,
           CASE WHEN {q.squeeze("coalesce(output, '')")} = '' THEN [] ELSE string_split({q.squeeze("lower(output)")}, ' ') END AS a
    FROM records"""
q.PARTS["budget"] = "SELECT *, least(512, len(p) + len(a)) AS total, greatest(0, least(512, len(p) + len(a)) - least(512, len(p))) AS room FROM answers"
register(
    "token_budget",
    lambda t: sc.token_budget(_answers(t)).select("row_id", "prompt_tokens", "gold_tokens", "token_length", "answer_tokens", "truncated"),
    "SELECT row_id, CAST(len(p) AS INTEGER) AS prompt_tokens, CAST(len(a) AS INTEGER) AS gold_tokens, CAST(total AS INTEGER) AS token_length, CAST(room AS INTEGER) AS answer_tokens, len(p) + len(a) > 512 AS truncated FROM budget",
)
q.PARTS["corpus"] = f"SELECT doc_id, string_split({q.squeeze('lower(text)')}, ' ') AS t FROM documents WHERE {q.squeeze('text')} <> ''"
q.PARTS["bigrams"] = """
    SELECT prev, token, count(*) AS n FROM (SELECT unnest(t) AS token, unnest(list_concat([''], t[1:len(t) - 1])) AS prev FROM corpus) GROUP BY 1, 2"""
q.PARTS["unigrams"] = "SELECT token, CAST(sum(n) AS BIGINT) AS n FROM bigrams GROUP BY 1"
register(
    "fit_ngram",
    lambda t: sc.fit_ngram(t.documents(), "text")["bigrams"],
    "SELECT prev, token, n, round(n / sum(n) OVER (PARTITION BY prev), 6) AS p2 FROM bigrams",
)
register(
    "score_loss",
    lambda t: sc.score_loss(_answers(t), sc.fit_ngram(t.documents(), "text"), "row_id").select("row_id", "token_length", "answer_tokens", "loss", "scored_tokens"),
    """SELECT b.row_id, CAST(total AS INTEGER) AS token_length, CAST(room AS INTEGER) AS answer_tokens, round(s.loss, 6) AS loss, s.k AS scored_tokens FROM budget b LEFT JOIN (
       SELECT x.row_id, count(*) AS k, avg(-ln(0.7::DOUBLE * coalesce(g.n / v.pn, 0) + (1 - 0.7)::DOUBLE * (coalesce(u.n, 0) + 1) / (c.total + c.vocab + 1))) AS loss
       FROM (SELECT row_id, unnest(a[1:room]) AS token, unnest(list_concat([p[len(p)]], a[1:room - 1])[1:room]) AS prev FROM budget WHERE room > 0) x
       LEFT JOIN bigrams g ON g.prev = x.prev AND g.token = x.token LEFT JOIN (SELECT prev, sum(n) AS pn FROM bigrams GROUP BY 1) v ON v.prev = x.prev
       LEFT JOIN unigrams u ON u.token = x.token CROSS JOIN (SELECT sum(n) AS total, count(*) AS vocab FROM unigrams) c GROUP BY 1) s USING (row_id)""",
)


def _length_model(frames):
    """A stand-in for a user's model: loss from the length of the answer."""
    for frame in frames:
        yield frame.assign(loss=frame["gold_summary"].fillna("").str.len() / 97)


register(
    "score_with_model",
    lambda t: sc.score_with_model(_answers(t).select("row_id", "gold_summary"), _length_model).select("row_id", "loss"),
    "SELECT row_id, round(length(gold_summary) / 97, 6) AS loss FROM answers",
)


def _words_only(c):
    """A user's tokenizer: runs of ASCII letters and digits."""
    return F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda x: x != "")


_WORDS = "len(list_filter(string_split_regex(array_to_string({}, ' '), '[^A-Za-z0-9]+'), lambda x: x <> ''))"
register(
    "token_budget_custom",
    lambda t: sc.token_budget(_answers(t), tokenize=_words_only).select("row_id", "prompt_tokens", "gold_tokens", "token_length", "truncated"),
    f"""SELECT row_id, CAST(np AS INTEGER) AS prompt_tokens, CAST(na AS INTEGER) AS gold_tokens, CAST(least(512, np + na) AS INTEGER) AS token_length, np + na > 512 AS truncated
        FROM (SELECT row_id, {_WORDS.format('p')} AS np, {_WORDS.format('a')} AS na FROM answers)""",
)


def _count_generator(frames):
    """A stand-in for a user's generator: answers with the length of the prompt."""
    for frame in frames:
        yield frame.assign(response="chars:" + frame["prompt"].str.len().astype(str))


def _answered(t: Tables):
    requests = t.pairs().select("conv_id", "turn", F.col("instruct").alias("prompt"))
    return bt.answer_requests(requests, _count_generator).select("conv_id", "turn", "response")


register("answer_requests", _answered, "SELECT conv_id, turn, 'chars:' || length(instruct) AS response FROM pairs")
