"""Ledger, vault, health and policy queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lossloom import schemas
from lossloom.catalog import sql as q
from lossloom.catalog.adapters import Tables
from lossloom.catalog.registry import register, text
from lossloom.functions import shape as sh
from lossloom.functions import text as tx
from lossloom.operators import health as hl
from lossloom.operators import ledger as lg
from lossloom.operators import planner as pl
from lossloom.operators import policy as po
from lossloom.operators import ranking as rk
from lossloom.operators import reports as rp
from lossloom.operators import vault as vt
from lossloom.params import DEFAULTS

VAULT_COLS = schemas.columns(schemas.VAULT)
VAULT_SQL = (
    "section_id, pos, ledger_id, tag, token_length, round(loss, 6) AS loss, recycle_count, last_recycled_round, active, "
    "retired_reason, first_seen_round, last_seen_round, round(last_loss, 6) AS last_loss, "
    "round(best_recycle_loss, 6) AS best_recycle_loss"
)

# --- filters and ledger -----------------------------------------------------------------------

register(
    "is_finite",
    lambda t: t.raw_evaluations().select("slot_id", tx.is_finite("loss").alias("finite"), tx.finite_or_null("loss").alias("loss")),
    "SELECT slot_id, coalesce(isfinite(try_cast(loss AS DOUBLE)), false) AS finite, "
    "round(CASE WHEN isfinite(try_cast(loss AS DOUBLE)) THEN CAST(loss AS DOUBLE) END, 6) AS loss FROM evals",
)
register(
    "split_finite",
    lambda t: _split(t),
    "SELECT section_id, round_id, CASE WHEN isfinite(try_cast(loss AS DOUBLE)) THEN 'kept' ELSE 'dropped' END AS side, slot_id, tag "
    "FROM evals",
)


def _split(t: Tables):
    kept, dropped = lg.split_finite(t.raw_evaluations())
    side = lambda df, s: df.select("section_id", "round_id", F.lit(s).alias("side"), "slot_id", "tag")
    return side(kept, "kept").unionByName(side(dropped, "dropped"))


register(
    "evaluation_events",
    lambda t: lg.evaluation_events(lg.split_finite(t.raw_evaluations())[1]).select(
        "section_id", "event_type", F.get_json_object("payload", "$.tag").alias("tag"),
        F.get_json_object("payload", "$.instruct_preview").alias("instruct_preview"),
        F.get_json_object("payload", "$.sample_preview").alias("sample_preview"),
    ),
    "SELECT section_id, 'nonfinite_evaluations_dropped' AS event_type, tag, instruct AS instruct_preview, sample AS sample_preview "
    "FROM evals WHERE NOT coalesce(isfinite(try_cast(loss AS DOUBLE)), false)",
)
register(
    "generated_only",
    lambda t: lg.generated_only(t.ledger()).groupBy("section_id").agg(
        F.count("*").alias("n"), F.sum("ledger_id").alias("id_sum")
    ),
    "SELECT section_id, count(*) AS n, CAST(sum(ledger_id) AS BIGINT) AS id_sum FROM gen GROUP BY 1",
)
register(
    "declared_generated",
    lambda t: lg.declared_generated(_nullable_source(t)).select("section_id", "ledger_id", "tag"),
    "SELECT section_id, ledger_id, tag FROM ledger WHERE source = 'generated' OR ledger_id % 11 = 0",
)


def _nullable_source(t: Tables):
    return t.ledger().withColumn("source", F.when(F.col("ledger_id") % 11 != 0, F.col("source")))


register(
    "recent_generated",
    lambda t: lg.recent_generated(t.ledger(), t.rounds()).select("section_id", "ledger_id", "round_id", "loss"),
    "SELECT g.section_id, ledger_id, round_id, round(loss, 6) AS loss FROM gen g JOIN rounds r USING (section_id) "
    "WHERE round_id >= greatest(0, current_round - 2) AND loss >= 0.15",
)
register(
    "latest_round",
    lambda t: lg.latest_round(t.ledger()).select("section_id", "round_id", "ledger_id"),
    "SELECT l.section_id, l.round_id, l.ledger_id FROM ledger l JOIN rounds r ON l.section_id = r.section_id AND l.round_id = r.current_round",
)
register(
    "assign_ids",
    lambda t: lg.assign_ids(_late(t), _early(t)).select("section_id", "slot_id", "ledger_id"),
    "SELECT l.section_id, l.ledger_id AS slot_id, m.top + row_number() OVER (PARTITION BY l.section_id ORDER BY l.round_id, l.ledger_id) AS ledger_id "
    "FROM ledger l JOIN (SELECT section_id, max(ledger_id) AS top FROM ledger WHERE round_id < 10 GROUP BY 1) m USING (section_id) "
    "WHERE round_id >= 10",
)
register(
    "append_rows",
    lambda t: lg.append_ledger(_late(t), _early(t)).select("section_id", "round_id", "ledger_id", "tag", "sample", "loss"),
    "SELECT section_id, round_id, id AS ledger_id, tag, sample, round(loss, 6) AS loss FROM ("
    "SELECT section_id, round_id, loss, tag, sample, ledger_id AS id FROM ledger WHERE round_id < 10 UNION ALL "
    "SELECT l.section_id, l.round_id, l.loss, l.tag, l.sample, m.top + row_number() OVER (PARTITION BY l.section_id ORDER BY l.round_id, l.ledger_id) "
    "FROM ledger l JOIN (SELECT section_id, max(ledger_id) AS top FROM ledger WHERE round_id < 10 GROUP BY 1) m USING (section_id) "
    "WHERE l.round_id >= 10)",
)


def _late(t: Tables):
    return t.raw_evaluations().where(F.col("round_id") >= 10).where(tx.is_finite("loss")).withColumn("loss", tx.finite_or_null("loss"))


def _early(t: Tables):
    return t.ledger().where(F.col("round_id") < 10)


register(
    "number_rows",
    lambda t: rk.number_rows(t.ledger(), ["section_id"], "ledger_id", "pos").select("section_id", "ledger_id", "pos"),
    "SELECT section_id, ledger_id, row_number() OVER (PARTITION BY section_id ORDER BY ledger_id) - 1 AS pos FROM ledger",
)
register(
    "percentile_nearest_rank",
    lambda t: rk.percentile_nr(t.ledger(), ["section_id"], "loss", 0.75, "p75").join(
        rk.percentile_nr(t.ledger(), ["section_id"], "loss", 0.10, "p10"), "section_id"
    ),
    "SELECT section_id, round(list_sort(list(loss))[CAST(round_even((count(*) - 1) * 0.75, 0) AS BIGINT) + 1], 6) AS p75, "
    "round(list_sort(list(loss))[CAST(round_even((count(*) - 1) * 0.10, 0) AS BIGINT) + 1], 6) AS p10 FROM ledger GROUP BY 1",
)
register(
    "tag_counts",
    lambda t: lg.tag_counts(t.ledger(), "section_id", "round_id"),
    "SELECT section_id, round_id, tag, count(*) AS n FROM ledger GROUP BY ALL",
)
register(
    "source_counts",
    lambda t: lg.source_counts(t.ledger(), "section_id", "tag"),
    "SELECT section_id, tag, count(*) FILTER (WHERE source = 'generated') AS generated, "
    "count(*) FILTER (WHERE source = 'recycled') AS recycled FROM ledger GROUP BY 1, 2",
)
register(
    "sync_tag_counts",
    lambda t: lg.sync_tag_counts(t.state_counts(), t.ledger()),
    "SELECT section_id, tag, CAST(n AS BIGINT) AS n FROM sync_counts",
)
register(
    "known_categories",
    lambda t: lg.known_categories(lg.tag_counts(t.messy_tags(), "section_id")),
    f"SELECT section_id, {q.norm('tag')} AS tag, count(*) AS n FROM messy WHERE {q.norm('tag')} NOT IN ('', 'good', 'wide_variety') GROUP BY 1, 2",
)
register(
    "render_tag_counts",
    lambda t: lg.render_tag_counts(lg.sync_tag_counts(t.state_counts(), t.ledger())),
    "SELECT a.section_id, a.tag_counts_text, b.categories_text FROM "
    "(SELECT section_id, string_agg('- ' || tag || ': ' || n, chr(10) ORDER BY tag) AS tag_counts_text FROM sync_counts GROUP BY 1) a "
    "LEFT JOIN (SELECT section_id, string_agg('- ' || tag || ' (' || n || ')', chr(10) ORDER BY n DESC, tag) AS categories_text "
    "FROM categories GROUP BY 1) b USING (section_id)",
)
register(
    "render_frequent_tags",
    lambda t: lg.render_tag_counts(lg.sync_tag_counts(t.state_counts(), t.ledger()), replace(DEFAULTS, prompt_tags=3)).select("section_id", "tag_counts_text"),
    """SELECT section_id, array_to_string(list_append(list('- ' || tag || ': ' || n ORDER BY tag) FILTER (WHERE place <= 3),
         CASE WHEN count(*) > 3 THEN '- ' || (count(*) - 3) || ' others: ' || CAST(sum(n) FILTER (WHERE place > 3) AS BIGINT) END), chr(10)) AS tag_counts_text
       FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY n DESC, tag) AS place FROM sync_counts) GROUP BY 1""",
)
register(
    "loss_list",
    lambda t: lg.loss_list(t.ledger(), t.vault().where(F.col("section_id") < "section_010")),
    "SELECT section_id, ledger_id, tag, token_length, round(loss, 6) AS loss FROM vault WHERE section_id < 'section_010' UNION ALL "
    "SELECT section_id, ledger_id, tag, token_length, round(loss, 6) FROM ledger WHERE section_id >= 'section_010'",
)
register(
    "recent_distinct",
    lambda t: lg.recent_distinct(t.ledger(), "instruct"),
    "SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY rn) AS INTEGER) AS pos, text FROM ("
    "SELECT section_id, substr(instruct, 1, 140) AS text, min(rn) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY section_id "
    "ORDER BY ledger_id DESC) AS rn FROM ledger) WHERE rn <= 25 GROUP BY 1, 2) QUALIFY pos <= 3",
)
register(
    "keep_last",
    lambda t: lg.keep_last(t.round_losses(), 7).select("section_id", "round_id", "decision_loss"),
    "SELECT section_id, round_id, round(decision_loss, 6) AS decision_loss FROM health_in "
    "QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY round_id DESC) <= 7",
)
register(
    "ordered_union",
    lambda t: t.ledger().select(
        "ledger_id",
        F.array_join(lg.ordered_union(F.array("tag", "source"), F.array(F.lit("generated"), "tag", F.lit("view"))), "|").alias("u"),
    ),
    "SELECT ledger_id, array_to_string(list_filter([tag, source, 'generated', tag, 'view'], "
    "lambda x, i: list_position([tag, source, 'generated', tag, 'view'], x) = i), '|') AS u FROM ledger",
)

# --- vault ------------------------------------------------------------------------------------

register(
    "vault_status",
    lambda t: t.vault().join(t.next_rounds(), "section_id").select(
        "section_id", "ledger_id", vt.vault_status("current_round").alias("status")
    ),
    f"SELECT v.section_id, ledger_id, {q.status('r.current_round + 1', 'v.')} AS status FROM vault v JOIN rounds r USING (section_id)",
)
register(
    "keep_priority",
    lambda t: t.vault().join(t.next_rounds(), "section_id").select(
        "section_id", "ledger_id", vt.keep_priority("current_round").alias("p")
    ).select("section_id", "ledger_id", "p.*"),
    f"SELECT v.section_id, ledger_id, {q.rank_of(q.status('r.current_round + 1', 'v.'))} AS status_rank, round(loss, 6) AS loss, "
    "coalesce(last_seen_round, -1) AS seen FROM vault v JOIN rounds r USING (section_id)",
)
register(
    "recyclable",
    lambda t: vt.recyclable(t.vault(), t.next_rounds()).select("section_id", "ledger_id"),
    f"SELECT v.section_id, ledger_id FROM vault v JOIN rounds r USING (section_id) WHERE {q.status('r.current_round + 1', 'v.')} = 'usable'",
)
register(
    "prune_low_loss",
    lambda t: vt.prune_low_loss(t.vault(), 1.0).select("section_id", "ledger_id", "loss"),
    "SELECT section_id, ledger_id, round(loss, 6) AS loss FROM vault WHERE loss >= 1.0",
)
register("mark_vault", lambda t: vt.mark_vault(_easy_vault(t)).select(*VAULT_COLS),
         f"SELECT {VAULT_SQL} FROM ({q.marked('(SELECT * REPLACE (loss * (pos % 3) / 4 AS loss) FROM vault)')})")


def _easy_vault(t: Tables):
    return t.vault().withColumn("loss", F.col("loss") * (F.col("pos") % 3) / 4)


register(
    "update_vault_scores",
    lambda t: vt.update_vault_scores(t.vault(), t.recycled_evaluations(), t.rounds()),
    f"SELECT {VAULT_SQL} FROM rescored",
)
register(
    "to_vault_items",
    lambda t: vt.to_vault_items(
        t.ledger().join(t.vault().select("section_id"), "section_id", "left_semi"), t.vault()
    ).select(*VAULT_COLS),
    "SELECT l.section_id, v.pos, l.ledger_id, l.tag, l.token_length, round(l.loss, 6) AS loss, coalesce(v.recycle_count, 0) AS recycle_count, "
    "v.last_recycled_round, coalesce(v.active, true) AS active, v.retired_reason, coalesce(v.first_seen_round, l.round_id) AS first_seen_round, "
    "l.round_id AS last_seen_round, round(l.loss, 6) AS last_loss, round(v.best_recycle_loss, 6) AS best_recycle_loss "
    "FROM ledger l LEFT JOIN vault v ON v.section_id = l.section_id AND v.ledger_id = l.ledger_id",
)
register(
    "lowest_half_avg",
    lambda t: vt.lowest_half_avg(vt.mark_vault(vt.update_vault_scores(t.vault(), t.recycled_evaluations(), t.rounds()))),
    "SELECT section_id, round(lowest_half_avg, 6) AS lowest_half_avg FROM low_half",
)
register(
    "entry_threshold",
    lambda t: vt.entry_threshold(
        lg.generated_only(lg.latest_round(t.ledger())),
        vt.update_vault_scores(t.vault(), t.recycled_evaluations(), t.rounds()), t.rounds(),
    ),
    "SELECT section_id, round(round_avg, 6) AS round_avg, round(lowest_half_avg, 6) AS lowest_half_avg, "
    "round(minimum_entry_loss, 6) AS minimum_entry_loss FROM thresholds",
)
register(
    "admit",
    lambda t: _admitted(t).select("section_id", "ledger_id", "loss", "keep_rank"),
    "SELECT section_id, ledger_id, round(loss, 6) AS loss, CAST(keep_rank AS INTEGER) AS keep_rank FROM admitted",
)
register(
    "refill",
    lambda t: vt.refill(_admitted(t), t.ledger(), t.rounds()).select("section_id", "ledger_id", "loss"),
    "SELECT section_id, ledger_id, round(loss, 6) AS loss FROM refilled",
)


def _admitted(t: Tables):
    rows = lg.generated_only(lg.latest_round(t.ledger()))
    old = vt.mark_vault(vt.update_vault_scores(t.vault(), t.recycled_evaluations(), t.rounds()))
    return vt.admit(old, vt.round_candidates(rows, old, vt.entry_threshold(rows, old, t.rounds())), t.rounds())


def new_vault(t: Tables):
    return vt.build_vault(t.shared_ledger(), t.recycled_evaluations(), t.vault(), t.rounds())


register("build_vault", new_vault, f"SELECT {VAULT_SQL} FROM new_vault")
register(
    "vault_analytics",
    lambda t: vt.vault_analytics(new_vault(t), t.next_rounds()),
    f"""SELECT section_id, count(*) AS total_failures_tracked,
        count(*) FILTER (WHERE st IN ('usable', 'cooling_down')) AS active_failures,
        count(*) FILTER (WHERE st = 'usable') AS usable_failures, count(*) FILTER (WHERE st = 'cooling_down') AS cooling_down_failures,
        count(*) FILTER (WHERE st = 'exhausted') AS exhausted_failures, count(*) FILTER (WHERE st = 'retired') AS retired_failures,
        round(avg(loss), 6) AS avg_loss, round(avg(token_length), 6) AS avg_token_length,
        arg_max(tag, (tag_n, -tag_first)) AS most_problematic_category
        FROM (SELECT v.*, {q.status('r.current_round + 1', 'v.')} AS st, count(*) OVER (PARTITION BY v.section_id, tag) AS tag_n,
              min(pos) OVER (PARTITION BY v.section_id, tag) AS tag_first FROM new_vault v JOIN rounds r USING (section_id)) GROUP BY 1""",
)
register(
    "vault_avg_loss",
    lambda t: vt.vault_avg_loss(t.vault()),
    "SELECT section_id, round(avg(loss), 6) AS avg_loss FROM vault GROUP BY 1",
)

# --- health -----------------------------------------------------------------------------------

register(
    "round_losses",
    lambda t: hl.round_losses(t.ledger()),
    "SELECT section_id, round_id, round(decision_loss, 6) AS decision_loss FROM health_in",
)
register(
    "running_best",
    lambda t: hl.running_best(t.round_losses()).drop("complete"),
    "SELECT section_id, round_id, round(decision_loss, 6) AS decision_loss, round(min(decision_loss) OVER w, 6) AS best_so_far, "
    "arg_min(round_id, (decision_loss, round_id)) OVER w AS best_so_far_round FROM health_in "
    "WINDOW w AS (PARTITION BY section_id ORDER BY round_id)",
)
register(
    "improvement",
    lambda t: hl.improvement(t.round_losses()).select("section_id", "round_id", "improvement"),
    "SELECT section_id, round_id, round((lag(decision_loss) OVER w - decision_loss) / lag(decision_loss) OVER w, 6) AS improvement "
    "FROM health_in WINDOW w AS (PARTITION BY section_id ORDER BY round_id)",
)
register(
    "rollback_target",
    lambda t: hl.rollback_target(t.round_losses()),
    "SELECT section_id, round_id, round(decision_loss, 6) AS decision_loss, complete, target_round, round(target_loss, 6) AS target_loss FROM targets",
)
register(
    "round_health",
    lambda t: hl.round_health(t.round_losses()).drop("previous_best_loss", "previous_raw_best_loss"),
    "SELECT section_id, round_id, round(decision_loss, 6) AS decision_loss, round(best, 6) AS best_eval_loss, best_round AS best_round_id, "
    "round(raw, 6) AS raw_best_eval_loss, raw_round AS raw_best_round_id, streak AS bad_round_streak, override AS base_override_round, "
    "rolled AS rollback_round, action FROM health",
)
register(
    "latest_health",
    lambda t: hl.latest_health(hl.round_health(t.round_losses())).select("section_id", "round_id", "action"),
    "SELECT section_id, round_id, action FROM health QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY round_id DESC) = 1",
)
register(
    "plateau_score",
    lambda t: hl.plateau_score(hl.round_health(t.round_losses())),
    "SELECT section_id, round_id, rounds_since_best, recent_degraded, round(validation_plateau, 6) AS validation_plateau FROM plateau",
)
register(
    "base_checkpoint",
    lambda t: hl.base_checkpoint(
        t.round_losses(),
        hl.latest_health(hl.round_health(t.round_losses())).select(
            "section_id", (F.col("round_id") + 1).alias("current_round"), "base_override_round"
        ),
    ),
    """SELECT section_id, current_round, coalesce(o, l) AS base_round, o IS NOT NULL AS used_override FROM (
       SELECT s.section_id, s.round_id + 1 AS current_round, max(c.round_id) FILTER (WHERE c.round_id = s.override) AS o,
              max(c.round_id) FILTER (WHERE c.round_id <= s.round_id) AS l
       FROM (SELECT * FROM health QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY round_id DESC) = 1) s
       LEFT JOIN (SELECT * FROM health_in WHERE complete) c ON c.section_id = s.section_id GROUP BY 1, 2)""",
)

# --- tag metrics and plan ---------------------------------------------------------------------

register(
    "per_tag_loss",
    lambda t: po.per_tag_loss(t.ledger(), t.vault()),
    "SELECT section_id, tag, round(avg_loss, 6) AS avg_loss, n, oldest_ledger_id FROM metrics",
)
register(
    "per_tag_loss_fallback",
    lambda t: po.per_tag_loss(
        t.ledger().where((F.col("section_id") < "section_010") | (F.col("source") == "recycled")), t.vault()
    ),
    "SELECT section_id, tag, round(avg_loss, 6) AS avg_loss, n, oldest_ledger_id FROM metrics WHERE section_id < 'section_010' UNION ALL "
    "SELECT section_id, tag, round(avg(loss), 6), count(*), min(ledger_id) FROM vault WHERE section_id >= 'section_010' GROUP BY 1, 2",
)
register(
    "order_metrics",
    lambda t: po.order_metrics(po.per_tag_loss(t.ledger())).select("section_id", "tag", "metric_rank"),
    "SELECT section_id, tag, CAST(row_number() OVER (PARTITION BY section_id ORDER BY avg_loss DESC, oldest_ledger_id, n DESC, tag) AS INTEGER) AS metric_rank FROM metrics",
)


def _groups(t: Tables):
    """A supplied grouping for some sections: two groups by tag length, and a lone unknown tag."""
    tags = t.ledger().select("section_id", "tag").distinct().where(F.col("section_id") < "section_010")
    by_len = tags.groupBy("section_id", F.concat(F.lit("len_"), (F.length("tag") % 2).cast("string")).alias("tag")).agg(
        F.sort_array(F.collect_list("tag")).alias("source_tags")
    ).withColumn("avg_loss", F.length("tag") * 0.25)
    lone = tags.select("section_id").distinct().select(
        "section_id", F.lit("unknown").alias("tag"), F.lit(None).cast("array<string>").alias("source_tags"), F.lit(0.5).alias("avg_loss")
    )
    return by_len.unionByName(lone)


register(
    "apply_tag_groups",
    lambda t: po.apply_tag_groups(po.per_tag_loss(t.ledger()), _groups(t)),
    "SELECT section_id, tag, round(avg_loss, 6) AS avg_loss, n, oldest_ledger_id FROM metrics WHERE section_id >= 'section_010' UNION ALL "
    "SELECT l.section_id, 'len_' || (length(l.tag) % 2), 1.25::DOUBLE, count(DISTINCT l.tag), coalesce(min(m.oldest_ledger_id), 0) FROM ledger l "
    "LEFT JOIN metrics m ON m.section_id = l.section_id AND m.tag = l.tag WHERE l.section_id < 'section_010' GROUP BY 1, 2, 3 UNION ALL "
    "SELECT DISTINCT section_id, 'unknown', 0.5::DOUBLE, 1, 0 FROM ledger WHERE section_id < 'section_010'",
)
register(
    "allocate_slots",
    lambda t: po.allocate_slots(po.per_tag_loss(t.ledger())),
    "SELECT section_id, CAST(metric_rank AS INTEGER) AS metric_rank, tag, round(avg_loss, 6) AS avg_loss, slots FROM allocated",
)
register(
    "tag_plan",
    lambda t: po.explode_plan(po.tag_plan(t.rounds(), po.allocate_slots(po.per_tag_loss(t.ledger())))),
    "SELECT section_id, CAST(unnest(range(1, 11)) AS INTEGER) AS slot_id, unnest(plan) AS tag FROM plan",
)
register(
    "fallback_tags",
    lambda t: po.fallback_tags(lg.sync_tag_counts(t.state_counts(), t.ledger())).select("section_id", text("fallback")),
    "SELECT section_id, string_agg(tag, '|' ORDER BY n DESC, tag) AS fallback FROM (SELECT * FROM sync_counts "
    f"WHERE tag <> 'good' AND NOT {q.explore('tag')} QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY n DESC, tag) <= 6) GROUP BY 1",
)
register(
    "cycle_to",
    lambda t: po.fallback_tags(t.state_counts(), n=4).select(
        "section_id", F.array_join(po.cycle_to(F.col("fallback"), 9), "|").alias("cycled")
    ),
    "SELECT section_id, array_to_string(list_resize(list_concat(l, l, l, l, l, l, l, l, l), 9), '|') AS cycled FROM "
    "(SELECT section_id, list(tag ORDER BY n DESC, tag) AS l FROM (SELECT * FROM state_counts "
    "QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY n DESC, tag) <= 4) GROUP BY 1)",
)
register(
    "first_recipe",
    lambda t: po.first_recipe(t.rounds().withColumn("current_round", F.lit(0)), t.state_counts()),
    "SELECT section_id, 0 AS round_id, CAST(unnest(range(1, 11)) AS INTEGER) AS slot_id, 'generate' AS command, "
    "unnest(list_concat(['wide_variety', 'wide_variety', 'wide_variety', 'wide_variety'], list_resize(list_concat(l, l, l, l, l, l), 6))) AS tag, "
    "NULL::BIGINT AS failure_ledger_id FROM (SELECT section_id, list(tag ORDER BY n DESC, tag) AS l FROM state_counts GROUP BY 1)",
)

# --- pressure ---------------------------------------------------------------------------------

register(
    "starvation_score",
    lambda t: po.starvation_score(new_vault(t), t.next_rounds()),
    f"""SELECT section_id, usable_count, round(usable_avg_loss, 6) AS usable_avg_loss, CASE WHEN usable_count = 0 THEN 1.0
        WHEN usable_count < 3 THEN 0.85 WHEN usable_avg_loss < 0.35 THEN 0.65 ELSE 0.0 END::DOUBLE AS vault_starvation FROM (
        SELECT r.section_id, count(v.ledger_id) AS usable_count, avg(v.loss) AS usable_avg_loss FROM rounds r
        LEFT JOIN new_vault v ON v.section_id = r.section_id AND {q.status('r.current_round + 1', 'v.')} = 'usable' GROUP BY 1)""",
)
register(
    "easy_batch_score",
    lambda t: po.easy_batch_score(t.ledger(), "section_id", "round_id"),
    "SELECT section_id, round_id, record_count, round(avg_loss, 6) AS avg_loss, round(max_loss, 6) AS max_loss, "
    "round(p75_loss, 6) AS p75_loss, round(easy_batch, 6) AS easy_batch FROM easy_scored",
)


def pressure_scores(t: Tables):
    """Component scores per section and round; easy losses are scaled down so that all bands occur."""
    easy = po.easy_batch_score(t.shared_ledger().withColumn("loss", F.col("loss") * _fade()), "section_id", "round_id")
    flat = hl.plateau_score(hl.round_health(t.round_losses()))
    return easy.join(flat, ["section_id", "round_id"]).select(
        "section_id", "round_id", "easy_batch", "validation_plateau",
        F.when(F.col("round_id") % 4 == 0, 0.0).when(F.col("round_id") % 4 == 1, 0.85).otherwise(1.0).alias("vault_starvation"),
        F.when(F.col("round_id") % 3 == 0, 0.55).otherwise(0.9).alias("shape_gap"),
    )


def _fade():
    return F.when(F.col("round_id") % 5 < 3, 0.1).otherwise(1.0)


q.PARTS["pressure_in"] = """
    SELECT e.section_id, e.round_id, p.validation_plateau,
           least(1.0, CASE WHEN avg(e.loss) < 0.18 THEN 0.45 ELSE 0 END
             + CASE WHEN list_sort(list(e.loss))[CAST(round_even((count(*) - 1) * 0.75, 0) AS BIGINT) + 1] < 0.35 THEN 0.35 ELSE 0 END
             + CASE WHEN max(e.loss) < 0.5 THEN 0.2 ELSE 0 END)::DOUBLE AS easy_batch,
           CASE e.round_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.85 ELSE 1.0 END::DOUBLE AS vault_starvation,
           CASE WHEN e.round_id % 3 = 0 THEN 0.55 ELSE 0.9 END::DOUBLE AS shape_gap
    FROM (SELECT * REPLACE (loss * CASE WHEN round_id % 5 < 3 THEN 0.1 ELSE 1 END::DOUBLE AS loss) FROM gen) e
    JOIN plateau p USING (section_id, round_id) GROUP BY 1, 2, 3"""
q.PARTS["pressure_steps"] = """
    SELECT *, count(*) FILTER (WHERE candidate) OVER (PARTITION BY section_id ORDER BY round_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hits,
           row_number() OVER (PARTITION BY section_id ORDER BY round_id) AS step
    FROM (SELECT *, round_id >= 3 AND score >= 0.65 AS candidate FROM (
          SELECT *, 0.3::DOUBLE * vault_starvation + 0.25::DOUBLE * easy_batch + 0.25::DOUBLE * validation_plateau + 0.2::DOUBLE * shape_gap AS score
          FROM pressure_in))"""
q.PARTS["pressure"] = """
    SELECT * FROM (WITH RECURSIVE f AS (
      SELECT section_id, step, round_id, score, candidate, hits, false AS hard_active, -1 AS cooldown_until FROM pressure_steps WHERE step = 1
      UNION ALL
      SELECT s.section_id, s.step, s.round_id, s.score, s.candidate, s.hits,
             s.candidate AND s.hits >= 2 AND s.round_id > f.cooldown_until,
             CASE WHEN s.candidate AND s.hits >= 2 AND s.round_id > f.cooldown_until THEN s.round_id + 1 ELSE f.cooldown_until END
      FROM f JOIN pressure_steps s ON s.section_id = f.section_id AND s.step = f.step + 1)
    SELECT * FROM f)"""
register(
    "learning_pressure",
    lambda t: po.learning_pressure(pressure_scores(t)).select(
        "section_id", "round_id", "score", "candidate", "hits", "hard_active", "cooldown_until", "hard_slots"
    ),
    "SELECT section_id, round_id, round(score, 6) AS score, candidate, hits, hard_active, cooldown_until, "
    "CASE WHEN hard_active THEN 3 ELSE 0 END AS hard_slots FROM pressure",
)

# --- reports ----------------------------------------------------------------------------------

register(
    "round_summary",
    lambda t: rp.round_summary(t.ledger()),
    """SELECT a.*, b.top_tags FROM (SELECT section_id, round_id, count(*) AS records, round(avg(loss), 6) AS avg_loss, round(min(loss), 6) AS min_loss,
       round(max(loss), 6) AS max_loss, count(*) FILTER (WHERE source <> 'recycled') AS generated_records,
       count(*) FILTER (WHERE source = 'recycled') AS recycled_records FROM ledger GROUP BY 1, 2) a
       JOIN (SELECT section_id, round_id, string_agg(tag || ':' || n, '; ' ORDER BY n DESC, f) AS top_tags FROM (
         SELECT section_id, round_id, tag, count(*) AS n, min(ledger_id) AS f FROM ledger GROUP BY 1, 2, 3
         QUALIFY row_number() OVER (PARTITION BY section_id, round_id ORDER BY count(*) DESC, min(ledger_id)) <= 5) GROUP BY 1, 2) b
       USING (section_id, round_id)""",
)
register(
    "tag_summary",
    lambda t: rp.tag_summary(t.ledger()),
    "SELECT section_id, tag, count(*) AS records, round(avg(loss), 6) AS avg_loss, round(max(loss), 6) AS max_loss, "
    "count(*) FILTER (WHERE source <> 'recycled') AS generated_records, count(*) FILTER (WHERE source = 'recycled') AS recycled_records "
    "FROM ledger GROUP BY 1, 2",
)
register(
    "ledger_rollup",
    lambda t: rp.ledger_rollup(t.ledger()),
    "SELECT section_id, round_id, tag, count(*) AS records, round(avg(loss), 6) AS avg_loss, "
    "count(*) FILTER (WHERE source <> 'recycled') AS generated_records, count(*) FILTER (WHERE source = 'recycled') AS recycled_records, "
    "3 - CASE grouping_id(section_id, round_id, tag) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS level "
    "FROM ledger GROUP BY ROLLUP (section_id, round_id, tag)",
)


def eval_losses(t: Tables):
    """Tags as runs, sections as evaluation sets, ids as batch numbers."""
    return t.ledger().select(F.col("section_id").alias("eval_set"), F.col("tag").alias("run"), F.col("ledger_id").alias("batch_index"), "loss")


q.PARTS["eval_stats"] = """
    SELECT section_id AS eval_set, tag AS run, count(*) AS batches, arg_min(loss, ledger_id) AS first_loss, avg(loss) AS avg_loss,
           min(loss) AS min_loss, max(loss) AS max_loss, arg_max(loss, ledger_id) AS last_loss FROM ledger GROUP BY 1, 2"""
_EVAL = (
    "SELECT s.eval_set, s.run, s.batches, round(s.first_loss, 6) AS first_loss, round(s.avg_loss, 6) AS avg_loss, round(s.min_loss, 6) AS min_loss, "
    "round(s.max_loss, 6) AS max_loss, round(s.last_loss, 6) AS last_loss, round(s.avg_loss - b.avg_loss, 6) AS delta_vs_baseline, "
    "round((s.avg_loss - b.avg_loss) / b.avg_loss, 6) AS pct_gap_vs_baseline FROM eval_stats s "
    "LEFT JOIN eval_stats b ON b.eval_set = s.eval_set AND b.run = 'view'"
)
register("eval_summary", lambda t: rp.eval_summary(eval_losses(t), "view"), _EVAL)
register(
    "eval_vs_baseline",
    lambda t: rp.eval_vs_baseline(
        eval_losses(t).groupBy("eval_set", "run").agg(F.avg("loss").alias("avg_loss")), "click"
    ),
    "SELECT s.eval_set, s.run, round(s.avg_loss, 6) AS avg_loss, round(s.avg_loss - b.avg_loss, 6) AS delta_vs_baseline, "
    "round((s.avg_loss - b.avg_loss) / b.avg_loss, 6) AS pct_gap_vs_baseline FROM eval_stats s "
    "LEFT JOIN eval_stats b ON b.eval_set = s.eval_set AND b.run = 'click'",
)


def _recipes(t: Tables):
    """The ledger seen as past recipes: one slot per record."""
    return t.ledger().select(
        "section_id", "round_id", F.when(F.col("source") == "recycled", "recycle").otherwise("generate").alias("command")
    )


register(
    "round_trend",
    lambda t: rp.round_trend(_recipes(t), t.ledger(), hl.round_health(t.round_losses())),
    """SELECT h.section_id, h.round_id, s.g AS generated_slots, s.r AS recycle_slots, round(s.a, 6) AS training_avg_loss,
       round(h.decision_loss, 6) AS validation_avg_loss, round(h.raw, 6) AS best_validation_so_far, h.action AS health_action, s.n AS new_ledger_records
       FROM health h JOIN (SELECT section_id, round_id, avg(loss) AS a, count(*) AS n, count(*) FILTER (WHERE source = 'generated') AS g,
       count(*) FILTER (WHERE source = 'recycled') AS r FROM ledger GROUP BY 1, 2) s USING (section_id, round_id)""",
)
