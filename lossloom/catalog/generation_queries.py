"""Requests to an outside generator, judged attempts and grouped tags."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom import fixed_values as fx
from lossloom.catalog import sql as q
from lossloom.catalog.adapters import Tables
from lossloom.catalog.batch_queries import blueprints, counts, recipe
from lossloom.catalog.registry import register
from lossloom.operators import batch as bt
from lossloom.operators import generation as gen
from lossloom.operators import policy as po
from lossloom.operators.ledger import tag_counts
from lossloom.params import DEFAULTS
from lossloom.plans.workspace import settle

# --- attempts ---------------------------------------------------------------------------------


def _counts(t: Tables) -> DataFrame:
    """Ledger counts in which one tag dominates every section."""
    return tag_counts(t.ledger(), "section_id").withColumn("n", F.when(F.col("tag") == "view", F.col("n") * 4).otherwise(F.col("n")))


def _slots(t: Tables) -> DataFrame:
    """Every section and round with the slots that its records name, and what the generator will say about each."""
    slot = (F.col("ledger_id") % 10 + 1).cast("int")
    return t.ledger().groupBy("section_id", "round_id", slot.alias("slot_id")).agg(
        F.min("ledger_id").alias("k"), F.min_by("tag", "ledger_id").alias("tag0"), F.max_by("tag", "ledger_id").alias("tag1")
    )


def _wanted(t: Tables) -> DataFrame:
    s = F.col("slot_id")
    explores = s % 3 != 0
    return t.once("asked_slots", lambda: _slots(t)).select(
        *gen.SLOT, (s - 1).alias("generation_index"), F.when(explores, "wide_variety").otherwise("slot_tag").alias("tag"), explores.alias("is_exploration"), (s == 1).alias("forced")
    )


def _row(tag, sample="s", instruct="i", gold="g"):
    parts = [F.lit(x) if isinstance(x, str) else x for x in (sample, instruct, gold)]
    return F.to_json(F.struct("slot_id", parts[0].alias("sample"), parts[1].alias("instruct"), parts[2].alias("gold_summary"), tag.alias("tag")))


def _answers(t: Tables, attempt: int) -> DataFrame:
    """Answers with slots left out, blank samples and missing gold answers; some batches are broken as a whole."""
    s, k = t.once("asked_slots", lambda: _slots(t)), F.col("k")
    if attempt == 0:
        row = _row(F.col("tag0"), F.when(k % 7 == 1, " ").otherwise("s"), "i", F.when(k % 7 == 2, "").otherwise("g"))
        listed = s.where(k % 7 != 0).groupBy("section_id", "round_id").agg(F.array_join(F.sort_array(F.collect_list(row)), ",").alias("rows"))
        end = F.when(F.col("round_id") % 9 == 4, "").otherwise("]")
        return listed.select("section_id", "round_id", F.concat(F.lit("["), "rows", end).alias("response"))
    if attempt == 1:
        tag = F.when(F.col("slot_id") == 1, "Factual QA").otherwise(F.col("tag1"))
        return s.where(k % 5 != 0).select(*gen.SLOT, _row(tag, "second", F.when(k % 5 == 1, "").otherwise("i")).alias("response"))
    return s.where(k % 3 != 0).select(*gen.SLOT, F.concat(F.lit("Here: "), _row(F.lit("error"), "third")).alias("response"))


def _attempts(t: Tables) -> DataFrame:
    def build():
        wanted, known = _wanted(t), _counts(t)
        used = wanted.select("section_id", "round_id", F.lit("error").alias("tag")).distinct()
        done = t.spark.createDataFrame([], gen.ATTEMPT)
        for attempt in range(3):
            done = settle(done.unionByName(gen.judge_answers(wanted, done, _answers(t, attempt), known, used, attempt)))
        return done

    return t.once("attempts", build)


def _fold(steps: str, seen: str, limit: int = 1) -> str:
    """The diversity rules over numbered steps, as a recursion; ``seen`` are the tags that a round has used before."""
    why = (
        "CASE WHEN NOT s.explore THEN NULL WHEN s.forced THEN CASE WHEN s.tag NOT IN " + str(tuple(fx.CONTEXTUAL_TAGS)) + " THEN 'not_contextual' END "
        f"WHEN len(list_filter({{seen}}, lambda x: x = s.tag)) >= {limit} THEN 'tag_in_round' "
        "WHEN s.n + len(list_filter({own}, lambda x: x = s.tag)) >= 3 AND (s.n + len(list_filter({own}, lambda x: x = s.tag))) / (s.total + len({own})) >= 0.35 THEN 'tag_dominates_section' END"
    )
    start, following = why.format(seen=seen, own="[]::VARCHAR[]"), why.format(seen="f.seen", own="f.own")
    keep = lambda w, old: f"CASE WHEN ({w}) IS NULL THEN list_append({old}, s.tag) ELSE {old} END"
    return f"""WITH RECURSIVE f AS (
        SELECT s.section_id, s.round_id, s.slot_id, s.tag, s.step, {start} AS why, {keep(start, seen)} AS seen, {keep(start, '[]::VARCHAR[]')} AS own FROM {steps} s WHERE s.step = 1
        UNION ALL
        SELECT s.section_id, s.round_id, s.slot_id, s.tag, s.step, {following}, {keep(following, 'f.seen')}, {keep(following, 'f.own')}
        FROM f JOIN {steps} s ON s.section_id = f.section_id AND s.round_id = f.round_id AND s.step = f.step + 1)
        SELECT section_id, round_id, slot_id, tag, why FROM f"""


_STEP = "row_number() OVER (PARTITION BY a.section_id, a.round_id ORDER BY a.slot_id) AS step"
q.PARTS["asked"] = """
    SELECT section_id, round_id, CAST(ledger_id % 10 + 1 AS INTEGER) AS slot_id, min(ledger_id) AS k, arg_min(tag, ledger_id) AS tag0, arg_max(tag, ledger_id) AS tag1,
           (ledger_id % 10 + 1) % 3 <> 0 AS explore, ledger_id % 10 = 0 AS forced FROM ledger GROUP BY ALL"""
q.PARTS["asked_counts"] = "SELECT section_id, tag, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY section_id) AS total FROM (SELECT section_id, tag, CASE WHEN tag = 'view' THEN 4 ELSE 1 END AS n FROM ledger) GROUP BY 1, 2"
q.PARTS["steps_a"] = f"""
    SELECT a.*, a.tag0 AS tag, c.n, c.total, {_STEP} FROM asked a JOIN asked_counts c ON c.section_id = a.section_id AND c.tag = a.tag0
    WHERE a.k % 7 > 2 AND a.round_id % 9 <> 4"""
q.PARTS["judged_a"] = _fold("steps_a", "['error']")
q.PARTS["tried_a"] = """
    SELECT a.*, f.why, f.tag, CASE WHEN f.tag IS NULL THEN 'missing' WHEN f.why IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
           CASE WHEN f.tag IS NOT NULL THEN f.why WHEN a.round_id % 9 = 4 AND bool_or(a.k % 7 <> 0) OVER (PARTITION BY section_id, round_id) THEN 'invalid_json' WHEN a.k % 7 = 0 THEN 'no_answer' WHEN a.k % 7 = 1 THEN 'missing_sample' ELSE 'missing_gold' END AS reason
    FROM asked a LEFT JOIN judged_a f USING (section_id, round_id, slot_id)"""
q.PARTS["counts_b"] = """
    SELECT section_id, tag, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY section_id) AS total FROM (
      SELECT section_id, tag, n FROM asked_counts UNION ALL SELECT section_id, tag, 1 FROM tried_a WHERE status = 'accepted') GROUP BY 1, 2"""
q.PARTS["steps_b"] = f"""
    SELECT a.*, c.total, coalesce(n.n, 0) AS n, coalesce(u.seen, ['error']) AS seen, {_STEP} FROM (
      SELECT section_id, round_id, slot_id, k, explore, forced, CASE WHEN slot_id = 1 THEN 'factual_qa' ELSE tag1 END AS tag FROM tried_a WHERE status <> 'accepted' AND k % 5 > 1) a
    JOIN (SELECT DISTINCT section_id, total FROM counts_b) c USING (section_id) LEFT JOIN counts_b n ON n.section_id = a.section_id AND n.tag = a.tag
    LEFT JOIN (SELECT section_id, round_id, list_append(list(tag), 'error') AS seen FROM tried_a WHERE status = 'accepted' GROUP BY 1, 2) u ON u.section_id = a.section_id AND u.round_id = a.round_id"""
q.PARTS["judged_b"] = _fold("steps_b", "s.seen")
q.PARTS["tried_b"] = """
    SELECT a.* EXCLUDE (why, tag, status, reason), f.why, f.tag, CASE WHEN f.tag IS NULL THEN 'missing' WHEN f.why IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
           CASE WHEN f.tag IS NOT NULL THEN f.why WHEN a.k % 5 = 0 THEN 'no_answer' ELSE 'missing_instruct' END AS reason
    FROM tried_a a LEFT JOIN judged_b f USING (section_id, round_id, slot_id) WHERE a.status <> 'accepted'"""
q.PARTS["tried_c"] = """
    SELECT a.* EXCLUDE (why, tag, status, reason), CASE WHEN k % 3 <> 0 THEN 'error' END AS tag, CASE WHEN k % 3 = 0 THEN 'missing' ELSE 'accepted' END AS status,
           CASE WHEN k % 3 = 0 THEN 'no_answer' WHEN forced THEN 'after_limit: not_contextual' ELSE 'after_limit: tag_in_round' END AS reason
    FROM tried_b a WHERE a.status <> 'accepted' AND explore"""
_TRIED = "SELECT section_id, round_id, slot_id, {k} AS attempt, status, reason, tag{more} FROM tried_{t}"
_ALL_TRIED = " UNION ALL ".join(_TRIED.format(k=k, t=x, more="") for k, x in enumerate("abc"))
register(
    "judge_answers",
    lambda t: _attempts(t).select(*gen.SLOT, "attempt", "status", "reason", "tag"),
    _ALL_TRIED,
)
register(
    "unfilled_slots",
    lambda t: gen.unfilled(_wanted(t), _attempts(t)),
    f"""SELECT section_id, round_id, slot_id, arg_max(reason, attempt) AS reason FROM ({_ALL_TRIED}) GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE status = 'accepted') = 0""",
)
register(
    "accept_diverse_twice",
    lambda t: bt.accept_diverse(
        _wanted(t).join(_slots(t).select(*gen.SLOT, F.col("tag0").alias("_tag")), gen.SLOT).withColumn("tag", F.col("_tag")).drop("_tag"),
        _counts(t).withColumn("n", F.lit(1).cast("bigint")),  # so few that a batch can make a tag dominate
        t.ledger().where("ledger_id % 20 = 0").select("section_id", "round_id", "tag"), replace(DEFAULTS, tags_per_round=2),
    ).select(*gen.SLOT, "tag", "accepted", "reject_reason"),
    f"SELECT section_id, round_id, slot_id, tag, why IS NULL AS accepted, why AS reject_reason FROM ({_fold('steps_twice', 's.seen', 2)})",
)
q.PARTS["steps_twice"] = f"""
    SELECT a.*, a.tag0 AS tag, 1 AS n, (SELECT count(DISTINCT tag) FROM ledger l WHERE l.section_id = a.section_id) AS total, coalesce(u.seen, []::VARCHAR[]) AS seen, {_STEP}
    FROM asked a LEFT JOIN (SELECT section_id, round_id, list(tag) AS seen FROM ledger WHERE ledger_id % 20 = 0 GROUP BY 1, 2) u ON u.section_id = a.section_id AND u.round_id = a.round_id"""


# --- requests ---------------------------------------------------------------------------------


def _second_requests(t: Tables) -> DataFrame:
    """What is asked after a first attempt in which every second slot was filled and exploration slots 8 and up rejected."""
    bp = blueprints(t)
    items = gen.wanted_slots(recipe(t)).join(bp.select(*gen.SLOT, F.col("forced").alias("_forced")), gen.SLOT).withColumn("forced", F.col("_forced")).drop("_forced")
    rows = bp.select(
        *gen.SLOT, F.lit(0).alias("attempt"), F.when(F.col("slot_id") % 2 == 0, "accepted").when(F.col("slot_id") >= 8, "rejected").otherwise("missing").alias("status"),
        F.lit("tag_in_round").alias("reason"), F.lit("a\nsample").alias("sample"), F.lit("instruct").alias("instruct"), F.lit("g").alias("gold_summary"),
        F.concat(F.lit("tag_"), (F.col("slot_id") % 4).cast("string")).alias("tag"),
    )
    used = recipe(t).where(F.col("command") == "recycle").select("section_id", "round_id", "tag")
    return gen.attempt_requests(items, rows, bp, counts(t), used, 1)


register(
    "second_requests",
    lambda t: _second_requests(t).select(
        *gen.SLOT, "attempt",
        F.array_join(F.filter(F.split("prompt", "\n"), lambda x: x.startswith("- Tags used in this round") | x.startswith("- 1. tag=") | x.startswith("- Categories that dominate")), "\n").alias("lines"),
    ),
    f"""SELECT b.section_id, b.round_id, b.slot_id, 1 AS attempt, CASE WHEN {q.explore('b.curriculum_focus')} THEN array_to_string(list_filter([
          '- Tags used in this round: ' || (SELECT string_agg(DISTINCT tag, ', ' ORDER BY tag) FROM (
             SELECT section_id, tag FROM recipe WHERE command = 'recycle' UNION ALL SELECT section_id, 'tag_' || slot_id % 4 FROM blueprints WHERE slot_id % 2 = 0) u WHERE u.section_id = b.section_id) || '.',
          '- Categories that dominate: ' || (SELECT string_agg(tag, ', ' ORDER BY tag) FROM plan_counts c WHERE c.section_id = b.section_id AND c.n >= 3 AND c.n / c.total >= 0.35) || '.',
          CASE WHEN slot_id >= 8 THEN '- 1. tag=tag_' || slot_id % 4 || '; reason=tag_in_round; instruction=instruct; sample=a sample' END], lambda x: x IS NOT NULL), chr(10)) ELSE '' END AS lines
        FROM blueprints b WHERE slot_id % 2 = 1""",
)

# --- grouped tags -----------------------------------------------------------------------------


def _section_number():
    return F.substring("section_id", 9, 3).cast("int")


def _tag_answers(t: Tables) -> DataFrame:
    """Answers to the tag lists: good ones, broken ones, ones that break a rule; every seventh section has none."""
    s = _section_number()
    tags = po.per_tag_loss(t.ledger()).groupBy("section_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    part = lambda tag, loss, sources: F.struct(F.lit(tag).alias("tag"), loss.alias("avg_loss"), sources.alias("source_tags"))
    two = lambda a, b: F.to_json(F.struct(F.array(a, b).alias("top_tags")))
    half, rest = F.slice("tags", 1, 2), F.slice("tags", 3, 10)
    loss = F.lit(1.5)
    good = two(part(" first ", loss, half), part("second", loss * 2, rest))
    return tags.where(s % 7 != 0).select(
        "section_id",
        F.when(s % 7 == 1, F.concat(good, F.lit("}")))
        .when(s % 7 == 2, F.lit('{"top_tags": {"tag": "x"}}'))
        .when(s % 7 == 3, two(part("first", loss, half), part("second", F.lit(None).cast("double"), rest)))
        .when(s % 7 == 4, two(part("first", loss, F.concat(half, F.array(F.lit("never seen")))), part("second", loss * 2, rest)))
        .when(s % 7 == 5, two(part("first", loss, half), part("second", loss * 2, half)))
        .otherwise(good).alias("response"),
    )


register(
    "tag_list_requests",
    lambda t: gen.tag_list_requests(po.per_tag_loss(t.ledger()), "***tag_list*** (***limit***)").select("section_id", "tags", "prompt"),
    """SELECT section_id, CAST(count(*) AS INTEGER) AS tags, '[' || string_agg('{"tag":"' || tag || '","loss":' || round(avg_loss, 6) || '}', ',' ORDER BY avg_loss DESC, oldest_ledger_id, tag) || '] (3)' AS prompt
       FROM metrics GROUP BY 1""",
)
q.PARTS["tag_halves"] = """
    SELECT *, CAST(substr(section_id, 9, 3) AS INTEGER) % 7 AS s, row_number() OVER (PARTITION BY section_id ORDER BY tag) <= 2 AS half FROM metrics"""
_GROUPED = """
    SELECT section_id, CASE WHEN half THEN 'first' ELSE 'second' END AS tag, CASE WHEN half THEN 1.5 ELSE 3.0 END::DOUBLE AS avg_loss, count(*) + {extra} AS n, min(oldest_ledger_id) AS oldest_ledger_id
    FROM tag_halves WHERE {which} GROUP BY section_id, half, s"""
_FIRST_TWICE = """
    SELECT section_id, x.tag, x.loss AS avg_loss, count(*) AS n, min(oldest_ledger_id) AS oldest_ledger_id
    FROM tag_halves, (VALUES ('first', 1.5::DOUBLE), ('second', 3.0::DOUBLE)) x(tag, loss) WHERE s = 5 AND half GROUP BY 1, 2, 3"""
_OWN = "SELECT section_id, tag, round(avg_loss, 6) AS avg_loss, n, oldest_ledger_id FROM tag_halves WHERE {which}"
register(
    "grouped_metrics",
    lambda t: gen.grouped_metrics(po.per_tag_loss(t.ledger()), _tag_answers(t))[0],
    " UNION ALL ".join([_OWN.format(which="s < 4"), _GROUPED.format(extra="CASE WHEN s = 4 AND half THEN 1 ELSE 0 END", which="s IN (4, 6)"), _FIRST_TWICE]),
)
register(
    "grouped_metrics_strict",
    lambda t: gen.grouped_metrics(po.per_tag_loss(t.ledger()), _tag_answers(t), strict=True)[0],
    " UNION ALL ".join([_OWN.format(which="s <> 6"), _GROUPED.format(extra="0", which="s = 6")]),
)
register(
    "tag_group_problems",
    lambda t: gen.grouped_metrics(po.per_tag_loss(t.ledger()), _tag_answers(t), strict=True)[1],
    """SELECT DISTINCT section_id, CASE s WHEN 0 THEN 'no_answer' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'no_top_tags' WHEN 3 THEN 'no_avg_loss'
         WHEN 4 THEN 'unknown_source_tag' ELSE 'repeated_source_tag' END AS reason FROM tag_halves WHERE s <> 6""",
)
