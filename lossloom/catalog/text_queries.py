"""Tag, text and task-shape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossloom import fixed_values as fx
from lossloom.catalog import sql as q
from lossloom.catalog.adapters import Tables
from lossloom.catalog.registry import register, text
from lossloom.functions import shape as sh
from lossloom.functions import text as tx
from lossloom.operators import reports as rp

# --- tags -------------------------------------------------------------------------------------

register(
    "normalize_tag",
    lambda t: t.messy_tags().select("ledger_id", tx.normalize_tag("tag").alias("tag")),
    f"SELECT ledger_id, {q.norm('tag')} AS tag FROM messy",
)
register(
    "path_tag",
    lambda t: t.messy_tags().select("ledger_id", tx.path_tag("tag").alias("tag")).unionByName(
        t.documents().select(F.col("doc_id").alias("ledger_id"), tx.path_tag("text").alias("tag"))
    ),
    "SELECT ledger_id, coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'untagged') AS tag "
    "FROM (SELECT ledger_id, tag FROM messy UNION ALL SELECT doc_id, text FROM documents)".format(q.strip("tag")),
)
register(
    "split_intent",
    lambda t: t.messy_tags().select("ledger_id", tx.split_intent("tag").alias("s")).select("ledger_id", "s.*"),
    f"SELECT ledger_id, {q.intent('tag')} AS intent, {q.base('tag')} AS base FROM messy",
)
register(
    "prefix_tags",
    lambda t: t.messy_tags().select("ledger_id", tx.hard_tag("tag").alias("hard"), tx.validation_tag(F.lit("  ")).alias("val")),
    f"SELECT ledger_id, 'hard:' || {q.strip('tag')} AS hard, 'validation:wide_variety' AS val FROM messy",
)
register(
    "tag_predicates",
    lambda t: t.messy_tags().select(
        "ledger_id", tx.is_exploration("tag").alias("exploration"), tx.is_wide_variety("tag").alias("wide"),
        tx.is_category(tx.normalize_tag("tag")).alias("category"), tx.is_metric_tag("tag").alias("metric"),
    ),
    f"SELECT ledger_id, {q.explore('tag')} AS exploration, "
    f"{q.norm(q.base('tag'))} = 'wide_variety' OR starts_with({q.norm(q.base('tag'))}, 'wide_variety_') AS wide, "
    f"{q.norm('tag')} NOT IN ('', 'good', 'wide_variety') AS category, tag <> '' AND tag <> 'good' AS metric FROM messy",
)
register(
    "stable_index",
    lambda t: t.ledger().select(
        "ledger_id", tx.stable_index(9, "section_id", "round_id", "tag", F.lit("input")).alias("i"),
        tx.choose_rotated(fx.INPUT_SHAPES, "section_id", "round_id", "tag", F.lit("input")).alias("choice"),
    ),
    "SELECT ledger_id, CAST({0} AS INTEGER) AS i, ({1})[{0} + 1] AS choice FROM ledger".format(
        q.pick("section_id || '|' || round_id || '|' || tag || '|input'", 9), q.lits(fx.INPUT_SHAPES)
    ),
)
register(
    "round_half_even",
    lambda t: t.ledger().select("ledger_id", tx.round_half_even(F.col("token_length") * 0.5).alias("r")),
    "SELECT ledger_id, CAST(round_even(token_length * 0.5::DOUBLE, 0) AS INTEGER) AS r FROM ledger",
)

# --- text -------------------------------------------------------------------------------------

register(
    "preview",
    lambda t: t.documents().select("doc_id", tx.preview("text", 140).alias("p"), tx.word_count("text").alias("words")),
    f"SELECT doc_id, substr({q.squeeze('text')}, 1, 140) AS p, CAST({q.words('text')} AS INTEGER) AS words FROM documents",
)
register(
    "request_key",
    lambda t: t.pairs().select("conv_id", "turn", tx.request_key("instruct", "m", "v1", 0.7).alias("k")),
    "SELECT conv_id, turn, sha256('{\"cache_version\":\"v1\",\"kind\":\"instruction_response\",\"model_id\":\"m\",\"prompt\":' || "
    f"CAST(to_json({q.strip('instruct')}) AS VARCHAR) || ',\"temperature\":0.7}}') AS k FROM pairs",
)
register(
    "is_meta_instruction",
    lambda t: _meta(t).select("record_id", tx.is_meta_instruction("instruct").alias("meta")),
    f"SELECT record_id, list_any_value(list_filter({q.lits(fx.META_INSTRUCTION_MARKERS)}, "
    f"lambda m: contains(lower({q.squeeze('instruct')}), m))) IS NOT NULL AS meta FROM "
    "(SELECT record_id, CASE WHEN record_id % 9 = 0 THEN 'Please:  You' || chr(10) || ' generate data' ELSE instruct END AS instruct FROM records)",
)


def _meta(t: Tables):
    return t.task_records().withColumn(
        "instruct", F.when(F.col("record_id") % 9 == 0, F.lit("Please:  You\n generate data")).otherwise(F.col("instruct"))
    )


q.PARTS["records"] = f"""
    SELECT doc_id AS record_id, {q.section('doc_id')} AS section_id,
           CASE WHEN doc_id % 7 = 1 THEN 'Context: ' || text ELSE text END AS sample,
           CASE doc_id % 7 WHEN 1 THEN 'Which fact answers this?' WHEN 2 THEN 'Explain the main idea'
             WHEN 3 THEN 'Classify and rank the items in the table' WHEN 4 THEN 'Write an image prompt with soft lighting, no logo'
             WHEN 5 THEN 'Sort the rows' WHEN 6 THEN 'Why is it so? Return JSON' ELSE '' END AS instruct,
           lang AS output
    FROM documents
    UNION ALL
    SELECT 1000000000000 + conv_id * 10000 + turn, {q.section('conv_id')}, '', instruct, gold_summary FROM pairs"""


def _question(x: str) -> str:
    s = q.squeeze(x)
    starts = "|".join(fx.QUESTION_STARTS)
    return f"(contains(substr({s}, 1, 220), '?') OR regexp_matches(lower({s}), '^({starts})([^\\p{{L}}\\p{{N}}_]|$)'))"


_CTX = " OR ".join(f"contains(lower(coalesce({{0}}, '')), '{m}')" for m in fx.CONTEXT_MARKERS)
q.PARTS["scored_records"] = f"""
    SELECT *, lower(concat_ws(' ', nullif(sample, ''), nullif(instruct, ''), nullif(output, ''))) AS full_text,
           {_CTX.format('sample')} OR {_CTX.format('instruct')}
             OR ({q.words('sample')} >= 45 AND {_question('instruct')}) AS ctx,
           {_question("coalesce(nullif(instruct, ''), sample)")} AS ask
    FROM records"""
q.PARTS["hit_records"] = f"""
    SELECT *, {q.markers('full_text', fx.VISUAL_MARKERS)} AS vis, {q.markers('full_text', fx.STRUCTURED_MARKERS)} AS str FROM scored_records"""
q.PARTS["shaped"] = f"""
    SELECT *, CASE WHEN vscore >= 3 THEN 'visual_generation' WHEN ctx AND ask THEN 'contextual_qa' WHEN ask AND sscore < 2 THEN 'assistant_qa'
             WHEN sscore > 0 THEN 'structured_text_task' ELSE 'generic_text_task' END AS shape_id,
           list_concat(list_transform(vis[1:3], lambda m: 'visual:' || m), list_filter([CASE WHEN ctx THEN 'context_signal' END,
             CASE WHEN ask THEN 'question_like' END, CASE WHEN sscore > 0 THEN 'structured_score:' || sscore END], lambda e: e IS NOT NULL)) AS evidence
    FROM (SELECT *, {q.weight('vis', fx.VISUAL_MARKERS)} AS vscore, {q.weight('str', fx.STRUCTURED_MARKERS)} AS sscore FROM hit_records)"""

register(
    "marker_hits",
    lambda t: t.task_records().select(
        "record_id",
        tx.marker_hits(F.lower(F.concat_ws(" ", *[tx.blank_to_null(c) for c in ("sample", "instruct", "output")])), fx.STRUCTURED_MARKERS).alias("h"),
    ).select("record_id", text("h"), tx.marker_score("h", fx.STRUCTURED_MARKERS).alias("score")),
    f"SELECT record_id, array_to_string(str, '|') AS h, CAST({q.weight('str', fx.STRUCTURED_MARKERS)} AS INTEGER) AS score FROM hit_records",
)
register(
    "is_question",
    lambda t: t.task_records().select(
        "record_id", tx.is_question("instruct").alias("q"), tx.has_context("sample", "instruct").alias("ctx"),
        tx.structured_score("instruct").alias("score"),
    ),
    f"SELECT record_id, {_question('instruct')} AS q, ctx, CAST({q.weight(q.markers('lower(instruct)', fx.STRUCTURED_MARKERS), fx.STRUCTURED_MARKERS)} AS INTEGER) AS score FROM scored_records",
)
register(
    "classify_shape",
    lambda t: sh.classify_shape(sh.coalesce_fields(t.task_records())).select("record_id", "shape_id", text("evidence")),
    "SELECT record_id, shape_id, array_to_string(evidence, '|') AS evidence FROM shaped",
)
register(
    "describe_shapes",
    lambda t: sh.describe_shapes(sh.classify_shape(sh.coalesce_fields(t.task_records()))).select(
        "record_id", "input_shape", "output_shape", "reasoning_pattern", "focus_tag", F.size("hard_levers").alias("levers")
    ),
    "SELECT record_id, d.input_shape, d.output_shape, d.reasoning_pattern, d.focus_tag, d.levers FROM shaped JOIN (VALUES "
    + ", ".join(
        f"('{s}', '{d[0]}', '{d[2]}', '{d[4]}', '{d[5]}', {len(fx.HARD_LEVERS[s])})" for s, d in fx.SHAPE_DESCRIPTORS.items()
    )
    + ") AS d(shape_id, input_shape, output_shape, reasoning_pattern, focus_tag, levers) USING (shape_id)",
)
q.PARTS["shape_top"] = """
    SELECT section_id, sum(n) OVER (PARTITION BY section_id) AS record_count, shape_id, n,
           row_number() OVER (PARTITION BY section_id ORDER BY n DESC, f) AS rn
    FROM (SELECT section_id, shape_id, count(*) AS n, min(record_id) AS f FROM shaped GROUP BY 1, 2)"""
q.PARTS["signal_top"] = """
    SELECT section_id, signal, n, row_number() OVER (PARTITION BY section_id ORDER BY n DESC, f) AS rn FROM (
      SELECT section_id, signal, count(*) AS n, min((record_id, i)) AS f FROM (
        SELECT section_id, record_id, unnest(evidence) AS signal, unnest(range(len(evidence))) AS i FROM shaped) GROUP BY 1, 2)"""
q.PARTS["profiles"] = """
    SELECT p.section_id, p.shape_id, CAST(p.record_count AS BIGINT) AS record_count,
           round(least(0.95, 0.35 + n / record_count * 0.6::DOUBLE), 4) AS confidence,
           (SELECT string_agg(s.shape_id || ':' || s.n, '|' ORDER BY s.rn) FROM shape_top s WHERE s.section_id = p.section_id)
           || '|' || (SELECT string_agg('signal:' || g.signal || ':' || g.n, '|' ORDER BY g.rn) FROM signal_top g WHERE g.section_id = p.section_id AND g.rn <= 6) AS evidence
    FROM shape_top p WHERE rn = 1"""
register(
    "shape_profile",
    lambda t: sh.shape_profile(t.task_records(), "section_id", pos="record_id", source="examples").select(
        "section_id", "shape_id", "record_count", "confidence", text("evidence")
    ),
    "SELECT * FROM profiles",
)

# --- prompts ----------------------------------------------------------------------------------

_TEMPLATE = "Do ***what*** with ***it***. Again: ***what***"
register(
    "render",
    lambda t: t.ledger().select(
        "ledger_id", tx.render(_TEMPLATE, {"what": F.col("tag"), "it": F.col("sample")}).alias("out"),
        tx.has_unfilled(tx.render(_TEMPLATE, {"what": F.col("tag")})).alias("unfilled"),
    ),
    "SELECT ledger_id, 'Do ' || tag || ' with ' || sample || '. Again: ' || tag AS out, true AS unfilled FROM ledger",
)
register(
    "format_example",
    lambda t: t.examples().select(
        "section_id", "pos", tx.format_example("sample", "output", "instruct", "context", "mode").alias("shown"),
        tx.example_signal("sample", "instruct", "context", "mode").alias("signal"),
    ),
    f"""SELECT section_id, pos, CASE WHEN mode = 'contextual' THEN 'Instruction:' || chr(10) || coalesce(nullif(instruct, ''), 'Use the context to produce the output.')
          || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(nullif(context, ''), sample) || chr(10) || chr(10) || 'Output:' || chr(10) || output
        ELSE 'Input:' || chr(10) || sample || chr(10) || chr(10) || 'Output:' || chr(10) || output END AS shown,
        'mode=' || mode || CASE WHEN coalesce(instruct, '') <> '' THEN '; has_instruction=true' ELSE '' END
          || CASE WHEN coalesce(context, '') <> '' THEN '; has_context=true' ELSE '' END
          || '; sample_words=' || {q.words("coalesce(nullif(context, ''), sample)")} AS signal
        FROM examples""",
)
q.PARTS["examples"] = f"""
    SELECT section_id, row_number() OVER (PARTITION BY section_id ORDER BY p) - 1 AS pos, sample, output, instruct,
           CASE WHEN ctx THEN coalesce(nullif(context, ''), sample) ELSE context END AS context,
           CASE WHEN ctx THEN 'contextual' ELSE 'plain' END AS mode
    FROM (SELECT *, coalesce(instruct, '') <> '' OR coalesce(context, '') <> '' AS ctx FROM (
      SELECT {q.section('conv_id')} AS section_id, conv_id * 1000 + turn AS p,
             CASE WHEN conv_id % 5 = 0 THEN 'Passage: ' || instruct ELSE instruct END AS sample, gold_summary AS output,
             CASE conv_id % 5 WHEN 0 THEN 'Which fact answers this?' WHEN 1 THEN '' WHEN 2 THEN 'Explain and compare the ideas' END AS instruct,
             CASE WHEN conv_id % 5 = 0 THEN instruct END AS context
      FROM pairs))"""
register(
    "normalize_example",
    lambda t: t.examples().select("section_id", "pos", "sample", "output", "instruct", "context", "mode"),
    "SELECT * FROM examples",
)
register(
    "sample_prompt",
    lambda t: t.task_records().select("record_id", tx.sample_prompt("sample", "instruct").alias("prompt")),
    f"""SELECT record_id, '### Instruction:' || chr(10) || {q.strip('instruct')} || CASE WHEN {q.strip('sample')} = '' THEN '' ELSE
        chr(10) || chr(10) || '### Input:' || chr(10) || {q.strip('sample')} END || chr(10) || chr(10) || '### Output:' || chr(10) AS prompt FROM records""",
)
register(
    "context_policy",
    lambda t: t.ledger().select(
        "ledger_id",
        tx.context_policy(
            F.col("ledger_id") % 5 == 0, tx.choose_rotated(fx.INPUT_SHAPES, "ledger_id"),
            F.when(F.col("ledger_id") % 3 == 0, fx.ASSISTANT_QA).otherwise(fx.GENERIC_TEXT),
        ).alias("policy"),
    ),
    "SELECT ledger_id, CASE WHEN ledger_id % 5 = 0 THEN '{forced}' WHEN ledger_id % 3 = 0 THEN '{question}' "
    "WHEN contains(s, 'context') OR contains(s, 'facts') OR contains(s, 'log') THEN '{grounded}' ELSE '{optional}' END AS policy "
    "FROM (SELECT ledger_id, ({0})[{1} + 1] AS s FROM ledger)".format(
        q.lits(fx.INPUT_SHAPES), q.pick("CAST(ledger_id AS VARCHAR)", 9), **fx.CONTEXT_POLICY
    ),
)

# --- validation weakness ----------------------------------------------------------------------


def weak_evals(t: Tables):
    """Task records with a loss that depends on the record, as validation rows."""
    return t.shaped_records().withColumn("loss", (F.col("record_id") * 37 % 499) / 97)


def weakness(t: Tables):
    return rp.validation_weakness(weak_evals(t), classified=True)


q.PARTS["weakness"] = """
    SELECT section_id, rank, d.focus AS tag, shape_id, avg_loss, max_loss, n, n / total AS share FROM (
      SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY avg_loss DESC, shape_id) AS rank, sum(n) OVER (PARTITION BY section_id) AS total
      FROM (SELECT section_id, shape_id, avg((record_id * 37 % 499) / 97) AS avg_loss, max((record_id * 37 % 499) / 97) AS max_loss, count(*) AS n
            FROM shaped GROUP BY 1, 2)) w JOIN (VALUES """ + ", ".join(f"('{s}', '{d[5]}')" for s, d in fx.SHAPE_DESCRIPTORS.items()) + """)
      AS d(s, focus) ON d.s = shape_id WHERE rank <= 3"""
register(
    "validation_weakness",
    lambda t: weakness(t).drop("input_shape", "output_shape", "reasoning_pattern"),
    "SELECT section_id, CAST(rank AS INTEGER) AS rank, tag, shape_id, round(avg_loss, 6) AS avg_loss, round(max_loss, 6) AS max_loss, n, round(share, 6) AS share FROM weakness",
)
