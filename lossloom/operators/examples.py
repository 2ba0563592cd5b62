"""Seed examples: parsing, normal form, task mode, and hand-out to slots.

A file of examples is one row, so parsing is a per-row expression and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossloom import fixed_values as fx
from lossloom.functions import text as tx
from lossloom.operators.ranking import number_rows
from lossloom.plans.workspace import settle

_FIELDS = ["sample", "output", "instruct", "context", "mode"]
_LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def normalize_example(df: DataFrame) -> DataFrame:
    """Back-fill sample and context from each other and set the mode from what is present."""
    ctx, ins = tx.blank_to_null("context"), tx.blank_to_null("instruct")
    contextual = ins.isNotNull() | ctx.isNotNull()
    sample = F.coalesce(tx.blank_to_null("sample"), ctx, F.lit(""))
    return df.withColumns(
        {
            "sample": sample,
            "context": F.when(contextual, F.coalesce(ctx, sample)).otherwise(F.col("context")),
            "mode": F.when(contextual, "contextual").otherwise("plain"),
        }
    )


def _shape_example(sample: Column, instruct: Column, context: Column, output: Column, fmt: str, swap: bool) -> Column:
    """Example struct from raw parts, or null when they do not make one.

    ``swap`` lets a lone sample stand in for a missing context or instruction (JSON input).
    """
    s, i, c, o = (tx.blank_to_null(tx.strip(F.coalesce(x, F.lit("")))) for x in (sample, instruct, context, output))
    none = F.lit(None).cast("string")
    plain = F.struct(
        s.alias("sample"), o.alias("output"), none.alias("instruct"), none.alias("context"),
        F.lit("plain").alias("mode"),
    )
    if fmt == "plain":
        return F.when(o.isNotNull() & s.isNotNull(), plain)
    if swap:
        c, i = F.coalesce(c, F.when(i.isNotNull(), s)), F.coalesce(i, F.when(c.isNotNull(), s))
    else:
        i = F.when(i.isNotNull() & c.isNotNull(), i).otherwise(s)
    contextual = F.struct(
        c.alias("sample"), o.alias("output"), i.alias("instruct"), c.alias("context"),
        F.lit("contextual").alias("mode"),
    )
    shaped = F.when(o.isNotNull() & i.isNotNull() & c.isNotNull(), contextual)
    return shaped if fmt == "contextual" else shaped.when(o.isNotNull() & s.isNotNull(), plain)


def parse_examples_json(files: DataFrame, text: str = "value", fmt: str = "auto") -> DataFrame:
    """Examples from JSON text: an object, an array, or ``{"examples": [...]}``.

    One invalid element voids its whole file. Adds ``pos`` and the example fields.
    """
    root = files.withColumn("_v", tx.strict_json(tx.strip(text)))
    as_array = lambda c: F.try_variant_get(c, "$", "array<variant>")
    nested = as_array(F.try_variant_get("_v", "$.examples", "variant"))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    listed = F.coalesce(
        F.when(is_object, nested), as_array(F.col("_v")), F.when(is_object, F.array("_v"))
    )

    def field(v: Column, *names: str) -> Column:
        return F.coalesce(
            *[tx.blank_to_null(F.try_variant_get(v, f"$.{n}", "string")) for n in names]
        )

    def element(v: Column) -> Column:
        shaped = _shape_example(
            field(v, "sample"), field(v, "instruction", "instruct", "question"),
            field(v, "context", "input"), field(v, "output", "gold_summary", "summary"), fmt, True,
        )
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), shaped)

    parsed = root.withColumn("_e", F.transform(listed, element))
    whole = parsed.where(
        (F.size("_e") > 0) & ~F.exists("_e", lambda x: x.isNull()) & ~has_template_text(text)
    )
    names = [c for c in files.columns if c != text]
    return whole.select(*names, F.posexplode("_e").alias("pos", "_x")).select(*names, "pos", "_x.*")


def has_template_text(text: str) -> Column:
    hit = F.lit(False)
    for marker in fx.EXAMPLE_TEMPLATE_MARKERS:
        hit = hit | F.col(text).contains(marker)
    return hit


def parse_examples_text(files: DataFrame, text: str = "value", fmt: str = "auto") -> DataFrame:
    """Examples from ``Sample: / Instruction: / Context: / Output:`` blocks.

    A sample or instruction header after some output opens the next block; text after a header's
    colon belongs to the section. One invalid block voids its file.
    """
    headers = ["sample", "output"] if fmt == "plain" else list(fx.EXAMPLE_HEADERS)
    header = rf"(?is)\A{tx.SPACE}*({'|'.join(headers)}){tx.SPACE}*(?::{tx.SPACE}*(.*?))?{tx.SPACE}*\z"
    name = lambda line: F.lower(F.regexp_extract(line, header, 1))
    section = F.create_map(*[F.lit(x) for kv in fx.EXAMPLE_HEADERS.items() for x in kv])

    split = F.transform(
        F.split(F.regexp_replace(tx.strip(text), _LINE_ENDS, "\n"), "\n"),
        lambda ln: F.struct(
            F.element_at(section, name(ln)).alias("head"),
            F.when(name(ln) == "", ln).otherwise(F.regexp_extract(ln, header, 2)).alias("line"),
        ),
    )
    lines = F.transform(split, lambda x: F.struct(x["head"].alias("head"), x["line"].alias("line"), tx.is_blank(x["line"]).alias("blank")))
    kept = [f for f in files.schema if f.name != text]
    read = files.where(~has_template_text(text)).select(*(f.name for f in kept), lines.alias("_lines"))
    schema = T.StructType([*kept, T.StructField("_blocks", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in _SECTIONS])))])
    folded = read.mapInArrow(_blocks_of, schema)
    shaped = F.transform("_blocks", lambda b: _shape_example(*(b[n] for n in _SECTIONS), fmt, False))
    whole = folded.withColumn("_e", shaped).where(
        (F.size("_e") > 0) & ~F.exists("_e", lambda x: x.isNull())
    )
    names = [f.name for f in kept]
    return whole.select(*names, F.posexplode("_e").alias("pos", "_x")).select(*names, "pos", "_x.*")


_SECTIONS = ("sample", "instruction", "context", "output")


def _blocks_of(batches):
    """The texts of the four sections of every block of a file that has any text, from its lines: one pass over them."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([(n, pa.string()) for n in _SECTIONS]))
    for batch in batches:
        at = batch.schema.get_field_index("_lines")
        found = []
        for lines in batch.column(at).to_pylist():
            blocks, sec, out, filled = [{}], None, False, False
            for x in lines or ():
                head, line = x["head"], x["line"]
                if head in ("sample", "instruction") and out and filled:
                    blocks.append({})
                    out = filled = False
                sec = head or sec
                # An inline text counts as a line only when it is there; body lines always count.
                if sec is not None and (head is None or line != ""):
                    blocks[-1].setdefault(sec, []).append((line, x["blank"]))
                    out, filled = out or sec == "output", filled or not x["blank"]
            texts = [b for b in blocks if any(not blank for rows in b.values() for _, blank in rows)]
            found.append([{n: "\n".join(line for line, _ in b[n]) if n in b else None for n in _SECTIONS} for b in texts])
        columns = [c for k, c in enumerate(batch.columns) if k != at]
        names = [n for k, n in enumerate(batch.schema.names) if k != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [*names, "_blocks"])


def new_examples(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """Examples not yet known: equal on all five fields, where missing equals missing."""
    p, k = parsed.alias("p"), known.select("section_id", *_FIELDS).alias("k")
    same = F.col("p.section_id") == F.col("k.section_id")
    for f in _FIELDS:
        same = same & F.col(f"p.{f}").eqNullSafe(F.col(f"k.{f}"))
    return p.join(k, same, "left_anti")


def contextual_examples(examples: DataFrame) -> DataFrame:
    return examples.where(
        (F.col("mode") == "contextual")
        & tx.first_filled("context", "sample").isNotNull()
        & tx.blank_to_null("instruct").isNotNull()
    )


def contextual_slot(slots: DataFrame, examples: DataFrame) -> DataFrame:
    """First exploration slot of each recipe whose section has usable contextual examples."""
    sections = contextual_examples(examples).select("section_id").distinct()
    return (
        slots.where((F.col("command") == "generate") & tx.is_wide_variety("tag"))
        .join(sections, "section_id", "left_semi")
        .groupBy("section_id", "round_id")
        .agg(F.min("slot_id").alias("contextual_slot_id"))
    )


def assign_examples(items: DataFrame, examples: DataFrame) -> DataFrame:
    """Round-robin example for every generation item ``(section_id, generation_index, forced)``.

    Forced contextual items draw from the contextual examples only. ``examples.pos`` is unique.
    """
    ctx = number_rows(contextual_examples(examples), ["section_id"], "pos", "_at")
    every = number_rows(examples, ["section_id"], "pos", "_at")
    pool = every.withColumn("_ctx", F.lit(False)).unionByName(ctx.withColumn("_ctx", F.lit(True)))
    sizes = pool.groupBy("section_id", "_ctx").agg(F.count("*").alias("_n"))
    has_ctx = sizes.where("_ctx").select("section_id", F.lit(True).alias("_has"))
    return (
        items.join(has_ctx, "section_id", "left")
        .withColumn("_ctx", F.col("forced") & F.coalesce("_has", F.lit(False)))
        .join(sizes, ["section_id", "_ctx"])
        .withColumn("_at", F.col("generation_index") % F.col("_n"))
        .join(pool.drop("pos"), ["section_id", "_ctx", "_at"])
        .drop("_ctx", "_at", "_n", "_has")
    )


# --- task mode --------------------------------------------------------------------------------

_SEAM = 1 + max(len(m) for m in [*fx.VISUAL_MARKERS, *fx.TEXT_MARKERS])


def example_hash(texts: DataFrame) -> DataFrame:
    """16 hex digits over a section's example texts and their places.

    Each example is hashed with its place by SHA-256; the leading 52 bits are summed, modulo 2 ** 60. The sum needs no order,
    so it is a partial aggregate for sections of any size. (A hash over the joined text would need one task per section.)
    """
    digest = F.sha2(F.concat_ws("|", F.col("pos").cast("string"), "_text"), 256)
    part = F.conv(F.substring(digest, 1, 13), 16, 10).cast("decimal(38,0)")
    total = (F.sum(part) % F.lit(1 << 60)).cast("bigint")
    return texts.groupBy("section_id").agg(F.lpad(F.lower(F.hex(total)), 16, "0").alias("example_hash"))


def _tails(texts: DataFrame) -> DataFrame:
    """The last ``_SEAM`` characters of each example and the ones before it, joined by blanks.

    Tails of 1, 2, 4, ... examples are put together by equi-joins on the place, so phrases over any number of short examples
    are seen and no section is ordered in one task.
    """
    tails, step = texts.select("section_id", "pos", F.right("_text", F.lit(_SEAM)).alias("_tail")), 1
    while step < _SEAM:
        before = tails.select("section_id", (F.col("pos") + step).alias("pos"), F.col("_tail").alias("_before"))
        longer = F.right(F.concat_ws(" ", "_before", "_tail"), F.lit(_SEAM))
        tails = settle(tails.join(before, ["section_id", "pos"], "left").select("section_id", "pos", longer.alias("_tail")))
        step *= 2
    return tails


def resolve_task_mode(examples: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """Text, visual or mixed mode of each section, from marker words in its examples.

    Markers are found per example and per seam between an example and those before it (the examples count as one text
    joined by blanks), then merged with map-side combine. ``examples.pos`` counts 0, 1, 2, ...
    ``configured`` may hold ``section_id, task_mode``.
    """
    text = F.lower(
        F.concat_ws(" ", *[tx.blank_to_null(c) for c in ("sample", "instruct", "context", "output")])
    )
    texts = settle(examples.select("section_id", F.col("pos").cast("bigint").alias("pos"), text.alias("_text")))
    # A piece is one character longer than any marker, so a phrase that spans the seam is whole in
    # it and so is the character before and after.
    tails = _tails(texts).withColumn("pos", F.col("pos") + 1)
    heads = texts.select("section_id", "pos", F.substring("_text", 1, _SEAM).alias("_head"))
    seams = tails.join(heads, ["section_id", "pos"]).select(
        "section_id", F.concat_ws(" ", "_tail", "_head").alias("_text")
    )
    phrases = {m: w for m, w in fx.VISUAL_MARKERS.items() if " " in m}
    whole_hits = texts.select(
        "section_id",
        tx.marker_hits("_text", fx.VISUAL_MARKERS).alias("v"),
        tx.marker_hits("_text", fx.TEXT_MARKERS).alias("t"),
    )
    seam_hits = seams.select(
        "section_id", tx.marker_hits("_text", phrases).alias("v"), F.array().cast("array<string>").alias("t")
    )

    def merged(col: str, markers: dict[str, int]) -> list[Column]:
        return [F.max(F.array_contains(col, m)).alias(f"{col}{i}") for i, m in enumerate(markers)]

    found = whole_hits.unionByName(seam_hits).groupBy("section_id").agg(
        *merged("v", fx.VISUAL_MARKERS), *merged("t", fx.TEXT_MARKERS)
    )
    listed = lambda col, markers: F.array_compact(
        F.array(*[F.when(F.col(f"{col}{i}"), F.lit(m)) for i, m in enumerate(markers)])
    )
    hits = found.select(
        "section_id", listed("v", fx.VISUAL_MARKERS).alias("v"), listed("t", fx.TEXT_MARKERS).alias("t")
    ).withColumns(
        {
            "visual_score": tx.marker_score("v", fx.VISUAL_MARKERS),
            "text_score": tx.marker_score("t", fx.TEXT_MARKERS),
        }
    ).join(example_hash(texts), "section_id")
    if configured is not None:
        hits = hits.join(configured.select("section_id", "task_mode"), "section_id", "left")
    else:
        hits = hits.withColumn("task_mode", F.lit("auto"))
    hits = hits.withColumn("task_mode", F.coalesce(tx.blank_to_null("task_mode"), F.lit("auto")))
    explicit = F.col("task_mode").isin("text", "visual", "mixed")
    strong, wordy = F.col("visual_score") >= 3, F.col("text_score")
    default_evidence = F.when(explicit, F.concat(F.lit("explicit:"), "task_mode")).otherwise(
        "default:text_no_strong_visual_evidence"
    )
    evidence = F.concat(
        F.transform("v", lambda m: F.concat(F.lit("visual:"), m)),
        F.transform("t", lambda m: F.concat(F.lit("text:"), m)),
    )
    return hits.select(
        "section_id",
        F.when(explicit, F.col("task_mode")).otherwise("auto").alias("task_mode"),
        F.when(explicit, F.col("task_mode"))
        .when(strong & (wordy >= 2), "mixed")
        .when(strong, "visual")
        .otherwise("text")
        .alias("resolved_task_mode"),
        F.when(explicit, 1.0).when(strong & (wordy >= 2), 0.75).when(strong, 0.85)
        .when(wordy > 0, 0.90).otherwise(0.70).alias("mode_confidence"),
        F.when(F.size(evidence) > 0, evidence).otherwise(F.array(default_evidence)).alias("mode_evidence"),
        "visual_score",
        "text_score",
        "example_hash",
    )
