"""Task-shape classification as one projection over the text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom import fixed_values as fx
from lossloom.functions import text as tx
from lossloom.plans.workspace import deal, stage_table


def coalesce_fields(df: DataFrame) -> DataFrame:
    """Bring loosely named example fields to one set; empty text counts as missing.

    Reads whichever of ``sample, instruct, instruction, question, output, gold_summary, summary,
    context, input, mode`` exist and yields ``sample, instruct, output, context, mode``.
    """
    have = set(df.columns)

    def pick(*names: str) -> Column:
        cols = [tx.blank_to_null(n) for n in names if n in have]
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    new = {
        "sample": pick("sample"),
        "instruct": pick("instruct", "instruction", "question"),
        "output": pick("output", "gold_summary", "summary"),
        "context": pick("context", "input"),
        "mode": pick("mode"),
    }
    drop = have & {"instruction", "question", "gold_summary", "summary", "input"}
    return df.withColumns(new).drop(*drop)


def classify_shape(df: DataFrame) -> DataFrame:
    """Add ``shape_id`` and ``evidence`` to rows with the fields of :func:`coalesce_fields`."""
    sample, instruct = F.coalesce("sample", F.lit("")), F.coalesce("instruct", F.lit(""))
    joined = F.lower(
        F.concat_ws(" ", *[tx.blank_to_null(c) for c in ("sample", "instruct", "output", "context")])
    )
    has_ctx_field = tx.blank_to_null("context").isNotNull()
    context_like = (
        has_ctx_field
        | (F.coalesce(F.col("mode"), F.lit("")) == "contextual")
        | tx.has_context(tx.first_filled("context", "sample"), instruct)
    )
    question_like = tx.is_question(tx.first_filled(instruct, sample))
    # Each stage names its intermediate values once, so that text is scanned once per marker.
    scored = (
        df.withColumn("_text", joined)
        .withColumns(
            {
                "_visual": tx.marker_hits("_text", fx.VISUAL_MARKERS),
                "_structured": tx.marker_score(
                    tx.marker_hits("_text", fx.STRUCTURED_MARKERS), fx.STRUCTURED_MARKERS
                ),
                "_context": context_like,
                "_question": question_like,
            }
        )
        .withColumn("_visual_score", tx.marker_score("_visual", fx.VISUAL_MARKERS))
    )
    shape = (
        F.when(F.col("_visual_score") >= 3, fx.VISUAL_GENERATION)
        .when(F.col("_context") & F.col("_question"), fx.CONTEXTUAL_QA)
        .when(F.col("_question") & (F.col("_structured") < 2), fx.ASSISTANT_QA)
        .when(F.col("_structured") > 0, fx.STRUCTURED_TEXT)
        .otherwise(fx.GENERIC_TEXT)
    )
    signals = F.array_compact(
        F.array(
            F.when(F.col("_context"), F.lit("context_signal")),
            F.when(F.col("_question"), F.lit("question_like")),
            F.when(
                F.col("_structured") > 0,
                F.concat(F.lit("structured_score:"), F.col("_structured").cast("string")),
            ),
        )
    )
    evidence = F.concat(
        F.transform(F.slice("_visual", 1, 3), lambda m: F.concat(F.lit("visual:"), m)), signals
    )
    return scored.withColumns({"shape_id": shape, "evidence": evidence}).drop(
        "_text", "_visual", "_structured", "_context", "_question", "_visual_score"
    )


def shape_dim(spark: SparkSession) -> DataFrame:
    """Fixed dimension of five rows: shape -> descriptors, focus tag, levers and tag aliases."""
    rows = [
        (shape, *desc, fx.HARD_LEVERS[shape], fx.SHAPE_TAG_ALIASES.get(shape, [shape]))
        for shape, desc in fx.SHAPE_DESCRIPTORS.items()
    ]
    return spark.createDataFrame(
        rows,
        "shape_id string, input_shape string, context_mode string, output_shape string, "
        "answer_style string, reasoning_pattern string, focus_tag string, "
        "hard_levers array<string>, tag_aliases array<string>",
    )


def describe_shapes(df: DataFrame) -> DataFrame:
    """Attach the shape dimension (five fixed rows, hence the hint)."""
    return df.join(F.broadcast(shape_dim(df.sparkSession)), "shape_id", "left")


def shaped_records(df: DataFrame, *names: str) -> DataFrame:
    """``names``, ``shape_id`` and ``evidence`` of every record, written once without the text.

    Several profiles can be made of it with one pass over the text. Rows are dealt evenly first, as the cost is in the
    text and a file may have few splits.
    """
    shaped = classify_shape(coalesce_fields(deal(df)))
    return stage_table(shaped.select(*names, "shape_id", "evidence"), "shapes")


def shape_profile(
    df: DataFrame, *keys: str, pos: str, source: str, fallback_modality: str = "text", classified: bool = False
) -> DataFrame:
    """Modal task shape of every group of records; ``classified`` ones come from :func:`shaped_records`.

    Counts are taken per (group, shape) and per (group, signal) with map-side combine, so a large
    group never meets in one task; ``pos`` orders records and decides ties by first occurrence.
    """
    keys = list(keys)
    # One pass over the text: rows collapse to the few (shape, evidence) combinations that occur.
    shaped = (
        (df if classified else classify_shape(coalesce_fields(df)))
        .groupBy(*keys, "shape_id", "evidence")
        .agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))
    )
    per_shape = shaped.groupBy(*keys, "shape_id").agg(
        F.sum("n").alias("n"), F.min("first_pos").alias("first_pos")
    )
    per_signal = (
        # outer, so that no filter on the evidence is pushed down into the text scan
        shaped.select(*keys, "n", "first_pos", F.posexplode_outer("evidence").alias("i", "signal"))
        .where(F.col("signal").isNotNull())
        .groupBy(*keys, "signal")
        .agg(F.sum("n").alias("n"), F.min(F.struct("first_pos", "i")).alias("first_pos"))
    )
    # At most five shapes and a few dozen signals exist, so these lists are small by construction.
    shapes = per_shape.groupBy(*keys).agg(
        F.sum("n").alias("record_count"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first_pos", "shape_id", "n"))).alias("s"),
    )
    signals = per_signal.groupBy(*keys).agg(
        F.slice(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first_pos", "signal", "n"))), 1, 6
        ).alias("g")
    )
    top = F.col("s")[0]
    visual = F.col("shape_id") == fx.VISUAL_GENERATION
    modality = F.when(visual, "visual").otherwise(
        "mixed" if fallback_modality == "visual" else "text"
    )
    share = F.col("top_count") / F.col("record_count")
    pair = lambda name: lambda x: F.concat(x[name], F.lit(":"), x["n"].cast("string"))
    return (
        shapes.join(signals, keys, "left")
        .withColumns({"shape_id": top["shape_id"], "top_count": top["n"]})
        .withColumns(
            {
                "modality": modality,
                "confidence": F.round(F.least(F.lit(0.95), F.lit(0.35) + share * 0.60), 4),
                "evidence": F.concat(
                    F.transform("s", pair("shape_id")),
                    F.coalesce(
                        F.transform("g", lambda x: F.concat(F.lit("signal:"), pair("signal")(x))),
                        F.array().cast("array<string>"),
                    ),
                ),
                "shape_counts": F.map_from_entries(
                    F.transform("s", lambda x: F.struct(x["shape_id"], x["n"]))
                ),
                "source": F.array(F.lit(source)),
            }
        )
        .drop("s", "g", "top_count")
        .transform(describe_shapes)
    )
