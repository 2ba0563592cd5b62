"""Filters and aggregates over the append-only ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossloom import schemas
from lossloom.functions import text as tx
from lossloom.operators.ranking import number_rows, top_n
from lossloom.params import DEFAULTS, Params


def split_finite(evals: DataFrame, loss: str = "loss") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): rows with a finite loss as a double, and the rest untouched."""
    kept = evals.where(tx.is_finite(loss)).withColumn(loss, tx.finite_or_null(loss))
    return kept, evals.where(~tx.is_finite(loss))


def generated_only(df: DataFrame) -> DataFrame:
    """Everything not recycled; a missing source counts as generated."""
    return df.where(~F.col("source").eqNullSafe("recycled"))


def declared_generated(df: DataFrame) -> DataFrame:
    """Only rows whose source is missing or says ``generated``."""
    return df.where(F.coalesce("source", F.lit("generated")) == "generated")


def current_rounds(ledger: DataFrame) -> DataFrame:
    """``(section_id, current_round)``: the round that follows the last one in the ledger."""
    return ledger.groupBy("section_id").agg((F.max("round_id") + 1).alias("current_round"))


def latest_round(ledger: DataFrame) -> DataFrame:
    """Rows of every section's last round.

    The last round is found by a partial aggregate over two columns and joined back, so no section
    is gathered in one task.
    """
    last = ledger.groupBy("section_id").agg(F.max("round_id").alias("round_id"))
    return ledger.join(last, ["section_id", "round_id"], "left_semi")


def recent_generated(ledger: DataFrame, rounds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Generated rows of the last rounds with a loss worth keeping, for refilling the vault."""
    first = F.greatest(F.lit(0), F.col("current_round") - (p.vault_refill_rounds - 1))
    lowest = rounds.agg(F.min(first)).first()[0]  # one number; as a literal it prunes partitions
    return (
        generated_only(ledger)
        .where((F.col("loss") >= p.vault_refill_floor) & (F.col("round_id") >= F.lit(lowest or 0)))
        .join(rounds.select("section_id", "current_round"), "section_id")
        .where(F.col("round_id") >= first)
        .drop("current_round")
    )


_BY_SLOT = ("round_id", "slot_id")


def assign_ids(evals: DataFrame, ledger: DataFrame, order: tuple[str, ...] = _BY_SLOT) -> DataFrame:
    """Give evaluations consecutive ledger ids, by round and slot, after the section's highest one."""
    highest = ledger.groupBy("section_id").agg(F.max("ledger_id").alias("_max"))
    numbered = number_rows(evals, ["section_id"], order, "_pos")
    return (
        numbered.join(highest, "section_id", "left")
        .withColumn("ledger_id", F.coalesce("_max", F.lit(0)) + 1 + F.col("_pos"))
        .drop("_max", "_pos")
    )


def append_ledger(evals: DataFrame, ledger: DataFrame, order: tuple[str, ...] = _BY_SLOT) -> DataFrame:
    """Ledger followed by the finite evaluations under new ids."""
    kept, _ = split_finite(evals)
    names = schemas.columns(schemas.LEDGER)
    return ledger.select(*names).unionByName(assign_ids(kept, ledger, order).select(*names))


def tag_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(tx.blank_to_null("tag").isNotNull()).groupBy(*keys, "tag").agg(
        F.count("*").alias("n")
    )


def source_counts(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key with generated and recycled counts side by side."""
    return (
        df.groupBy(*keys)
        .pivot("source", ["generated", "recycled"])
        .agg(F.count(F.lit(1)))
        .na.fill(0, ["generated", "recycled"])
    )


def sync_tag_counts(state_counts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per tag, the larger of the remembered count and the ledger's count."""
    seen = tag_counts(ledger, "section_id").withColumnRenamed("n", "ledger_n")
    return state_counts.join(seen, ["section_id", "tag"], "full_outer").select(
        "section_id", "tag",
        F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("ledger_n", F.lit(0))).alias("n"),
    )


def known_categories(counts: DataFrame) -> DataFrame:
    """Counts per normalised category; spellings of one category are merged."""
    return (
        counts.withColumn("tag", tx.normalize_tag("tag"))
        .where(tx.is_category("tag"))
        .groupBy("section_id", "tag")
        .agg(F.sum("n").alias("n"))
    )


def render_tag_counts(counts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Text blocks for prompts: raw counts by tag, and known categories by count.

    A prompt names the ``prompt_tags`` most frequent tags and categories of a section and sums up the others in a last line;
    the counts themselves stay a table.
    """
    def block(df: DataFrame, order: Column, line: Column, out: str) -> DataFrame:
        shown = top_n(df, ["section_id"], [F.col("n").desc(), F.col("tag")], p.prompt_tags, "_place")
        lines = shown.groupBy("section_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "tag", line.alias("line")))), lambda x: x["line"]).alias("_lines"),
            F.sum("n").alias("_shown"),
        )
        totals = df.groupBy("section_id").agg(F.sum("n").alias("_n"), F.count("*").alias("_tags"))
        more = F.col("_tags") - F.size("_lines")
        rest = F.concat(F.lit("- "), more.cast("string"), F.lit(" others: "), (F.col("_n") - F.col("_shown")).cast("string"))
        told = F.when(more > 0, F.concat("_lines", F.array(rest))).otherwise(F.col("_lines"))
        return lines.join(totals, "section_id").select("section_id", F.array_join(told, "\n").alias(out))

    n = F.col("n").cast("string")
    raw = block(counts, F.lit(0), F.concat(F.lit("- "), "tag", F.lit(": "), n), "tag_counts_text")
    known = block(
        known_categories(counts), -F.col("n"),
        F.concat(F.lit("- "), "tag", F.lit(" ("), n, F.lit(")")), "categories_text",
    )
    return raw.join(known, "section_id", "left")


def loss_list(ledger: DataFrame, vault: DataFrame) -> DataFrame:
    """High-loss rows first: the vault's where a section has one, else the ledger's."""
    names = ["section_id", "ledger_id", "tag", "token_length", "loss"]
    sections = vault.select("section_id").distinct()
    rest = ledger.select(*names).join(sections, "section_id", "left_anti")
    return vault.select(*names).unionByName(rest).orderBy(
        "section_id", F.col("loss").desc(), "ledger_id"
    )


def recent_distinct(ledger: DataFrame, col: str, n: int = 3, window: int = 25, chars: int = 140) -> DataFrame:
    """Newest distinct previews of a text column among each section's last rows."""
    last = top_n(
        ledger.select("section_id", "ledger_id", col), ["section_id"], [F.col("ledger_id").desc()],
        window, "_rn",
    )
    texts = (
        last.withColumn("text", tx.preview(col, chars))
        .where(F.col("text") != "")
        .groupBy("section_id", "text")
        .agg(F.min("_rn").alias("_rn"))
    )
    return top_n(texts, ["section_id"], [F.col("_rn")], n, "pos").select("section_id", "pos", "text")


def keep_last(df: DataFrame, n: int, keys: list[str] | None = None, order: str = "round_id") -> DataFrame:
    """History truncation: the newest ``n`` rows per key."""
    return top_n(df, keys or ["section_id"], [F.col(order).desc()], n, "_rn").drop("_rn")


def ordered_union(*arrays: Column) -> Column:
    """Concatenate and keep the first occurrence of every element."""
    return F.array_distinct(F.concat(*arrays))


def evaluation_events(dropped: DataFrame) -> DataFrame:
    """Event rows describing evaluations that were dropped, with text previews."""
    payload = F.to_json(
        F.struct(
            "round_id", "source", "source_ledger_id", "tag",
            F.col("loss").cast("string").alias("loss"), "token_length",
            tx.preview("instruct", 220).alias("instruct_preview"),
            tx.preview("sample", 220).alias("sample_preview"),
            tx.preview("gold_summary", 220).alias("gold_preview"),
        )
    )
    return dropped.select(
        "section_id", F.lit("nonfinite_evaluations_dropped").alias("event_type"), payload.alias("payload")
    )
