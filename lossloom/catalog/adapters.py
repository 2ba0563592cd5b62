"""Inputs for the registered queries, derived from the given tables by projections.

``section_000`` owns a third of the ledger on purpose, so every query meets a hot section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom import schemas
from lossloom.functions.shape import shaped_records
from lossloom.operators.examples import normalize_example
from lossloom.operators.health import round_losses
from lossloom.operators.ledger import generated_only
from lossloom.operators.ranking import number_rows, top_n
from lossloom.plans.workspace import deal, settle, stage_table


_SETTLED: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    """The given tables and the ledger-shaped views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def once(self, name: str, build, keep=settle) -> DataFrame:
        """A derived input that several operands of a query share: written once per session."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _SETTLED:
            _SETTLED[key] = keep(build())
        return _SETTLED[key]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def raw_evaluations(self) -> DataFrame:
        return self._as_evaluations(self.read("events"))

    @staticmethod
    def _as_evaluations(events: DataFrame) -> DataFrame:
        """Every event as an evaluation; the loss is text and sometimes not a finite number."""
        e = F.col("event_id")
        seq = F.floor(e / 30)
        recycled = seq % 10 < 3
        return events.select(
            section_of(e).alias("section_id"),
            (F.dayofmonth("ts") - 1).alias("round_id"),
            e.alias("slot_id"),
            F.col("props").alias("sample"),
            F.concat(F.lit("Explain the "), "event_type", F.lit(" event.")).alias("instruct"),
            F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("gold_summary"),
            F.lit("").alias("student_ans"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("token_length"),
            F.when(e % 97 == 0, "nan")
            .when(e % 101 == 0, F.lit(None))
            .when(e % 103 == 0, "inf")
            .when(e % 107 == 0, "bad")
            .otherwise((F.col("value") / 97).cast("string")).alias("loss"),
            F.col("event_type").alias("tag"),
            F.when(recycled, "recycled").otherwise("generated").alias("source"),
            F.when(recycled & (seq >= 7), e - 210).alias("source_ledger_id"),
        )

    def ledger(self) -> DataFrame:
        return self._as_ledger(self.read("events"))

    def _as_ledger(self, events: DataFrame) -> DataFrame:
        """Finite evaluations with the event id as ledger id."""
        loss = F.col("loss").try_cast("double")
        finite = ~F.isnan(loss) & (F.abs(loss) < float("inf"))
        names = [c for c in schemas.columns(schemas.LEDGER)]
        return (
            self._as_evaluations(events)
            .withColumn("loss", loss)
            .where(finite)
            .withColumnRenamed("slot_id", "ledger_id")
            .select(*names)
        )

    def shared_ledger(self) -> DataFrame:
        """The ledger as a table of columns, for queries that read it many times: events are read and parsed once."""
        return self.once("ledger", lambda: deal(self.read("events")).transform(self._as_ledger), lambda df: stage_table(df, "ledger"))

    def messy_tags(self) -> DataFrame:
        """Tags with prefixes, case and punctuation as generators return them."""
        e, t = F.col("event_id"), F.col("event_type")
        k = e % 8
        return self.read("events").select(
            e.alias("ledger_id"),
            section_of(e).alias("section_id"),
            F.when(k == 0, F.concat(F.lit("hard:"), t))
            .when(k == 1, F.concat(F.lit(" Validation: "), F.upper(t), F.lit(" ")))
            .when(k == 2, F.concat(F.lit("wide_variety:"), t))
            .when(k == 3, F.lit("HARD:"))
            .when(k == 4, F.concat(F.lit("__"), F.initcap(t), F.lit("--QA!! ")))
            .when(k == 5, F.lit("Wide Variety"))
            .when(k == 6, F.concat(F.lit("good "), t))
            .otherwise(t).alias("tag"),
        )

    def pairs(self) -> DataFrame:
        """User turns with the assistant answer of the next turn.

        An equi-join on (conversation, turn), so one long conversation does not end up in one task.
        """
        turns = self.read("conversations")
        answers = turns.where(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold_summary")
        )
        return (
            turns.where(F.col("role") == "user")
            .select("conv_id", "turn", F.col("text").alias("instruct"))
            .join(answers, ["conv_id", "turn"])
        )

    def rounds(self) -> DataFrame:
        return self.once("rounds", self._rounds)

    def _rounds(self) -> DataFrame:
        """The last round in the ledger, about to be closed."""
        return self.shared_ledger().groupBy("section_id").agg(F.max("round_id").alias("current_round"))

    def next_rounds(self) -> DataFrame:
        return self.rounds().withColumn("current_round", F.col("current_round") + 1)

    def vault(self) -> DataFrame:
        return self.once("vault", self._vault)

    def _vault(self) -> DataFrame:
        """A vault as the round before left it: the worst earlier rows, with varied lifecycles."""
        n = F.col("ledger_id")
        count = (n % 3).cast("int")
        last = F.col("current_round")
        rows = top_n(
            generated_only(self.shared_ledger()).join(self.rounds(), "section_id").where(F.col("round_id") < last),
            ["section_id"], [F.col("loss").desc(), n], 10, "pos",
        )
        # older incumbents got easier since they were first seen
        loss = F.col("loss") / (1 + F.col("pos") % 4)
        return rows.select(
            "section_id", "pos", "ledger_id", "tag", "token_length", loss.alias("loss"),
            count.alias("recycle_count"),
            F.when(count > 0, last - 1 - (n % 4).cast("int")).alias("last_recycled_round"),
            (n % 7 != 0).alias("active"),
            F.when(n % 7 == 0, "low_loss").alias("retired_reason"),
            F.col("round_id").alias("first_seen_round"),
            F.when(n % 5 != 0, F.col("round_id")).alias("last_seen_round"),
            loss.alias("last_loss"),
            F.when(count > 0, loss).alias("best_recycle_loss"),
        )

    def recycled_evaluations(self) -> DataFrame:
        return self.once("recycled_evaluations", self._recycled_evaluations)

    def _recycled_evaluations(self) -> DataFrame:
        """Evaluations of the closing round, some pointing at vault rows (one of them twice)."""
        again = self.vault().join(self.rounds(), "section_id")
        columns = lambda pos, slot, factor: again.where(F.col("pos") % 3 == pos).select(
            "section_id", F.col("current_round").alias("round_id"),
            (F.col("ledger_id") * 10 + slot).alias("slot_id"), "token_length",
            (F.col("loss") * factor).alias("loss"), F.concat("tag", F.lit("_again")).alias("tag"),
            F.lit("recycled").alias("source"), F.col("ledger_id").alias("source_ledger_id"),
        )
        return columns(0, 1, 0.5).unionByName(columns(0, 2, 0.2)).unionByName(columns(1, 1, 0.9))

    def round_losses(self) -> DataFrame:
        return self.once("round_losses", self._round_losses)

    def _round_losses(self) -> DataFrame:
        """Average loss per round as decision loss; some checkpoints are incomplete."""
        return round_losses(self.shared_ledger()).withColumn(
            "complete", (F.col("round_id") + F.substring("section_id", 9, 3).cast("int")) % 5 != 4
        )

    def state_counts(self) -> DataFrame:
        return self.once("state_counts", self._state_counts)

    def _state_counts(self) -> DataFrame:
        """Remembered tag counts: behind the ledger for some tags, ahead for others, one unseen."""
        seen = self.shared_ledger().groupBy("section_id", "tag").agg(F.count("*").alias("n"))
        bent = seen.select(
            "section_id", "tag", F.when((F.col("tag") == "view") & (F.substring("section_id", 9, 3).cast("int") % 2 == 0), F.col("n") * 4).when(F.length("tag") % 2 == 0, F.col("n") + 5).otherwise(F.floor(F.col("n") / 2)).alias("n")
        )
        extra = seen.select("section_id").distinct().select(
            "section_id", F.lit("Rare-Kind").alias("tag"), F.lit(2).cast("bigint").alias("n")
        )
        return bent.unionByName(extra)

    def examples(self) -> DataFrame:
        return self.once("examples", self._examples, lambda df: stage_table(df, "examples"))

    def _examples(self) -> DataFrame:
        """Seed examples: conversation pairs, some with context, some with visual wording."""
        k = F.col("conv_id") % 5
        rows = self.pairs().select(
            section_of(F.col("conv_id")).alias("section_id"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
            F.when(k == 0, F.concat(F.lit("Passage: "), "instruct")).otherwise(F.col("instruct")).alias("sample"),
            F.col("gold_summary").alias("output"),
            F.when(k == 0, "Which fact answers this?")
            .when(k == 1, "")
            .when(k == 2, "Explain and compare the ideas")
            .otherwise(F.lit(None)).alias("instruct"),
            F.when(k == 0, F.col("instruct")).otherwise(F.lit(None)).alias("context"),
            F.lit(None).cast("string").alias("mode"),
        )
        return number_rows(normalize_example(rows).withColumnRenamed("pos", "_p"), ["section_id"], "_p", "pos").drop("_p")

    def documents(self) -> DataFrame:
        return self.read("documents")

    def shaped_records(self) -> DataFrame:
        """Task records with their shapes instead of their texts."""
        return self.once("shapes", self.task_records, lambda df: shaped_records(df, "record_id", "section_id"))

    def task_records(self) -> DataFrame:
        """Documents and pairs as task records, with openings that reach every shape."""
        d = self.documents()
        k = F.col("doc_id") % 7
        docs = d.select(
            F.col("doc_id").alias("record_id"),
            section_of(F.col("doc_id")).alias("section_id"),
            F.when(k == 1, F.concat(F.lit("Context: "), "text")).otherwise(F.col("text")).alias("sample"),
            F.when(k == 1, "Which fact answers this?")
            .when(k == 2, "Explain the main idea")
            .when(k == 3, "Classify and rank the items in the table")
            .when(k == 4, "Write an image prompt with soft lighting, no logo")
            .when(k == 5, "Sort the rows")
            .when(k == 6, "Why is it so? Return JSON")
            .otherwise("").alias("instruct"),
            F.col("lang").alias("output"),
            F.lit(None).cast("string").alias("context"),
            F.lit(None).cast("string").alias("mode"),
        )
        base = F.lit(1_000_000_000_000)
        turns = self.pairs().select(
            (base + F.col("conv_id") * 10000 + F.col("turn")).alias("record_id"),
            section_of(F.col("conv_id")).alias("section_id"),
            F.lit("").alias("sample"),
            "instruct",
            F.col("gold_summary").alias("output"),
            F.lit(None).cast("string").alias("context"),
            F.lit(None).cast("string").alias("mode"),
        )
        return docs.unionByName(turns)


def section_of(e):
    """A third of all ids in one section, the rest spread over twenty."""
    n = F.greatest(e % 30 - 9, F.lit(0))
    return F.concat(F.lit("section_"), F.lpad(n.cast("string"), 3, "0"))
