"""Streaming forms of the ledger, loss monitor, round health and vault."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from lossloom import schemas
from lossloom.functions import text as tx
from lossloom.operators import vault as vt
from lossloom.operators.health import judge_round
from lossloom.params import DEFAULTS, Params
from lossloom.plans.workspace import settle
from lossloom.sources.files import read_ledger, read_vault, write_ledger, write_vault


def stream_ledger(
    evals: DataFrame, time: str = "ts", delay: str = "1 hour", keys: tuple[str, ...] = ("section_id", "slot_id")
) -> DataFrame:
    """Evaluations once each, with ``finite`` telling ledger rows from dropped ones.

    Duplicates are forgotten once the watermark has passed, so the state stays bounded.
    """
    once = evals.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return once.withColumn("finite", tx.is_finite("loss")).withColumn("loss", tx.finite_or_null("loss"))


def stream_loss_monitor(
    evals: DataFrame, window: str = "1 day", slide: str | None = None, session_gap: str | None = None,
    time: str = "ts", delay: str = "10 minutes",
) -> DataFrame:
    """Loss per tag over tumbling, sliding or session windows; rows behind the watermark drop."""
    frame = F.session_window(time, session_gap) if session_gap else F.window(time, window, slide or window)
    return (
        evals.withColumn("loss", tx.finite_or_null("loss"))
        .where(F.col("loss").isNotNull())
        .withWatermark(time, delay)
        .groupBy(frame.alias("w"), "section_id", "tag")
        .agg(F.count("*").alias("n"), F.avg("loss").alias("avg_loss"), F.max("loss").alias("max_loss"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "section_id", "tag", "n", "avg_loss", "max_loss",
        )
    )


_HEALTH = (
    "section_id string, round_id int, decision_loss double, best_eval_loss double, best_round_id int, "
    "bad_round_streak int, base_override_round int, action string"
)
_STATE = (
    "best double, best_round int, streak int, override int, last int, rounds array<int>, losses array<double>, "
    "complete array<boolean>"
)


def stream_round_health(rounds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Health action per arriving scored round; the state is the best loss, the streak and a few rounds.

    Unscored rounds give no row but stay in the state, as a complete one can be rolled back to. Rounds of a section must
    arrive in order across micro-batches; within one they are sorted. A round that arrives after a later one was judged
    gets the action ``late`` and changes neither the best loss nor the streak.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, best_round, streak, override, last, past = None, None, 0, None, None, []
        if state.exists:
            best, best_round, streak, override, last, rs, ls, cs = state.get
            past = list(zip(rs, ls, cs, strict=True))
        out = []
        arrived = pd.concat(list(frames)).sort_values("round_id")
        for r, loss, complete in arrived[["round_id", "decision_loss", "complete"]].itertuples(index=False):
            r, loss = int(r), None if pd.isna(loss) else float(loss)
            late = last is not None and r <= last
            near = [(q, x) for q, x, c in past if c and r - p.rollback_lookback <= q < r]
            scored = [(x, -q) for q, x in near if x is not None and not pd.isna(x)]
            target = -min(scored)[1] if scored else max((q for q, _ in near), default=None)
            if loss is not None and not late:
                (best, best_round, streak, override), action = judge_round((best, best_round, streak, override), r, loss, target, p)
            if loss is not None:
                out.append((key[0], r, loss, best, best_round, streak, override, "late" if late else action))
            last = r if last is None else max(last, r)
            past = [x for x in [*past, (r, loss, bool(complete))] if x[0] >= last - p.rollback_lookback]
        rs, ls, cs = ([x[k] for x in past] for k in range(3))
        state.update((best, best_round, streak, override, last, rs, ls, cs))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _HEALTH.split(", ")])
        yield frame.astype({"base_override_round": "Int32", "best_round_id": "Int32"})

    return rounds.groupBy("section_id").applyInPandasWithState(judge, _HEALTH, _STATE, "append", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JUDGED = "best double, best_round int, streak int, override int"
_PAST = "round_id int, loss double, complete boolean"


class _OrderedHealth(StatefulProcessor):
    """Holds a section's rounds until the watermark has passed them, then judges them in order."""

    def __init__(self, p: Params):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.judged = handle.getValueState("judged", _JUDGED)
        self.past = handle.getListState("past", _PAST)  # rounds that a later one may go back to
        self.waiting = handle.getMapState("waiting", "round_id int", "loss double, complete boolean, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples(index=False):
                due = int(r.due)
                loss = None if pd.isna(r.decision_loss) else float(r.decision_loss)
                self.waiting.updateValue((int(r.round_id),), (loss, bool(r.complete), due))
                self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator() if v[2] <= now)
        state = tuple(self.judged.get()) if self.judged.exists() else (None, None, 0, None)
        past, out, p = [tuple(x) for x in self.past.get()], [], self.p
        for r, loss, complete in ready:
            near = [(q, x) for q, x, c in past if c and r - p.rollback_lookback <= q < r]
            scored = [(x, -q) for q, x in near if x is not None]
            target = -min(scored)[1] if scored else max((q for q, _ in near), default=None)
            if loss is not None:
                state, action = judge_round(state, r, loss, target, p)
                out.append((key[0], r, loss, *state, action))
            past = [x for x in [*past, (r, loss, complete)] if x[0] >= r - p.rollback_lookback]
            self.waiting.removeKey((r,))
        if ready:
            self.judged.update(state)
            self.past.put(past)
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _HEALTH.split(", ")])
            yield frame.astype({"base_override_round": "Int32", "best_round_id": "Int32"})

    def close(self) -> None:
        pass


def stream_ordered_health(rounds: DataFrame, time: str = "ts", delay: str = "3 days", p: Params = DEFAULTS) -> DataFrame:
    """Health action per scored round, in order, from rounds that may arrive in any order within ``delay``.

    ``rounds``: ``section_id, round_id, decision_loss, complete`` and an event time that grows with the round. A round waits in
    the state until the watermark passes its time; a timer then judges what waits, by round. So the result is that of
    ``round_health`` over the whole, and no round is only marked late. Rounds behind the watermark are dropped. The query
    needs the state store ``ROCKS``.
    """
    due = (F.unix_millis(F.col(time))).alias("due")
    rows = rounds.withWatermark(time, delay).select("section_id", "round_id", "decision_loss", "complete", time, due)
    return rows.groupBy("section_id").transformWithStateInPandas(_OrderedHealth(p), _HEALTH, "append", "EventTime")


def stream_vault(ledger_rows: DataFrame, ledger_path: str, vault_path: str, checkpoint: str, p: Params = DEFAULTS):
    """Keep ledger and vault tables up to date from a stream of ledger rows.

    A micro-batch may hold any part of any rounds. Its rows are merged into the ledger by section and ledger id, and the
    vaults of the rounds they touch, and of the later ones of the same sections, are built again, each from the section's
    newest earlier snapshot. So a repeated micro-batch changes nothing, and gaps between rounds do no harm.
    """
    spark = ledger_rows.sparkSession
    key = ["section_id", "round_id"]

    def close(rows: DataFrame, _batch_id: int) -> None:
        rows = settle(rows.select(*schemas.columns(schemas.LEDGER)).dropDuplicates(["section_id", "ledger_id"]))
        touched = rows.select(*key).distinct()
        there = read_ledger(spark, ledger_path).join(touched, key, "left_semi")
        kept = there.join(rows.select("section_id", "ledger_id"), ["section_id", "ledger_id"], "left_anti")
        write_ledger(settle(kept.unionByName(rows)), ledger_path)

        first = touched.groupBy("section_id").agg(F.min("round_id").alias("first"))
        known = read_ledger(spark, ledger_path).select(*key).distinct().join(first, "section_id").where("round_id >= first")
        wave = F.row_number().over(Window.partitionBy("section_id").orderBy("round_id"))
        todo = settle(known.select("section_id", F.col("round_id").alias("current_round"), wave.alias("wave")))
        for n in range(1, (todo.agg(F.max("wave")).first()[0] or 0) + 1):  # the most rounds that one section has to close
            rounds = todo.where(F.col("wave") == n).drop("wave")
            ledger = read_ledger(spark, ledger_path).join(rounds, "section_id").where("round_id <= current_round")
            evals = ledger.where("round_id = current_round").withColumn("slot_id", F.col("ledger_id"))
            earlier = read_vault(spark, vault_path).join(rounds, "section_id").where("round_id < current_round")
            newest = earlier.groupBy("section_id").agg(F.max("round_id").alias("round_id"))
            before = earlier.join(newest, key, "left_semi").drop("round_id", "current_round")
            vault = vt.build_vault(ledger.drop("current_round"), evals.drop("current_round"), before, rounds, p)
            named = vault.join(rounds.withColumnRenamed("current_round", "round_id"), "section_id")
            write_vault(settle(named), vault_path)

    return (
        ledger_rows.writeStream.foreachBatch(close)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
