"""An outside generator in the loop, state carried from round to round, and what is written."""

import glob
import random

from pyspark.sql import functions as F

from lossloom import schemas
from lossloom.operators import examples, generation, health, ledger, sums
from lossloom.operators import policy as po
from lossloom.params import Params
from lossloom.plans.loop import StageTables, run_generated
from lossloom.sources.files import write_partitions

WANTED = "section_id string, round_id int, slot_id int, generation_index int, tag string, is_exploration boolean, forced boolean"
COUNTS = "section_id string, tag string, n long"
TAGS = "section_id string, round_id int, tag string"
ANSWER = "section_id string, round_id int, slot_id int, response string"


def row(slot, tag, sample="s", gold="g"):
    return f'{{"slot_id": {slot}, "sample": "{sample}", "instruct": "do", "gold_summary": "{gold}", "tag": "{tag}"}}'


def test_attempts_until_every_slot_is_settled(spark):
    wanted = spark.createDataFrame([("a", 0, k, k - 1, "wide_variety" if k < 4 else "t", k < 4, False) for k in range(1, 7)], WANTED)
    none = spark.createDataFrame([], COUNTS)
    used = spark.createDataFrame([("a", 0, "old")], TAGS)
    done = spark.createDataFrame([], generation.ATTEMPT)
    first = "[" + ", ".join([row(1, "old"), row(2, "fresh"), row(3, "fresh"), row(4, "t", sample="  "), row(6, "t", gold="")]) + "]"
    answers = [
        [("a", 0, None, f"Here: {first}")],
        [("a", 0, 1, row(9, "fresh")), ("a", 0, 3, "nothing"), ("a", 0, 4, row(1, "t")), ("a", 0, 5, "[]"), ("a", 0, 6, row(6, "t"))],
        [("a", 0, 1, row(1, "fresh")), ("a", 0, 3, row(3, "new"))],
    ]
    for attempt, told in enumerate(answers):
        judged = generation.judge_answers(wanted, done, spark.createDataFrame(told, ANSWER), none, used, attempt)
        done = spark.createDataFrame(judged.collect(), generation.ATTEMPT).unionByName(done)
    got = {(r.attempt, r.slot_id): (r.status, r.reason) for r in done.collect()}
    assert got == {
        (0, 1): ("rejected", "tag_in_round"), (0, 2): ("accepted", None), (0, 3): ("rejected", "tag_in_round"), (0, 4): ("missing", "missing_sample"),
        (0, 5): ("missing", "no_answer"), (0, 6): ("missing", "missing_gold"),
        (1, 1): ("rejected", "tag_in_round"), (1, 3): ("missing", "invalid_json"), (1, 4): ("accepted", None), (1, 5): ("missing", "empty_list"), (1, 6): ("accepted", None),
        (2, 1): ("accepted", "after_limit: tag_in_round"), (2, 3): ("accepted", None),
    }
    assert [(r.slot_id, r.reason) for r in generation.unfilled(wanted, done).collect()] == [(5, "empty_list")]
    assert generation.open_slots(wanted, done, 3).count() == 0


def test_no_slots_and_no_answers(spark):
    wanted, none = spark.createDataFrame([], WANTED), spark.createDataFrame([], COUNTS)
    done, answers = spark.createDataFrame([], generation.ATTEMPT), spark.createDataFrame([], ANSWER)
    for attempt in (0, 1):
        assert generation.judge_answers(wanted, done, answers, none, spark.createDataFrame([], TAGS), attempt).count() == 0


def test_tag_groups_fail_section_by_section(spark):
    metrics = spark.createDataFrame(
        [(s, t, 1.0, 2, 5) for s in "abcdefgh" for t in ("x", "y")], "section_id string, tag string, avg_loss double, n long, oldest_ledger_id long"
    )
    answers = [
        ("a", '{"top_tags": [{"tag": "both", "avg_loss": 2, "source_tags": ["x", "y"]}]}'), ("b", "no json"), ("c", '{"top_tags": 3}'),
        ("d", '{"top_tags": [{"tag": "both"}]}'), ("e", '{"top_tags": [5, {"tag": " "}]}'), ("f", '{"top_tags": [{"tag": "z", "avg_loss": 2, "source_tags": ["z"]}]}'),
        ("g", '{"top_tags": [{"tag": "x", "avg_loss": 2}, {"tag": "w", "avg_loss": 1, "source_tags": ["x"]}]}'),
    ]
    frame = spark.createDataFrame(answers, "section_id string, response string")
    got, problems = generation.grouped_metrics(metrics, frame, strict=True)
    assert {r.section_id: r.reason for r in problems.collect()} == {
        "b": "invalid_json", "c": "no_top_tags", "d": "no_avg_loss", "e": "no_groups", "f": "unknown_source_tag", "g": "repeated_source_tag", "h": "no_answer",
    }
    assert sorted((r.section_id, r.tag) for r in got.collect()) == sorted([("a", "both"), *((s, t) for s in "bcdefgh" for t in "xy")])
    loose = generation.grouped_metrics(metrics, frame)[1]
    assert {r.section_id for r in loose.collect()} == set("bcdeh")


def test_the_loop_waits_for_answers_and_goes_on(spark, tmp_path):
    rows = [("s", k, f"Sample text {k}", f"out {k}", "Summarize the text.", None, "plain") for k in range(3)]
    seeds = spark.createDataFrame(rows, "section_id string, pos long, sample string, output string, instruct string, context string, mode string")
    score = lambda df: df.withColumn("token_length", F.length("sample")).withColumn("loss", F.lit(1.0))
    root, p = str(tmp_path / "loop"), Params(generation_attempts=1)
    tables, ready = run_generated(spark, root, seeds, score, p=p)
    assert not ready and tables.done("requests_0", 1) and not tables.done("batch", 1)
    asked = tables.at("requests_0", 1, generation.REQUEST).collect()
    assert len(asked) == 1 and asked[0].slots == 10 and '"slot_id":10' in asked[0].prompt
    assert not run_generated(spark, root, seeds, score, p=p)[1]  # nothing has changed
    batch = "[" + ",".join(row(k, f"kind_{k}") for k in range(1, 10)) + "]"
    tables.write(spark.createDataFrame([("s", 0, None, batch)], ANSWER), "responses_0", 1)
    tables, ready = run_generated(spark, root, seeds, score, p=p)
    assert not ready and [r.slot_id for r in tables.at("requests_1", 1, generation.REQUEST).collect()] == [10]
    tables.write(spark.createDataFrame([("s", 0, 10, row(10, "kind_ten"))], ANSWER), "responses_1", 1)
    checkpoints = spark.createDataFrame([("s", 0, False)], "section_id string, round_id int, complete boolean")
    tables, ready = run_generated(spark, root, seeds, score, p=p, checkpoints=checkpoints)
    assert ready and StageTables(spark, root).next_step() == 2
    assert tables.at("ledger", 1, schemas.LEDGER).count() == 10 and tables.at("vault", 1, schemas.VAULT).count() > 0
    assert tables.at("round_losses", 1, schemas.ROUND_LOSS).first().complete is False
    assert tables.at("complete", 1, "section_id string, last_complete int").count() == 0


def test_state_of_rounds_against_folds_over_all(spark):
    pick = random.Random(23)
    rows = [(s, k, pick.choice([None, pick.random() + 0.5, pick.random() + 0.5]), pick.random() < 0.7) for s in ("a", "b", "c") for k in range(14) if pick.random() < 0.9]
    rounds = spark.createDataFrame(rows, "section_id string, round_id int, decision_loss double, complete boolean").cache()
    state, seen = spark.createDataFrame([], sums.HEALTH_STATE), []
    for k in range(14):
        state = spark.createDataFrame(sums.health_step(state, rounds.where(F.col("round_id") == k)).collect(), sums.HEALTH_STATE)
        seen += [(r.section_id, r.round_id, r.action, r.best_eval_loss, r.best_round_id, r.bad_round_streak, r.base_override_round) for r in sums.last_round(state).collect() if r.round_id == k and r.action]
        assert all(len(r.rounds) <= 4 for r in state.collect())
    want = health.round_health(rounds).collect()
    assert sorted(map(str, seen)) == sorted(str((r.section_id, r.round_id, r.action, r.best_eval_loss, r.best_round_id, r.bad_round_streak, r.base_override_round)) for r in want)
    now = {r.section_id: r for r in sums.health_now(state).collect()}
    plateau = {(r.section_id, r.round_id): r.validation_plateau for r in health.plateau_score(health.round_health(rounds)).collect()}
    for r in health.latest_health(health.round_health(rounds)).collect():
        assert now[r.section_id].latest_action == r.action and abs(now[r.section_id].validation_plateau - plateau[r.section_id, r.round_id]) < 1e-9


def test_sums_against_the_ledger(spark):
    pick = random.Random(29)
    rows = [(pick.choice("ab"), k, pick.choice(["x", "y", "", None, "good"]), float(k % 7), k // 20, pick.choice(["generated", "recycled", None, "other"])) for k in range(1, 120)]
    frame = spark.createDataFrame(rows, "section_id string, ledger_id long, tag string, loss double, round_id int, source string")
    tags, sections = spark.createDataFrame([], sums.TAG_SUMS), spark.createDataFrame([], sums.SECTION_SUMS)
    for k in range(6):
        part = frame.where(F.col("round_id") == k)
        tags, sections = sums.add_tag_sums(tags, part), sums.add_section_sums(sections, part)
    plain = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert plain(sums.counts_of(tags)) == plain(ledger.tag_counts(frame, "section_id"))
    names = ["section_id", "tag", "avg_loss", "n", "oldest_ledger_id"]
    assert plain(sums.metrics_of(tags).select(names)) == plain(po.per_tag_loss(frame).select(names))
    assert {r.section_id: (r.last_ledger_id, r.records) for r in sections.collect()} == {s: (max(x[1] for x in rows if x[0] == s), sum(x[0] == s for x in rows)) for s in "ab"}


def test_a_partition_gets_few_files(spark, tmp_path):
    rows = spark.range(20_000).repartition(16).select((F.col("id") % 10).cast("string").alias("section_id"), F.lit(0).alias("round_id"), "id")
    write_partitions(rows, str(tmp_path / "t"))
    assert len(glob.glob(str(tmp_path / "t/*/*/*.parquet"))) == 10
    write_partitions(rows.where("section_id = '3'").limit(5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 18_000 + 5


def test_a_long_example_file(spark):
    text = "\n".join(f"Sample:\nline {k}\nmore\nOutput: x" for k in range(12_500))
    files = spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "file string, value string")
    got = examples.parse_examples_text(files)
    assert got.count() == 12_500 and got.agg(F.max("pos")).first()[0] == 12_499
