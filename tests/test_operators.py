"""Edge cases and brute-force comparisons on small fixtures."""

import difflib
import math
import random
from dataclasses import replace

from pyspark.sql import functions as F

from lossloom.functions import text as tx
from lossloom.operators import batch, examples, ledger, planner, policy, ranking, vault
from lossloom.params import DEFAULTS, Params


def test_finite_losses(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,), ("-0.2",)], "loss string")
    kept, dropped = ledger.split_finite(df)
    assert sorted(r.loss for r in kept.collect()) == [-0.2, 1.5]
    assert dropped.count() == 4


def test_percentile_and_numbering_match_brute_force(spark):
    rng = random.Random(1)
    sizes = {"a": 30_000, "b": 900, **{f"s{n}": n for n in range(1, 30)}}
    rows = [(k, rng.randrange(1 << 60), rng.choice([0.1, 0.2, rng.random()])) for k, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(7).cache()
    for p in (0.0, 0.1, 0.5, 0.75, 1.0):
        got = {r.k: r.p for r in ranking.percentile_nr(df, ["k"], "v", p, "p").collect()}
        for k in sizes:
            vs = sorted(v for kk, _, v in rows if kk == k)
            assert got[k] == vs[round((len(vs) - 1) * p)], (k, p)
    pos = ranking.number_rows(df, ["k"], "i", "p").collect()  # sparse ids
    for k in sizes:
        mine = sorted((r.i, r.p) for r in pos if r.k == k)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_tables_written_section_by_section(spark, tmp_path):
    from lossloom import schemas
    from lossloom.sources import files

    row = lambda s, i, r: (s, i, "x", "", "", "", 1, 1.0, "t", r, "generated", None)
    for part in ([row("A", 1, 3)], [row("B", 1, 3), row("B", 2, 4)], [row("007", 1, 3)], [row("A", 5, 3)]):
        files.write_ledger(spark.createDataFrame(part, schemas.LEDGER), f"{tmp_path}/ledger")
    got = {(r.section_id, r.ledger_id, r.round_id) for r in files.read_ledger(spark, f"{tmp_path}/ledger").collect()}
    assert got == {("A", 5, 3), ("B", 1, 3), ("B", 2, 4), ("007", 1, 3)}
    for r in range(5):
        snap = spark.createDataFrame([("A", r, float(r))] + ([("B", r, 9.0)] if r == 1 else []), "section_id string, round_id int, v double")
        files.write_planner_history(snap, f"{tmp_path}/history", keep=2)
    kept = spark.read.parquet(f"{tmp_path}/history").collect()
    assert sorted((r.section_id, r.round_id) for r in kept) == [("A", 3), ("A", 4), ("B", 1)]


def test_every_row_gets_a_verdict(spark):
    rows = [("A", 1, 1, "x"), ("A", 1, 1, "y"), ("A", 1, 11, "z"), ("A", 1, None, "w"), ("A", 1, 2, "x"), ("A", 1, 3, "x")]
    frame = spark.createDataFrame([(*r, True, False) for r in rows], "section_id string, round_id int, slot_id int, tag string, is_exploration boolean, forced boolean")
    counts = spark.createDataFrame([("A", f"t{k}", 1) for k in range(9)], "section_id string, tag string, n long")

    def reasons(p):
        return sorted(((r.slot_id or 0, r.tag, r.reject_reason) for r in batch.accept_diverse(frame, counts, p=p).collect()), key=str)

    once = reasons(DEFAULTS)
    assert len(once) == len(rows)
    assert {x[2] for x in once if x[0] in (0, 11)} == {"slot_out_of_range"} and (1, "y", "duplicate_slot") in once
    assert (1, "x", None) in once and (2, "x", "tag_in_round") in once and (3, "x", "tag_in_round") in once
    twice = reasons(replace(DEFAULTS, tags_per_round=2))
    assert (2, "x", None) in twice and (3, "x", "tag_in_round") in twice


def test_two_rounds_of_a_section_take_different_rows(spark):
    recipe = spark.createDataFrame(
        [("A", r, s, "generate", t, None) for r in (1, 2) for s, t in ((1, "x"), (2, "x"), (3, "wide_variety"))],
        "section_id string, round_id int, slot_id int, command string, tag string, failure_ledger_id long",
    )
    pool = spark.createDataFrame([("A", i, t, float(i)) for i, t in enumerate("xxxxyyyyzz")], "section_id string, sample_id long, tag string, score double")
    counts = spark.createDataFrame([("A", "x", 3), ("A", "y", 2)], "section_id string, tag string, n long")
    got = batch.select_from_pool(recipe, pool, counts).collect()
    taken = [r.sample_id for r in got if r.sample_id is not None]
    assert len(taken) == 6 == len(set(taken))


def test_phrase_over_three_examples(spark):
    from lossloom.operators.examples import resolve_task_mode

    texts = ["please generate", "an", "image of it", "and other words"]
    rows = [("A", k, t, None, None, None) for k, t in enumerate(texts)]
    got = resolve_task_mode(spark.createDataFrame(rows, "section_id string, pos long, sample string, instruct string, context string, output string")).first()
    one = [("A", 0, " ".join(texts), None, None, None)]
    whole = resolve_task_mode(spark.createDataFrame(one, "section_id string, pos long, sample string, instruct string, context string, output string")).first()
    assert got.mode_evidence == whole.mode_evidence and got.visual_score == whole.visual_score > 0


def test_streamed_health_keeps_unscored_rounds(spark, tmp_path):
    from lossloom import schemas
    from lossloom.operators import health
    from lossloom.streaming import streams

    rng = random.Random(4)
    rows = []
    for s in range(12):
        for r in range(25):
            loss = None if rng.random() < 0.3 else round(1 + rng.random() + r * 0.05, 3)
            rows.append((f"s{s}", r, loss, rng.random() < 0.7))
    frame = spark.createDataFrame(rows, schemas.ROUND_LOSS)
    for part in range(3):
        frame.where((F.col("round_id") / 9).cast("int") == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    names = ["section_id", "round_id", "decision_loss", "best_eval_loss", "best_round_id", "bad_round_streak", "base_override_round", "action"]
    want = sorted(health.round_health(frame).select(*names).collect(), key=str)
    out = str(tmp_path / "out")
    once = streams.stream_round_health(spark.readStream.schema(schemas.ROUND_LOSS).parquet(f"{tmp_path}/in"))
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(availableNow=True).start().awaitTermination()
    got = sorted(spark.read.parquet(out).select(*names).collect(), key=str)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert {r.action for r in got} >= {"rollback_next", "degraded", "new_best"}


def test_last_response_wins_and_tags_are_conformed(spark):
    items = spark.createDataFrame([("A", 1, k + 1, k, "slot_tag") for k in range(2)], "section_id string, round_id int, slot_id int, generation_index int, tag string")
    row = '{{"slot_id": {0}, "sample": "{1}", "instruct": "do it", "gold_summary": "g", "tag": "Hard: Good Tag"}}'
    raw = spark.createDataFrame(
        [("A", 1, 1, "[" + row.format(1, "old") + "]"), ("A", 1, 2, "[" + row.format(1, "new") + "]"), ("A", 1, 3, "broken")],
        "section_id string, round_id int, response_no int, response string",
    )
    counts = spark.createDataFrame([("A", "good_tag", 3)], "section_id string, tag string, n long")
    good, bad = batch.ingest_responses(raw, items, counts)
    assert [(r.sample, r.tag, r.tag_match) for r in good.collect()] == [("new", "good_tag", "exact")]
    assert sorted(r.reason for r in bad.collect()) == ["duplicate_slot_id", "invalid_json"]


def _mutate(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(s))
        op = rng.random()
        if op < 0.4:
            s.pop(at)
        elif op < 0.7:
            s.insert(at, rng.choice("abcdef_"))
        else:
            s[at] = rng.choice("abcdef_")
        if not s:
            s = ["a"]
    return "".join(s).strip("_") or "a"


def test_fuzzy_tags_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "_".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 5)))
    known = sorted({word() for _ in range(60)})
    tags = [tx_norm(_mutate(rng, rng.choice(known))) for _ in range(200)] + [word() for _ in range(30)]
    counts = spark.createDataFrame([("s", k, 1) for k in known], "section_id string, tag string, n long")
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(tags)], "section_id string, i int, tag string")
    got = {r.i: r.tag for r in batch.conform_tags(df, counts).collect()}
    for i, t in enumerate(tags):
        close = difflib.get_close_matches(t, known, n=1, cutoff=0.92)
        want = t if t in known else (close[0] if close else t)
        assert got[i] == want, (t, got[i], want)


def tx_norm(s):
    import re

    return re.sub("[^a-z0-9]+", "_", s.lower()).strip("_") or "a"


def test_allocation_sums_to_the_focused_slots(spark):
    rng = random.Random(3)
    rows = [(f"s{s}", f"t{i}", rng.random() * 3, 5, i + 1) for s in range(12) for i in range(rng.randint(1, 9))]
    rows.append(("zero", "t", 0.0, 1, 1))
    metrics = spark.createDataFrame(rows, "section_id string, tag string, avg_loss double, n long, oldest_ledger_id long")
    alloc = policy.allocate_slots(metrics)
    for r in alloc.groupBy("section_id").agg(F.sum("slots").alias("n"), F.min("slots").alias("lo")).collect():
        assert r.lo >= 1 and (r.n == 6 or r.section_id == "zero")
    sections = metrics.select("section_id").distinct()
    plan = {r.section_id: r.plan for r in policy.tag_plan(sections, alloc).collect()}
    assert all(len(p) == 10 and p[:4] == ["wide_variety"] * 4 for p in plan.values())
    assert plan["zero"][4:] == ["t"] * 6


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (4.5,)], "v double")
    assert [r.r for r in df.select(tx.round_half_even("v").alias("r")).collect()] == [2, 4, 4]


def test_vault_is_bounded_and_repeatable(spark):
    rng = random.Random(9)
    rows = [
        ("s", i, f"t{i % 4}", 10, rng.choice([0.1, 0.15, 0.35, rng.random() * 2]), i // 12, rng.choice(["generated", None, "recycled"]))
        for i in range(1, 60)
    ]
    led = spark.createDataFrame(
        rows, "section_id string, ledger_id long, tag string, token_length int, loss double, round_id int, source string"
    ).withColumn("source_ledger_id", F.lit(None).cast("bigint")).withColumn("slot_id", F.col("ledger_id"))
    from lossloom import schemas

    snap = spark.createDataFrame([], schemas.VAULT)
    for rnd in range(5):
        now = spark.createDataFrame([("s", rnd)], "section_id string, current_round int")
        upto = led.where(F.col("round_id") <= rnd)
        built = vault.build_vault(upto, upto.where(F.col("round_id") == rnd), snap, now).orderBy("pos").collect()
        again = vault.build_vault(upto, upto.where(F.col("round_id") == rnd), snap, now).orderBy("pos").collect()
        assert built == again and len(built) <= 10
        assert all(math.isfinite(r.loss) for r in built)
        assert len({r.ledger_id for r in built}) == len(built)
        snap = spark.createDataFrame(built, schemas.VAULT)


def test_example_text_blocks(spark):
    texts = {
        "good": "Sample:\na b\n\nOutput: c\n\nSample:\nd\nOutput:\ne",
        "void": "Sample:\na\nOutput:\nb\nSample:\nno output",
        "template": "Sample:\nWrite the source text here.\nOutput:\nx",
        "context": "Question: when?\nInput:\nlong ago\nOutput:\nthen",
    }
    files = spark.createDataFrame(list(texts.items()), "file string, value string")
    got = [(r.file, r.pos, r.sample, r.output, r.mode) for r in examples.parse_examples_text(files).collect()]
    assert sorted(got) == [
        ("context", 0, "long ago", "then", "contextual"), ("good", 0, "a b", "c", "plain"), ("good", 1, "d", "e", "plain"),
    ]


def test_responses_split_into_good_and_quarantine(spark):
    rows = [
        ("a", 0, '```json\n{"items": [{"slot_id": 1, "sample": "x", "instruct": "do", "gold_summary": "y", "tag": "T"}, 5]}\n```'),
        ("b", 0, 'text {"sample": "x", "instruct": "do", "output": "y"} more'),
        ("c", 0, "[]"), ("d", 0, "nothing"), ("e", 0, '[{"slot_id": 9, "sample": "x", "instruct": "do", "output": "y"}]'),
    ]
    raw = spark.createDataFrame(rows, "section_id string, round_id int, response string")
    items = spark.createDataFrame(
        [(s, 0, 1, 0, "slot") for s in "abcde"], "section_id string, round_id int, slot_id int, generation_index int, tag string"
    )
    good, bad = batch.ingest_responses(raw, items)
    assert sorted((r.section_id, r.tag) for r in good.collect()) == [("a", "T"), ("b", "slot")]
    assert sorted((r.section_id, r.reason) for r in bad.collect()) == [
        ("a", "not_an_object"), ("c", "empty_list"), ("d", "invalid_json"), ("e", "unknown_slot_id"),
    ]


def test_params_fix_the_slot_split():
    assert (Params().exploration_slots(), Params().focused_slots()) == (4, 6)


def test_combine_constraints_skips_blanks(spark):
    df = spark.range(1).select(
        planner.combine_constraints(F.lit("a "), F.lit(" "), F.lit("No extra constraints."), F.lit("b")).alias("x"),
        planner.combine_constraints(F.lit("")).alias("y"),
    )
    assert tuple(df.first()) == ("a\n\nb", "No extra constraints.")


def test_scratch_tables_are_cleared(spark):
    from lossloom.plans import workspace

    path = workspace.scratch_table(spark, "x")
    spark.range(3).write.parquet(path)
    assert workspace.path_exists(spark, path) and workspace.clear_scratch(spark) >= 1
    assert not workspace.path_exists(spark, path)
