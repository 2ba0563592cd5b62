"""Example files in JSON, and steps that several queries share."""

import json

from pyspark.sql import functions as F

from lossloom.functions import shape
from lossloom.functions import text as tx
from lossloom.operators import examples, reports, score
from lossloom.plans import workspace


def test_example_json_files(spark, tmp_path):
    whole = [
        {"sample": " a ", "output": "b"},
        {"question": "q", "input": "c", "gold_summary": "d"},
    ]
    texts = {
        "list": json.dumps(whole), "object": json.dumps(whole[0]), "named": json.dumps({"examples": whole[1:]}),
        "void": json.dumps([*whole, {"sample": "x"}]), "broken": "[", "empty": "[]",
        "template": json.dumps([{"sample": "Write the source text here.", "output": "b"}]),
    }
    files = spark.createDataFrame([(k, "kept", v) for k, v in texts.items()], "file string, other string, value string")
    plain, contextual = ("a", "b", None, None, "plain"), ("c", "d", "q", "c", "contextual")
    found = examples.parse_examples_json(files)
    assert found.columns == ["file", "other", "pos", "sample", "output", "instruct", "context", "mode"]
    got = {(r.file, r.pos): (r.sample, r.output, r.instruct, r.context, r.mode) for r in found.collect()}
    assert got == {("list", 0): plain, ("list", 1): contextual, ("object", 0): plain, ("named", 0): contextual}

    from lossloom.sources import files as fl

    (tmp_path / "a.json").write_text(texts["list"])
    read = fl.read_examples_json(spark, f"{tmp_path}/*.json").select("pos", "sample", "output", "instruct", "context", "mode")
    assert sorted(tuple(r) for r in read.collect()) == [(0, *plain), (1, *contextual)]


def test_white_space_in_one_pass(spark):
    odd = ["", " ", "a", " a b ", " a\x0b\x1cb ", "x\n\ny\r\n", "\x85", "é  ü", "a\U0001F600 ", None, " ".join(["w"] * 44), "\t" + "\x1f ".join(["w"] * 45), "w " * 46]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, s string")
    old = F.regexp_replace("s", rf"\A{tx.SPACE}+|{tx.SPACE}+\z", "")
    squeezed = tx.squeeze(F.coalesce("s", F.lit("")))
    split = F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.split(squeezed, " "))
    for r in df.select("*", tx.strip("s").alias("a"), old.alias("b"), tx.tokens("s").alias("c"), split.alias("d"), tx.has_words("s", 45).alias("e"), (tx.word_count("s") >= 45).alias("f")).collect():
        assert (r.a, r.c, r.e) == (r.b, r.d, r.f), r


def test_classified_records_are_read_once(spark):
    rows = [(k, f"s{k % 3}", t, float(k)) for k, t in enumerate(["Classify and rank the table", "Why is it so?", "Context: a. Which fact?", "plain words", "image prompt with logo"] * 6)]
    df = spark.createDataFrame(rows, "record_id long, section_id string, instruct string, loss double")
    once = shape.shaped_records(df, "record_id", "section_id", "loss")
    assert once.columns == ["record_id", "section_id", "loss", "shape_id", "evidence"]
    assert "instruct" not in once._jdf.queryExecution().toString()
    asked = dict(pos="record_id", source="x")
    names = ["section_id", "shape_id", "record_count", "confidence", "evidence", "focus_tag"]
    profile = lambda f, **more: sorted(map(tuple, shape.shape_profile(f, "section_id", **asked, **more).select(*names).collect()))
    assert profile(once, classified=True) == profile(df)
    weak = lambda f, **more: sorted(map(tuple, reports.validation_weakness(f, **more).select("section_id", "rank", "shape_id", "avg_loss", "n").collect()))
    assert weak(once, classified=True) == weak(df)


def test_rows_of_one_split_are_dealt(spark):
    df = spark.range(0, 1000, 1, 1)
    dealt = workspace.deal(df)
    assert dealt.rdd.getNumPartitions() > 1 and sorted(r.id for r in dealt.collect()) == list(range(1000))


def test_pairs_of_tokens(spark):
    corpus = spark.createDataFrame([("a b  A",), (" ",), (None,), ("b",)], "text string")
    got = {(r.prev, r.token): (r.n, r.p2) for r in score.fit_ngram(corpus, "text")["bigrams"].collect()}
    assert got == {("", "a"): (1, 0.5), ("", "b"): (1, 0.5), ("a", "b"): (1, 1.0), ("b", "a"): (1, 1.0)}
    answers = spark.createDataFrame([(1, "p", ["x", "y"]), (2, None, []), (3, None, ["z"]), (4, "q", None)], "row_id int, before string, tokens array<string>")
    assert sorted(map(tuple, score.answer_token_rows(answers).collect()), key=str) == [(1, "p", "x"), (1, "x", "y"), (3, None, "z")]


def test_scores_from_counts_and_from_shares(spark):
    corpus = spark.createDataFrame([("a b a c",), ("b a d",), ("a b",)], "text string")
    model = score.fit_ngram(corpus, "text")
    plain = {k: model[k] for k in ("totals", "unigrams", "bigrams")}
    rows = [(1, "", "a", "a b x"), (2, "a", "b", "a c a"), (3, "", "q", None), (None, "", "a", "b"), (2, "", "z", "a")]
    samples = spark.createDataFrame(rows, "row_id int, sample string, instruct string, gold_summary string")
    got = [sorted(((r.row_id, r.gold_summary, r.token_length, r.loss and round(r.loss, 9), r.scored_tokens) for r in score.score_loss(samples, m).collect()), key=str) for m in (model, plain)]
    assert got[0] == got[1] and len(got[0]) == 5 and sum(r[3] is not None for r in got[0]) == 3


def test_keys_looked_up_by_broadcast(spark):
    long = "y" * 65
    counts = spark.range(3000).selectExpr("concat('x', id) AS prev", "2L AS rows").unionByName(
        spark.createDataFrame([(long, 2), (long + "z", 2000), (None, 1)], "prev string, rows long"))
    hot = {r.prev for r in score.hot_keys(counts, ["prev"]).collect()}
    assert hot == {f"x{k}" for k in range(3000)} | {long + "z"}  # of 8,003 rows a short key needs one, a long one five
    rows = spark.createDataFrame([("x1", 1), ("x1", 2), (long, 3), (long + "z", 4), (None, 5), ("new", 6)], "prev string, i int")
    table = counts.where("prev <> 'x1'").withColumnRenamed("rows", "value")
    got = sorted((r.i, r.prev, r.value) for r in score._lookup(rows, table, ["prev"], "value", counts).collect())
    assert got == [(1, "x1", None), (2, "x1", None), (3, long, 2), (4, long + "z", 2000), (5, None, None), (6, "new", None)]
