"""Loss of a sample: mean negative log-probability of its answer tokens.

Prompt tokens are context only. Prompt and answer together are cut at ``max_length`` tokens, as the
student would see them; a sample without answer tokens has no loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossloom.functions import text as tx
from lossloom.params import DEFAULTS, Params
from lossloom.plans.workspace import deal, stage_table

# A key holding more than this share of the rows is looked up by broadcast. Shares sum to one, so
# there can be no more than 1 / HOT_SHARE such keys. Keys of few characters may be a hundred times as many in the same memory.
HOT_SHARE = 1 / 2000
SHORT_HOT_SHARE = HOT_SHARE / 100
SHORT_KEY = 64
BIGRAM_WEIGHT = 0.7


def token_budget(df: DataFrame, p: Params = DEFAULTS, tokenize: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """Add token counts of prompt and answer within the length limit, and whether the limit cut them.

    ``tokenize`` maps a text column to an array of tokens; it may wrap a pandas UDF.
    """
    prompt, answer = tokenize(tx.sample_prompt("sample", "instruct")), tokenize(tx.strip(F.coalesce("gold_summary", F.lit(""))))
    total = F.least(F.lit(p.max_length), F.col("prompt_tokens") + F.col("gold_tokens"))
    return (
        df.withColumns({"prompt_tokens": F.size(prompt), "gold_tokens": F.size(answer)})
        .withColumn("token_length", total)
        .withColumn("truncated", F.col("prompt_tokens") + F.col("gold_tokens") > p.max_length)
        .withColumn(
            "answer_tokens",
            F.greatest(F.lit(0), F.col("token_length") - F.least(F.col("prompt_tokens"), F.lit(p.max_length))),
        )
    )


def fit_ngram(corpus: DataFrame, text: str, tokenize: Callable[[Column], Column] = tx.tokens) -> dict[str, DataFrame]:
    """Unigram and bigram tables of a corpus as probabilities, and the counts that the bigrams are made of.

    Counting is a partial aggregate: a frequent token shuffles one row per task, not one per use.
    """
    toks = deal(corpus.select(text)).select(tokenize(F.lower(F.col(text))).alias("t")).where(F.size("t") > 0)
    # Everything else follows from the bigram counts, which are far smaller than the text and written once.
    bigrams = stage_table(toks.select(_pairs(F.lit(""), F.col("t"))).toDF("prev", "token").groupBy("prev", "token").agg(F.count("*").alias("n")), "bigrams")
    unigrams = stage_table(bigrams.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "unigrams")
    starts = stage_table(bigrams.groupBy("prev").agg(F.sum("n").alias("prev_n"), F.count("*").alias("rows")), "starts")
    joined = _lookup(bigrams, starts, ["prev"], "prev_n", starts)
    return {
        "totals": unigrams.agg(F.sum("n").alias("total"), F.count("*").alias("vocab")),
        "unigrams": unigrams.select("token", "n"),
        "bigrams": joined.select("prev", "token", "n", (F.col("n") / F.col("prev_n")).alias("p2")),
        "counts": bigrams,
        "starts": starts.select("prev", "prev_n"),
    }


def _pairs(before: Column, tokens: Column) -> Column:
    """One row ``prev, token`` per token; ``before`` stands before the first."""
    prev = F.slice(F.concat(F.array(before), tokens), F.lit(1), F.size(tokens))
    return F.inline(F.arrays_zip(prev.alias("prev"), tokens.alias("token")))


def hot_keys(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``counts`` (``keys`` and ``rows``, a written table) that enough of the rows hold to be broadcast."""
    total = counts.agg(F.sum("rows")).first()[0] or 0  # a single number
    length = reduce(lambda x, y: x + y, [F.length(k) for k in keys])
    hot = F.when(length <= SHORT_KEY, total * SHORT_HOT_SHARE).otherwise(total * HOT_SHARE)
    return counts.where(F.col("rows") > hot).select(*keys)


def _lookup(rows: DataFrame, table: DataFrame, keys: list[str], value: str, counts: DataFrame) -> DataFrame:
    """Left join on ``keys`` that keeps keys that many of the rows share out of the shuffle.

    ``counts`` (``keys`` and ``rows``, how many rows hold them) must be a written table. Keys that more than ``HOT_SHARE`` of the
    rows hold (short ones: ``SHORT_HOT_SHARE``) are bounded in number; their values are broadcast, present or not. Of the other
    rows each key's are few.
    """
    hot = F.broadcast(hot_keys(counts, keys).join(table.select(*keys, value), keys, "left"))
    named = hot.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_hot"), F.lit(True).alias("_is_hot"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    marked = rows.join(F.broadcast(named), reduce(lambda x, y: x & y, same), "left").drop(*(f"_{k}" for k in keys))
    known = marked.where("_is_hot").withColumn(value, F.col("_hot"))
    rest = marked.where("_is_hot is null").join(table.select(*keys, value), keys, "left")
    columns = [*rows.columns, value]
    return known.select(columns).unionByName(rest.select(columns))


def answer_tokens(df: DataFrame, row_id: str, p: Params = DEFAULTS, tokenize: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """Per row the answer tokens inside the length limit and the prompt token before them: ``row_id, before, tokens``."""
    prompt = tokenize(F.lower(tx.sample_prompt("sample", "instruct")))
    answer = tokenize(F.lower(tx.strip(F.coalesce("gold_summary", F.lit("")))))
    seen = df.select(F.col(row_id).alias("row_id"), prompt.alias("_p"), answer.alias("_a"))
    room = F.greatest(F.lit(0), F.lit(p.max_length) - F.size("_p"))
    return seen.select("row_id", F.get("_p", F.size("_p") - 1).alias("before"), F.slice("_a", F.lit(1), room).alias("tokens"))


def answer_token_rows(answers: DataFrame) -> DataFrame:
    """One row per answer token: ``row_id, prev, token``."""
    return answers.select("row_id", _pairs(F.col("before"), F.col("tokens"))).toDF("row_id", "prev", "token")


def score_loss(
    samples: DataFrame, model: dict[str, DataFrame], row_id: str = "row_id", p: Params = DEFAULTS,
    tokenize: Callable[[Column], Column] = tx.tokens,
) -> DataFrame:
    """Loss per sample under an interpolated bigram model; null when no answer token is left.

    The model is asked once for each pair of tokens that occurs, with how often it does. Frequent pairs are then broadcast to
    the token rows; only the rows of the others are shuffled, once. A row's tokens stay an array until then.
    """
    totals = model["totals"].first()  # two numbers
    samples = deal(samples)
    answers = stage_table(answer_tokens(samples, row_id, p, tokenize), "answers")
    rows = answer_token_rows(answers).withColumn("prev", F.coalesce("prev", F.lit("\0")))
    pairs = stage_table(rows.groupBy("prev", "token").agg(F.count("*").alias("rows")), "pairs")
    tokens = stage_table(pairs.groupBy("token").agg(F.count("*").alias("rows")), "pair-tokens")
    if "starts" in model:  # only the pairs that occur need a share, not all of the corpus
        prevs = stage_table(pairs.groupBy("prev").agg(F.count("*").alias("rows")), "pair-starts")
        seen = stage_table(pairs.join(model["counts"].select("prev", "token", "n"), ["prev", "token"], "left"), "pair-counts")
        seen = _lookup(seen, model["starts"], ["prev"], "prev_n", prevs).withColumn("p2", F.col("n") / F.col("prev_n"))
    else:
        seen = pairs.join(model["bigrams"].select("prev", "token", "p2"), ["prev", "token"], "left")
    seen = _lookup(seen, model["unigrams"].withColumnRenamed("n", "uni_n"), ["token"], "uni_n", tokens)
    single = (F.coalesce("uni_n", F.lit(0)) + 1) / F.lit((totals["total"] or 0) + totals["vocab"] + 1)
    prob = F.lit(BIGRAM_WEIGHT) * F.coalesce("p2", F.lit(0.0)) + F.lit(1 - BIGRAM_WEIGHT) * single
    losses = stage_table(seen.select("prev", "token", "rows", (-F.log(prob)).alias("_loss")), "pair-losses")
    told = _lookup(rows, losses, ["prev", "token"], "_loss", losses)
    scored = (
        told.groupBy("row_id")
        .agg(F.avg("_loss").alias("loss"), F.count("*").alias("scored_tokens"))
        .withColumnRenamed("row_id", row_id)
    )
    return token_budget(samples, p, tokenize).join(scored, row_id, "left")


def score_with_model(
    samples: DataFrame, score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], loss: str = "loss"
) -> DataFrame:
    """Loss from a user's model, batch by batch; the model adds the loss column to each frame."""
    schema = T.StructType([f for f in samples.schema if f.name != loss]).add(loss, "double")
    return samples.mapInPandas(score, schema)
