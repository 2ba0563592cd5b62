"""Toxicity score from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones, digits and signs that stand for
letters to those letters. The lexicon's terms are whole words and word beginnings; their weights are learned from labelled
documents. One Aho-Corasick pass finds all terms and all exception phrases; a match inside an exception phrase does not
count, and of the terms in one word only the heaviest does. The sum of weights is divided by the number of words and turned
into a score by a logistic curve, also learned from the labelled documents.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.llm.common import byte_batches, stage, text_or_empty

#: Look-alike letters of other scripts, and the Latin letters they stand for.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ӏ": "l", "м": "m", "т": "t", "к": "k", "н": "h", "в": "b",
    "α": "a", "ο": "o", "ε": "e", "ι": "i", "ρ": "p", "ν": "v", "κ": "k", "τ": "t", "υ": "u", "ω": "w", "ı": "i",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
#: Digits and signs used for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "sore loser", "garbage collection", "crossword idiot")

_FAR_SIGNS = re.compile("[" + "".join(re.escape(c) for c in LOOK_ALIKES) + "]")
_LEET_BYTES = bytes.maketrans("".join(LEET).encode(), "".join(LEET.values()).encode())
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
SHORTEST, LONGEST = 4, 8  # word beginnings that can be terms


def fold(text: str) -> bytes:
    """The folded text in UTF-8."""
    text = text.lower()
    if not text.isascii() and _FAR_SIGNS.search(text):
        text = _FAR_SIGNS.sub(lambda m: LOOK_ALIKES[m.group()], text)
    return text.encode("utf-8", "replace").translate(_LEET_BYTES)


def forms(word: bytes) -> list[bytes]:
    """What can be a term for a word: its beginnings, and the whole word, marked by a closing blank."""
    return [word + b" ", *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


class Lexicon:
    """Terms with weights, exception phrases, and the logistic curve; ``score`` needs nothing else."""

    def __init__(self, weights: dict[bytes, float], curve: tuple[float, ...] = (0.0, 1.0, 0.0), exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.curve, self.exceptions = weights, curve, tuple(exceptions)
        self.automaton = None

    def _build(self):
        import ahocorasick

        entries: dict[bytes, list] = {}  # body: weight as a beginning, weight as a whole word, exception
        for phrase in self.exceptions:
            entries.setdefault(fold(phrase), [0.0, 0.0, False])[2] = True
        for term, weight in self.weights.items():
            entries.setdefault(term.rstrip(b" "), [0.0, 0.0, False])[term.endswith(b" ")] = weight
        self.automaton = ahocorasick.Automaton()
        for body, entry in entries.items():
            self.automaton.add_word(body.decode("latin-1"), (len(body), *entry))
        self.automaton.make_automaton()

    def density(self, text: str) -> tuple[float, int]:
        """Weight of the terms per word, and the number of words."""
        if self.automaton is None:
            self._build()
        folded = fold(text)
        n = len(_WORD.findall(folded))
        view, best, spared = folded.decode("latin-1"), {}, []
        for last, (size, beginning, whole, exception) in self.automaton.iter(view) if len(self.automaton) else ():
            start = last + 1 - size
            if start and _is_word(folded[start - 1]):
                continue
            ended = last + 1 == len(folded) or not _is_word(folded[last + 1])
            if exception and ended:
                spared.append((start, last + 1))
            weight = max(beginning, whole) if ended else beginning
            if weight > best.get(start, 0.0):
                best[start] = weight
        return _outside(best, spared) / (n + 20), n

    def score(self, text: str) -> float:
        x = self.density(text)[0]
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x + c * math.sqrt(x)))))

    def to_json(self) -> str:
        return json.dumps({"weights": {k.decode("latin-1"): v for k, v in self.weights.items()}, "curve": self.curve, "exceptions": self.exceptions})

    @staticmethod
    def from_json(text: str) -> "Lexicon":
        data = json.loads(text)
        return Lexicon({k.encode("latin-1"): v for k, v in data["weights"].items()}, tuple(data["curve"]), tuple(data["exceptions"]))


def _outside(best: dict[int, float], spared: list[tuple[int, int]]) -> float:
    """Weight of the terms that begin outside all spared spans: one sweep over both, in order."""
    total, end, k = 0.0, 0, 0
    spared = sorted(spared)
    for at in sorted(best):
        while k < len(spared) and spared[k][0] <= at:
            end, k = max(end, spared[k][1]), k + 1
        if at >= end:
            total += best[at]
    return total


def _is_word(byte: int) -> bool:
    return byte >= 128 or 97 <= byte <= 122 or 48 <= byte <= 57


def learn(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 4_000, least_docs: int = 5, least_weight: float = 3.5
) -> Lexicon:
    """Learn a lexicon from docs (doc_id, text) and labels (doc_id, toxic 0/1).

    About ``max_rows`` labelled doc_ids, chosen by a hash, are used, each with all its different texts (of several labels for one
    the larger counts); of the terms found in ``least_docs`` toxic documents with
    a log-odds of ``least_weight`` the ``max_terms`` weightiest are kept. Null labels and doc_ids are left out; without both
    kinds of rows the lexicon is empty and every score is the share of toxic rows.
    """
    import pandas as pd

    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stage(known, "labels")
    share = max_rows / max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30))))
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").distinct()  # about max_rows doc_ids
    rows = stage(rows.select("text", "toxic"), "labelled").repartition(64)
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        share = (bad + 0.5) / (bad + good + 1)
        return Lexicon({}, (math.log(share / (1 - share)), 0.0, 0.0))

    def count(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text"):
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update({f for w in set(_WORD.findall(fold(text))) for f in forms(w)})
            terms = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(terms, pa.binary()), *(pa.array([counts[k][t] for t in terms], pa.int64()) for k in (0, 1))]
            yield pa.record_batch(columns, ["term", "good", "bad"])

    terms = rows.mapInArrow(count, "term binary, good long, bad long").groupBy("term").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    terms = terms.where(F.col("bad") >= least_docs).withColumn("weight", weight).where(F.col("weight") >= least_weight)
    kept = terms.orderBy(F.desc(F.col("bad") * F.col("weight")), "term").limit(max_terms).collect()  # the model, max_terms rows
    lexicon = Lexicon({bytes(r["term"]): r["weight"] for r in kept})

    def densities(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text"):
            x = [lexicon.density(t)[0] for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    lexicon.automaton = None
    binned = rows.mapInArrow(densities, "x double, toxic int").groupBy(F.round("x", 4).alias("x"), "toxic").agg(F.count("*").alias("n"))
    sample = pd.DataFrame([r.asDict() for r in binned.collect()])  # at most max_rows rows
    lexicon.curve = _curve(sample["x"].to_numpy(float), sample["toxic"].to_numpy(float), sample["n"].to_numpy(float))
    return lexicon


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression on the density and its square root by Newton's method."""
    columns = np.column_stack([np.ones_like(x), x, np.sqrt(x)])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(columns @ beta, -30, 30)))
        slope = columns.T @ (n * (y - p)) - ridge * beta
        curve = (columns * (n * p * (1 - p))[:, None]).T @ columns + ridge * np.eye(3)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs (doc_id, text); null texts count as empty, other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon.to_json())  # at most max_terms terms

    def rows(batches):
        import pyarrow as pa

        own = Lexicon.from_json(held.value)
        for batch in byte_batches(batches, "text"):
            yield pa.record_batch([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return named.mapInArrow(rows, "doc_id long, score double")
