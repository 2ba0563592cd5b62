"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. How often each vote occurs among good and bad
documents is estimated by expectation-maximisation over the counts of vote patterns of the whole corpus; there are at most
3 ** labellers patterns, whatever the number of documents. The posterior of a document's pattern is its label for a linear
scorer over hashed features, which is fitted on a bounded sample and then scores all documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossloom.llm.common import byte_batches, byte_column, text_or_empty
from lossloom.llm.shingles import word_hashes

#: (statistic, a share up to which the vote is good, a share from which it is bad); between them there is no vote.
LABELLERS = (
    ("symbol_words", 0.02, 0.15),
    ("upper_words", 0.05, 0.35),
    ("same_neighbours", 0.03, 0.15),
    ("repeated_words", 0.45, 0.65),
    ("bar_words", 0.02, 0.15),
    ("other_signs", 0.06, 0.11),
    ("repeated_lines", 0.35, 0.70),
    ("empty", 0.0, 1.0),
)
FEWEST = 8  # below this number of words only the last labeller votes
BUCKETS = 1 << 11
_KINDS = np.full(256, 1, np.uint8)  # 0 blank, 1 lower or other letter, 2 upper case, 3 digit, then signs
_KINDS[65:91], _KINDS[48:58], _KINDS[[32, *range(9, 14)]] = 2, 3, 0
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_KINDS[_SIGNS] = 4 + np.arange(len(_SIGNS)) % 32
_HEAVY = np.zeros(256, bool)
_HEAVY[[b for b in _SIGNS if chr(b) not in ".,;:'\"()-?"]] = True


def _shares(values: np.ndarray, bounds: np.ndarray, totals: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(totals, 1)


def statistics(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the shares that the labellers look at, in their order, and the number of words."""
    hashes, first, last, counts = word_hashes(raw, at)
    n = np.diff(counts)
    size = last - first
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90), dtype=np.int64)])
    lower = np.concatenate([[0], np.cumsum(((raw >= 97) & (raw <= 122)) | (raw >= 0xC3), dtype=np.int64)])
    ups, lows = (c[last] - c[first] if len(first) else np.zeros(0, np.int64) for c in (upper, lower))
    closing, before = raw[last - 1], raw[np.maximum(last - 2, 0)]
    symbol = _HEAVY[closing] & (size > 2) & _HEAVY[before]
    row = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    again = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    repeated = _shares(again, counts, n)
    # long texts repeat words as a matter of course: the share is measured against what a text of this length may have
    repeated = np.maximum(0, repeated - 0.06 * np.maximum(0, np.log2(np.maximum(n, 1) / 256)))
    signs = _shares((_KINDS[raw] >= 4), at, np.diff(at))
    bars = (raw[first] == 124) & (size == 1) if len(first) else np.zeros(0, bool)
    columns = [
        _shares(symbol, counts, n), _shares((ups >= 2) & (lows == 0), counts, n), _shares(same, counts, n), repeated,
        _shares(bars, counts, n), signs, _repeated_lines(raw, at), (n == 0).astype(float),
    ]
    return np.column_stack(columns), n


def _repeated_lines(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of lines that stood in the same text before."""
    signs = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64)
    signs[10] = 0
    hashes, _, _, counts = word_hashes(raw, at, signs)
    row = np.repeat(np.arange(len(at) - 1), np.diff(counts))
    order = np.lexsort((hashes, row))
    again = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    return _shares(again, counts, np.diff(counts))


def votes(shares: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0 no vote, 1 good, 2 bad, for each row and labeller."""
    good = np.array([g for _, g, _ in LABELLERS])
    bad = np.array([b for _, _, b in LABELLERS])
    out = np.where(shares >= bad, 2, np.where(shares <= good, 1, 0))
    out[words < FEWEST, :-1] = 0
    return out


def pattern(vote: np.ndarray) -> np.ndarray:
    return vote @ (3 ** np.arange(len(LABELLERS)))


@dataclass
class LabelModel:
    """Shares of the classes, and how often each labeller gives each vote in each class.

    Class 0 is good; class k is the defect that labeller k looks for, as documents with different defects draw different
    votes. Accuracies of a labeller are its rates in class 0 and, weighted by the shares, in the others.
    """

    shares: np.ndarray  # class
    rates: np.ndarray  # labeller, class, vote

    def classes(self, vote: np.ndarray) -> np.ndarray:
        """Probability of each class for rows of votes; abstentions say nothing."""
        logs = np.log(self.shares)[None, :].repeat(len(vote), 0)
        for k in range(vote.shape[1]):
            logs += np.where(vote[:, k, None] > 0, np.log(self.rates[k][:, vote[:, k]].T), 0)
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability of good."""
        return self.classes(vote)[:, 0]

    def accuracies(self) -> np.ndarray:
        """For each labeller the rate of good votes on good documents and of bad votes on bad ones."""
        bad = self.shares[1:] / self.shares[1:].sum()
        return np.column_stack([self.rates[:, 0, 1], self.rates[:, 1:, 2] @ bad])


def prior() -> LabelModel:
    """What is taken to hold before anything is counted: labellers are hardly ever wrong about good documents, see most of
    their own defect and a few of the others."""
    n = len(LABELLERS)
    bad = np.full((n, n + 1), 0.1)
    bad[:, 0] = 0.005
    bad[np.arange(n), np.arange(n) + 1] = 0.8
    shares = np.concatenate([[0.8], np.full(n, 0.2 / n)])
    return LabelModel(shares, np.stack([np.ones_like(bad), 1 - bad, bad], axis=2))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, strength: float = 0.01) -> LabelModel:
    """Expectation-maximisation over pattern counts, begun at ``prior``, which also counts as a share ``strength`` of all rows."""
    vote = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    first = model = prior()
    total = max(1, counts.sum())
    for _ in range(rounds):
        weight = model.classes(vote) * counts[:, None]
        rates = np.ones_like(model.rates)
        for k in range(len(LABELLERS)):
            seen = np.stack([weight[vote[:, k] == v].sum(axis=0) for v in (1, 2)], axis=1)
            seen = seen + strength * total * first.shares[:, None] * first.rates[k, :, 1:]
            rates[k, :, 1:] = seen / seen.sum(axis=1, keepdims=True)
        shares = weight.sum(axis=0) + strength * total * first.shares
        change = np.abs(rates - model.rates).max()
        model = LabelModel(shares / shares.sum(), rates)
        if change < 1e-7:
            break
    return model


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


_TRIPLES = np.array([zlib.crc32(k.to_bytes(4, "little")) % BUCKETS for k in range(36**3)], np.int32)
_STEPS = np.array([0.0, 1e-9, 0.01, 0.02, 0.05, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 1.01])
_BINS = np.array([[_bucket(f"{name}:{k}") for k in range(len(_STEPS))] for name, _, _ in LABELLERS])


def triples(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of three byte kinds inside rows, and the rows' bounds in them."""
    kinds = _KINDS[raw].astype(np.int32)
    if len(kinds) < 3:
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    found = _TRIPLES[kinds[:-2] * 1296 + kinds[1:-1] * 36 + kinds[2:]]
    ends = np.repeat(at[1:], np.diff(at))[: len(found)]
    inside = np.arange(len(found)) + 3 <= ends
    bounds = np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - 2, 0))])
    return found[inside], bounds


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Dense rows of hashed features: shares of the triples, and one bucket for the step of each statistic."""
    shares, _ = statistics(raw, at)
    found, bounds = triples(raw, at)
    out = np.zeros((len(at) - 1, BUCKETS), np.float32)
    for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b > a:
            out[row] = np.bincount(found[a:b], minlength=BUCKETS) / (b - a)
    steps = np.searchsorted(_STEPS, shares, side="right") - 1
    for k in range(len(LABELLERS)):
        out[np.arange(len(out)), _BINS[k][steps[:, k]]] += 1
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of good for every row; 0 for rows without words."""
        shares, words = statistics(raw, at)
        found, bounds = triples(raw, at)
        sums = np.concatenate([[0], np.cumsum(self.weights[found], dtype=np.float64)])
        z = self.bias + (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
        steps = np.searchsorted(_STEPS, shares, side="right") - 1
        for k in range(len(LABELLERS)):
            z += self.weights[_BINS[k][steps[:, k]]]
        return np.where(words > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def fit_scorer(x: np.ndarray, good: np.ndarray, counts: np.ndarray | None = None, rounds: int = 2000, ridge: float = 1e-6) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient steps; buckets that no row has keep weight 0.

    ``counts`` says how many rows each row stands for.
    """
    share = np.ones(len(x)) if counts is None else counts
    share = (share / max(1, share.sum())).astype(np.float32)
    used = np.flatnonzero(x.any(axis=0)) if len(x) else np.zeros(0, np.int64)
    x, good = np.ascontiguousarray(x[:, used], np.float32), good.astype(np.float32)
    weights, bias = np.zeros(len(used), np.float32), 0.0
    speed, bias_speed, step = np.zeros_like(weights), 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ (weights + 0.9 * speed) + (bias + 0.9 * bias_speed), -50, 50)))
        error = ((good - p) * share).astype(np.float32)
        speed = (0.9 * speed + step * (error @ x - ridge * weights)).astype(np.float32)
        bias_speed = 0.9 * bias_speed + step * float(error.sum())
        weights, bias = weights + speed, bias + bias_speed
    out = np.zeros(BUCKETS)
    out[used] = weights
    return Scorer(out, bias)


@dataclass
class Quality:
    labels: LabelModel
    scorer: Scorer


def learn(docs: DataFrame, max_rows: int = 4_000) -> Quality:
    """Label model over all rows of docs (text) and a scorer fitted on about ``max_rows`` distinct texts.

    These are chosen by a hash of the text and weigh as much as they have copies, so ``max_rows`` holds whatever is copied.
    """
    texts = docs.select(text_or_empty().alias("text"))

    def count(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text", 1_000_000):
            found, n = np.unique(pattern(votes(*statistics(*byte_column(batch, "text")))), return_counts=True)
            yield pa.record_batch([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["pattern", "n"])

    counted = texts.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # <= 3 ** labellers
    found = np.array(sorted((r["pattern"], r["n"]) for r in counted), np.int64).reshape(-1, 2)
    model = fit_labels(found[:, 0], found[:, 1])
    total = int(found[:, 1].sum())

    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, max_rows / max(1, total)) * (1 << 30)))
    chosen = chosen.groupBy("text").agg(F.count("*").alias("n"))  # copies are counted before the shuffle

    def sample(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text", 1_000_000):
            raw, at = byte_column(batch, "text")
            good = model.posterior(votes(*statistics(raw, at)))
            rows = [r.tobytes() for r in features(raw, at).astype(np.float16)]
            yield pa.record_batch([pa.array(rows, pa.binary()), pa.array(good, pa.float64()), batch.column(1)], ["x", "good", "n"])

    rows = chosen.mapInArrow(sample, "x binary, good double, n long").collect()  # about max_rows rows of 2 * BUCKETS bytes
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(-1, BUCKETS)
    return Quality(model, fit_scorer(x, np.array([r["good"] for r in rows]), np.array([r["n"] for r in rows], float)))


def _scored(texts: DataFrame, quality: Quality, name: str, schema: str, filtered: float | None = None) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast((quality.scorer.weights, quality.scorer.bias))  # BUCKETS numbers

    def rows(batches):
        import pyarrow as pa

        scorer = Scorer(*held.value)
        for batch in byte_batches(batches, "text", 1_000_000):
            score = scorer.score(*byte_column(batch, "text"))
            if filtered is not None:
                yield batch.filter(pa.array(score >= filtered))
            else:
                yield pa.record_batch([batch.column(0), pa.array(score)], ["doc_id", name])

    return texts.mapInArrow(rows, schema)


def score(docs: DataFrame, quality: Quality, least: float = 0.5) -> DataFrame:
    """doc_id, score (0 bad to 1 good) and keep of every row of docs (doc_id, text).

    Rows without words (null, empty or blank texts) have score 0; null and repeated doc_ids stay as they are; other columns
    are ignored.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keep: Column = F.col("score") >= least
    return _scored(named, quality, "score", "doc_id long, score double").withColumn("keep", keep)


def keep_good(docs: DataFrame, quality: Quality, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that the scorer keeps."""
    return _scored(docs, quality, "score", docs.schema, least)
