"""Benchmark passages in documents, found with spaced seeds.

A seed is a fixed mask over consecutive words: only the places marked 1 are hashed, so a substituted word at another place
does not hide a match. Any 12 aligned words of which at most two differ share at least ``MIN_HITS`` seeds of the masks below
(enumerated in the tests). A shorter item has masks over its whole length, cut into blocks of which a mask leaves out as many
as words may be changed: one of them fits whatever the places (an item without room for a change has one full mask). They
are only tried where the benchmark has items of that length.

The hashes of the benchmark set the bits of a filter whose size follows their number, up to ``MOST_BITS``, and which is
broadcast; documents' hashes that pass it are joined to the benchmark's, hits are counted by document, item and diagonal,
and the words around the diagonals with enough hits are compared: a passage is the longest run of at least ``min_words``
aligned words of which at least ``percent`` in 100 are equal, or the whole of a shorter item under the same condition.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.llm.common import byte_batches, byte_column, free_name, stage, text_or_empty
from lossloom.llm.shingles import _WORD_SIGN, mix, word_hashes

MASKS = ("11111", "111101", "1101011", "11011001")
MIN_HITS = 2  # hits of a long item; a short one has one mask that must hit
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30  # of the filter, 128 MB at most; beyond that it lets more through, which the join drops
MOST_KEYS = 1_000_000  # documents with candidates that are broadcast (16 bytes each); more are shuffled
_SIGNS = _WORD_SIGN.copy()
_SIGNS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0  # ASCII punctuation is no part of a word
_SEED = np.random.Generator(np.random.PCG64(4711))
_AT_PLACE = _SEED.integers(0, 1 << 64, 16, np.uint64, endpoint=False) | np.uint64(1)
_OF_MASK = _SEED.integers(0, 1 << 64, 16, np.uint64, endpoint=False)


def short_masks(words: int, percent: int) -> tuple[str, ...]:
    """Masks over whole items of so few words: whichever words are changed, one mask reads none of them."""
    changed = words * (100 - percent) // 100
    parts = min(words, changed + 2) if changed else 1
    if not changed or parts <= changed:
        return ("1" * words,)
    cuts = [words * k // parts for k in range(parts + 1)]
    masks = []
    for left_out in combinations(range(parts), changed):
        masks.append("".join("0" if k in left_out else "1" for k in range(parts) for _ in range(cuts[k], cuts[k + 1])))
    return tuple(masks)


def _sign_of(mask: str) -> np.uint64:
    return _OF_MASK[MASKS.index(mask)] if mask in MASKS else mix(np.array([int("1" + mask, 2)], np.uint64))[0]


def seed_hashes(hashes: np.ndarray, counts: np.ndarray, masks: tuple[str, ...] = MASKS):
    """For each mask: word positions (over all rows) where it fits into a row, and the hashes there."""
    row_end = np.repeat(counts[1:], np.diff(counts))
    for mask in masks:
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            continue
        fits = np.flatnonzero(np.arange(n) + len(mask) <= row_end[:n])
        places = [k for k, sign in enumerate(mask) if sign == "1"]
        total = sum(hashes[k : k + n] * _AT_PLACE[j % len(_AT_PLACE)] for j, k in enumerate(places)) + _sign_of(mask)
        yield fits, mix(total[fits])


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(size - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) & low).astype(np.int64)


def _item_seeds(items: DataFrame, min_words: int, percent: int) -> DataFrame:
    """hash, item (key), item_at (word), needs (hits that make a diagonal a candidate) and words (of a short item) of every seed."""

    def rows(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text", 1_000_000):
            hashes, _, _, counts = word_hashes(*byte_column(batch, "text"), _SIGNS)
            sizes = np.diff(counts)
            for length in sorted({0, *sizes[sizes < min_words].tolist()}):  # 0: the long items
                own = sizes >= min_words if not length else sizes == length
                if not own.any():
                    continue
                for at, seeds in seed_hashes(hashes, counts, short_masks(length, percent) if length else MASKS):
                    row = np.searchsorted(counts, at, side="right") - 1
                    kept = own[row]
                    row, at, seeds = row[kept], at[kept], seeds[kept]
                    n = len(row)
                    columns = [
                        pa.array(seeds.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at - counts[row]),
                        pa.array(np.full(n, 1 if length else MIN_HITS)), pa.array(np.full(n, length)),
                    ]
                    yield pa.record_batch(columns, ["hash", "item", "item_at", "needs", "words"])

    return items.mapInArrow(rows, "hash long, item long, item_at long, needs long, words long")


def _filter_bits(seeds: DataFrame, size: int) -> np.ndarray:
    """The benchmark's filter: two bits for each hash, ``size`` in all, put together by an aggregate."""
    low = F.lit(size - 1)
    both = F.array(F.col("hash").bitwiseAND(low) + 1, F.shiftrightunsigned("hash", 32).bitwiseAND(low) + 1)
    bit = seeds.select(F.explode(both).alias("bit"))
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for row in parts.collect():  # at most size / 32768 rows of 4 KB
        out[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _hits(docs: DataFrame, held, masks: tuple[str, ...]) -> DataFrame:
    """hash, doc_id, sign, at of the documents' seeds that pass the filter."""

    def rows(batches):
        import pyarrow as pa

        bits = held.value
        for batch in byte_batches(batches, "text", 1_000_000):
            hashes, _, _, counts = word_hashes(*byte_column(batch, "text"), _SIGNS)
            for at, seeds in seed_hashes(hashes, counts, masks):
                x, y = _bits(seeds, len(bits) * 8)
                passed = np.flatnonzero((bits[x >> 3] >> (x & 7)) & 1)
                y = y[passed]
                passed = passed[((bits[y >> 3] >> (y & 7)) & 1) == 1]
                at, seeds = at[passed], seeds[passed]
                row = np.searchsorted(counts, at, side="right") - 1
                own = [batch.column(k).take(pa.array(row)) for k in (0, 1)]
                yield pa.record_batch([pa.array(seeds.view(np.int64)), *own, pa.array(at - counts[row])], ["hash", "doc_id", "sign", "at"])

    return docs.select("doc_id", "sign", "text").mapInArrow(rows, "hash long, doc_id long, sign long, at long")


def longest_run(equal: np.ndarray, percent: int) -> tuple[int, int]:
    """The longest run of places, beginning and ending with an equal one, of which at least ``percent`` in 100 are equal."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    lowest = np.minimum.accumulate(sums)  # non-increasing: the first place not above a sum is a binary search
    ends = np.flatnonzero(equal) + 1
    if not len(ends):
        return 0, 0
    starts = np.searchsorted(-lowest, -sums[ends], side="left")
    k = int(np.argmax(ends - starts))
    start, end = int(starts[k]), int(ends[k])
    while start < end and not equal[start]:
        start += 1
    return start, end


def passages(docs: DataFrame, items: DataFrame, min_words: int = 12, percent: int = 80) -> DataFrame:
    """Benchmark passages in documents: doc_id, sign, item_id, start, end, n_words, n_equal.

    docs has doc_id and text, items has item_id and text. start and end are code points of the document, end exclusive;
    sign is the hash of the document's text, which with doc_id names a row. One row for each document, item and diagonal.
    An item of one word or more is found; an item without an id is too, under a null id. Null and empty texts match
    nothing; null and repeated doc_ids keep their rows apart by their texts; items that share a text or an id are items of
    their own; other columns are ignored; empty tables give an empty result.
    """
    found = _passages(docs, items, min_words, percent)
    named = items.select(F.xxhash64(text_or_empty()).alias("item"), F.col("item_id").cast("long").alias("item_id")).distinct()
    return found.join(named, "item").select("doc_id", "sign", "item_id", "start", "end", "n_words", "n_equal")


def _passages(docs: DataFrame, items: DataFrame, min_words: int, percent: int) -> DataFrame:
    """:func:`passages` with the hash of the item's text, ``item``, for item_id: equal texts are searched for once."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("sign", F.xxhash64("text"))
    texts = items.select(text_or_empty().alias("text")).where("text <> ''").distinct().select(F.xxhash64("text").alias("item"), "text")
    seeds = stage(_item_seeds(texts, min_words, percent).distinct(), "item-seeds")
    lengths = sorted(r["words"] for r in seeds.select("words").distinct().collect())  # less than min_words of them
    masks = tuple(m for n in lengths for m in (short_masks(n, percent) if n else MASKS))
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * seeds.count()).bit_length()))
    held = spark.sparkContext.broadcast(_filter_bits(seeds, size))
    hits = _hits(rows, held, masks).join(seeds, "hash")
    diagonals = hits.groupBy("doc_id", "sign", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.count("*").alias("n"), F.min("needs").alias("needs"))
    diagonals = stage(diagonals.where("n >= needs").drop("n", "needs"), "diagonals")

    keys = diagonals.select(F.col("doc_id").alias("of_doc"), F.col("sign").alias("of_sign")).distinct()
    if keys.count() <= MOST_KEYS:
        keys = F.broadcast(keys)
    of = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("sign") == F.col("of_sign"))
    rows = rows.join(keys, of, "left_semi")  # only documents with candidates go on
    parts = diagonals.join(texts.withColumnRenamed("text", "item_text"), "item")
    found = F.struct("item", "diagonal", "item_text")
    # a document's candidates in lists of bounded length
    parts = parts.groupBy(F.col("doc_id").alias("of_doc"), F.col("sign").alias("of_sign"), F.floor(F.col("diagonal") / 512).alias("part"), F.pmod("item", F.lit(64)).alias("share"))
    parts = parts.agg(F.collect_list(found).alias("found"))
    return rows.join(parts, of).select("doc_id", "sign", "text", "found").mapInArrow(
        _compare(min_words, percent), "doc_id long, sign long, item long, start long, end long, n_words long, n_equal long"
    ).distinct()


def _compare(min_words: int, percent: int):
    def rows(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text", 1_000_000):
            raw, at = byte_column(batch, "text")
            hashes, first, last, counts = word_hashes(raw, at, _SIGNS)
            out = []
            ids, signs, found = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for row in range(batch.num_rows):
                own = slice(int(counts[row]), int(counts[row + 1]))
                words, points = hashes[own], None
                for candidate in found[row]:
                    text = np.frombuffer(candidate["item_text"].encode(), np.uint8)
                    item = word_hashes(text, np.array([0, len(text)]), _SIGNS)[0]
                    diagonal = candidate["diagonal"]
                    a, b = max(0, diagonal), min(len(words), diagonal + len(item))
                    equal = words[a:b] == item[a - diagonal : b - diagonal]
                    if len(item) >= min_words:
                        start, end = longest_run(equal, percent)
                    else:  # the whole item, changed ends included
                        start, end = (0, len(item)) if len(equal) == len(item) and int(equal.sum()) * 100 >= percent * len(item) else (0, 0)
                    if end - start >= max(1, min(min_words, len(item))):
                        equal = int((words[a + start : a + end] == item[a - diagonal + start : a - diagonal + end]).sum())
                        if points is None:
                            points = np.concatenate([[0], np.cumsum((raw[at[row] : at[row + 1]] & 0xC0) != 0x80)])
                        span = (first[own][a + start] - at[row], last[own][a + end - 1] - at[row])
                        out.append((ids[row], signs[row], candidate["item"], int(points[span[0]]), int(points[span[1]]), end - start, equal))
            columns = list(zip(*out)) or [()] * 7
            names = ["doc_id", "sign", "item", "start", "end", "n_words", "n_equal"]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

    return rows


def decontaminate(docs: DataFrame, items: DataFrame, min_words: int = 12, percent: int = 80) -> DataFrame:
    """docs without the rows that hold a benchmark passage, items without an id included."""
    doc, sign = free_name("_doc", docs), free_name("_sign", docs)
    found = _passages(docs, items, min_words, percent).select(F.col("doc_id").alias(doc), F.col("sign").alias(sign))
    found = stage(found.distinct(), "contaminated")  # its size is then known
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_or_empty()) == F.col(sign))
    return docs.join(found, same, "left_anti")
