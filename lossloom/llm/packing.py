"""Packing of documents into sequences by shortest-pack-first over the histogram of piece lengths.

Documents are cut into pieces of at most ``max_tokens``. The histogram of lengths has at most ``max_tokens`` rows whatever
the size of the corpus, so the plan is made on the driver: lengths are placed longest first, each into the open pattern
with the most room, and only pattern counts are updated. Pieces then find their place by their rank among the pieces of
the same length, which is a matter of counts per salted bucket; no piece is moved to one task.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom.llm.common import blocks, byte_batches, free_name, shuffle_parts, stage, text_or_empty
from lossloom.llm.tokens import END_ID, default_vocabulary, encoder, texts_of

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def cut(docs: DataFrame, max_tokens: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every document: doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit).

    A document's ids end with the end id. It is cut into full pieces and a rest; the rest of up to ``max_tokens - 1`` ids
    stays whole. Null and empty texts give one piece of length 1. Rows with the same or a null doc_id are separate
    documents; other columns are ignored; an empty table gives no piece.
    """
    vocabulary = vocabulary or default_vocabulary()

    def pieces(batches):
        import pyarrow as pa

        encode, end, size = encoder(vocabulary).ids, END_ID.to_bytes(4, "little"), 4 * max_tokens
        for batch in byte_batches(batches, "text", 2_000_000):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                ids = encode(text) + end
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    out.append((doc_id, at // 4, len(part) // 4, len(ids) // 4, part))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64()] * 4 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "ids"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(pieces, PIECES)


@dataclass
class Plan:
    """For each length its blocks of ranks: first rank, copies in a pattern, first sequence, offset of the first copy."""

    blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int
    padded: list[tuple[int, int]]  # tokens in a sequence, number of such sequences


def plan_packs(histogram: dict[int, int], max_tokens: int) -> Plan:
    """Shortest-pack-first: longest lengths first, each into the open pattern with the most room left.

    A pattern is a tuple of (length, copies) with a count. Placing a length takes as many packs from a pattern as are
    needed, several copies at a time when the length repeats, and splits the pattern when only a part of it is used.
    """
    open_by_room: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []  # ascending
    closed: list[tuple[int, tuple]] = []

    def put(room: int, count: int, pattern: tuple) -> None:
        if not room:
            closed.append((count, pattern))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                put(max_tokens - length, left, ((length, 1),))
                break
            room = rooms[-1]
            count, pattern = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop()
            used = min(count, left)
            if used < count:
                put(room, count - used, pattern)
            if pattern[-1][0] == length:
                longer = pattern[:-1] + ((length, pattern[-1][1] + 1),)
            else:
                longer = pattern + ((length, 1),)
            put(room - length, used, longer)
            left -= used

    patterns = closed + [p for room in rooms[::-1] for p in open_by_room[room]]
    ranks: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence, padded = 0, []
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            found.setdefault(length, []).append((ranks.get(length, 0), copies, sequence, offset))
            ranks[length] = ranks.get(length, 0) + count * copies
            offset += length * copies
        padded.append((offset, count))
        sequence += count
    return Plan({k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in found.items()}, sequence, padded)


def assign(pieces: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns, among them doc_id, start and length).

    Pieces of one length are numbered over salted buckets; a bucket holds about a quarter of a partition's share of all
    pieces at most, so a length that holds a third of all pieces is spread too. ``pieces`` is read twice; stage it first.
    """
    spark = pieces.sparkSession
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= max_tokens rows
    plan = plan_packs(lengths, max_tokens)
    total = sum(lengths.values())
    salts = blocks(max(lengths.values(), default=0), max(1, total // (4 * shuffle_parts(spark))))
    names = [c for c in pieces.columns]
    salt, rank, base = (free_name(n, pieces) for n in ("_salt", "_rank", "_base"))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", salt).agg(F.count("*").alias("n"))
    bases = counts.select("length", salt, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy("length", salt).orderBy("doc_id", "start")
    ranked = salted.withColumn(rank, F.row_number().over(inside) - 1).join(bases, ["length", salt])
    ranked = ranked.select(*names, (F.col(rank) + F.col(base)).alias(rank))
    held = spark.sparkContext.broadcast(plan.blocks)  # bounded by max_tokens, whatever the number of pieces

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            length, place_of = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", rank))
            sequence, offset = np.empty(len(place_of), np.int64), np.empty(len(place_of), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                first, copies, base, at = held.value[int(length[rows[0]])]
                k = np.searchsorted(first, place_of[rows], side="right") - 1
                inner = place_of[rows] - first[k]
                sequence[rows] = base[k] + inner // copies[k]
                offset[rows] = at[k] + inner % copies[k] * length[rows]
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, max_tokens: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Places of all pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = cut(docs, max_tokens, vocabulary)
    narrow = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return assign(stage(narrow, "pieces"), max_tokens)


def sequences(pieces: DataFrame, places: DataFrame, max_tokens: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, ids (padded), n_ids, doc_ids and offsets of the pieces in them.

    A sequence whose number of ids is a power of two is left as it is; any other is padded to ``max_tokens``.
    """
    keyed = places.select("doc_id", "start", "sequence_id", "offset")
    parts = pieces.join(keyed, (pieces["doc_id"].eqNullSafe(keyed["doc_id"])) & (pieces["start"] == keyed["start"]))
    part = F.struct(keyed["offset"], pieces["doc_id"], pieces["ids"])
    rows = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # at most max_tokens ids
    raw = F.concat(F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])))
    rows = rows.select("sequence_id", raw.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
    n = (F.octet_length("ids") / 4).cast("int")
    full = F.lit(max_tokens) if max_tokens else n
    power = n.bitwiseAND(n - 1) == 0
    pad = F.repeat(F.hex(F.lit(pad_id.to_bytes(4, "little"))), full - n)
    return rows.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.unhex(pad))).alias("ids"), n.alias("n_ids"), "doc_ids", "offsets")
