"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document's signature has ``SYMBOLS`` minima of its word shingles, each cut to 16 bits; the distance of two signatures is
the number of places where they differ. The places are split into ``CHUNKS`` chunks. By the pigeonhole principle two
signatures at a distance of at most 2 * CHUNKS - 1 = 23 differ in at most one place of some chunk, so listing every chunk
with each one of its places masked finds all such pairs by equality. At a similarity of 0.8 the expected distance is 12.8
and 23 is more than three deviations above it; a masked chunk that agrees also finds many pairs beyond 23, which stay
candidates. All candidates are confirmed on their full shingle sets.

Equal shingle sets are one node. Nodes of one key are not paired all with all:

1. each node is a candidate with the smallest node of its key, and components of the confirmed links are formed;
2. in each key that still has several components, nodes of different components are compared by their signatures and by a
   finer sketch of their sets, and only a spanning forest of the similar ones, the most similar first, is confirmed;
3. where several components are left, all similar pairs between them are confirmed.

A pair inside one component cannot change the result, so no link between components is lost. The comparison by sketches
only drops pairs that are many deviations below the required similarity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom.llm.common import byte_batches, byte_column, free_name, shuffle_parts, stage, text_or_empty
from lossloom.llm.graph import components
from lossloom.llm.grouping import in_blocks, sorted_groups
from lossloom.llm.shingles import mix, overlap, shingle_sets

SYMBOLS, CHUNKS = 64, 12
_SEED = np.random.Generator(np.random.PCG64(99))
_FACTOR = _SEED.integers(0, 1 << 64, SYMBOLS, np.uint64, endpoint=False) | np.uint64(1)
_ADD = _SEED.integers(0, 1 << 64, SYMBOLS, np.uint64, endpoint=False)
_KEY = _SEED.integers(0, 1 << 64, SYMBOLS, np.uint64, endpoint=False) | np.uint64(1)
_MASKED = _SEED.integers(0, 1 << 64, SYMBOLS, np.uint64, endpoint=False)
_CHUNK = np.array_split(np.arange(SYMBOLS), CHUNKS)
BINS, BLOCK = 1024, 1024
FAR = 28  # a signature distance that similar pairs exceed about three times in a million
DEVIATIONS = 4.5  # by which a pair's sketch must fall short to be dropped


def signature(grams: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` 16-bit symbols of a non-empty array of shingle hashes."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        part = grams[at : at + 1024]
        np.minimum(low, (_FACTOR[:, None] * part + _ADD[:, None]).min(axis=1), out=low)
    return (mix(low) & np.uint64(0xFFFF)).astype("<u2")


def masked_keys(signatures: np.ndarray) -> np.ndarray:
    """For rows of symbols the keys of every chunk with each of its places masked, one key per place."""
    weighted = signatures.astype(np.uint64) * _KEY
    keys = np.empty(weighted.shape, np.uint64)
    for places in _CHUNK:
        part = weighted[:, places]
        keys[:, places] = part.sum(axis=1, dtype=np.uint64)[:, None] - part + _MASKED[places]
    return mix(keys).view(np.int64)


def binned(grams: np.ndarray) -> np.ndarray:
    """A sketch of a sorted array of hashes: for each of ``BINS`` ranges one byte of its smallest hash, 0 if it has none."""
    out = np.zeros(BINS, np.uint8)
    bins = (grams >> np.uint64(54)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = mix(grams[first]) % np.uint64(255) + np.uint64(1)
    return out


def may_be_similar(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of sketches and the sums of their sets' sizes: estimated similarity, and whether the pair stays a candidate.

    The bins in use are a sample of the union without repetition, which makes the deviation smaller the more of it they hold.
    """
    used = ((x | y) > 0).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1) / np.maximum(used, 1)
    need = percent / 100
    union = np.maximum(sizes / (1 + need), used)
    deviation = np.sqrt(need * (1 - need) / np.maximum(used, 1) * np.maximum(0.05, 1 - used / np.maximum(union, 1)))
    return same, same >= need - DEVIATIONS * deviation - 1 / np.maximum(used, 1)


def sketch(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit digest of the shingle set), signature and bins (null without words)."""

    def rows(batches):
        import pyarrow as pa
        import xxhash

        for batch in byte_batches(batches, "text", 1_000_000):
            sets = shingle_sets(*byte_column(batch, "text"), words)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signs = [signature(s).tobytes() if len(s) else None for s in sets]
            bins = [binned(s).tobytes() if len(s) else None for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [batch.column(0), sizes, *(pa.array(c, pa.binary()) for c in (keys, signs, bins))]
            yield pa.record_batch(columns, ["doc_id", "n_shingles", "set_key", "signature", "bins"])

    return _texts(docs).mapInArrow(rows, "doc_id long, n_shingles long, set_key binary, signature binary, bins binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def _keys(nodes: DataFrame) -> DataFrame:
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                signs = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS)
                keys = masked_keys(signs).ravel()
                yield pa.record_batch([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), SYMBOLS))], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(rows, "key long, node long")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough: 100 * intersection >= percent * union."""
    texts = _texts(docs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = texts.join(ends, "doc_id", "left_semi")
    with_b = pairs.join(needed.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    both = with_b.join(needed.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")

    def similar(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text_b", 1_000_000):
            of_b = shingle_sets(*byte_column(batch, "text_b"), words)
            keep, last, of_a = [], None, None
            for row in range(batch.num_rows):
                text = batch.column(2)[row]
                if text != last:  # neighbours often share it
                    of_a, last = shingle_sets(*byte_column(batch.slice(row, 1), "text_a"), words)[0], text
                both = overlap(of_a, of_b[row])
                keep.append(100 * both >= percent * (len(of_a) + len(of_b[row]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(similar, "a long, b long").distinct()


def _pairs_by_sketch(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that stay candidates by their sketches."""
    of = sets.select("node", "n_shingles", "bins")
    both = pairs.join(of.withColumnsRenamed({"node": "b", "n_shingles": "size_b", "bins": "bins_b"}), "b")
    both = both.join(of.withColumnsRenamed({"node": "a", "n_shingles": "size_a", "bins": "bins_a"}), "a")

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
                a, b = (part.column(k).to_numpy() for k in (4, 5))
                keep = may_be_similar(x, y, a + b, percent)[1] & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "bins_a", "bins_b", "size_a", "size_b").mapInArrow(rows, "a long, b long").distinct()


def _forest(a: np.ndarray, b: np.ndarray, likeness: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of a spanning forest, the most alike first."""
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k in np.argsort(-likeness, kind="stable").tolist():
        x, y = top(int(a[k])), top(int(b[k]))
        if x != y:
            parent[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def _pairs_in_keys(members: DataFrame, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidate pairs (a, b) between components, from members (key, node, component): a spanning forest of each group of a
    key, or all of them. A pair is looked at in the first key that its nodes share."""
    spark = members.sparkSession
    of = sets.groupBy("node").agg(F.first(F.struct("n_shingles", "signature", "bins")).alias("s")).select("node", "s.*")
    rows = in_blocks(members, "key", "node", BLOCK).join(of, "node")
    rows = rows.select("key", "low", "high", "block", "node", "component", "n_shingles", "signature", "bins")
    # no merging of small partitions: a group's work grows with the square of its rows
    rows = rows.repartition(shuffle_parts(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def compare(batches):
        import pyarrow as pa

        for (key, low, high), (block, node, component, size, sign, bins) in sorted_groups(batches, 3):
            if len(node) < 2:
                continue
            node, component, size, block = (np.array(c) for c in (node, component, size, block))
            sign = np.frombuffer(b"".join(sign), "<u2").reshape(-1, SYMBOLS)
            bins = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, BINS)
            keys = masked_keys(sign)
            found = []
            for k in range(len(node)):
                other = np.arange(k + 1, len(node))
                other = other[component[other] != component[k]]
                other = other[(100 * np.minimum(size[other], size[k]) >= percent * np.maximum(size[other], size[k]))]
                if low != high:
                    other = other[block[other] != block[k]]
                other = other[(sign[other] != sign[k]).sum(axis=1) <= FAR]
                if len(other):
                    shared = np.where(keys[other] == keys[k], keys[other], np.iinfo(np.int64).max).min(axis=1)
                    other = other[shared == key]
                if len(other):
                    alike, keep = may_be_similar(bins[other], bins[k], size[other] + size[k], percent)
                    found += [(k, j, x) for j, x in zip(other[keep].tolist(), alike[keep].tolist())]
            if found:
                i, j, alike = (np.array(c) for c in zip(*found))
                if forest:
                    kept = _forest(component[i], component[j], alike)
                    i, j = i[kept], j[kept]
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _still_mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the keys that have nodes of several components: key, node, component."""
    placed = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return stage(placed.join(mixed, "key"), "members")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Rows without words (null, empty or blank texts) and rows without a doc_id are linked with nothing; a row without a
    doc_id has no component_id and is kept. Rows that share a doc_id are one document: they share a component, and a link of
    one is a link of all. Other columns are ignored; an empty table gives an empty result.
    """
    sketches = stage(sketch(docs, words), "sketches")
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    first = F.first(F.struct("n_shingles", "signature", "bins"))
    sets = usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), first.alias("s")).select("set_key", "node", "s.*")
    sets = stage(sets, "sets")
    keys = _keys(sets)
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = stage(keys.join(shared.select("key", "low"), "key").select("key", "low", "node"), "members")  # keys of several nodes

    stars = members.where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    links = confirm(stage(_pairs_by_sketch(stars, sets, percent), "candidates"), docs, words, percent)
    repeated = usable.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x < y").select("doc_id")
    same_id = usable.join(repeated, "doc_id").join(sets.select("set_key", "node"), "set_key")
    found = components(links.union(same_id.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))
    for forest in (True, False):
        members = _still_mixed(members, found)
        pairs = stage(_pairs_in_keys(members, sets, percent, forest), "candidates")
        more = confirm(pairs, docs, words, percent)
        found = components(more.union(found.select("component", "node")))

    named = sets.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


_NUMBERS = -(1 << 62)
MOST_KEYS = 1_000_000  # dropped rows that are broadcast (16 bytes each); more are joined as Spark sees fit


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of docs: that of the smallest doc_id.

    Rows are told apart by doc_id and text, so different texts under one doc_id are different documents. Of rows that
    repeat both, one stays. Rows without a doc_id and rows without words stay otherwise.
    """
    doc, sign, other = (free_name(n, docs) for n in ("_doc", "_sign", "_other"))
    own, text = F.col("doc_id").cast("long"), F.xxhash64(text_or_empty())
    rows = docs.select(own.alias("doc_id"), text_or_empty().alias("text"), text.alias("sign"))
    pairs = stage(rows.where("doc_id is not null").groupBy("doc_id", "sign").agg(F.count("*").alias("n")), "texts")
    several = pairs.groupBy("doc_id").agg(F.min("sign").alias("x"), F.max("sign").alias("y")).where("x < y").select(F.col("doc_id").alias("of"))
    several = stage(several, "several-texts")
    # such rows get numbers of their own, 62-bit hashes below all others; usually there are none
    number = -(F.xxhash64("doc_id", "sign").bitwiseAND((1 << 62) - 1)) + _NUMBERS
    named = rows
    if not several.isEmpty():
        named = rows.join(several, F.col("doc_id") == F.col("of"), "left")
        named = named.withColumn("doc_id", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(number)).drop("of")
    found = near_duplicates(named.select("doc_id", "text"), words, percent).where("doc_id is not null").select("doc_id", "component_id").distinct()
    places = pairs.join(several, F.col("doc_id") == F.col("of"), "left").select(
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(number).alias("node"), F.col("doc_id").alias("own"), "sign"
    )
    placed = stage(places.join(found, F.col("node") == F.col("doc_id")).select("own", "sign", "component_id"), "placed")
    # a component without such a number is named by the doc_id that stays; only in the others it has to be looked for
    gone = placed.where((F.col("component_id") > _NUMBERS) & (F.col("own") != F.col("component_id"))).select("own", "sign")
    if not several.isEmpty():
        mixed = placed.where(F.col("component_id") <= _NUMBERS)
        first = mixed.groupBy("component_id").agg(F.min(F.struct("own", "sign")).alias("first"))
        other_rows = mixed.join(first, "component_id").where((F.col("own") != F.col("first.own")) | (F.col("sign") != F.col("first.sign")))
        gone = gone.union(other_rows.select("own", "sign"))
    gone = stage(gone.select(F.col("own").alias(doc), F.col("sign").alias(sign)), "gone")
    if gone.count() <= MOST_KEYS:
        gone = F.broadcast(gone)
    same = (own == F.col(doc)) & (text == F.col(sign))
    left = docs.join(gone, same, "left_anti")
    again = stage(pairs.where("n > 1").select(F.col("doc_id").alias(doc), F.col("sign").alias(sign)), "repeated")
    if again.isEmpty():
        return left
    one = Window.partitionBy(own, text, text_or_empty()).orderBy(F.lit(0))
    copies = left.join(again, same, "left_semi").withColumn(other, F.row_number().over(one)).where(F.col(other) == 1).drop(other)
    return left.join(again, same, "left_anti").unionByName(copies)
