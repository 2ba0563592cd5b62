"""Similar vectors by spherical-cap filters from random product codes.

Vectors are rotated by a random orthogonal matrix and split into two halves. Each half has a code of ``c`` random
directions; a filter is a pair of code words, so there are c * c filter directions although only 2 * c are stored. A vector
belongs to every filter whose direction it exceeds by the threshold; the list is decoded from the inner products of the
halves, keeping only code words that can still reach the threshold. Filters grow in proportion to the vectors, and the
threshold is set so that a vector has about ``per_vector`` filters in each of ``codes`` independent codes. The threshold
rises with the number of filters, and with it the share of pairs that a code misses, so the number of codes rises as well:
pairs at the least cosine are drawn and their misses in one code counted, and as many codes are taken as bring the
product of the misses below ``MISS``.

Vectors of a filter are compared in double precision. A filter with many vectors is split into blocks, and each pair of
blocks is a group of its own, so no group outgrows a task. A link is counted in the first filter that both vectors share,
so no pairs are collected to be made distinct, and within a group only the smallest node of each linked part is passed on.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.llm.common import shuffle_parts, stage
from lossloom.llm.graph import components
from lossloom.llm.grouping import in_blocks, sorted_groups

MIN_COS, CODES, PER_VECTOR, PER_FILTER, BLOCK = 0.95, 16, 2, 1, 1024  # CODES is the least number
MISS = 0.001  # the share of pairs at the least cosine that may have no filter in common


def cap_threshold(dim: int, share: float) -> float:
    """The inner product that a random unit vector exceeds with a direction with probability ``share``."""
    t = np.linspace(-1, 1, 200_001)
    density = np.power(np.maximum(0, 1 - t * t), (dim - 3) / 2)
    above = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-above, -share * above[0])])


class ProductCode:
    """The filters of one code for one dimension."""

    def __init__(self, dim: int, words: int, per_vector: float, number: int):
        self.dim, self.words = max(dim, 8), words
        random = np.random.Generator(np.random.PCG64([dim, words, *((number,) if number >= 0 else (-number, 1))]))
        self.rotation = np.linalg.qr(random.standard_normal((self.dim, self.dim)))[0]
        self.half = self.dim // 2
        sides = [random.standard_normal((words, n)) for n in (self.half, self.dim - self.half)]
        self.codes = [s / np.linalg.norm(s, axis=1, keepdims=True) * math.sqrt(s.shape[1] / self.dim) for s in sides]
        self.threshold = cap_threshold(self.dim, per_vector / (words * words))

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row (a unit vector) the sorted numbers of the filters that it exceeds."""
        padded = np.zeros((len(unit), self.dim))
        padded[:, : unit.shape[1]] = unit
        turned = padded @ self.rotation
        left, right = turned[:, : self.half] @ self.codes[0].T, turned[:, self.half :] @ self.codes[1].T
        out = []
        for a, b in zip(left, right):
            i = np.flatnonzero(a >= self.threshold - b.max())
            j = np.flatnonzero(b >= self.threshold - a.max())
            x, y = np.nonzero(a[i, None] + b[j] >= self.threshold)
            out.append(np.sort(i[x] * self.words + j[y]))
        return out


def words_of(vectors: int, per_vector: float = PER_VECTOR, per_filter: float = PER_FILTER) -> int:
    """The code words of a half for so many distinct vectors."""
    return max(16, math.ceil(math.sqrt(vectors * per_vector / per_filter)))


def miss_of_code(dim: int, words: int, min_cos: float = MIN_COS, per_vector: float = PER_VECTOR, pairs: int = 4000) -> float:
    """The share of random pairs at ``min_cos`` without a common filter of one code, and twice its standard error."""
    random = np.random.Generator(np.random.PCG64([dim, words, 97]))
    missed, done, number = 0, 0, 0
    at_once = max(50, min(500, 2_000_000 // words))  # the products of a batch stay below 50 MB
    while done < pairs:
        if done * 4 >= number * pairs:  # four codes, none of them one that is used
            code, number = ProductCode(dim, words, per_vector, -1 - number), number + 1
        x = random.standard_normal((at_once, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = random.standard_normal((at_once, dim))
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y *= math.sqrt(max(0.0, 1 - min_cos * min_cos)) / np.linalg.norm(y, axis=1, keepdims=True)
        both = zip(code.filters(x), code.filters(min_cos * x + y))
        missed += sum(not len(np.intersect1d(a, b, assume_unique=True)) for a, b in both)
        done += at_once
    share = missed / done
    return share + 2 * math.sqrt(share * (1 - share) / done)


def codes_for(dims: list[int], words: int, min_cos: float = MIN_COS, per_vector: float = PER_VECTOR, miss: float = MISS) -> int:
    """The codes, at least CODES, with which the share ``miss`` of the pairs at ``min_cos`` has no common filter in any dimension."""
    worst = max((miss_of_code(d, words, min_cos, per_vector) for d in dims if d > 1), default=0.0)
    return max(CODES, math.ceil(math.log(miss) / math.log(min(0.99, worst)))) if worst > 0 else CODES


def _decode(classes: DataFrame, words: int, codes: int, per_vector: float) -> DataFrame:
    """node, copies, vector (binary floats, or doubles where floats would lose digits) and filters of distinct vectors."""

    def rows(batches):
        import pyarrow as pa

        known: dict[int, list[ProductCode]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vectors = [np.array(v, np.float64) for v in part.column(2).to_pylist()]
                filters = [None] * len(vectors)
                for dim in {len(v) for v in vectors}:
                    if dim not in known:
                        known[dim] = [ProductCode(dim, words, per_vector, k) for k in range(codes)]
                    mine = [k for k, v in enumerate(vectors) if len(v) == dim]
                    x = unit_rows(np.array([vectors[k] for k in mine]))
                    lists = [[f + (dim * codes + k) * words * words for f in c.filters(x)] for k, c in enumerate(known[dim])]
                    for k, *found in zip(mine, *lists):
                        filters[k] = np.concatenate(found)
                packed = [v.astype(np.float32) for v in vectors]
                packed = [(p if (p == v).all() else v).tobytes() for p, v in zip(packed, vectors)]
                columns = [part.column(0), part.column(1), pa.array(packed, pa.binary()), pa.array(filters, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, ["node", "copies", "vector", "filters"])

    return classes.select("node", "copies", "vector").mapInArrow(rows, "node long, copies long, vector binary, filters array<long>")


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(min_cos: float, per_dim: int):
    """For each group the number of links first seen there, and the smallest node of the linked part, by node."""

    def rows(batches):
        import pyarrow as pa

        out = []
        for (flt, low, high), (block, node, copies, vector, filters) in sorted_groups(batches, 3):
            if len(node) < 2:
                continue
            singles = 4 * (flt // per_dim)  # bytes of a vector in floats
            x = unit_rows(np.array([np.frombuffer(v, np.float32 if len(v) == singles else np.float64) for v in vector], np.float64))
            near = x @ x.T >= min_cos
            np.fill_diagonal(near, False)
            if low != high:
                side = np.array(block) == low
                near &= side[:, None] != side
            rows_ = np.flatnonzero(near.any(axis=1))
            if not len(rows_):
                continue
            near = near[np.ix_(rows_, rows_)]
            earlier = sorted({f for k in rows_ for f in filters[k] if f < flt})
            first = near
            if earlier:
                place = {f: k for k, f in enumerate(earlier)}
                has = np.zeros((len(rows_), len(earlier)), np.float32)
                for r, k in enumerate(rows_):
                    has[r, [place[f] for f in filters[k] if f < flt]] = 1
                first = near & (has @ has.T == 0)
            links = first.astype(np.float64) @ np.array(copies, np.float64)[rows_]
            names = np.array(node)[rows_]
            least = names.copy()
            while True:
                reached = np.minimum(least, np.where(near, least, np.iinfo(np.int64).max).min(axis=1))
                if (reached == least).all():
                    break
                least = reached
            out += zip(names.tolist(), links.astype(np.int64).tolist(), least.tolist())
            if len(out) > 50_000:
                yield _batch(pa, out)
                out = []
        yield _batch(pa, out)

    return rows


def _batch(pa, rows):
    columns = list(zip(*rows)) or [()] * 3
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["node", "links", "least"])


def similar_vectors(
    vectors: DataFrame, min_cos: float = MIN_COS, codes: int | None = None, per_vector: float = PER_VECTOR, per_filter: float = PER_FILTER, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding).

    Equal vectors are one node that counts its copies. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; vectors of different dimensions are not compared. Rows without a vec_id link with nothing
    and are kept; rows that share a vec_id share their links. Other columns are ignored. Without ``codes``, as many are taken
    as the number of distinct vectors needs (``codes_for``).
    """
    spark = vectors.sparkSession
    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    wrong = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & ~F.coalesce(wrong, F.lit(True)) & F.exists("vector", lambda v: v != 0)
    plain = F.transform("vector", lambda v: v + F.lit(0.0))  # -0.0 becomes 0.0
    keyed = doubles.select("vec_id", F.when(usable, plain).alias("vector"))
    keyed = keyed.withColumn("key", F.when(F.col("vector").isNotNull(), F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)))
    keyed = stage(keyed, "vectors")
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = stage(classes, "vector-classes")

    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    words = words_of(sum(sizes.values()), per_vector, per_filter)
    if codes is None:
        codes = codes_for([dim for dim, n in sizes.items() if n > 1], words, min_cos, per_vector)
    spread = classes.repartition(shuffle_parts(spark))
    caps = stage(_decode(spread, words, codes, per_vector), "caps")
    flat = caps.select("node", F.explode("filters").alias("filter"))
    rows = in_blocks(flat, "filter", "node", block).join(caps, "node").select("filter", "low", "high", "block", "node", "copies", "vector", "filters")
    # no merging of small partitions: a group's work grows with the square of its rows
    rows = rows.repartition(shuffle_parts(spark), "filter", "low", "high").sortWithinPartitions("filter", "low", "high")
    found = stage(rows.mapInArrow(_linked(min_cos, codes * words * words), "node long, links long, least long"), "links")

    joined = components(found, "node", "least")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("key", "node", "copies").join(links, "node", "left").join(joined, "node", "left")
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = keyed.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
