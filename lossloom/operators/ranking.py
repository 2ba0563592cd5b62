"""Order statistics that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom.plans.workspace import settle


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key with their rank.

    Spark limits each input partition to ``n`` rows per key before the shuffle
    (WindowGroupLimit), so a hot key sends at most ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)


def number_rows(df: DataFrame, keys: list[str], order: str | tuple[str, ...], out: str = "pos") -> DataFrame:
    """Consecutive 0-based position of every row per key, by columns that together are unique in a key.

    Only keys and order columns are ranged, by Spark's sampling range partitioner, so ranges are even whatever the ids look
    like and a hot key has many. Rows are numbered inside a range, the sizes of a key's earlier ranges give the offset, and
    the positions are joined back. They depend on the values alone, not on where the ranges were cut.
    """
    by = [order] if isinstance(order, str) else list(order)
    ranged = settle(df.select(*keys, *by).repartitionByRange(*keys, *by).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*by)
    placed = ranged.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, "_range"])
    placed = placed.select(*(F.col(c).alias(f"_{c}_of") for c in [*keys, *by]), (F.col("_off") + F.col("_rn") - 1).alias(out))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in [*keys, *by]]
    joined = df.join(placed, reduce(lambda x, y: x & y, same))
    return joined.drop(*(f"_{c}_of" for c in [*keys, *by]))


_ACCURACY = 20000
_MARGINS = (0.0006, 0.002, 0.006, 0.02, 0.06, 0.2, 0.6, 1.0)


def percentile_nr(df: DataFrame, keys: list[str], col: str, p: float, out: str) -> DataFrame:
    """Exact nearest-rank percentile per key, at rank ``round_half_even((n-1) * p)``.

    A quantile sketch brackets the answer; values are then counted below and inside the bracket with map-side combine, and
    only the bracket's distinct values are put in order. Nothing is approximated in the result. The bracket is the narrowest
    of a few widths that reaches two ranks and the sketch's error beyond the answer on either side.
    """
    shares = [max(0.0, p - m) for m in _MARGINS] + [min(1.0, p + m) for m in _MARGINS]
    stats = df.groupBy(*keys).agg(F.count(col).alias("_n"), F.percentile_approx(col, shares, _ACCURACY).alias("_b"))
    reach = F.lit(3.0 / _ACCURACY) + F.lit(2.0) / F.col("_n")
    width = F.size(F.filter(F.array(*(F.lit(m) for m in _MARGINS[:-1])), lambda m: m < reach))
    lo, hi = F.get("_b", width), F.get("_b", width + len(_MARGINS))
    bounds = stats.select(
        *keys, lo.alias("_lo"), hi.alias("_hi"),
        (F.bround((F.col("_n") - 1) * F.lit(p), 0).cast("bigint") + 1).alias("_rank"),
    )
    value = F.when(F.col(col) >= F.col("_lo"), F.col(col))
    counted = (
        df.where(F.col(col).isNotNull())
        .join(bounds, keys)
        .where(F.col(col) <= F.col("_hi"))
        .groupBy(*keys, "_rank", value.alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    upto = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    return (
        counted.withColumn("_cum", F.sum("_c").over(upto))
        .where(F.col("_v").isNotNull() & (F.col("_cum") >= F.col("_rank")))
        .groupBy(*keys)
        .agg(F.min("_v").alias(out))
    )
