"""Rows in order, cut into ranges: positions in a group without a window over the group's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom.llm.common import stage

_PLACE = 1 << 33  # monotonically_increasing_id counts rows in the lower 33 bits


def ranged(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows of df in the order of group and order (nulls first), as a stage table with _range and _place.

    Spark's range partitioner samples the keys, so a group with many rows gets many ranges; rows equal in all columns named
    are the only ones it cannot part, so ``order`` should end with a column that tells them apart.
    """
    rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    at = F.monotonically_increasing_id()
    rows = rows.withColumn("_at", at).withColumn("_range", F.floor(F.col("_at") / _PLACE)).withColumn("_place", F.col("_at") % _PLACE)
    return stage(rows.drop("_at"), name)


def pieces(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per range and group: _first (place in the range), _count, _before (rows in earlier ranges) and _total of the group.

    One row per range and one more per group, so a window over a group's pieces is short. A row's position in its group is
    _before + _place - _first.
    """
    found = rows.groupBy("_range", *group).agg(F.min("_place").alias("_first"), F.count("*").alias("_count"))
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return found.select(
        "*", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(own).alias("_total")
    )


def place(rows: DataFrame, of: DataFrame, group: list[str]) -> DataFrame:
    """rows with what ``of`` says about their piece and the position in their group as ``pos``.

    The join is by range and group, so a hot group is spread over its ranges.
    """
    named = of.select(*(F.col(c).alias(f"_of_{c}") for c in ["_range", *group]), *(c for c in of.columns if c not in ("_range", *group)))
    same = rows["_range"] == named["_of__range"]
    for c in group:
        same = same & rows[c].eqNullSafe(named[f"_of_{c}"])
    joined = rows.join(named, same).withColumn("pos", F.col("_before") + F.col("_place") - F.col("_first"))
    return joined.drop("_range", "_place", "_first", "_before", "_count", "_total", *(f"_of_{c}" for c in ["_range", *group]))
