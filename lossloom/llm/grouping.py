"""Groups of rows that are compared with one another, split so that no group outgrows a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(members: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """members with key repeated by at least two rows, as rows of pairs of blocks: adds low, high and block.

    A key with n rows has ceil(n / block) blocks; a row stands once in each pair of blocks that has its own, so any two rows
    of a key meet in exactly one pair, or, if they are in the same block, in the pair of that block with itself.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64(node), parts).cast("int")
    rows = members.join(sizes, key)
    rows = rows.select(*members.columns, own.alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other"))
    return rows.select("*", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")).drop("_other")


def sorted_groups(batches, keys: int):
    """Rows of sorted Arrow batches with equal first ``keys`` columns: the key and the lists of the other columns."""
    held, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
        columns = [batch.column(k).to_pylist() for k in range(keys, batch.num_columns)]
        for a, b in zip(cuts, cuts[1:]):
            now, part = tuple(key[a].tolist()), [c[a:b] for c in columns]
            if now == last:
                for x, y in zip(held, part):
                    x.extend(y)
            else:
                if held is not None:
                    yield last, held
                last, held = now, part
    if held is not None:
        yield last, held
