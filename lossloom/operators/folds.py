"""Folds over the rounds of a section, carrying one state from round to round."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def fold_rounds(rows: DataFrame, step: Callable, start: tuple, schema: str) -> DataFrame:
    """Apply ``step(state, row) -> (state, values)`` to each section's rows in order of ``round_id``.

    ``rows`` has one short row per section and round, so a group holds the rounds of a section, never its records; the
    state is one tuple. ``schema`` lists the columns of the values after ``section_id`` and ``round_id``.
    """
    names = ["section_id", "round_id", *(part.split()[0] for part in schema.split(", "))]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        state, out = start, []
        for row in frame.sort_values("round_id").itertuples(index=False):
            state, values = step(state, row)
            out.append((key[0], row.round_id, *values))
        found = pd.DataFrame(out, columns=names)
        ints = [part.split()[0] for part in schema.split(", ") if part.split()[1] == "int"]
        return found.astype(dict.fromkeys(ints, "Int32"))

    return rows.groupBy("section_id").applyInPandas(run, f"section_id string, round_id int, {schema}")
