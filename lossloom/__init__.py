"""Loss-driven curriculum building on Spark.

Sections (independent experiments) are a column, not a directory: every operator takes
DataFrames keyed by ``section_id`` and handles all sections in one job.
"""

from lossloom.params import Params

__all__ = ["Params"]
