"""The fact table's columns and the options of the analyses."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import types as T

#: One row per commit and changed file. ``ord`` gives log order; any type that can be sorted will do.
COMMIT_COLUMNS = ("rev", "date", "author", "entity", "loc_added", "loc_deleted")
COMMITS = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in COMMIT_COLUMNS[:4]]
    + [T.StructField(c, T.LongType(), False) for c in COMMIT_COLUMNS[4:]]
    + [T.StructField("ord", T.LongType(), False)]
)


@dataclass(frozen=True)
class Options:
    """Thresholds of coupling, the changeset limit of coupling and sum of coupling, the reference date of age."""

    min_revs: int = 5
    min_shared_revs: int = 5
    min_coupling: float = 30
    max_coupling: float = 100
    max_changeset_size: int = 30
    verbose: bool = False
    age_time_now: date | None = None
