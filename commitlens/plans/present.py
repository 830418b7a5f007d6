"""Presentation: the report columns of each analysis as text, in its order, with its limit."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.model import Options


@dataclass(frozen=True)
class Report:
    """Columns as (header, column), sort keys (``-`` for descending), columns shown to two places."""

    columns: tuple[tuple[str, str], ...]
    order: tuple[str, ...]
    places: tuple[str, ...] = ()


def _report(columns: str, order: str, places: str = "") -> Report:
    pairs = tuple(tuple(c.split("=")) if "=" in c else (c.replace("_", "-"), c) for c in columns.split())
    return Report(pairs, tuple(order.split()), tuple(places.split()))


CHURN = "added deleted commits"
REPORTS = {
    "authors": _report("entity n_authors n_revs", "-n_authors entity"),
    "revisions": _report("entity n_revs", "-n_revs entity"),
    "summary": _report("statistic value", "position"),
    "identity": _report("entity rev date author loc_added loc_deleted", "ord"),
    "abs-churn": _report(f"date {CHURN}", "date"),
    "author-churn": _report(f"author {CHURN}", "author"),
    "entity-churn": _report(f"entity {CHURN}", "-added entity"),
    "entity-ownership": _report("entity author added deleted", "entity author"),
    "main-dev": _report("entity main_dev added total_added ownership", "entity", "ownership"),
    "refactoring-main-dev": _report("entity main_dev removed total_removed ownership", "entity", "ownership"),
    "main-dev-by-revs": _report("entity main_dev revs total_revs ownership", "entity", "ownership"),
    "entity-effort": _report("entity author author_revs total_revs", "entity -author_revs author"),
    "fragmentation": _report("entity fractal_value total_revs", "-fractal_value entity", "fractal_value"),
    "communication": _report("author peer shared average strength", "-strength -author peer"),
    "age": _report("entity age_months", "age_months entity"),
    "coupling": _report("entity coupled degree average_revs", "-degree -average_revs entity coupled"),
    "soc": _report("entity soc", "-soc entity"),
    "cloc": _report("Language=language Files=files Blank=blank Comment=comment Code=code", "is_total -code language"),
    "cloc-by-file": _report("File=file Language=language Blank=blank Comment=comment Code=code", "file"),
}
VERBOSE = ("first_entity_revisions", "second_entity_revisions", "shared_revisions")


@F.pandas_udf(T.StringType())
def two_places(values: pd.Series) -> pd.Series:
    """A double to two places as its exact binary value rounds, which Spark's own formatting doesn't do."""
    return values.map(lambda x: None if pd.isna(x) else f"{x + 0.0:.2f}")


def present(result: DataFrame, name: str, rows: int = 0, options: Options = Options()) -> DataFrame:  # noqa: B008
    """``result`` of analysis ``name`` as text under its headers; the first ``rows`` of it if that is positive."""
    report = REPORTS[name]
    columns = report.columns + (tuple((c.replace("_", "-"), c) for c in VERBOSE) if name == "coupling" and options.verbose else ())
    sort = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in report.order]
    ordered = result.orderBy(*sort)
    ordered = ordered.limit(rows) if rows > 0 else ordered

    def text(column: str) -> Column:
        return two_places(F.col(column).cast("double")) if column in report.places else F.col(column).cast("string")

    return ordered.select(*[text(c).alias(h) for h, c in columns])
