"""Readers of the small configuration files: group rules and the team map."""

from __future__ import annotations

import csv
from collections.abc import Iterable

from pyspark.sql import SparkSession

from commitlens.functions.patterns import java_regex, quoted


def parse_groups(lines: Iterable[str]) -> list[tuple[str, str]]:
    """(pattern, name) of each ``path => name`` rule, in order; ``^`` begins a pattern, other paths are directories."""
    rules = []
    for number, line in enumerate(lines, 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        left, arrow, name = line.partition("=>")
        if not arrow:
            raise ValueError(f"line {number}: no => in {line!r}")
        left = left.strip()
        rules.append((java_regex(left) if left.startswith("^") else f"^{quoted(left)}/", name.strip()))
    return rules


def text_lines(path: str, spark: SparkSession | None = None) -> Iterable[str]:
    """The lines of a small file, ends included: of the driver's disk, or with a session of any store that Spark reads."""
    if spark is None:
        with open(path, encoding="utf-8", newline="") as lines:
            return list(lines)
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).splitlines(keepends=True)


def read_groups(path: str, spark: SparkSession | None = None) -> list[tuple[str, str]]:
    return parse_groups(text_lines(path, spark))


def parse_teams(lines: Iterable[str]) -> dict[str, str]:
    """author: team. Header rows are skipped wherever they stand; the last of several rows counts."""
    teams: dict[str, str] = {}
    width = None
    for row in csv.reader((x for x in lines if not x.startswith("#")), skipinitialspace=True, strict=True):
        if not row:
            continue
        width = width or len(row)
        if len(row) != width:
            raise ValueError(f"wrong number of fields: {row}")
        if len(row) < 2:
            continue
        author, team = row[0].strip(), row[1].strip()
        if (author.lower(), team.lower()) != ("author", "team"):
            teams[author] = team
    return teams


def read_teams(path: str, spark: SparkSession | None = None) -> dict[str, str]:
    return parse_teams(text_lines(path, spark))
