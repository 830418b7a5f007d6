"""Row-level transforms of the log: architectural groups, teams, excluded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions.patterns import path_regex

#: A team map of at most so many authors is broadcast; larger ones are joined as Spark sees fit.
BROADCAST_AUTHORS = 100_000


def apply_groups(commits: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """Entities take the name of the first group whose pattern they hold; rows without one, or with an empty name, go. No groups: no change."""
    if not groups:
        return commits
    name = F.lit(None).cast("string")
    for pattern, group in reversed(groups):
        name = F.when(F.col("entity").rlike(pattern), F.lit(group)).otherwise(name)
    return commits.withColumn("entity", name).filter("entity <> ''")


def apply_teams(commits: DataFrame, teams: dict[str, str]) -> DataFrame:
    """Authors become their teams; those without one go. An empty map: no change."""
    if not teams:
        return commits
    rows = commits.sparkSession.createDataFrame(list(teams.items()), "author string, team string")
    return join_teams(commits, F.broadcast(rows) if len(teams) <= BROADCAST_AUTHORS else rows)


def join_teams(commits: DataFrame, teams: DataFrame) -> DataFrame:
    """The same with a table of teams (author, distinct, and team)."""
    joined = commits.join(teams.select("author", F.col("team").alias("_team")), "author")
    return joined.withColumn("author", F.col("_team")).select(*commits.columns)


def is_excluded(path: str | Column, patterns: list[str]) -> Column:
    """Whether a path matches any exclude pattern: a directory at the root, or a glob on the whole path or its last part."""
    path, whole = F.col(path) if isinstance(path, str) else path, path_regex(patterns)
    return F.lit(False) if whole is None else path.rlike(rf"^{whole}\z")


def exclude_paths(commits: DataFrame, patterns: list[str]) -> DataFrame:
    return commits.filter(~is_excluded("entity", patterns)) if patterns else commits


def exclude_log_lines(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """Raw log lines (``value``) without those of excluded files; all without three fields pass, with their line ends."""
    whole = path_regex(patterns)
    return lines if whole is None else lines.filter(~F.rtrim("value", F.lit("\r\n")).rlike(rf"^[^\t]*\t[^\t]*\t{whole}\z"))
