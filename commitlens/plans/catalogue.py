"""The query catalogue over the driver's tables, with the SQL that checks each query."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.model import COMMIT_COLUMNS, Options
from commitlens.operators import loc
from commitlens.operators.transforms import apply_groups, apply_teams, exclude_log_lines, exclude_paths, join_teams
from commitlens.plans.analyses import ANALYSES
from commitlens.plans.present import present
from commitlens.sources.gitlog import log_lines, read_git_log
from commitlens.sources.producer import texts_under
from commitlens.sources.sinks import write_csv_file
from commitlens.sources.specs import parse_groups, read_groups, read_teams
from commitlens.sources.storage import shared_dir
from commitlens.sources.tables import COMMITS_SQL, commits_from_tables

NOW = date(2002, 1, 1)
LOOSE = Options(min_revs=1, min_shared_revs=2, min_coupling=5, age_time_now=NOW)
EXCLUDES = ("src/standard/", "*7.go", "src/*/brand1?/part[1-3]*.go")


def by_type(commits: DataFrame) -> DataFrame:
    """Entities by their part's type."""
    return apply_groups(commits, parse_groups(f"src/{n.lower()} => {n}" for n in ("Standard", "Small", "Medium", "Large", "Economy", "Promo")))


def region_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as authors, their regions as teams."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("author"), F.concat(F.lit("team"), F.col("n_regionkey").cast("string")).alias("team"))


def by_region(spark: SparkSession, sf_dir: str, commits: DataFrame) -> DataFrame:
    return join_teams(commits, region_teams(spark, sf_dir))


def _new(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def by_team_file(spark: SparkSession, sf_dir: str, commits: DataFrame) -> DataFrame:
    """The same teams by way of a file, with a header and a comment."""
    path = _new(spark, "teams")
    rows = region_teams(spark, sf_dir).select(F.lit(2).alias("n"), F.concat_ws(", ", "author", "team").alias("value"))
    head = spark.range(2).select(F.col("id").cast("int").alias("n"), F.when(F.col("id") == 0, "Author,Team").otherwise("# nations").alias("value"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return apply_teams(commits, read_teams(path, spark))


def by_group_file(spark: SparkSession, sf_dir: str, commits: DataFrame) -> DataFrame:
    """Types as groups by way of a file: directories, and a pattern."""
    path = _new(spark, "groups")
    rules = ["# types", "", "src/standard => Standard", r"^src/\Qsmall\E/ => Small", "^src/(?:medium)/ => Medium", r"^src/lar\pL+/ => Large", "src/economy => Economy", "^src/[[:alpha:]]romo/ => Promo"]
    spark.createDataFrame([("\n".join(rules),)], "value string").coalesce(1).write.text(path)
    return apply_groups(commits, read_groups(path, spark))


def _over(name: str, change: Callable | None = None, options: Options = LOOSE) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        commits = commits_from_tables(spark, sf_dir)
        result = ANALYSES[name](change(spark, sf_dir, commits) if change else commits, options)
        return result.drop("ord", "position")

    return query


def _grouped(spark: SparkSession, sf_dir: str, commits: DataFrame) -> DataFrame:
    return by_type(commits)


def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' commits written as log text and scanned again: some authors have dashes, some
    records have line ends of two characters, and some a malformed header within, whose lines stay the record's."""
    path = _new(spark, "log")
    commits = commits_from_tables(spark, sf_dir).withColumn("author", F.when(F.col("author").startswith("I"), F.concat(F.col("author"), F.lit("--too"))).otherwise(F.col("author")))
    value, kind = F.col("value"), F.pmod(F.crc32("value"), F.lit(6))
    broken = F.regexp_replace(value, r"\n([0-9-]+\t[^\n]*\n)$", "\n--broken--header\n$1")
    written = F.when(kind == 0, F.replace(value, F.lit("\n"), F.lit("\r\n"))).when(kind == 1, broken).otherwise(value)
    log_lines(commits).select(written.alias("value")).write.text(path)
    return read_git_log(spark, path).select(*COMMIT_COLUMNS)


def exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclude_paths(commits_from_tables(spark, sf_dir), list(EXCLUDES)).select(*COMMIT_COLUMNS)


def exclude_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit's lines: a header, a line of its file (some with line ends), and a blank one."""
    end = F.when(F.col("loc_added") % 3 == 0, "\r").when(F.col("loc_added") % 3 == 1, "\r\n").otherwise("")
    line = F.concat(F.concat_ws("\t", F.col("loc_added").cast("string"), F.col("loc_deleted").cast("string"), "entity"), end)
    lines = F.array(F.concat(F.lit("--"), F.concat_ws("--", "rev", "date", "author")), line, F.lit(""))
    return exclude_log_lines(commits_from_tables(spark, sf_dir).select(F.explode(lines).alias("value")), list(EXCLUDES))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of revisions as a CSV file, read back; names have quotes, separators, line ends and leading blanks."""
    path = _new(spark, "report")
    path = f"{path if ':' in path.split('/')[0] else 'file://' + path}.csv"
    odd = F.element_at(F.array(F.lit('say "'), F.lit("a, "), F.lit(" "), F.lit("two\nlines ")), (F.length("entity") % 4 + 1).cast("int"))
    report = present(ANALYSES["revisions"](commits_from_tables(spark, sf_dir).withColumn("entity", F.concat(odd, F.col("entity"))), LOOSE), "revisions")
    write_csv_file(report, path)
    read = spark.read.options(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read.select(F.col("entity"), F.col("n-revs").cast("bigint").alias("n_revs"))


def topk_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ANALYSES["revisions"](commits_from_tables(spark, sf_dir), LOOSE)
    return found.orderBy(F.desc("n_revs"), "entity").limit(10)


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per part with blank, comment and code lines, and comments over several lines."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = lambda i: F.when(i % 5 == 0, F.lit("  ")).when(i % 7 == 0, F.lit("  # note // too")).when(i % 11 == 0, F.lit("// note")).when(i % 16 == 1, F.lit("/* open")).when(i % 16 == 4, F.lit("shut */")).otherwise(F.lit("x = 1;"))
    end = F.get(F.array(F.lit(".go"), F.lit(".py"), F.lit(".yaml"), F.lit(".unknown")), (F.col("p_partkey") % 4).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), line), "\n")
    return parts.select(F.concat(F.lit("src/part"), F.col("p_partkey").cast("string"), end).alias("file"), F.concat(text, F.lit("\n")).alias("text"))


def loc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loc.by_language(loc.count_lines(made_files(spark, sf_dir))).drop("is_total")


def loc_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loc.by_file(loc.exclude_files(loc.count_lines(made_files(spark, sf_dir)), ["*9.py"]))


def loc_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' files put together by brand, written as files, and counted as executors read them."""
    path = _new(spark, "files")
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    end = F.get(F.array(F.lit(".go"), F.lit(".py"), F.lit(".yaml"), F.lit(".unknown")), (F.col("p_partkey") % 4).cast("int"))
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), lambda i: F.when(i % 5 == 0, "").when(i % 7 == 0, "# note").otherwise("x = 1")), "\n")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(brand, end).alias("name"), lines.alias("text"))
    parts.repartition("name").write.partitionBy("name").text(path)
    files = texts_under(spark, path).withColumn("file", F.regexp_replace("file", r"^name=([^/]*)/.*$", "src/$1"))
    return loc.by_file(loc.count_lines(files)).groupBy("file", "language").agg(*(F.sum(c).alias(c) for c in ("blank", "comment", "code")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name.replace("-", "_"): _over(name) for name in ANALYSES},
    "coupling_verbose": _over("coupling", options=Options(min_revs=1, min_shared_revs=2, min_coupling=5, verbose=True)),
    "coupling_by_type_default": _over("coupling", _grouped, Options()),
    "soc_by_type": _over("soc", _grouped, Options()),
    "revisions_grouped": _over("revisions", _grouped),
    "authors_team": _over("authors", by_region),
    "fragmentation_team": _over("fragmentation", by_region),
    "communication_team": _over("communication", by_region),
    "log_roundtrip": log_roundtrip,
    "exclude_filter": exclude_filter,
    "exclude_lines": exclude_lines,
    "topk_revisions": topk_revisions,
    "authors_team_file": _over("authors", by_team_file),
    "revisions_group_file": _over("revisions", by_group_file),
    "csv_roundtrip": csv_roundtrip,
    "loc_from_files": loc_from_files,
    "loc_by_language": loc_by_language,
    "loc_by_file": loc_by_file,
}


# ---- the same in DuckDB's SQL

GROUPED_SQL = """commits AS (
  SELECT * EXCLUDE (entity), CASE split_part(entity, '/', 2)
         WHEN 'standard' THEN 'Standard' WHEN 'small' THEN 'Small' WHEN 'medium' THEN 'Medium'
         WHEN 'large' THEN 'Large' WHEN 'economy' THEN 'Economy' WHEN 'promo' THEN 'Promo' END AS entity
  FROM base WHERE split_part(entity, '/', 2) IN ('standard', 'small', 'medium', 'large', 'economy', 'promo'))"""
TEAMS_SQL = "commits AS (SELECT base.* EXCLUDE (author), 'team' || n_regionkey AS author FROM base JOIN nation ON author = n_name)"


def _sql(body: str, change: str = "") -> str:
    return f"WITH {COMMITS_SQL.replace('commits AS', 'base AS', 1)}, {change} {body}" if change else f"WITH {COMMITS_SQL} {body}"


def _joined(change: str, more: str, select: str) -> str:
    base = f"{COMMITS_SQL.replace('commits AS', 'base AS', 1)}, {change}" if change else COMMITS_SQL
    return f"WITH {base}, {more} {select}"


def _churn(key: str) -> str:
    return _sql(f"SELECT {key}, CAST(sum(loc_added) AS BIGINT) AS added, CAST(sum(loc_deleted) AS BIGINT) AS deleted, count(DISTINCT rev) AS commits FROM commits GROUP BY {key}")


def _top(shares: str, count: str, total: str) -> str:
    return _joined(
        "",
        f"shares AS ({shares}), ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {count} DESC, author) AS place FROM shares)",
        f"SELECT entity, author AS main_dev, {count}, {total}, CASE WHEN {total} = 0 THEN 0.0 ELSE CAST({count} AS DOUBLE) / CAST({total} AS DOUBLE) * 100.0::DOUBLE END AS ownership FROM ranked WHERE place = 1",
    )


def _sums(column: str, name: str) -> str:
    return f"SELECT entity, author, CAST(sum({column}) AS BIGINT) AS {name}, CAST(sum(sum({column})) OVER (PARTITION BY entity) AS BIGINT) AS total_{name} FROM commits GROUP BY entity, author"


REVS = """each AS (SELECT entity, author, count(DISTINCT rev) AS author_revs FROM commits GROUP BY entity, author),
  every AS (SELECT entity, count(DISTINCT rev) AS total_revs FROM commits GROUP BY entity)"""


def _fragmentation(change: str = "") -> str:
    return _joined(
        change,
        REVS + ", squares AS (SELECT entity, CAST(sum(author_revs * author_revs) AS BIGINT) AS s, any_value(total_revs) AS total_revs FROM each JOIN every USING (entity) GROUP BY entity)",
        "SELECT entity, CAST(sign(total_revs * total_revs - s) * ((200 * abs(total_revs * total_revs - s) + total_revs * total_revs) // (2 * total_revs * total_revs)) AS DOUBLE) / 100.0::DOUBLE AS fractal_value, total_revs FROM squares",
    )


def _communication(change: str = "") -> str:
    return _joined(
        change,
        """works AS (SELECT DISTINCT entity, author FROM commits), totals AS (SELECT author, count(*) AS n FROM works GROUP BY author),
  shared AS (SELECT a.author, b.author AS peer, count(*) AS shared FROM works a JOIN works b USING (entity) WHERE a.author <> b.author GROUP BY ALL),
  counted AS (SELECT s.*, CAST(ceil((t.n + p.n) / 2.0::DOUBLE) AS BIGINT) AS average FROM shared s JOIN totals t ON s.author = t.author JOIN totals p ON s.peer = p.author)""",
        "SELECT author, peer, shared, average, CAST(trunc(CAST(shared AS DOUBLE) / CAST(average AS DOUBLE) * 100.0::DOUBLE) AS BIGINT) AS strength FROM counted",
    )


def _coupling(o: Options, change: str = "") -> str:
    more = ", na AS first_entity_revisions, nb AS second_entity_revisions, shared AS shared_revisions" if o.verbose else ""
    return _joined(
        change,
        f"""pairs AS (SELECT DISTINCT rev, entity FROM commits),
  sets AS (SELECT * FROM pairs WHERE rev IN (SELECT rev FROM pairs GROUP BY rev HAVING count(*) <= {o.max_changeset_size})),
  mods AS (SELECT entity, count(*) AS n FROM sets GROUP BY entity),
  shared AS (SELECT a.entity AS a, b.entity AS b, count(*) AS shared FROM sets a JOIN sets b ON a.rev = b.rev AND a.entity < b.entity GROUP BY ALL),
  counted AS (SELECT s.*, x.n AS na, y.n AS nb, (x.n + y.n) / 2.0::DOUBLE AS average FROM shared s JOIN mods x ON s.a = x.entity JOIN mods y ON s.b = y.entity),
  exact AS (SELECT *, shared / average * 100.0::DOUBLE AS degree FROM counted)""",
        f"""SELECT a AS entity, b AS coupled, CAST(trunc(degree) AS BIGINT) AS degree, CAST(ceil(average) AS BIGINT) AS average_revs{more} FROM exact
  WHERE shared >= {o.min_shared_revs} AND average >= {o.min_revs} AND degree >= {o.min_coupling} AND floor(degree) <= {o.max_coupling}""",
    )


def _soc(change: str = "", most: int = 30) -> str:
    return _joined(
        change,
        f"pairs AS (SELECT DISTINCT rev, entity FROM commits), sizes AS (SELECT rev, count(*) AS n FROM pairs GROUP BY rev HAVING count(*) <= {most})",
        "SELECT entity, CAST(sum(n - 1) AS BIGINT) AS soc FROM pairs JOIN sizes USING (rev) GROUP BY entity",
    )


AUTHORS_SQL = "SELECT entity, count(DISTINCT author) AS n_authors, count(DISTINCT rev) AS n_revs FROM commits GROUP BY entity"
REVISIONS_SQL = "SELECT entity, count(DISTINCT rev) AS n_revs FROM commits GROUP BY entity"
KEPT_SQL = r"NOT (starts_with(entity, 'src/standard/') OR regexp_matches(entity, '7\.go$') OR regexp_matches(entity, '^src/[^/]*/brand1[^/]/part[1-3][^/]*\.go$'))"
LINES_SQL = """lines AS (
    SELECT p_partkey, 'src/part' || p_partkey || ['.go', '.py', '.yaml', '.unknown'][CAST(p_partkey % 4 AS INTEGER) + 1] AS file,
           ['Go', 'Python', 'YAML', NULL][CAST(p_partkey % 4 AS INTEGER) + 1] AS language, unnest(range(1, CAST(p_size AS BIGINT) + 1)) AS i FROM part),
  kinds AS (
    SELECT *, CASE WHEN i % 5 = 0 THEN 'blank' WHEN i % 7 = 0 THEN 'hash' WHEN i % 11 = 0 THEN 'slash' WHEN i % 16 = 1 THEN 'open' WHEN i % 16 = 4 THEN 'shut' END AS kind FROM lines WHERE language IS NOT NULL),
  within AS (
    SELECT *, language = 'Go' AND coalesce(max(i) FILTER (kind = 'open') OVER before, 0) > coalesce(max(i) FILTER (kind = 'shut') OVER before, 0) AS inside
    FROM kinds WINDOW before AS (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  marked AS (
    SELECT *, coalesce(kind = 'blank', false) AS blank,
           coalesce(kind <> 'blank', true) AND CASE WHEN language = 'Go' THEN inside OR coalesce(kind IN ('slash', 'open'), false) ELSE coalesce(kind = 'hash', false) END AS remark
    FROM within),
  counts AS (
    SELECT file, language, count(*) FILTER (blank) AS blank, count(*) FILTER (remark) AS comment, count(*) FILTER (NOT blank AND NOT remark) AS code
    FROM marked GROUP BY file, language)"""

ORACLE_SQL: dict[str, str] = {
    "authors": _sql(AUTHORS_SQL),
    "revisions": _sql(REVISIONS_SQL),
    "summary": _sql("""SELECT unnest(['number-of-commits', 'number-of-entities', 'number-of-entities-changed', 'number-of-authors']) AS statistic,
      unnest([count(DISTINCT rev), count(DISTINCT entity), count(*), count(DISTINCT author)]) AS value FROM commits"""),
    "identity": _sql("SELECT rev, date, author, entity, loc_added, loc_deleted FROM commits"),
    "abs_churn": _churn("date"),
    "author_churn": _churn("author"),
    "entity_churn": _churn("entity"),
    "entity_ownership": _sql("SELECT entity, author, CAST(sum(loc_added) AS BIGINT) AS added, CAST(sum(loc_deleted) AS BIGINT) AS deleted FROM commits GROUP BY entity, author"),
    "main_dev": _top(_sums("loc_added", "added"), "added", "total_added"),
    "refactoring_main_dev": _top(_sums("loc_deleted", "removed"), "removed", "total_removed"),
    "main_dev_by_revs": _top(f"WITH {REVS} SELECT entity, author, author_revs AS revs, total_revs FROM each JOIN every USING (entity)", "revs", "total_revs"),
    "entity_effort": _joined("", REVS, "SELECT entity, author, author_revs, total_revs FROM each JOIN every USING (entity)"),
    "fragmentation": _fragmentation(),
    "communication": _communication(),
    "age": _sql(f"""SELECT entity, greatest(0, ({NOW.year} - year(last)) * 12 + {NOW.month} - month(last)) AS age_months
      FROM (SELECT entity, CAST(max(date) AS DATE) AS last FROM commits GROUP BY entity)"""),
    "coupling": _coupling(LOOSE),
    "coupling_verbose": _coupling(Options(min_revs=1, min_shared_revs=2, min_coupling=5, verbose=True)),
    "coupling_by_type_default": _coupling(Options(), GROUPED_SQL),
    "soc": _soc(),
    "soc_by_type": _soc(GROUPED_SQL),
    "revisions_grouped": _sql(REVISIONS_SQL, GROUPED_SQL),
    "authors_team": _sql(AUTHORS_SQL, TEAMS_SQL),
    "fragmentation_team": _fragmentation(TEAMS_SQL),
    "communication_team": _communication(TEAMS_SQL),
    "log_roundtrip": _sql("SELECT rev, date, CASE WHEN starts_with(author, 'I') THEN author || '--too' ELSE author END AS author, entity, loc_added, loc_deleted FROM commits"),
    "exclude_filter": _sql(f"SELECT rev, date, author, entity, loc_added, loc_deleted FROM commits WHERE {KEPT_SQL}"),
    "exclude_lines": _sql(f"""SELECT '--' || rev || '--' || date || '--' || author AS value FROM commits UNION ALL SELECT '' FROM commits UNION ALL
      SELECT loc_added || chr(9) || loc_deleted || chr(9) || entity || [chr(13), chr(13) || chr(10), ''][loc_added % 3 + 1] FROM commits WHERE {KEPT_SQL}"""),
    "authors_team_file": _sql(AUTHORS_SQL, TEAMS_SQL),
    "revisions_group_file": _sql(REVISIONS_SQL, GROUPED_SQL),
    "csv_roundtrip": _sql(f"SELECT ['say \"', 'a, ', ' ', 'two' || chr(10) || 'lines '][length(entity) % 4 + 1] || entity AS entity, n_revs FROM ({REVISIONS_SQL})"),
    "loc_from_files": """SELECT 'src/' || replace(lower(p_brand), '#', '') || ['.go', '.py', '.yaml'][p_partkey % 4 + 1] AS file, ['Go', 'Python', 'YAML'][p_partkey % 4 + 1] AS language,
      CAST(sum(CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS blank,
      CAST(sum(CASE WHEN i % 5 <> 0 AND i % 7 = 0 AND p_partkey % 4 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS comment,
      CAST(sum(CASE WHEN i % 5 <> 0 AND (i % 7 <> 0 OR p_partkey % 4 = 0) THEN 1 ELSE 0 END) AS BIGINT) AS code
      FROM (SELECT *, unnest(range(1, CAST(p_size AS BIGINT) + 1)) AS i FROM part) WHERE p_partkey % 4 < 3 GROUP BY 1, 2""",
    "topk_revisions": _sql(REVISIONS_SQL + " ORDER BY n_revs DESC, entity LIMIT 10"),
    "loc_by_language": f"""WITH {LINES_SQL} SELECT CASE WHEN grouping(language) = 1 THEN 'TOTAL' ELSE language END AS language, count(*) AS files,
      CAST(coalesce(sum(blank), 0) AS BIGINT) AS blank, CAST(coalesce(sum(comment), 0) AS BIGINT) AS comment, CAST(coalesce(sum(code), 0) AS BIGINT) AS code
      FROM counts GROUP BY ROLLUP (language)""",
    "loc_by_file": f"WITH {LINES_SQL} SELECT file, language, blank, comment, code FROM counts WHERE NOT ends_with(file, '9.py')",
}
