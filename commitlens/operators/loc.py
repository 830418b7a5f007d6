"""Line counts: blank, comment and code lines of files, by file and by language."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.operators.transforms import is_excluded

C_STYLE = (("//",), "/*", "*/")
HASH = (("#",), "", "")
MARKUP = ((), "<!--", "-->")
#: Language, file name ends (whole names without a dot), line comments, block comment.
LANGUAGES = (
    ("Go", (".go",), *C_STYLE), ("C", (".c",), *C_STYLE), ("C Header", (".h",), *C_STYLE), ("C++", (".cc", ".cpp", ".cxx"), *C_STYLE),
    ("C#", (".cs",), *C_STYLE), ("Java", (".java",), *C_STYLE), ("JavaScript", (".js", ".mjs"), *C_STYLE), ("TypeScript", (".ts",), *C_STYLE),
    ("Kotlin", (".kt",), *C_STYLE), ("Scala", (".scala",), *C_STYLE), ("Rust", (".rs",), *C_STYLE), ("Swift", (".swift",), *C_STYLE),
    ("Protocol Buffers", (".proto",), *C_STYLE), ("PHP", (".php",), ("#", "//"), "/*", "*/"), ("CSS", (".css",), (), "/*", "*/"),
    ("Python", (".py",), ("#",), '"""', '"""'), ("Ruby", (".rb",), ("#",), "=begin", "=end"), ("Perl", (".pl", ".pm"), ("#",), "=", "=cut"),
    ("BASH", (".sh", ".bash"), *HASH), ("YAML", (".yml", ".yaml"), *HASH), ("TOML", (".toml",), *HASH), ("R", (".r", ".R"), *HASH),
    ("Makefile", (".mk", "Makefile", "makefile"), *HASH), ("Dockerfile", ("Dockerfile",), *HASH), ("CMake", (".cmake", "CMakeLists.txt"), *HASH),
    ("SQL", (".sql",), ("--",), "/*", "*/"), ("Lua", (".lua",), ("--",), "--[[", "]]"), ("Haskell", (".hs",), ("--",), "{-", "-}"),
    ("HTML", (".html", ".htm"), *MARKUP), ("XML", (".xml",), *MARKUP), ("Markdown", (".md",), *MARKUP), ("JSON", (".json",), (), "", ""),
)


def language_of(file: str | Column) -> Column:
    """The language by a file's whole name, or by what its last dot begins; null if neither is known."""
    name = F.substring_index(file, "/", -1)
    known = F.create_map(*(F.lit(x) for language, ends, *_ in LANGUAGES for end in ends for x in (end, language)))
    ending = F.concat(F.lit("."), F.substring_index(name, ".", -1))
    return F.coalesce(F.try_element_at(known, name), F.when(name.contains("."), F.try_element_at(known, ending)))


def unknown_files(files: DataFrame) -> DataFrame:
    """The rows of ``files`` that ``count_lines`` leaves out."""
    return files.filter(language_of("file").isNull())


def count_lines(files: DataFrame) -> DataFrame:
    """file, language, blank, comment, code for each row of ``files`` (file, text) in a known language.

    The lines of a file are folded with whether a block comment is open; a file is one row, whatever its size.
    """
    named = files.withColumn("language", language_of("file")).filter("language is not null")
    entries = ((language, F.struct(F.array(*map(F.lit, lines)).cast("array<string>").alias("line"), F.lit(begin).alias("begin"), F.lit(end).alias("end"))) for language, _, lines, begin, end in LANGUAGES)
    marks = F.try_element_at(F.create_map(*(x for language, entry in entries for x in (F.lit(language), entry))), F.col("language"))
    ended = F.regexp_replace("text", r"\n\z", "")
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split(ended, "\n"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(False).alias("open"), zero.alias("blank"), zero.alias("comment"), zero.alias("code"))

    def step(s: Column, raw: Column) -> Column:
        line, m = F.regexp_replace(raw, r"^\s+|\s+$", ""), F.col("marks")
        one = lambda c: c.cast("bigint")
        begins = (m["begin"] != "") & line.startswith(m["begin"])
        opens = begins & ~F.substr(line, F.length(m["begin"]) + 1).contains(m["end"])
        blank = line == ""
        remark = ~blank & (s["open"] | begins | F.exists(m["line"], lambda x: line.startswith(x)))
        still = F.when(s["open"], ~line.contains(m["end"])).otherwise(opens)
        return F.struct(still.alias("open"), (s["blank"] + one(blank)).alias("blank"), (s["comment"] + one(remark)).alias("comment"), (s["code"] + one(~blank & ~remark)).alias("code"))

    counted = named.select("file", "language", marks.alias("marks"), lines.alias("lines")).withColumn("n", F.aggregate("lines", start, step))
    return counted.select("file", "language", "n.blank", "n.comment", "n.code")


def exclude_files(counts: DataFrame, patterns: list[str]) -> DataFrame:
    return counts.filter(~is_excluded("file", patterns)) if patterns else counts


def by_language(counts: DataFrame) -> DataFrame:
    """Sums by language and, as TOTAL (``is_total`` 1), of all; without files the total alone."""
    sums = [F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blank", "comment", "code"))]
    return counts.rollup("language").agg(F.grouping("language").cast("int").alias("is_total"), *sums).withColumn(
        "language", F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col("language"))
    )


def by_file(counts: DataFrame) -> DataFrame:
    return counts.select("file", "language", "blank", "comment", "code")
