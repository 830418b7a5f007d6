"""Producers that ask git on the driver: the log text and the list of tracked files."""

from __future__ import annotations

import io
import os
import re
import subprocess
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.functions.patterns import path_regex
from commitlens.sources.storage import shared_dir

#: Characters with a meaning in Spark's input paths.
GLOB = re.compile(r"([\\{}\[\]*?^])")

#: The end of a text in Java's patterns and in Python's.
JAVA_END, PYTHON_END = r"\z", r"\Z"
LOG = ("log", "--all", "--numstat", "--date=short", "--pretty=format:--%h--%ad--%aN", "--no-renames")


def kept_lines(lines: Iterable[str], patterns: list[str]) -> Iterator[str]:
    """Log lines, ends included, without those of excluded files."""
    whole = path_regex(patterns)
    file_line = re.compile(rf"[^\t]*\t[^\t]*\t{whole.replace(JAVA_END, PYTHON_END)}") if whole else None
    for line in lines:
        if not file_line or not file_line.fullmatch(line.rstrip("\r\n")):
            yield line


def git_log(path: str = ".", after: str = "", excludes: list[str] | None = None) -> Iterator[str]:
    """The lines of a repository's log, streamed as git writes them; git's own words on failure."""
    command = ["git", "-C", path, *LOG, *([f"--after={after}"] if after else [])]
    with tempfile.TemporaryFile() as said, subprocess.Popen(command, stdout=subprocess.PIPE, stderr=said) as run:
        yield from kept_lines(io.TextIOWrapper(run.stdout, "utf-8", "surrogateescape", newline="\n"), excludes or [])
        if run.wait():
            said.seek(0)
            raise RuntimeError(f"{said.read().decode('utf-8', 'replace').strip()}\n(status {run.returncode} of: {' '.join(command)})")


def _git(path: str, *command: str) -> str:
    run = subprocess.run(["git", "-C", path, *command], capture_output=True, text=True, encoding="utf-8", errors="surrogateescape")
    if run.returncode:
        raise RuntimeError(f"git {command[0]} failed: {run.stderr.strip()}")
    return run.stdout


def tracked_files(path: str = ".") -> tuple[list[str], str]:
    """The tracked files of the whole repository that holds ``path``, relative to its root; and the root."""
    root = _git(path, "rev-parse", "--show-toplevel").rstrip("\n")
    names = [n for n in _git(root, "ls-files", "-z").split("\0") if n]
    if not names:
        raise RuntimeError(f"git tracks nothing in {path}")
    return names, root


def tracked_texts(spark: SparkSession, path: str = ".") -> DataFrame:
    """file (relative to the root) and text of each tracked file that is text; Spark reads them in parallel.

    A checkout is on the driver's disk: away from a local session it is first copied to the folder that executors share.
    """
    names, root = tracked_files(path)
    there = [n for n in names if os.path.isfile(f"{root}/{n}")]
    top = f"file://{root}"
    if not spark.sparkContext.master.startswith("local"):
        top = f"{shared_dir(spark)}/checkout-{uuid.uuid4().hex}"
        java = spark._jvm.org.apache.hadoop.fs.Path
        files = java(top).getFileSystem(spark._jsc.hadoopConfiguration())
        for n in there:
            files.copyFromLocalFile(java(f"file://{root}/{n}"), java(f"{top}/{n}"))
    return texts_under(spark, top, there)


def texts_under(spark: SparkSession, top: str, names: list[str] | None = None) -> DataFrame:
    """file (relative to ``top``) and text of the named files, or of all, wherever Spark can read; files that hold a zero byte early on aren't text."""
    if names == []:
        return spark.createDataFrame([], "file string, text string")
    paths = [top] if names is None else [f"{top}/{GLOB.sub(r'\\\1', n)}" for n in names]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", names is None).load(paths)
    text = found.filter(~F.contains(F.substring("content", 1, 8000), F.lit(bytes(1))))
    return text.select(relative(F.col("path"), top).alias("file"), F.col("content").cast("string").alias("text"))


def relative(path: str | Column, top: str) -> Column:
    """What stands after ``top`` in a path; other paths stay as they are. The scheme's slashes may be written in several ways."""
    path, scheme = F.col(path) if isinstance(path, str) else path, r"^[a-z][a-z0-9+.-]*:/*(?=/)"
    bare, under = F.regexp_replace(path, scheme, ""), re.sub(scheme, "", top).rstrip("/") + "/"
    return F.when(bare.startswith(under), F.substring(bare, len(under) + 1, 1 << 30)).otherwise(path)
