"""CSV sinks: one file or stream, header first, rows in the frame's order."""

from __future__ import annotations

import io
import re
import sys
from typing import TextIO

from pyspark.sql import DataFrame


def quoted(field: str) -> str:
    """A field in quotes where it needs them: separators, quotes, line ends, a leading space, or ``\\.`` alone."""
    needs = field == r"\." or any(c in field for c in ',"\r\n') or field[:1].isspace()
    return '"' + field.replace('"', '""') + '"' if needs else field


def write_csv(report: DataFrame, to: TextIO | None = None) -> None:
    """Partitions come to the driver one at a time, so a long report needs no more memory than its largest."""
    to = to or sys.stdout
    to.write(",".join(map(quoted, report.columns)) + "\n")
    for row in report.toLocalIterator():
        to.write(",".join(quoted("" if v is None else v) for v in row) + "\n")


class _Store(io.RawIOBase):
    """A new file in any store that Spark knows."""

    def __init__(self, report: DataFrame, uri: str) -> None:
        spark = report.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        self.out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:  # noqa: ANN001
        self.out.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.out.close()
        super().close()


def write_csv_file(report: DataFrame, path: str) -> None:
    """To a path on the driver's disk, or a uri of any store that Spark knows."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        with io.TextIOWrapper(io.BufferedWriter(_Store(report, path), 1 << 20), "utf-8", "surrogateescape", newline="") as to:
            write_csv(report, to)
        return
    with open(path, "w", encoding="utf-8", errors="surrogateescape", newline="") as to:
        write_csv(report, to)
