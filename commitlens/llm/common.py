"""What the operators share: tables, shared storage, row-wise Arrow functions and span digests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.sources.storage import shared_dir

#: Rows that a function sees at once. Texts can be long, so these are few; Spark's own batches are bounded in bytes.
BATCH_ROWS = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, without a session setting that other queries would share."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tables that ``cut`` wrote and nothing has released, oldest first.
CUT: list[DataFrame] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder: a lost executor costs no lineage.

    checkpoint() would compute it twice, once to count and once to write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.cut_path = path
    CUT.append(kept)
    return kept


def release(kept: DataFrame) -> None:
    """Delete the files of a table from ``cut`` that nothing reads any more."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    CUT[:] = [other for other in CUT if other is not kept]


def only(make: Callable[[], DataFrame]) -> DataFrame:
    """``cut(make())``, and what was cut on the way to it released."""
    before = len(CUT)
    kept = cut(make())
    for other in CUT[before:-1]:
        release(other)
    return kept


def per_batch(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``make()``, called once a task, gives a function from a batch's columns (lists) to an iterable of rows."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in slices(batches):
            f = f or make()
            rows = list(f([c.to_pylist() for c in batch.columns]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def per_text(docs: DataFrame, make: Callable[[], Callable], keep: bool = False) -> DataFrame:
    """``docs`` with new texts, or (``keep``) those of its rows whose text is to stay; other columns pass untouched.

    ``make()``, called once a task, gives a function from a batch's texts to new texts or to booleans.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in slices(batches):
            f = f or make()
            field, out = batch.schema.field(at), f(batch.column(at).to_pylist())
            yield batch.filter(pa.array(out, pa.bool_())) if keep else batch.set_column(at, field, pa.array(out, field.type))

    return docs.mapInArrow(run, docs.schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def span_text(spans: Iterable[tuple[str, int, int]], order: dict[str, int]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, other letters left as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
