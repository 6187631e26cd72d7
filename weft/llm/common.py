"""What the operators share: written tables and checked broadcasts, batches for Python, words and folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.lineage import broadcast_if_small, session_conf, shared_dir, shared_path, small, table

__all__ = ["broadcast_if_small", "fold", "lower_az", "map_batches", "read", "session_conf", "shared_dir", "shared_path", "small", "small_batches", "strings", "table", "utf8"]

#: Rows in one batch handed to Python; texts may be very long.
BATCH_ROWS = 1000

#: Maps A-Z to a-z and leaves every other byte; bytes of UTF-8 sequences are never in A-Z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that are parted by white space of ASCII, for the JVM's regular expressions.
SPACED_WORD = "[^\\x20\\x09-\\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, unless the session asks for less already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """A narrow pass in Python: f turns a batch of rows into columns of the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    small_batches(df.sparkSession)
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(kind)
        for batch in batches:
            out = f(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=into.field(n).type) for n in names], schema=into)

    return df.mapInArrow(run, kind)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null becomes empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """A string column; null becomes empty."""
    return [s or "" for s in column.to_pylist()]


def fold(column: str, n: int) -> F.Column:
    """crc32 of a column's text, modulo n; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def lower_az(column: str | F.Column) -> F.Column:
    return F.translate(column, UPPER_AZ, LOWER_AZ)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

