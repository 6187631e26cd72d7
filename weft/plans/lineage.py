"""Written tables between the steps of iterative plans, and joins that check a side's size before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []

#: Rows, and bytes of them as text, up to which a side is broadcast where its size was checked.
MOST_BROADCAST, MOST_BYTES = 200_000, 32_000_000
#: How many times smaller than in memory a written table is taken to be at most.
PACKED = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset and all runs in one process, as in tests, one is made."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weft-shared-"))
        found = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It stays until discard(), as results that are not yet computed may read it."""
    _made.append(f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(spark: SparkSession) -> None:
    """Deletes all that this process has written to the shared folder: for when no result that reads it is needed any more."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(hadoop).delete(path, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor then costs a read, not the work before it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def file_bytes(spark: SparkSession, path: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


@contextmanager
def session_conf(spark: SparkSession, given: dict[str, str]) -> Iterator[None]:
    """Settings for what is run inside (not for what is only planned there); afterwards they are what they were."""
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small(df: DataFrame, most: int = MOST_BROADCAST, most_bytes: int = MOST_BYTES) -> bool:
    """Whether df has no more than `most` rows, and these no more than so many bytes; it reads no more than it needs for that.

    A written table that takes a small part of these bytes in its files is not read at all.
    """
    path = getattr(df, "_weft_path", None)
    if path and most and file_bytes(df.sparkSession, path) <= min(most_bytes // PACKED, 8 * most):
        return True
    wide = [c for c in df.columns if df.schema[c].dataType.typeName() not in ("long", "integer", "double", "boolean", "short", "byte", "float")]
    size = F.lit(8 * (len(df.columns) - len(wide)))
    for c in wide:
        plain = df.schema[c].dataType.typeName() in ("string", "binary")
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`") if plain else F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) + 8
    n, held = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= most and held <= most_bytes


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df with a hint to broadcast it if it is small; else as it is, for a shuffled join. Give written tables: df is run for it."""
    return F.broadcast(df) if small(df, most, most_bytes) else df
