"""From documents to a training mix, in stages; each is written as Parquet and read again as the next one's documents.

All stages but the last keep the columns of documents. Documents that are toxic go; of each group of near copies (a
Jaccard similarity of 5-word shingles of 0.8 or more, also through others) one stays, the least doc_id; documents that hold a benchmark passage go; secrets are replaced by a mark (and n_chars is counted
again); then sources are mixed to their targets: a row for each repetition taken, with repeat (from 0) and words, and of a
source's last document only as many words as are missing. Extra columns pass through; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, mixing, nearcopies, secrets, toxicity
from weft.llm.common import read, shared_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").filter(~toxicity.held_out())
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repetitions(mixing.mix(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near-dedup", without_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

#: SQL cannot express the model stages; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
