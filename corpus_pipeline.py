"""Training-corpus pipeline: stages over the ``documents`` table.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and calls one operator of
``tillrec.llm``; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillrec.llm.common import table
from tillrec.llm.decontaminate import decontaminated
from tillrec.llm.mixing import mixed_documents
from tillrec.llm.quality import good_documents
from tillrec.llm.sharding import shard_by_bytes
from tillrec.llm.simhash import one_of_each
from tillrec.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers keep."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return one_of_each(docs, shingle=4, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weighted-fair-queueing mix takes them."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their place in eight byte-balanced shards."""
    return shard_by_bytes(docs, n_shards=8, carry=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The quality, fingerprint and automaton stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and
    read again.  A stage's files go when the next one has been written; those
    that the result reads stay."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/{k}-{name}"
        out.write.parquet(path)
        if read:
            _remove(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs
