"""Reading the corpus tables.

Parquet is read with Spark's own scan, so column pruning and pushed filters
reach the files. The only addition is a parallelism floor: a table stored as a
handful of large row groups (small test corpora) would otherwise be processed
by a handful of tasks. When the scan has fewer partitions than the cluster's
default parallelism the rows are spread round-robin; on a large corpus the scan
already has far more partitions than cores and nothing is added.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Text-heavy tables whose per-row work (regex split, explode) dominates, with
# their unique key; these get the parallelism floor. Others are left as scanned.
_SPREAD = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def path_of(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def with_parallelism_floor(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a scan with fewer partitions than the default parallelism.
    Hashing on the unique key spreads evenly and is deterministic without the
    local sort a round-robin repartition needs. (``df.rdd`` is taken on the
    bare scan only, so no job runs.)"""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    if n < target:
        return df.repartition(target, key) if key else df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path_of(sf_dir, name))
    if columns:
        df = df.select(*columns)
    if name in _SPREAD:
        key = _SPREAD[name]
        df = with_parallelism_floor(df, key if key in df.columns else None)
    return df


def documents(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return read_table(spark, sf_dir, "documents", columns or ["doc_id", "text", "lang"])


def labelled_corpus(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """Canonical ``(doc_id, label, text)`` corpus.

    ``label='lang'`` labels every document with its language (4 classes);
    ``label='quality'`` / ``'toxic'`` take the binary label from ``labels``
    (inner join: only labelled documents).
    """
    if label in ("quality", "toxic"):
        lab = read_table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
        docs = documents(spark, sf_dir, ["doc_id", "text"])
        return docs.join(lab, "doc_id").select("doc_id", "label", "text")
    docs = documents(spark, sf_dir, ["doc_id", "text", label])
    return docs.select("doc_id", F.col(label).alias("label"), "text")
