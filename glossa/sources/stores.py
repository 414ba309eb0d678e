"""Stores: vocabulary, prepared data sets, models and the metric log.

Everything is Parquet (or Spark ML's own model format) under a caller-given
root on shared storage.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, **params) -> str:
    """Identity of a fit: the content of its input plus the fit parameters.
    The content enters as the number of rows and two order-free sums of row
    hashes, one aggregation; changed, added or overwritten rows give a new id,
    so a stored vocabulary is never silently reused for different data."""
    rows = df.select(F.xxhash64(*df.columns).alias("h"))
    seen = rows.agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    payload = json.dumps({"rows": [str(x) for x in seen], "columns": df.dtypes, "params": params}, sort_keys=True, default=str)
    return hashlib.md5(payload.encode()).hexdigest()[:16]


def vocab_store(spark: SparkSession, root: str, dataset: str, fit_id: str, fit) -> tuple[DataFrame, bool]:
    """Reuse the vocabulary stored for ``(dataset, fit_id)`` or fit (``fit()``
    returns the DataFrame) and store it. Returns ``(vocab, reused)``."""
    path = f"{root.rstrip('/')}/vocab/dataset={dataset}/fit_id={fit_id}"
    stored = _published(spark, path)
    if stored is not None:
        return spark.read.parquet(stored), True
    data = f"{path}/data-{uuid.uuid4().hex[:12]}"
    fit().write.parquet(data)
    spark.createDataFrame([(data,)], "data string").coalesce(1).write.mode("overwrite").parquet(f"{path}/current")
    return spark.read.parquet(data), False


def _published(spark: SparkSession, path: str) -> str | None:
    """The folder of a finished write. It is named only after the data is
    whole, so what a failed write left behind is never read."""
    try:
        row = spark.read.schema("data string").parquet(f"{path}/current").first()
    except AnalysisException:  # nothing was ever written
        return None
    return row["data"] if row else None


def write_prepared(df: DataFrame, path: str) -> None:
    """Prepared set, one folder per split (partition pruning on read). Rows are
    rebalanced by split first: few files of the advisory size, large splits divided."""
    df.hint("rebalance", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def read_prepared(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read a prepared set; a missing path raises ``AnalysisException``."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


METRIC_SCHEMA = "run_id string, tag string, step bigint, value double"


def append_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """Append ``(tag, step, value)`` scalars of one run to the metric log."""
    (metrics.select(F.lit(run_id).alias("run_id"), F.col("tag").cast("string"), F.col("step").cast("long"),
                    F.col("value").cast("double"))
     .write.mode("append").partitionBy("run_id").parquet(path))


def read_metrics(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(F.col("run_id") == run_id) if run_id else df
    return df.select("run_id", "tag", "step", "value")
