"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.session import scratch_path
from glossa.sources.tables import path_of

# Text handled at once by a Python kernel; a larger single text is one slice.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(path_of(sf_dir, name))


# Spark's own setting: a finished write's shuffle files go at once, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def landed(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to a fresh folder beside ``spark.checkpoint.dir`` (shared
    on a cluster) and read it back: cuts lineage, survives lost executors.
    ``codec`` ``zstd`` is for texts: a third smaller, a little slower."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.landed_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Empty the folders of landed steps that nothing reads any more (whatever
    was made from them must be landed as well)."""
    for step in steps:
        step.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(step.landed_at)


def text_bytes(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column, null as empty (no copy of the data)."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"")


def slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes each, covering every row."""
    n = len(texts)
    if n == 0:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    start, base = 0, 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])


def fold(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the key written as text, modulo ``folds`` (null key: fold 0)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def is_held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def null_safe(df: DataFrame) -> DataFrame:
    """``df`` with ``_k`` and ``_null``: equal where its column ``key`` is, nulls included."""
    return df.withColumn("_k", F.coalesce(F.col("key").cast("string"), F.lit(""))).withColumn("_null", F.col("key").isNull())
