"""Distributed ranking helpers.

An unpartitioned window (``row_number() over (order by ...)``) moves every row
into one task. These helpers give the same numbers while keeping the work
spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import materialize


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rn",
                      total: str | None = None) -> DataFrame:
    """1-based row number under a total order, computed without a single-task window.

    Plan: a range-partitioned sort (distributed), tag each row with its sort
    partition and ``monotonically_increasing_id`` (contiguous inside a
    partition), cut lineage with a reliable checkpoint so a lost executor can
    not re-sample the range bounds under different numbers, count rows per
    partition (one row per partition, so the offset table is bounded by the
    partition count and safe to broadcast), and add the prefix offset.
    ``order`` must be a total order for the numbering to be deterministic.
    """
    tagged = df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_gr_p"), F.monotonically_increasing_id().alias("_gr_m"))
    tagged = materialize(tagged)
    stats = tagged.groupBy("_gr_p").agg(F.count(F.lit(1)).alias("_gr_n"), F.min("_gr_m").alias("_gr_0"))
    prior = Window.orderBy("_gr_p").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = stats.select("_gr_p", "_gr_0", F.coalesce(F.sum("_gr_n").over(prior), F.lit(0)).alias("_gr_off"),
                           F.sum("_gr_n").over(everything).alias("_gr_tot"))
    out = tagged.join(F.broadcast(offsets), "_gr_p").withColumn(
        name, F.col("_gr_off") + F.col("_gr_m") - F.col("_gr_0") + F.lit(1))
    if total:
        out = out.withColumn(total, F.col("_gr_tot"))
    return out.drop("_gr_p", "_gr_m", "_gr_0", "_gr_off", "_gr_tot")


def grouped_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn",
                       total: str | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by ...)`` for FEW, LARGE groups.

    A window partitioned by a class label puts a whole class (possibly a third
    of the corpus) into one task. Here the rows are range-sorted by
    ``(keys, order)`` across all partitions, and each row's number is its
    offset inside its sort partition plus the rows of the same group in earlier
    partitions. The per-(partition, group) count table has at most
    ``partitions + groups`` rows (groups are contiguous in a sort), so it is
    bounded when the number of groups is (a class table), and is broadcast.
    For many small groups (per document) use an ordinary window instead.
    """
    keys = list(keys)
    tagged = df.orderBy(*[F.col(k) for k in keys], *order).select(
        "*", F.spark_partition_id().alias("_gr_p"), F.monotonically_increasing_id().alias("_gr_m"))
    tagged = materialize(tagged)
    stats = tagged.groupBy("_gr_p", *keys).agg(F.count(F.lit(1)).alias("_gr_n"), F.min("_gr_m").alias("_gr_0"))
    prior = Window.partitionBy(*keys).orderBy("_gr_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = stats.select("_gr_p", *keys, "_gr_0",
                           F.coalesce(F.sum("_gr_n").over(prior), F.lit(0)).alias("_gr_off"),
                           F.sum("_gr_n").over(whole).alias("_gr_tot"))
    # null-safe on the group keys: a null label is its own group, never dropped
    renamed = offsets.select(F.col("_gr_p").alias("_gr_q"), *[F.col(k).alias(f"_gr_k{i}") for i, k in enumerate(keys)],
                             "_gr_0", "_gr_off", "_gr_tot")
    cond = [F.col("_gr_p") == F.col("_gr_q")] + [F.col(k).eqNullSafe(F.col(f"_gr_k{i}")) for i, k in enumerate(keys)]
    out = tagged.join(F.broadcast(renamed), cond).withColumn(
        name, F.col("_gr_off") + F.col("_gr_m") - F.col("_gr_0") + F.lit(1))
    if total:
        out = out.withColumn(total, F.col("_gr_tot"))
    return out.drop("_gr_p", "_gr_q", "_gr_m", "_gr_0", "_gr_off", "_gr_tot", *[f"_gr_k{i}" for i in range(len(keys))])


# Largest number of rows the final merge of a TakeOrdered may receive
# (k rows from every input partition meet in one task).
MAX_TAKE_ORDERED_ROWS = 5_000_000


def top_k_ranked(df: DataFrame, order: Sequence[Column], k: int, name: str = "rn",
                 partitions: int | None = None) -> DataFrame:
    """The first ``k`` rows under ``order`` with their rank.

    ``orderBy().limit(k)`` plans as a TakeOrdered: each task keeps its own top
    k and one task merges ``k x partitions`` rows. That is used only while the
    merge stays under :data:`MAX_TAKE_ORDERED_ROWS`; a large ``k`` over many
    partitions takes the distributed :func:`global_row_number` and a filter.
    ``partitions`` is the input's partition count; by default the session's
    shuffle partition count (the input is an aggregate's output). It is never
    read from the plan, which under adaptive execution would run the shuffle.
    """
    if k <= 0:
        return df.limit(0).withColumn(name, F.lit(None).cast("long"))
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if k * partitions > MAX_TAKE_ORDERED_ROWS:
        return global_row_number(df, order, name).where(F.col(name) <= k)
    top = df.orderBy(*order).limit(k)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
