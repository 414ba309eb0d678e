"""Metric-log transforms: scalar series ``(tag, step, value)``.

A metric table is tiny compared with the data it describes; the only heavy
step is deriving it from an event table, which is a partial + final
aggregate per (tag, period).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def events_as_metrics(events: DataFrame) -> DataFrame:
    """(tag, step, value): each event is one scalar of its type's series."""
    return events.select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")


def every_n(metrics: DataFrame, n: int = 100, step: str = "step") -> DataFrame:
    """Progress sampling: keep steps that are multiples of ``n``, never step 0."""
    return metrics.where((F.col(step) % F.lit(n) == 0) & (F.col(step) > 0))


def hourly_metrics(events: DataFrame, digits: int = 6) -> DataFrame:
    """(tag, epoch, value): one epoch per hour with events of the tag, value =
    the hour's mean (rounded). The epoch number is a dense rank over the
    aggregated (tag, hour) table, whose size is bounded by the time range."""
    per_hour = events.groupBy(F.col("event_type").alias("tag"), F.date_trunc("hour", "ts").alias("hr")) \
        .agg(F.round(F.avg("value"), digits).alias("value"))
    w = Window.partitionBy("tag").orderBy("hr")
    return per_hour.select("tag", F.dense_rank().over(w).cast("long").alias("epoch"), "value")
