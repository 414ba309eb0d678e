"""Class dictionary, class codes and one-hot targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.labels import one_hot
from glossa.operators.joins import bounded_broadcast


def class_table(corpus: DataFrame, label: str = "label") -> DataFrame:
    """(code, label, n_classes): distinct labels in their typed order
    (numbers numerically, so 10 sorts after 9), codes from 0.

    The distinct is a partial + final aggregate; the numbering window runs
    over the distinct labels only (the class dimension), never the corpus.
    """
    distinct = corpus.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    w = Window.orderBy("label")
    return distinct.select(
        (F.dense_rank().over(w) - 1).cast("int").alias("code"), "label",
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).cast("int").alias("n_classes"))


def attach_codes(corpus: DataFrame, classes: DataFrame, label: str = "label",
                 with_one_hot: bool = True) -> DataFrame:
    """Add ``code`` (null for a missing label) and ``one_hot`` by joining the
    class table, broadcast only after its size was measured."""
    cls = bounded_broadcast(classes.select(F.col("label").alias("_cls_label"), "code", "n_classes"))
    out = corpus.join(cls, corpus[label].eqNullSafe(F.col("_cls_label")), "left").drop("_cls_label")
    if with_one_hot:
        out = out.withColumn("one_hot", F.when(F.col("code").isNotNull(), one_hot("code", "n_classes")))
    return out


def class_balance(coded: DataFrame) -> DataFrame:
    """(code, label, n): stratum sizes (partial aggregation before the shuffle)."""
    return coded.groupBy("code", "label").agg(F.count(F.lit(1)).alias("n"))
