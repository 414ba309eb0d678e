"""Evaluation metrics over a ``(label, pred[, probability])`` table.

Every metric starts with an aggregate that collapses the scored rows to at
most ``n_classes x n_classes`` confusion cells (partial aggregation in each
task), so everything after the first shuffle runs on a table whose size is
bounded by the class count, not the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import vectors as VX
from glossa.operators.ranking import global_row_number
from glossa.session import materialize


def confusion(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(label, pred, n) over rows with a label."""
    return (scored.where(F.col(label).isNotNull())
            .groupBy(F.col(label).alias("label"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def accuracy(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row: (n, correct, accuracy)."""
    s = scored.where(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum((F.col(label) == F.col(pred)).cast("long")), F.lit(0)).cast("long").alias("correct"))
    return s.select("n", "correct", F.round(F.try_divide(F.col("correct").cast("double"), F.col("n")), 6).alias("accuracy"))


def _safe_ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def classification_report(scored: DataFrame, label: str = "label", pred: str = "pred",
                          digits: int = 6) -> DataFrame:
    """(row, precision, recall, f1, support): one row per class present in
    labels or predictions (``row`` = the class as text), then ``accuracy``
    (value in ``f1``), ``macro avg`` and ``weighted avg`` (by support).
    Undefined ratios are 0; a class never predicted still counts in the macro
    average."""
    # one pass over the scored rows; everything below runs on <= n_classes^2
    # checkpointed cells (the four report branches never re-read the data)
    cm = materialize(confusion(scored, label, pred))
    by_label = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    by_pred = cm.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = cm.where(F.col("label") == F.col("pred")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    per = (by_label.join(by_pred, "cls", "full").join(tp, "cls", "left")
           .select("cls", F.coalesce("support", F.lit(0)).cast("long").alias("support"),
                   F.coalesce("predicted", F.lit(0)).alias("predicted"), F.coalesce("tp", F.lit(0)).alias("tp")))
    per = per.select("cls", "support", _safe_ratio(F.col("tp"), F.col("predicted")).alias("precision"),
                     _safe_ratio(F.col("tp"), F.col("support")).alias("recall"), "tp")
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                       F.col("precision") + F.col("recall")), F.lit(0.0)))
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(F.col("f1")))
    totals = per.agg(F.sum("support").alias("total"), F.sum("tp").alias("correct"), F.count(F.lit(1)).alias("k"),
                     F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1").alias("sf"),
                     F.sum(F.col("precision") * F.col("support")).alias("wp"),
                     F.sum(F.col("recall") * F.col("support")).alias("wr"),
                     F.sum(F.col("f1") * F.col("support")).alias("wf"))
    from pyspark.sql.types import DoubleType, FloatType

    cls = F.col("cls").cast("string")
    if isinstance(per.schema["cls"].dataType, (DoubleType, FloatType)):  # model output: 2.0 -> "2"
        c = F.col("cls")
        cls = F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    rows = per.select(cls.alias("row"), "precision", "recall", "f1", "support")
    acc = totals.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"),
                        _safe_ratio(F.col("correct"), F.col("total")).alias("f1"),
                        F.col("total").cast("long").alias("support"))
    macro = totals.select(F.lit("macro avg").alias("row"), (F.col("sp") / F.col("k")).alias("precision"),
                          (F.col("sr") / F.col("k")).alias("recall"), (F.col("sf") / F.col("k")).alias("f1"),
                          F.col("total").cast("long").alias("support"))
    weighted = totals.select(F.lit("weighted avg").alias("row"), _safe_ratio(F.col("wp"), F.col("total")).alias("precision"),
                             _safe_ratio(F.col("wr"), F.col("total")).alias("recall"),
                             _safe_ratio(F.col("wf"), F.col("total")).alias("f1"),
                             F.col("total").cast("long").alias("support"))
    out = rows.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("row", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")


def mean_log_loss(scored: DataFrame, prob: str = "probability", label: str = "label") -> DataFrame:
    """One row: (n, log_loss) = mean over rows of ``-ln p[label]`` (clipped)."""
    s = scored.where(F.col(label).isNotNull()).select(VX.cross_entropy(prob, label).alias("_l"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_l"), 6).alias("log_loss"))


def batched_log_loss(scored: DataFrame, batch_size: int, order: str = "doc_id",
                     prob: str = "probability", label: str = "label") -> DataFrame:
    """One row: (n_batches, log_loss) = mean of per-batch mean losses, rows
    batched in ``order`` (the last, shorter batch weighs as much as a full one).
    The batch number comes from the distributed global rank."""
    s = scored.where(F.col(label).isNotNull()).select(order, VX.cross_entropy(prob, label).alias("_l"))
    ranked = global_row_number(s, [F.col(order)], "_rn")
    per = ranked.groupBy(F.floor((F.col("_rn") - 1) / F.lit(batch_size)).alias("_b")).agg(F.avg("_l").alias("_bl"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.round(F.avg("_bl"), 6).alias("log_loss"))


def mean_kl(df: DataFrame, t: str, q: str, literal: bool = False) -> DataFrame:
    f = VX.kl_divergence_literal if literal else VX.kl_divergence
    return df.select(f(t, q).alias("_kl")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_kl"), 6).alias("kl"))


def early_stop(metrics: DataFrame, patience: int = 4, key: str = "tag", step: str = "epoch",
               value: str = "value") -> DataFrame:
    """(tag, best_epoch, best_value, stop_epoch) per series: stop at the first
    epoch whose value has not improved on the best so far for ``patience``
    epochs (null: never stopped); best = first epoch with the maximum value up
    to the stop. What a series does after its stop is not seen.

    Windows are partitioned by series; one training series is a few hundred
    epochs, so each window partition is small."""
    w_prev = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    w_cum = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    m = metrics.select(key, step, value).withColumn("_prev_best", F.max(value).over(w_prev))
    m = m.withColumn("_improved", F.col("_prev_best").isNull() | (F.col(value) > F.col("_prev_best")))
    m = m.withColumn("_last_imp", F.max(F.when(F.col("_improved"), F.col(step))).over(w_cum))
    m = m.withColumn("_since", F.col(step) - F.col("_last_imp"))
    stop = F.min(F.when(F.col("_since") >= patience, F.col(step))).over(Window.partitionBy(key))
    m = m.withColumn("stop_epoch", stop).where(F.col("stop_epoch").isNull() | (F.col(step) <= F.col("stop_epoch")))
    return m.groupBy(key).agg(
        F.min_by(step, F.struct(-F.col(value), F.col(step))).alias("best_epoch"),
        F.max(value).alias("best_value"),
        F.max("stop_epoch").alias("stop_epoch"))
