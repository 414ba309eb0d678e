"""Staged training: one distributed gradient step an epoch, with validation,
early stopping, restoring the best epoch, and going on after a kill.

The model is a softmax regression on which vocabulary words a document has
(a row of unit length). An epoch is one step of gradient descent over all
training rows, from the coefficients of the epoch before (warm start):

* scoring is map-only: the coefficients, ``(max_features + 1) x classes`` doubles and
  never more than :data:`MAX_PARAMETERS`, travel as one broadcast row;
* the gradient is one aggregation by word id with map-side combine, so a word
  that every document has reaches its reducer as one row a task.

Documents are never shuffled after :func:`document_features`. Each epoch's
coefficients are written to ``{path}/weights/epoch=k``, then its metrics to
``{path}/history/epoch=k``: an epoch counts once its metrics are there. A killed
run repeats at most the epoch it was in; with lost executors Spark repeats tasks.

Defined results: rows without a label (``code`` null) train and validate
nothing; a document without known words is scored by the class biases; without
training rows the coefficients stay zero; without validation rows the metrics
are null, nothing improves and the first epoch is the best one. Ties of the
best scores go to the first class, ties of the best epochs to the first epoch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import metrics as MT
from glossa.operators.joins import bounded_broadcast
from glossa.session import materialize

MAX_PARAMETERS = 16 << 20  # doubles in the broadcast row: 128 MB
MONITOR = "val_accuracy"
_HISTORY = "tag string, value double, params string, epoch int"


def document_features(docs: DataFrame, tokens: DataFrame, vocab: DataFrame, carry: list[str]) -> DataFrame:
    """``(doc_id, *carry, idx)``: the ids, ascending, of the vocabulary words that each document has."""
    known = tokens.join(bounded_broadcast(vocab.select("word", "idx")), "word").groupBy("doc_id").agg(
        F.sort_array(F.collect_set("idx")).alias("idx"))
    return docs.select("doc_id", *carry).join(known, "doc_id", "left").select(
        "doc_id", *carry, F.coalesce("idx", F.array().cast("array<int>")).alias("idx"))


def _scale() -> Column:
    """What makes a document's row of ones one of unit length."""
    return F.lit(1.0) / F.sqrt(F.greatest(F.size("idx"), F.lit(1)).cast("double"))


def _parameter_row(weights: DataFrame, n_classes: int) -> DataFrame:
    """One row: for each class ``c`` the array ``w{c}`` of coefficients by id (id 0: the bias)."""
    rows = weights.agg(F.array_sort(F.collect_list(F.struct("idx", "coefs"))).alias("rows"))

    def of_class(c: int) -> Column:
        return F.transform("rows", lambda r: F.get(r["coefs"], F.lit(c))).alias(f"w{c}")

    return rows.select(F.lit(0).alias("one"), *[of_class(c) for c in range(n_classes)])


def scored(data: DataFrame, weights: DataFrame, n_classes: int) -> DataFrame:
    """``data`` with ``probability`` (``array<double>`` by class) and ``pred``."""
    both = data.withColumn("one", F.lit(0)).join(F.broadcast(_parameter_row(weights, n_classes)), "one")

    def logit(c: int) -> Column:
        total = F.aggregate("idx", F.lit(0.0), lambda a, i: a + F.get(F.col(f"w{c}"), i))
        return total * _scale() + F.get(F.col(f"w{c}"), F.lit(0))

    both = both.select(*data.columns, F.array(*[logit(c) for c in range(n_classes)]).alias("z"))
    top = F.array_max("z")
    powers = F.transform("z", lambda z: F.exp(z - top))
    total = reduce(Column.__add__, [F.get(F.col("e"), F.lit(c)) for c in range(n_classes)])
    both = both.withColumn("e", powers).withColumn("total", total)
    return both.select(*data.columns, F.transform("e", lambda e: e / F.col("total")).alias("probability"),
                       (F.array_position("z", top) - 1).cast("int").alias("pred"))


def _gradient(rows: DataFrame, weights: DataFrame, n_classes: int) -> DataFrame:
    """``(idx, g array)``: sums of (probability - target) x feature over ``rows``; id 0 is the bias."""
    off = scored(rows, weights, n_classes).select("idx", F.transform(
        "probability", lambda p, c: p - (c == F.col("code")).cast("double")).alias("off"))
    entries = off.select("off", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(1.0).alias("x"))), F.transform(
        "idx", lambda i: F.struct(i.alias("at"), _scale().alias("x"))))).alias("f"))
    sums = entries.groupBy(F.col("f.at").alias("idx")).agg(*[
        F.sum(F.get("off", F.lit(c)) * F.col("f.x")).alias(f"g{c}") for c in range(n_classes)])
    return sums.select("idx", F.array(*[f"g{c}" for c in range(n_classes)]).alias("g"))


def _step(weights: DataFrame, rows: DataFrame, n_rows: int, n_classes: int, rate: float) -> DataFrame:
    new = F.when(F.col("g").isNull(), F.col("coefs")).otherwise(
        F.zip_with("coefs", "g", lambda w, g: w - F.lit(rate / max(n_rows, 1)) * g))
    return weights.join(_gradient(rows, weights, n_classes), "idx", "left").select("idx", new.alias("coefs"))


def _measured(data: DataFrame, weights: DataFrame, n_classes: int) -> DataFrame:
    """``(tag, value)`` of one epoch."""
    p = F.get("probability", F.col("code"))
    per = scored(data, weights, n_classes).select(
        "split", (-F.ln(F.greatest(p, F.lit(1e-300)))).alias("loss"), (F.col("pred") == F.col("code")).cast("double").alias("hit"))
    one = per.agg(*[F.avg(F.when(F.col("split") == s, F.col(v))).alias(t) for t, s, v in (
        ("train_loss", "train", "loss"), ("val_loss", "validation", "loss"), (MONITOR, "validation", "hit"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("value")) for t in one.columns]))
                      .alias("m")).select("m.tag", "m.value")


def history(spark: SparkSession, path: str) -> DataFrame | None:
    """``(tag, value, params, epoch)`` of the finished epochs under ``path``; None before the first."""
    try:
        return spark.read.schema(_HISTORY).parquet(f"{path}/history")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def train_staged(data: DataFrame, n_features: int, n_classes: int, path: str, epochs: int = 20, patience: int = 4,
                 rate: float = 4.0) -> int:
    """Train on ``data(doc_id, code, split, idx)`` (ids 1 to ``n_features``) until
    ``epochs``, or until the validation accuracy has not improved for ``patience``
    epochs. Returns the best epoch. A ``path`` with finished epochs is gone on
    with; one of other parameters is an error."""
    if (n_features + 1) * n_classes > MAX_PARAMETERS:
        raise ValueError(f"{n_features} features x {n_classes} classes are over {MAX_PARAMETERS} parameters: cap the vocabulary")
    spark = data.sparkSession
    params = f"features={n_features} classes={n_classes} rate={rate!r}"
    done = history(spark, path)
    at = 0
    if done is not None:
        seen = done.agg(F.max("epoch").alias("at"), F.collect_set("params").alias("params")).first()
        if seen["params"] != [params]:
            raise ValueError(f"{path} holds a run with {seen['params']}, not {params}")
        at = seen["at"]
    data = materialize(data.where(F.col("code").isNotNull()))
    train = data.where(F.col("split") == "train")
    n_rows = train.count()
    weights = epoch_weights(spark, path, at) if at else spark.range(n_features + 1).select(
        F.col("id").cast("int").alias("idx"), F.array_repeat(F.lit(0.0), n_classes).alias("coefs"))
    while True:
        best, stopped = best_epoch(spark, path, patience) if at else (0, False)
        if stopped or at >= epochs:
            return best
        at += 1
        _step(weights, train, n_rows, n_classes, rate).write.mode("overwrite").parquet(f"{path}/weights/epoch={at}")
        weights = epoch_weights(spark, path, at)
        _measured(data, weights, n_classes).withColumn("params", F.lit(params)).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/history/epoch={at}")


def best_epoch(spark: SparkSession, path: str, patience: int = 4) -> tuple[int, bool]:
    """The epoch to restore, and whether the run is to stop."""
    series = history(spark, path).where(F.col("tag") == MONITOR).select("tag", "epoch", "value")
    found = MT.early_stop(series.where("value IS NOT NULL"), patience).first()
    return (1, False) if found is None else (found["best_epoch"], found["stop_epoch"] is not None)


def epoch_weights(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """``(idx, coefs)`` after an epoch."""
    return spark.read.schema("idx int, coefs array<double>").parquet(f"{path}/weights/epoch={epoch}")
