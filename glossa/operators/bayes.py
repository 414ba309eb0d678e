"""Multinomial naive Bayes over clean words, with whole-number parameters.

The fit is one aggregation of (class, word) counts. A word's weight in a class
is the natural logarithm of its smoothed share, ``(count + 1) / (class total +
vocabulary size)``, in millionths and rounded; so is a class's prior, ``(rows +
1) / (all rows + classes)``. A document's class score is the prior plus the
weights of its words (words that were never seen in training say nothing), a
sum of integers: it is the same under any partitioning, in any order and in any
engine, and so are predictions and word evidence.

The model is a table ``(word, w array<bigint>)`` with one row a word and the
priors, as many as classes. Counts are pre-aggregated in the tasks; scoring is
one join on the word (broadcast below a measured size) and one aggregation by
document. Tokens may bring their document's class code or prediction along, as
joins of documents are less than joins of words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import vectors as VX
from glossa.operators.joins import bounded_broadcast
from glossa.session import materialize

MICRO = 1_000_000


def _log(share: Column) -> Column:
    return F.round(F.log(share) * MICRO).cast("long")


@dataclass
class NaiveBayes:
    """``weights(word, w)`` and one prior a class, in the order of the class codes."""

    weights: DataFrame
    priors: list[int]

    @property
    def n_classes(self) -> int:
        return len(self.priors)

    def save(self, path: str) -> None:
        """``path/weights`` and ``path/priors``, both Parquet."""
        spark = self.weights.sparkSession
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame(list(enumerate(self.priors)), "code int, prior long").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/priors")

    @staticmethod
    def load(spark: SparkSession, path: str) -> NaiveBayes:
        priors = spark.read.parquet(f"{path}/priors").orderBy("code").collect()  # one row a class
        return NaiveBayes(spark.read.parquet(f"{path}/weights"), [r["prior"] for r in priors])


def fit(tokens: DataFrame, labels: DataFrame, n_classes: int) -> NaiveBayes:
    """Fit on ``tokens(doc_id, word)`` of the documents of ``labels(doc_id,
    code)``; rows without a code are left out. Tokens with a column ``code`` are
    joined already. Without any word the model is its priors."""
    labels = labels.where(F.col("code").isNotNull()).select("doc_id", F.col("code").cast("int").alias("code"))
    per_class = {r["code"]: r["n"] for r in labels.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(per_class.values())
    coded = tokens.select("code", "word") if "code" in tokens.columns else tokens.select("doc_id", "word").join(labels, "doc_id")
    counted = coded.groupBy("word").agg(
        F.array(*[F.sum((F.col("code") == c).cast("long")) for c in range(n_classes)]).alias("n"))
    counted = materialize(counted)
    totals = counted.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("n")[c]), F.lit(0)) for c in range(n_classes)]).first()
    size, totals = totals[0], list(totals[1:])
    weights = counted.select("word", F.array(*[
        _log((F.col("n")[c] + 1.0) / F.lit(float(totals[c] + size))) for c in range(n_classes)]).alias("w"))
    spark = tokens.sparkSession
    shares = [(c, (per_class.get(c, 0) + 1.0) / (rows + n_classes)) for c in range(n_classes)]
    priors = spark.createDataFrame(shares, "code int, share double").select("code", _log(F.col("share")).alias("prior"))
    return NaiveBayes(weights, [r["prior"] for r in priors.orderBy("code").collect()])


def scores(model: NaiveBayes, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` with ``scores array<bigint>``, one a class (in millionths of a natural logarithm)."""
    said = tokens.select("doc_id", "word").join(bounded_broadcast(model.weights), "word")
    sums = said.groupBy("doc_id").agg(*[F.sum(F.col("w")[c]).alias(f"_s{c}") for c in range(model.n_classes)])
    out = docs.join(sums, "doc_id", "left")
    total = [F.coalesce(f"_s{c}", F.lit(0)) + F.lit(p).cast("long") for c, p in enumerate(model.priors)]
    return out.select(*docs.columns, F.array(*total).alias("scores"))


def predictions(model: NaiveBayes, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` with ``pred`` (the first best class), ``scores`` and ``probability``."""
    out = scores(model, tokens, docs)
    logs = F.transform("scores", lambda s: (s - F.array_max("scores")) / F.lit(float(MICRO)))
    return out.withColumn("pred", VX.argmax("scores")).withColumn("probability", VX.softmax(logs))


def soft_targets(preds: DataFrame) -> DataFrame:
    """``(doc_id, code, probability)``: one row for each document and class."""
    return preds.select("doc_id", F.posexplode("probability").alias("code", "probability"))


def word_evidence(model: NaiveBayes, tokens: DataFrame, preds: DataFrame) -> DataFrame:
    """``tokens`` of known words with ``importance bigint``: the word's weight
    in the predicted class less its largest weight in another class. Tokens with
    a column ``pred`` are joined with ``preds`` already."""
    told = tokens if "pred" in tokens.columns else tokens.join(preds.select("doc_id", "pred"), "doc_id")
    met = told.join(bounded_broadcast(model.weights), "word")
    rest = F.array_max(F.filter("w", lambda x, i: i != F.col("pred")))
    return met.select("doc_id", "sent_pos", "word_pos", "word",
                      (F.get("w", F.col("pred")) - F.coalesce(rest, F.lit(0))).alias("importance"))


def sentence_evidence(words: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(doc_id, sent_pos, importance bigint, weight)``: the sum of the words'
    evidence in each sentence (0 without a known word) and its softmax share."""
    marks = sentences.select("doc_id", "sent_pos", F.lit(0).cast("long").alias("importance"))
    sums = words.select("doc_id", "sent_pos", "importance").unionByName(marks).groupBy("doc_id", "sent_pos").agg(
        F.sum("importance").alias("importance"))
    document = Window.partitionBy("doc_id")
    share = F.exp((F.col("importance") - F.max("importance").over(document)) / F.lit(float(MICRO)))
    return sums.withColumn("_e", share).withColumn("weight", F.col("_e") / F.sum("_e").over(document)).drop("_e")
