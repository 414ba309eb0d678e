"""Leave-one-out importance of words under max pooling.

The pooled vector of a document without one of its words is known from two
numbers a dimension: the largest value, and the largest one below it, with how many
words reach the largest. A word takes away from a dimension only what it alone
holds up. So every word of a document is left out at once, without pooling again:
two aggregates by document over its distinct word ids, which are written once. Vectors
are looked up by id (broadcast below a measured size) where they are used, so no row
with a vector is sorted, spilled or shuffled. Importance asks for one word a dimension,
a holder of the largest value, and what the others reach: most words hold none and
are told without a look at their vectors.

Defined results: all occurrences of a word are left out together; words with
equal vectors hold each other up; a document of one word has the zero vector
without it; documents without words give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.joins import bounded_broadcast
from glossa.operators.pooling import dimension, max_pool
from glossa.session import landed, materialize


def _said(words: DataFrame, vectors: DataFrame | None, partitions: int | None = None) -> tuple[
        DataFrame, Callable[[DataFrame], DataFrame], int]:
    """``(doc_id, ids)`` of each document's distinct words, dealt by document (to so many partitions, if given), a
    function that looks up the vectors of the ids, and the dimension."""
    vectors = (words if vectors is None else vectors).select("idx", "vec").dropDuplicates(["idx"])
    vectors = bounded_broadcast(vectors.select("idx", F.col("vec").cast("array<double>").alias("vec")))
    pairs = words.select("doc_id", "idx").where(F.col("doc_id").isNotNull())
    pairs = pairs.repartition("doc_id") if partitions is None else pairs.repartition(partitions, "doc_id")
    docs = landed(pairs.distinct().groupBy("doc_id").agg(F.collect_list("idx").alias("ids")), "ids")

    def said(rows: DataFrame) -> DataFrame:
        return rows.withColumn("idx", F.explode("ids")).drop("ids").join(vectors, "idx")

    return docs, said, dimension(vectors, "vec")


def words_with_top_two(words: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """``(doc_id, idx, vec, top, second, n_top, n_words)`` of each document's distinct
    words, from token rows ``(doc_id, idx)`` and ``vectors(idx, vec)`` (if not given, token rows
    have a ``vec``); ``second`` is the largest value below ``top``."""
    docs, said, dim = _said(words, vectors)
    top = max_pool(said(docs), dtype="float64", dim=dim).withColumnRenamed("pooled", "top")
    both = materialize(docs.join(top, "doc_id"))
    v, t = ([F.get(c, F.lit(i)) for i in range(dim)] for c in ("vec", "top"))
    more = said(both).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), *[F.max(F.when(v[i] < t[i], v[i])).alias(f"s{i}") for i in range(dim)],
        *[F.sum((v[i] == t[i]).cast("double")).alias(f"n{i}") for i in range(dim)])
    more = more.select("doc_id", "n_words", F.array(*[F.coalesce(f"s{i}", F.lit(float("-inf"))) for i in range(dim)]).alias("second"),
                       F.array(*[f"n{i}" for i in range(dim)]).alias("n_top"))
    return said(both.join(more, "doc_id"))


def pooled_without(words: DataFrame) -> DataFrame:
    """``(doc_id, idx, top, pooled)``: the pooled vector with all words, and without word ``idx``."""
    left = F.transform("vec", lambda v, i: F.when((v == F.get("top", i)) & (F.get("n_top", i) == 1), F.get("second", i)).otherwise(
        F.get("top", i)))
    none = F.transform("vec", lambda v: F.lit(0.0))
    return words.select("doc_id", "idx", "top", F.when(F.col("n_words") == 1, none).otherwise(left).alias("pooled"))


def importance(words: DataFrame, vectors: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """``(doc_id, idx, importance)``: how much of the rectified pooled vector's sum goes with the word. A dimension goes
    with its holder from the largest value down to what another word reaches (:func:`pooled_without` without it)."""
    docs, said, dim = _said(words, vectors, partitions)
    v, at = [F.get("vec", F.lit(i)) for i in range(dim)], range(dim)

    def of_each(rows: DataFrame, name: str, kind: str, value: Callable[[int], Column]) -> DataFrame:
        agg = said(rows).groupBy("doc_id").agg(F.count(F.lit(1)), *[F.max(value(i)).alias(f"m{i}") for i in at])
        return agg.select("doc_id", F.array(*[f"m{i}" for i in at]).cast(f"array<{kind}>").alias(name))

    top = landed(of_each(docs, "top", "double", lambda i: v[i]), "top")
    holder = landed(of_each(docs.join(top, "doc_id"), "holder", "int", lambda i: F.when(
        v[i] == F.get("top", F.lit(i)), F.col("idx"))), "holder")
    others = of_each(docs.join(holder, "doc_id"), "other", "double", lambda i: F.when(
        F.col("idx") != F.get("holder", F.lit(i)), v[i]))
    lost = F.zip_with("top", "other", lambda t, o: F.greatest(t, F.lit(0.0)) - F.greatest(o, F.lit(0.0)))
    # a largest value without end is lost on all words but its holder: the difference of two of them is no number
    endless = F.lit(float("inf"))
    told = landed(docs.join(top, "doc_id").join(holder, "doc_id").join(others, "doc_id").select(
        "doc_id", F.array_except("ids", "holder").alias("idle"), F.arrays_zip("holder", "top", lost.alias("lost")).alias("held"),
        F.size(F.filter("top", lambda t: t >= endless)).alias("endless")), "told")
    held = told.select("doc_id", "endless", F.inline("held")).where(F.col("holder").isNotNull()).groupBy("doc_id", "holder").agg(
        F.sum("lost").alias("lost"), (F.max("endless") - F.sum((F.col("top") >= endless).cast("int"))).alias("endless"))
    none = F.when(F.col("endless") > 0, F.lit(float("nan"))).otherwise(F.lit(0.0))
    return held.select("doc_id", F.col("holder").alias("idx"), (F.col("lost") + none).alias("importance")).unionByName(
        told.select("doc_id", F.explode("idle").alias("idx"), none.alias("importance")))
