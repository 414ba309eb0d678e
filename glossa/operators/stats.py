"""Corpus statistics used to choose encoding shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents, sentences, words, and the half-to-even rounded
    means words/sentence and sentences/document (null when undefined).

    Per-document sizes are computed in the scan projection and summed with a
    single partial + final aggregate: one tiny shuffle regardless of size.
    """
    arr = T.doc_words(text)
    per = docs.select(
        F.coalesce(F.size(arr), F.lit(0)).cast("long").alias("ns"),
        F.aggregate(arr, F.lit(0).cast("long"), lambda acc, s: acc + F.size(s)).alias("nw"))
    sums = per.agg(F.count(F.lit(1)).alias("n_docs"),
                   F.coalesce(F.sum("ns"), F.lit(0)).cast("long").alias("n_sentences"),
                   F.coalesce(F.sum("nw"), F.lit(0)).cast("long").alias("n_words"))
    return sums.select(
        "n_docs", "n_sentences", "n_words",
        F.bround(F.try_divide(F.col("n_words").cast("double"), F.col("n_sentences")), 0).cast("long").alias("words_per_sentence"),
        F.bround(F.try_divide(F.col("n_sentences").cast("double"), F.col("n_docs")), 0).cast("long").alias("sentences_per_doc"))
