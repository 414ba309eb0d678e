"""Incremental vocabulary: counts of input parts that add up to one fit.

The state of a part is ``(word, n, first appearance)``, one row a word; states merge by
sum and least appearance, so any order and any grouping of parts gives the
vocabulary of one fit over all. Each part is counted once: its state is written
first, its manifest entry last, and only parts in the manifest are read. A part
offered again is not counted again; one with the same name and other rows is
an error. New data cost one pass over the new data; the merge reads
vocabulary-sized rows, never texts.

Defined results: a part without words is in the manifest and adds nothing; a
root without parts has an empty vocabulary; a document's words must be in one part.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import vocab as V
from glossa.operators.ranking import global_row_number

_MANIFEST = "part string, fingerprint string, data string, words long, tokens long"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(part, fingerprint, data, words, tokens)``: the parts that are counted; ``data`` is a part's folder."""
    try:
        return spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def add_part(root: str, part: str, tokens: DataFrame, fingerprint: str) -> bool:
    """Count ``tokens(doc_id, sent_pos, word_pos, word)`` of one part, if it is
    new. ``fingerprint`` names the part's content
    (:func:`glossa.sources.stores.fingerprint`). Returns whether it was counted."""
    spark = tokens.sparkSession
    seen = manifest(spark, root).where(F.col("part") == part).first()
    if seen is not None:
        if seen["fingerprint"] != fingerprint:
            raise ValueError(f"part {part!r} was counted with other rows: {seen['fingerprint']}, now {fingerprint}")
        return False
    data = f"{root}/state/{uuid.uuid4().hex}"
    V.word_counts(tokens).write.parquet(data)
    sums = spark.read.parquet(data).agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    entry = sums.select(F.lit(part).alias("part"), F.lit(fingerprint).alias("fingerprint"), F.lit(data).alias("data"), "words", "tokens")
    # named by the part, so that two writers of one part leave one entry
    entry.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{part.encode().hex()}")
    return True


def merged_counts(spark: SparkSession, root: str) -> DataFrame:
    """``(word, n, first_doc, first_sent, first_word)`` over all counted parts."""
    folders = [r["data"] for r in manifest(spark, root).select("data").collect()]  # one row a part
    if not folders:
        none = spark.createDataFrame([], "doc_id long, sent_pos int, word_pos int, word string")
        return V.word_counts(none)
    states = spark.read.parquet(*folders)
    return V.counted(states, F.sum("n"), "first_doc", "first_sent", "first_word")


def ranked(spark: SparkSession, root: str) -> DataFrame:
    """``(word, idx, n)``: the vocabulary of all counted parts, as one fit ranks it."""
    out = global_row_number(merged_counts(spark, root), V.rank_order(), "idx")
    return out.select("word", F.col("idx").cast("int").alias("idx"), "n")
