"""Explanation operators: which sentences and words drove a score.

Inputs are token rows carrying a ``weight`` (attention, model contribution,
or a frequency-based rarity) and the sentence table. Every window here is
partitioned by document, so each window partition is one document's rows;
only the cut results (top n) are regrouped, and those groups are bounded by n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.joins import bounded_broadcast, frequent_join, is_broadcast
from glossa.session import materialize

FREQUENT = 100_000  # words whose weights are broadcast when the vocabulary is too large for it
WORD_LEVELS = ("high", "medium", "low")
SENTENCE_LEVELS = ("high", "medium", "low", "none")


def rarity_weights(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token rows with ``weight`` = the word's frequency rank (rarer = larger):
    an integer, frequency-based importance that needs no model."""
    return weighted(tokens, weight_table(vocab))


def weight_table(vocab: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(word, weight)`` of a ranked vocabulary, measured once: whole and marked
    for broadcast, or its :data:`FREQUENT` first words and the others."""
    v = bounded_broadcast(vocab.select("word", F.col("idx").cast("long").alias("weight")))
    if is_broadcast(v):
        return v, None
    return materialize(v.where(F.col("weight") <= FREQUENT)), v.where(F.col("weight") > FREQUENT)


def weighted(tokens: DataFrame, table: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    """Token rows with the ``weight`` of :func:`weight_table`."""
    frequent, rest = table
    return tokens.join(frequent, "word") if rest is None else frequent_join(tokens, frequent, rest)


def sentence_weights(sentences: DataFrame, weighted_tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_pos, weight): sum of token weights per sentence slot;
    a sentence without weighted tokens scores 0. One shuffle: sentence marker
    rows are unioned into the same aggregation instead of a join."""
    marks = sentences.select("doc_id", "sent_pos", F.lit(0).cast("long").alias("weight"))
    toks = weighted_tokens.select("doc_id", "sent_pos", F.col("weight").cast("long").alias("weight"))
    return toks.unionByName(marks).groupBy("doc_id", "sent_pos").agg(F.sum("weight").alias("weight"))


def _sent_order():
    return Window.partitionBy("doc_id").orderBy(F.col("weight").desc(), F.col("sent_pos"))


def _word_order():
    return Window.partitionBy("doc_id").orderBy(F.col("weight").desc(), F.col("sent_pos"), F.col("word_pos"))


def top_sentences(sent_w: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, sent_pos, weight, rank): the ``n`` heaviest sentences (ties by
    position); ``rank`` 1 = heaviest. Fewer sentences -> what exists."""
    r = sent_w.withColumn("rank", F.row_number().over(_sent_order()))
    return r.where(F.col("rank") <= n)


def sentence_rank(sent_w: DataFrame) -> DataFrame:
    """Full descending sentence rank per document."""
    return sent_w.withColumn("rank", F.row_number().over(_sent_order()))


def top_words(weighted_tokens: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` heaviest token occurrences per document (duplicates kept)."""
    r = weighted_tokens.withColumn("rank", F.row_number().over(_word_order()))
    return r.where(F.col("rank") <= n)


def in_sentences(weighted_tokens: DataFrame, chosen: DataFrame) -> DataFrame:
    """The token rows inside the chosen sentences: words are ranked within a
    summary, not within the whole document."""
    return weighted_tokens.join(chosen.select("doc_id", "sent_pos"), ["doc_id", "sent_pos"], "left_semi")


def _level(bucket, levels):
    expr = None
    for i, name in enumerate(levels, start=1):
        expr = F.when(bucket == i, F.lit(name)) if expr is None else expr.when(bucket == i, F.lit(name))
    return expr


def word_terciles(weighted_tokens: DataFrame) -> DataFrame:
    """Token rows with ``level`` high/medium/low: equal thirds by weight, the
    earlier buckets one larger (11 -> 4, 4, 3)."""
    return weighted_tokens.withColumn("level", _level(F.ntile(3).over(_word_order()), WORD_LEVELS))


def sentence_quartiles(sent_w: DataFrame) -> DataFrame:
    """Sentence rows with ``level`` high/medium/low/none by weight quartile."""
    return sent_w.withColumn("level", _level(F.ntile(4).over(_sent_order()), SENTENCE_LEVELS))


def sentence_text(sentences: DataFrame, chosen: DataFrame) -> DataFrame:
    """Semi join: the text of the chosen sentences."""
    return sentences.join(chosen.select("doc_id", "sent_pos"), ["doc_id", "sent_pos"], "left_semi")


def extractive_summary(sentences: DataFrame, chosen: DataFrame, sep: str = " ") -> DataFrame:
    """(doc_id, summary): chosen sentences in document order, joined."""
    picked = sentence_text(sentences, chosen)
    g = picked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_pos", "sentence"))).alias("_s"))
    return g.select("doc_id", F.array_join(F.transform("_s", lambda s: s["sentence"]), sep).alias("summary"))


def highlight_spans(weighted_tokens: DataFrame, sent_w: DataFrame, n_sentences: int = 3) -> DataFrame:
    """Token rows (doc_id, sent_pos, word_pos, word, sent_level, word_level).

    ``sent_level``: the sentence's weight quartile. ``word_level``: only for
    tokens inside the ``n_sentences`` chosen sentences; the chosen tokens are
    split in weight terciles and every occurrence of a word takes the best
    level any occurrence of that word reached (lookup by word text).

    Plan: sentence attributes are joined to the token rows, unless these have them
    already (``sent_level`` and ``chosen``: sentences joined with
    :func:`sentence_levels` before their words are taken). Only the tokens of
    chosen sentences are then shuffled by document, for the terciles and the
    per-word best level.
    """
    toks = weighted_tokens
    if "sent_level" not in toks.columns:
        toks = with_levels(toks, sentence_levels(sent_w, n_sentences))
    toks = toks.withColumn("weight", F.col("weight").cast("long"))
    inside = toks.where("chosen").withColumn("_b", F.ntile(3).over(_word_order()))
    best = F.min("_b").over(Window.partitionBy("doc_id", "word"))
    inside = inside.withColumn("word_level", _level(best, WORD_LEVELS))
    outside = toks.where(~F.coalesce("chosen", F.lit(False))).withColumn("word_level", F.lit(None).cast("string"))
    columns = ["doc_id", "sent_pos", "word_pos", "word", "sent_level", "word_level"]
    return inside.select(*columns).unionByName(outside.select(*columns))


def sentence_levels(sent_w: DataFrame, n_sentences: int = 3) -> DataFrame:
    """(doc_id, sent_pos, sent_level, chosen): the weight quartile, and whether
    the sentence is among the ``n_sentences`` heaviest."""
    ranked = sentence_quartiles(sent_w).withColumn("_rank", F.row_number().over(_sent_order()))
    return ranked.select("doc_id", "sent_pos", F.col("level").alias("sent_level"), (F.col("_rank") <= n_sentences).alias("chosen"))


def with_levels(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """``rows(doc_id, sent_pos, ...)`` with ``sent_level`` and ``chosen``; null keys are keys."""
    at = levels.withColumnsRenamed({"doc_id": "_d", "sent_pos": "_s"})
    return rows.join(at, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("sent_pos").eqNullSafe(F.col("_s")), "left").drop("_d", "_s")
