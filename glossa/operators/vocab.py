"""Vocabulary: corpus word counts, frequency rank, capped top-k, word vectors.

Counting is a ``groupBy(word)`` with map-side partial aggregation, so a hot
word (a third of all tokens) is pre-combined in every task before the shuffle
and reaches the reducer as one partial row per task. A first appearance is one
number while it is aggregated: the least of structs would make Spark sort all
tokens by word in every task instead of hashing them. It is a long for places that
fit into one, and a decimal, which takes longer to make than all else, for others.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators.ranking import global_row_number, top_k_ranked

_POS = 31  # bits of a position
_DOC = Decimal(1 << (2 * _POS))  # places of a document
_NO_DOC = Decimal(-(1 << 63) - 1)
_LEAST = Decimal(-(1 << (63 + 2 * _POS)))  # place of any document is at least that
_SMALL = (36, 14, 13)  # bits of a document, sentence and word whose place is a long


def rank_order():
    """Count descending, then first appearance (a total order on words)."""
    return [F.col("n").desc(), F.col("first_doc"), F.col("first_sent"), F.col("first_word")]


def word_counts(tokens: DataFrame) -> DataFrame:
    """(word, n, first_doc, first_sent, first_word): occurrences and first
    appearance (document, sentence, word position) of every word."""
    return counted(tokens, F.count(F.lit(1)), "doc_id", "sent_pos", "word_pos")


def counted(rows: DataFrame, n: Column, doc: str, sent: str, word: str) -> DataFrame:
    """(word, n, first_doc, first_sent, first_word): ``n`` and the least place of
    every word (a null document goes first; positions are never null)."""
    kinds = [rows.schema[c].dataType for c in (doc, sent, word)]
    if not (isinstance(kinds[0], T.IntegralType) and kinds[1:] == [T.IntegerType()] * 2):
        agg = rows.groupBy("word").agg(n.alias("n"), F.min(F.struct(doc, sent, word)).alias("first"))
        return agg.select("word", "n", F.col(f"first.{doc}").alias("first_doc"),
                          F.col(f"first.{sent}").alias("first_sent"), F.col(f"first.{word}").alias("first_word"))
    _, sents, words = _SMALL
    fits = F.coalesce(F.col(doc).between(0, (1 << _SMALL[0]) - 1), F.lit(False)) & (F.col(sent) < (1 << sents)) & (F.col(word) < (1 << words))
    small = F.shiftleft(F.col(doc).cast("long"), sents + words) + F.shiftleft(F.col(sent).cast("long"), words) + F.col(word)
    place = F.shiftleft(F.col(sent).cast("long"), _POS) + F.col(word)
    agg = rows.groupBy("word").agg(n.alias("n"), F.min(F.when(fits, small)).alias("small"),
                                   F.min(F.when(~fits, _placed(F.col(doc), place))).alias("large"))
    place = F.shiftleft(F.shiftright("small", words).bitwiseAND(F.lit((1 << sents) - 1)), _POS) + F.col("small").bitwiseAND(
        F.lit((1 << words) - 1))
    first = F.least(F.when(F.col("small").isNotNull(), _placed(F.shiftright("small", sents + words), place)), "large")
    agg = agg.select("word", "n", first.alias("first"))
    agg = agg.withColumn("place", F.pmod("first", F.lit(_DOC).cast("decimal(19,0)")).cast("long"))
    first_doc = F.when(F.col("first") >= F.lit(_LEAST).cast("decimal(38,0)"),
                       F.expr(f"(first - cast(place AS decimal(19,0))) div cast({_DOC} AS decimal(19,0))"))
    return agg.select("word", "n", first_doc.cast(kinds[0]).alias("first_doc"),
                      F.shiftright("place", _POS).cast("int").alias("first_sent"),
                      F.col("place").bitwiseAND(F.lit((1 << _POS) - 1)).cast("int").alias("first_word"))


def _placed(doc: Column, place: Column) -> Column:
    """A place as a decimal: 64 bits of the document and 31 of each position are less than 38 digits."""
    at = F.coalesce(doc.cast("decimal(20,0)"), F.lit(_NO_DOC).cast("decimal(20,0)")) * F.lit(_DOC).cast("decimal(19,0)")
    return at + place.cast("decimal(19,0)")


def vocab_rank(tokens: DataFrame) -> DataFrame:
    """(word, idx, n): every word ranked from 1 by count descending, ties by
    first appearance. Uses the distributed global rank (no one-task window)."""
    ranked = global_row_number(word_counts(tokens), rank_order(), "idx")
    return ranked.select("word", F.col("idx").cast("int").alias("idx"), "n")


def vocab_topk(tokens: DataFrame, max_features: int) -> DataFrame:
    """(word, idx, n) for the usable words of a capped vocabulary: ids
    ``1 .. max_features-1`` (a word is usable iff ``idx < max_features``).
    Planned as a distributed TakeOrdered, so only ``max_features-1`` rows
    ever meet in one place."""
    top = top_k_ranked(word_counts(tokens), rank_order(), max_features - 1, "idx")
    return top.select("word", F.col("idx").cast("int").alias("idx"), "n")


def capped(vocab: DataFrame, max_features: int) -> DataFrame:
    """Usable part of a full vocabulary: ``idx < max_features``."""
    return vocab.where(F.col("idx") < max_features)


def word_vectors_from_rank(vocab: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(word, vec) by assigning the vector table's rows to words by rank
    (``vec_id = idx - 1``): a word-vector table that misses the tail."""
    return (vocab.join(embeddings.select("vec_id", F.col("embedding").alias("vec")),
                       (F.col("idx") - 1) == F.col("vec_id"))
            .select("word", "vec"))


def vocab_vectors(vocab: DataFrame, words: DataFrame, dim: int) -> DataFrame:
    """(idx, word, vec): vocabulary left join word vectors; a missing word gets
    a zero vector, and id 0 (padding) is a zero row with a null word."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    joined = (vocab.select("idx", "word").join(words.select("word", "vec"), "word", "left")
              .select("idx", "word", F.coalesce(F.col("vec"), zero).alias("vec")))
    pad = vocab.sparkSession.range(1).select(F.lit(0).cast("int").alias("idx"),
                                             F.lit(None).cast("string").alias("word"), zero.alias("vec"))
    return joined.unionByName(pad)


def plural_lemmas(tokens: DataFrame) -> DataFrame:
    """(word, lemma) derived from the corpus: a word longer than three
    characters ending in ``s`` whose stem (without the ``s``) is itself a
    corpus word maps to that stem. An equi-join of the distinct-word set with
    itself (vocabulary sized, never token sized)."""
    vw = tokens.select("word").distinct()
    plural = (vw.where((F.length("word") > 3) & F.col("word").endswith("s"))
              .select("word", F.expr("left(word, length(word) - 1)").alias("lemma")))
    return plural.join(vw.select(F.col("word").alias("lemma")), "lemma").select("word", "lemma")
