"""Encoders: token ids, hierarchical document matrices, fixed-length sequences.

Shape of every encoder: explode -> join the (measured, broadcast) vocabulary
-> cut to the target shape *before* any regrouping -> one ``groupBy(doc_id)``
whose groups are bounded by the output shape (m x k or max_len entries), never
by the document length. Documents without a single known word are kept by
unioning a marker row per document into the same aggregation (one shuffle, no
extra join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.joins import bounded_broadcast

# Reserved ids of the sequence encoding.
PAD, UNK, BEGIN, END = 0, 1, 2, 3
RESERVED = 4


def token_ids(tokens: DataFrame, vocab_capped: DataFrame, vocab_measured: bool = False,
              partitions: int | None = None) -> DataFrame:
    """(doc_id, sent_pos, word_pos, idx): known words only; unknown words are
    dropped and later words move left (positions re-counted per sentence). Rows
    that get much longer later are dealt to a given number of ``partitions``."""
    v = _vocab_side(vocab_capped.select("word", "idx"), vocab_measured)
    known = tokens.join(v, "word")
    if partitions is not None:
        known = known.select("doc_id", "sent_pos", "word_pos", "idx").repartition(partitions, "doc_id", "sent_pos")
    w = Window.partitionBy("doc_id", "sent_pos").orderBy("word_pos")
    return known.select("doc_id", "sent_pos", (F.row_number().over(w) - 1).cast("int").alias("word_pos"), "idx")


def _vocab_side(vocab: DataFrame, measured: bool) -> DataFrame:
    """The vocabulary's join side: measured here, or as the caller's
    measurement left it (a frozen vocabulary reused for every micro-batch): a
    broadcast that was refused is not asked for again."""
    return vocab if measured else bounded_broadcast(vocab)


def doc_matrix(docs: DataFrame, tokens: DataFrame, vocab_capped: DataFrame,
               max_sentences: int, max_words: int, carry: list[str] | None = None,
               vocab_measured: bool = False) -> DataFrame:
    """(doc_id, *carry, x): ``x`` is a ``max_sentences x max_words`` int matrix
    of word ids, zero padded. Only the first ``max_sentences`` sentence slots
    are read; in each, the first ``max_words`` *known* words are kept.

    ``docs`` supplies the document rows (and ``carry`` columns); ``tokens`` the
    clean tokens of the same documents.
    """
    carry = carry or []
    m, k = max_sentences, max_words
    v = _vocab_side(vocab_capped.select("word", "idx"), vocab_measured)
    known = (tokens.where(F.col("sent_pos") < m).join(v, "word")
             .select("doc_id", "sent_pos", "word_pos", "idx", *[F.lit(None).alias(c) for c in carry]))
    # one marker row per document (sent_pos null) keeps documents without a
    # known word and carries the document's columns
    markers = docs.select("doc_id", F.lit(None).cast("int").alias("sent_pos"), F.lit(None).cast("int").alias("word_pos"),
                          F.lit(None).cast("int").alias("idx"), *carry)
    for c in carry:
        known = known.withColumn(c, F.col(c).cast(markers.schema[c].dataType))
    # The only shuffle: hash by document. The per-sentence window and both
    # regroupings below are satisfied by this partitioning (no further
    # exchange), and every group is bounded by the output shape.
    rows = known.unionByName(markers).repartition("doc_id")
    w = Window.partitionBy("doc_id", "sent_pos").orderBy("word_pos")
    kept = rows.withColumn("_kp", F.row_number().over(w)).where(F.col("sent_pos").isNull() | (F.col("_kp") <= k))
    # position and id in one long: sorted as numbers, where structs are compared by an interpreted function
    per_sent = kept.groupBy("doc_id", "sent_pos").agg(
        F.sort_array(F.collect_list(_placed("_kp", "idx"))).alias("_ids"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry])
    padded = F.slice(F.concat(F.transform("_ids", _id_of), F.array_repeat(F.lit(0), k)), 1, k)
    per_sent = per_sent.select("doc_id", *carry, F.when(F.col("sent_pos").isNotNull(),
                                                        F.struct("sent_pos", padded.alias("row"))).alias("_r"))
    grouped = per_sent.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list("_r")).alias("_mp"),  # at most m entries
        *[F.first(c, ignorenulls=True).alias(c) for c in carry])
    zeros = F.array_repeat(F.lit(0), k)
    x = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_mp"), i), zeros))
    return grouped.select("doc_id", *carry, x.alias("x"))


def _placed(pos: str, idx: str) -> Column:
    return F.shiftleft(F.col(pos).cast("long"), 32).bitwiseOR(F.col(idx).cast("long"))


def _id_of(placed: Column) -> Column:
    return placed.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def flat_word_positions(docs: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """(doc_id, pos, word): contract words of the whole document in order
    (sentences flattened, stop words kept); only the first ``limit`` words are
    exploded when given. Cut documents (a column ``sents``) are not cut again."""
    flat = F.flatten("sents" if "sents" in docs.columns else T.doc_words(text))
    if limit is not None:
        flat = F.slice(flat, 1, limit)
    return docs.select("doc_id", F.posexplode(flat).alias("pos", "word"))


def sequence_encode(docs: DataFrame, vocab_capped: DataFrame, max_len: int,
                    carry: list[str] | None = None, text: str = "text",
                    markers: DataFrame | None = None) -> DataFrame:
    """(doc_id, *carry, ids, mask, token_type_ids): BEGIN + the first
    ``max_len - 2`` word ids (unknown word -> UNK, vocabulary ids shifted past
    the reserved ones) + END, padded with PAD to ``max_len``; mask is 1 on real
    positions; token types are all 0. ``markers`` (doc_id + carry columns)
    defaults to ``docs``; pass it to carry columns without carrying the text.
    ``docs`` may be cut documents (:func:`glossa.operators.tokens.cut_documents`, stop words kept)."""
    if max_len < 2:
        raise ValueError("max_len must leave room for BEGIN and END")
    carry = carry or []
    v = bounded_broadcast(vocab_capped.select("word", (F.col("idx") + (RESERVED - 1)).alias("_id")))
    words = flat_word_positions(docs, text, max_len - 2).join(v, "word", "left")
    entries = words.withColumn("_id", F.coalesce("_id", F.lit(UNK))).select(
        "doc_id", _placed("pos", "_id").alias("_e"), *[F.lit(None).alias(c) for c in carry])
    markers = (markers if markers is not None else docs).select(
        "doc_id", F.lit(None).cast("long").alias("_e"), *carry)
    for c in carry:
        entries = entries.withColumn(c, F.col(c).cast(markers.schema[c].dataType))
    grouped = entries.unionByName(markers).groupBy("doc_id").agg(
        F.sort_array(F.collect_list("_e")).alias("_es"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry])
    body = F.concat(F.array(F.lit(BEGIN)), F.transform("_es", _id_of), F.array(F.lit(END)))
    # the length is told by the entries: a size of the body would make the body again for each position
    n = F.size("_es") + 2
    padded = F.concat(body, F.array_repeat(F.lit(PAD), F.lit(max_len) - n))
    mask = F.concat(F.array_repeat(F.lit(1), F.least(n, F.lit(max_len))), F.array_repeat(F.lit(0), F.lit(max_len) - n))
    return grouped.select("doc_id", *carry, padded.alias("ids"), mask.alias("mask"),
                          F.array_repeat(F.lit(0), max_len).alias("token_type_ids"))
