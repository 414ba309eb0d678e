"""Sentence and token tables derived from a text column.

``tokens(doc_id, sent_pos, word_pos, word)`` is the exploded form every
vocabulary, encoding and explanation operator starts from. It is produced by
a map-only projection (regex split + ``posexplode``): no shuffle, so it scales
with the input partitions and any filter on the documents is pushed into the
Parquet scan first.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.stopwords import ENGLISH_STOP_WORDS
from glossa.operators.joins import bounded_broadcast


def sentence_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, sent_pos, sentence) for every non-blank sentence."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(T.sentences(text)).alias("sent_pos", "sentence"))


def word_table(docs: DataFrame, text: str = "text", key: str = "doc_id",
               stop_words: Iterable[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *carry, sent_pos, word_pos, word); ``word_pos`` counts kept words.

    ``stop_words=None`` gives the contract words before stop-word removal.
    ``carry`` columns are the document's: what is joined to documents need not be joined to their words.
    """
    # exploded as it is made: a column of its own would be cut twice, as Spark asks first whether it is empty
    sents = docs.select(F.col(key).alias("doc_id"), *carry, F.posexplode(_cut(text, stop_words)).alias("sent_pos", "ws"))
    return sentence_tokens(sents, carry)


def _cut(text: str, stop_words: Iterable[str] | None) -> Column:
    return T.clean_words(text, stop_words) if stop_words else T.doc_words(text)


def cut_documents(docs: DataFrame, text: str = "text", key: str = "doc_id",
                  stop_words: Iterable[str] | None = ENGLISH_STOP_WORDS, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *carry, sents): each document's kept words by sentence. Cutting is most of the work of many
    queries; one that reads the words again lands this (:func:`glossa.session.landed`) and takes them from there."""
    return docs.select(F.col(key).alias("doc_id"), *carry, _cut(text, stop_words).alias("sents"))


def cut_sentences(cut: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *carry, sent_pos, ws) of cut documents: every sentence, emptied ones too."""
    return cut.select("doc_id", *carry, F.posexplode("sents").alias("sent_pos", "ws"))


def sentence_tokens(sents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *carry, sent_pos, word_pos, word) of cut sentences."""
    return sents.select("doc_id", *carry, "sent_pos", F.posexplode("ws").alias("word_pos", "word"))


def dealt_words(cut: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, sent_pos, word) of cut documents, dealt by document to so many partitions: as plain texts (words are
    letters and digits), as arrays of strings take more than twice the room. An empty sentence gives an empty word."""
    plain = F.array_join(F.transform("sents", lambda ws: F.array_join(ws, " ")), "\n")
    dealt = cut.select("doc_id", plain.alias("said")).repartition(partitions, "doc_id")
    sents = dealt.select("doc_id", F.posexplode(F.split("said", "\n")).alias("sent_pos", "ws"))
    return sents.select("doc_id", "sent_pos", F.explode(F.split("ws", " ")).alias("word"))


def words_of(cut: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *carry, sent_pos, word_pos, word) of cut documents."""
    return sentence_tokens(cut_sentences(cut, carry), carry)


def clean_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id",
                 stop_words: Iterable[str] | None = ENGLISH_STOP_WORDS, carry: Sequence[str] = ()) -> DataFrame:
    """Clean tokens (stop words removed) with compacted positions."""
    return word_table(docs, text, key, stop_words, carry)


def stopword_anti_join(tokens: DataFrame, stop_table: DataFrame, word: str = "word") -> DataFrame:
    """Drop stop words with an anti join; the stop table is broadcast after
    its size is measured (a word list: normally hundreds of rows)."""
    stops = bounded_broadcast(stop_table.select(F.col(stop_table.columns[0]).alias(word)))
    return tokens.join(stops, word, "left_anti")


def lemmatize(tokens: DataFrame, lemma_table: DataFrame | None) -> DataFrame:
    """Replace each word by its lemma where the caller's table has one.

    The lemma table is measured and broadcast when small; a dictionary above
    the ceiling is joined with a shuffle join (AQE splits hot-word skew).
    """
    if lemma_table is None:
        return tokens
    lem = bounded_broadcast(lemma_table.select("word", F.col("lemma").alias("_lemma")))
    return (tokens.join(lem, "word", "left")
            .withColumn("word", F.coalesce(F.col("_lemma"), F.col("word")))
            .drop("_lemma"))
