"""Subword ids by greedy longest match against a piece vocabulary.

The work is proportional to the number of *distinct* words, not tokens: the
distinct words are encoded once by an Arrow ``pandas_udf`` (the greedy match
is a per-word loop that has no SQL form) with the piece vocabulary shipped as
a broadcast variable, and the result is joined back to the token rows: that of
frequent words by broadcast, so no word's tokens meet in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators.joins import frequent_join
from glossa.session import landed

FREQUENT = 100_000  # at most so many words' pieces are broadcast
# Reserved piece ids.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
CONT = "##"


def piece_vocabulary(vocab: DataFrame, n_words: int) -> DataFrame:
    """(piece, id): the reserved ids, the ``n_words`` most frequent whole
    words, then every character seen in the vocabulary as a word-initial
    piece and as a ``##`` continuation piece. Size is bounded by
    ``n_words`` + twice the alphabet."""
    words = vocab.where(F.col("idx") <= n_words).select(
        F.col("word").alias("piece"), F.struct(F.lit(0).alias("g"), F.col("idx").cast("long").alias("r")).alias("o"))
    chars = (vocab.select(F.explode(F.split("word", "")).alias("c")).where(F.col("c") != "").distinct())
    ranked_chars = chars.select("c", F.dense_rank().over(Window.orderBy("c")).cast("long").alias("r"))
    # order: whole words (by rank), then initial characters, then continuations
    initial = ranked_chars.select(F.col("c").alias("piece"), F.struct(F.lit(1).alias("g"), "r").alias("o"))
    cont = ranked_chars.select(F.concat(F.lit(CONT), "c").alias("piece"), F.struct(F.lit(2).alias("g"), "r").alias("o"))
    pieces = words.unionByName(initial).unionByName(cont)
    # first id wins when a one-character word is also a character piece
    best = pieces.groupBy("piece").agg(F.min("o").alias("o"))
    return best.select("piece", (F.row_number().over(Window.orderBy("o")) + 3).cast("int").alias("id"))


def greedy_pieces(word: str, table: dict[str, int], longest: int | None = None) -> list[int]:
    """Greedy longest-prefix match; a word with an unmatched remainder is a
    single UNK. No word is too long: a match is tried from the ``longest``
    piece down, so the work is linear in the word."""
    longest = longest or max(map(len, table), default=0)
    out, start, n = [], 0, len(word)
    while start < n:
        end, found = min(n, start + longest), None
        while end > start:
            piece = word[start:end] if start == 0 else CONT + word[start:end]
            if piece in table:
                found = table[piece]
                break
            end -= 1
        if found is None:
            return [UNK]
        out.append(found)
        start = end
    return out


def _ship_module_by_value() -> None:
    """Serialise this module's functions into the UDF, so Python workers do
    not need the package on their path."""
    import sys

    from pyspark import cloudpickle

    try:
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except ValueError:  # already registered
        pass


def subword_encode(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """Token rows with ``piece_ids array<int>``."""
    spark = tokens.sparkSession
    table = {r["piece"]: int(r["id"]) for r in pieces.collect()}  # bounded piece vocabulary
    bc = spark.sparkContext.broadcast(table)
    _ship_module_by_value()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(words: pd.Series) -> pd.Series:
        t = bc.value
        longest = max(map(len, t), default=0)
        return words.map(lambda w: greedy_pieces(w, t, longest))

    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    coded = landed(counts.select("word", "n", encode("word").alias("piece_ids")), "coded")
    # at most FREQUENT words have so large a share of the tokens
    share = F.lit(1 + coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // FREQUENT)
    return frequent_join(tokens, coded.where(F.col("n") >= share).drop("n"), coded.where(F.col("n") < share).drop("n"))
