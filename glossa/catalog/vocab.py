"""Vocabulary queries: counts, full rank, capped top-k, store round trip."""

from __future__ import annotations

from glossa import sqltext as S
from glossa.catalog import common as C
from glossa.catalog import register
from glossa.functions.stopwords import ENGLISH_STOP_WORDS
from glossa.operators import vocab as V

TOKENS_CTE = f"tk AS ({S.token_rows_sql('documents', ENGLISH_STOP_WORDS)})"
WORD_COUNTS_CTE = f"""{TOKENS_CTE},
wc0 AS (SELECT word, count(*) AS n, min({{'d': doc_id, 's': sent_pos, 'w': word_pos}}) AS f FROM tk GROUP BY word),
wc AS (SELECT word, n, f.d AS first_doc, f.s AS first_sent, f.w AS first_word FROM wc0)"""
VOCAB_CTE = f"""{WORD_COUNTS_CTE},
vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, first_doc, first_sent, first_word) AS INTEGER) AS idx, n
          FROM wc)"""


def vocab_cte(max_features: int | None = None) -> str:
    """SQL CTE chain ending in ``vocab(word, idx, n)`` (capped when asked)."""
    if max_features is None:
        return VOCAB_CTE
    return VOCAB_CTE + f",\nvcap AS (SELECT * FROM vocab WHERE idx < {max_features})"


@register("word_counts", sql=f"WITH {WORD_COUNTS_CTE} SELECT * FROM wc")
def word_counts(spark, d):
    return V.word_counts(C.clean_tokens(spark, d))


@register("vocab_rank", sql=f"WITH {VOCAB_CTE} SELECT * FROM vocab")
def vocab_rank(spark, d):
    return V.vocab_rank(C.clean_tokens(spark, d))


@register("vocab_topk", sql=f"WITH {VOCAB_CTE} SELECT * FROM vocab WHERE idx < {C.MAX_FEATURES}")
def vocab_topk(spark, d):
    return V.vocab_topk(C.clean_tokens(spark, d), C.MAX_FEATURES)
