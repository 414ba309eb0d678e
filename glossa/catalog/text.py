"""Text preparation queries: sentences, words, cleaning, stop words, lemmas, corpus stats."""

from __future__ import annotations

from glossa import sqltext as S
from glossa.catalog import common as C
from glossa.catalog import register
from glossa.functions import text as T
from glossa.functions.stopwords import ENGLISH_STOP_WORDS
from glossa.operators import stats, tokens as tok
from glossa.operators import vocab as V

_STOPS = S.stop_list_sql()


@register("sentence_split", sql=S.sentence_rows_sql())
def sentence_split(spark, d):
    return tok.sentence_table(C.docs(spark, d))


@register("word_split", sql=S.token_rows_sql("documents", None))
def word_split(spark, d):
    return C.raw_tokens(spark, d)


@register("filter_words", sql=S.token_rows_sql("documents", ENGLISH_STOP_WORDS))
def filter_words(spark, d):
    return C.clean_tokens(spark, d)


@register("stopword_anti_join", sql=f"""
SELECT t.* FROM ({S.token_rows_sql('documents', None)}) t
WHERE NOT list_contains({_STOPS}, t.word)
""")
def stopword_anti_join(spark, d):
    stop_table = spark.createDataFrame([(w,) for w in ENGLISH_STOP_WORDS], "word string")
    return tok.stopword_anti_join(C.raw_tokens(spark, d), stop_table)


@register("clean_text", sql=f"SELECT doc_id, {S.clean_string_sql('text')} AS text FROM documents")
def clean_text(spark, d):
    return C.docs(spark, d).select("doc_id", T.clean_string("text").alias("text"))


@register("strip_punct", sql=f"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, {S.q(T.WHITESPACE_RUN)}),
       lambda w: trim(w, {S.q(T.ASCII_PUNCTUATION)})), lambda w: w <> ''), ' ') AS text
FROM documents""")
def strip_punct(spark, d):
    return C.docs(spark, d).select("doc_id", T.strip_punctuation_text("text").alias("text"))


@register("collapse_ws", sql=f"""
SELECT doc_id, trim(regexp_replace(coalesce(text, ''), {S.q(T.WHITESPACE_RUN)}, ' ', 'g'), ' ') AS text
FROM documents""")
def collapse_ws(spark, d):
    return C.docs(spark, d).select("doc_id", T.collapse_whitespace("text").alias("text"))


# Lemma table derived from the corpus itself: a plural form ending in "s"
# whose stem is also a corpus word maps to the stem.
_LEMMA_SQL = f"""
WITH tk AS ({S.token_rows_sql('documents', ENGLISH_STOP_WORDS)}),
     vw AS (SELECT DISTINCT word FROM tk),
     lem AS (SELECT p.word, s.word AS lemma FROM vw p JOIN vw s
             ON length(p.word) > 3 AND p.word LIKE '%s' AND s.word = left(p.word, length(p.word) - 1))
SELECT tk.doc_id, tk.sent_pos, tk.word_pos, coalesce(lem.lemma, tk.word) AS word
FROM tk LEFT JOIN lem ON tk.word = lem.word
"""


@register("lemma_join", sql=_LEMMA_SQL)
def lemma_join(spark, d):
    toks = C.clean_tokens(spark, d)
    lemmas = V.plural_lemmas(toks)
    return tok.lemmatize(toks, lemmas).select("doc_id", "sent_pos", "word_pos", "word")


@register("corpus_stats", sql=f"""
WITH per_doc AS (
  SELECT {S.doc_words_sql('text')} AS ws FROM documents
), sums AS (
  SELECT count(*) AS n_docs, sum(len(ws)) AS n_sentences,
         sum(list_sum(list_transform(ws, lambda x: len(x)))) AS n_words FROM per_doc
)
SELECT n_docs, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(n_words AS BIGINT) AS n_words,
       CAST(round_even(n_words / nullif(n_sentences, 0), 0) AS BIGINT) AS words_per_sentence,
       CAST(round_even(n_sentences / nullif(n_docs, 0), 0) AS BIGINT) AS sentences_per_doc
FROM sums""")
def corpus_stats(spark, d):
    return stats.corpus_stats(C.docs(spark, d))
