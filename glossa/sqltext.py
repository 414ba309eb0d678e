"""The token contract written as DuckDB SQL, for the correctness oracle.

Mirrors :mod:`glossa.functions.text` expression by expression. The patterns
are the same strings; only the function names differ between engines.
"""

from __future__ import annotations

from glossa.functions.stopwords import ENGLISH_STOP_WORDS
from glossa.functions import text as T


def q(s: str) -> str:
    """Single-quoted SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def stop_list_sql(stop_words=ENGLISH_STOP_WORDS) -> str:
    return "[" + ", ".join(q(w) for w in stop_words) + "]"


def sentences_sql(text: str) -> str:
    return (f"list_filter(string_split_regex({text}, {q(T.SENTENCE_SPLIT)}), "
            f"lambda s: regexp_matches(s, {q(T.NON_BLANK)}))")


def words_of_sql(sentence: str, var: str = "w") -> str:
    return (f"list_filter(list_transform(string_split_regex(lower({sentence}), {q(T.WORD_SPLIT)}), "
            f"lambda {var}: trim({var}, {q(T.EDGE_CHARS)})), "
            f"lambda {var}: regexp_matches({var}, {q(T.ALNUM_WORD)}))")


def doc_words_sql(text: str) -> str:
    return f"list_transform({sentences_sql(text)}, lambda s2: {words_of_sql('s2')})"


def clean_words_sql(text: str, stop_words=ENGLISH_STOP_WORDS) -> str:
    if stop_words:
        keep = f"lambda w2: NOT list_contains({stop_list_sql(stop_words)}, w2)"
        return (f"list_transform({sentences_sql(text)}, "
                f"lambda s2: list_filter({words_of_sql('s2')}, {keep}))")
    return doc_words_sql(text)


def clean_string_sql(text: str, stop_words=ENGLISH_STOP_WORDS) -> str:
    return (f"array_to_string(list_transform({clean_words_sql(text, stop_words)}, "
            f"lambda ws: array_to_string(ws, ' ') || ' . '), '')")


def sentence_rows_sql(source: str = "documents", text: str = "text", key: str = "doc_id") -> str:
    """(doc_id, sent_pos, sentence) rows."""
    return (f"SELECT {key} AS doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS sent_pos, unnest(ss) AS sentence "
            f"FROM (SELECT {key}, {sentences_sql(text)} AS ss FROM {source})")


def token_rows_sql(source: str = "documents", stop_words=ENGLISH_STOP_WORDS, text: str = "text") -> str:
    """(doc_id, sent_pos, word_pos, word) rows of clean words; positions are
    0-based, word_pos counts kept words only."""
    if stop_words:
        words = (f"list_filter({words_of_sql('sentence')}, "
                 f"lambda w2: NOT list_contains({stop_list_sql(stop_words)}, w2))")
    else:
        words = words_of_sql("sentence")
    return (f"SELECT doc_id, sent_pos, CAST(unnest(range(len(ws))) AS INTEGER) AS word_pos, unnest(ws) AS word "
            f"FROM (SELECT doc_id, sent_pos, {words} AS ws FROM ({sentence_rows_sql(source, text)}))")
