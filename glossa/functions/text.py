"""Text expressions: the token contract every text operator shares.

All functions return JVM-side ``Column`` expressions (regex split, lower,
higher-order ``transform``/``filter``), so they stay inside whole-stage codegen
and never move a document through Python. The regular expressions avoid
look-around and Unicode-ambiguous shorthands, so Java regex and RE2 (the SQL
oracle) split identically.

Contract
  1. sentences: split on a run of ``.!?`` followed by whitespace, or on line
     breaks; blank pieces are dropped, every other piece keeps its slot.
  2. words: lower-case the sentence, split on whitespace and bracket/separator
     punctuation, strip edge characters, keep a word only if it is entirely
     letters and digits (Unicode).
  3. clean words: contract words that are not stop words; a sentence emptied
     by the filter still keeps its slot.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.stopwords import ENGLISH_STOP_WORDS

WS = r" \t\n\r\f"
SENTENCE_SPLIT = r"[.!?]+[" + WS + r"]+|\n+"
NON_BLANK = r"[^" + WS + r"]"
WORD_SPLIT = r"[" + WS + r",;:!?\"()\[\]{}<>@#$%&]+"
EDGE_CHARS = ".'*/_-"
ALNUM_WORD = r"^[\p{L}\p{N}]+$"
WHITESPACE_RUN = r"[" + WS + r"]+"
# Fixed value: the ASCII punctuation set of the Python ``string`` module.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentences(text: Column | str) -> Column:
    """``array<string>``: the non-blank sentences of a text, in order."""
    return F.filter(F.split(_col(text), SENTENCE_SPLIT), lambda s: s.rlike(NON_BLANK))


def words_of(sentence: Column) -> Column:
    """``array<string>``: contract words of one sentence."""
    raw = F.split(F.lower(sentence), WORD_SPLIT)
    stripped = F.transform(raw, lambda w: F.btrim(w, F.lit(EDGE_CHARS)))
    return F.filter(stripped, lambda w: w.rlike(ALNUM_WORD))


def keep_word(w: Column, stop_words: Iterable[str] | None) -> Column:
    """Word predicate: not a stop word (an ``InSet`` hash probe once the
    optimizer rewrites the literal list)."""
    if not stop_words:
        return F.lit(True)
    return ~w.isin(list(stop_words))


def doc_words(text: Column | str, mode: str = "contract") -> Column:
    """``array<array<string>>``: words per sentence, before stop-word removal.

    ``mode='builtin'`` uses Spark's locale-aware ``sentences()`` instead of the
    contract (JVM break iterators: different sentence and word boundaries,
    no SQL twin), lower-cased and filtered to letters and digits."""
    if mode == "builtin":
        return F.transform(F.sentences(_col(text)),
                           lambda ws: F.filter(F.transform(ws, lambda w: F.lower(w)), lambda w: w.rlike(ALNUM_WORD)))
    if mode != "contract":
        raise ValueError(f"unknown tokeniser mode {mode!r}")
    return F.transform(sentences(text), words_of)


def clean_words(text: Column | str, stop_words: Iterable[str] | None = ENGLISH_STOP_WORDS) -> Column:
    """``array<array<string>>``: kept words per sentence; emptied sentences stay."""
    stops = list(stop_words) if stop_words else None
    return F.transform(sentences(text), lambda s: F.filter(words_of(s), lambda w: keep_word(w, stops)))


def clean_string(text: Column | str, stop_words: Iterable[str] | None = ENGLISH_STOP_WORDS) -> Column:
    """The cleaned document string: each sentence's words joined by a space and
    followed by ``' . '`` (also for an emptied sentence, so slots stay aligned)."""
    return F.array_join(
        F.transform(clean_words(text, stop_words), lambda ws: F.concat(F.array_join(ws, " "), F.lit(" . "))),
        "",
    )


def strip_punctuation_text(text: Column | str) -> Column:
    """Whitespace tokens with ASCII punctuation stripped at both edges, empty
    ones dropped, re-joined by single spaces."""
    toks = F.transform(F.split(_col(text), WHITESPACE_RUN), lambda w: F.btrim(w, F.lit(ASCII_PUNCTUATION)))
    return F.array_join(F.filter(toks, lambda w: w != F.lit("")), " ")


def collapse_whitespace(text: Column | str) -> Column:
    """Missing text becomes empty; whitespace runs become one space; trimmed."""
    return F.btrim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), WHITESPACE_RUN, " "), F.lit(" "))


def whitespace_tokens(text: Column | str) -> Column:
    """``array<string>`` of non-empty whitespace-separated tokens."""
    return F.filter(F.split(_col(text), WHITESPACE_RUN), lambda w: w != F.lit(""))
