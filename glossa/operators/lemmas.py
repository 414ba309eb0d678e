"""Morphological lemmas of nouns: suffix detachment checked against a lexicon.

A word's candidates are the word itself and what each detachment rule that fits
its ending makes of it. A candidate is accepted if the lexicon has it; of the
accepted ones the shortest wins (ties: the least by code points). An exception
table goes before the rules. A word without an accepted candidate stays as it is.

Everything works on distinct words, so hot words cost nothing more: candidates
are a map over them, acceptance is one semi-join with the lexicon, the choice
one aggregation. Only the words that change reach the table that tokens are
joined with, measured and broadcast when small (:func:`glossa.operators.tokens.lemmatize`).

Defined results: null words are left out; repeated words count once; an empty
lexicon gives the exceptions only; an empty word table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.stopwords import ENGLISH_STOP_WORDS
from glossa.operators import tokens as tok
from glossa.session import materialize

# The detachment rules for English nouns (ending, replacement).
NOUN_RULES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
              ("men", "man"), ("ies", "y"))
# Common irregular English nouns.
NOUN_EXCEPTIONS = {
    "children": "child", "feet": "foot", "geese": "goose", "halves": "half", "knives": "knife", "leaves": "leaf",
    "lives": "life", "loaves": "loaf", "mice": "mouse", "oxen": "ox", "people": "people", "shelves": "shelf",
    "teeth": "tooth", "thieves": "thief", "wives": "wife", "wolves": "wolf"}


def candidates(word: Column, rules: Iterable[tuple[str, str]] = NOUN_RULES) -> Column:
    """``array<string>``: the word and its detached forms (never an empty one)."""
    forms = [F.when(word.endswith(end) & (F.length(word) > len(end)), F.concat(
        F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(new))) for end, new in rules]
    return F.array_compact(F.array(word, *forms))


def lemma_table(words: DataFrame, lexicon: DataFrame | None = None, rules: Iterable[tuple[str, str]] = NOUN_RULES,
                exceptions: Mapping[str, str] = NOUN_EXCEPTIONS) -> DataFrame:
    """``(word, lemma)`` of the words in ``words(word, ...)`` that change.
    ``lexicon(word)`` holds the accepted forms; by default the words themselves."""
    distinct = materialize(words.select("word").where(F.col("word").isNotNull()).distinct())  # read four times
    known = distinct if lexicon is None else lexicon.select("word").distinct()
    forms = distinct.select("word", F.explode(candidates(F.col("word"), rules)).alias("form"))
    accepted = forms.join(known.withColumnRenamed("word", "form"), "form", "left_semi")
    chosen = accepted.groupBy("word").agg(F.min(F.struct(F.length("form").alias("n"), "form"))["form"].alias("lemma"))
    irregular = list(exceptions.items())
    if irregular:
        table = distinct.sparkSession.createDataFrame(irregular, "word string, lemma string")
        fixed = distinct.join(F.broadcast(table), "word")  # a literal table of this module or the caller's
        chosen = chosen.join(F.broadcast(table.select("word")), "word", "left_anti").unionByName(fixed)
    return chosen.where("word <> lemma")


def clean_lemma_text(docs: DataFrame, lemmas: DataFrame, text: str = "text", key: str = "doc_id",
                     stop_words: Iterable[str] | None = ENGLISH_STOP_WORDS) -> DataFrame:
    """``(doc_id, text)``: the cleaned string with lemmas in place of words (stop
    words go before). Emptied sentences keep their ``' . '``; null text stays
    null. ``key`` is unique. One shuffle of kept words by document."""
    sents = docs.select(F.col(key).alias("doc_id"), F.col(text).isNull().alias("missing"),
                        F.posexplode_outer(T.clean_words(text, stop_words)).alias("sent_pos", "ws"))
    toks = sents.select("doc_id", "missing", "sent_pos", F.posexplode_outer("ws").alias("word_pos", "word"))
    said = tok.lemmatize(toks, lemmas).groupBy("doc_id", "missing", "sent_pos").agg(
        F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word_pos", "word")))).alias("ws"))
    line = F.concat(F.array_join(F.transform("ws", lambda w: w["word"]), " "), F.lit(" . "))
    lines = F.array_sort(F.collect_list(F.when(F.col("sent_pos").isNotNull(), F.struct("sent_pos", line.alias("line")))))
    whole = F.array_join(F.transform(lines, lambda s: s["line"]), "")
    return said.groupBy("doc_id", "missing").agg(whole.alias("said")).select(
        "doc_id", F.when(~F.col("missing"), F.col("said")).alias("text"))
