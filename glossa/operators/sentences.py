"""Learnt sentence boundaries: a period after an abbreviation ends no sentence.

Abbreviations are word types that nearly always carry a period: each type gets a
log-likelihood ratio of "its period belongs to it" (99 %) against "periods come as
often as after any word", scaled up by inner periods, down by length and by every
occurrence without a period (the statistics of Kiss and Strunk, 2006). They come
from one aggregation by word type with map-side combine; splitting is map-only,
with the accepted types as a hashed literal set, as stop words are.

Defined results: a line break always ends a sentence; null text has no
sentences; blank ones are dropped, the others numbered from 0 and trimmed; a
corpus without words or without periods has no abbreviations; at most
:data:`MAX_ABBREVIATIONS` types (more is an error, not a cut).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T

THRESHOLD = 0.3
MAX_ABBREVIATIONS = 20_000
OWN_PERIOD = 0.99
BRACKETS = "\"'()[]{}"
WORD_TYPE = r"^\p{L}+(\.\p{L}+)*\.?$"
LINE_BREAK = "[" + T.WS + r"]*\n[" + T.WS + "]*"
STOP = r"([.!?]+[\"')\]]*)[" + T.WS + "]+"
LAST_TYPE = "(^|[" + T.WS + "\x02\"'(\\[{])" + r"(\p{L}+(\.\p{L}+)*)\.$"


def word_types(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(type, n, n_period)``: occurrences of each lower-case type, and those with a period after it."""
    token = docs.select(F.explode(F.split(F.lower(F.col(text)), T.WHITESPACE_RUN)).alias("raw")).select(
        F.btrim("raw", F.lit(BRACKETS)).alias("token")).where(F.col("token").rlike(WORD_TYPE))
    ends = F.col("token").endswith(".")
    kind = F.when(ends, F.expr("left(token, length(token) - 1)")).otherwise(F.col("token"))
    return token.select(kind.alias("type"), ends.cast("long").alias("p")).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("n_period"))


def abbreviation_scores(types: DataFrame) -> DataFrame:
    """``(type, n, n_period, score)`` of the types seen with a period."""
    totals = types.agg(F.sum("n").alias("all"), F.sum("n_period").alias("periods")).first()  # two numbers
    if not totals["periods"]:
        return types.where("false").withColumn("score", F.lit(0.0))
    share = totals["periods"] / totals["all"]
    bare = F.col("n") - F.col("n_period")
    if share == 1.0:  # every word has a period: they tell nothing
        ratio = F.lit(0.0)
    else:
        def likelihood(p: float) -> Column:
            return F.col("n_period") * F.ln(F.lit(p)) + bare * F.ln(F.lit(1.0 - p))

        ratio = F.lit(-2.0) * (likelihood(share) - likelihood(OWN_PERIOD))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - letters
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -bare.cast("double"))
    return types.where("n_period > 0").withColumn("score", score)


def abbreviations(types: DataFrame, threshold: float = THRESHOLD) -> list[str]:
    """The accepted types, sorted: the splitter's parameter."""
    found = abbreviation_scores(types).where(F.col("score") >= threshold).select("type")
    rows = found.limit(MAX_ABBREVIATIONS + 1).collect()
    if len(rows) > MAX_ABBREVIATIONS:
        raise ValueError(f"more than {MAX_ABBREVIATIONS} abbreviations: raise the threshold")
    return sorted(r["type"] for r in rows)


def learnt_sentences(text: Column | str, known: list[str]) -> Column:
    """``array<string>``: the sentences of a text, with their marks."""
    source = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(F.regexp_replace(source, LINE_BREAK, "\x02"), STOP, "$1\x01")
    last = lambda p: F.regexp_extract(F.lower(p), LAST_TYPE, 2)
    joined = F.array_join(F.transform(F.split(marked, "\x01"), lambda p: F.concat(
        p, F.when(last(p).isin(known), F.lit(" ")).otherwise(F.lit("\x02")) if known else F.lit("\x02"))), "")
    trimmed = F.transform(F.split(joined, "\x02"), lambda s: F.btrim(s, F.lit(" \t\n\r\f")))
    return F.filter(trimmed, lambda s: s != "")


def sentence_table(docs: DataFrame, known: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, sent_pos, sentence)``."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(learnt_sentences(text, known)).alias("sent_pos", "sentence"))
