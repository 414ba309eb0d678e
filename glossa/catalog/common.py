"""Inputs shared by the registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.functions.stopwords import ENGLISH_STOP_WORDS
from glossa.operators import tokens as tok
from glossa.sources import tables

# Parameters of the registered queries (the reference's preparation defaults
# scaled to the test corpus: 50 000 features, 20 sentences x 40 words).
MAX_FEATURES = 50000
MAX_SENTENCES = 20
MAX_WORDS = 40
SEED = 42
YEAR = 1995
MAX_LEN = 128


def docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.documents(spark, d)


def corpus(spark: SparkSession, d: str, label: str = "lang") -> DataFrame:
    return tables.labelled_corpus(spark, d, label)


def clean_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tok.clean_tokens(docs(spark, d), stop_words=ENGLISH_STOP_WORDS)


def raw_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tok.word_table(docs(spark, d), stop_words=None)
