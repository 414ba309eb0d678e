"""One-year review corpus: read JSON lines, slice a year, normalise the star
label, clean the text, write CSV."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glossa.functions import labels as L
from glossa.functions import text as T
from glossa.functions.stopwords import ENGLISH_STOP_WORDS
from glossa.operators import lemmas as LM
from glossa.operators import slices as SL
from glossa.operators import tokens as tok
from glossa.session import materialize
from glossa.sources import files as FS


def prepare_year_corpus(spark: SparkSession, src: str, dest: str, year: int, full_year: bool = False,
                        stop_words=ENGLISH_STOP_WORDS, lemmas: bool = False) -> None:
    """The date filter runs before the cleaning, and both are one projection
    over the JSON scan (no shuffle). With ``lemmas``, words become lemmas by the
    slice's own words; rows have no key, so they are numbered and checkpointed first."""
    reviews = FS.read_jsonl_reviews(spark, src)
    sliced = SL.year_slice(reviews, "date", year, full_year)
    label = L.star_to_code(F.col("stars").cast("string")).alias("label")
    if lemmas:
        rows = materialize(sliced.select(F.monotonically_increasing_id().alias("doc_id"), label, "text"))
        table = LM.lemma_table(tok.clean_tokens(rows, stop_words=stop_words))
        out = rows.select("doc_id", "label").join(LM.clean_lemma_text(rows, table, stop_words=stop_words), "doc_id").drop("doc_id")
    else:
        out = sliced.select(label, T.clean_string("text", stop_words).alias("text"))
    FS.write_reviews_csv(out, dest)
