"""Token rows are dealt evenly before they get vectors, and read from words that are cut once."""

from pyspark.sql import functions as F

from glossa.catalog import vectors as VC
from glossa.operators import encode as E
from glossa.operators import tokens as tok

DOCS = [(1, "Alpha beta. The of! Gamma\nalpha"), (1, "delta. beta"), (2, ""), (3, None), (None, "beta gamma"), (4, "the."), (5, "...")]


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def rows(df):
    return sorted(map(str, df.collect()))


def many(spark, path):
    spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("lang", F.lit("en")).coalesce(1).write.parquet(str(path / "documents.parquet"))
    vecs = [(i, [i - 1.0, 0.5, -0.25 * i]) for i in range(3)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(path / "embeddings.parquet"))


def test_dealt_positions_are_the_same(spark):
    docs = spark.createDataFrame(DOCS * 3, "doc_id long, text string")
    toks = tok.clean_tokens(docs)
    vocab = spark.createDataFrame([("beta", 1), ("gamma", 2)], "word string, idx int")
    got = E.token_ids(toks, vocab, partitions=3)
    assert rows(got) == rows(E.token_ids(toks, vocab))
    assert "hashpartitioning(doc_id" in plan(got) and "REPARTITION_BY_NUM" in plan(got)


def test_token_vectors_read_cut_words(spark, tmp_path):
    many(spark, tmp_path)
    assert "[.!?]+" not in plan(VC.token_vectors(spark, str(tmp_path)))
