"""Words are cut once for the vector queries and dealt before they get vectors."""

from pyspark.sql import functions as F

from glossa.catalog import vectors as VC
from glossa.operators import pooling as PL
from glossa.operators import tokens as tok
from glossa.session import landed

DOCS = [(1, "Alpha beta. The of! Gamma\nalpha"), (1, "delta. beta"), (2, ""), (3, None), (None, "beta gamma"), (4, "the."), (5, "...")]


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def rows(df):
    return sorted(map(str, df.collect()))


def test_texts_are_cut_once_in_a_plan(spark):
    toks = tok.clean_tokens(spark.createDataFrame(DOCS, "doc_id long, text string"))
    # a filter on the cut words would cut them again
    assert plan(toks).count("[.!?]+") <= 1


def many(spark, path):
    spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("lang", F.lit("en")).coalesce(1).write.parquet(str(path / "documents.parquet"))
    vecs = [(i, [i - 1.0, 0.5, -0.25 * i]) for i in range(3)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(path / "embeddings.parquet"))


def test_dealt_words(spark):
    cut = landed(tok.cut_documents(spark.createDataFrame(DOCS, "doc_id long, text string")), "cut")
    dealt = tok.dealt_words(cut, 3)
    assert rows(dealt.where("word <> ''")) == rows(tok.words_of(cut).select("doc_id", "sent_pos", "word"))
    # sums of sentences and of documents are made where the words are
    with_vec = dealt.withColumn("vec", F.array(F.lit(1.0), F.lit(2.0))).withColumn("score", F.lit(0.5))
    assert plan(PL.attention_pool(with_vec, [1.0, 2.0], [1.0, 2.0])).count("Exchange") == 1


def test_attention_pool_shuffles_no_sentence_sums(spark, tmp_path, monkeypatch):
    many(spark, tmp_path)
    monkeypatch.setattr(VC.tables, "with_parallelism_floor", lambda df, key=None: df)  # as on a large corpus
    out = VC.attention_pool(spark, str(tmp_path))
    assert "keys=[doc_id" in plan(out) and not any("Exchange" in x and "sent_pos" in x for x in plan(out).splitlines())
    assert sorted(r["doc_id"] or 0 for r in out.where("pos = 0").collect()) == [0, 1, 1, 2, 3, 4, 5]
