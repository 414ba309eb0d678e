"""Words of chosen documents: texts meet their rows first, and are cut once then."""

from pyspark.sql import functions as F

from glossa.catalog import models as M
from glossa.operators import tokens as tok


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_after_they_met_their_rows(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "red fox. the owl") for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(M.C, "docs", lambda s, d: texts)
    words = M.words_of(spark, None, spark.createDataFrame([(3, 7)], "doc_id long, code int"), "code")
    plan = plan_of(words.where(F.col("word") != "fox"))
    # a filter on the cut words was made below the join: it cut every text, and the chosen ones again above it
    assert plan.count("[.!?]+") == 1
    assert plan.index("[.!?]+") < plan.index("Join")
    assert sorted(r["word"] for r in words.collect()) == ["fox", "owl", "red"]


def test_tokens_of_both_kinds_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "The red fox. An owl!"), (2, None), (3, ""), (4, "the. Of")], "doc_id long, text string")
    for stop_words in (None, ["the", "of", "an"]):
        toks = tok.word_table(docs, stop_words=stop_words)
        assert plan_of(toks).count("[.!?]+") == 1
        assert sorted(map(str, toks.collect())) == sorted(map(str, tok.words_of(tok.cut_documents(docs, stop_words=stop_words)).collect()))
