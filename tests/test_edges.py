"""Edge data: tiny classes, short documents, multilingual letters, nulls,
and streaming output equal to batch output."""

from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import explain as X
from glossa.operators import labels as OL
from glossa.operators import splits as SP
from glossa.operators import tokens as tok

from paths import SF001


def test_class_with_one_row_and_null_label(spark):
    rows = [(i, "a") for i in range(10)] + [(10, "b"), (11, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, label string")
    coded = OL.attach_codes(df, OL.class_table(df), with_one_hot=False)
    s = {r["doc_id"]: (r["code"], r["split"]) for r in SP.stratified_split(coded, seed=1).collect()}
    assert len(s) == 12  # nothing dropped
    assert s[10] == (1, "train")  # bround(0.8 * 1) = 1
    assert s[11][0] is None  # a null label is its own stratum, still split
    a = [v[1] for k, v in s.items() if k < 10]
    assert a.count("train") == 8 and a.count("validation") == 1 and a.count("test") == 1


def test_fewer_sentences_than_n(spark):
    sw = spark.createDataFrame([(1, 0, 5), (1, 1, 9)], "doc_id bigint, sent_pos int, weight bigint")
    top = X.top_sentences(sw, 3).orderBy("rank").collect()
    assert [(r["sent_pos"], r["rank"]) for r in top] == [(1, 1), (0, 2)]


def test_multilingual_letters_kept(spark):
    df = spark.createDataFrame([(1, "Straße, café y niño! Ça va? Ölçü 42x e-mail don't")], "doc_id bigint, text string")
    words = [r["word"] for r in tok.word_table(df).orderBy("sent_pos", "word_pos").collect()]
    assert words == ["straße", "café", "y", "niño", "ça", "va", "ölçü", "42x"]


def test_one_word_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "Hello"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", T.clean_string("text").alias("c")).collect()}
    assert got == {1: "hello . ", 2: "", 3: None}


def test_stream_scores_equal_batch(spark):
    from glossa.catalog.models import fitted_text_model
    from glossa.catalog.streams import land
    from glossa.operators import models as MD
    from glossa.session import scratch_path
    from glossa.streaming import jobs

    model, data, _ = fitted_text_model(spark, SF001)
    batch = MD.predictions(model, data).select("doc_id", F.col("pred").alias("b"))
    out, ck = scratch_path(spark, "t-ss"), scratch_path(spark, "t-ss-ck")
    jobs.stream_score(spark, land(spark, SF001), out, ck, model, max_files=1)
    streamed = spark.read.parquet(out).select("doc_id", F.col("pred").alias("s"))
    assert streamed.count() == 200
    assert streamed.join(batch, "doc_id").where("s != b").count() == 0
