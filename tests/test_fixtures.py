"""Literal fixtures: small inputs whose expected values follow from the
semantics being reproduced."""

from datetime import datetime

from pyspark.sql import functions as F

from glossa.functions import labels as L
from glossa.functions import text as T
from glossa.functions import vectors as VX
from glossa.functions.timefmt import format_duration
from glossa.operators import encode as E
from glossa.operators import explain as X
from glossa.operators import labels as OL
from glossa.operators import metrics as MT
from glossa.operators import slices as SL
from glossa.operators import stats
from glossa.operators import tokens as tok
from glossa.sources import files as FS
from glossa.session import scratch_path


def test_onehot_string_decode(spark):
    df = spark.createDataFrame([("0000000001",), ("0000001000",), ("1000000000",), ("junk",)], "s string")
    got = [r[0] for r in df.select(L.onehot_string_to_code("s")).collect()]
    assert got == [0, 3, 9, None]


def test_star_label(spark):
    vals = [("5.0",), ("3",), (" 2 ",), ("label",), ("nan",), ("inf",), (None,)]
    df = spark.createDataFrame(vals, "s string")
    assert [r[0] for r in df.select(L.star_to_code("s")).collect()] == [4, 2, 1, 0, 0, 0, 0]


def test_year_bounds(spark):
    rows = [(datetime(2014, 1, 1),), (datetime(2014, 12, 30),), (datetime(2014, 12, 30, 0, 1),),
            (datetime(2014, 12, 31),), (datetime(2013, 12, 31, 23, 59),)]
    df = spark.createDataFrame(rows, "d timestamp_ntz")
    inside = [r[0] for r in SL.year_slice(df, "d", 2014).collect()]
    assert inside == [datetime(2014, 1, 1), datetime(2014, 12, 30)]
    outside = SL.year_complement(df, "d", 2014).count()
    assert outside == 3
    assert SL.year_slice(df, "d", 2014, full_year=True).count() == 4


def test_encode_skips_unknown_and_overcap(spark):
    vocab = spark.createDataFrame([("good", 1), ("food", 2), ("bad", 3)], "word string, idx int")
    docs = spark.createDataFrame([(1, "good zzz food bad")], "doc_id bigint, text string")
    toks = tok.clean_tokens(docs, stop_words=None)
    mat = E.doc_matrix(docs.select("doc_id"), toks, vocab.where("idx < 3"), 1, 4).collect()[0]["x"]
    assert mat == [[1, 2, 0, 0]]


def test_empty_document_gets_zero_matrix(spark):
    vocab = spark.createDataFrame([("good", 1)], "word string, idx int")
    docs = spark.createDataFrame([(1, ""), (2, "the. of.")], "doc_id bigint, text string")
    toks = tok.clean_tokens(docs)
    rows = {r["doc_id"]: r["x"] for r in E.doc_matrix(docs.select("doc_id"), toks, vocab, 2, 3).collect()}
    assert rows == {1: [[0, 0, 0], [0, 0, 0]], 2: [[0, 0, 0], [0, 0, 0]]}


def test_class_codes_numeric_order(spark):
    df = spark.createDataFrame([(10,), (2,), (1,), (2,)], "label int")
    got = {r["label"]: r["code"] for r in OL.class_table(df).collect()}
    assert got == {10: 2, 2: 1, 1: 0}


def test_one_hot(spark):
    df = spark.createDataFrame([(2,)], "c int")
    assert df.select(L.one_hot("c", 5)).first()[0] == [0, 0, 1, 0, 0]


def test_argmax_first_maximum(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5],)], "x array<double>")
    assert df.select(VX.argmax("x")).first()[0] == 1


def test_tercile_and_quartile_sizes(spark):
    words = spark.createDataFrame([(1, 0, i, f"w{i}", 100 - i) for i in range(11)],
                                  "doc_id bigint, sent_pos int, word_pos int, word string, weight bigint")
    levels = [r["level"] for r in X.word_terciles(words).orderBy("word_pos").collect()]
    assert [levels.count(x) for x in ("high", "medium", "low")] == [4, 4, 3]
    sents = spark.createDataFrame([(1, i, 50 - i) for i in range(10)], "doc_id bigint, sent_pos int, weight bigint")
    q = [r["level"] for r in X.sentence_quartiles(sents).collect()]
    assert [q.count(x) for x in ("high", "medium", "low", "none")] == [3, 3, 2, 2]


def test_duration_text(spark):
    df = spark.createDataFrame([(2.5,), (3661.0,), (90061.0,), (3.5,), (2 * 86400.0,)], "s double")
    got = [r[0] for r in df.select(format_duration(F.col("s"))).collect()]
    assert got == ["0:00:02", "1:01:01", "1 day, 1:01:01", "0:00:04", "2 days, 0:00:00"]


def test_average_rounds_half_to_even(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma. delta epsilon.")], "doc_id bigint, text string")
    row = stats.corpus_stats(docs).first()
    assert (row["n_words"], row["n_sentences"], row["words_per_sentence"]) == (5, 2, 2)


def test_report_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "label int, pred int")
    rep = {r["row"]: r for r in MT.classification_report(df).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["f1"] == 0.0 and rep["1"]["support"] == 1
    macro_f1 = (rep["0"]["f1"] + 0.0 + rep["2"]["f1"]) / 3
    assert abs(rep["macro avg"]["f1"] - macro_f1) < 1e-6
    assert rep["accuracy"]["f1"] == 0.75


def test_csv_round_trip_keeps_text(spark):
    text = 'first line\nsecond, with comma and "quoted" words . '
    df = spark.createDataFrame([("1", text)], "label string, text string")
    path = scratch_path(spark, "t-csv")
    FS.write_reviews_csv(df, path)
    back = FS.read_csv_reviews(spark, path, "label string, text string").first()
    assert back["text"] == text


def test_clean_string_keeps_sentence_slots(spark):
    df = spark.createDataFrame([("The cat sat. It was the. Dogs run!",)], "text string")
    assert df.select(T.clean_string("text")).first()[0] == "cat sat .  . dogs run! . ".replace("run!", "run")


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1000.0, 1000.0],)], "x array<double>")
    for r in df.select(VX.softmax("x").alias("p")).collect():
        assert abs(sum(r["p"]) - 1.0) < 1e-12


def test_cross_entropy_modes(spark):
    import math

    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2)], "x array<double>, c int")
    row = df.select(VX.cross_entropy(VX.softmax("x"), "c").alias("a"),
                    VX.cross_entropy("x", "c", mode="logits").alias("b"),
                    VX.cross_entropy(VX.softmax("x"), "c", mode="double_softmax").alias("d")).first()
    want = -math.log(math.exp(3) / (math.exp(1) + math.exp(2) + math.exp(3)))
    assert abs(row["a"] - want) < 1e-12 and abs(row["b"] - want) < 1e-12
    p = [math.exp(v) / sum(math.exp(u) for u in (1, 2, 3)) for v in (1, 2, 3)]
    want_d = -math.log(math.exp(p[2]) / sum(math.exp(v) for v in p))
    assert abs(row["d"] - want_d) < 1e-12


def test_builtin_sentence_mode(spark):
    df = spark.createDataFrame([("Hello world. Second one here!",)], "text string")
    got = df.select(T.doc_words("text", mode="builtin")).first()[0]
    assert got == [["hello", "world"], ["second", "one", "here"]]


def test_greedy_subword_pieces():
    from glossa.operators.subword import UNK, greedy_pieces

    table = {"play": 10, "p": 11, "##ing": 12, "##i": 13, "##n": 14, "##g": 15, "##s": 16}
    assert greedy_pieces("playing", table) == [10, 12]
    assert greedy_pieces("plays", table) == [10, 16]
    assert greedy_pieces("xyz", table) == [UNK]
    assert greedy_pieces("p" * 101, table) == [UNK]
