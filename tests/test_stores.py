"""Stores: fingerprinted vocabulary reuse, prepared-set partitions, metric log."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from glossa.session import scratch_path
from glossa.sources import stores as ST
from glossa.sources import tables

from paths import SF001


def test_vocab_store_reuses_only_same_fingerprint(spark):
    docs = tables.documents(spark, SF001)
    a = ST.fingerprint(docs, kind="rank", cap=10)
    assert a == ST.fingerprint(docs, kind="rank", cap=10)
    b = ST.fingerprint(docs, kind="rank", cap=20)
    assert a != b
    root = scratch_path(spark, "t-store")
    calls = []

    def fit():
        calls.append(1)
        return spark.createDataFrame([("w", 1, 3)], "word string, idx int, n bigint")

    v1, reused1 = ST.vocab_store(spark, root, "docs", a, fit)
    v2, reused2 = ST.vocab_store(spark, root, "docs", a, fit)
    v3, reused3 = ST.vocab_store(spark, root, "docs", b, fit)
    assert (reused1, reused2, reused3) == (False, True, False) and len(calls) == 2
    assert v2.collect() == v1.collect()


def test_prepared_store_partitions_and_missing_path(spark):
    df = spark.createDataFrame([(1, "train", [1]), (2, "test", [2]), (3, "test", [3])],
                               "doc_id bigint, split string, x array<int>")
    path = scratch_path(spark, "t-prep")
    ST.write_prepared(df, path)
    assert sorted(r["doc_id"] for r in ST.read_prepared(spark, path, "test").collect()) == [2, 3]
    with pytest.raises(AnalysisException):
        ST.read_prepared(spark, path + "-missing").count()


def test_metric_log_appends_runs(spark):
    m = spark.createDataFrame([("acc", 1, 0.5), ("acc", 2, 0.7)], "tag string, step long, value double")
    path = scratch_path(spark, "t-metrics")
    ST.append_metrics(m, path, "run-a")
    ST.append_metrics(m.withColumn("value", F.col("value") + 0.1), path, "run-b")
    assert ST.read_metrics(spark, path).count() == 4
    got = [r["value"] for r in ST.read_metrics(spark, path, "run-b").orderBy("step").collect()]
    assert got == pytest.approx([0.6, 0.8])


def test_file_corpus_gets_stable_ids_and_can_be_prepared(spark, tmp_path):
    from glossa.plans.prepare import prepare_hierarchical
    from glossa.sources import files as FS

    rows = [("a", f"Word{i % 7} here. Another one, line\n{i}") for i in range(60)] + [("b", "same text. Twice.")] * 40
    path = str(tmp_path / "csv")
    FS.write_reviews_csv(spark.createDataFrame(rows, "label string, text string").repartition(5), path)
    read = FS.read_csv_reviews(spark, path, "label string, text string")
    ids = {r["doc_id"]: (r["label"], r["text"]) for r in FS.with_doc_ids(read).collect()}
    assert sorted(ids) == list(range(100)) and sorted(ids.values()) == sorted(rows)
    assert ids == {r["doc_id"]: (r["label"], r["text"]) for r in FS.with_doc_ids(read.repartition(3)).collect()}
    union = FS.with_doc_ids(FS.with_doc_ids(read).drop("doc_id").unionByName(read))
    assert union.select("doc_id").distinct().count() == 200
    assert prepare_hierarchical(FS.with_doc_ids(read), max_sentences=3, max_words=4, max_features=50).count() == 100


def test_corrupt_json_line_is_an_error(spark, tmp_path):
    import pytest

    from glossa.sources import files as FS

    (tmp_path / "a.json").write_text('{"stars": 1, "text": "x", "date": "2014-01-01T00:00:00"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        FS.read_jsonl_reviews(spark, str(tmp_path)).collect()
    assert FS.read_jsonl_reviews(spark, str(tmp_path), mode="DROPMALFORMED").count() == 1
