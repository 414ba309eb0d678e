"""Properties that must hold for any input and any partitioning."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.catalog import common as C
from glossa.operators import encode as E
from glossa.operators import labels as OL
from glossa.operators import ranking as R
from glossa.operators import splits as SP
from glossa.operators import tokens as tok
from glossa.operators import vocab as V
from glossa.sources import tables

from paths import SF001, SF01


def test_global_rank_equals_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), "id").repartition(7)
    got = R.global_row_number(df, [F.col("k"), F.col("id")], "rn")
    want = df.withColumn("rn2", F.row_number().over(Window.orderBy("k", "id")))
    bad = got.join(want, ["k", "id"]).where(F.col("rn") != F.col("rn2")).count()
    assert bad == 0 and got.count() == 5000


def test_grouped_rank_equals_window_with_null_group(spark):
    df = spark.range(0, 3000).select(F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("g"),
                                     "id").repartition(5)
    got = R.grouped_row_number(df, ["g"], [F.col("id").desc()], "rn", total="n")
    want = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy(F.col("id").desc())))
    assert got.count() == 3000
    assert got.join(want, "id").where(F.col("rn") != F.col("rn2")).count() == 0


def _coded_labels(spark, d):
    lab = tables.read_table(spark, d, "labels", ["doc_id", "quality"]).withColumnRenamed("quality", "label")
    return OL.attach_codes(lab, OL.class_table(lab), with_one_hot=False)


def test_stratified_split_disjoint_cover_and_sizes(spark):
    coded = _coded_labels(spark, SF01)
    s = SP.stratified_split(coded, 0.8, 0.1, 0.1, seed=42)
    assert s.count() == coded.count() == s.select("doc_id").distinct().count()
    sizes = {(r["code"], r["split"]): r["n"] for r in s.groupBy("code", "split").agg(F.count("*").alias("n")).collect()}
    per_class = {r["code"]: r["n"] for r in coded.groupBy("code").agg(F.count("*").alias("n")).collect()}
    for code, n in per_class.items():
        n_train = round(0.8 * n)
        n_val = round(0.5 * (n - n_train))
        assert sizes.get((code, "train"), 0) == n_train
        assert sizes.get((code, "validation"), 0) == n_val
        assert sizes.get((code, "test"), 0) == n - n_train - n_val


def test_split_is_partitioning_independent(spark):
    coded = _coded_labels(spark, SF01)
    a = SP.stratified_split(coded.repartition(1), seed=7).select("doc_id", F.col("split").alias("a"))
    b = SP.stratified_split(coded.repartition(13), seed=7).select("doc_id", F.col("split").alias("b"))
    assert a.join(b, "doc_id").where("a != b").count() == 0


def test_split_fraction_guard(spark):
    import pytest

    coded = _coded_labels(spark, SF001)
    with pytest.raises(ValueError):
        SP.stratified_split(coded, 0.7, 0.2, 0.2)
    with pytest.raises(ValueError):
        SP.stratified_split(coded, 1.1, -0.05, -0.05)
    SP.stratified_split(coded, 0.7, 0.2, 0.1)  # float error tolerated


def test_random_split_disjoint(spark):
    docs = tables.documents(spark, SF01).select("doc_id")
    s = SP.random_split(docs, 0.8, seed=42)
    counts = {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 1000 and counts["train"] == 800 and counts["test"] == 100


def test_matrix_shape_ids_and_tail_padding(spark):
    docs = tables.documents(spark, SF001)
    toks = tok.clean_tokens(docs)
    vcap = V.vocab_topk(toks, 300)
    m, k = 7, 9
    mats = E.doc_matrix(docs.select("doc_id"), toks, vcap, m, k).collect()
    assert len(mats) == docs.count()
    for r in mats:
        x = r["x"]
        assert len(x) == m and all(len(row) == k for row in x)
        for row in x:
            assert all(0 <= v < 300 for v in row)
            nz = [v != 0 for v in row]
            assert nz == sorted(nz, reverse=True)  # zeros only at the tail


def test_vocab_topk_equals_full_rank_prefix(spark):
    toks = C.clean_tokens(spark, SF001)
    full = V.vocab_rank(toks)
    top = V.vocab_topk(toks, 200)
    diff = top.exceptAll(full.where("idx < 200"))
    assert diff.count() == 0 and top.count() == 199


def test_sequence_encoding_shape(spark):
    docs = tables.documents(spark, SF001)
    vocab = V.vocab_topk(tok.word_table(docs), 100)
    for r in E.sequence_encode(docs, vocab, 16).collect():
        assert len(r["ids"]) == len(r["mask"]) == len(r["token_type_ids"]) == 16
        assert r["ids"][0] == E.BEGIN
        n = sum(r["mask"])
        assert r["ids"][n - 1] == E.END and all(v == E.PAD for v in r["ids"][n:])


def test_report_support_sums_to_rows(spark):
    from glossa.catalog.metrics import scored
    from glossa.operators import metrics as MT

    s = scored(spark, SF001)
    rep = {r["row"]: r for r in MT.classification_report(s).collect()}
    per_class = [v["support"] for k, v in rep.items() if k not in ("accuracy", "macro avg", "weighted avg")]
    assert sum(per_class) == s.count() == rep["accuracy"]["support"]


def test_top_k_large_path_equals_small_path(spark, monkeypatch):
    df = spark.range(0, 3000).select((F.col("id") % 97).alias("n"), "id").repartition(6)
    order = [F.col("n").desc(), F.col("id")]
    small = R.top_k_ranked(df, order, 500, "r", partitions=6)
    monkeypatch.setattr(R, "MAX_TAKE_ORDERED_ROWS", 10)
    large = R.top_k_ranked(df, order, 500, "r", partitions=6)
    assert small.count() == large.count() == 500
    assert small.exceptAll(large.select(*small.columns)).count() == 0


def test_broadcast_ceiling_falls_back_to_shuffle_join(spark):
    from glossa.operators import joins as J
    from glossa.session import shuffle_partitions_for

    docs = tables.documents(spark, SF001)
    toks = tok.clean_tokens(docs)
    vocab = V.vocab_topk(toks, 300)
    small = E.token_ids(toks, vocab)
    spark.conf.set("glossa.broadcast.maxBytes", "10")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "ResolvedHint" not in J.bounded_broadcast(vocab)._jdf.queryExecution().analyzed().toString()
        big = E.token_ids(toks, vocab)
        plan = big._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert small.exceptAll(big).count() == 0 and big.exceptAll(small).count() == 0
    finally:
        spark.conf.unset("glossa.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffle_partitions_for(100 * 2**40, 4000) == 200_000
    assert shuffle_partitions_for(1 << 20, 8) == 16


def test_early_stop_looks_no_further_than_the_stop(spark):
    from glossa.operators.metrics import early_stop

    series = [.5, .6, .55, .55, .55, .55, .9]
    rows = [("a", i + 1, v) for i, v in enumerate(series)] + [("b", i + 1, v) for i, v in enumerate([.1, .2, .3])]
    got = {r["tag"]: (r["best_epoch"], r["best_value"], r["stop_epoch"])
           for r in early_stop(spark.createDataFrame(rows, "tag string, epoch long, value double"), patience=4).collect()}
    assert got == {"a": (2, .6, 6), "b": (3, .3, None)}


def test_refused_broadcast_is_not_forced_by_the_flag(spark):
    from glossa.operators import encode as E
    from glossa.operators.joins import bounded_broadcast

    toks = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b")], "doc_id long, sent_pos int, word_pos int, word string")
    vocab = bounded_broadcast(spark.createDataFrame([("a", 1)], "word string, idx int"), max_bytes=1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.token_ids(toks, vocab, vocab_measured=True)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan


def test_long_words_have_pieces():
    from glossa.operators.subword import greedy_pieces

    assert greedy_pieces("ab" * 80, {"ab": 4, "##ab": 5}) == [4] + [5] * 79


def test_summary_words_come_from_the_summary(spark):
    from glossa.catalog import queries

    for r in queries()["explain_docs"](spark, "/root/testdata/sf0.001").collect():
        words = (r["summary"] or "").lower()
        assert all(w in words for w in r["top_words"] or [])
