"""Epoch batches are permutations; the incremental vocabulary equals one fit."""

import pytest
from pyspark.sql import functions as F

from glossa.operators import epochs as EP
from glossa.operators import vocab as V
from glossa.operators import vocab_state as VS
from glossa.session import scratch_path


def brute(place, n, seed, epoch):
    side = EP.side_of(n)
    while True:
        left, right = divmod(place, side)
        for a, b in EP.round_keys(seed, epoch):
            base = (right + a) % EP.PRIME
            left, right = right, (left + (base * base + b) % EP.PRIME) % side
        place = left * side + right
        if place < n:
            return place


@pytest.mark.parametrize("n", [1, 2, 3, 10, 37, 1024, 1025])
def test_permutation_of_any_size(spark, n):
    rows = EP.numbered(spark.range(5, 5 + n).withColumnRenamed("id", "doc_id"))
    got = EP.epoch_batches(rows, n, 1, 10, seed=7).collect()
    assert {r["doc_id"]: r["place"] for r in got} == {i + 5: brute(i, n, 7, 1) for i in range(n)}
    assert sorted(r["place"] for r in got) == list(range(n))
    assert all((r["batch"], r["slot"]) == divmod(r["place"], 10) for r in got)


def test_no_rows(spark):
    rows = EP.numbered(spark.range(0).withColumnRenamed("id", "doc_id"))
    assert EP.epoch_batches(rows, 0, 0, 10).collect() == []


def test_large_places_are_exact(spark):
    side, keys = EP.side_of(10 ** 15 + 7), EP.round_keys(1, 2)
    df = spark.createDataFrame([(p,) for p in (0, 1, 123456789012345, side * side - 1)], "p long")
    once = df.select("p", EP._permuted(F.col("p"), side, keys).alias("e"))
    for r in once.select("p", "e", EP._permuted(F.col("e"), side, keys, back=True).alias("back")).collect():
        assert (r["e"], r["back"]) == (brute(r["p"], side * side, 1, 2), r["p"])


def test_epochs_mix(spark):
    n = 4000
    rows = EP.numbered(spark.range(n).withColumnRenamed("id", "doc_id"))
    a, b = (EP.epoch_batches(rows, n, e, 100, seed=3).select("doc_id", F.col("batch").alias(f"b{e}")) for e in (0, 1))
    both = a.join(b, "doc_id")
    # 100 rows of a batch fall into the 40 batches of the next epoch, 2.5 each: no two batches stay together
    assert both.groupBy("b0", "b1").count().agg(F.max("count")).first()[0] < 20
    assert both.where("b0 = b1").count() < 300


SCHEMA = "doc_id long, sent_pos int, word_pos int, word string"


def toks(spark, docs):
    return spark.createDataFrame([(d, 0, i, w) for d, ws in docs.items() for i, w in enumerate(ws.split())], SCHEMA)


def ranks(df):
    return sorted((r["idx"], r["word"], r["n"]) for r in df.collect())


def test_parts_equal_one_fit(spark):
    docs = {1: "b a a", 2: "c b", 3: "a d d d", 4: "e", 5: "c c b"}
    root = scratch_path(spark, "vs")
    assert ranks(VS.ranked(spark, root)) == []
    assert VS.add_part(root, "late/1", toks(spark, {4: docs[4], 5: docs[5]}), "x")
    assert VS.add_part(root, "none", toks(spark, {}), "y")
    assert VS.add_part(root, "early", toks(spark, {k: docs[k] for k in (1, 2, 3)}), "z")
    want = ranks(V.vocab_rank(toks(spark, docs)))
    assert ranks(VS.ranked(spark, root)) == want
    assert not VS.add_part(root, "early", toks(spark, {1: docs[1]}), "z")  # offered again: ignored
    assert ranks(VS.ranked(spark, root)) == want
    with pytest.raises(ValueError):
        VS.add_part(root, "early", toks(spark, docs), "other rows")
    assert {r["part"]: (r["words"], r["tokens"]) for r in VS.manifest(spark, root).collect()} == {
        "late/1": (3, 4), "none": (0, 0), "early": (4, 9)}


def test_state_without_manifest_entry_is_not_read(spark):
    root = scratch_path(spark, "vs-killed")
    VS.add_part(root, "a", toks(spark, {1: "x y"}), "1")
    V.word_counts(toks(spark, {2: "x z"})).write.parquet(f"{root}/state/left-behind")
    assert ranks(VS.ranked(spark, root)) == [(1, "x", 1), (2, "y", 1)]
