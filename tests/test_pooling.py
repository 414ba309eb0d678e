"""Pooling against brute force; no row with a vector is sorted, spilled or shuffled."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import leave_one_out as LO
from glossa.operators import pooling as PL


def made(spark, n=40):
    rng = random.Random(7)
    vec = {i: [rng.choice([-1.5, -0.25, 0.0, 0.5, 2.0]) for _ in range(4)] for i in range(1, 9)}
    rows = [(d, s, w, rng.randint(1, 8)) for d in range(n) for s in range(rng.randint(1, 3)) for w in range(rng.randint(1, 5))]
    ids = spark.createDataFrame(rows, "doc_id long, sent_pos int, word_pos int, idx int")
    return rows, vec, ids, spark.createDataFrame(list(vec.items()), "idx int, vec array<float>")


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_token_vectors_follow_ids(spark):
    rows, vec, ids, vecs = made(spark)
    got = PL.token_vectors(ids, vecs)
    assert sorted(map(tuple, got.select("doc_id", "sent_pos", "word_pos", "idx").collect())) == sorted(rows)
    assert all(list(r["vec"]) == vec[r["idx"]] for r in got.collect())
    for part in got.select(F.spark_partition_id().alias("p"), "idx").groupBy("p").agg(F.collect_list("idx").alias("i")).collect():
        assert part["i"] == sorted(part["i"])  # equal vectors are written side by side


def test_max_pool(spark):
    rows, vec, ids, vecs = made(spark)
    pooled = PL.max_pool(ids.join(F.broadcast(vecs), "idx"), dim=4)
    want = {d: [max(x) for x in zip(*(vec[i] for e, _, _, i in rows if e == d))] for d, *_ in rows}
    assert {r["doc_id"]: list(r["pooled"]) for r in pooled.collect()} == want
    assert pooled.schema["pooled"].dataType.simpleString() == "array<float>"
    assert not any(x in plan(pooled) for x in ("ObjectHashAggregate", "SortAggregate", "Sort ["))
    assert PL.max_pool(ids.join(vecs, "idx").where("false")).collect() == []


def test_attention_pool(spark):
    rows, vec, ids, vecs = made(spark)
    u, v = [0.5, -1.0, 0.25, 2.0], [1.0, 0.0, -0.5, 0.75]
    pooled = PL.attention_pool(ids.join(F.broadcast(vecs), "idx"), u, v)
    assert not any(x in plan(pooled) for x in ("ObjectHashAggregate", "SortAggregate", "Window", "Sort ["))

    def pool(xs, c):
        e = [math.exp(sum(math.tanh(a) * b for a, b in zip(x, c))) for x in xs]
        return [sum(k * a for k, a in zip(e, col)) / (sum(e) + 1e-7) for col in zip(*xs)]

    for r in pooled.collect():
        mine = [x for x in rows if x[0] == r["doc_id"]]
        sents = [pool([vec[i] for _, s, _, i in mine if s == k], u) for k in sorted({s for _, s, _, _ in mine})]
        assert list(r["doc_vec"]) == pytest.approx(pool(sents, v))


def test_leave_one_out_looks_vectors_up(spark):
    _, _, ids, vecs = made(spark)
    both = LO.importance(ids.select("doc_id", "idx"), vecs)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, LO.importance(ids.join(vecs, "idx")).collect()))
