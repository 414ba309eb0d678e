"""Leave-one-out importance by holders of dimensions equals pooling without the word."""

import math
import random

from pyspark.sql import functions as F

from glossa.operators import leave_one_out as LO


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def rows(df):
    return sorted(map(str, df.collect()))


def test_importance_is_pooling_without_the_word(spark):
    rng, inf = random.Random(5), float("inf")
    vec = {i: [rng.choice([-1.5, -0.5, 0.0, 0.25, 0.5, 2.0]) for _ in range(4)] for i in range(1, 12)}
    vec |= {9: [inf, 0.5, 0.0, 1.0], 10: [math.nan, 1.0, 0.0, 1.0], 11: [inf, 0.0, 2.5, 0.0]}
    docs = {d: rng.sample(range(1, 12), rng.randint(1, 5)) for d in range(80)} | {100: [3], 101: [9], 102: [9, 11], 103: [9, 1], 104: [1, 2]}
    words = spark.createDataFrame([(d, i) for d, ids in docs.items() for i in ids * 2] + [(None, 1)], "doc_id long, idx int")
    vectors = spark.createDataFrame(list(vec.items()), "idx int, vec array<float>")
    lost = F.zip_with("top", "pooled", lambda t, p: F.greatest(t, F.lit(0.0)) - F.greatest(p, F.lit(0.0)))
    slow = LO.pooled_without(LO.words_with_top_two(words, vectors)).select(
        "doc_id", "idx", F.round(F.aggregate(lost, F.lit(0.0), lambda a, x: a + x), 6).alias("importance"))
    fast = LO.importance(words, vectors, 3)
    assert rows(fast.withColumn("importance", F.round("importance", 6))) == rows(slow)
    # only the holders of a dimension are looked at again, and no word's vector
    assert "vec" not in plan(fast)
