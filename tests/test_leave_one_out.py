"""Leave-one-out pools against pooling again without the word."""

import random

from glossa.operators import leave_one_out as LO

SCHEMA = "doc_id long, idx int, vec array<float>"


def test_equals_pooling_again(spark):
    rng = random.Random(4)
    vec = {i: [rng.choice([-1.5, -0.5, 0.0, 0.25, 0.5, 2.0]) for _ in range(5)] for i in range(1, 9)}
    vec[8] = vec[1]  # two words that hold each other up
    docs = {d: [rng.randint(1, 8) for _ in range(rng.randint(1, 6))] for d in range(60)} | {100: [3, 3, 3], 101: [1, 8], 102: [2] * 2000}
    rows = [(d, i, vec[i]) for d, ids in docs.items() for i in ids]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["doc_id"], r["idx"]): (list(r["top"]), list(r["pooled"])) for r in
           LO.pooled_without(LO.words_with_top_two(df)).collect()}
    assert set(got) == {(d, i) for d, i, _ in rows}

    def pool(ids):
        return [max(x) for x in zip(*(vec[i] for i in ids))] if ids else [0.0] * 5

    for (d, i), (top, pooled) in got.items():
        assert top == pool(docs[d]) and pooled == pool([j for j in docs[d] if j != i])
    drop = {(r["doc_id"], r["idx"]): r["importance"] for r in LO.importance(df).collect()}
    assert drop[101, 1] == drop[101, 8] == 0.0
    assert drop[100, 3] == sum(max(v, 0) for v in vec[3])
    assert LO.importance(df.where("false")).collect() == []
