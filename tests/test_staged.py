"""Staged training against a numpy trainer; killed runs, restored epochs, odd inputs."""

import random

import numpy as np
import pytest

from glossa.operators import staged as SG
from glossa.session import scratch_path

SCHEMA = "doc_id long, code int, split string, idx array<int>"
N, C = 12, 3


def rows(seed=1, n=90):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        code = rng.randrange(C)
        ids = sorted({rng.randint(1, N) for _ in range(3)} | ({code * 4 + 1} if rng.random() < 0.5 else set()))
        out.append((i, code, rng.choice(["train", "train", "validation", "test"]), ids))
    return out + [(900, None, "train", [1]), (901, 1, "train", []), (902, 2, "validation", [])]


def brute(data, epochs, rate):
    """Coefficients and (train loss, validation loss, validation accuracy) after each epoch."""
    data = [r for r in data if r[1] is not None]
    x = np.zeros((len(data), N + 1))
    for r, (_, _, _, ids) in enumerate(data):
        x[r, 0] = 1
        for i in ids:
            x[r, i] = 1 / np.sqrt(len(ids))
    code, split = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    w, out = np.zeros((N + 1, C)), []

    def proba():
        e = np.exp(x @ w - (x @ w).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    train, valid = split == "train", split == "validation"
    for _ in range(epochs):
        off = proba() - np.eye(C)[code]
        w = w - rate / train.sum() * x[train].T @ off[train]
        p = proba()
        loss = -np.log(p[np.arange(len(data)), code])
        out.append((w.copy(), loss[train].mean(), loss[valid].mean(), (p.argmax(axis=1) == code)[valid].mean()))
    return out


def coefs(spark, path, epoch):
    got = SG.epoch_weights(spark, path, epoch).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(N + 1))
    return np.array([r["coefs"] for r in got])


def log(spark, path):
    out = {}
    for r in SG.history(spark, path).collect():
        out.setdefault(r["epoch"], {})[r["tag"]] = r["value"]
    return out


def test_equals_numpy_and_restores_the_best(spark):
    data, path = rows(), scratch_path(spark, "staged-t")
    best = SG.train_staged(spark.createDataFrame(data, SCHEMA), N, C, path, epochs=4, patience=9, rate=2.0)
    want, seen = brute(data, 4, 2.0), log(spark, path)
    assert sorted(seen) == [1, 2, 3, 4]
    for k, (w, train_loss, val_loss, accuracy) in enumerate(want, 1):
        assert np.allclose(coefs(spark, path, k), w, atol=1e-12)
        assert np.allclose([seen[k]["train_loss"], seen[k]["val_loss"], seen[k]["val_accuracy"]], [train_loss, val_loss, accuracy])
    top = max(w[3] for w in want)
    assert best == next(k for k, w in enumerate(want, 1) if w[3] == top)


def test_killed_run_goes_on(spark):
    data, path = rows(2), scratch_path(spark, "staged-k")
    df = spark.createDataFrame(data, SCHEMA)
    SG.train_staged(df, N, C, path, epochs=1, patience=9, rate=2.0)
    # killed in epoch 2: wrong coefficients are there, its metrics are not
    SG.epoch_weights(spark, path, 1).selectExpr("idx", "transform(coefs, c -> 99D) AS coefs").write.parquet(f"{path}/weights/epoch=2")
    SG.train_staged(df, N, C, path, epochs=3, patience=9, rate=2.0)
    assert sorted(log(spark, path)) == [1, 2, 3]
    assert np.allclose(coefs(spark, path, 3), brute(data, 3, 2.0)[2][0], atol=1e-12)
    with pytest.raises(ValueError):
        SG.train_staged(df, N, C, path, epochs=3, rate=1.0)


def test_stops_when_nothing_improves(spark):
    data = [(i, i % 2, s, [1 + i % 2]) for i, s in enumerate(["train"] * 8 + ["validation"] * 4)]
    path = scratch_path(spark, "staged-s")
    assert SG.train_staged(spark.createDataFrame(data, SCHEMA), N, C, path, epochs=9, patience=2) == 1
    assert sorted(log(spark, path)) == [1, 2, 3]  # all right from the first epoch on


def test_odd_inputs(spark):
    path = scratch_path(spark, "staged-o")
    none = spark.createDataFrame([], SCHEMA)
    assert SG.train_staged(none, N, C, path, epochs=1) == 1
    assert not coefs(spark, path, 1).any() and set(log(spark, path)[1].values()) == {None}
    with pytest.raises(ValueError):
        SG.train_staged(none, SG.MAX_PARAMETERS, 2, path)
    docs = spark.createDataFrame([(1, 0, "train"), (2, 1, "test")], "doc_id long, code int, split string")
    toks = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "zz"), (1, None)], "doc_id long, word string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "word string, idx int")
    got = SG.document_features(docs, toks, vocab, ["code", "split"]).orderBy("doc_id").collect()
    assert [r["idx"] for r in got] == [[1, 2], []]
