"""Naive Bayes with whole-number parameters against a brute-force fit, and its edges."""

import math
import random
from collections import Counter

import pytest

from glossa.operators import bayes as NB
from glossa.session import scratch_path


def micro(x):
    return math.floor(math.log(x) * 1_000_000 + 0.5) if x >= 1 else -math.floor(-math.log(x) * 1_000_000 + 0.5)


def brute(rows, labels, n_classes):
    """Weights by word, priors, scores by document; rows are (doc, sentence, position, word)."""
    count = Counter((labels[d], w) for d, _, _, w in rows if labels.get(d) is not None)
    words = sorted({w for _, w in count})
    total = [sum(n for (c, _), n in count.items() if c == k) + len(words) for k in range(n_classes)]
    weights = {w: [micro((count[k, w] + 1) / total[k]) for k in range(n_classes)] for w in words}
    per = Counter(c for c in labels.values() if c is not None)
    priors = [micro((per[k] + 1) / (sum(per.values()) + n_classes)) for k in range(n_classes)]
    scores = {}
    for d, _, _, w in rows:
        if w in weights:
            s = scores.setdefault(d, list(priors))
            scores[d] = [a + b for a, b in zip(s, weights[w])]
    return weights, priors, scores


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, labels = [], {}
    for d in range(60):
        labels[d] = None if d % 10 == 9 else d % 3 if d != 7 else 3  # class 3 has one row, class 4 none
        for i in range(rng.randrange(0, 25)):
            rows.append((d, i // 6, i % 6, f"w{rng.randrange(12) + 4 * (d % 3)}"))
    rows += [(100, 0, 0, "unseen"), (101, 0, 0, "w1"), (101, 0, 1, "unseen"), (101, 0, 2, "w1")]
    return rows, labels


def frames(spark, corpus):
    rows, labels = corpus
    return (spark.createDataFrame(rows, "doc_id long, sent_pos int, word_pos int, word string"),
            spark.createDataFrame(list(labels.items()), "doc_id long, code int"))


def test_bayes_equals_brute_force(spark, corpus):
    tokens, labels = frames(spark, corpus)
    weights, priors, scores = brute(*corpus, 5)
    model = NB.fit(tokens, labels, 5)
    assert {r["word"]: list(r["w"]) for r in model.weights.collect()} == weights and model.priors == priors
    path = scratch_path(spark, "test-bayes")
    model.save(path)
    again = NB.NaiveBayes.load(spark, path)
    docs = spark.range(0, 103).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r for r in NB.predictions(again, tokens.repartition(7), docs).collect()}
    assert len(got) == 103
    for d, r in got.items():
        want = scores.get(d, priors)  # without a known word: the priors
        assert list(r["scores"]) == want and r["pred"] == want.index(max(want))
        e = [math.exp((x - max(want)) / 1e6) for x in want]
        assert all(abs(p - x / sum(e)) < 1e-12 for p, x in zip(r["probability"], e))


def test_evidence_adds_up(spark, corpus):
    tokens, labels = frames(spark, corpus)
    weights, _, _ = brute(*corpus, 5)
    model = NB.fit(tokens, labels, 5)
    preds = NB.predictions(model, tokens, tokens.select("doc_id").distinct())
    pred = {r["doc_id"]: r["pred"] for r in preds.collect()}
    words = NB.word_evidence(model, tokens, preds)
    got = {tuple(r[:4]): r["importance"] for r in words.collect()}
    known = [r for r in corpus[0] if r[3] in weights]
    assert set(got) == set(known)
    for r in known:
        w, p = weights[r[3]], pred[r[0]]
        assert got[r] == w[p] - max(w[:p] + w[p + 1:])
    sentences = tokens.select("doc_id", "sent_pos").distinct().unionByName(spark.createDataFrame([(101, 5)], "doc_id long, sent_pos int"))
    out = {(r["doc_id"], r["sent_pos"]): r for r in NB.sentence_evidence(words, sentences).collect()}
    assert out[101, 5]["importance"] == 0 and out[100, 0]["importance"] == 0
    for d, s in out:
        assert out[d, s]["importance"] == sum(v for k, v in got.items() if k[:2] == (d, s))
    assert abs(sum(r["weight"] for (d, _), r in out.items() if d == 101) - 1) < 1e-12


def test_bayes_without_words_or_one_class(spark):
    none = spark.createDataFrame([], "doc_id long, sent_pos int, word_pos int, word string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, code int")
    model = NB.fit(none, labels, 2)
    assert model.weights.count() == 0 and model.priors == [micro(2 / 5), micro(3 / 5)]
    assert [r["pred"] for r in NB.predictions(model, none, labels.select("doc_id")).collect()] == [1, 1, 1]
    words = spark.createDataFrame([(1, 0, 0, "a")], "doc_id long, sent_pos int, word_pos int, word string")
    one = NB.fit(words, labels.where("code = 0"), 1)
    preds = NB.predictions(one, words, labels.select("doc_id"))
    assert {tuple(r["probability"]) for r in preds.collect()} == {(1.0,)}
    assert NB.word_evidence(one, words, preds).first()["importance"] == list(one.weights.first()["w"])[0]
