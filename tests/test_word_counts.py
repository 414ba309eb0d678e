"""Counts and first appearances of words, against a brute-force table; how they are aggregated."""

import random

from glossa.operators import vocab as V

TOKENS = "doc_id long, sent_pos int, word_pos int, word string"


def brute(rows):
    seen = {}
    for doc, sent, pos, word in rows:
        seen.setdefault(word, []).append(((doc is not None, doc or 0), sent, pos, doc))
    return {(w, len(at), min(at, key=lambda a: a[:3])[3], *min(at, key=lambda a: a[:3])[1:3]) for w, at in seen.items()}


def test_first_appearances_equal_brute_force(spark):
    rng = random.Random(5)
    docs = [None, 0, -1, 1, -(1 << 63), (1 << 63) - 1, 1 << 40]
    places = [0, 1, 7, (1 << 31) - 1]
    rows = [(rng.choice(docs), rng.choice(places), rng.choice(places), f"w{rng.randint(0, 150)}") for _ in range(400)]
    rows += [(d, (1 << 31) - 1, (1 << 31) - 1, f"only{i}") for i, d in enumerate(docs)] + rows[:20]
    got = {tuple(r) for r in V.word_counts(spark.createDataFrame(rows, TOKENS)).collect()}
    assert got == brute(rows)


def test_other_keys_are_compared_as_they_are(spark):
    df = spark.createDataFrame([("b", 0, 0, "x"), ("a", 3, 1, "x"), ("a", 2, 5, "x")], TOKENS.replace("doc_id long", "doc_id string"))
    assert [tuple(r) for r in V.word_counts(df).collect()] == [("x", 3, "a", 2, 5)]


def test_tokens_are_hashed_not_sorted(spark):
    df = spark.createDataFrame([(1, 0, 0, "x")], TOKENS)
    plan = V.word_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
