"""Learnt abbreviations against a brute-force count, and splits by them."""

import math
import re
from collections import Counter

from glossa.operators import sentences as SN

TEXT = ("Dr. Smith met Mrs. Jones at 5 p.m. sharp. They spoke of the garden. The garden was green! Was it? "
        "He said (so did she) that Dr. Brown knew. Nobody knew the garden. It rained.\nMr.\nGreen left.")
WORDS = "They walk to the house and see it near the people who knew the garden. " * 30


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def brute(texts):
    n, with_period = Counter(), Counter()
    for text in texts:
        for raw in re.split(r"[ \t\n\r\f]+", (text or "").lower()):
            token = raw.strip(SN.BRACKETS)
            if re.fullmatch(r"[^\W\d_]+(\.[^\W\d_]+)*\.?", token):
                n[token.removesuffix(".")] += 1
                with_period[token.removesuffix(".")] += token.endswith(".")
    p, out = sum(with_period.values()) / sum(n.values()), {}
    for t, k in with_period.items():
        if k:
            bare, letters = n[t] - k, len(t.replace(".", ""))
            ratio = -2 * (k * math.log(p) + bare * math.log(1 - p) - k * math.log(0.99) - bare * math.log(0.01))
            out[t] = (n[t], k, ratio * math.exp(-letters) * (t.count(".") + 1) * letters ** -bare)
    return out


def test_scores_equal_brute_force(spark):
    texts = [TEXT, WORDS, None, "", TEXT]
    got = SN.abbreviation_scores(SN.word_types(docs(spark, *texts))).collect()
    want = brute(texts)
    assert {r["type"] for r in got} == set(want)
    for r in got:
        assert (r["n"], r["n_period"]) == want[r["type"]][:2]
        assert math.isclose(r["score"], want[r["type"]][2], rel_tol=1e-9, abs_tol=1e-300)


def test_dr_smith(spark):
    df = docs(spark, TEXT, WORDS, None, "", " \n ", "No end")
    known = SN.abbreviations(SN.word_types(docs(spark, TEXT, WORDS, TEXT)))
    assert {"dr", "mrs", "mr", "p.m"} <= set(known) and not {"garden", "it", "knew"} & set(known)
    rows = SN.sentence_table(df, known).orderBy("doc_id", "sent_pos").collect()
    assert [r["sentence"] for r in rows if r["doc_id"] == 0] == [
        "Dr. Smith met Mrs. Jones at 5 p.m. sharp.", "They spoke of the garden.", "The garden was green!", "Was it?",
        "He said (so did she) that Dr. Brown knew.", "Nobody knew the garden.", "It rained.", "Mr.", "Green left."]
    assert sum(r["doc_id"] == 1 for r in rows) == 30
    assert [(r["doc_id"], r["sent_pos"], r["sentence"]) for r in rows if r["doc_id"] > 1] == [(5, 0, "No end")]


def test_no_words_no_periods(spark):
    for df in (docs(spark, None, "", "no period here"), spark.createDataFrame([], "doc_id long, text string"),
               docs(spark, "all. have. one.")):
        assert SN.abbreviations(SN.word_types(df)) == []
    got = SN.sentence_table(docs(spark, "Dr. Smith came."), []).collect()
    assert [r["sentence"] for r in got] == ["Dr.", "Smith came."]
