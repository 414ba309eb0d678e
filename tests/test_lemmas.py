"""Noun lemmas against a brute-force table, and the lemmatised text of odd documents."""

import random

from glossa.functions.stopwords import ENGLISH_STOP_WORDS
from glossa.operators import lemmas as LM
from glossa.operators import tokens as tok


def brute(words, lexicon):
    out = {}
    for w in {w for w in words if w is not None}:
        forms = [w] + [w[:-len(end)] + new for end, new in LM.NOUN_RULES if w.endswith(end) and len(w) > len(end)]
        known = [(len(f), f) for f in forms if f in lexicon]
        lemma = LM.NOUN_EXCEPTIONS.get(w) or (min(known)[1] if known else w)
        if lemma != w:
            out[w] = lemma
    return out


def words(spark, ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def table(df):
    return {r["word"]: r["lemma"] for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abehnmsxyzv") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    ends = ["", "s", "ses", "ves", "xes", "zes", "ches", "shes", "men", "ies", "f", "x", "y", "man", "ch", "sh"]
    ws = [s + rng.choice(ends) for s in stems for _ in range(4)] + ["children", "feet", "mice", "people", None]
    assert table(LM.lemma_table(words(spark, ws))) == brute(ws, set(ws))
    lexicon = sorted({w for w in ws if w})[::2]
    assert table(LM.lemma_table(words(spark, ws), words(spark, lexicon))) == brute(ws, set(lexicon))


def test_known_words(spark):
    ws = ["boxes", "box", "women", "woman", "cities", "city", "churches", "church", "glasses", "glass", "bus", "wolves", "as"]
    assert table(LM.lemma_table(words(spark, ws))) == {
        "boxes": "box", "women": "woman", "cities": "city", "churches": "church", "glasses": "glass", "wolves": "wolf"}


def test_empty_tables(spark):
    none = words(spark, [])
    assert table(LM.lemma_table(none)) == {}
    assert table(LM.lemma_table(words(spark, ["cats", "mice"]), none)) == {"mice": "mouse"}


def test_clean_lemma_text(spark):
    docs = spark.createDataFrame([(1, "The cats saw a cat. And the. Dogs!"), (2, None), (3, ""), (4, "dog boxes. box"),
                                  (5, "cats " * 3000)], "doc_id long, text string")
    lem = LM.lemma_table(tok.clean_tokens(docs, stop_words=ENGLISH_STOP_WORDS))
    got = {r["doc_id"]: r["text"] for r in LM.clean_lemma_text(docs, lem).collect()}
    assert got == {1: "cat saw cat .  . dog . ", 2: None, 3: "", 4: "dog box . box . ", 5: "cat " * 2999 + "cat . "}
