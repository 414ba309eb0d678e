"""What several steps read is made once: cut texts, pooled vectors, soft targets; first appearances that fit are longs."""

from pyspark.sql import functions as F

from glossa.catalog import models as M
from glossa.operators import models as MD
from glossa.operators import splits as SP
from glossa.operators import tokens as tok
from glossa.operators import vocab as V

from paths import SF001


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pooled_rows_are_written_once(spark):
    feats, _ = M.pooled_data(spark, SF001)
    assert not any(x in plan_of(feats) for x in ("Aggregate", "Join", "split("))
    assert feats.count() == M.C.docs(spark, SF001).count()


def test_student_cuts_texts_once(spark, monkeypatch):
    seen, cut = [], tok.cut_documents
    monkeypatch.setattr(tok, "cut_documents", lambda *a, **k: (seen.append(1), cut(*a, **k))[1])
    fits, fit = [], MD.train_student
    monkeypatch.setattr(MD, "train_student", lambda train, soft, *a, **k: (fits.append((train, soft)), fit(train, soft, *a, **k))[1])
    out = M.train_student(spark, SF001)
    (train, soft), = fits
    assert len(seen) == 1
    assert not any(x in plan_of(df) for df in (train, soft, out) for x in ("Aggregate", "Join", "split("))
    assert soft.count() == train.count() > out.count() > 0


def test_words_are_what_the_teacher_cuts(spark):
    data, _ = M.split_corpus(spark, SF001)
    train = data.where(F.col("split") == SP.TRAIN).select("doc_id", "label", "text")
    words = MD.CleanWords().transform(train).drop("text")
    by_text, by_words = (MD.train_text_classifier(x, max_features=300) for x in (train, words))
    assert by_text.stages[1].vocabulary == by_words.stages[1].vocabulary
    a, b = (dict(x.collect()) for x in (MD.soft_targets(by_text, train), MD.soft_targets(by_words, words)))
    assert a.keys() == b.keys() and all(abs(p - q) < 1e-9 for k in a for p, q in zip(a[k], b[k]))


def test_first_appearances_of_any_size(spark):
    docs = (None, -(1 << 63), -5, 0, 7, (1 << 36) - 1, 1 << 36, (1 << 63) - 1)
    places = [(d, s, w) for d in docs for s in (0, 3, (1 << 14) - 1, 1 << 14) for w in (0, 5, (1 << 13) - 1, 1 << 13, (1 << 31) - 1)]
    rows = [(f"w{(7 * i + j) % 23}", *p) for i, p in enumerate(places) for j in range(2)] + [(f"own{i}", *p) for i, p in enumerate(places)]
    tokens = spark.createDataFrame(rows, "word string, doc_id long, sent_pos int, word_pos int").repartition(5)
    want = {}
    for w, *p in rows:
        want.setdefault(w, []).append((p[0] is not None, p[0] or 0, *p[1:], p[0]))
    got = {r["word"]: (r["n"], r["first_doc"], r["first_sent"], r["first_word"]) for r in V.word_counts(tokens).collect()}
    assert got == {w: (len(ps), min(ps, key=lambda p: p[:4])[4], *min(ps, key=lambda p: p[:4])[2:4]) for w, ps in want.items()}
    # no decimal is made of a place that fits into a long
    assert "small" in plan_of(V.word_counts(tokens))
