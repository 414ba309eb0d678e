"""Only the documents that are scored are cut into words; what rows bring along is joined to texts."""

from glossa.catalog import models as M
from glossa.operators import bayes as NB
from glossa.operators import splits as SP

from paths import SF001


def test_words_of_other_splits_are_not_read(spark, monkeypatch):
    seen, predictions = [], NB.predictions
    monkeypatch.setattr(NB, "predictions", lambda model, tokens, docs: (seen.append((tokens, docs)), predictions(model, tokens, docs))[1])
    preds = M.bayes_predictions(spark, SF001, SP.TEST)
    (tokens, docs), = seen
    asked = {r["doc_id"] for r in docs.collect()}
    assert asked and {r["doc_id"] for r in tokens.select("doc_id").distinct().collect()} <= asked
    assert {r["doc_id"] for r in preds.select("doc_id").collect()} == asked


def test_words_meet_each_of_their_rows(spark, monkeypatch):
    """Repeated documents and repeated rows multiply, rows without a key or a text have no words."""
    texts = spark.createDataFrame([(1, "red fox"), (1, "red fox"), (2, "blue"), (None, "lost"), (3, None)], "doc_id long, text string")
    monkeypatch.setattr(M.C, "docs", lambda s, d: texts)
    rows = spark.createDataFrame([(1, 7), (1, 8), (None, 1), (3, 2), (4, 2)], "doc_id long, code int")
    got = sorted((r["doc_id"], r["code"], r["word"]) for r in M.words_of(spark, None, rows, "code").collect())
    assert got == sorted(2 * [(1, c, w) for c in (7, 8) for w in ("red", "fox")])
