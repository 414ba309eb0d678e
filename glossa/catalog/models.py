"""Model queries. The trainers (``train_*``) are Spark ML's, checked by rows and
tests, as their parameters are iterative; targets, evaluation, prediction, the
model store, importance and explanation use a naive Bayes model with
whole-number parameters, whose results have SQL twins.

All train on the stratified train split of the language-labelled corpus and
report on the test split.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog import common as C
from glossa import sqltext as S
from glossa.catalog import register
from glossa.catalog.metrics import report_sql
from glossa.catalog.sqlparts import coded_cte, stratified_cte
from glossa.catalog.vectors import cut_words, max_pooled
from glossa.operators import bayes as NB
from glossa.operators import labels as OL
from glossa.operators import metrics as MT
from glossa.operators import models as MD
from glossa.operators import splits as SP
from glossa.operators import tokens as tok
from glossa.operators.joins import bounded_broadcast
from glossa.session import landed, materialize, scratch_path
from glossa.sources import stores as ST

LAMBDA = 0.5


def split_corpus(spark, d):
    """(doc_id, label=code double, text, split) plus the class table."""
    corpus = C.corpus(spark, d, "lang")
    keys = corpus.select("doc_id", "label")
    classes = OL.class_table(keys)
    split = SP.stratified_split(OL.attach_codes(keys, classes, with_one_hot=False), seed=C.SEED)
    joined = corpus.select("doc_id", "text").join(
        split.select("doc_id", F.col("code").cast("double").alias("label"), "split"), "doc_id")
    return joined, classes


def fitted_text_model(spark, d):
    data, classes = split_corpus(spark, d)
    model = MD.train_text_classifier(data.where(F.col("split") == SP.TRAIN), max_features=C.MAX_FEATURES)
    return model, data, classes


@register("train_text_classifier")
def train_text_classifier(spark, d):
    model, data, _ = fitted_text_model(spark, d)
    return MD.predictions(model, data.where(F.col("split") == SP.TEST))


def pooled_data(spark, d, cut=None, split=None):
    """(doc_id, pooled, label, split, features) and the class table. Pooled vectors are written once: a fit reads its rows
    several times, predictions again. ``cut`` words and ``split_corpus`` may be given."""
    data, classes = split or split_corpus(spark, d)
    pooled = max_pooled(spark, d, cut).join(data.select("doc_id", "label", "split"), "doc_id")
    return MD.pooled_features(landed(pooled, "pooled")), classes


@register("train_pooled_classifier")
def train_pooled_classifier(spark, d):
    feats, _ = pooled_data(spark, d)
    model = MD.pooled_classifier().fit(feats.where(F.col("split") == SP.TRAIN))
    return MD.predictions(model, feats.where(F.col("split") == SP.TEST))


def words_of(spark, d, rows, *carry):
    """Clean tokens of the documents that ``rows(doc_id, *carry)`` names, once a row, with the ``carry`` columns: texts
    meet their rows before they are cut into words, so no others are cut and no words are joined."""
    named = bounded_broadcast(rows.select("doc_id", *carry))
    return tok.clean_tokens(C.docs(spark, d).join(named, "doc_id"), carry=carry)


def scored(spark, d, model, rows):
    """``rows`` with predictions, by the words of their documents only."""
    return NB.predictions(model, words_of(spark, d, rows.select("doc_id").distinct()), rows)


def fitted_bayes(spark, d):
    """The model fitted on the train split, the corpus with codes and splits (no texts), classes."""
    data, classes = split_corpus(spark, d)
    rows = materialize(data.select("doc_id", F.col("label").cast("int").alias("label"), "split"))
    train = rows.where((F.col("split") == SP.TRAIN) & F.col("label").isNotNull()).select("doc_id", F.col("label").alias("code"))
    return NB.fit(words_of(spark, d, train, "code"), train, classes.count()), rows, classes


def bayes_predictions(spark, d, split=None):
    model, rows, _ = fitted_bayes(spark, d)
    return scored(spark, d, model, rows if split is None else rows.where(F.col("split") == split))


BAYES_SQL = f"""{coded_cte("SELECT doc_id, lang AS label FROM documents")}, {stratified_cte()},
tk AS MATERIALIZED ({S.token_rows_sql()}),
wn AS (SELECT tk.word, s.code, count(*) AS n FROM tk JOIN strat s ON s.doc_id = tk.doc_id
       WHERE s.split = 'train' AND s.code IS NOT NULL GROUP BY ALL),
voc AS (SELECT DISTINCT word FROM wn),
cls AS (SELECT c.code, c.label AS name, count(s.doc_id) AS docs FROM cls_coded c
        LEFT JOIN strat s ON s.code = c.code AND s.split = 'train' GROUP BY ALL),
totals AS (SELECT c.code, coalesce(sum(n), 0) + (SELECT count(*) FROM voc) AS t FROM cls c LEFT JOIN wn ON wn.code = c.code GROUP BY ALL),
nb AS MATERIALIZED (
  SELECT v.word, t.code, CAST(round(ln((coalesce(wn.n, 0) + 1.0::DOUBLE) / t.t::DOUBLE) * 1000000) AS BIGINT) AS w
  FROM voc v CROSS JOIN totals t LEFT JOIN wn ON wn.word = v.word AND wn.code = t.code),
prior AS (SELECT code, CAST(round(ln((docs + 1.0::DOUBLE) / (sum(docs) OVER () + count(*) OVER ())::DOUBLE) * 1000000) AS BIGINT) AS w FROM cls),
sums AS (SELECT doc_id, code, sum(w) AS s FROM tk JOIN nb ON nb.word = tk.word GROUP BY ALL),
score AS MATERIALIZED (
  SELECT d.doc_id, d.code AS label, d.split, p.code, CAST(p.w + coalesce(s.s, 0) AS BIGINT) AS score
  FROM strat d CROSS JOIN prior p LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.code = p.code),
probs AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) = 1 AS best,
    exp((score - max(score) OVER (PARTITION BY doc_id)) / 1000000.0::DOUBLE) AS e FROM score),
bayes AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS probability FROM probs)"""

_EVIDENCE_SQL = f"""{BAYES_SQL},
best AS MATERIALIZED (SELECT doc_id, code AS pred, split FROM bayes WHERE best),
ev AS MATERIALIZED (
  SELECT tk.doc_id, tk.sent_pos, tk.word_pos, tk.word,
    CAST(max(nb.w) FILTER (nb.code = b.pred) - coalesce(max(nb.w) FILTER (nb.code <> b.pred), 0) AS BIGINT) AS importance
  FROM tk JOIN best b ON b.doc_id = tk.doc_id AND b.split = 'test' JOIN nb ON nb.word = tk.word
  GROUP BY ALL),
st AS MATERIALIZED (SELECT s.* FROM ({S.sentence_rows_sql()}) s JOIN best b ON b.doc_id = s.doc_id WHERE b.split = 'test'),
se AS MATERIALIZED (
  SELECT st.doc_id, st.sent_pos, CAST(coalesce(sum(importance), 0) AS BIGINT) AS importance
  FROM st LEFT JOIN ev ON ev.doc_id = st.doc_id AND ev.sent_pos = st.sent_pos GROUP BY ALL)"""


@register("soft_targets", sql=f"""WITH {BAYES_SQL}
SELECT doc_id, code, probability FROM bayes WHERE split = 'train'""")
def soft_targets(spark, d):
    return NB.soft_targets(bayes_predictions(spark, d, SP.TRAIN))


@register("train_student")
def train_student(spark, d):
    """Teacher and student read the same cut words; what the fits read again is written once."""
    data, classes = split = split_corpus(spark, d)
    cut = cut_words(spark, d)
    feats, _ = pooled_data(spark, d, cut, split)
    codes = bounded_broadcast(data.where(F.col("split") == SP.TRAIN).select("doc_id", "label"))
    train = cut.select("doc_id", F.flatten("sents").alias("words")).join(codes, "doc_id")
    teacher = MD.train_text_classifier(train, max_features=C.MAX_FEATURES)
    soft = landed(MD.soft_targets(teacher, train), "soft-targets")
    n_classes = classes.count()
    student = MD.train_student(feats.where(F.col("split") == SP.TRAIN), soft, n_classes, LAMBDA)
    return MD.predictions(student, feats.where(F.col("split") == SP.TEST))


@register("evaluate_model", sql=f"""WITH {BAYES_SQL},
tested AS (SELECT label, code AS pred FROM bayes WHERE best AND split = 'test'),
{report_sql('tested')}""")
def evaluate_model(spark, d):
    return MT.classification_report(bayes_predictions(spark, d, SP.TEST))


@register("evaluate_loss", sql=f"""WITH {BAYES_SQL}
SELECT count(*) AS n, round(avg(-ln(least(greatest(probability, 1e-15), 1 - 1e-15))), 6) AS log_loss
FROM bayes WHERE code = label AND split = 'test'""")
def evaluate_loss(spark, d):
    """Mean loss of the test split, beside the report."""
    return MT.mean_log_loss(bayes_predictions(spark, d, SP.TEST))


@register("predict_docs", sql=f"""WITH {BAYES_SQL}
SELECT doc_id, b.code AS pred, c.name AS predicted_label, b.code + 1 AS display_label, score, probability
FROM bayes b JOIN cls c ON c.code = b.code WHERE best""")
def predict_docs(spark, d):
    model, rows, classes = fitted_bayes(spark, d)
    preds = NB.predictions(model, tok.clean_tokens(C.docs(spark, d)), rows)
    names = classes.select(F.col("code").alias("pred"), F.col("label").alias("predicted_label"))
    return preds.join(bounded_broadcast(names), "pred", "left").select(
        "doc_id", "pred", "predicted_label", (F.col("pred") + 1).alias("display_label"),
        F.get("scores", F.col("pred")).alias("score"), F.get("probability", F.col("pred")).alias("probability"))


@register("model_store", sql=f"""WITH {BAYES_SQL}
SELECT doc_id, label, code AS pred, score FROM bayes WHERE best AND split = 'test'""")
def model_store(spark, d):
    """Saved, loaded and applied to the test split."""
    model, rows, _ = fitted_bayes(spark, d)
    path = scratch_path(spark, "model")
    model.save(path)
    preds = scored(spark, d, NB.NaiveBayes.load(spark, path), rows.where(F.col("split") == SP.TEST))
    return preds.select("doc_id", "label", "pred", F.get("scores", F.col("pred")).alias("score"))


def _evidence(spark, d):
    model, rows, classes = fitted_bayes(spark, d)
    preds = materialize(scored(spark, d, model, rows.where(F.col("split") == SP.TEST)))
    return NB.word_evidence(model, words_of(spark, d, preds, "pred"), preds), preds, classes


def _tested_sentences(spark, d, preds):
    return tok.sentence_table(C.docs(spark, d).join(bounded_broadcast(preds.select("doc_id")), "doc_id"))


@register("word_importance", sql=f"WITH {_EVIDENCE_SQL}\nSELECT doc_id, sent_pos, word_pos, word, importance FROM ev")
def word_importance(spark, d):
    return _evidence(spark, d)[0]


@register("sentence_importance", sql=f"""WITH {_EVIDENCE_SQL},
sx AS (SELECT *, exp((importance - max(importance) OVER (PARTITION BY doc_id)) / 1000000.0::DOUBLE) AS e FROM se)
SELECT doc_id, sent_pos, importance, e / sum(e) OVER (PARTITION BY doc_id) AS weight FROM sx""")
def sentence_importance(spark, d):
    words, preds, _ = _evidence(spark, d)
    return NB.sentence_evidence(words, _tested_sentences(spark, d, preds))


@register("explain_docs", sql=f"""WITH {_EVIDENCE_SQL},
sr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, sent_pos) AS r FROM se),
su AS (SELECT st.doc_id, string_agg(st.sentence, ' ' ORDER BY st.sent_pos) AS summary
       FROM st JOIN sr ON sr.doc_id = st.doc_id AND sr.sent_pos = st.sent_pos WHERE r <= 3 GROUP BY st.doc_id),
wr AS (SELECT ev.doc_id, word, row_number() OVER (PARTITION BY ev.doc_id ORDER BY ev.importance DESC, ev.sent_pos, word_pos) AS k
       FROM ev JOIN sr ON sr.doc_id = ev.doc_id AND sr.sent_pos = ev.sent_pos WHERE r <= 3),
tw AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS top_words FROM wr WHERE k <= 5 GROUP BY doc_id)
SELECT b.doc_id, b.pred, c.name AS predicted_label, su.summary, tw.top_words
FROM best b JOIN cls c ON c.code = b.pred LEFT JOIN su ON su.doc_id = b.doc_id LEFT JOIN tw ON tw.doc_id = b.doc_id
WHERE b.split = 'test'""")
def explain_docs(spark, d):
    from glossa.plans.explain_docs import explained

    words, preds, classes = _evidence(spark, d)
    sents = _tested_sentences(spark, d, preds)
    sw = NB.sentence_evidence(words, sents).select("doc_id", "sent_pos", F.col("importance").alias("weight"))
    out = explained(preds, materialize(words.withColumnRenamed("importance", "weight")), sw, sents, classes)
    return out.select("doc_id", "pred", "predicted_label", "summary", F.array_join("top_words", " ").alias("top_words"))


def _distillation_sql() -> str:
    from glossa.catalog import oracle_sql

    return f"""WITH {BAYES_SQL},
taught AS (SELECT doc_id, list(score ORDER BY code) AS soft_scores FROM bayes WHERE split = 'train' GROUP BY doc_id)
SELECT p.* EXCLUDE (split), s.split, t.soft_scores
FROM ({oracle_sql()["prepare_sequence"].strip()}) p JOIN strat s ON s.doc_id = p.doc_id LEFT JOIN taught t ON t.doc_id = p.doc_id"""


@register("distillation_set", sql=_distillation_sql())
def distillation_set(spark, d):
    """Soft targets as the teacher's class scores (their softmax is its probabilities), null off the train split."""
    from glossa.plans.prepare import prepare_sequence

    model, rows, _ = fitted_bayes(spark, d)
    taught = scored(spark, d, model, rows.where(F.col("split") == SP.TRAIN)).select(
        "doc_id", F.col("scores").alias("soft_scores"))
    prepared = prepare_sequence(C.corpus(spark, d, "lang"), C.MAX_LEN, C.MAX_FEATURES, seed=C.SEED)
    joined = prepared.drop("split").join(rows.select("doc_id", "split"), "doc_id")
    return MD.attach_soft_targets(joined, taught, "soft_scores")
