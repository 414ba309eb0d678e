"""Model sanity: the text classifier beats the majority class; a student with
lambda 0 is the plain fit."""

from pyspark.sql import functions as F

from glossa.catalog.models import fitted_text_model, pooled_data
from glossa.operators import metrics as MT
from glossa.operators import models as MD
from glossa.operators import splits as SP

from paths import SF01


def test_text_classifier_beats_majority(spark):
    model, data, _ = fitted_text_model(spark, SF01)
    test = data.where(F.col("split") == SP.TEST)
    acc = MT.accuracy(MD.predictions(model, test)).first()["accuracy"]
    majority = test.groupBy("label").count().agg(F.max("count")).first()[0] / test.count()
    assert acc > majority + 0.1, (acc, majority)
    soft = MD.soft_targets(model, data.where(F.col("split") == SP.TRAIN)).collect()
    assert all(abs(sum(r["soft_targets"]) - 1.0) < 1e-9 for r in soft)


def test_student_lambda_zero_is_plain_fit(spark):
    feats, _ = pooled_data(spark, SF01)
    train = feats.where(F.col("split") == SP.TRAIN)
    n = 4
    fake_soft = train.select("doc_id", F.array(*[F.lit(0.25)] * n).alias("soft_targets"))
    student = MD.train_student(train, fake_soft, n, lam=0.0, max_iter=50)
    plain = MD.pooled_classifier(max_iter=50).fit(train)
    a = MD.predictions(student, train).select("doc_id", F.col("pred").alias("a"))
    b = MD.predictions(plain, train).select("doc_id", F.col("pred").alias("b"))
    agree = a.join(b, "doc_id").where("a = b").count() / a.count()
    assert agree > 0.97
