"""Spark ML classifiers standing in for the trained networks.

* text classifier: clean words -> term counts (CountVectorizer, vocabulary
  capped, so the model's dictionary has a proven size) -> IDF -> multinomial
  logistic regression;
* pooled classifier: element-wise max of word vectors -> logistic regression;
* distillation: a student fitted on hard labels plus a teacher's soft targets,
  expressed as a weighted fit (one row per class, weight ``1[c=y] +
  lambda * t_c``), whose objective equals cross entropy + lambda * KL(t, q)
  up to a constant.

Fits are Spark ML's distributed (tree-aggregated) optimisers; scoring is
``model.transform`` (a projection, no shuffle).
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import vectors as VX
from glossa.operators.joins import bounded_broadcast


class CleanWords(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: text -> flat ``array<string>`` of clean words (the token
    contract, stop words removed). Saved and loaded with the pipeline, so a
    stored model scores raw text in batch and streaming alike."""

    @keyword_only
    def __init__(self, inputCol: str = "text", outputCol: str = "words"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="words")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), F.flatten(T.clean_words(F.col(self.getInputCol()))))


def text_classifier(max_features: int = 50000, max_iter: int = 25, reg: float = 0.01,
                    min_df: float = 1.0) -> Pipeline:
    return Pipeline(stages=[
        CleanWords(inputCol="text", outputCol="words"),
        CountVectorizer(inputCol="words", outputCol="tf", vocabSize=max_features, minDF=min_df),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=reg,
                           family="multinomial"),
    ])


def dictionary_model(vocab: DataFrame, input_col: str, output_col: str):
    """A ``CountVectorizerModel`` whose dictionary is ``vocab(word, idx)`` in
    id order (term index = idx - 1).

    The dictionary is written by Spark as the model's data file (one row,
    bounded by the vocabulary cap) into a saved model folder and loaded back,
    so it never passes through Python objects on the driver."""
    from pyspark.ml.feature import CountVectorizerModel

    from glossa.session import scratch_path

    path = scratch_path(vocab.sparkSession, "dictionary")
    CountVectorizerModel.from_vocabulary(["_"], inputCol=input_col, outputCol=output_col).save(path)
    data = vocab.agg(F.array_sort(F.collect_list(F.struct("idx", "word"))).alias("_v")) \
        .select(F.transform("_v", lambda e: e["word"]).alias("vocabulary"))
    data.coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return CountVectorizerModel.load(path)


def train_text_classifier(train: DataFrame, **kw) -> PipelineModel:
    """Fit on ``(doc_id, label, text)`` rows (label = class code), or on ``(doc_id, label, words)`` where texts are cut
    already.

    Same stages as :func:`text_classifier`, fitted one by one so the clean
    words are computed once (persisted, spilling to disk) instead of once per
    downstream estimator; the result is an ordinary ``PipelineModel``."""
    from pyspark import StorageLevel

    from glossa.operators import vocab as V

    stages = text_classifier(**kw).getStages()
    clean, cv, idf, lr = stages
    labelled = train.where(F.col("label").isNotNull())
    # The dictionary: the distributed capped vocabulary (count desc, ties by
    # first appearance), not CountVectorizer.fit, whose top-k merge runs on
    # the driver and breaks ties arbitrarily. Collected once: it is the
    # model's parameter, bounded by vocabSize.
    cap = cv.getVocabSize()
    if "words" not in labelled.columns:
        labelled = clean.transform(labelled.select("doc_id", "label", "text"))
    words = labelled.select("doc_id", "label", "words").persist(StorageLevel.MEMORY_AND_DISK)
    # flat word position inside a document orders like (sentence, word)
    toks = words.select("doc_id", F.lit(0).alias("sent_pos"), F.posexplode("words").alias("word_pos", "word"))
    vocab = V.vocab_topk(toks, cap + 1)
    try:
        cv_model = dictionary_model(vocab, cv.getInputCol(), cv.getOutputCol())
        tf = cv_model.transform(words)
        idf_model = idf.fit(tf)
        lr_model = lr.fit(idf_model.transform(tf))
    finally:
        words.unpersist()
    return PipelineModel(stages=[clean, cv_model, idf_model, lr_model])


def pooled_classifier(max_iter: int = 100, reg: float = 0.001) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=reg,
                              family="multinomial")


def pooled_features(pooled: DataFrame, col: str = "pooled") -> DataFrame:
    """``features`` vector from an ``array<float|double>`` pooled column."""
    return pooled.withColumn("features", array_to_vector(F.col(col).cast("array<double>")))


def predictions(model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep..., label, pred, probability array<double>)."""
    keep = keep or ["doc_id"]
    out = model.transform(df)
    return out.select(*keep, "label", F.col("prediction").cast("int").alias("pred"),
                      vector_to_array("probability").alias("probability"))


def soft_targets(teacher, train: DataFrame) -> DataFrame:
    """(doc_id, soft_targets): the teacher's class probabilities per training row; rows with ``words`` are cut already."""
    cut = "words" in train.columns
    out = (PipelineModel(stages=[s for s in teacher.stages if not isinstance(s, CleanWords)]) if cut else teacher).transform(train)
    return out.select("doc_id", vector_to_array("probability").alias("soft_targets"))


def distillation_rows(train: DataFrame, soft: DataFrame, n_classes: int, lam: float) -> DataFrame:
    """Expand each training row to one row per class with weight
    ``1[c = label] + lam * t_c`` (soft targets joined on ``doc_id``)."""
    j = train.join(soft, "doc_id")
    ex = j.select("*", F.posexplode(F.col("soft_targets")).alias("_c", "_t"))
    return (ex.withColumn("weight", (F.col("_c") == F.col("label")).cast("double") + F.lit(lam) * F.col("_t"))
            .withColumn("label", F.col("_c").cast("double"))
            .drop("_c", "_t", "soft_targets")
            .where(F.col("weight") > 0))


def train_student(train: DataFrame, soft: DataFrame, n_classes: int, lam: float = 0.5,
                  max_iter: int = 100, reg: float = 0.001):
    """Weighted multinomial fit on the expanded rows (``features`` column)."""
    rows = distillation_rows(train, soft, n_classes, lam)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter,
                            regParam=reg, family="multinomial")
    return lr.fit(rows)


def coefficient_table(model: PipelineModel):
    """(index, word, idf, coefs array<double>) of a text classifier: one row
    per vocabulary entry (bounded by the vocabulary cap)."""
    cv, idf, lr = model.stages[1], model.stages[2], model.stages[3]
    coef = lr.coefficientMatrix.toArray()
    idf_v = idf.idf.toArray()
    return [(i, w, float(idf_v[i]), [float(x) for x in coef[:, i]]) for i, w in enumerate(cv.vocabulary)]


def word_importance(model: PipelineModel, tokens: DataFrame, preds: DataFrame) -> DataFrame:
    """(doc_id, sent_pos, word_pos, word, importance): coefficient of the
    predicted class x tf-idf of the word in its document, per token.

    The coefficient table is a model parameter bounded by the vocabulary cap;
    it is joined (planner's choice, broadcast when small) on the word."""
    spark = tokens.sparkSession
    table = bounded_broadcast(spark.createDataFrame(coefficient_table(model),
                                                    "index int, word string, idf double, coefs array<double>"))
    from pyspark.sql import Window

    # one token shuffle (by document): the (doc_id, word) window and the join
    # with the document-level predictions both reuse it
    tf = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "word"))
    scored = (tokens.repartition("doc_id").withColumn("tf", tf)
              .join(preds.select("doc_id", "pred"), "doc_id").join(table, "word"))
    imp = VX.prob_at("coefs", "pred") * F.col("tf") * F.col("idf")
    return scored.select("doc_id", "sent_pos", "word_pos", "word", imp.alias("importance"))


def sentence_importance(word_imp: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_pos, importance, weight): summed word importance per
    sentence slot (0 without scored words), and its softmax share in the
    document."""
    from pyspark.sql import Window

    marks = sentences.select("doc_id", "sent_pos", F.lit(0.0).alias("importance"))
    s = (word_imp.select("doc_id", "sent_pos", "importance").unionByName(marks)
         .groupBy("doc_id", "sent_pos").agg(F.sum("importance").alias("importance")))
    w = Window.partitionBy("doc_id")
    shifted = F.col("importance") - F.max("importance").over(w)
    return s.withColumn("weight", F.exp(shifted) / F.sum(F.exp(shifted)).over(w))


def attach_soft_targets(prepared: DataFrame, soft: DataFrame, name: str = "soft_targets") -> DataFrame:
    """Distillation set: every prepared row, with the teacher's soft targets
    (column ``name``) joined by ``doc_id`` on training rows and null (not zeros)
    everywhere else."""
    return prepared.join(soft.select("doc_id", name), "doc_id", "left")
