"""Explain many documents at once: prediction, top sentences, top words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators import explain as X
from glossa.operators import models as MD
from glossa.operators import tokens as tok
from glossa.operators.joins import bounded_broadcast
from glossa.session import materialize


def explain_documents(model, docs: DataFrame, classes: DataFrame, n_sentences: int = 3,
                      n_words: int = 5) -> DataFrame:
    """(doc_id, pred, predicted_label, probability, summary, top_words).

    Word weights are the model's per-token importance; sentence weights are
    their sums; the summary is the ``n_sentences`` heaviest sentences in
    document order; ``top_words`` the ``n_words`` heaviest occurrences in it.
    Every step is a per-document window or a bounded regroup (top n only)."""
    preds = MD.predictions(model, docs)
    sents = tok.sentence_table(docs)
    wi = MD.word_importance(model, tok.clean_tokens(docs), preds).withColumnRenamed("importance", "weight")
    sw = MD.sentence_importance(wi.withColumnRenamed("weight", "importance"), sents) \
        .select("doc_id", "sent_pos", F.col("importance").alias("weight"))
    return explained(preds, wi, sw, sents, classes, n_sentences, n_words)


def explained(preds: DataFrame, wi: DataFrame, sw: DataFrame, sents: DataFrame, classes: DataFrame,
              n_sentences: int = 3, n_words: int = 5) -> DataFrame:
    """The same from any model's ``preds(doc_id, pred, probability)``, word and
    sentence weights."""
    chosen = materialize(X.top_sentences(sw, n_sentences).select("doc_id", "sent_pos"))  # n rows a document, read twice
    summary = X.extractive_summary(sents, chosen)
    words = (X.top_words(X.in_sentences(wi, chosen), n_words).groupBy("doc_id")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_w"))
             .select("doc_id", F.transform("_w", lambda s: s["word"]).alias("top_words")))
    names = classes.select(F.col("code").alias("pred"), F.col("label").alias("predicted_label"))
    return (preds.join(bounded_broadcast(names), "pred", "left").join(summary, "doc_id", "left")
            .join(words, "doc_id", "left")
            .select("doc_id", "pred", "predicted_label", "probability", "summary", "top_words"))
