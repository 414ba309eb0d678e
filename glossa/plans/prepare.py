"""Composite preparation plans: labelled corpus -> model-ready tables.

Each returns one lazy DataFrame; write it with
:func:`glossa.sources.stores.write_prepared` (partitioned by split) where a
later job trains on it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.labels import one_hot
from glossa.functions.stopwords import ENGLISH_STOP_WORDS
from glossa.operators import encode as E
from glossa.operators import labels as OL
from glossa.operators import lemmas as LM
from glossa.operators import splits as SP
from glossa.operators import tokens as tok
from glossa.operators import vocab as V
from glossa.session import landed


def prepare_hierarchical(corpus: DataFrame, max_sentences: int = 40, max_words: int = 50,
                         max_features: int = 200000, seed: int = 42,
                         fractions: tuple[float, float, float] = (0.8, 0.1, 0.1),
                         stop_words: Iterable[str] | None = ENGLISH_STOP_WORDS,
                         lemma_table: DataFrame | None = None, vocab: DataFrame | None = None,
                         lemmas: bool = False) -> DataFrame:
    """(doc_id, split, code, y, x) from a ``(doc_id, label, text)`` corpus.

    clean -> class codes -> vocabulary over the whole corpus (or a stored one)
    -> stratified split on the code -> ``x`` id matrices, ``y`` one-hot.
    Only ``(doc_id, label)`` goes through the split's rank (and its
    checkpoint); the text is read once for tokens, which feed both the
    vocabulary and the matrices. ``lemmas`` derives the lemma table from the
    corpus's own words (:mod:`glossa.operators.lemmas`); ``lemma_table`` brings one.
    """
    keys = corpus.select("doc_id", "label")
    classes = OL.class_table(keys)
    coded = OL.attach_codes(keys, classes, with_one_hot=False)
    split = SP.stratified_split(coded, *fractions, seed=seed)
    markers = split.select("doc_id", "split", "code", F.when(F.col("code").isNotNull(),
                                                            one_hot("code", "n_classes")).alias("y"))
    toks = tok.words_of(landed(tok.cut_documents(corpus, stop_words=stop_words), "cut"))  # read up to three times
    if lemmas and lemma_table is None:
        lemma_table = LM.lemma_table(toks)
    toks = tok.lemmatize(toks, lemma_table)
    vcap = V.capped(vocab, max_features) if vocab is not None else V.vocab_topk(toks, max_features)
    return E.doc_matrix(markers, toks, vcap, max_sentences, max_words, carry=["split", "code", "y"]) \
        .select("doc_id", "split", "code", "y", "x")


def prepare_sequence(corpus: DataFrame, max_len: int = 128, max_features: int = 30000,
                     seed: int = 42, vocab: DataFrame | None = None) -> DataFrame:
    """(doc_id, split, ids, mask, token_type_ids, targets): disjoint seeded
    80/10/10 split, fixed-length encoding over the raw words (stop words kept),
    one-hot targets of width = number of classes in the whole corpus."""
    keys = corpus.select("doc_id", "label")
    coded = OL.attach_codes(keys, OL.class_table(keys), with_one_hot=False)
    split = SP.random_split(coded, 0.8, seed=seed)
    markers = split.select("doc_id", "split", F.when(F.col("code").isNotNull(),
                                                     one_hot("code", "n_classes")).alias("targets"))
    docs = corpus.select("doc_id", "text")
    if vocab is None:
        docs = landed(tok.cut_documents(corpus, stop_words=None), "cut")  # read twice
        vocab = V.vocab_topk(tok.words_of(docs), max_features)
    else:
        vocab = V.capped(vocab, max_features)
    enc = E.sequence_encode(docs, vocab, max_len,
                            carry=["split", "targets"], markers=markers)
    return enc.select("doc_id", "split", "ids", "mask", "token_type_ids", "targets")
