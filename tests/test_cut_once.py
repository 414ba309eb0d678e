"""Texts are cut into words once, rows of documents are not sorted with their words, landed files keep all cores busy."""

import os

import pytest
from pyspark.sql import functions as F

from glossa.catalog import streams as ST
from glossa.operators import encode as E
from glossa.operators import explain as X
from glossa.operators import subword as SW
from glossa.operators import tokens as tok
from glossa.operators import vocab as V
from glossa.session import landed
from glossa.streaming import jobs

DOCS = [(1, "Alpha beta. Gamma! Alpha alpha.\nDelta beta the"), (2, "beta beta. of the. Epsilon"), (3, None), (4, ""),
        (5, "zeta. alpha zeta beta. eta theta iota. kappa. lambda")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("glossa.broadcast.maxBytes", "1")
    yield
    spark.conf.unset("glossa.broadcast.maxBytes")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_landed_words_are_the_words(spark, docs):
    cut = landed(tok.cut_documents(docs), "cut")
    assert rows(tok.words_of(cut)) == rows(tok.clean_tokens(docs))
    assert tok.cut_sentences(cut).count() == tok.sentence_table(docs).count()
    assert "split(" not in plan_of(tok.words_of(cut))


def test_sequences_of_cut_documents(spark, docs):
    cut = landed(tok.cut_documents(docs, stop_words=None), "cut")
    vocab = V.vocab_topk(tok.words_of(cut), 6)
    for max_len in (2, 4, 16):
        got = E.sequence_encode(cut, vocab, max_len)
        assert "split(" not in plan_of(got)
        assert rows(got) == rows(E.sequence_encode(docs, vocab, max_len))
        for r in got.collect():
            assert len(r["ids"]) == len(r["mask"]) == max_len
            assert r["mask"] == [int(x != E.PAD) for x in r["ids"]]


def test_frequent_and_other_words_get_their_weights(spark, docs, no_broadcast, monkeypatch):
    toks = tok.clean_tokens(docs)
    vocab = V.vocab_rank(toks)
    whole = rows(toks.join(vocab.select("word", F.col("idx").cast("long").alias("weight")), "word").select(
        "doc_id", "sent_pos", "word_pos", "word", "weight"))
    for frequent in (0, 3, 1000):
        monkeypatch.setattr(X, "FREQUENT", frequent)
        table = X.weight_table(vocab)
        assert table[1] is not None  # too large to be broadcast whole
        assert rows(X.weighted(toks, table).select("doc_id", "sent_pos", "word_pos", "word", "weight")) == whole


def test_highlights_of_levelled_sentences(spark, docs):
    sents = tok.cut_sentences(tok.cut_documents(docs))
    table = X.weight_table(V.vocab_rank(tok.sentence_tokens(sents)))
    tw = X.weighted(tok.sentence_tokens(sents), table)
    sw = X.sentence_weights(sents, tw)
    early = X.weighted(tok.sentence_tokens(X.with_levels(sents, X.sentence_levels(sw, 2)), ["sent_level", "chosen"]), table)
    assert rows(X.highlight_spans(early, sw, 2)) == rows(X.highlight_spans(tw, sw, 2))
    # only tokens of chosen sentences are sorted
    assert plan_of(X.highlight_spans(early, sw, 2)).count("ntile(3)") == 1


def test_pieces_of_frequent_and_other_words(spark, docs, monkeypatch):
    toks = tok.word_table(docs)
    pieces = SW.piece_vocabulary(V.vocab_rank(toks), 2)
    table = {r["piece"]: r["id"] for r in pieces.collect()}
    want = rows(toks.select("doc_id", "sent_pos", "word_pos", "word"))
    for frequent in (1, 5, 100_000):
        monkeypatch.setattr(SW, "FREQUENT", frequent)
        got = SW.subword_encode(toks, pieces)
        assert rows(got.select("doc_id", "sent_pos", "word_pos", "word")) == want
        assert all(r["piece_ids"] == SW.greedy_pieces(r["word"], table) for r in got.collect())


def test_landed_files_fill_the_cores(spark, tmp_path):
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"),
                                   F.lit("s").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    many.write.parquet(str(tmp_path / "documents.parquet"))
    folder = ST.land(spark, str(tmp_path))
    files = [f for f in os.listdir(folder.removeprefix("file:")) if f.endswith(".parquet")]
    assert len(files) >= 4 * ST.files_at_once(spark) >= 4 * spark.sparkContext.defaultParallelism
    assert rows(spark.read.parquet(folder)) == rows(many)


def test_rows_with_one_key_in_a_batch_stay_apart(spark, tmp_path):
    some = spark.createDataFrame([(1, "alpha beta.", None, None, 0), (2, "beta", None, None, 0), (2, None, None, None, 0)], jobs.DOC_SCHEMA)
    for _ in range(2):
        some.coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    vocab = spark.createDataFrame([("alpha", 1), ("beta", 2)], "word string, idx int")
    out = str(tmp_path / "out")
    jobs.stream_encode(spark, str(tmp_path / "landing"), out, str(tmp_path / "ck"), vocab, 1, 3)
    assert sorted((r["doc_id"], r["x"]) for r in spark.read.parquet(out).collect()) == (
        2 * [(1, [[1, 2, 0]])] + 2 * [(2, [[0, 0, 0]])] + 2 * [(2, [[2, 0, 0]])])
