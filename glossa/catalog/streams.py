"""Streaming and subword queries."""

from __future__ import annotations

from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.encode import capped_vocab, matrix_sql
from glossa.operators import subword as SW
from glossa.operators import tokens as tok
from glossa.operators import vocab as V
from glossa.session import landed, scratch_path
from glossa.sources import tables
from glossa.streaming import jobs

N_SUBWORD_WORDS = 1000


def files_at_once(spark) -> int:
    """Files of a micro-batch: one for each core, as a landed file is mostly one task's."""
    return spark.sparkContext.defaultParallelism


def land(spark, d, n_files: int | None = None) -> str:
    """Land the documents table as Parquet files (a landing folder): four
    micro-batches, or more where the table's scan has more parts than that."""
    path = scratch_path(spark, "landing")
    docs = tables.read_table(spark, d, "documents")
    if n_files is None:
        scanned = spark.read.parquet(tables.path_of(d, "documents")).rdd.getNumPartitions()
        n_files = max(4 * files_at_once(spark), scanned)
    docs.repartition(n_files, "doc_id").write.parquet(path)
    return path


@register("stream_encode", sql=f"WITH {matrix_sql('mdocs AS (SELECT doc_id FROM documents)')}\nSELECT doc_id, x FROM mat")
def stream_encode(spark, d):
    landing = land(spark, d)
    vocab = capped_vocab(spark, d)
    out, ck = scratch_path(spark, "senc"), scratch_path(spark, "senc-ck")
    jobs.stream_encode(spark, landing, out, ck, vocab, C.MAX_SENTENCES, C.MAX_WORDS, max_files=files_at_once(spark))
    return spark.read.parquet(out).select("doc_id", "x")


@register("stream_score")
def stream_score(spark, d):
    from glossa.catalog.models import fitted_text_model

    model, _, _ = fitted_text_model(spark, d)
    landing = land(spark, d)
    out, ck = scratch_path(spark, "sscore"), scratch_path(spark, "sscore-ck")
    jobs.stream_score(spark, landing, out, ck, model, max_files=files_at_once(spark))
    return spark.read.parquet(out)


@register("subword_encode")
def subword_encode(spark, d):
    # all words, stop words included; read three times
    toks = tok.words_of(landed(tok.cut_documents(C.docs(spark, d), stop_words=None), "cut"))
    pieces = SW.piece_vocabulary(V.vocab_rank(toks), N_SUBWORD_WORDS)
    return SW.subword_encode(toks, pieces).select("doc_id", "sent_pos", "word_pos", "word", "piece_ids")
