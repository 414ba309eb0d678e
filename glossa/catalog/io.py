"""Source, sink and store queries. Each writes derived data with the
library's writers to a fresh folder next to the checkpoint data, then returns
the library reader's view of it (a round trip over the whole table)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa import sqltext as S
from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.sqlparts import random_split_cte
from glossa.catalog.vocab import VOCAB_CTE
from glossa.operators import slices as SL
from glossa.operators import splits as SP
from glossa.operators import vocab as V
from glossa.operators import metriclog as ML
from glossa.session import scratch_path
from glossa.sources import files as FS
from glossa.sources import stores as ST
from glossa.sources import tables

_SPLIT_FILE = {"train": "train", "test": "test", "validation": "dev"}


@register("read_tsv_splits", sql=f"""
WITH docs AS (SELECT doc_id, lang AS label, text FROM documents), {random_split_cte('docs')}
SELECT doc_id, label, text, CASE split WHEN 'validation' THEN 'dev' ELSE split END AS source_split FROM rsplit""")
def read_tsv_splits(spark, d):
    corpus = C.corpus(spark, d, "lang")
    split = SP.random_split(corpus, 0.8, seed=C.SEED)
    root = scratch_path(spark, "tsv")
    paths = {}
    for part, name in _SPLIT_FILE.items():
        paths[name] = f"{root}/{name}"
        FS.write_tsv(split.where(F.col("split") == part).select("doc_id", "label", "text"), paths[name])
    return FS.read_tsv_splits(spark, paths, "doc_id bigint, label string, text string", header=True)


@register("read_csv_reviews", sql="SELECT lang AS label, text FROM documents")
def read_csv_reviews(spark, d):
    path = scratch_path(spark, "csv")
    FS.write_reviews_csv(C.corpus(spark, d, "lang").withColumnRenamed("doc_id", "index"), path, index_col="index")
    return FS.read_csv_reviews(spark, path, "index bigint, label string, text string")


@register("write_reviews_csv", sql="""
SELECT CAST(l.quality AS VARCHAR) AS label, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def write_reviews_csv(spark, d):
    path = scratch_path(spark, "csvq")
    corpus = C.corpus(spark, d, "quality").select(F.col("label").cast("string").alias("label"), "text")
    FS.write_reviews_csv(corpus, path)
    return FS.read_csv_reviews(spark, path, "label string, text string")


def reviews(spark, d):
    """Reviews as JSON-line records: a document with the date and priority
    digit (as a star rating) of the order sharing its key."""
    docs = C.docs(spark, d).select("doc_id", "text")
    orders = tables.read_table(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderdate"])
    return docs.join(orders, docs.doc_id == orders.o_orderkey).select(
        F.substring("o_orderpriority", 1, 1).cast("double").alias("stars"), "text",
        F.col("o_orderdate").cast("timestamp_ntz").alias("date"))


_REVIEWS_SQL = """SELECT CAST(substr(o.o_orderpriority, 1, 1) AS DOUBLE) AS stars, d.text, o.o_orderdate AS date
FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id"""


@register("read_jsonl_reviews", sql=_REVIEWS_SQL)
def read_jsonl_reviews(spark, d):
    path = scratch_path(spark, "jsonl")
    FS.write_jsonl(reviews(spark, d), path)
    return FS.read_jsonl_reviews(spark, path)


@register("read_labeled_docs", sql="""
SELECT d.doc_id, l.quality AS label, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def read_labeled_docs(spark, d):
    path = scratch_path(spark, "bin")
    FS.write_labeled_docs(C.corpus(spark, d, "quality"), path)
    return FS.read_labeled_docs(spark, path)


@register("read_word_vectors", sql=f"""WITH {VOCAB_CTE}
SELECT v.word, e.embedding AS vec FROM vocab v JOIN embeddings e ON v.idx - 1 = e.vec_id""")
def read_word_vectors(spark, d):
    vocab = V.vocab_rank(C.clean_tokens(spark, d))
    emb = tables.read_table(spark, d, "embeddings", ["vec_id", "embedding"])
    path = scratch_path(spark, "vec")
    FS.write_word_vectors(V.word_vectors_from_rank(vocab, emb), path)
    return FS.read_word_vectors(spark, path)


@register("vocab_store", sql=f"WITH {VOCAB_CTE} SELECT word, idx, n FROM vocab")
def vocab_store(spark, d):
    docs = C.docs(spark, d)
    fit_id = ST.fingerprint(docs, kind="vocab_rank")
    root = scratch_path(spark, "store")
    fit = lambda: V.vocab_rank(C.clean_tokens(spark, d))
    ST.vocab_store(spark, root, "documents", fit_id, fit)
    vocab, reused = ST.vocab_store(spark, root, "documents", fit_id, fit)
    assert reused, "second lookup must reuse the stored vocabulary"
    return vocab.select("word", "idx", "n")


def _prepared_sql() -> str:
    from glossa.catalog import oracle_sql

    return oracle_sql()["prepare_hierarchical"].strip()


@register("prepared_store", sql=_prepared_sql())
def prepared_store(spark, d):
    from glossa.catalog.encode import prepare_hierarchical

    path = scratch_path(spark, "prepared")
    ST.write_prepared(prepare_hierarchical(spark, d), path)
    parts = [ST.read_prepared(spark, path, split) for split in (SP.TRAIN, SP.VALIDATION, SP.TEST)]
    return reduce(DataFrame.unionByName, parts).select("doc_id", "split", "code", "y", "x")


@register("metric_log", sql="""
SELECT 'events' AS run_id, event_type AS tag, event_id AS step, value FROM events""")
def metric_log(spark, d):
    path = scratch_path(spark, "metrics")
    ST.append_metrics(ML.events_as_metrics(tables.read_table(spark, d, "events")), path, "events")
    return ST.read_metrics(spark, path, "events")


_ORDERS_COLS = "o_orderkey, o_custkey, o_totalprice, o_orderdate"


@register("year_slice", sql=f"""SELECT {_ORDERS_COLS} FROM orders
WHERE o_orderdate >= TIMESTAMP '{C.YEAR}-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '{C.YEAR}-12-30 00:00:00'""")
def year_slice(spark, d):
    o = tables.read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    return SL.year_slice(o, "o_orderdate", C.YEAR)


@register("year_complement", sql=f"""SELECT {_ORDERS_COLS} FROM orders WHERE o_orderdate IS NOT NULL AND NOT
(o_orderdate >= TIMESTAMP '{C.YEAR}-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '{C.YEAR}-12-30 00:00:00')""")
def year_complement(spark, d):
    o = tables.read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    return SL.year_complement(o, "o_orderdate", C.YEAR)


@register("prepare_year_corpus", sql=f"""WITH r AS ({_REVIEWS_SQL})
SELECT CAST(coalesce(TRY_CAST(trunc(stars) AS INTEGER) - 1, 0) AS INTEGER) AS label, {S.clean_string_sql('text')} AS text
FROM r WHERE date >= TIMESTAMP '{C.YEAR}-01-01 00:00:00' AND date <= TIMESTAMP '{C.YEAR}-12-30 00:00:00'""")
def prepare_year_corpus(spark, d):
    from glossa.plans.year_corpus import prepare_year_corpus as plan

    src = scratch_path(spark, "yjson")
    FS.write_jsonl(reviews(spark, d), src)
    out = scratch_path(spark, "ycsv")
    plan(spark, src, out, C.YEAR)
    return FS.read_csv_reviews(spark, out, "label int, text string")
