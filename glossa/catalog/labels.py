"""Label queries: canonical columns, label decoding, class table, codes, one-hot."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.sqlparts import coded_cte
from glossa.functions import labels as L
from glossa.operators import labels as OL
from glossa.sources import tables


@register("canonical_columns", sql="SELECT doc_id, lang AS label, text FROM documents")
def canonical_columns(spark, d):
    return C.corpus(spark, d, "lang")


_ONEHOT_SQL = "lpad('1' || repeat('0', label), 10, '0')"


@register("label_onehot_decode", sql=f"""
SELECT vec_id, {_ONEHOT_SQL} AS onehot,
       CAST(length(CAST(TRY_CAST({_ONEHOT_SQL} AS BIGINT) AS VARCHAR)) - 1 AS INTEGER) AS code
FROM embeddings""")
def label_onehot_decode(spark, d):
    emb = tables.read_table(spark, d, "embeddings", ["vec_id", "label"])
    s = emb.select("vec_id", L.code_to_onehot_string("label", 10).alias("onehot"))
    return s.select("vec_id", "onehot", L.onehot_string_to_code("onehot").alias("code"))


_STAR_RAW = "CAST(value AS VARCHAR)"


@register("label_star_normalize", sql=f"""
SELECT event_id,
       coalesce(CAST(TRY_CAST(trunc(TRY_CAST({_STAR_RAW} AS DOUBLE)) AS INTEGER) - 1 AS INTEGER), 0) AS label,
       TRY_CAST(trunc(TRY_CAST({_STAR_RAW} AS DOUBLE)) AS INTEGER) IS NOT NULL AS label_valid
FROM events""")
def label_star_normalize(spark, d):
    ev = tables.read_table(spark, d, "events", ["event_id", "value"])
    raw = F.col("value").cast("string")
    return ev.select("event_id", L.star_to_code(raw).alias("label"),
                     L.star_code_or_null(raw).isNotNull().alias("label_valid"))


@register("class_table", sql=f"""
WITH {coded_cte("SELECT doc_id, lang AS label FROM documents")}
SELECT code, label, n_classes FROM cls_coded""")
def class_table(spark, d):
    return OL.class_table(C.corpus(spark, d, "lang"))


@register("label_codes", sql=f"""
WITH {coded_cte("SELECT doc_id, lang AS label FROM documents")}
SELECT doc_id, label, code, list_transform(range(n_classes), lambda i: CAST(i = code AS INTEGER)) AS one_hot
FROM coded""")
def label_codes(spark, d):
    corpus = C.corpus(spark, d, "lang").select("doc_id", "label")
    return OL.attach_codes(corpus, OL.class_table(corpus)).select("doc_id", "label", "code", "one_hot")


@register("one_hot", sql=f"""
WITH {coded_cte("SELECT vec_id AS doc_id, label FROM embeddings")}
SELECT doc_id AS vec_id, code, list_transform(range(n_classes), lambda i: CAST(i = code AS INTEGER)) AS one_hot
FROM coded""")
def one_hot(spark, d):
    emb = tables.read_table(spark, d, "embeddings", ["vec_id", "label"])
    coded = OL.attach_codes(emb, OL.class_table(emb), with_one_hot=False)
    return coded.select("vec_id", "code", L.one_hot("code", "n_classes").alias("one_hot"))


@register("class_balance", sql=f"""
WITH {coded_cte("SELECT doc_id, lang AS label FROM documents")}
SELECT code, label, count(*) AS n FROM coded GROUP BY code, label""")
def class_balance(spark, d):
    corpus = C.corpus(spark, d, "lang").select("doc_id", "label")
    return OL.class_balance(OL.attach_codes(corpus, OL.class_table(corpus), with_one_hot=False))
