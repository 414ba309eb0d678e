"""Split, shuffle and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.sqlparts import coded_cte, hash_sql, random_split_cte, stratified_cte
from glossa.operators import labels as OL
from glossa.operators import splits as SP
from glossa.sources import tables

_LABELS_SRC = "SELECT doc_id, quality AS label FROM labels"
STRAT_SQL = f"WITH {coded_cte(_LABELS_SRC)},\n{stratified_cte()}"


def coded_labels(spark, d, column: str = "quality"):
    lab = tables.read_table(spark, d, "labels", ["doc_id", column]).withColumnRenamed(column, "label")
    return OL.attach_codes(lab, OL.class_table(lab), with_one_hot=False).drop("n_classes")


def stratified(spark, d):
    return SP.stratified_split(coded_labels(spark, d), 0.8, 0.1, 0.1, seed=C.SEED)


@register("stratified_split", sql=f"{STRAT_SQL}\nSELECT doc_id, label, code, split FROM strat")
def stratified_split(spark, d):
    return stratified(spark, d).select("doc_id", "label", "code", "split")


@register("random_split", sql=f"""
WITH docs AS (SELECT doc_id FROM documents), {random_split_cte('docs')}
SELECT doc_id, split FROM rsplit""")
def random_split(spark, d):
    return SP.random_split(C.docs(spark, d).select("doc_id"), 0.8, seed=C.SEED)


@register("split_summary", sql=f"""{STRAT_SQL}
SELECT coalesce(split, 'full') AS split, count(*) AS n FROM strat GROUP BY ROLLUP (split)""")
def split_summary(spark, d):
    return SP.split_summary(stratified(spark, d))


@register("split_remainder", sql=f"""WITH {coded_cte(_LABELS_SRC)},
{stratified_cte()}
SELECT c.doc_id, c.label, c.code FROM coded c
WHERE NOT EXISTS (SELECT 1 FROM strat s WHERE s.split = 'train' AND s.doc_id = c.doc_id)""")
def split_remainder(spark, d):
    coded = coded_labels(spark, d)
    train = SP.stratified_split(coded, 0.8, 0.1, 0.1, seed=C.SEED).where(F.col("split") == SP.TRAIN)
    return SP.remainder(coded, train).select("doc_id", "label", "code")


@register("union_splits", sql=f"{STRAT_SQL}\nSELECT doc_id, label, split AS source_split FROM strat")
def union_splits(spark, d):
    s = stratified(spark, d).select("doc_id", "label", "split")
    parts = {name: s.where(F.col("split") == name).drop("split")
             for name in (SP.TRAIN, SP.TEST, SP.VALIDATION)}
    return SP.union_parts(parts)


@register("shuffle_rows", sql=f"""
SELECT doc_id, row_number() OVER (ORDER BY {hash_sql()}, doc_id) AS shuffle_pos FROM documents""")
def shuffle_rows(spark, d):
    return SP.shuffle_positions(C.docs(spark, d).select("doc_id"), seed=C.SEED)


@register("random_review", sql=f"""
SELECT doc_id, lang AS label, text FROM documents ORDER BY {hash_sql()}, doc_id LIMIT 1""")
def random_review(spark, d):
    return SP.random_row(C.corpus(spark, d, "lang"), seed=C.SEED)
