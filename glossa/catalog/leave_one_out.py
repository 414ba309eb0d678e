"""Leave-one-out importance of each document's words under max pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.vectors import TASK_TOKENS, TV_SQL, cut_words, shares, vocab_vec
from glossa.operators import leave_one_out as LO
from glossa.operators import tokens as tok
from glossa.operators.joins import bounded_broadcast


@register("leave_one_out", sql=f"""WITH {TV_SQL},
ws AS (SELECT DISTINCT doc_id, idx, vec FROM tv),
td AS MATERIALIZED (SELECT doc_id, idx, unnest(range(len(vec))) AS i, CAST(unnest(vec) AS DOUBLE) AS v FROM ws),
t1 AS (SELECT doc_id, i, max(v) AS t FROM td GROUP BY doc_id, i),
t2 AS (SELECT td.doc_id, td.i, any_value(t) AS t, count(*) FILTER (v = t) AS n, max(v) FILTER (v < t) AS s
       FROM td JOIN t1 ON t1.doc_id = td.doc_id AND t1.i = td.i GROUP BY td.doc_id, td.i)
SELECT td.doc_id, td.idx, round(sum(greatest(t, 0) - greatest(CASE WHEN v = t AND n = 1 THEN coalesce(s, 0) ELSE t END, 0)), 6) AS importance
FROM td JOIN t2 ON t2.doc_id = td.doc_id AND t2.i = td.i GROUP BY td.doc_id, td.idx""")
def leave_one_out(spark, d):
    cut = cut_words(spark, d)
    vcap, vv = vocab_vec(spark, d, C.MAX_FEATURES, tok.words_of(cut))
    known = vcap.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    said = cut.select("doc_id", F.explode(F.array_distinct(F.flatten("sents"))).alias("word"))
    ids = said.join(bounded_broadcast(vcap.select("word", "idx")), "word")
    return LO.importance(ids, vv, shares(spark, known, TASK_TOKENS)).select(
        "doc_id", "idx", F.round("importance", 6).alias("importance"))
