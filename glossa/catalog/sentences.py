"""Learnt sentence boundaries: the statistics of abbreviations and the split by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa import sqltext as S
from glossa.catalog import common as C
from glossa.catalog import register
from glossa.functions import text as T
from glossa.operators import sentences as SN
from glossa.session import materialize

_SCORES = f"""raw AS (SELECT trim(unnest(string_split_regex(lower(text), {S.q(T.WHITESPACE_RUN)})), {S.q(SN.BRACKETS)}) AS token FROM documents),
types AS MATERIALIZED (SELECT CASE WHEN token LIKE '%.' THEN left(token, length(token) - 1) ELSE token END AS type,
  count(*) AS n, CAST(sum(CAST(token LIKE '%.' AS BIGINT)) AS BIGINT) AS n_period
  FROM raw WHERE regexp_matches(token, {S.q(SN.WORD_TYPE)}) GROUP BY 1),
share AS (SELECT CAST(sum(n_period) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS p FROM types),
parts AS (SELECT t.*, p, n - n_period AS bare, length(replace(type, '.', '')) AS letters FROM types t, share WHERE n_period > 0),
scores AS (SELECT type, n, n_period, -2.0::DOUBLE * (n_period * ln(p) + bare * ln(1 - p)
    - (n_period * ln({SN.OWN_PERIOD!r}::DOUBLE) + bare * ln({1.0 - SN.OWN_PERIOD!r}::DOUBLE)))
  * exp(-letters::DOUBLE) * (length(type) - letters + 1) * pow(letters::DOUBLE, -bare::DOUBLE) AS score FROM parts)"""


@register("abbreviation_scores", sql=f"""WITH {_SCORES}
SELECT type, n, n_period, CASE WHEN abs(score) < 1e-6 THEN 0.0::DOUBLE ELSE round(score, 6) END AS score, score >= {SN.THRESHOLD} AS accepted FROM scores""")
def abbreviation_scores(spark, d):
    types = materialize(SN.word_types(C.docs(spark, d)))
    # no negative zeros
    return SN.abbreviation_scores(types).select(
        "type", "n", "n_period", F.when(F.abs("score") < 1e-6, 0.0).otherwise(F.round("score", 6)).alias("score"), (F.col("score") >= SN.THRESHOLD).alias("accepted"))


@register("sentence_split_learnt", sql=f"""WITH {_SCORES},
known AS MATERIALIZED (SELECT coalesce(list(type), []) AS types FROM scores WHERE score >= {SN.THRESHOLD}),
marked AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, {S.q(SN.LINE_BREAK)}, chr(2), 'g'),
  {S.q(SN.STOP)}, '\\1' || chr(1), 'g'), chr(1)) AS pieces FROM documents),
joined AS (SELECT doc_id, array_to_string(list_transform(pieces, lambda p: p || CASE WHEN list_contains(types,
  regexp_extract(lower(p), {S.q(SN.LAST_TYPE)}, 2)) THEN ' ' ELSE chr(2) END), '') AS text FROM marked, known),
cut AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(2)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(12))),
  lambda s: s <> '') AS ss FROM joined)
SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS sent_pos, unnest(ss) AS sentence FROM cut""")
def sentence_split_learnt(spark, d):
    docs = C.docs(spark, d)
    return SN.sentence_table(docs, SN.abbreviations(materialize(SN.word_types(docs))))
