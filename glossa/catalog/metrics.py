"""Metric, loss and vector-function queries over the keyword-scored corpus,
plus the metric-log queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.sqlparts import coded_cte, stratified_cte
from glossa.functions import vectors as VX
from glossa.operators import labels as OL
from glossa.operators import metrics as MT
from glossa.operators import scoring as SC
from glossa.operators import splits as SP
from glossa.operators import metriclog as stores
from glossa.sources import tables

LAMBDA = 0.5
TEMPERATURE_Q = 2.0  # student = softmax(logits / 2)


def scored(spark, d):
    corpus = C.corpus(spark, d, "lang")
    coded = OL.attach_codes(corpus, OL.class_table(corpus.select("label")), with_one_hot=False)
    return SC.score(coded.select("doc_id", F.col("code").alias("label"), "text"))


def _logits_sql(text: str = "d.text") -> str:
    parts = [f"CAST(100.0 AS DOUBLE) * len(regexp_extract_all({text}, '{p}')) / greatest(length({text}), 1)"
             for p in SC.LANG_PATTERNS]
    return "[" + ", ".join(parts) + "]"


def _softmax_sql(x: str) -> str:
    return (f"list_transform(list_transform({x}, lambda v: exp(v - list_max({x}))), "
            f"lambda v: v / list_sum(list_transform({x}, lambda u: exp(u - list_max({x})))))")


def _ce_sql(p: str, code: str) -> str:
    return f"-ln(least(greatest({p}[{code} + 1], 1e-15), 1 - 1e-15))"


def _kl_sql(t: str, q: str) -> str:
    return (f"list_sum(list_transform(list_zip({t}, {q}), "
            f"lambda z: CASE WHEN z[1] = 0 THEN 0.0 ELSE z[1] * (ln(z[1]) - ln(z[2])) END))")


def _kl_literal_sql(t: str, q: str) -> str:
    return (f"list_sum(list_transform(list_zip({t}, {q}), "
            f"lambda z: CASE WHEN z[1] = 0 THEN 0.0 ELSE z[1] * (ln(z[1]) - z[2]) END)) / len({t})")


SCORED_CTE = f"""{coded_cte("SELECT doc_id, lang AS label FROM documents")},
sc AS (SELECT c.doc_id, c.code AS label, {_logits_sql()} AS logits FROM coded c JOIN documents d ON c.doc_id = d.doc_id),
scored AS (SELECT doc_id, label, logits, {_softmax_sql('logits')} AS probability,
                  CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM sc)"""


def report_sql(src: str) -> str:
    """SQL classification report over ``src(label, pred)``."""
    return f"""cm AS (SELECT label, pred, count(*) AS n FROM {src} WHERE label IS NOT NULL GROUP BY label, pred),
bl AS (SELECT label AS cls, sum(n) AS support FROM cm GROUP BY label),
bp AS (SELECT pred AS cls, sum(n) AS predicted FROM cm GROUP BY pred),
tp AS (SELECT label AS cls, n AS tp FROM cm WHERE label = pred),
per0 AS (SELECT coalesce(bl.cls, bp.cls) AS cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
         FROM bl FULL JOIN bp ON bl.cls = bp.cls),
per1 AS (SELECT p.cls, p.support, coalesce(tp.tp, 0) AS tp,
                coalesce(CAST(coalesce(tp.tp, 0) AS DOUBLE) / nullif(p.predicted, 0), 0.0) AS precision,
                coalesce(CAST(coalesce(tp.tp, 0) AS DOUBLE) / nullif(p.support, 0), 0.0) AS recall
         FROM per0 p LEFT JOIN tp ON p.cls = tp.cls),
per AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
        FROM per1),
tot AS (SELECT sum(support) AS total, sum(tp) AS correct, count(*) AS k, sum(precision) AS sp, sum(recall) AS sr,
               sum(f1) AS sf, sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf
        FROM per),
rep AS (
  SELECT CAST(cls AS VARCHAR) AS "row", precision, recall, f1, CAST(support AS BIGINT) AS support FROM per
  UNION ALL SELECT 'accuracy', NULL, NULL, coalesce(CAST(correct AS DOUBLE) / nullif(total, 0), 0.0),
                   CAST(total AS BIGINT) FROM tot
  UNION ALL SELECT 'macro avg', sp / k, sr / k, sf / k, CAST(total AS BIGINT) FROM tot
  UNION ALL SELECT 'weighted avg', coalesce(wp / nullif(total, 0), 0.0), coalesce(wr / nullif(total, 0), 0.0),
                   coalesce(wf / nullif(total, 0), 0.0), CAST(total AS BIGINT) FROM tot)
SELECT "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep"""


@register("softmax", sql=f"""WITH {SCORED_CTE}
SELECT doc_id, list_transform(probability, lambda v: round(v, 6)) AS probability FROM scored""")
def softmax(spark, d):
    return scored(spark, d).select("doc_id", VX.round_array("probability").alias("probability"))


@register("argmax", sql=f"""WITH {SCORED_CTE}
SELECT doc_id, pred, pred + 1 AS display_label FROM scored""")
def argmax(spark, d):
    return scored(spark, d).select("doc_id", "pred", (F.col("pred") + 1).alias("display_label"))


@register("accuracy", sql=f"""WITH {SCORED_CTE}
SELECT count(*) AS n, CAST(sum(CAST(label = pred AS BIGINT)) AS BIGINT) AS correct,
       round(sum(CAST(label = pred AS BIGINT)) / count(*), 6) AS accuracy FROM scored WHERE label IS NOT NULL""")
def accuracy(spark, d):
    return MT.accuracy(scored(spark, d))


@register("confusion_matrix", sql=f"""WITH {SCORED_CTE}
SELECT label, pred, count(*) AS n FROM scored WHERE label IS NOT NULL GROUP BY label, pred""")
def confusion_matrix(spark, d):
    return MT.confusion(scored(spark, d))


@register("classification_report", sql=f"WITH {SCORED_CTE},\n{report_sql('scored')}")
def classification_report(spark, d):
    return MT.classification_report(scored(spark, d))


@register("log_loss", sql=f"""WITH {SCORED_CTE}
SELECT count(*) AS n, round(avg({_ce_sql('probability', 'label')}), 6) AS log_loss FROM scored
WHERE label IS NOT NULL""")
def log_loss(spark, d):
    return MT.mean_log_loss(scored(spark, d))


@register("log_loss_batched", sql=f"""WITH {SCORED_CTE},
b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS bn, {_ce_sql('probability', 'label')} AS l
      FROM scored WHERE label IS NOT NULL),
pb AS (SELECT bn, avg(l) AS bl FROM b GROUP BY bn)
SELECT count(*) AS n_batches, round(avg(bl), 6) AS log_loss FROM pb""")
def log_loss_batched(spark, d):
    return MT.batched_log_loss(scored(spark, d), 64)


_Q_SQL = _softmax_sql(f"list_transform(logits, lambda v: v * {1.0 / TEMPERATURE_Q!r})")


@register("kl_divergence", sql=f"""WITH {SCORED_CTE},
tq AS (SELECT probability AS t, {_Q_SQL} AS q FROM scored)
SELECT count(*) AS n, round(avg({_kl_sql('t', 'q')}), 6) AS kl,
       round(avg({_kl_literal_sql('t', 'q')}), 6) AS kl_literal FROM tq""")
def kl_divergence(spark, d):
    s = scored(spark, d).select(F.col("probability").alias("t"),
                                VX.softmax(VX.scale("logits", 1.0 / TEMPERATURE_Q)).alias("q"))
    return s.agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg(VX.kl_divergence("t", "q")), 6).alias("kl"),
                 F.round(F.avg(VX.kl_divergence_literal("t", "q")), 6).alias("kl_literal"))


@register("kd_loss", sql=f"""WITH {SCORED_CTE},
tq AS (SELECT label, probability AS t, {_Q_SQL} AS q FROM scored WHERE label IS NOT NULL)
SELECT count(*) AS n, round(avg({_ce_sql('q', 'label')} + {LAMBDA} * {_kl_sql('t', 'q')}), 6) AS kd_loss FROM tq""")
def kd_loss(spark, d):
    s = scored(spark, d).where(F.col("label").isNotNull()).select(
        "label", F.col("probability").alias("t"), VX.softmax(VX.scale("logits", 1.0 / TEMPERATURE_Q)).alias("q"))
    row_loss = VX.cross_entropy("q", "label") + F.lit(LAMBDA) * VX.kl_divergence("t", "q")
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(row_loss), 6).alias("kd_loss"))


@register("teacher_agreement", sql=f"""WITH {SCORED_CTE},
{stratified_cte('coded')},
ta AS (SELECT s.label, CAST(list_position(s.probability, list_max(s.probability)) - 1 AS INTEGER) AS pred
       FROM scored s JOIN strat t ON s.doc_id = t.doc_id WHERE t.split = 'train'),
{report_sql('ta')}""")
def teacher_agreement(spark, d):
    sc = scored(spark, d)
    keys = C.corpus(spark, d, "lang").select("doc_id", "label")
    split = SP.stratified_split(OL.attach_codes(keys, OL.class_table(keys), with_one_hot=False), seed=C.SEED)
    train = split.where(F.col("split") == SP.TRAIN).select("doc_id")
    soft = sc.join(train, "doc_id", "left_semi").select("label", VX.argmax("probability").alias("pred"))
    return MT.classification_report(soft)


@register("relu", sql="""
SELECT vec_id, list_transform(embedding, lambda v: greatest(v, CAST(0 AS FLOAT))) AS embedding FROM embeddings""")
def relu(spark, d):
    emb = tables.read_table(spark, d, "embeddings", ["vec_id", "embedding"])
    return emb.select("vec_id", VX.relu("embedding", "float").alias("embedding"))


# --- metric log over events (tag = event type) ---------------------------------

@register("metric_every_n", sql="""
SELECT event_type AS tag, event_id AS step, value FROM events WHERE event_id % 100 = 0 AND event_id > 0""")
def metric_every_n(spark, d):
    m = stores.events_as_metrics(tables.read_table(spark, d, "events"))
    return stores.every_n(m, 100)


_EPOCH_SQL = """ep AS (SELECT event_type AS tag, date_trunc('hour', ts) AS hr, round(avg(value), 6) AS value
       FROM events GROUP BY event_type, date_trunc('hour', ts)),
ms AS (SELECT tag, CAST(dense_rank() OVER (PARTITION BY tag ORDER BY hr) AS BIGINT) AS epoch, value FROM ep)"""


@register("early_stop_epoch", sql=f"""WITH {_EPOCH_SQL},
w AS (SELECT *, max(value) OVER (PARTITION BY tag ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb
      FROM ms),
w2 AS (SELECT *, max(CASE WHEN pb IS NULL OR value > pb THEN epoch END)
                 OVER (PARTITION BY tag ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM w),
w3 AS (SELECT *, min(CASE WHEN epoch - li >= 4 THEN epoch END) OVER (PARTITION BY tag) AS stop FROM w2)
SELECT tag, arg_min(epoch, (-value, epoch)) AS best_epoch, max(value) AS best_value, max(stop) AS stop_epoch
FROM w3 WHERE stop IS NULL OR epoch <= stop GROUP BY tag""")
def early_stop_epoch(spark, d):
    m = stores.hourly_metrics(tables.read_table(spark, d, "events"))
    return MT.early_stop(m, patience=4)


@register("run_id", sql="SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS run_id FROM events")
def run_id(spark, d):
    ev = tables.read_table(spark, d, "events", ["event_id", "ts"])
    return ev.select("event_id", F.date_format("ts", "yyyyMMdd-HHmmss").alias("run_id"))


_SECS = "CAST(round_even(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6, 0) AS BIGINT)"


@register("format_duration", sql=f"""
WITH s AS (SELECT event_id, {_SECS} AS secs FROM events),
p AS (SELECT event_id, secs // 86400 AS days, secs % 86400 AS rem FROM s)
SELECT event_id,
       CASE WHEN days = 0 THEN '' WHEN days = 1 THEN '1 day, ' ELSE CAST(days AS VARCHAR) || ' days, ' END
       || CAST(rem // 3600 AS VARCHAR) || ':' || lpad(CAST((rem % 3600) // 60 AS VARCHAR), 2, '0')
       || ':' || lpad(CAST(rem % 60 AS VARCHAR), 2, '0') AS elapsed
FROM p""")
def format_duration(spark, d):
    from glossa.functions.timefmt import elapsed_seconds, format_duration as fmt

    ev = tables.read_table(spark, d, "events", ["event_id", "ts"])
    return ev.select("event_id", fmt(elapsed_seconds("ts", "2024-01-01 00:00:00")).alias("elapsed"))


def _ce_logits_sql(x: str, code: str) -> str:
    return (f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))) "
            f"- {x}[{code} + 1])")


@register("log_loss_double_softmax", sql=f"""WITH {SCORED_CTE}
SELECT count(*) AS n, round(avg({_ce_logits_sql('probability', 'label')}), 6) AS log_loss FROM scored
WHERE label IS NOT NULL""")
def log_loss_double_softmax(spark, d):
    s = scored(spark, d).where(F.col("label").isNotNull())
    loss = VX.cross_entropy("probability", "label", mode="double_softmax")
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("log_loss"))
