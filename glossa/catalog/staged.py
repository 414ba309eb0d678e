"""Staged training: the history of a run, with the restored epoch, and its predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.encode import _LANG_SRC
from glossa.catalog.sqlparts import coded_cte, stratified_cte
from glossa.catalog.vocab import VOCAB_CTE
from glossa.operators import labels as OL
from glossa.operators import splits as SP
from glossa.operators import staged as SG
from glossa.operators import tokens as tok
from glossa.operators import vocab as V
from glossa.session import landed, materialize, scratch_path

FEATURES, EPOCHS, PATIENCE, RATE = 2000, 6, 2, 4.0


def staged_run(spark, d):
    """A finished run over the language-labelled corpus: (data, n_classes, path, best epoch)."""
    keys = C.corpus(spark, d, "lang").select("doc_id", "label")
    classes = OL.class_table(keys)
    split = SP.stratified_split(OL.attach_codes(keys, classes, with_one_hot=False), seed=C.SEED)
    toks = tok.words_of(landed(tok.cut_documents(C.docs(spark, d)), "cut"))  # read twice
    vocab = materialize(V.vocab_topk(toks, FEATURES + 1))
    data = materialize(SG.document_features(split, toks, vocab, ["code", "split"]))
    n_classes, path = classes.count(), scratch_path(spark, "staged")
    best = SG.train_staged(data, vocab.count(), n_classes, path, EPOCHS, PATIENCE, RATE)
    return data, n_classes, path, best


def _epoch_sql(k: int) -> str:
    """``z``: scores by the coefficients ``w{k}``; ``p``: probabilities; ``m``: metrics; ``w{k+1}``: a step on."""
    return f"""s{k} AS MATERIALIZED (SELECT x.doc_id, w.c, sum(w.v) AS v FROM x JOIN w{k} w ON w.idx = x.idx GROUP BY x.doc_id, w.c),
z{k} AS MATERIALIZED (SELECT d.doc_id, d.code, d.split, d.scale, b.c, d.scale * coalesce(s.v, 0) + b.v AS z
  FROM d JOIN w{k} b ON b.idx = 0 LEFT JOIN s{k} s ON s.doc_id = d.doc_id AND s.c = b.c),
e{k} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM z{k}),
p{k} AS MATERIALIZED (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM e{k}),
y{k} AS MATERIALIZED (SELECT doc_id, code, split, arg_min(c, {{'z': -z, 'c': c}}) AS pred, min(p) FILTER (c = code) AS p
  FROM p{k} GROUP BY doc_id, code, split),
m{k} AS (SELECT {k} AS epoch, avg(-ln(p)) FILTER (split = 'train') AS train_loss,
  avg(-ln(p)) FILTER (split = 'validation') AS val_loss,
  avg(CAST(pred = code AS DOUBLE)) FILTER (split = 'validation') AS val_accuracy FROM y{k}),
o{k} AS (SELECT doc_id, c, scale, p - CAST(c = code AS DOUBLE) AS off FROM p{k} WHERE split = 'train'),
g{k} AS (SELECT x.idx, o.c, sum(o.scale * o.off) AS g FROM o{k} o JOIN x ON x.doc_id = o.doc_id GROUP BY x.idx, o.c
  UNION ALL SELECT 0, c, sum(off) FROM o{k} GROUP BY c),
w{k + 1} AS MATERIALIZED (SELECT w.idx, w.c, w.v - ({RATE!r}::DOUBLE / (SELECT n FROM n_train)) * coalesce(g.g, 0) AS v
  FROM w{k} w LEFT JOIN g{k} g ON g.idx = w.idx AND g.c = w.c)"""


_RUN_SQL = f"""WITH {VOCAB_CTE},
{coded_cte(_LANG_SRC)},
{stratified_cte()},
x AS MATERIALIZED (SELECT DISTINCT tk.doc_id, v.idx FROM tk JOIN vocab v ON v.word = tk.word WHERE v.idx <= {FEATURES}),
d AS MATERIALIZED (SELECT s.doc_id, s.code, s.split, 1.0::DOUBLE / sqrt(CAST(greatest(coalesce(n.n, 0), 1) AS DOUBLE)) AS scale
  FROM strat s LEFT JOIN (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id) n ON n.doc_id = s.doc_id
  WHERE s.code IS NOT NULL),
n_train AS (SELECT greatest(count(*), 1) AS n FROM d WHERE split = 'train'),
w0 AS MATERIALIZED (SELECT i.idx, c.code AS c, 0.0::DOUBLE AS v FROM (SELECT 0 AS idx UNION ALL SELECT idx FROM vocab WHERE idx <= {FEATURES}) i,
  (SELECT DISTINCT code FROM cls_coded) c),
{(',' + chr(10)).join(_epoch_sql(k) for k in range(EPOCHS + 1))},
per AS (SELECT * FROM ({' UNION ALL '.join(f'SELECT * FROM m{k}' for k in range(1, EPOCHS + 1))})),
improved AS (SELECT *, coalesce(val_accuracy > max(val_accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up
  FROM per),
since AS (SELECT *, epoch - max(CASE WHEN up THEN epoch END) OVER (ORDER BY epoch) AS waited FROM improved),
ran AS (SELECT * FROM since WHERE epoch <= coalesce((SELECT min(epoch) FROM since WHERE waited >= {PATIENCE}), {EPOCHS})),
best AS (SELECT epoch FROM ran ORDER BY val_accuracy DESC, epoch LIMIT 1)"""


@register("staged_history", sql=f"""{_RUN_SQL}
SELECT t.tag, ran.epoch, round(CASE t.tag WHEN 'train_loss' THEN train_loss WHEN 'val_loss' THEN val_loss ELSE val_accuracy END, 6) AS value,
       ran.epoch = (SELECT epoch FROM best) AS restored
FROM ran, (SELECT unnest(['train_loss', 'val_loss', 'val_accuracy']) AS tag) t""")
def staged_history(spark, d):
    """The metric log of the run and which epoch is restored."""
    _, _, path, best = staged_run(spark, d)
    return SG.history(spark, path).select("tag", "epoch", F.round("value", 6).alias("value"), (F.col("epoch") == best).alias("restored"))


@register("staged_predictions", sql=f"""{_RUN_SQL},
preds AS ({' UNION ALL '.join(f'SELECT {k} AS epoch, doc_id, code, split, pred, p FROM y{k}' for k in range(1, EPOCHS + 1))})
SELECT doc_id, code, pred, round(p, 6) AS p_label FROM preds WHERE epoch = (SELECT epoch FROM best) AND split = 'test'""")
def staged_predictions(spark, d):
    """Test split scored by the restored epoch."""
    data, n_classes, path, best = staged_run(spark, d)
    test = data.where((F.col("split") == SP.TEST) & F.col("code").isNotNull())
    out = SG.scored(test, SG.epoch_weights(spark, path, best), n_classes)
    return out.select("doc_id", "code", "pred", F.round(F.get("probability", F.col("code")), 6).alias("p_label"))
