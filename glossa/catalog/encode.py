"""Encoding queries: token ids, document matrices, sequences, prepared sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa import sqltext as S
from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.sqlparts import coded_cte, random_split_cte, stratified_cte
from glossa.catalog.vocab import VOCAB_CTE
from glossa.operators import encode as E
from glossa.operators import splits as SP
from glossa.operators import tokens as tok
from glossa.operators import vocab as V
from glossa.session import landed

M, K, F_ = C.MAX_SENTENCES, C.MAX_WORDS, C.MAX_FEATURES


def capped_vocab(spark, d, tokens=None):
    return V.vocab_topk(tokens if tokens is not None else C.clean_tokens(spark, d), F_)


@register("token_ids", sql=f"""
WITH {VOCAB_CTE}
SELECT tk.doc_id, tk.sent_pos,
       CAST(row_number() OVER (PARTITION BY tk.doc_id, tk.sent_pos ORDER BY tk.word_pos) - 1 AS INTEGER) AS word_pos,
       v.idx
FROM tk JOIN vocab v ON tk.word = v.word AND v.idx < {F_}""")
def token_ids(spark, d):
    toks = C.clean_tokens(spark, d)
    return E.token_ids(toks, capped_vocab(spark, d, toks))


def matrix_sql(docs_cte: str, m: int = M, k: int = K, f: int = F_) -> str:
    """CTE chain producing ``mat(doc_id, x)`` for the docs in ``mdocs(doc_id)``."""
    return f"""{VOCAB_CTE},
{docs_cte},
kn AS (SELECT tk.doc_id, tk.sent_pos, tk.word_pos, v.idx FROM tk JOIN vocab v ON tk.word = v.word
       WHERE v.idx < {f} AND tk.sent_pos < {m}),
kr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY word_pos) AS kp FROM kn),
ks AS (SELECT doc_id, sent_pos, list(idx ORDER BY kp) AS ids FROM kr WHERE kp <= {k} GROUP BY doc_id, sent_pos),
grid AS (SELECT doc_id, unnest(range({m})) AS i FROM mdocs),
mrows AS (SELECT g.doc_id, g.i, list_resize(coalesce(ks.ids, []::INTEGER[]), {k}, 0) AS r
          FROM grid g LEFT JOIN ks ON ks.doc_id = g.doc_id AND ks.sent_pos = g.i),
mat AS (SELECT doc_id, list(r ORDER BY i) AS x FROM mrows GROUP BY doc_id)"""


@register("doc_matrix", sql=f"WITH {matrix_sql('mdocs AS (SELECT doc_id FROM documents)')}\nSELECT doc_id, x FROM mat")
def doc_matrix(spark, d):
    docs = C.docs(spark, d)
    toks = tok.clean_tokens(docs)
    return E.doc_matrix(docs.select("doc_id"), toks, capped_vocab(spark, d, toks), M, K)


_LANG_SRC = "SELECT doc_id, lang AS label FROM documents"


@register("prepare_hierarchical", sql=f"""
WITH {coded_cte(_LANG_SRC)},
{stratified_cte()},
{matrix_sql('mdocs AS (SELECT doc_id FROM documents)')}
SELECT s.doc_id, s.split, s.code,
       list_transform(range(s.n_classes), lambda i: CAST(i = s.code AS INTEGER)) AS y, mat.x
FROM strat s JOIN mat ON s.doc_id = mat.doc_id""")
def prepare_hierarchical(spark, d):
    from glossa.plans.prepare import prepare_hierarchical as plan

    return plan(C.corpus(spark, d, "lang"), M, K, F_, seed=C.SEED)


# --- sequence encoding -------------------------------------------------------
RAW_TOKENS_CTE = f"rtk AS ({S.token_rows_sql('documents', None)})"
RAW_VOCAB_CTE = f"""{RAW_TOKENS_CTE},
rwc0 AS (SELECT word, count(*) AS n, min({{'d': doc_id, 's': sent_pos, 'w': word_pos}}) AS f FROM rtk GROUP BY word),
rvocab AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, f.d, f.s, f.w) AS INTEGER) AS idx FROM rwc0)"""


def seq_sql(docs_cte: str, max_len: int = C.MAX_LEN, f: int = F_) -> str:
    """CTE chain producing ``seq(doc_id, ids, mask, token_type_ids)``."""
    return f"""{RAW_VOCAB_CTE},
{docs_cte},
fw AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word
       FROM (SELECT doc_id, flatten({S.doc_words_sql('text')})[1:{max_len - 2}] AS w FROM sdocs)),
fi AS (SELECT fw.doc_id, fw.pos, coalesce(v.idx + {E.RESERVED - 1}, {E.UNK}) AS id
       FROM fw LEFT JOIN rvocab v ON fw.word = v.word AND v.idx < {f}),
fl AS (SELECT doc_id, list(id ORDER BY pos) AS l FROM fi GROUP BY doc_id),
body AS (SELECT s.doc_id, list_concat(list_concat([{E.BEGIN}], coalesce(fl.l, []::INTEGER[])), [{E.END}]) AS b
         FROM sdocs s LEFT JOIN fl ON s.doc_id = fl.doc_id),
seq AS (SELECT doc_id, CAST(list_resize(b, {max_len}, {E.PAD}) AS INTEGER[]) AS ids,
               list_transform(range(1, {max_len} + 1), lambda p: CAST(p <= len(b) AS INTEGER)) AS mask,
               list_transform(range({max_len}), lambda p: 0) AS token_type_ids
        FROM body)"""



@register("seq_encode", sql=f"WITH {seq_sql('sdocs AS (SELECT doc_id, text FROM documents)')}\nSELECT * FROM seq")
def seq_encode(spark, d):
    cut = landed(tok.cut_documents(C.docs(spark, d), stop_words=None), "cut")
    return E.sequence_encode(cut, V.vocab_topk(tok.words_of(cut), F_), C.MAX_LEN)


@register("prepare_sequence", sql=f"""
WITH {coded_cte(_LANG_SRC)},
{random_split_cte('coded')},
{seq_sql('sdocs AS (SELECT doc_id, text FROM documents)')}
SELECT r.doc_id, r.split, seq.ids, seq.mask, seq.token_type_ids,
       list_transform(range(r.n_classes), lambda i: CAST(i = r.code AS INTEGER)) AS targets
FROM rsplit r JOIN seq ON r.doc_id = seq.doc_id""")
def prepare_sequence(spark, d):
    from glossa.plans.prepare import prepare_sequence as plan

    return plan(C.corpus(spark, d, "lang"), C.MAX_LEN, F_, seed=C.SEED)


@register("batch_counts", sql=f"""
WITH docs AS (SELECT doc_id FROM documents), {random_split_cte('docs')}
SELECT split, count(*) AS n, CAST(ceil(count(*) / 64) AS BIGINT) AS batches FROM rsplit GROUP BY split""")
def batch_counts(spark, d):
    s = SP.random_split(C.docs(spark, d).select("doc_id"), 0.8, seed=C.SEED)
    return (s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("batches", F.ceil(F.col("n") / F.lit(64)).cast("long")))
