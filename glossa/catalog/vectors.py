"""Word-vector queries: vocabulary vectors, token vectors, pooling, attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.vocab import vocab_cte
from glossa.functions import vectors as VX
from glossa.operators import encode as E
from glossa.operators import pooling as PL
from glossa.operators import tokens as tok
from glossa.operators import vocab as V
from glossa.operators.joins import bounded_broadcast
from glossa.session import landed, materialize
from glossa.sources import tables

TASK_TOKENS = 4_000_000  # sorted in a task
TASK_SENTENCES = 200_000  # summed up in a task, one vector each


def embeddings(spark, d):
    return tables.read_table(spark, d, "embeddings", ["vec_id", "embedding"])


def dim_of(spark, d) -> int:
    return int(embeddings(spark, d).select(F.size("embedding").alias("n")).first()["n"])


def context_vector(spark, d, vec_id: int) -> list[float]:
    """A parameter vector (one row of the vector table), as driver literals."""
    return [float(x) for x in embeddings(spark, d).where(F.col("vec_id") == vec_id).first()["embedding"]]


def cut_words(spark, d):
    """Every document's clean words (``tokens.cut_documents``): texts are cut once for the vocabulary and what it is used for."""
    return landed(tok.cut_documents(C.docs(spark, d)), "cut")


def vocab_vec(spark, d, max_features: int, toks=None):
    toks = toks if toks is not None else C.clean_tokens(spark, d)
    full = V.vocab_rank(toks) if max_features is None else V.vocab_topk(toks, max_features)
    full = materialize(full)  # reused by the vector table and the id join: fit once
    words = V.word_vectors_from_rank(full, embeddings(spark, d))
    return full, V.vocab_vectors(full, words, dim_of(spark, d))


def _zero_sql(dim: str = "64") -> str:
    return f"list_transform(range({dim}), lambda i: CAST(0 AS FLOAT))"


def _vv_sql(f: int) -> str:
    return f"""{vocab_cte(f)},
vw AS (SELECT v.word, e.embedding AS vec FROM vcap v JOIN embeddings e ON v.idx - 1 = e.vec_id),
dim AS (SELECT max(len(embedding)) AS d FROM embeddings),
vv AS (SELECT v.idx, v.word, coalesce(w.vec, {_zero_sql('(SELECT d FROM dim)')}) AS vec
       FROM vcap v LEFT JOIN vw w ON v.word = w.word
       UNION ALL SELECT 0, NULL, {_zero_sql('(SELECT d FROM dim)')})"""


@register("vocab_vectors", sql=f"WITH {_vv_sql(C.MAX_FEATURES)}\nSELECT idx, word, vec FROM vv")
def vocab_vectors(spark, d):
    return vocab_vec(spark, d, C.MAX_FEATURES)[1]


TV_SQL = f"""{_vv_sql(C.MAX_FEATURES)},
tid AS (SELECT tk.doc_id, tk.sent_pos,
               CAST(row_number() OVER (PARTITION BY tk.doc_id, tk.sent_pos ORDER BY tk.word_pos) - 1 AS INTEGER) AS word_pos,
               v.idx
        FROM tk JOIN vcap v ON tk.word = v.word),
tv AS (SELECT t.doc_id, t.sent_pos, t.word_pos, t.idx, vv.vec FROM tid t JOIN vv ON t.idx = vv.idx)"""


def known_ids(toks, vcap, partitions=None):
    return E.token_ids(toks, bounded_broadcast(vcap.select("word", "idx")), vocab_measured=True, partitions=partitions)


def shares(spark, rows: int, most: int) -> int:
    """Partitions of no more than ``most`` rows, as many for each core: adaptive execution would measure the few bytes
    that are shuffled, not the vectors they become or that are kept for them."""
    cores = spark.sparkContext.defaultParallelism
    return cores * max(1, -(-rows // (most * cores)))


def tok_vecs(spark, d):
    toks = tok.words_of(cut_words(spark, d))
    vcap, vv = vocab_vec(spark, d, C.MAX_FEATURES, toks)
    known = vcap.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return PL.token_vectors(known_ids(toks, vcap, shares(spark, known, TASK_TOKENS)), vv)


def word_vecs(spark, d, u=None, cut=None, partitions=None):
    """(doc_id, sent_pos, idx, vec) of all known words, without their positions: nothing is sorted, no vector
    shuffled. With a context vector ``u`` also ``score``, computed once a word of the vocabulary. With a number of
    ``partitions`` they are dealt by document."""
    cut = cut_words(spark, d) if cut is None else cut
    vv = vocab_vec(spark, d, C.MAX_FEATURES, tok.words_of(cut))[1]
    if u is not None:
        vv = vv.withColumn("score", PL.attention_score(F.col("vec"), u))
    toks = tok.words_of(cut).select("doc_id", "sent_pos", "word") if partitions is None else tok.dealt_words(cut, partitions)
    return toks.join(bounded_broadcast(vv.where(F.col("word").isNotNull())), "word").drop("word")


def tok_scores(spark, d, u):
    """(doc_id, sent_pos, word_pos, score): the attention score is looked up by word, no vectors on token rows."""
    toks = C.clean_tokens(spark, d)
    vcap, vv = vocab_vec(spark, d, C.MAX_FEATURES, toks)
    scored = bounded_broadcast(vv.select("idx", PL.attention_score(F.col("vec"), u).alias("score")))
    return known_ids(toks, vcap).join(scored, "idx").drop("idx")


@register("token_vectors", sql=f"WITH {TV_SQL}\nSELECT doc_id, sent_pos, word_pos, idx, vec FROM tv")
def token_vectors(spark, d):
    return tok_vecs(spark, d)


def max_pooled(spark, d, cut=None):
    """(doc_id, pooled) for every document."""
    dim = dim_of(spark, d)
    return PL.keep_documents(PL.max_pool(word_vecs(spark, d, cut=cut), dim=dim), C.docs(spark, d), dim, "pooled")


@register("doc_max_pool", sql=f"""WITH {TV_SQL},
dims AS (SELECT doc_id, unnest(range(len(vec))) AS i, unnest(vec) AS v FROM tv),
mx AS (SELECT doc_id, i, max(v) AS v FROM dims GROUP BY doc_id, i),
mp AS (SELECT doc_id, list(v ORDER BY i) AS pooled FROM mx GROUP BY doc_id)
SELECT d.doc_id, coalesce(mp.pooled, {_zero_sql('(SELECT d FROM dim)')}) AS pooled
FROM documents d LEFT JOIN mp ON mp.doc_id = d.doc_id""")
def doc_max_pool(spark, d):
    return max_pooled(spark, d)


def _u_sql(vec_id: int) -> str:
    return f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {vec_id})"


def _score_sql(vec: str, u: str) -> str:
    return (f"list_sum(list_transform(list_zip(list_transform({vec}, lambda x: tanh(CAST(x AS DOUBLE))), {u}), "
            f"lambda z: z[1] * z[2]))")


_WSCORE_SQL = f"""{TV_SQL},
ts AS (SELECT doc_id, sent_pos, word_pos, vec, {_score_sql('vec', _u_sql(0))} AS score FROM tv)"""


@register("attention_weights", sql=f"""WITH {_WSCORE_SQL}
SELECT doc_id, sent_pos, word_pos,
       round(exp(score) / (sum(exp(score)) OVER (PARTITION BY doc_id, sent_pos) + 1e-7), 6) AS weight FROM ts""")
def attention_weights(spark, d):
    w = PL.attention_weights(tok_scores(spark, d, context_vector(spark, d, 0)), ["doc_id", "sent_pos"])
    return w.select("doc_id", "sent_pos", "word_pos", F.round("weight", 6).alias("weight"))


@register("attention_weights_doc", sql=f"""WITH {_WSCORE_SQL}
SELECT doc_id, sent_pos, word_pos,
       round(exp(score) / (sum(exp(score)) OVER (PARTITION BY doc_id) + 1e-7), 6) AS weight FROM ts""")
def attention_weights_doc(spark, d):
    w = PL.attention_weights(tok_scores(spark, d, context_vector(spark, d, 0)), ["doc_id"])
    return w.select("doc_id", "sent_pos", "word_pos", F.round("weight", 6).alias("weight"))


@register("attention_pool", sql=f"""WITH {_WSCORE_SQL},
tw AS (SELECT *, exp(score) / (sum(exp(score)) OVER (PARTITION BY doc_id, sent_pos) + 1e-7) AS w FROM ts),
td AS (SELECT doc_id, sent_pos, w, unnest(range(len(vec))) AS i, unnest(vec) AS v FROM tw),
sd AS (SELECT doc_id, sent_pos, i, sum(w * v) AS v FROM td GROUP BY doc_id, sent_pos, i),
sv AS (SELECT doc_id, sent_pos, list(v ORDER BY i) AS svec FROM sd GROUP BY doc_id, sent_pos),
ss AS (SELECT *, {_score_sql('svec', _u_sql(1))} AS score FROM sv),
sw AS (SELECT *, exp(score) / (sum(exp(score)) OVER (PARTITION BY doc_id) + 1e-7) AS w FROM ss),
dd AS (SELECT doc_id, w, unnest(range(len(svec))) AS i, unnest(svec) AS v FROM sw),
dv AS (SELECT doc_id, i, sum(w * v) AS v FROM dd GROUP BY doc_id, i),
places AS (SELECT doc_id, CAST(unnest(range((SELECT d FROM dim))) AS INTEGER) AS pos FROM documents)
SELECT p.doc_id, p.pos, coalesce(dv.v, 0.0::DOUBLE) AS value
FROM places p LEFT JOIN dv ON dv.doc_id = p.doc_id AND dv.i = p.pos""")
def attention_pool(spark, d):
    """One row for each document and dimension. Words are dealt by document before they get vectors, so that sums of
    sentences and documents are made where their words are: no row with a vector is shuffled but a document's."""
    u_word = context_vector(spark, d, 0)
    cut = cut_words(spark, d)
    sentences = cut.agg(F.coalesce(F.sum(F.greatest(F.size("sents"), F.lit(0))), F.lit(0))).first()[0]
    words = word_vecs(spark, d, u_word, cut, shares(spark, sentences, TASK_SENTENCES))
    out = PL.attention_pool(words, u_word, context_vector(spark, d, 1))
    out = PL.keep_documents(out.select("doc_id", "doc_vec"), C.docs(spark, d), dim_of(spark, d), "doc_vec", "double")
    return out.select("doc_id", F.posexplode("doc_vec").alias("pos", "value"))
