"""Word vectors on token rows, document pooling and attention weights.

Vector-valued aggregates (element-wise max, weighted sums) keep one built-in
aggregate a dimension: a hash aggregate with buffers of fixed width, combined in
every task. A document or sentence never has its vectors collected into one list,
dimensions are never exploded into rows, and no row with a vector is sorted,
spilled or shuffled: only a group's result is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.joins import bounded_broadcast

KERAS_EPSILON = 1e-7


def token_vectors(token_ids: DataFrame, vocab_vec: DataFrame) -> DataFrame:
    """(doc_id, sent_pos, word_pos, idx, vec): embedding lookup by id. Rows are
    ordered by id before they get their vectors, in each partition: equal vectors
    written side by side compress to little."""
    v = bounded_broadcast(vocab_vec.select("idx", "vec"))
    # always true, but not deterministic: the optimizer drops an order right below a join
    ordered = token_ids.sortWithinPartitions("idx").where(F.monotonically_increasing_id() >= 0)
    return ordered.join(v, "idx").select("doc_id", "sent_pos", "word_pos", "idx", "vec")


def dimension(vectors: DataFrame, vec: str) -> int:
    return int(vectors.agg(F.coalesce(F.max(F.size(vec)), F.lit(0))).first()[0])


def max_pool(vectors: DataFrame, key: str | Sequence[str] = "doc_id", vec: str = "vec",
             dtype: str = "float32", dim: int | None = None) -> DataFrame:
    """(key..., pooled): element-wise maximum of the group's vectors, which have
    ``dim`` elements (read from the rows if not given)."""
    keys = [key] if isinstance(key, str) else list(key)
    dim = dimension(vectors, vec) if dim is None else dim
    agg = vectors.groupBy(*keys).agg(F.count(F.lit(1)), *[F.max(F.get(vec, F.lit(i))).alias(f"_m{i}") for i in range(dim)])
    kind = "float" if dtype == "float32" else "double"
    return agg.select(*keys, F.array(*[f"_m{i}" for i in range(dim)]).cast(f"array<{kind}>").alias("pooled"))


def keep_documents(pooled: DataFrame, docs: DataFrame, dim: int, name: str, dtype: str = "float") -> DataFrame:
    """(doc_id, name) for every row of ``docs``; a document without a known
    word has the zero vector."""
    zero = F.array_repeat(F.lit(0.0).cast(dtype), dim)
    return docs.select("doc_id").join(pooled, "doc_id", "left").select("doc_id", F.coalesce(name, zero).alias(name))


def attended(scored: DataFrame, keys: Sequence[str], vec: str, name: str, dim: int,
             eps: float = KERAS_EPSILON) -> DataFrame:
    """(keys..., name): the group's vectors, summed with the weights of
    :func:`attention_weights`: ``sum(exp(score) * vec) / (sum(exp(score)) + eps)``."""
    each = scored.withColumn("_e", F.exp("score"))
    sums = each.groupBy(*keys).agg(F.sum("_e").alias("_t"), *[
        F.sum(F.col("_e") * F.get(vec, F.lit(i))).alias(f"_s{i}") for i in range(dim)])
    return sums.select(*keys, F.array(*[F.col(f"_s{i}") / (F.col("_t") + F.lit(eps)) for i in range(dim)]).alias(name))


def dot(a: Column, b: Sequence[float]) -> Column:
    """Dot product of an array column with a literal vector."""
    lit = F.array(*[F.lit(float(x)) for x in b])
    return F.aggregate(F.zip_with(a, lit, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def attention_score(h: Column, u: Sequence[float], w: Sequence[Sequence[float]] | None = None,
                    b: Sequence[float] | None = None) -> Column:
    """``u . tanh(W h + b)``; identity ``W`` and zero ``b`` when omitted."""
    z = h
    if w is not None:
        z = F.array(*[dot(h, row) for row in w])
    if b is not None:
        z = F.zip_with(z, F.array(*[F.lit(float(x)) for x in b]), lambda x, y: x + y)
    return dot(F.transform(z, lambda x: F.tanh(x)), u)


def attention_weights(scored: DataFrame, by: Sequence[str], score: str = "score",
                      eps: float = KERAS_EPSILON) -> DataFrame:
    """Add ``weight = exp(score) / (sum(exp(score)) + eps)`` within ``by``
    (a sentence: ``doc_id, sent_pos``; a whole document: ``doc_id``).
    The window is partitioned by document, so each partition is one document."""
    w = Window.partitionBy(*by)
    return scored.withColumn("weight", F.exp(score) / (F.sum(F.exp(score)).over(w) + F.lit(eps)))


def attention_pool(tok_vecs: DataFrame, u_word: Sequence[float], u_sent: Sequence[float],
                   eps: float = KERAS_EPSILON) -> DataFrame:
    """(doc_id, doc_vec): two-level attention pooling. Word scores
    ``u_word . tanh(h)`` -> weights within the sentence -> weighted sentence
    vectors -> sentence scores ``u_sent . tanh(s)`` -> weights within the
    document -> weighted document vector. A word's score depends on its vector
    only: ``tok_vecs`` may bring it along as ``score``."""
    words = tok_vecs if "score" in tok_vecs.columns else tok_vecs.withColumn("score", attention_score(F.col("vec"), u_word))
    sents = attended(words, ["doc_id", "sent_pos"], "vec", "svec", len(u_word), eps)
    sents = sents.withColumn("score", attention_score(F.col("svec"), u_sent))
    return attended(sents, ["doc_id"], "svec", "doc_vec", len(u_sent), eps)
