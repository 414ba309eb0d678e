"""Operator 10: quality classifier, hashed word n-grams with FTRL.

A text's tokens are runs of word characters and runs of other visible
characters. Its features are the hashes of its distinct tokens and token pairs,
each weighing one over the root of their number, and two shares: how many of
its tokens and of its pairs it has had before. A logistic regression over them
is trained with follow-the-regularised-leader (FTRL-proximal) updates: adaptive
steps per coordinate and an L1 term that keeps rare coordinates at zero.

Training takes a bounded sample of labelled rows (:data:`SAMPLE_ROWS`, chosen
by a hash of the key). Spark deals it to :data:`SHARDS` learners, each of which
makes :data:`EPOCHS` passes over its part; the model is the mean of theirs. It
has a fixed size (:data:`BITS`) and is broadcast. Scoring is a map-only sparse
dot product over whole texts.

Defined results: null text counts as empty and scores by the bias alone, as
any empty text; without labelled rows every score is 0.5; a key that is
labelled more than once takes its smallest label, other labels than 0 and 1
are ignored; every row gives one row, repeated rows repeat; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import slices, text_bytes

SAMPLE_ROWS = 24_000
SHARDS = 2
EPOCHS = 8
BITS = 18
# FTRL-proximal: step size, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.1
MEMO_ENTRIES = 400_000
_TOKEN = re.compile(r"[^\W_]+|[^\s\w]+|_+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Coordinates after the hashed ones.
AGAIN_TOKENS, AGAIN_PAIRS, BIAS = 1 << BITS, (1 << BITS) + 1, (1 << BITS) + 2
SIZE = (1 << BITS) + 3


class TokenMemo(dict):
    """Token -> 64-bit hash, remembered up to a bounded number of tokens."""

    def __missing__(self, token: str) -> int:
        h = xxhash.xxh3_64_intdigest(token)
        if len(token) <= 48:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[token] = h
        return h


def features(text: str, memo: TokenMemo) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (hashed ones may repeat where hashes share one) and values."""
    tokens = np.fromiter(map(memo.__getitem__, _TOKEN.findall(text)), np.uint64)
    if not len(tokens):
        return np.array([BIAS]), np.ones(1)
    pairs = (tokens[:-1] ^ (tokens[1:] * _MIX)) * _MIX
    own, own_pairs = np.unique(tokens), np.unique(pairs)
    n = len(own) + len(own_pairs)
    at = np.empty(n + 3, np.int64)
    at[:n] = np.concatenate([own, own_pairs]) >> np.uint64(64 - BITS)
    at[n:] = AGAIN_TOKENS, AGAIN_PAIRS, BIAS
    values = np.full(n + 3, n ** -0.5)
    values[n:] = 1 - len(own) / len(tokens), 1 - len(own_pairs) / max(1, len(pairs)), 1.0
    return at, values


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over the rows in their order."""
    z, n = np.zeros(SIZE), np.zeros(SIZE)

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for (at, x), y in zip(rows, labels, strict=True):
            at, first = np.unique(at, return_inverse=True)  # coordinates that hashes share add up
            x = np.bincount(first, x)
            w = weights(z[at], n[at])
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            step = (np.sqrt(n[at] + gradient ** 2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - step * w
            n[at] += gradient ** 2
    return weights(z, n)


def fit(df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str,
        sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Model weights (all 0 if no row is labelled)."""
    marked = (labels.select(F.col(label_key).alias("key"), F.col(label).cast("int").alias("label"))
              .where(F.col("key").isNotNull() & F.col("label").isin(0, 1)).groupBy("key").agg(F.min("label").alias("label")))
    total = marked.count()
    h = F.shiftrightunsigned(F.xxhash64("key"), 11) * F.lit(2.0 ** -53)
    sample = marked.where(h < F.lit(sample_rows / max(1, total)))  # about sample_rows rows, a bounded broadcast
    texts = (df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
             .join(F.broadcast(sample), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
             .withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(SHARDS))))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(h=[xxhash.xxh3_64_intdigest(str(k)) for k in part["key"]]).sort_values(["h", "key"])
        memo = TokenMemo()
        weights = train_ftrl([features(t, memo) for t in part["text"]], part["label"].tolist())
        return pd.DataFrame({"n": [len(part)], "weights": [weights.tobytes()]})

    learnt = texts.groupBy("shard").applyInPandas(learn, "n long, weights binary").collect()  # SHARDS rows
    if not learnt:
        return np.zeros(SIZE)
    counts = np.array([r["n"] for r in learnt], float)
    return np.average([np.frombuffer(r["weights"]) for r in learnt], axis=0, weights=counts)


def score(df: DataFrame, key: str, text: str, weights: np.ndarray) -> DataFrame:
    """``(key, score)``: probability of label 1."""
    model = df.sparkSession.sparkContext.broadcast({"weights": weights})
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value["weights"]
        memo = model.value.setdefault("memo", TokenMemo())  # later tasks of this worker go on with it
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for start, stop in slices(texts):
                out = []
                for raw in texts[start:stop].to_pylist():
                    at, x = features(raw.decode(), memo)
                    out.append(w[at] @ x)
                scores = 1 / (1 + np.exp(-np.clip(np.array(out), -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.array(scores)], ["key", "score"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, score double").withColumnRenamed("key", key)
