"""Operator 6: sharding by weighted rendezvous hashing.

Every shard gives a record key a score, ``-ln(u) / weight`` with ``u`` a
uniform hash of (key, shard); the least score wins. A shard's share is
proportional to its weight. The scores of the other shards do not change when a
shard is added, so records move only into the new shard; when one is removed,
only its records move. All of it is one projection over the key's hash, without
a shuffle.

Slots number the records of a shard without gaps. Shards are few and large, so
the numbering is a distributed sort with per-partition offsets
(``ranking.grouped_row_number``), never one task per shard; only keys and the
small columns are sorted, not texts.

Defined results: a null key is a key like any other (all null keys share a
shard); null text has no bytes; repeated rows share a shard and get slots of
their own; ties in the order of slots are between rows equal in every column
that is returned; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.ranking import grouped_row_number


def score(key: Column, shard: int, weight: float) -> Column:
    """The key's score for a shard: an exponential variate with rate ``weight``."""
    h = F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), key.isNull(), F.lit(shard))
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)
    return -F.log(u) / F.lit(float(weight))


def best_of(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    scored = [F.struct(score(key, first + i, w).alias("score"), F.lit(first + i).alias("shard"))
              for i, w in enumerate(weights)]
    return F.least(*scored) if len(scored) > 1 else scored[0]


def assign(df: DataFrame, key: str, weights: Sequence[float], grown_by: float = 1.0) -> DataFrame:
    """``df`` with ``shard``, and ``grown_shard``: where the record goes when one
    more shard, of weight ``grown_by``, is added."""
    now = best_of(F.col(key), weights)
    new = F.struct(score(F.col(key), len(weights), grown_by).alias("score"), F.lit(len(weights)).alias("shard"))
    return (df.withColumn("_now", now).withColumn("_grown", F.least(F.col("_now"), new))
            .withColumn("shard", F.col("_now.shard")).withColumn("grown_shard", F.col("_grown.shard"))
            .drop("_now", "_grown"))


def with_slots(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``slot``: 0, 1, 2, ... within each ``shard``, in ``order``."""
    ranked = grouped_row_number(df, ["shard"], [F.col(c) for c in order], "slot")
    return ranked.withColumn("slot", F.col("slot") - 1)


def write_shards(df: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write rows with ``shard`` and ``slot`` to one folder a shard, each dealt
    over several files, so that no task writes a whole shard."""
    spread = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    df.repartition(F.col("shard"), spread).write.partitionBy("shard").parquet(path)
