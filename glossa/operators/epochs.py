"""Epoch batches: every epoch its own order of all rows, without a sort.

Rows get gapless numbers once (:func:`numbered`). An epoch's order is a keyed
permutation of these numbers, so a row knows its place and its batch from its
number, the number of rows and the epoch's key alone: map-only, nothing is
shuffled or stored for an epoch, any task can be repeated.

The permutation is a Feistel network over pairs of numbers below ``side``, the
least whole number whose square holds all rows. A place beyond the last row is
encrypted again until it is one (cycle walking). Fewer than ``2 * side`` places are
beyond, and the longest walk over them is measured (:func:`longest_walk`), so the
expression has a fixed number of steps and no row is left over.

Defined results: ``n`` rows have the places 0 to ``n - 1``, each once an epoch; no
rows have none; the last batch may be shorter; the same seed and epoch give the
same order under any partitioning.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.ranking import global_row_number

ROUNDS = 6
PRIME = (1 << 31) - 1  # squares of what is below fit a long; ``side`` stays below it


def numbered(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` with ``row_no``, 0 to n - 1 by the unique ``key``."""
    ranked = global_row_number(df, [F.col(key)], "row_no")
    return ranked.withColumn("row_no", F.col("row_no") - 1)


def round_keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """Two numbers below :data:`PRIME` for each round."""
    def number(i: int, part: int) -> int:
        return int(hashlib.md5(f"{seed}:{epoch}:{i}:{part}".encode()).hexdigest()[:15], 16) % PRIME

    return [(number(i, 0), number(i, 1)) for i in range(ROUNDS)]


def side_of(n: int) -> int:
    side = math.isqrt(max(n - 1, 0)) + 1
    if side >= PRIME:
        raise ValueError(f"{n} rows are more than a permutation of {PRIME} squared holds")
    return side


def _permuted(place: Column, side: int, keys: list[tuple[int, int]], back: bool = False) -> Column:
    """The network's image of ``place``, or (``back``) the place that has it as its image."""
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
                      for a, b in (reversed(keys) if back else keys)])
    low = (place % F.lit(side)).cast("long")
    start = F.struct(F.call_function("div", place - low, F.lit(side).cast("long")).alias("l"), low.alias("r"))

    def mixed(x: Column, k: Column) -> Column:
        base = (x + k["a"]) % F.lit(PRIME)
        return (base * base + k["b"]) % F.lit(PRIME)

    def turn(s: Column, k: Column) -> Column:
        return F.struct(s["r"].alias("l"), ((s["l"] + mixed(s["r"], k)) % F.lit(side)).alias("r"))

    def turn_back(s: Column, k: Column) -> Column:
        return F.struct(F.pmod(s["r"] - mixed(s["l"], k), F.lit(side).cast("long")).alias("l"), s["l"].alias("r"))

    return F.aggregate(steps, start, turn_back if back else turn, lambda s: s["l"] * F.lit(side) + s["r"])


def longest_walk(spark: SparkSession, n: int, seed: int, epoch: int) -> int:
    """How often the worst place beyond the last row is encrypted until it is a
    row's place. Only places that a row's place leads to count: cycles that never
    leave the places beyond are never entered."""
    side, steps, keys = side_of(n), 0, round_keys(seed, epoch)
    at = spark.range(n, side * side).select(F.col("id").alias("place"))
    at = at.where(_permuted(F.col("place"), side, keys, back=True) < n)
    while at.limit(1).count():
        steps += 1
        at = at.select(_permuted(F.col("place"), side, keys).alias("place")).where(F.col("place") >= n)
    return steps


def epoch_batches(rows: DataFrame, n: int, epoch: int, batch_size: int, seed: int = 42) -> DataFrame:
    """``rows`` (with ``row_no``) and ``epoch``, ``place``, ``batch``, ``slot`` in the batch."""
    side, keys = side_of(n), round_keys(seed, epoch)
    walk = longest_walk(rows.sparkSession, n, seed, epoch)
    first = _permuted(F.col("row_no"), side, keys)
    if walk:
        place = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), first,
                            lambda x, _: F.when(x < n, x).otherwise(_permuted(x, side, keys)))
    else:
        place = first
    out = rows.withColumn("epoch", F.lit(epoch)).withColumn("place", place)
    return out.withColumns({"batch": F.expr(f"place div {batch_size}"), "slot": (F.col("place") % batch_size).cast("int")})
