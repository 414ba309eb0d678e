"""Reproducible train / validation / test splits, shuffles and samples.

Randomness is a hash of ``seed:doc_id`` (md5), never ``rand()`` or row
position, so the same seed gives the same assignment under any partitioning,
on any cluster size, and after any task retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.ranking import global_row_number, grouped_row_number

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def hash_key(seed: int, key: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def check_fractions(train: float, validation: float, test: float, tol: float = 1e-9) -> None:
    if min(train, validation, test) <= 0:
        raise ValueError("split fractions must all be positive")
    if abs(train + validation + test - 1.0) > tol:
        raise ValueError("split fractions must sum to 1.0")


def stratified_split(coded: DataFrame, train: float = 0.8, validation: float = 0.1, test: float = 0.1,
                     seed: int = 42, stratum: str = "code", key: str = "doc_id") -> DataFrame:
    """Add ``split``: per stratum, the first ``bround(train*n)`` rows in hash
    order are train, the next ``bround(validation/(validation+test) * rest)``
    validation, the remainder test (the exact sizes of per-class sampling).

    The per-stratum rank uses :func:`grouped_row_number`, so a stratum holding
    a third of the corpus is still ranked by the whole cluster.
    """
    check_fractions(train, validation, test)
    ranked = grouped_row_number(coded, [stratum], [hash_key(seed, key), F.col(key)], "_sp_rn", total="_sp_n")
    n_train = F.bround(F.lit(train) * F.col("_sp_n"), 0)
    n_val = F.bround(F.lit(validation / (validation + test)) * (F.col("_sp_n") - n_train), 0)
    split = (F.when(F.col("_sp_rn") <= n_train, F.lit(TRAIN))
             .when(F.col("_sp_rn") <= n_train + n_val, F.lit(VALIDATION))
             .otherwise(F.lit(TEST)))
    return ranked.withColumn("split", split).drop("_sp_rn", "_sp_n")


def random_split(df: DataFrame, train: float = 0.8, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Disjoint split: the first ``bround(train*n)`` rows in hash order are
    train; half of the rest (``bround``) test; the remainder validation."""
    if not 0 < train < 1:
        raise ValueError("train fraction must be in (0, 1)")
    ranked = global_row_number(df, [hash_key(seed, key), F.col(key)], "_sp_rn", total="_sp_n")
    n_train = F.bround(F.lit(train) * F.col("_sp_n"), 0)
    n_test = F.bround(F.lit(0.5) * (F.col("_sp_n") - n_train), 0)
    split = (F.when(F.col("_sp_rn") <= n_train, F.lit(TRAIN))
             .when(F.col("_sp_rn") <= n_train + n_test, F.lit(TEST))
             .otherwise(F.lit(VALIDATION)))
    return ranked.withColumn("split", split).drop("_sp_rn", "_sp_n")


def split_summary(split_df: DataFrame) -> DataFrame:
    """(split, n) per part plus the ``full`` row (a rollup)."""
    return (split_df.rollup("split").agg(F.count(F.lit(1)).alias("n"))
            .select(F.coalesce(F.col("split"), F.lit("full")).alias("split"), "n"))


def remainder(df: DataFrame, taken: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``taken`` (anti join on the key, so
    equal texts are still distinct rows)."""
    return df.join(taken.select(key), key, "left_anti")


def union_parts(parts: dict[str, DataFrame]) -> DataFrame:
    """Concatenate parts, duplicates kept, with a ``source_split`` column."""
    out = None
    for name, part in parts.items():
        p = part.withColumn("source_split", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def shuffle_positions(df: DataFrame, seed: int = 42, key: str = "doc_id", name: str = "shuffle_pos") -> DataFrame:
    """A seeded permutation as data: each row's 1-based position in hash order."""
    return global_row_number(df, [hash_key(seed, key), F.col(key)], name)


def random_row(df: DataFrame, seed: int = 42, key: str = "doc_id", n: int = 1) -> DataFrame:
    """``n`` seeded random rows (distributed TakeOrdered on the hash)."""
    return df.orderBy(hash_key(seed, key), F.col(key)).limit(n)
