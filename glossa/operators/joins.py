"""Join helpers: broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.session import materialize

# Default ceiling for an explicit broadcast; overridable per session with
# ``glossa.broadcast.maxBytes``.
DEFAULT_MAX_BROADCAST_BYTES = 128 * 1024 * 1024


def max_broadcast_bytes(df: DataFrame) -> int:
    try:
        v = df.sparkSession.conf.get("glossa.broadcast.maxBytes")
    except Exception:  # noqa: BLE001
        v = None
    return int(v) if v else DEFAULT_MAX_BROADCAST_BYTES


def estimated_bytes(df: DataFrame) -> int:
    """Upper estimate of a table's in-memory size: the length of each row
    rendered as JSON (numbers and arrays print longer than they store)."""
    row = df.select(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("b")).first()
    return int(row["b"])


def frequent_join(tokens: DataFrame, frequent: DataFrame, rest: DataFrame, key: str = "word") -> DataFrame:
    """``tokens`` joined with a table too large to broadcast, whose ``frequent``
    part (a bounded number of rows) is. Most tokens are of frequent words and stay
    where they are; only the others are shuffled, so no word is a large partition."""
    few = F.broadcast(frequent)
    others = tokens.join(F.broadcast(frequent.select(key)), key, "left_anti").join(rest, key)
    return tokens.join(few, key).unionByName(others)


def is_broadcast(df: DataFrame) -> bool:
    """Whether :func:`bounded_broadcast` marked ``df``."""
    return getattr(df, "_glossa_broadcast", False)


def bounded_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Materialise a dimension table (reliable checkpoint), measure it, and
    mark it for broadcast only if it is under the ceiling. Above the ceiling it
    is returned unhinted, so the planner uses a shuffle join (and AQE may still
    convert it, or split skewed partitions)."""
    limit = max_broadcast_bytes(df) if max_bytes is None else max_bytes
    df = materialize(df)
    if estimated_bytes(df) <= limit:
        df = F.broadcast(df)
        df._glossa_broadcast = True
    return df
