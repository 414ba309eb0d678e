"""Date slices of a corpus (time-zone free: bounds are NTZ literals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def year_predicate(date: str, year: int, full_year: bool = False) -> Column:
    """``date`` within year ``year``. The default keeps the literal bounds
    ``[Y-01-01 00:00, Y-12-30 00:00]`` (30 December after midnight and all of
    31 December fall outside); ``full_year=True`` uses ``[Y-01-01, Y+1-01-01)``."""
    c = F.col(date).cast("timestamp_ntz")
    lo = _ntz(f"{year:04d}-01-01 00:00:00")
    if full_year:
        return (c >= lo) & (c < _ntz(f"{year + 1:04d}-01-01 00:00:00"))
    return (c >= lo) & (c <= _ntz(f"{year:04d}-12-30 00:00:00"))


def year_slice(df: DataFrame, date: str, year: int, full_year: bool = False) -> DataFrame:
    """Rows inside the year (a plain filter: pushed into the Parquet scan)."""
    return df.where(year_predicate(date, year, full_year))


def year_complement(df: DataFrame, date: str, year: int, full_year: bool = False) -> DataFrame:
    """Rows with a date outside the year; null dates are in neither part."""
    return df.where(F.col(date).isNotNull() & ~year_predicate(date, year, full_year))
