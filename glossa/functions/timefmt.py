"""Time expressions: elapsed seconds and ``[D day[s], ]H:MM:SS`` text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed_seconds(ts: str, start: str) -> Column:
    """Seconds (fractional) from a fixed wall-clock start to ``ts``; both
    read as time-zone-free timestamps, so the session zone cannot shift them."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(start).cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    return micros / F.lit(1e6)


def format_duration(seconds: Column) -> Column:
    """Round half to even to whole seconds and render like a Python
    ``timedelta``: ``H:MM:SS``, prefixed by ``N day, `` / ``N days, ``."""
    secs = F.bround(seconds, 0).cast("long")
    days = F.floor(secs / F.lit(86400)).cast("long")
    rem = secs - days * F.lit(86400)
    hms = F.format_string("%d:%02d:%02d", F.floor(rem / 3600).cast("long"),
                          F.floor((rem % 3600) / 60).cast("long"), (rem % 60).cast("long"))
    prefix = (F.when(days == 0, F.lit("")).when(days == 1, F.lit("1 day, "))
              .otherwise(F.concat(days.cast("string"), F.lit(" days, "))))
    return F.concat(prefix, hms)
