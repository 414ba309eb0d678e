"""Label normalisation expressions (JVM-side, ANSI-safe on dirty input)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def onehot_string_to_code(s: Column | str) -> Column:
    """Class code from a one-hot digit string (``0000001000`` -> 3): the
    number of digits of its integer value minus one, i.e. the position of the
    ``1`` counted from the right. Unparsable input gives null."""
    return (F.length(_col(s).try_cast("bigint").cast("string")) - F.lit(1)).cast("int")


def code_to_onehot_string(code: Column | str, width: int) -> Column:
    """Inverse: a ``width``-digit one-hot string with the ``1`` at ``code``
    counted from the right."""
    c = _col(code)
    return F.lpad(F.concat(F.lit("1"), F.repeat(F.lit("0"), c)), width, "0")


def star_to_code(s: Column | str) -> Column:
    """Star rating text to a 0-based class: ``int(float(x)) - 1``; anything
    unparsable (text, NaN, infinity, null) gives class 0."""
    return F.coalesce(star_code_or_null(s), F.lit(0))


def star_code_or_null(s: Column | str) -> Column:
    return (_col(s).try_cast("double").try_cast("int") - F.lit(1)).cast("int")


def one_hot(code: Column | str, n_classes: Column | str | int) -> Column:
    """``array<int>`` of width ``n_classes`` with a 1 at ``code``."""
    n = F.lit(n_classes) if isinstance(n_classes, int) else _col(n_classes)
    c = _col(code)
    return F.transform(F.sequence(F.lit(0), n - F.lit(1)), lambda i: (i == c).cast("int"))
