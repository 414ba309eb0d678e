"""Array-valued numeric expressions: softmax, argmax, ReLU, divergences, losses.

All are higher-order SQL functions over ``array<double>`` columns, evaluated
in the JVM row by row; no Python, no explode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-15  # probability clip of the log loss


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def softmax(x: Column | str) -> Column:
    """Numerically stable softmax of an array."""
    a = _col(x)
    e = F.transform(a, lambda v: F.exp(v - F.array_max(a)))
    total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / total)


def scale(x: Column | str, factor: float) -> Column:
    return F.transform(_col(x), lambda v: v * F.lit(factor))


def argmax(x: Column | str) -> Column:
    """0-based index of the first maximum (null for an empty array)."""
    a = _col(x)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def relu(x: Column | str, element_type: str = "double") -> Column:
    """Element-wise ``max(v, 0)``, keeping the element type."""
    return F.transform(_col(x), lambda v: F.greatest(v, F.lit(0).cast(element_type)))


def prob_at(p: Column | str, code: Column | str) -> Column:
    """``p[code]`` (0-based); null when out of range."""
    return F.try_element_at(_col(p), _col(code) + F.lit(1))


def cross_entropy(p: Column | str, code: Column | str, eps: float = EPS, mode: str = "probabilities") -> Column:
    """Per-row cross entropy of class ``code``.

    ``mode='probabilities'``: ``-ln(clip(p[code]))`` for probabilities ``p``.
    ``mode='logits'``: ``p`` holds raw scores; ``-log_softmax(p)[code]``.
    ``mode='double_softmax'``: ``p`` holds probabilities that are passed
    through softmax again before the loss (a loss that expects logits fed
    with probabilities)."""
    if mode == "probabilities":
        pc = prob_at(p, code)
        return -F.log(F.least(F.greatest(pc, F.lit(eps)), F.lit(1.0 - eps)))
    if mode in ("logits", "double_softmax"):
        a = _col(p)
        mx = F.array_max(a)
        lse = mx + F.log(F.aggregate(F.transform(a, lambda v: F.exp(v - mx)), F.lit(0.0), lambda acc, v: acc + v))
        return lse - prob_at(a, code)
    raise ValueError(f"unknown cross-entropy mode {mode!r}")


def kl_divergence(t: Column | str, q: Column | str) -> Column:
    """``sum_c t_c (ln t_c - ln q_c)`` with ``0 ln 0 = 0``."""
    terms = F.zip_with(_col(t), _col(q), lambda a, b: F.when(a == 0, F.lit(0.0)).otherwise(a * (F.log(a) - F.log(b))))
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def kl_divergence_literal(t: Column | str, q: Column | str) -> Column:
    """The mis-slotted divergence: mean over classes of ``t (ln t - q)`` with
    probabilities passed where log-probabilities were expected."""
    terms = F.zip_with(_col(t), _col(q), lambda a, b: F.when(a == 0, F.lit(0.0)).otherwise(a * (F.log(a) - b)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) / F.size(_col(t))


def round_array(x: Column | str, digits: int = 6) -> Column:
    return F.transform(_col(x), lambda v: F.round(v, digits))
