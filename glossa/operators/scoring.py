"""A deterministic keyword scorer: per-class logits from marker-pattern rates.

It is a transparent baseline classifier (no training) whose outputs can be
written in SQL exactly, which makes it the reference input for every metric,
loss and explanation operator. Trained Spark ML models produce the same
``(label, probability, pred)`` shape (see :mod:`glossa.operators.models`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import vectors as VX

# Marker patterns of the four corpus languages, in class-code order
# (de, en, es, fr): characters or digraphs typical of each language.
LANG_PATTERNS = ("[äöüß]", "th", "[ñáíóú¿¡]", "[èéêçàù]")


def keyword_logits(text: str, patterns: Sequence[str]):
    """``array<double>``: per class, matches of its pattern per 100 characters."""
    denom = F.greatest(F.length(text), F.lit(1))
    return F.array(*[(F.lit(100.0) * F.regexp_count(F.col(text), F.lit(p))) / denom for p in patterns])


def score(df: DataFrame, patterns: Sequence[str] = LANG_PATTERNS, text: str = "text",
          temperature: float = 1.0) -> DataFrame:
    """Add ``logits``, ``probability`` (softmax of logits / temperature) and
    ``pred`` (first arg-max of the logits)."""
    out = df.withColumn("logits", keyword_logits(text, patterns))
    lg = VX.scale("logits", 1.0 / temperature) if temperature != 1.0 else F.col("logits")
    return out.withColumn("probability", VX.softmax(lg)).withColumn("pred", VX.argmax("logits"))
