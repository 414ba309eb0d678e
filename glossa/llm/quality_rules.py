"""Operator 3: quality rules combined by weak supervision.

Each rule looks at one property of a text and votes good, bad, or abstains. The
rules are not trusted alike and none of them rejects by itself: expectation-
maximisation estimates, from how the rules agree over the whole corpus, how
often each votes which way on good and on bad texts, and a text is kept if its
posterior probability of being good is at least one half.

The corpus enters the estimate as counts of vote patterns: one aggregation,
whose result has at most 3 ** rules rows whatever the corpus's size. The
posterior of each pattern goes back as a column expression. Properties are
computed once, map-only over whole texts, and written (a few numbers a row).

Words are runs of anything but ASCII white space.

Defined results: null text counts as empty: no words, so it fails the base
test; every row gives one row, repeated rows repeat (and count as often in the
estimate); other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import landed, slices, text_bytes

SYMBOLS = b"#*$%&|<>"
PROPERTIES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
              "n_adjacent_repeats", "n_top_word")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5


def properties(raw: bytes) -> tuple[int, ...]:
    """:data:`PROPERTIES` of one text, without ``word_chars``, in order."""
    words = raw.split()
    n = len(words)
    seen: set[bytes] = set()
    n_lines = n_dup_lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            if line in seen:
                n_dup_lines += 1
            else:
                seen.add(line)
    counts = Counter(words)
    adjacent = sum(map(bytes.__eq__, words, words[1:])) if len(counts) < n else 0
    return (n, len(raw) - len(raw.translate(None, SYMBOLS)), n_dup_lines, repeated_words(words), n_lines, len(counts),
            adjacent, max(counts.values(), default=0))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0  # words counted so far stand before ``covered``
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


@dataclass(frozen=True)
class Rule:
    """Votes bad if ``bad`` holds, else good if ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return (F.when(self.bad, F.lit(-1)).when(self.good, F.lit(1)).otherwise(F.lit(0))).alias(self.name)


def default_rules() -> list[Rule]:
    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    long_enough = F.col("n_words") >= 20
    return [
        Rule("symbols", share("n_symbols", "n_words") > 0.1, share("n_symbols", "n_words") < 0.02),
        Rule("symbol_chars", share("n_symbols", "word_chars") > 0.03,
             (share("n_symbols", "word_chars") < 0.005) & long_enough),
        Rule("dup_lines", (share("n_dup_lines", "n_lines") > 0.4) & (F.col("n_lines") >= 4),
             (share("n_dup_lines", "n_lines") < 0.2) & (F.col("n_lines") >= 4)),
        Rule("repeats", share("n_repeat_words", "n_words") > 0.5, (share("n_repeat_words", "n_words") <= 0.5) & long_enough),
        Rule("adjacent", (share("n_adjacent_repeats", "n_words") > 0.3) & long_enough,
             (share("n_adjacent_repeats", "n_words") < 0.05) & long_enough),
        Rule("top_word", (share("n_top_word", "n_words") > 0.3) & long_enough,
             (share("n_top_word", "n_words") < 0.15) & long_enough),
        Rule("word_length", (share("word_chars", "n_words") > 7.5) | (share("word_chars", "n_words") < 2.5),
             (share("word_chars", "n_words") > 3) & (share("word_chars", "n_words") < 7) & long_enough),
        Rule("length", F.col("n_words") < 5, F.col("n_words") >= MIN_WORDS),
    ]


def measured(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the :data:`PROPERTIES` of each text, map-only."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            points = pc.fill_null(pc.utf8_length(batch.column(1)), 0)
            for start, stop in slices(texts):
                raws = texts[start:stop].to_pylist()
                rows = np.array([properties(r) for r in raws], np.int64).reshape(-1, len(PROPERTIES) - 1)
                blanks = [len(r) - len(r.translate(None, b" \t\n\r\x0b\x0c")) for r in raws]
                chars = np.asarray(points[start:stop], np.int64) - np.array(blanks, np.int64)
                columns = [rows[:, 0], chars, *rows[:, 1:].T]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:stop], *[pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns]],
                    ["key", *PROPERTIES])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, " + ", ".join(f"{p} long" for p in PROPERTIES))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Posterior probability of good by vote pattern.

    Two classes; given the class, each rule votes bad, abstains or votes good
    with probabilities of its own. The first posterior is a soft all-must-pass:
    likely bad with any bad vote, else likely good. One vote of each kind is added to every count, so that no probability is 0."""
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns]) + 1  # 0 bad, 1 abstain, 2 good
    count = np.array([n for _, n in patterns], float)
    good = np.where((votes == 0).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        prior = (np.array([(1 - good) @ count, good @ count]) + 1) / (count.sum() + 2)
        belief = np.log(prior)[:, None] + np.zeros((2, len(count)))
        for rule in votes.T:
            for side, weight in enumerate((1 - good, good)):
                cast = np.array([weight[rule == v] @ count[rule == v] for v in range(3)]) + 1
                belief[side] += np.log(cast / cast.sum())[rule]
        new = 1 / (1 + np.exp(np.clip(belief[0] - belief[1], -500, 500)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return {p: float(g) for (p, _), g in zip(patterns, good, strict=True)}


def judge(df: DataFrame, key: str, text: str, rules: list[Rule] | None = None) -> DataFrame:
    """``key``, the :data:`PROPERTIES`, ``votes`` (array in the order of the
    rules), ``p_good``, ``base_failed`` and ``kept``."""
    rules = rules or default_rules()
    rows = landed(measured(df, key, text).withColumn("votes", F.array(*[r.vote() for r in rules])), "quality")
    counted = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** len(rules) rows at most
    posterior = estimate(sorted((tuple(r["votes"]), r["n"]) for r in counted))
    spark = df.sparkSession
    table = spark.createDataFrame([(list(p), g) for p, g in posterior.items()], "votes array<int>, p_good double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (rows.join(F.broadcast(table), "votes", "left").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= KEEP_AT))
            .withColumnRenamed("key", key))
