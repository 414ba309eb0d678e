"""Operator 8 [native]: URL rules by a Bloom filter cascade.

A rule is a host and a path prefix (``example.com/en/``); it fits its host and
all subdomains where the path starts with its path, and the longest rule that
fits wins. A URL's candidate keys are its host's suffixes joined with its path
cut to each length that rules have. So the question is whether a candidate key
is listed, for keys of a universe that is known in full: the candidates of the
whole corpus.

The cascade answers exactly without a join. Level 1 is a Bloom filter of the
listed keys. The keys of the universe that it passes though they are not listed
make level 2, the listed keys that level 2 passes make level 3, and so on until
a level has no false positive. A key is listed if the number of levels that it
passes before it fails one is odd. Each level is built from the distributed
universe by aggregation; only its bits reach the plan. Level 1 is sized by the
ratio of unlisted to listed keys, so that the false positives of each level
are about as many as the listed keys: the cascade's size follows the list, not
the corpus. It is checked: above :data:`MAX_BITS`, or where more rules are
given than :data:`MAX_RULES`, membership is a left join on the key instead.

All expressions are Spark's own; no Python runs in tasks.

Defined results: null or ``://``-less URLs have an empty host and path, and no
rule; a URL without a rule gets ``default``; every row gives one row, repeated
rows repeat; other columns are ignored; no rows, or no rules, are no error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import landed

MAX_BITS = 1 << 23
MAX_RULES = 200_000
MAX_LEVELS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    key: str  # host and path prefix, host in lower case

    @property
    def path_length(self) -> int:
        return len(self.key) - self.key.index("/")


def rules_of(lines: list[str]) -> list[Rule]:
    """From lines like ``block example.com/en/``; a later line for a key wins."""
    out = {}
    for line in lines:
        verdict, key = line.split()
        host, slash, path = key.partition("/")
        if verdict not in ("allow", "block") or not host or not slash:
            raise ValueError(f"not a rule: {line}")
        out[host.lower() + slash + path] = verdict
    return [Rule(v, k) for k, v in out.items()]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Array of the keys that a rule fitting this URL can have, longest first,
    of equal length the one with the longer host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.array_distinct(F.array(*[F.substring(path, 1, n) for n in path_lengths]))
    # a path shorter than the cut equals the path itself, which is some other cut or no rule's path
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda p: F.struct(
        (-(F.length(s) + F.length(p))).alias("o"), (-F.length(s)).alias("h"), F.concat(s, p).alias("key")))))
    return F.when((host != "") & (path != ""), F.transform(F.array_sort(pairs), lambda x: x["key"])).otherwise(
        F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    n_bits: int
    n_hashes: int
    words: tuple[int, ...]  # signed 64-bit words


def _positions(key: Column, level: int, n_bits: int, n_hashes: int) -> list[Column]:
    first, step = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(F.xxhash64(first, step, F.lit(i)), F.lit(n_bits)) for i in range(n_hashes)]


def build_level(keys: DataFrame, level: int, n_keys: int, rate: float, n_bits: int | None = None) -> Level:
    """A Bloom filter of ``keys`` (column ``key``) with about this false positive
    rate, or of ``n_bits`` bits (a multiple of 64) whatever the rate."""
    n_hashes = max(1, round(-math.log2(rate)))
    n_bits = n_bits or 64 * max(1, math.ceil(n_keys * n_hashes / math.log(2) / 64))
    if n_bits > MAX_BITS:
        raise OverflowError(f"level {level} needs {n_bits} bits")
    at = F.explode(F.array(*_positions(F.col("key"), level, n_bits, n_hashes)))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
    by_word = {r["word"]: r["bits"] for r in words.collect()}  # MAX_BITS / 64 rows at most
    return Level(n_bits, n_hashes, tuple(by_word.get(i, 0) for i in range(n_bits // 64)))


def passes(key: Column, level: int, f: Level) -> Column:
    """Whether the filter may hold the key. The bits are a constant of the plan."""
    words = F.split(F.lit(",".join(map(str, f.words))), ",").cast("array<bigint>")
    out = F.lit(True)
    for at in _positions(key, level, f.n_bits, f.n_hashes):
        word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
        out = out & (F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """Levels over ``universe`` (distinct column ``key``), exact for each of its
    keys: whether it is in ``listed`` (distinct column ``key``)."""
    marked = landed(universe.join(listed.withColumn("listed", F.lit(True)), "key", "left").select(
        "key", F.coalesce("listed", F.lit(False)).alias("listed")), "cascade")
    levels: list[Level] = []
    while len(levels) < MAX_LEVELS:
        odd = len(levels) % 2 == 0  # this level encodes listed keys
        reached = marked
        for i, f in enumerate(levels):
            reached = reached.where(passes(F.col("key"), i, f))
        n_here, n_other = (reached.agg(F.count_if(F.col("listed") == odd), F.count_if(F.col("listed") != odd)).first())
        if n_here == 0:
            return levels  # the level before has no false positive
        rate = min(0.5, n_here / (math.sqrt(2) * n_other)) if not levels and n_other else 0.5
        levels.append(build_level(reached.where(F.col("listed") == odd), len(levels), n_here, max(rate, 1e-9)))
    raise RuntimeError("the cascade does not end: two keys share all their hashes")


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Membership of a key of the universe. Failing level i settles it: listed
    if i is odd; passing all means what the last level encodes."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(passes(key, i, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return out


def judge(df: DataFrame, key: str, url: str, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``(key, host, path, rule, verdict)`` per row; ``rule`` is null where none fits."""
    spark = df.sparkSession
    parsed = df.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    lengths = sorted({r.path_length for r in rules}) or [1]
    keyed = parsed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("key")).distinct()
    try:
        if len(rules) > MAX_RULES:
            raise OverflowError(f"{len(rules)} rules")
        listed = build_cascade(universe, _keys(spark, rules))
        blocking = build_cascade(universe, _keys(spark, [r for r in rules if r.verdict == "block"]))
    except OverflowError:
        return _judge_by_join(parsed, keyed, rules, default).withColumnRenamed("key", key)
    hit = F.get(F.filter("keys", lambda k: is_listed(k, listed)), F.lit(0))  # null where none fits
    out = keyed.withColumn("rule", hit).withColumn(
        "verdict", F.when(F.col("rule").isNull(), F.lit(default))
        .when(is_listed(F.col("rule"), blocking), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("key").alias(key), "host", "path", "rule", "verdict")


def _keys(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.key,) for r in rules], "key string")


def _judge_by_join(parsed: DataFrame, keyed: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The way beyond the size bound: distinct (host, path cut) pairs joined with the rules."""
    table = keyed.sparkSession.createDataFrame([(r.key, r.verdict) for r in rules], "rule string, verdict string")
    found = keyed.select("host", "path", F.posexplode("keys").alias("at", "rule")).distinct().join(table, "rule")
    best = found.groupBy("host", "path").agg(F.min(F.struct("at", "rule", "verdict")).alias("b"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select("key", "host", "path", F.col("b.rule").alias("rule"),
                      F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
