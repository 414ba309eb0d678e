"""Operator 7: similarity join on word shingles by a token-group matrix.

Texts whose sets of word shingles have a Jaccard similarity of at least
``percent`` / 100 are linked; the result names the connected component of each.

*Tokens.* The matrix's tokens are segments of a text's shingle set. With
similarity t, two sets of sizes a and b differ in at most D = (a+b)(1-t)/(1+t)
shingles; so if both are cut, by ranges of the shingle hash, into more than D
segments, at most D of them differ. Of its segments a set names those of w or
more shingles, w as large as it can be with more than D of them left. Of two
linked sets the one with the larger w so has a segment of w or more that is the
same in the other, and both name it. A segment token is the hash
of a segment's shingles; empty segments, which unrelated sets have in common, are so hardly ever named,
those of a single shingle less, and a sentence that many texts share seldom makes a token common. Sizes are dealt into bands, which fix D; a text
that can match smaller bands has tokens there, too.

*Groups.* Tokens of one text only are dropped. Of the texts with a token, the
one that shares most leads; each text joins the group of its best leader.
Groups are so made of similar texts, copies of one thing share a group. The
matrix holds each group's union of tokens.

*Bound, open.* A text's overlap with a group's union must be one token or more
(at most D of D + 1 segments can differ), otherwise no member can be similar.
A text is compared with the leader of its own group first. Then the groups are
opened: members of a token that are still in different components are compared
with each other. Before two shingle sets are read, their sizes and their parity
sketches (which differ in at most as many bits as the sets in shingles) must
allow the similarity; then it is verified. So no link between different texts
is lost that could join two components, and a group of n copies costs n
comparisons of sets, not n squared. Exact, but for collisions of 64-bit hashes.

Defined results: a text with fewer words than a shingle, but not none, has one
shingle, all its words; null text or one without words has none, and is linked
with nothing; equal texts are linked; rows with equal ids and different texts
are separate; a null id is never a component's name (a component of null ids
only has none); every row gives one row, repeated rows repeat; other columns
are ignored (or passed through by :func:`keep_one`); no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import discard, landed, null_safe, slices, text_bytes
from glossa.llm.components import connected_components
from glossa.llm.url_filter import build_level, passes

BAND = 1.5
SPARE = 1.25 # segments a set is cut into, times those that must be named
SKETCH_WORDS = 16
BLOOM_BITS = 1 << 20
MEMO_ENTRIES = 400_000
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_HALF = np.uint64(32)
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _K3
    return x ^ (x >> _HALF)


class WordMemo(dict):
    """Word -> 64-bit hash, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = h
        return h


def shingle_set(raw: bytes, size: int, memo: WordMemo) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles. Bytes are lower-cased and
    split as ASCII, whatever else they hold."""
    words = np.fromiter(map(memo.__getitem__, raw.lower().split()), np.uint64)
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        out = out * _K1 + words[k:n - width + 1 + k]
    return np.unique(mix(out))


class Bands:
    """Size bands, and in each the differences allowed and the hash ranges of the segments."""

    def __init__(self, percent: int):
        self.percent, self.starts, self.cuts = percent, [1, 2], {}

    def of(self, n: int) -> list[int]:
        """Bands in which a set of size ``n`` has tokens: its own, and those
        below in which sets can be similar."""
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND)))
        own = int(np.searchsorted(self.starts, n, side="right")) - 1
        out = [own]
        while out[-1] > 0 and 100 * (self.starts[out[-1]] - 1) >= self.percent * n:
            out.append(out[-1] - 1)
        return out

    def ranges(self, band: int) -> tuple[int, np.ndarray]:
        """How many shingles may differ, and the upper edges of the segments'
        hash ranges without the last."""
        if band not in self.cuts:
            top = self.starts[band + 1] - 1  # largest size whose own band it is
            most = top + top * 100 // self.percent
            differ = most * (100 - self.percent) // (100 + self.percent)
            n = int(SPARE * differ) + 1
            self.cuts[band] = differ, np.array([(i * 2 ** 64) // n for i in range(1, n)], np.uint64)
        return self.cuts[band]


def segment_tokens(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles * _K2), dtype=np.uint64)])
    out = []
    for band in bands.of(len(shingles)):
        differ, edges = bands.ranges(band)
        cuts = np.concatenate([[0], np.searchsorted(shingles, edges), [len(shingles)]])
        widths = np.diff(cuts)
        least = np.partition(widths, len(widths) - 1 - differ)[len(widths) - 1 - differ]
        part = np.flatnonzero(widths >= least)
        salt = np.uint64(xxhash.xxh3_64_intdigest(str(band)))
        out.append(mix((sums[cuts[part + 1]] - sums[cuts[part]]) * _K1 + part.astype(np.uint64) * _K2 + salt))
    return np.concatenate(out)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * SKETCH_WORDS buckets. A
    shingle that only one of two sets has changes one bit."""
    bits = 64 * SKETCH_WORDS
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def class_of(shingles: np.ndarray) -> int:
    """Identity of a shingle set, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signatures(df: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """``(key, rk, n, cls, sketch, tokens)``: hash of the text, size, identity and parity sketch of the
    shingle set, and its segment tokens. A task names the tokens of a class once only."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bands, seen = WordMemo(), Bands(percent), set()
        none, blank = np.zeros(0, np.uint64), np.zeros(SKETCH_WORDS, np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for start, stop in slices(texts):
                sizes, classes, sketches, tokens = [], [], [], []
                for raw in texts[start:stop].to_pylist():
                    shingles = shingle_set(raw, size, memo)
                    sizes.append(len(shingles))
                    cls = class_of(shingles) if len(shingles) else None
                    classes.append(cls)
                    sketches.append(blank if cls is None else parity_sketch(shingles))
                    if cls is None or cls in seen:
                        tokens.append(none)
                        continue
                    if len(seen) >= MEMO_ENTRIES:
                        seen.clear()
                    seen.add(cls)
                    tokens.append(segment_tokens(shingles, bands))
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                flat = np.concatenate(tokens).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:stop], batch.column(1)[start:stop], pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()),
                     *[pa.array(column) for column in np.array(sketches).T.copy()],
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["key", "rk", "n", "cls", *_SKETCH, "tokens"])

    return df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("rk"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, rk long, n long, cls long, " + "".join(f"{c} long, " for c in _SKETCH) + "tokens array<long>")


def shingle_rows(df: DataFrame, size: int) -> DataFrame:
    """``(cls, shingles)`` of each ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo()
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for start, stop in slices(texts):
                sets = [shingle_set(raw, size, memo) for raw in texts[start:stop].to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))],
                    ["cls", "shingles"])

    return df.select("text").mapInArrow(run, "cls long, shingles array<long>")


def _of(texts: DataFrame, side: str) -> DataFrame:
    return texts.select(*[F.col(c).alias(side + c) for c in texts.columns])


def _may_link(percent: int) -> Column:
    """Whether two texts' sizes and sketches (sides x_ and y_) allow a link."""
    a, b = F.col("x_n"), F.col("y_n")
    differ = sum((F.bit_count(F.col("x_" + c).bitwiseXOR(F.col("y_" + c))) for c in _SKETCH), F.lit(0))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (
        differ * (100 + percent) <= (a + b) * (100 - percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs(a, b)``."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), (
        F.size("sa") + F.size("sb")).alias("sizes"))
    return both.where(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b")


def components(df: DataFrame, key: str, text: str, size: int = 3, percent: int = 90) -> DataFrame:
    """``(key, rk, n_shingles, cls, component)`` per row; ``rk`` is
    ``xxhash64(text)``, ``cls`` the identity of the shingle set, ``component``
    the smallest key reachable by links."""
    return _rooted(df, key, text, size, percent).drop("root")


def _rooted(df: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """:func:`components`, and ``root``: a class of the component, null keys only or not."""
    signed = landed(signatures(df, key, text, size, percent), "signatures")
    named = signed.where(F.col("cls").isNotNull())
    # one shuffle by token, read by the count of classes, the join and the distinct rows
    tokens = named.select("cls", F.explode("tokens").alias("token")).repartition("token")
    shared = tokens.groupBy("token").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).where("c0 <> c1").select("token")
    matrix = landed(tokens.join(shared, "token").distinct().select("token", "cls"), "matrix")

    # one group for each text: the text that shares most leads
    share = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("share"))
    weight = matrix.join(share, "token").groupBy("cls").agg(F.sum("share").alias("weight"))
    weighed = matrix.join(weight, "cls").select("token", "cls", F.struct("weight", "cls").alias("w"))
    leaders = weighed.groupBy("token").agg(F.max("w").alias("leader"))
    groups = weighed.join(leaders, "token").groupBy("cls").agg(F.max("leader").alias("leader")).select(
        "cls", F.col("leader.cls").alias("leader"))
    one = named.join(groups, "cls").groupBy("cls", "leader").agg(
        F.min(F.struct(F.col("key").isNull().alias("null"), "key", "rk")).alias("row"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in _SKETCH])
    texts = landed(one.select("cls", "leader", "row.key", "row.rk", "n", *_SKETCH), "texts")
    rows = landed(signed.select("key", "rk", "n", "cls"), "rows")
    discard(signed)  # its tokens are in the matrix

    # the bound against the own group's leader, then between the texts of a token in open groups
    plain = texts.select("cls", "n", *_SKETCH)
    own = _of(texts.where("cls <> leader").drop("key", "rk"), "x_").join(_of(plain, "y_"), F.col("x_leader") == F.col("y_cls"))
    asked = landed(own.where(_may_link(percent)).select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")), "own-group")
    sets = _shingle_sets(df, key, text, texts, asked, size)
    own = landed(_verified(asked, sets, percent), "own-links")
    discard(asked, sets)
    roots = connected_components(own)
    rooted = texts.select("cls", "leader", "n", *_SKETCH).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls"))
    placed = matrix.select("token", "cls").join(rooted.select("cls", "root"), "cls")
    opened = placed.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    members = landed(placed.select("token", "cls").join(opened.select("token"), "token", "left_semi").join(rooted, "cls"),
                     "members")
    discard(matrix)
    pairs = _of(members, "x_").join(
        _of(members, "y_"), (F.col("x_token") == F.col("y_token")) & (F.col("x_root") < F.col("y_root"))
        & (F.col("x_cls") != F.col("y_leader")) & (F.col("y_cls") != F.col("x_leader")) & _may_link(percent))
    pairs = landed(pairs.select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")).distinct(), "open-pairs")
    discard(members)
    sets = _shingle_sets(df, key, text, texts, pairs, size)
    roots = connected_components(own.unionByName(_verified(pairs, sets, percent)))
    discard(pairs, sets, own, texts)

    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("key").alias("name")).join(
        roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    names = classes.groupBy("root").agg(F.min("name").alias("component"))
    classes = classes.join(names, "root").select("cls", "root", "component")
    out = rows.select("key", "rk", F.col("n").alias("n_shingles"), "cls").join(classes, "cls", "left")
    return out.select(F.col("key").alias(key), "rk", "n_shingles", "cls",
                      F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"), "root")


def _shingle_sets(df: DataFrame, key: str, text: str, texts: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``(cls, shingles)`` of the texts in ``pairs``, read from one row of each.
    A Bloom filter of fixed size saves shuffling the other rows; the join decides."""
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    keys = landed(texts.join(wanted, "cls", "left_semi").select("key", "rk").distinct(), "text-keys")
    ident = F.xxhash64("key", "rk")
    bloom = build_level(keys.select(ident.alias("key")), 0, 0, 0.5, n_bits=BLOOM_BITS)
    rows = df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("rk"), F.col(text).alias("text"))
    rows = null_safe(rows.where(passes(ident, 0, bloom))).join(null_safe(keys), ["_k", "_null", "rk"], "left_semi")
    out = landed(shingle_rows(rows.groupBy("_k", "_null", "rk").agg(F.first("text").alias("text")), size), "shingles")
    discard(keys)
    return out


def keep_one(df: DataFrame, key: str, text: str, size: int = 5, percent: int = 80) -> DataFrame:
    """``df``, same columns, with one document of each component: the one with
    the least key (nulls last), then text hash. Documents without words all
    stay; rows that repeat key and text are one."""
    found = _rooted(df, key, text, size, percent).withColumnRenamed(key, "key")
    # one group for each component, also of null keys only; texts without words by themselves
    group = F.when(F.col("cls").isNull(), F.struct(F.lit(1).alias("k"), F.xxhash64("key", "rk").alias("v"))).otherwise(
        F.struct(F.lit(0).alias("k"), F.col("root").alias("v")))
    kept = found.groupBy(group.alias("g")).agg(F.min(F.struct(
        F.col("key").isNull().alias("null"), "key", "rk")).alias("first")).select("first.key", "first.rk")
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    whole = df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("rk"), row.alias("row"))
    whole = null_safe(whole).groupBy("_k", "_null", "rk").agg(F.first("row").alias("row"))
    out = whole.join(null_safe(kept), ["_k", "_null", "rk"], "left_semi")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])
