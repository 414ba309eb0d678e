"""Operator 11: how far the sources of a language differ in their words.

Text goes through Arrow's own kernels inside ``mapInArrow``: ``ascii_lower``,
``split_pattern_regex`` at whatever is no letter, ``dictionary_encode``, and two
hash ``group_by``: occurrences of a term in a document, then of a term in a
(language, source) group and the documents that hold it. A task merges the
counts of its batches and sends them on when they reach :data:`EMIT_ROWS`.
Spark adds the partial counts, one row for each language, source and term, and
keeps the terms found in at least ``min_docs`` documents of a language.

A kept term's smoothed share in a group or language with ``n`` occurrences of
kept terms, of ``v`` kept terms, is ``1 + floor(SCALE * (count + PRIOR) /
(n + PRIOR * v))``, in whole numbers throughout. Two sources diverge by the sum
of the differences of their shares over all kept terms of the language. The
kept counts are dealt into columnar shards by (language, hash of the term), as
many a language as it needs for :data:`SHARD_ROWS` rows each; a shard is a
terms x sources matrix that gives partial sums of all pairs of sources, and
those are added up. No group is in one task as a whole: a shard and the
sources of one language (whose pairs are the result) are the largest units.

Defined results: null text, language or source counts as empty (empty names are
a language or source of their own); every row is a document, so repeated rows
count again; a group without a term is a group with zero counts; a language
without kept terms has pairs of value 0; ties are ordered by the item's UTF-8
bytes; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import discard, landed, slices, text_bytes
from glossa.operators.joins import bounded_broadcast

# Whatever separates terms: every ASCII character but letters (texts are in lower case by then).
SEPARATORS = r"[\x00-\x60\x7B-\x7F]+"
SCALE, PRIOR = 1_000_000_000, 5
EMIT_ROWS = 1 << 19
SHARD_ROWS = 1 << 15
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
                      ("docs", pa.int64())])


def _count(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Counts of one slice of rows; a group's own row has the empty term and its documents."""
    parts = pc.split_pattern_regex(pc.ascii_lower(text), SEPARATORS)
    words, row = parts.flatten(), pc.list_parent_indices(parts)
    found = pc.not_equal(words, "")
    terms = words.filter(found).dictionary_encode()
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    n_sources = pa.scalar(len(sources.dictionary), pa.int64())
    group = pc.add(pc.multiply(langs.indices.cast(pa.int64()), n_sources), sources.indices.cast(pa.int64()))

    said = pa.table({"row": row.filter(found), "term": terms.indices}).group_by(["row", "term"]).aggregate(
        [([], "count_all")])
    by_group = pa.table({"group": group.take(said["row"]), "term": said["term"], "n": said["count_all"]}).group_by(
        ["group", "term"]).aggregate([("n", "sum"), ("n", "count")])
    seen = pa.table({"group": group}).group_by("group").aggregate([([], "count_all")])

    def named(groups, term, n, docs) -> pa.Table:
        return pa.table([langs.dictionary.take(pc.divide(groups, n_sources)),
                         sources.dictionary.take(pc.subtract(groups, pc.multiply(pc.divide(groups, n_sources), n_sources))),
                         term, n, docs], schema=_COUNTED)

    empty = pa.array([""] * len(seen), pa.string())
    return pa.concat_tables([
        named(by_group["group"], terms.dictionary.take(by_group["term"]), by_group["n_sum"], by_group["n_count"]),
        named(seen["group"], empty, pa.array(np.zeros(len(seen), np.int64)), seen["count_all"])])


def _merged(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables)
    added = whole.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return added.rename_columns(["lang", "source", "term", "n", "docs"]).select(_COUNTED.names).cast(_COUNTED)


def partial_counts(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """``(lang, source, term, n, docs)`` of parts of the rows: occurrences of a
    term and documents that hold it. The empty term counts all documents."""
    empty = F.lit("")
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n)
                       for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            names, sources, texts = (batch.column(i) for i in range(3))
            for a, b in slices(text_bytes(texts)):
                held.append(_count(names.slice(a, b - a), sources.slice(a, b - a), texts.slice(a, b - a)))
                if sum(map(len, held[1:])) > EMIT_ROWS:
                    held = [_merged(held)]
                    if len(held[0]) > EMIT_ROWS:
                        yield from held.pop().to_batches(max_chunksize=1 << 16)
        if held:
            yield from _merged(held).to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: Column, n: Column, v: Column) -> Column:
    """A smoothed share in whole numbers; decimals hold counts beyond 2^63 / SCALE."""
    wide = "decimal(20,0)"
    whole = F.call_function("div", (count + PRIOR).cast(wide) * F.lit(SCALE).cast("decimal(10,0)"), (n + PRIOR * v).cast(wide))
    return F.when(v > 0, whole + 1)


def _kept(counts: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, term, source, n, n_lang, first)`` of terms in enough documents
    of the language; ``first`` marks one row of each term."""
    term = Window.partitionBy("lang", "term")
    rows = counts.where("term <> ''").select(
        "lang", "term", "source", "n", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("n_lang"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    return rows.where(F.col("df") >= min_docs).drop("df")


def _groups(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, ix, n_all, n_lang_all, v, absent, shards)``, one row a
    group: its place among the language's sources, occurrences of kept terms in
    it and in the language, kept terms, share of a term that is absent."""
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang_all"), F.sum(F.col("first").cast("long")).alias("v"),
                                     F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    zero = F.lit(0).cast("long")
    out = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    out = out.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("ix"),
                     *[F.coalesce(c, zero).alias(c) for c in ("n_all", "n_lang_all", "v")],
                     F.coalesce("shards", F.lit(1)).alias("shards"))
    return out.withColumn("absent", _share(zero, F.col("n_all"), F.col("v")))


def _differences(key: tuple[pa.Scalar, ...], rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial sums of one shard: for sources i < j the differences of their shares over its terms."""
    ix = groups["ix"].to_numpy()
    n = len(ix)
    sums = np.zeros((n, n), np.int64)
    if len(rows):
        absent = np.zeros(n, np.int64)
        absent[ix] = groups["absent"].to_numpy()
        term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(term, kind="stable")
        term, at, share = term[order], rows["ix"].to_numpy()[order], rows["share"].to_numpy()[order]
        step = max(1, (1 << 20) // n)  # terms held at once as a matrix
        for first in range(0, int(term[-1]) + 1, step):
            a, b = np.searchsorted(term, [first, first + step])
            matrix = np.repeat(absent[None, :], min(step, int(term[-1]) + 1 - first), axis=0)
            matrix[term[a:b] - first, at[a:b]] = share[a:b]
            for i in range(n - 1):
                sums[i, i + 1:] += np.abs(matrix[:, i + 1:] - matrix[:, i:i + 1]).sum(axis=0)
    i, j = np.triu_indices(n, 1)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(i), pa.string()), "i": pa.array(i, pa.int32()),
                     "j": pa.array(j, pa.int32()), "value": pa.array(sums[i, j], pa.int64())})


def _pairs(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of all ordered pairs of sources of a language."""
    rows = shared.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "term", "ix", "share")
    sides = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "ix", "absent")
    sums = rows.groupBy("lang", "shard").cogroup(sides.groupBy("lang", "shard")).applyInArrow(
        _differences, "lang string, i int, j int, value long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    names = groups.select("lang", "source", "ix")
    return (both.join(names.withColumnRenamed("ix", "i"), ["lang", "i"])
            .join(names.select("lang", F.col("source").alias("item"), F.col("ix").alias("j")), ["lang", "j"])
            .select("lang", "source", "item", "value"))


def audit(df: DataFrame, lang: str, source: str, text: str, min_docs: int = 30, top: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each group of a language
    and a source, part ``pair`` has every other source of the language by
    divergence, part ``term`` the ``top`` kept terms by how much larger their
    share is there than in the language."""
    counts = landed(partial_counts(df, lang, source, text).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = landed(_kept(counts, min_docs), "kept-terms")
    groups = landed(_groups(counts, kept), "groups")
    discard(counts)
    shared = kept.join(bounded_broadcast(groups), ["lang", "source"]).select(
        "lang", "source", "term", "ix", "shards", _share(F.col("n"), F.col("n_all"), F.col("v")).alias("share"),
        _share(F.col("n_lang"), F.col("n_lang_all"), F.col("v")).alias("whole"), "n")
    over = shared.where("n > 0 AND share > whole").select(
        "lang", "source", F.col("term").alias("item"), (F.col("share") - F.col("whole")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = _pairs(shared, groups).withColumn("rank", F.row_number().over(best))
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")
