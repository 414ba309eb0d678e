"""Operator 4: benchmark decontamination.

The benchmark's normalised word windows go into a hash set that is broadcast;
every document is scanned once, map-only, over its whole text. Words become
numbers of the benchmark's own word list; only stretches of known words as long
as a window are hashed (all at once, with numpy); a hash that is in the set is
then verified word by word. Hits are reported, or their spans or documents
removed.

The benchmark is measured before it is broadcast. Its tables take some 55 times
its text in memory, on the driver and in each worker, so that a part of
:data:`MAX_BROADCAST_BYTES` of text comes to about 220 MB. Above that it is dealt
by item into as many parts as it needs (a single item is not divided),
and the documents are scanned once per part, with the hits so far written to
the shared folder between the scans: the same result with bounded memory.

Words: ASCII letters lower-cased, then runs of digits, ASCII letters and any
character beyond ASCII. A window is ``size`` consecutive words of an item; an
item with fewer words, but not none, is one window.

Defined results: null text (document or item) has no words, and an item without
words no window; an item without id counts as item ''; repeated items count
once; every document row gives one row, repeated rows repeat; other columns are
ignored (or passed through, where documents or spans are removed); an empty
benchmark hits nothing; no documents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import landed, slices, text_bytes

WINDOW = 10
MAX_BROADCAST_BYTES = 4 << 20  # of benchmark text in a part; its tables take about 55 times that
_HIT_COLUMNS = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
# Every ASCII byte that is no word character becomes a blank, capitals small.
_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(words: list, size: int) -> list[tuple]:
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def window_hashes(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for k in range(length):
        out = out * _BASE + ids[starts + k].astype(np.uint64) + np.uint64(1)
    return out


def window_tables(items: list[tuple[str, bytes]], size: int) -> dict:
    """Plain data for the tasks: word numbers, and by window length the sorted
    hashes and the items of each window."""
    number: dict[bytes, int] = {}
    by_length: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        words = [number.setdefault(w, len(number)) for w in words_of(text)]
        for window in windows_of(words, size):
            by_length.setdefault(len(window), {}).setdefault(window, set()).add(item)
    hashes = {}
    for length, windows in by_length.items():
        flat = np.array(list(windows), np.int64).reshape(-1)
        hashes[length] = np.unique(window_hashes(flat, np.arange(0, len(flat), length), length))
    return {"number": number, "windows": by_length, "hashes": hashes}


def scan_texts(texts: list[bytes], tables: dict) -> tuple[list[int], dict[int, tuple[list, set]]]:
    """Words per text, and for the texts that are hit ``(spans, items)``:
    merged ``(first, last)`` word positions."""
    number = tables["number"]
    ids: list[int] = []
    bounds = [0]
    for text in texts:
        words = words_of(text)
        ids.extend([number.get(w, -1) for w in words])
        ids.append(-1)  # no window crosses from one text to the next
        bounds.append(len(ids))
    flat, edges = np.array(ids, np.int64), np.array(bounds)
    n_words = (np.diff(edges) - 1).tolist()
    known = np.concatenate([[0], np.cumsum(flat >= 0)])
    found: dict[int, tuple[list, set]] = {}
    for length, windows in tables["windows"].items():
        if len(flat) < length:
            continue
        starts = np.flatnonzero(known[length:] - known[:-length] == length)
        hashes = tables["hashes"][length]
        hashed = window_hashes(flat, starts, length)
        near = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
        for start in starts[hashes[near] == hashed].tolist():
            items = windows.get(tuple(ids[start:start + length]))
            if items:
                row = int(np.searchsorted(edges, start, side="right")) - 1
                spans, all_items = found.setdefault(row, ([], set()))
                spans.append((start - bounds[row], start - bounds[row] + length - 1))
                all_items.update(items)
    return n_words, {row: (merged(spans), items) for row, (spans, items) in found.items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word spans; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without its hit words and what stands between them."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, done = [], 0
    for first, last in spans:
        out.append(text[done:at[first][0]])
        done = at[last][1]
    return b"".join([*out, text[done:]])


def _parts(benchmark: DataFrame, item: str, text: str, max_bytes: int) -> list[DataFrame]:
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                            F.col(text).alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // max_bytes))
    if n == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _broadcast(part: DataFrame, size: int):
    items = [(r["item"], bytes(r["raw"])) for r in
             part.select("item", F.col("text").cast("binary").alias("raw")).distinct().collect()]
    return part.sparkSession.sparkContext.broadcast(window_tables(items, size))


def find_hits(df: DataFrame, key: str, text: str, benchmark: DataFrame, item: str = "item_id",
              item_text: str = "text", size: int = WINDOW, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``(key, n_words, spans, items)`` per row: merged spans of hit words by
    position (both ends included), and the items with occurring windows, sorted
    as strings."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    parts = _parts(benchmark, item, item_text, max_bytes)
    for i, part in enumerate(parts):
        tables = _broadcast(part, size)
        last = i == len(parts) - 1

        def run(batches: Iterator[pa.RecordBatch], tables=tables, first=i == 0, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = text_bytes(batch.column(1))
                for start, stop in slices(texts):
                    n_words, found = scan_texts(texts[start:stop].to_pylist(), tables.value)
                    part = batch.slice(start, stop - start)
                    if not first:  # hits of the parts before
                        for row, (spans, items) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(),
                                                                 strict=True)):
                            if spans:
                                now = found.get(row, ([], set()))
                                found[row] = (merged([(s["first"], s["last"]) for s in spans] + now[0]), now[1] | set(items))
                    spans = [[{"first": a, "last": b} for a, b in found[r][0]] if r in found else []
                             for r in range(len(n_words))]
                    items = [sorted(found[r][1]) if r in found else [] for r in range(len(n_words))]
                    columns = [part.column(0)] + ([] if last else [part.column(1)])
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                        ["key", *([] if last else ["text"]), "n_words", "spans", "items"])

        rows = rows.mapInArrow(run, f"key {kind}, " + ("" if last else "text string, ") + _HIT_COLUMNS)
        if not last:
            rows = landed(rows, "decontam")
    return rows.withColumnRenamed("key", key)


def remove(df: DataFrame, text: str, benchmark: DataFrame, what: str = "documents", item: str = "item_id",
           item_text: str = "text", size: int = WINDOW, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df``, same columns, without its contaminated ``documents``, or with the
    contaminated ``spans`` cut out of ``text``. (Cutting joins what stood on
    both sides, which may make a new window; it is not scanned again.)"""
    if what not in ("documents", "spans"):
        raise ValueError(f"what: {what}")
    at, schema = df.columns.index(text), df.schema
    parts = _parts(benchmark, item, item_text, max_bytes)
    for i, part in enumerate(parts):
        tables = _broadcast(part, size)

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = text_bytes(batch.column(at))
                for start, stop in slices(texts):
                    raw = texts[start:stop].to_pylist()
                    _, found = scan_texts(raw, tables.value)
                    part = batch.slice(start, stop - start)
                    if found and what == "documents":
                        part = part.filter(pa.array([r not in found for r in range(len(raw))]))
                    elif found:
                        null = part.column(at).is_null().to_pylist()
                        new = [None if null[r] else (without_spans(x, found[r][0]) if r in found else x).decode()
                               for r, x in enumerate(raw)]
                        part = part.set_column(at, part.schema.field(at), pa.array(new, part.column(at).type))
                    yield part

        df = df.mapInArrow(run, schema)
        if i < len(parts) - 1:
            df = landed(df, "decontam")
    return df
