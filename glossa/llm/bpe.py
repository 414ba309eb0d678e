"""Operator 2: byte-level BPE encoding and decoding.

Two tiers. Tier one is a minimal perfect hash over the vocabulary: a pre-token
that is a vocabulary entry is one probe and one byte comparison. Tier two
merges the bytes of a pre-token that is not an entry: a heap holds the
mergeable neighbours by rank, and the bytes are a linked list, so each merge is
O(log n) however long the pre-token is.

The vocabulary (a rank file; its path is a parameter) is read by the driver and
broadcast; its size is bounded by :data:`MAX_VOCAB_BYTES` and checked. Texts
never move between tasks: encoding and decoding are map-only.

Defined results: null text counts as empty (no ids, empty bytes); every row
gives one row, repeated rows repeat; any other column, whatever its name, is
ignored; a table without rows gives none.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.common import slices, text_bytes

MAX_VOCAB_BYTES = 64 << 20
# Pre-tokens a worker remembers with their ids; beyond it the memory restarts.
MEMO_ENTRIES = 600_000
MEMO_LONGEST = 48
_STEP, _SPREAD, _ALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from a rank file (one base64 token and id a line)."""
    if os.path.getsize(path) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes, the most that is broadcast")
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def build_perfect_hash(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(displacement by bucket, key index by slot)``: as many slots as keys.

    Keys fall into buckets of about three. Large buckets first, each looks for a
    displacement that puts all its keys into free slots; a bucket with one key
    names a free slot directly (as ``-slot - 1``)."""
    n = len(keys)
    buckets: list[list[int]] = [[] for _ in range(max(1, n // 3))]
    hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
    for i, h in enumerate(hashes):
        buckets[h % len(buckets)].append(i)
    displacement, slot_key = np.zeros(len(buckets), np.int64), np.full(n, -1, np.int64)
    order = sorted(range(len(buckets)), key=lambda b: (-len(buckets[b]), b))
    for b in order:
        members = buckets[b]
        if len(members) < 2:
            break
        d = 0
        while True:
            slots = [slot_of(hashes[i], d, n) for i in members]
            if len(set(slots)) == len(slots) and all(slot_key[s] < 0 for s in slots):
                break
            d += 1
        displacement[b] = d
        slot_key[slots] = members
    free = iter(np.flatnonzero(slot_key < 0).tolist())
    for b in order:
        if len(buckets[b]) == 1:
            slot = next(free)
            displacement[b], slot_key[slot] = -slot - 1, buckets[b][0]
    return displacement, slot_key


def slot_of(h: int, d: int, n: int) -> int:
    return (((h ^ (d * _STEP)) * _SPREAD & _ALL) >> 20) % n


def resolver(codec: dict) -> Callable[[bytes], int | None]:
    """Vocabulary id of a byte string, or None: one probe of the perfect hash."""
    displacement, slot_bytes, slot_id = codec["displacement"], codec["slot_bytes"], codec["slot_id"]
    n_buckets, n, digest = len(displacement), len(slot_bytes), xxhash.xxh3_64_intdigest

    def resolve(token: bytes) -> int | None:
        h = digest(token)
        d = displacement[h % n_buckets]
        slot = -d - 1 if d < 0 else slot_of(h, d, n)
        return slot_id[slot] if slot_bytes[slot] == token else None

    return resolve


def merge_bytes(piece: bytes, resolve: Callable[[bytes], int | None]) -> list[int]:
    """Ids of a pre-token that is not in the vocabulary; ``resolve`` gives the
    rank of two neighbours joined.

    ``end[i]`` is where the part starting at ``i`` ends (0: merged away), which
    is also where its right neighbour starts; ``left[i]`` starts its left one."""
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n))
    heap = []
    for i in range(n - 1):
        rank = resolve(piece[i:i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], end[j], left[stop] = stop, 0, i
        before = left[i]
        if before >= 0:
            rank = resolve(piece[before:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, before, stop))
        if stop < n:
            rank = resolve(piece[i:end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
    out, i = [], 0
    while i < n:
        out.append(resolve(piece[i:end[i]]))
        i = end[i]
    return out


def codec_of(ranks: dict[bytes, int]) -> dict:
    """What tasks need, as plain data: the perfect hash, and the ranks of merges."""
    keys = list(ranks)
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"single bytes without an id: {missing[:5]}")
    displacement, slot_key = build_perfect_hash(keys)
    by_slot = [keys[i] for i in slot_key]
    return {"displacement": displacement.tolist(), "slot_bytes": by_slot, "slot_id": [ranks[k] for k in by_slot],
            "ranks": ranks}


class PieceMemo(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, resolve, ranks):
        super().__init__()
        self.resolve, self.rank = resolve, ranks.get

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.resolve(raw)
        ids = [whole] if whole is not None else merge_bytes(raw, self.rank)
        packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= MEMO_LONGEST:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = packed
        return packed


def encode(df: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """``(key, n_tokens long, ids binary)``: ids as little-endian unsigned
    32-bit integers, each match of ``pattern`` encoded by itself."""
    codec = df.sparkSession.sparkContext.broadcast(codec_of(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        known = codec.value
        memo = known.get("memo")
        if memo is None:  # kept with the broadcast value: later tasks of this worker go on with it
            memo = known["memo"] = PieceMemo(resolver(known), known["ranks"])
        find, get = regex.compile(pattern).findall, memo.__getitem__
        for batch in batches:
            keys, texts = batch.column(0), text_bytes(batch.column(1))
            for start, stop in slices(texts):
                ids = [b"".join(map(get, find(t.decode()))) for t in texts[start:stop].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [keys[start:stop], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["key", "n_tokens", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_tokens long, ids binary")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str, into: str, ranks_path: str) -> DataFrame:
    """``df`` with the bytes that its packed ids stand for, in column ``into``."""
    table = df.sparkSession.sparkContext.broadcast({i: k for k, i in read_ranks(ranks_path).items()})
    at = df.columns.index(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.__getitem__
        for batch in batches:
            packed = text_bytes(batch.column(at))
            for start, stop in slices(packed):
                out = [b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in packed[start:stop].to_pylist()]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names)

    return df.mapInArrow(run, schema)
