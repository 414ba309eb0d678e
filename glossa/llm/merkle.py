"""Operator 12: a Merkle manifest of a data set, by source, with midstates.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group (a
source) stand in the order of the key; while there is more than one node, each
run of :data:`FAN` (the last may be shorter) becomes its parent, the SHA-256 of
the children's hex digests. The groups' roots, in the order of the groups (null
first, then by UTF-8 bytes), become the root in the same way.

A parent keeps a copy of its hash state before each child slot. To fold a
changed leaf to the root, each parent on its path resumes the state before the
child's slot with the replacement and the siblings to the right of it; what is
left of the slot is not hashed again.

Nodes are handled in chunks of :data:`CHUNK`, whole subtrees of three levels,
dealt by (tree, chunk): a round climbs three levels, so the table shrinks by
4,096 each time, and a group of any size is spread over its chunks. On the way
down a chunk gets, as one row, the siblings of its own path above it, and its
task rebuilds the states it retains; siblings are never repeated for each leaf.
Places come from a distributed sort. Steps are written to the shared folder.

Defined results: a null field is marked, other than any text; a null key comes
first in its group and ties are ordered by the leaf, so repeated rows are
leaves side by side; a group with one row has that leaf as its root, a single
group's root is the root; columns that are not named are ignored; no rows give
no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import landed
from glossa.operators.joins import bounded_broadcast
from glossa.operators.ranking import global_row_number

FAN, LEVELS = 16, 3
CHUNK = FAN ** LEVELS
_PATH = "lefts array<binary>, rights array<binary>, subroot binary, root binary"


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 (binary) of fields, each ``-`` if null, else its size in bytes, a colon and its text."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def _hex(digests) -> list[bytes]:
    return [d.hex().encode() for d in digests]


class Parent:
    """A node over its children's hex digests, with the hash state before each child slot."""

    def __init__(self, children: list[bytes]):
        self.children, self.states, state = children, [], hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def left(self, slot: int) -> bytes:
        return b"".join(self.children[:slot])

    def right(self, slot: int) -> bytes:
        return b"".join(self.children[slot + 1:])


def resumed(state, child: bytes, right: bytes) -> bytes:
    """The parent's digest with another child in the slot that the state stands before."""
    state = state.copy()
    state.update(child + right)
    return state.hexdigest().encode()


def parents_of(digests: list[bytes], n: int) -> list[list[Parent]]:
    """The levels above a chunk of nodes in a tree that has ``n`` nodes at this level: at most
    :data:`LEVELS`, none above a tree's root."""
    levels = []
    while n > 1 and len(levels) < LEVELS:
        levels.append([Parent(digests[i:i + FAN]) for i in range(0, len(digests), FAN)])
        digests, n = [p.digest for p in levels[-1]], -(-n // FAN)
    return levels


def _raised(key: tuple[pa.Scalar, ...], nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("at")
    n = nodes["n"][0].as_py()
    levels = parents_of(_hex(nodes["digest"].to_pylist()), n)
    top = levels[-1][0].digest.decode() if levels else nodes["digest"][0].as_py().hex()
    return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "at": pa.array([key[1].as_py()], pa.int64()),
                     "n": pa.array([-(-n // CHUNK)], pa.int64()), "digest": pa.array([bytes.fromhex(top)], pa.binary())})


def _above(levels: list[list[Parent]], place: int) -> list[tuple[Parent, int]]:
    """The parents of the node at a place of a chunk, with the slot of the path in each."""
    out = []
    for parents in levels:
        out.append((parents[place // FAN], place % FAN))
        place //= FAN
    return out


def _lowered(key: tuple[pa.Scalar, ...], nodes: pa.Table, paths: pa.Table) -> pa.Table:
    """The path of each node of a chunk: its own siblings, then those of the chunk's path."""
    nodes, path = nodes.sort_by("at"), paths.to_pylist()[0]
    levels = parents_of(_hex(nodes["digest"].to_pylist()), nodes["n"][0].as_py())
    up = [_above(levels, i) for i in range(len(nodes))]
    return pa.table({
        "tree": nodes["tree"], "at": nodes["at"],
        "lefts": pa.array([[p.left(s) for p, s in u] + path["lefts"] for u in up], pa.list_(pa.binary())),
        "rights": pa.array([[p.right(s) for p, s in u] + path["rights"] for u in up], pa.list_(pa.binary())),
        "subroot": pa.array([path["subroot"]] * len(up), pa.binary()),
        "root": pa.array([path["root"]] * len(up), pa.binary())})


def _folded(key: tuple[pa.Scalar, ...], leaves: pa.Table, paths: pa.Table) -> pa.Table:
    """Proof and folded root of each leaf of a chunk."""
    leaves, path = leaves.sort_by("at"), paths.to_pylist()[0]
    levels = parents_of(_hex(leaves["digest"].to_pylist()), leaves["n"][0].as_py())
    # the parents above the chunk keep the one state that all of its leaves resume
    upper = [(hashlib.sha256(left), right) for left, right in zip(path["lefts"], path["rights"])]
    beside = b"".join(x for pair in zip(path["lefts"], path["rights"]) for x in pair)
    proofs, roots = [], []
    for place, digest in enumerate(_hex(leaves["replacement"].to_pylist())):
        proof = hashlib.sha256()
        for parent, slot in _above(levels, place):
            right = parent.right(slot)
            proof.update(parent.left(slot) + right)
            digest = resumed(parent.states[slot], digest, right)
        proof.update(beside)
        for state, right in upper:
            digest = resumed(state, digest, right)
        proofs.append(proof.digest())
        roots.append(bytes.fromhex(digest.decode()))
    out = leaves.drop_columns(["tree", "at", "n", "replacement"]).rename_columns({"digest": "leaf"})
    for name, values in (("subroot", [path["subroot"]] * len(roots)), ("root", [path["root"]] * len(roots)),
                         ("proof", proofs), ("folded_root", roots)):
        out = out.append_column(name, pa.array(values, pa.binary()))
    return out


def _chunk() -> Column:
    return F.floor(F.col("at") / CHUNK).cast("long").alias("chunk")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(tree, at, n, digest)`` and what they climb to, up to one node a tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        now = rounds[-1].select("tree", "at", "n", "digest")
        rounds.append(landed(now.groupBy("tree", _chunk()).applyInArrow(
            _raised, "tree long, at long, n long, digest binary"), "merkle-nodes"))
    return rounds


def _paths(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the chunks of the first round, from the paths of the trees' roots: ``(tree, at, lefts, rights, ...)``."""
    for nodes in reversed(rounds[1:-1]):
        nodes = nodes.select("tree", "at", "n", "digest")
        paths = landed(nodes.groupBy("tree", _chunk()).cogroup(paths.groupBy("tree", "at")).applyInArrow(
            _lowered, f"tree long, at long, {_PATH}"), "merkle-paths")
    return paths


def placed_leaves(df: DataFrame, key: str, group: str, leaf: Column, replacement: Column) -> DataFrame:
    """``(key, tree, at, n, digest, replacement)``: trees numbered in the order
    of the groups, the leaf's place in its tree and the tree's number of leaves."""
    rows = landed(df.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), leaf.alias("digest"),
                            replacement.alias("replacement")), "merkle-leaves")
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("key"), F.asc("digest")]
    ranked = global_row_number(rows, order, "rn")
    groups = ranked.groupBy("grp").agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("n"))
    trees = global_row_number(groups, [F.col("first")], "tree").select(
        F.col("grp").alias("g"), "first", "n", (F.col("tree") - 1).alias("tree"))
    return ranked.join(bounded_broadcast(trees), F.col("grp").eqNullSafe(F.col("g"))).select(
        "key", "tree", (F.col("rn") - F.col("first")).alias("at"), "n", "digest", "replacement")


def manifest(df: DataFrame, key: str, group: str, leaf: Column, replacement: Column) -> DataFrame:
    """``(key, leaf, subroot, root, proof, folded_root)`` (binary) of each row.
    ``leaf`` and ``replacement`` are digests (:func:`leaf_of`): the row's when
    the manifest was made, and the one that is now to be checked against it;
    ``folded_root`` equals ``root`` if nothing has changed. ``proof`` is the
    SHA-256 of the hex digests beside the row's path, leaf to root."""
    spark: SparkSession = df.sparkSession
    leaves = landed(placed_leaves(df, key, group, leaf, replacement), "merkle-placed")
    low = _rounds(leaves)
    tops = low[-1].where("at = 0")
    n_trees = tops.count()
    # trees of one leaf are never raised: their root is the leaf
    subroots = landed(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"),
                                  F.lit(n_trees).cast("long").alias("n"), "digest"), "merkle-subroots")
    high = _rounds(subroots)
    last = high[-1].first()
    none = F.array().cast("array<binary>")
    root = F.lit(bytes(last["digest"]) if last else b"")
    start = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("at"),
                                  none.alias("lefts"), none.alias("rights"), root.alias("subroot"), root.alias("root"))
    of_chunks = _paths(high, start)
    of_trees = subroots.groupBy("tree", _chunk()).cogroup(of_chunks.groupBy("tree", "at")).applyInArrow(
        _lowered, f"tree long, at long, {_PATH}")
    of_trees = landed(of_trees.join(subroots.select("at", F.col("digest").alias("own")), "at").select(
        F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "lefts", "rights", F.col("own").alias("subroot"), "root"),
        "merkle-paths")
    of_chunks = _paths(low, of_trees)
    kind = df.schema[key].dataType.simpleString()
    out = leaves.groupBy("tree", _chunk()).cogroup(of_chunks.groupBy("tree", "at")).applyInArrow(
        _folded, f"key {kind}, leaf binary, subroot binary, root binary, proof binary, folded_root binary")
    return out.withColumnRenamed("key", key)
