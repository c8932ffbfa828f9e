"""Sharding by a k-d tree over document metadata.

A node that shall give k shards is split where its bytes divide as floor(k/2) to ceil(k/2), along the
dimension that is widest in it. The weighted median is found by exact sums over ever finer bins of the
split order, all nodes of a level at once; no approximate quantile decides. The driver holds the tree,
one split per shard, and per node the sums of at most ``BINS`` bins.

The split order is (coordinate, text, row): rows of equal coordinate are told apart by a hash of the
text and then of the id, so a hot source is divisible. Equal texts have one place: copies with other
metadata take the smallest coordinates of their group. Cuts fall between the groups of a text; only a
group that is larger than a shard is cut inside, by id.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import with_positions, written

#: Bins of a node in one pass, as a power of two.
BIN_BITS = 10
#: Bits of a coordinate, of the text's hash and of the row's hash in the split order.
AXIS_BITS, TEXT_BITS, ROW_BITS = 24, 20, 18
KEY_BITS = AXIS_BITS + TEXT_BITS + ROW_BITS
#: A cut is good enough when its bin holds at most this part of a shard.
CLOSE = 1 / 2000

#: Rows of the coordinates of a group of copies in their join, so that a text of very many copies is spread.
PIECES = 16

BYTES_OF_ROW = 16


@dataclass
class Node:
    """A split: keys of ``axis`` below ``cut`` go to ``low``. A leaf holds ``shards`` from ``first`` on."""

    shards: int
    first: int
    axis: int = 0
    cut: int = 0
    low: int | None = None
    high: int | None = None


def document_size(text: Column = None) -> Column:
    text = F.col("text") if text is None else text
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(BYTES_OF_ROW)).cast("long")


def _axis(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.lit((1 << AXIS_BITS) - 1)).cast("long")


def document_axes(docs: DataFrame) -> dict[str, Column]:
    """Coordinates of the documents table: size on a log scale, source and language by hash.

    A column that is missing has no axis; nulls share one coordinate.
    """
    scale = (1 << AXIS_BITS) / 40.0
    axes = {"size": _axis(F.log2(document_size().cast("double")) * F.lit(scale))}
    for name in ("source", "lang"):
        if name in docs.columns:
            hashed = F.shiftrightunsigned(F.xxhash64(F.col(name).cast("string")), 64 - AXIS_BITS)
            axes[name] = F.when(F.col(name).isNull(), F.lit(0)).otherwise(hashed).cast("long")
    return axes


def _nodes(tree: list[Node], depth: int, keys: np.ndarray) -> np.ndarray:
    """The leaf of every point; ``keys`` has a row of split keys per axis."""
    axis, cut = np.array([n.axis for n in tree]), np.array([n.cut for n in tree])
    low = np.array([i if n.low is None else n.low for i, n in enumerate(tree)])
    high = np.array([i if n.high is None else n.high for i, n in enumerate(tree)])
    node, every = np.zeros(keys.shape[1], dtype=np.int64), np.arange(keys.shape[1])
    for _ in range(depth):
        node = np.where(keys[axis[node], every] < cut[node], low[node], high[node])
    return node


def _keys(batch: pa.RecordBatch, axes: int) -> np.ndarray:
    tie = batch.column("tie").to_numpy(zero_copy_only=False)
    return np.stack(
        [(batch.column(f"axis{a}").to_numpy(zero_copy_only=False) << (TEXT_BITS + ROW_BITS)) + tie for a in range(axes)]
    )


def _sums(points: DataFrame, tree: list[Node], depth: int, axes: int, place) -> dict[int, list[tuple]]:
    """Bytes by (node, bin) as node -> [(bin, bytes)]; ``place(node, keys)`` gives bins, -1 for none.

    Tasks add up their batches, so the shuffle carries a row per node, bin and batch.
    """

    def add(batches):
        for batch in batches:
            keys = _keys(batch, axes)
            node = _nodes(tree, depth, keys)
            frame = pd.DataFrame({"node": node, "bin": place(node, keys), "size": batch.column("size").to_pandas()})
            sums = frame[frame["bin"] >= 0].groupby(["node", "bin"], as_index=False)["size"].sum()
            yield pa.RecordBatch.from_pandas(sums, preserve_index=False)

    found = points.mapInArrow(add, "node long, bin long, size long")
    out: dict[int, list[tuple]] = {}
    for node, b, size in found.groupBy("node", "bin").agg(F.sum("size")).collect():
        out.setdefault(node, []).append((b, size))
    return {node: sorted(bins) for node, bins in out.items()}


def _extents(points: DataFrame, tree: list[Node], depth: int, axes: int) -> dict[int, list[tuple[int, int]]]:
    """Smallest and largest coordinate of every leaf along every axis."""
    names = [f"axis{a}" for a in range(axes)]

    def ends(batches):
        for batch in batches:
            frame = pd.DataFrame({n: batch.column(n).to_pandas() for n in names})
            frame["node"] = _nodes(tree, depth, _keys(batch, axes))
            both = frame.groupby("node")[names].agg(["min", "max"]).reset_index()
            both.columns = ["node", *(f"{n}_{e}" for n in names for e in ("min", "max"))]
            yield pa.RecordBatch.from_pandas(both, preserve_index=False)

    schema = "node long, " + ", ".join(f"{n}_min long, {n}_max long" for n in names)
    found = points.mapInArrow(ends, schema).groupBy("node")
    rows = found.agg(*(f(f"{n}_{f.__name__}").alias(f"{n}_{f.__name__}") for n in names for f in (F.min, F.max)))
    return {r[0]: [(r[1 + 2 * a], r[2 + 2 * a]) for a in range(axes)] for r in rows.collect()}


def build_tree(points: DataFrame, shards: int, axes: int) -> tuple[list[Node], int]:
    """The nodes and the depth. ``points``: size, tie below 2**(TEXT_BITS + ROW_BITS), axis0, axis1, ..."""
    tree, depth = [Node(shards, 0)], 0
    spans: list[int] = []
    while open_nodes := [i for i, n in enumerate(tree) if n.low is None and n.shards > 1]:
        extents = _extents(points, tree, depth, axes)
        if not spans:
            spans = [max(1, high - low) for low, high in extents.get(0, [(0, 0)] * axes)]
        for i in open_nodes:
            wide = [(high - low) / span for (low, high), span in zip(extents.get(i, [(0, 0)]), spans)]
            tree[i].axis = wide.index(max(wide))
        _find_cuts(points, tree, depth, axes, set(open_nodes))
        for i in open_nodes:
            n, half = tree[i], tree[i].shards // 2
            n.low, n.high = len(tree), len(tree) + 1
            tree += [Node(half, n.first), Node(n.shards - half, n.first + half)]
        depth += 1
    return tree, depth


def _find_cuts(points: DataFrame, tree: list[Node], depth: int, axes: int, todo: set[int]) -> None:
    """Sets the cuts of the nodes in ``todo``: pass by pass, the range in which a goal lies narrows."""
    start, bits = np.zeros(len(tree), dtype=np.int64), np.full(len(tree), KEY_BITS)
    before, goals, shard = [0] * len(tree), {}, {}
    while todo:
        axis = np.array([n.axis for n in tree])
        # bins are not finer than the groups of a text, until a group is to be cut
        shift = np.maximum(np.where(bits > ROW_BITS, ROW_BITS, 0), bits - BIN_BITS)
        active = np.isin(np.arange(len(tree)), list(todo))

        def place(node, keys, axis=axis, shift=shift, active=active):
            offset = keys[axis[node], np.arange(len(node))] - start[node]
            inside = active[node] & (offset >= 0) & (offset >> bits[node] == 0)
            return np.where(inside, offset >> shift[node], -1)

        sums = _sums(points, tree, depth, axes, place)
        for i in list(todo):
            places = sums.get(i, [])
            if i not in goals:
                total, n = sum(size for _, size in places), tree[i]
                goals[i], shard[i] = total * (n.shards // 2) / n.shards, total / n.shards
            if not places:
                todo.discard(i)
                continue
            ahead = [before[i]]
            for _, size in places:
                ahead.append(ahead[-1] + size)
            k = max(0, min(bisect.bisect_right(ahead, goals[i]), len(places)) - 1)
            b, size = places[k]
            whole = shift[i] == ROW_BITS and size <= shard[i]
            if shift[i] == 0 or whole or size <= CLOSE * shard[i]:
                nearer = goals[i] - ahead[k] <= ahead[k + 1] - goals[i]
                tree[i].cut = int(start[i]) + ((b if nearer else b + 1) << int(shift[i]))
                todo.discard(i)
            else:
                start[i], bits[i], before[i] = start[i] + (b << int(shift[i])), shift[i], ahead[k]


def _with_shard(points: DataFrame, tree: list[Node], depth: int, axes: int) -> DataFrame:
    first = np.array([n.first for n in tree], dtype=np.int32)

    def place(batches):
        for batch in batches:
            shard = first[_nodes(tree, depth, _keys(batch, axes))]
            kept = [batch.column(n) for n in ("doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(shard)], ["doc_id", "size", "text_crc32", "shard"])

    kind = points.schema["doc_id"].dataType.simpleString()
    return points.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, shard int")


def _one_place_per_text(points: DataFrame, axes: int) -> DataFrame:
    """Gives copies whose coordinates differ the smallest of their group."""
    names = [f"axis{a}" for a in range(axes)]
    ends = [f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]
    differ = " OR ".join(f"min_{n} < max_{n}" for n in names)
    groups = points.groupBy("digest").agg(*ends).filter(differ)
    spread = groups.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    dealt = points.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).cast("int"))
    return dealt.join(spread, ["digest", "piece"], "left").select(
        "doc_id", "size", "text_crc32", "tie", *(F.coalesce(f"min_{n}", n).alias(n) for n in names)
    )


def shard_documents(docs: DataFrame, shards: int, axes: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 16; a null text has none, and its CRC is 0. Shards hold
    nearly equal bytes, as far as documents and groups of equal texts allow: a group is in one shard unless
    it is larger than one. ``slot`` numbers the rows of a shard from 0 by doc_id (nulls first, repeated
    ids in any order). ``axes`` gives other coordinates, each a long in [0, 2**24). An empty table
    gives no rows; with fewer rows than shards, some shards stay empty.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    axes = axes or document_axes(docs)
    text_hash = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 64 - TEXT_BITS)
    row_hash = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(1)), 64 - ROW_BITS)
    read = written(
        docs.select(
            "doc_id",
            F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"),
            document_size().alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            (F.shiftleft(text_hash, ROW_BITS) + row_hash).alias("tie"),
            *(value.alias(f"axis{a}") for a, value in enumerate(axes.values())),
        ),
        "shard-rows",
    )
    points = written(_one_place_per_text(read, len(axes)), "shard-points")
    tree, depth = build_tree(points, shards, len(axes))
    placed = _with_shard(points, tree, depth, len(axes))
    placed = with_positions(placed, ["shard", "doc_id"], "shard-slots")
    first = placed.groupBy("shard").agg(F.min("position").alias("first_position"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("position") - F.col("first_position")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
