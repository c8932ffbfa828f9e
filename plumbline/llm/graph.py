"""Classes of linked nodes from candidate buckets, without ever listing the pairs of a bucket.

Members of a bucket may be linked. First every bucket proposes its members against its smallest one
only; proposals are verified and their components formed. A bucket whose members now all belong to one
component has nothing more to tell. In the others, pairs from different components are found through
an R-tree over count vectors, block by block: first every member's most promising partner alone, which
joins most of what belongs together, then, between what is still apart, all of them. So no link between
components is missed, work within a component is linear, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Members of a bucket that meet in one task, per side.
BLOCK = 512
#: Points in a leaf of the R-tree.
LEAF = 16

_NONE = np.int64(-(1 << 63))


def live_members(members: DataFrame) -> DataFrame:
    """(key, node, center) of the buckets of (key, node) that hold two different nodes or more."""

    def runs(batches):
        last_key, center, last_node, told = None, None, None, True
        for batch in batches:
            key, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
            if not len(key):
                continue
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            new[0] = not (last_key == key[0] and last_node == node[0])
            key, node = key[new], node[new]
            if not len(key):
                continue
            head = np.ones(len(key), dtype=bool)
            head[1:] = key[1:] != key[:-1]
            follows = last_key == key[0]
            run = np.cumsum(head) - 1
            starts = np.flatnonzero(head)
            counts = np.diff(np.append(starts, len(key)))
            centers = node[starts]
            live = counts > 1
            if follows:
                centers[0], live[0] = center, True
            keep = live[run]
            out = [key[keep], node[keep], centers[run][keep]]
            if follows and not told:
                out = [np.append(a, b) for a, b in zip(out, (last_key, center, center))]
            last_key, last_node, center, told = key[-1], node[-1], centers[-1], bool(live[-1])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in out], ["key", "node", "center"])

    dealt = members.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(runs, "key long, node long, center long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); the root is the smallest node of its component.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to their ends by
    doubling, and goes on with the links between what is left.
    """
    nodes = None
    edges = written(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(),
        "edges",
    )
    while not edges.isEmpty():
        hooks = written(edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node"), "hooks")
        while True:
            over = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            jumped = hooks.join(over, "root", "left")
            hooks = written(
                jumped.select(
                    "node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
                ),
                "hooks",
            )
            if hooks.filter("moved").isEmpty():
                break
        hooks = hooks.select("node", "root")
        if nodes is None:
            nodes = edges.select(F.col("a").alias("node")).union(hooks.select("node")).distinct()
            nodes = nodes.join(hooks, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        else:
            over = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            nodes = nodes.join(over, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        nodes = written(nodes, "roots")
        moved = edges
        for side in ("a", "b"):
            over = hooks.select(F.col("node").alias(side), F.col("root").alias("to"))
            moved = moved.join(over, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        edges = written(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(),
            "edges",
        )
    if nodes is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most that multisets can share, from their uint8 counts by group along the last axis.

    Counts stop at 255. Where both have stopped, nothing is known and the bound is out of reach.
    """
    least = np.minimum(a, b)
    return np.where((least == 255).any(axis=-1), np.int64(1) << 40, least.sum(axis=-1, dtype=np.int64))


def rtree_pairs(points_a, sizes_a, points_b, sizes_b, need) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i, j) whose overlap can reach ``need(size, size)``, and by how much it can exceed it.

    The overlap of two multisets is at most the sum of the smaller of their counts, group by group. Both
    sides are packed into leaves by size and largest group; a leaf is bounded by its corner of maxima
    and its smallest size, and only leaves whose bound suffices are opened.
    """
    if not len(points_a) or not len(points_b):
        return (np.zeros(0, dtype=np.int64),) * 3

    def pack(points, sizes):
        order = np.lexsort((points.argmax(axis=1), sizes))
        starts = np.arange(0, len(order), LEAF)
        corner = np.maximum.reduceat(points[order], starts, axis=0)
        return order, starts, corner, np.minimum.reduceat(sizes[order], starts)

    order_a, starts_a, corner_a, least_a = pack(points_a, sizes_a)
    order_b, starts_b, corner_b, least_b = pack(points_b, sizes_b)
    left, right, over = [], [], []
    for leaf, start in enumerate(starts_a):
        bound = overlap_bound(corner_a[leaf], corner_b)
        opened = np.flatnonzero(bound >= need(least_a[leaf], least_b))
        if not len(opened):
            continue
        mine = order_a[start : start + LEAF]
        theirs = np.concatenate([order_b[starts_b[k] : starts_b[k] + LEAF] for k in opened])
        overlap = overlap_bound(points_a[mine][:, None, :], points_b[theirs][None, :, :])
        spare = overlap - need(sizes_a[mine][:, None], sizes_b[theirs][None, :])
        i, j = np.nonzero(spare >= 0)
        left.append(mine[i])
        right.append(theirs[j])
        over.append(spare[i, j])
    if not left:
        return (np.zeros(0, dtype=np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(over)


def _most_promising(a: np.ndarray, b: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that are the best of one of their two ends."""
    order = np.lexsort((b, a, -over))
    firsts = [order[np.unique(side[order], return_index=True)[1]] for side in (a, b)]
    return np.unique(np.concatenate(firsts))


def _open_pairs(members: DataFrame, points: DataFrame, groups: int, need: Callable, best: bool) -> DataFrame:
    """(a, b): pairs of different roots in the buckets of (key, node, center, root, n).

    With ``best``, only every member's most promising pair of each two blocks.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"))
    )
    # first the few points that are asked for, then one of each
    asked = points.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    dealt = (
        members.join(asked, "node")
        .select("key", "node", "center", "root", "size", "point", own.alias("own"), F.explode(pairs).alias("at"))
        .select("*", "at.i", "at.j")
        .drop("at")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )

    def join_group(group):
        node, root, size, own, point = group["node"], group["root"], group["size"], group["own"], group["point"]
        i, j = group["i"][0], group["j"][0]
        rows_a = np.flatnonzero(own == i)
        rows_b = rows_a if i == j else np.flatnonzero(own == j)
        x, y, over = rtree_pairs(point[rows_a], size[rows_a], point[rows_b], size[rows_b], need)
        a, b = rows_a[x], rows_b[y]
        center = group["center"][0]
        good = (root[a] != root[b]) & (node[a] != center) & (node[b] != center)
        if i == j:
            good &= node[a] < node[b]
        a, b = node[a][good], node[b][good]
        if best and len(a):
            chosen = _most_promising(a, b, over[good])
            a, b = a[chosen], b[chosen]
        return np.minimum(a, b), np.maximum(a, b)

    def join_groups(batches):
        held: dict[str, np.ndarray] = {}
        names = ("key", "i", "j", "node", "center", "root", "size", "own", "point")

        def flush(part):
            a, b = join_group(part)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names[:-1]}
            flat = np.frombuffer(b"".join(batch.column("point").to_pylist()), dtype=np.uint8)
            rows["point"] = flat.reshape(-1, groups)
            held = {c: np.concatenate([held[c], rows[c]]) for c in names} if held else rows
            change = (np.diff(held["key"]) != 0) | (np.diff(held["i"]) != 0) | (np.diff(held["j"]) != 0)
            ends = np.flatnonzero(change) + 1
            for start, end in zip(np.append(0, ends[:-1]), ends):
                yield from flush({c: held[c][start:end] for c in names})
            if len(ends):
                held = {c: held[c][ends[-1] :] for c in names}
        if held and len(held["key"]):
            yield from flush(held)

    return dealt.mapInArrow(join_groups, "a long, b long").distinct()


def linked_classes(
    members: DataFrame,
    points: DataFrame,
    groups: int,
    need: Callable,
    verify: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """(node, root) of all nodes that are linked with another.

    ``members`` (key, node): any two linked nodes share a key. ``points`` (node, size, point): a row per
    node or more, ``point`` being ``groups`` bytes, each a count that stops at 255. ``need(size, size)`` bounds the overlap
    of linked nodes from below and does not fall with the sizes. ``verify`` keeps the true ones of
    candidate pairs (a, b); it is told all nodes (node) that may come up, and is asked up to three times.
    """
    live = written(live_members(members), "live")
    size = F.col("size")
    star = live.filter("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    nodes = live.select("node").distinct()
    links = written(verify(written(star, "star"), nodes), "links")
    roots = components(links)
    points = points.select("node", size, "point")
    for best in (True, False):
        labelled = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_keys = (
            labelled.groupBy("key")
            .agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
            .filter("n > 2 AND low < high")
            .select("key", "n")
        )
        rest = written(labelled.join(open_keys, "key"), "open")
        if rest.isEmpty():
            return roots
        more = written(_open_pairs(rest, points, groups, need, best), "more")
        if more.isEmpty():
            return roots
        links = written(links.union(verify(more, nodes)), "links")
        roots = components(links)
    return roots
