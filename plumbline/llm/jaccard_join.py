"""Near-duplicate documents by the Jaccard similarity of their shingle sets, exactly.

A document's shingles are hashed into groups and the counts of the groups are its point. Two sets share
at most the sum of the smaller counts; an R-tree over the points applies that bound (``graph``).

Count vectors of unrelated texts lie close together, so corners of large leaves bound nothing. The top
of the index therefore does not cut by coordinates but by content, which loses nothing: sizes fall into
classes [0.85 * 2**j, 2**(j+1)), similar sets share a class, and in a class of m groups two similar sets
differ in fewer than m elements, so they agree in a whole group. (class, group, content of the group) is
the bucket that a document is filed under; the R-tree works inside a bucket.

Copies of a set are one node: a task files each set once. Sets that differ are verified in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bitmap import bitmap_of, maybe_in
from plumbline.llm.common import TEXT_BATCH, written
from plumbline.llm.graph import linked_classes, overlap_bound
from plumbline.llm.wordhash import NOT_SPACE, mix, ngrams, words_of

#: Groups of a point: enough that sets just below the threshold rarely pass the bound.
GROUPS = 256
#: 64-bit hashes of sets and shingles stand for them; two differing ones agree with odds of 2**-64.

_SMALL = np.uint64(0x51ED270B)


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of every row; fewer than k words are one shingle."""
    for words in words_of(column, NOT_SPACE):
        grams = ngrams(words.hashes, k)
        for r in range(words.rows):
            low, high = words.bounds[r], words.bounds[r + 1]
            if high - low >= k:
                yield words.first + r, np.unique(grams[low : high - k + 1])
            elif high > low:
                whole = ngrams(words.hashes[low:high], int(high - low)) ^ _SMALL
                yield words.first + r, mix(whole)
            else:
                yield words.first + r, np.zeros(0, dtype=np.uint64)


def most_difference(total: int, percent: int) -> int:
    """Largest symmetric difference of two sets with ``total`` elements together that link."""
    return total * (100 - percent) // (100 + percent)


def _filed_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The buckets of a set: per class of its size, one for each group of which it has elements.

    A class has a few groups more than two sets of it can differ in, so that a set with some empty
    groups still agrees with every similar set in one that is not empty. A set with too many empty
    groups is filed in the class's rest as well; two such sets meet there.
    """
    n, keys = len(hashes), []
    mixed = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    j = n.bit_length() - 1
    classes = [j, j + 1] if 100 * n >= percent * (2 << j) else [j]
    for c in classes:
        top = (2 << c) - 1
        most = most_difference(2 * top, percent)
        m = most + 3 + most // 32
        group = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(m, dtype=np.uint64)
        np.add.at(content, group, mixed)
        filled = np.flatnonzero(np.bincount(group, minlength=m))
        salt = np.uint64(c << 40) + filled.astype(np.uint64)
        keys.append(mix(content[filled] + mix(salt)))
        if len(filled) <= most_difference(n + min(top, 100 * n // percent), percent):
            keys.append(mix(np.array([(c << 40) + (1 << 39)], dtype=np.uint64)))
    return np.unique(np.concatenate(keys))


def _signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, node, size, point, keys): a row per document; keys once per node and task."""

    def sign(batches):
        seen: set[int] = set()
        for batch in batches:
            node, size, point, keys = [], [], [], []
            for _, hashes in shingle_sets(batch.column("text"), k):
                n = len(hashes)
                size.append(n)
                if not n:
                    node.append(None), point.append(None), keys.append(None)
                    continue
                total = mix(hashes + np.uint64(n)).sum(dtype=np.uint64)
                own = int(mix(np.array([total]))[0].astype(np.int64))
                node.append(own)
                if own in seen:
                    point.append(None), keys.append(None)
                    continue
                seen.add(own)
                counts = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
                point.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
                keys.append(_filed_keys(hashes, percent).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(node, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(point, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "node", "size", "point", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        sign, f"doc_id {kind}, node long, size long, point binary, keys array<long>"
    )


def _sets_of(docs: DataFrame, nodes: DataFrame, signed: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the given nodes, one document of each read again."""
    chosen = signed.filter("point IS NOT NULL").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    asked = F.xxhash64(F.col("doc_id"))
    wanted = bitmap_of(chosen.select(asked.alias("h")), "h")

    def sets(batches):
        for batch in batches:
            rows = np.flatnonzero(maybe_in(wanted, batch.column("h").to_numpy(zero_copy_only=False)))
            for start in range(0, len(rows), 256):
                part = batch.take(pa.array(rows[start : start + 256]))
                node, shingles = [], []
                for _, hashes in shingle_sets(part.column("text"), k):
                    n = len(hashes)
                    total = mix(hashes + np.uint64(n)).sum(dtype=np.uint64)
                    node.append(int(mix(np.array([total]))[0].astype(np.int64)) if n else None)
                    shingles.append(hashes.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(shingles, pa.list_(pa.int64()))], ["node", "shingles"]
                )

    found = docs.select("text", asked.alias("h")).mapInArrow(sets, "node long, shingles array<long>")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are what lies between ASCII white space, after lower-casing A-Z. Two documents link when their
    sets of k-word shingles overlap in ``percent`` of their union; fewer than k words are one shingle.
    A component's id is its smallest doc_id. A document without words has size 0, is linked with nothing
    and has its own id, as have null ids without links. Repeated rows are documents of their own and
    share a component through their equal sets. An empty table gives no rows; other columns are not
    looked at.
    """
    signed = written(_signatures(docs, k, percent), "signatures", TEXT_BATCH)
    members = signed.select("node", F.explode("keys").alias("key"))
    points = signed.filter("point IS NOT NULL").select("node", "size", "point")

    def need(a, b):
        return -(-(a + b) * percent // (100 + percent))

    def verify(pairs: DataFrame, _nodes: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        few = points.join(asked, "node", "left_semi").dropDuplicates(["node"])
        ends = [few.select(F.col("node").alias(c), F.col("size").alias(f"n_{c}"), F.col("point").alias(f"p_{c}")) for c in "ab"]
        bounded = pairs.join(ends[0], "a").join(ends[1], "b").mapInArrow(bound, "a long, b long")
        bounded = written(bounded, "bounded")
        nodes = bounded.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = written(_sets_of(docs, written(nodes, "nodes"), signed, k), "sets", TEXT_BATCH)
        ends = [sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab"]
        both = F.size(F.array_intersect("s_a", "s_b"))
        union = F.size("s_a") + F.size("s_b") - both
        return bounded.join(ends[0], "a").join(ends[1], "b").filter(100 * both >= percent * union).select("a", "b")

    def bound(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p_a, p_b = (
                np.frombuffer(b"".join(batch.column(f"p_{c}").to_pylist()), dtype=np.uint8).reshape(-1, GROUPS)
                for c in "ab"
            )
            n_a, n_b = (batch.column(f"n_{c}").to_numpy(zero_copy_only=False) for c in "ab")
            good = overlap_bound(p_a, p_b) >= need(n_a, n_b)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in "ab"], ["a", "b"])

    roots = linked_classes(members, points, GROUPS, need, verify)
    firsts = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "root").select("node", "component_id")
    return signed.select("doc_id", "node", "size").join(classes, "node", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
