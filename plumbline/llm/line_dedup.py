"""Duplicate and near-duplicate lines by a segment-partition edit join.

A line of length l is cut into threshold + 1 segments; a line within the threshold of it holds one of
them unchanged, at a place that the lengths and the number of the segment narrow to a few. Lines file
their segments under (length, number, content) and probe with their own substrings under the lengths
they may match. Lines that meet are verified by banded bit-parallel edit distance (``graph`` decides
which pairs, so that a segment shared by very many lines is not paired out).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bitmap import bitmap_of, maybe_in
from plumbline.llm.common import TEXT_BATCH, written
from plumbline.llm.graph import linked_classes
from plumbline.llm.wordhash import SLICE, hash_pieces, inverse_powers, mix, prefix_sums

#: Groups that the characters of a line are counted in.
GROUPS = 32
#: Cells of code points that are compared at a time.
CELLS = 1 << 21

_FEED = 10


def line_slices(texts: list[str | None]):
    """(lines per text, code points, line starts, line ends) of some texts at a time.

    A text of k line feeds has k + 1 lines; a null text is empty and has one empty line.
    """
    first = 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end] or "") < SLICE):
            size += len(texts[end] or "") + 1
            end += 1
        part = [t or "" for t in texts[first:end]]
        points = np.frombuffer("\n".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.append(np.flatnonzero(points == _FEED), len(points))
        yield np.array([t.count("\n") + 1 for t in part]), points, np.append(0, ends[:-1] + 1), ends
        first = end


def segments(length: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of ``count`` even segments, the longer ones last."""
    size, longer = length // count, length % count
    out, start = [], np.zeros_like(length)
    for i in range(count):
        own = size + (i >= count - longer)
        out.append((start, own))
        start = start + own
    return out


def line_keys(points: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: int, least: int):
    """(line numbers, keys): the buckets that lines are filed under and probe."""
    n, lines, keys = len(points), [], []
    length = end - start
    every = np.arange(len(length))

    def add(rows, begin, size, of_length, i):
        if len(rows):
            salt = (of_length * (threshold + 1) + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            content = hashes(start[rows] + begin, start[rows] + begin + size)
            lines.append(rows)
            keys.append(mix(content + mix(salt)))

    hashes = _hasher(points, n)
    for back in range(threshold + 1):
        other = length - back
        able = other >= least
        for i, (begin, size) in enumerate(segments(np.maximum(other, 1), threshold + 1)):
            low = np.maximum.reduce([begin - i, begin + back - (threshold - i), np.zeros_like(begin)])
            high = np.minimum.reduce([begin + i, begin + back + (threshold - i), length - size])
            for shift in range(-threshold, threshold + 1):
                place = begin + shift
                rows = every[able & (place >= low) & (place <= high)]
                add(rows, place[rows], size[rows], other[rows], i)
    if not lines:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(lines), np.concatenate(keys)


def _hasher(points: np.ndarray, n: int):
    sums = prefix_sums(points)
    inverse = inverse_powers(n + 1)
    return lambda a, b: mix((sums[b] - sums[a]) * inverse[a])


def close_pairs(left: list[str], right: list[str], threshold: int) -> np.ndarray:
    """Which pairs are within ``threshold`` edits (insert, delete, replace of a code point).

    Hyyrö's banded bit vectors, one 64-bit word per pair and all pairs of a chunk together. The word
    moves down the diagonal: its top bit is row i + threshold in column i. Needs threshold < 31 and texts
    longer than the threshold.
    """
    size_a, size_b = (np.array([len(t) for t in side], dtype=np.int64) for side in (left, right))
    good = np.zeros(len(left), dtype=bool)
    able = np.flatnonzero(np.abs(size_a - size_b) <= threshold)
    able = able[np.argsort(size_b[able], kind="stable")]
    at = 0
    while at < len(able):
        rows = max(1, min(len(able) - at, CELLS // int(size_b[able[at]] + 1)))
        while rows > 1 and rows * int(size_b[able[at + rows - 1]]) > 2 * CELLS:
            rows //= 2
        chosen = able[at : at + rows]
        at += rows
        a = _padded([left[k] for k in chosen], threshold, 0xFFFFFFFF)
        b = _padded([right[k] for k in chosen], 0, 0xFFFFFFFE)
        good[chosen] = _banded(a, size_a[chosen], b, size_b[chosen], threshold) <= threshold
    return good


def _padded(texts: list[str], margin: int, fill: int) -> np.ndarray:
    """A column per text of its code points, with ``margin`` rows of ``fill`` around."""
    width = max(map(len, texts)) + 2 * margin
    out = np.full((len(texts), width), fill, dtype=np.uint32)
    for row, text in zip(out, texts):
        row[margin : margin + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.ascontiguousarray(out.T)


def _banded(a, size_a, b, size_b, k: int) -> np.ndarray:
    one, top = np.uint64(1), np.uint64(63)
    plus = np.full(a.shape[1], ((1 << (k + 1)) - 1) << (63 - k), dtype=np.uint64)
    minus = np.zeros_like(plus)
    distance = np.full(a.shape[1], k, dtype=np.int64)
    for i in range(b.shape[0]):
        equal = np.zeros_like(plus)
        for back in range(2 * k + 1):  # row i + k - back; rows of ``a`` are shifted by the margin k
            row = i + 2 * k - back
            if row < a.shape[0]:
                equal |= (a[row] == b[i]).astype(np.uint64) << (top - np.uint64(back))
        zero = (((equal & plus) + plus) ^ plus) | equal | minus
        up, down = minus | ~(zero | plus), zero & plus
        running = i < size_b
        diagonal = i < size_a - k
        step = np.where(diagonal, 1 - (zero >> top).astype(np.int64), 0)
        bit = np.clip(62 - (i - np.maximum(size_a - k, 0)), 0, 62).astype(np.uint64)
        level = ((up >> bit) & one).astype(np.int64) - ((down >> bit) & one).astype(np.int64)
        distance += np.where(running, np.where(diagonal, step, level), 0)
        plus, minus = down | ~((zero >> one) | up), (zero >> one) & up
    return distance


def _signatures(docs: DataFrame, threshold: int, least: int) -> DataFrame:
    """Rows (doc_id, text_hash, lines) per document and rows (node, size, point, keys) per new line."""

    def sign(batches):
        seen: set[int] = set()
        for batch in batches:
            row = 0
            for counts, points, start, end in line_slices(batch.column("text").to_pylist()):
                node = hash_pieces(points, start, end).view(np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(node)
                )
                yield _rows(
                    len(counts), doc_id=batch.column("doc_id").slice(row, len(counts)),
                    text_hash=batch.column("text_hash").slice(row, len(counts)), lines=lists,
                )
                row += len(counts)
                long = np.flatnonzero(end - start >= least)
                long = long[np.unique(node[long], return_index=True)[1]]
                long = np.array([k for k in long if node[k] not in seen], dtype=np.int64)
                if not len(long):
                    continue
                seen.update(node[long].tolist())
                which, keys = line_keys(points, start[long], end[long], threshold, least)
                order = np.argsort(which, kind="stable")
                bounds = np.append(0, np.cumsum(np.bincount(which, minlength=len(long))))
                yield _rows(
                    len(long), node=pa.array(node[long]), size=pa.array(end[long] - start[long]),
                    point=pa.array(_counts(points, start[long], end[long])),
                    keys=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys[order].view(np.int64))),
                )

    kind = docs.schema["doc_id"].dataType
    fields = pa.schema([("doc_id", _arrow(kind)), ("text_hash", pa.int64()), ("lines", pa.list_(pa.int64())),
                        ("node", pa.int64()), ("size", pa.int64()), ("point", pa.binary()),
                        ("keys", pa.list_(pa.int64()))])

    def _rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields
        )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(
        sign,
        f"doc_id {kind.simpleString()}, text_hash long, lines array<long>, node long, size long, point binary, "
        "keys array<long>",
    )


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _counts(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Characters of each line by group, as bytes that stop at 255."""
    size = end - start
    line = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    counts = np.bincount(line * GROUPS + points[inside] % GROUPS, minlength=len(size) * GROUPS)
    return [row.tobytes() for row in np.minimum(counts, 255).reshape(-1, GROUPS).astype(np.uint8)]


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line) of the given nodes."""
    wanted = bitmap_of(nodes, "node")

    def look(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, points, start, end in line_slices(batch.column("text").to_pylist()):
                node = hash_pieces(points, start, end).view(np.int64)
                rows = [k for k in np.flatnonzero(maybe_in(wanted, node)) if node[k] not in seen]
                seen.update(node[rows].tolist())
                lines = [points[start[k] : end[k]].tobytes().decode("utf-32-le", "surrogatepass") for k in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[rows], pa.int64()), pa.array(lines, pa.string())], ["node", "line"]
                )

    found = docs.select("text").mapInArrow(look, "node long, line string")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def deduplicate_lines(docs: DataFrame, threshold: int = 2, least: int = 24) -> DataFrame:
    """One row per input row: doc_id, text, n_lines, n_dropped, dropped.

    Lines are what line feeds separate. Lines of ``least`` code points or more belong together when they
    are within ``threshold`` edits, directly or through others; shorter ones when they are equal. Of
    every class the first line stays, in the order of doc_id (nulls first), text hash and place; the
    others go, and ``dropped`` has their numbers from 0. Lines of nothing but white space always stay.
    A null text stays null and has no lines. Rows of equal id and text are the same document and keep
    the same lines. An empty table gives no rows; other columns are not looked at.
    """
    if not 0 < threshold < 31 or least <= 2 * threshold:
        raise ValueError("the threshold is 1 to 30 edits, and lines have to be over twice as long")
    signed = written(_signatures(docs, threshold, least), "lines", TEXT_BATCH)
    filed = signed.filter("node IS NOT NULL")
    members = filed.select("node", F.explode("keys").alias("key"))
    points = filed.select("node", "size", "point")

    def need(a, b):
        return np.maximum(a, b) - threshold

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                good = close_pairs(batch.column("l_a").to_pylist(), batch.column("l_b").to_pylist(), threshold)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in "ab"], ["a", "b"])

    kept: list[DataFrame] = []

    def verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        if not kept:  # the lines of all candidates, read once
            kept.append(written(_texts_of(docs, written(nodes, "line-nodes")), "line-texts", TEXT_BATCH))
        (texts,) = kept
        ends = [texts.select(F.col("node").alias(c), F.col("line").alias(f"l_{c}")) for c in "ab"]
        met = pairs.join(ends[0], "a").join(ends[1], "b")
        near = F.abs(F.length("l_a") - F.length("l_b")) <= threshold
        return met.filter(near).mapInArrow(compare, "a long, b long")

    roots = linked_classes(members, points, GROUPS, need, verify)
    place = F.struct("doc_id", "text_hash", "line")
    occurrences = signed.filter("lines IS NOT NULL AND text_hash IS NOT NULL").select(
        "doc_id", "text_hash", F.posexplode("lines").alias("line", "node")
    )
    firsts = occurrences.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    classed = written(
        firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "line-classes"
    )
    repeated = (
        classed.groupBy("root")
        .agg(F.min("first").alias("keep"), F.sum("n").alias("total"))
        .filter("total > 1")
        .select("root", "keep")
    )
    keepers = classed.join(repeated, "root").select("node", "keep")
    dropped = (
        occurrences.join(keepers, "node")
        .filter(~place.eqNullSafe(F.col("keep")))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("line")).alias("lines"))
        .select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "lines")
    )
    # blank lines have classes too; they are let off here, where the text is at hand
    own = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    joined = own.join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")), "left")
    split = joined.withColumn("all", F.split("text", "\n"))
    listed = F.filter(
        F.coalesce("lines", F.array().cast("array<int>")),
        lambda i: F.trim(F.regexp_replace(F.element_at("all", i + 1), r"\s+", "")) != "",
    )
    cut = split.withColumn("dropped", listed)
    stay = F.filter("all", lambda line, i: ~F.array_contains("dropped", i))
    return cut.select(
        "doc_id",
        F.when(F.size("dropped") > 0, F.array_join(stay, "\n")).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("all")), F.lit(0)).cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        "dropped",
    )
