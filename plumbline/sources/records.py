"""Records of delimited text that span lines, read split by split.

Whether a line begins inside quotes depends on all lines before it. So each line is a function from the
state it is entered in, outside or inside quotes, to the state it leaves, and functions compose:

1. every split composes its lines into one function (one row per split),
2. the functions of a file's splits compose to the state that each split is entered in,
3. every split reads its lines again, knowing where records begin, and hands out whole records; what lies
   across splits comes as pieces, which are put together per file.

No file is ever read by one task, and no text is shuffled but the pieces at the edges of splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits whose entry states are broadcast (a few dozen bytes each); more are joined by a shuffle of lines.
BROADCAST_SPLITS = 100_000

_SPLIT = ["path", "block", "size"]
_COMPLETE, _HEAD, _MIDDLE, _TAIL = range(4)


def _left_open(line: Column, delimiter: str) -> Column:
    """Whether a line that begins a record leaves a quoted field open."""
    d = re.escape(delimiter)
    closed = F.regexp_replace(line, f'(^|{d})[ \\t]*"[^"]*+(?:""[^"]*+)*+"', "$1x")
    return F.contains(line, F.lit('"')) & F.coalesce(closed.rlike(f'(^|{d})[ \\t]*"'), F.lit(False))


def _stays_open(line: Column, delimiter: str) -> Column:
    """Whether a line that begins inside quotes ends inside quotes."""
    to_close = '^[^"]*+(?:""[^"]*+)*+"'
    rest = F.regexp_replace(line, to_close, "x")
    closes = F.contains(line, F.lit('"')) & line.rlike(to_close)
    return F.when(closes, _left_open(rest, delimiter)).otherwise(F.lit(True))


def _lines(
    spark: SparkSession, path: str | list[str], delimiter: str, encoding: str, line_end: str, keep: Column | None
) -> DataFrame:
    """(path, block, size, value, opens, stays): the lines of every split, in order within it."""
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", line_end).text(path)
    if keep is not None:
        raw = raw.where(keep)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("size"),
        value.alias("value"),
    )
    line = F.col("value")
    return lines.withColumn("opens", _left_open(line, delimiter)).withColumn("stays", _stays_open(line, delimiter))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """((path, block, size), first, behind) of the stretches of a batch that belong to one split."""
    if not batch.num_rows:
        return
    codes = batch.column("path").dictionary_encode().indices.to_numpy()
    block = batch.column("block").to_numpy()
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield tuple(batch.column(c)[a].as_py() for c in _SPLIT), a, b


def _states(opens: np.ndarray, stays: np.ndarray, entry: bool) -> np.ndarray:
    """Whether quotes are open before each line, and behind the last one."""
    n = len(opens)
    fixed = opens == stays
    swaps = np.concatenate([[0], np.cumsum(opens & ~stays)])
    # behind line k: what the last line with a fixed outcome left, swapped as often as lines since then swap
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1)) if n else np.zeros(0, dtype=int)
    base = np.where(last >= 0, opens[last], entry)
    since = swaps[1:] - np.where(last >= 0, swaps[last + 1], 0)
    return np.concatenate([[entry], base ^ (since % 2 == 1)])


def _bools(batch: pa.RecordBatch, name: str, a: int, b: int) -> np.ndarray:
    return batch.column(name).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)


def _split_functions(lines: DataFrame) -> DataFrame:
    """(path, block, size, from_out, from_in): the state behind each split, by the state before it."""

    def compose(batches):
        current, after = None, [False, True]

        def row():
            columns = [pa.array([v]) for v in (*current, *after)]
            return pa.RecordBatch.from_arrays(columns, [*_SPLIT, "from_out", "from_in"])

        for batch in batches:
            for split, a, b in _runs(batch):
                if split != current:
                    if current:
                        yield row()
                    current, after = split, [False, True]
                opens, stays = _bools(batch, "opens", a, b), _bools(batch, "stays", a, b)
                after = [bool(_states(opens, stays, s)[-1]) for s in after]
        if current:
            yield row()

    schema = "path string, block long, size long, from_out boolean, from_in boolean"
    return lines.select(*_SPLIT, "opens", "stays").mapInArrow(compose, schema)


def _entries(functions: DataFrame) -> DataFrame:
    """(path, block, size, entry, exit): the states before and behind each split of each file."""
    in_order = Window.partitionBy("path").orderBy("block")
    swap = F.col("from_out") & ~F.col("from_in")
    counted = functions.withColumn("swaps", F.sum(swap.cast("int")).over(in_order))
    outcome = F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "swaps"))
    last = F.last(outcome, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.lag("swaps").over(in_order), F.lit(0))
    placed = counted.withColumn("last", last).withColumn("before", before)
    odd = (F.col("before") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2 == 1
    entry = F.coalesce(F.col("last.from_out"), F.lit(False)) != odd
    placed = placed.withColumn("entry", entry)
    behind = F.when(F.col("entry"), F.col("from_in")).otherwise(F.col("from_out"))
    return placed.select(*_SPLIT, "entry", behind.alias("exit"))


class _Assembler:
    """Puts the lines of one split after the other together; ``rows`` collects what is finished."""

    def __init__(self, line_end: str, header: bool):
        self.end, self.header = line_end, header
        self.split, self.inside, self.held, self.tail = None, False, [], False
        self.to_drop = False  # the header record is still to come

    def begin(self, split, entry: bool):
        self.split, self.inside, self.held, self.tail = split, entry, [], entry
        self.to_drop = self.header and split[1] == 0

    def close(self):
        """The rows of what the end of a split leaves open."""
        if self.split is None or not self.held:
            return []
        kind = _MIDDLE if self.tail and self.inside else _TAIL if self.tail else _HEAD if self.inside else _COMPLETE
        text, self.held = self.end.join(self.held), []
        return [(kind, text)] if kind != _COMPLETE or self.keeps(text) else []

    def keeps(self, text: str) -> bool:
        """False for blank records, and for the first other one of a file with a header."""
        if not text.strip(" \r\n"):
            return False
        dropped, self.to_drop = self.to_drop, False
        return not dropped

    def add(self, values: pa.Array, opens: np.ndarray, stays: np.ndarray):
        """The rows that these lines finish."""
        state = _states(opens, stays, self.inside)
        starts = np.flatnonzero(~state[:-1])  # lines that begin a record
        self.inside = bool(state[-1])
        if not len(starts):
            self.held.extend(values.to_pylist())
            return []
        first, last = int(starts[0]), int(starts[-1])
        self.held.extend(values.slice(0, first).to_pylist())
        out = []
        if self.held:
            text, self.held = self.end.join(self.held), []
            if self.tail or self.keeps(text):
                out.append((_TAIL if self.tail else _COMPLETE, text))
        self.tail = False
        texts = values.slice(first, last - first).to_pylist()
        bounds = (starts - first).tolist()
        for a, b in zip(bounds, bounds[1:]):
            text = texts[a] if b == a + 1 else self.end.join(texts[a:b])
            if self.keeps(text):
                out.append((_COMPLETE, text))
        self.held = values.slice(last).to_pylist()
        return out


def _assembled(lines: DataFrame, line_end: str, header: bool) -> DataFrame:
    """(path, block, kind, is_header, record) from lines that know the entry state of their split."""

    def assemble(batches):
        work = _Assembler(line_end, header)

        def rows(found):
            kinds, texts = zip(*found)
            dropped = [k == _HEAD and work.to_drop for k in kinds]
            n = len(found)
            columns = [pa.array([work.split[0]] * n), pa.array([work.split[1]] * n), pa.array(kinds, pa.int32()),
                       pa.array(dropped), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["path", "block", "kind", "is_header", "record"])

        for batch in batches:
            for split, a, b in _runs(batch):
                if split != work.split:
                    if found := work.close():
                        yield rows(found)
                    work.begin(split, bool(batch.column("entry")[a].as_py()))
                values = batch.column("value").slice(a, b - a)
                if found := work.add(values, _bools(batch, "opens", a, b), _bools(batch, "stays", a, b)):
                    yield rows(found)
        if found := work.close():
            yield rows(found)

    schema = "path string, block long, kind int, is_header boolean, record string"
    return lines.select(*_SPLIT, "value", "opens", "stays", "entry").mapInArrow(assemble, schema)


def _with_entries(lines: DataFrame, entries: DataFrame, few: bool) -> DataFrame:
    """Lines with the entry state of their split, still in order within it.

    The join fails where a split is not the one that was measured, which happens when the cluster's size
    changed in between and with it the size of splits.
    """
    if few:
        met = lines.join(F.broadcast(entries), _SPLIT, "left")
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        met = numbered.join(entries.hint("shuffle_hash"), _SPLIT, "left")
        met = met.repartition(*_SPLIT).sortWithinPartitions(*_SPLIT, "at")
    changed = F.raise_error(F.lit("the files were split anew between two passes; read them again"))
    return met.withColumn("entry", F.coalesce(F.col("entry"), changed.cast("boolean")))


def read_records(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = ",",
    encoding: str = "UTF-8",
    header: bool = True,
    line_end: str = "\n",
    keep: Column | None = None,
    broadcast_splits: int = BROADCAST_SPLITS,
) -> DataFrame:
    """(path, block, last, record): the raw records of all files; those that span lines hold their line ends.

    ``block`` is where the split begins in which the record does; ``last`` marks records that end in another
    one. The others come in the order of their split.

    Quotes open at the start of a field, doubled ones stand for themselves, and quotes elsewhere are text.
    Blank records are left out, and with ``header`` the first other record of each file. A quote that never
    closes takes the rest of its file into one record. ``keep`` is a condition on the files' metadata.
    """
    lines = _lines(spark, path, delimiter, encoding, line_end, keep)
    entries = _entries(_split_functions(lines)).checkpoint()
    few = entries.count() <= broadcast_splits
    whole = _assembled(_with_entries(lines, entries, few), line_end, header)
    whole = whole.where(F.col("kind") == _COMPLETE).select("path", "block", F.lit(False).alias("last"), "record")
    edges = entries.where(F.col("entry") | F.col("exit"))
    if edges.isEmpty():
        return whole
    # only splits that a record enters or leaves are read for pieces
    near = lines.join(F.broadcast(edges) if few else edges, _SPLIT, "left_semi")
    pieces = _assembled(_with_entries(near, entries, few), line_end, header).where(F.col("kind") != _COMPLETE)
    is_head = (F.col("kind") == _HEAD).cast("int")
    begun = F.sum(is_head).over(Window.partitionBy("path").orderBy("block", is_head))
    parts = F.array_sort(F.collect_list(F.struct("block", "part", "record")))
    joined = (
        pieces.withColumn("begun", begun)
        .withColumn("part", is_head)
        .groupBy("path", "begun")
        .agg(
            F.max("is_header").alias("is_header"),
            F.min("block").alias("block"),
            F.transform(parts, lambda p: p["record"]).alias("texts"),
        )
        .where(~F.col("is_header"))
        .select("path", "block", F.lit(True).alias("last"), F.array_join("texts", line_end).alias("record"))
    )
    return whole.unionByName(joined)
