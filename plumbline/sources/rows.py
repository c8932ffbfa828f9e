"""Numbers for the rows of files, in file order, and what is chosen by them: the first rows, or a sample.

File order is by path, then as the rows stand. Nothing is sorted for it:

1. every split counts its rows (one row per split),
2. sums over the splits before say with which number each split begins,
3. every split numbers its rows from there, as it is read.

So a row's number does not depend on how the files are split, and neither does a sample drawn by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.coercion import quoted
from plumbline.session import shared_root
from plumbline.sources.records import BROADCAST_SPLITS

#: Where a row comes from: its file, its split, and whether it runs on into the next split, which makes it
#: the last one of its own. Readers add these columns on request.
PLACE = ("__path", "__block", "__last")

_RANK = "__rank"
#: Rows of a bucket of hashes that are sorted in one task to find the last one of a sample.
_SORTED = 4096


def place(path: Column, block: Column, last: Column | None = None) -> list[Column]:
    """The columns of ``PLACE``."""
    runs_on = F.lit(False) if last is None else last
    return [path.alias(PLACE[0]), block.cast("long").alias(PLACE[1]), runs_on.alias(PLACE[2])]


def _starts(rows: DataFrame) -> DataFrame:
    """(path, block, rows, start): the number of every split's first row. One row per split."""
    counted = rows.groupBy(*PLACE[:2]).agg(F.count("*").alias("__rows"))
    before = Window.orderBy(*PLACE[:2]).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0)))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their rank among those of their split that end in it, counted as they are read."""
    schema = T.StructType([*rows.schema.fields, T.StructField(_RANK, T.LongType())])
    names = [*rows.columns, _RANK]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(PLACE[0]).dictionary_encode().indices.to_numpy()
            block = batch.column(PLACE[1]).to_numpy()
            firsts = np.concatenate([[0], np.flatnonzero((np.diff(codes) != 0) | (np.diff(block) != 0)) + 1])
            begun = (batch.column(PLACE[0])[0].as_py(), int(block[0]))
            base = np.zeros(len(firsts), dtype=np.int64)
            base[0] = count if begun == current else 0
            lengths = np.diff(np.append(firsts, batch.num_rows))
            ranks = np.arange(batch.num_rows) - np.repeat(firsts - base, lengths)
            current = (batch.column(PLACE[0])[batch.num_rows - 1].as_py(), int(block[-1]))
            count = int(ranks[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64())], names)

    return rows.mapInArrow(number, schema)


def numbered(rows: DataFrame, starts: DataFrame, name: str, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """``rows`` with their number in file order (from 0) as the column ``name``, without their place.

    ``starts`` is read again for every split, so pass it written. A split that was not counted, or has more
    rows than were counted, means that files or splits changed in between, and is an error.
    """
    few = starts.count() <= broadcast_splits
    met = _ranked(rows).join(F.broadcast(starts) if few else starts, [*PLACE[:2]], "left")
    rank = F.when(F.col(PLACE[2]), F.col("__rows") - 1).otherwise(F.col(_RANK))
    changed = F.raise_error(F.lit("the files were split anew between two passes; read them again")).cast("long")
    number = F.when(rank < F.col("__rows"), F.col("__start") + rank).otherwise(changed)
    columns = [F.col(quoted(c)) for c in rows.columns if c not in PLACE]
    return met.select(*columns, number.alias(name))


def first_rows(rows: DataFrame, n: int, name: str) -> tuple[DataFrame, int]:
    """The first ``n`` rows in file order, with their number, and how many rows there are to choose from."""
    shared_root(rows.sparkSession)
    starts = _starts(rows).checkpoint()
    total = starts.agg(F.sum("__rows")).first()[0] or 0
    return numbered(rows, starts, name).where(F.col(quoted(name)) < n), total


def _key(number: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string")).cast("binary"))


def _last_key(spark: SparkSession, total: int, n: int, seed: int) -> str:
    """The largest key of the ``n`` rows with the smallest keys, among rows 0 to ``total`` - 1.

    Keys come from numbers, so no file is read for it. Rows are counted by three more hexadecimal digits per
    pass, until those in question are few.
    """
    keys = spark.range(total).select(_key(F.col("id"), seed).alias("key"))
    prefix, wanted = "", n
    while True:
        digits = F.substring("key", len(prefix) + 1, 3)
        counts = keys.where(F.col("key").startswith(prefix)).groupBy(digits.alias("d")).count().collect()
        for d, count in sorted((r["d"], r["count"]) for r in counts):  # at most 4,096
            if wanted <= count:
                break
            wanted -= count
        prefix += d
        if count <= _SORTED or len(prefix) >= 30:
            near = keys.where(F.col("key").startswith(prefix)).orderBy("key").limit(wanted)
            return near.agg(F.max("key")).first()[0]


def sampled_rows(rows: DataFrame, n: int, seed: int, name: str) -> tuple[DataFrame, int]:
    """``n`` rows drawn without replacement (all, if fewer), with their number, and how many there are.

    A row is drawn by the MD5 digest of seed and number: the same files and seed give the same rows, on any
    cluster, and equal rows are drawn independently of each other.
    """
    spark = rows.sparkSession
    shared_root(spark)
    starts = _starts(rows).checkpoint()
    total = starts.agg(F.sum("__rows")).first()[0] or 0
    all_rows = numbered(rows, starts, name)
    if n >= total:
        return all_rows, total
    if n <= 0:
        return all_rows.where(F.lit(False)), total
    return all_rows.where(_key(F.col(quoted(name)), seed) <= _last_key(spark, total, n, seed)), total


def leading_files(files: DataFrame, m: int) -> tuple[str | None, int, bool]:
    """(last path, lines, whether these are all) of the first ``m`` files by path, of (path, lines)."""
    told = files.orderBy("path").limit(m).agg(F.max("path").alias("path"), F.sum("lines").alias("lines"), F.count("*").alias("n"))
    found = told.first()
    return found["path"], found["lines"] or 0, found["n"] < m
