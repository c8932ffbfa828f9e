"""What several operators share: written intermediate tables, and gapless positions."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits that ``monotonically_increasing_id`` leaves for the row within its partition.
ROW_BITS = 33


def process_state() -> dict:
    """What this Python process keeps from task to task; task code itself arrives anew with every task."""
    name = "_plumbline_process_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Rows in an Arrow batch of whole texts, so that a task's memory follows its texts, not 10,000 of them.
TEXT_BATCH = 500

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder: cuts the lineage for good.

    ``batch_rows`` bounds the Arrow batches of this one job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(batch_rows or before))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def partition_offsets(spark: SparkSession, counts: list[tuple[int, int]]) -> DataFrame:
    """(part, before): how many rows the partitions before it hold; one row per partition."""
    rows, before = [], 0
    for part, n in sorted(counts):
        rows.append((part, before))
        before += n
    return spark.createDataFrame(rows, "part int, before long")


def with_positions(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Adds ``position``, the row's gapless number from 0 in the order of ``keys``.

    Rows are dealt by ranges of the keys, sorted and written; a row's number is its place in its
    partition plus the rows of the partitions before. No task sees more than its range, so give keys
    that tell rows apart: then no key is hot. The driver sees one count per partition.
    """
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(sorted_rows.withColumn("_row", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("part", F.shiftright("_row", ROW_BITS).cast("int"))
    counts = [(r[0], r[1]) for r in placed.groupBy("part").count().collect()]
    offsets = partition_offsets(df.sparkSession, counts)
    inside = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("position", F.col("before") + inside)
        .drop("_row", "part", "before")
    )
