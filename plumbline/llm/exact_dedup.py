"""Exact duplicates by content sort, in DataFrame operations only.

Sampled splitters deal the normalised texts by range, Spark's external sort puts equal ones side by
side, and neighbours are compared in full. The splitters are a short prefix and a hash, so sampling
brings no whole text to the driver; ranges of equal (prefix, hash) hold equal texts together.

A text with more copies than a fraction of a partition would land in one task. Those texts are found
first, from counts by SHA-256 digest with map-side sums; there are at most ``4 * partitions`` of them.
Their rows are dealt over many ranges and take their group from those counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import lower_ascii

#: Characters of the text in a splitter.
PREFIX = 32

#: A text is heavy when its copies fill more than one part in so many of an even partition.
HEAVY_PARTS = 4


def exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the smallest or the largest doc_id of equal texts stays. A null text counts
    as empty. A null doc_id stays only where no row of the group has an id; of several rows with the
    kept id, all are marked kept. Other columns are not looked at. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    best = F.max if keep == "largest" else F.min
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", lower_ascii(F.col("text")).alias("norm"))
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    most = docs.count() / (HEAVY_PARTS * partitions)
    heavy = (
        rows.groupBy("sha")
        .agg(best("doc_id").alias("heavy_id"), F.count("*").alias("heavy_size"))
        .filter(F.col("heavy_size") > F.lit(max(most, 1.0)))
    )
    pieces = F.ceil(F.col("heavy_size") / F.lit(max(most, 1.0)))
    dealt = (
        rows.join(F.broadcast(heavy), "sha", "left")
        .withColumn("prefix", F.substring("norm", 1, PREFIX))
        .withColumn("hash", F.xxhash64("sha"))
        .withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), pieces), F.lit(0)))
        .repartitionByRange("prefix", "hash", "piece")
    )
    equal = Window.partitionBy("prefix", "hash", "piece", "norm")
    order = F.desc_nulls_last if keep == "largest" else F.asc_nulls_last
    keep_id = F.first("doc_id").over(equal.orderBy(order("doc_id")))
    return (
        dealt.select(
            "doc_id",
            F.when(F.col("heavy_size").isNotNull(), F.col("heavy_id")).otherwise(keep_id).alias("keep_id"),
            F.coalesce("heavy_size", F.count("*").over(equal)).alias("group_size"),
            F.col("sha").alias("text_sha256"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )
