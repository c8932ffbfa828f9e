"""Which requested files may be read, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed


def has_ending(path: Column, endings) -> Column:
    return F.lower(path).rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def ending(path: Column) -> Column:
    """The ending of a path with its dot, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def admit_files(
    requested: DataFrame, inventory: DataFrame, endings=fixed.ANALYSIS_ENDINGS
) -> DataFrame:
    """(path, requests, ok, reason) for every distinct requested path.

    ``requested`` has a column path, ``inventory`` the columns path and is_file with one row per
    path. Requests are counted per path before the join, so a popular path is one row in it.
    """
    asked = requested.groupBy("path").agg(F.count("*").alias("requests"))
    path = F.col("path")
    dotted = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    reason = (
        F.when(path.isNull() | (path == ""), fixed.NO_PATH)
        .when(F.col("is_file").isNull(), F.concat(F.lit(fixed.NOT_FOUND), path))
        .when(~F.col("is_file"), F.concat(F.lit(fixed.NOT_A_FILE), path))
        .when(
            ~has_ending(path, endings),
            F.concat(
                F.lit(fixed.WRONG_TYPE[0]),
                dotted,
                F.lit(fixed.WRONG_TYPE[1] + ", ".join(endings)),
            ),
        )
        .otherwise("")
    )
    return (
        asked.join(inventory.select("path", "is_file"), "path", "left")
        .withColumn("reason", reason)
        .select("path", "requests", (F.col("reason") == "").alias("ok"), "reason")
    )
