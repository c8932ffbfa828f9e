"""What kind of text files are these? Encoding, delimiter, header and size, from whole files.

The text source hands out lines as raw bytes and splits large files, so every byte votes and no
file has to fit anywhere. The counts of the lines are combined before the shuffle and are a few
rows per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.session import shared_root

# Two-byte marks as hexadecimal text. The three bytes of the UTF-8 mark never show: the text source
# drops them, which leaves the lines that much shorter than the file.
_WIDE_MARKS = ("FFFE", "FEFF")


def list_files(spark: SparkSession, path: str | list[str], *more: Column) -> DataFrame:
    """Paths and sizes, and more of ``_metadata``. The content is not selected, so no file is opened."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"), *more)
    )


def without_quoted(line: Column) -> Column:
    """Delimiters inside quotes do not count."""
    return F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)


def _encoding(first_bytes: Column, valid_utf8: Column, unseen_bytes: Column) -> Column:
    """``unseen_bytes`` is the file size less its lines and line ends; the last end may be absent."""
    return (
        F.when(first_bytes.isin(*_WIDE_MARKS), "utf-16")
        .when(~valid_utf8, "iso-8859-1")
        .when(unseen_bytes.isin(2, 3), "utf-8-sig")
        .otherwise("utf-8")
    )


def _text(raw: Column, encoding: Column) -> Column:
    """A header line as text, without its byte-order mark."""
    decoded = (
        F.when(encoding == "utf-16", F.decode(raw, "UTF-16"))
        .when(encoding == "iso-8859-1", F.decode(raw, "ISO-8859-1"))
        .otherwise(F.decode(raw, "UTF-8"))
    )
    return F.regexp_replace(decoded, "^\ufeff|[\r\ufffd]+$", "")


def _lines(spark: SparkSession, path: str | list[str], line_end: str, keep: Column | None) -> DataFrame:
    """Lines as raw bytes, with their file and a number that grows along each block of it."""
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", line_end).text(path)
    return (
        (raw if keep is None else raw.where(keep))
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("bytes"),
            (F.col("_metadata.file_block_start") == 0).alias("in_first_block"),
            F.monotonically_increasing_id().alias("at"),
            (F.trim(F.col("value"), F.lit(" \r")) != "").alias("filled"),
        )
    )


def _first_lines(per_file: DataFrame, lines: DataFrame) -> DataFrame:
    """The bytes of the first filled line of each file, picked out of a second scan by number.

    Carrying the text through the first aggregate would make Spark sort all lines. Spark broadcasts
    the wanted numbers, one per file, where their size allows.
    """
    wanted = per_file.select("path", "at")
    raw = F.col("value").cast("binary").alias("raw")
    return lines.where("in_first_block").select("path", "at", raw).join(wanted, ["path", "at"])


def sniff(
    spark: SparkSession, path: str | list[str], line_end: str = "\n", keep: Column | None = None
) -> DataFrame:
    """One row per non-empty file: encoding, delimiter, first line, bytes and lines.

    The delimiter is the candidate whose most frequent non-zero count per line covers most lines;
    ties go to the higher count, then to the order of the candidates. Comma serves where none
    occurs, and tab wherever the file name says so. The first line is null in a blank file.
    ``quoted_feeds`` tells files with lines whose quotes do not pair up: their records may span lines.

    ``keep`` is a condition on ``_metadata`` that says which files to look at.

    The counts of a line are its key in the first aggregate, so lines of the same shape are one row
    before the shuffle, whatever the size of their file.
    """
    shared_root(spark)
    places = range(len(fixed.DELIMITERS))
    bare, quote = F.col("bare"), F.lit('"')
    shapes = [
        F.when(
            F.col("filled"),
            F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))),
        ).alias(f"n{i}")
        for i, d in enumerate(fixed.DELIMITERS)
    ]
    lines = _lines(spark, path, line_end, keep)
    # A column of its own is made once for all delimiters; inside the conditions it would be for each.
    with_bare = lines.withColumn("bare", F.when(F.col("filled"), without_quoted(F.col("value"))))
    without_quotes = F.octet_length(F.replace(F.col("value"), quote, F.lit("")))
    counted = (
        with_bare.select(
            "path",
            "bytes",
            F.is_valid_utf8("value").cast("int").alias("valid"),
            ((F.octet_length("value") - without_quotes) % 2).cast("bigint").alias("odd"),
            (F.octet_length("value") + 1).cast("bigint").alias("seen"),
            F.when(F.col("in_first_block") & F.col("filled"), F.col("at")).alias("at"),
            *shapes,
        )
        .groupBy("path", *(f"n{i}" for i in places))
        .agg(
            F.count("*").alias("lines"),
            F.max("bytes").alias("bytes"),
            F.sum("seen").alias("seen"),
            F.sum("odd").alias("odd"),
            F.min("valid").alias("valid"),
            F.min("at").alias("at"),
        )
    )
    usage = F.array(
        *(F.struct(F.lit(i).alias("rank"), F.col(f"n{i}").alias("per_line")) for i in places)
    )
    used = F.col("per_line") > 0
    per_delimiter = (
        counted.withColumn("c", F.explode(usage))
        .groupBy("path", "c.rank", "c.per_line")
        .agg(
            F.sum("lines").alias("lines"),
            F.max("bytes").alias("bytes"),
            F.sum("seen").alias("seen"),
            F.sum("odd").alias("odd"),
            F.min("valid").alias("valid"),
            F.min("at").alias("at"),
        )
        .groupBy("path", "rank")
        .agg(
            F.sum("lines").alias("lines"),
            F.max("bytes").alias("bytes"),
            F.sum("seen").alias("seen"),
            F.sum("odd").alias("odd"),
            F.min("valid").alias("valid"),
            F.min("at").alias("at"),
            F.coalesce(F.max(F.when(used, F.col("lines"))), F.lit(0)).alias("agreeing"),
            F.max_by(
                F.when(used, F.col("per_line")), F.when(used, F.struct("lines", "per_line"))
            ).alias("usual"),
        )
    )
    best = F.struct("agreeing", "usual", -F.col("rank"))
    per_file = (
        per_delimiter.groupBy("path")
        .agg(
            F.max("bytes").alias("bytes"),
            F.max("lines").alias("lines"),
            F.max("seen").alias("seen"),
            F.max("odd").alias("odd"),
            F.min("valid").alias("valid"),
            F.min("at").alias("at"),
            F.max_by("rank", best).alias("winner"),
            F.max("agreeing").alias("agreeing"),
        )
        .checkpoint()
    )
    names = F.array(*map(F.lit, fixed.DELIMITERS))
    encoding = _encoding(
        F.hex(F.substring("raw", 1, 2)), F.col("valid") == 1, F.col("bytes") - F.col("seen")
    )
    return (
        per_file.join(_first_lines(per_file, lines), ["path", "at"], "left")
        .withColumn("encoding", encoding)
        .withColumn(
            "delimiter",
            F.when(F.lower("path").endswith(".tsv"), "\t")
            .when(F.col("agreeing") == 0, ",")
            .otherwise(F.get(names, F.col("winner"))),
        )
        .select(
            "path",
            "bytes",
            "lines",
            "encoding",
            "delimiter",
            _text(F.col("raw"), F.col("encoding")).alias("header"),
            (F.col("odd") > 0).alias("quoted_feeds"),
        )
    )


def dialects(sniffed: DataFrame) -> DataFrame:
    """One row per distinct header line: encoding, delimiter, files, bytes and lines.

    A folder of part files is one table, so its files decide together: one byte-order mark, or one
    byte that is not UTF-8, settles the encoding, and most lines settle the delimiter.
    """
    marked = F.max(F.when(F.col("encoding").isin("utf-8-sig", "utf-16"), F.col("encoding")))
    latin = F.max(F.when(F.col("encoding") == "iso-8859-1", F.col("encoding")))
    sums = [F.sum(c).alias(c) for c in ("files", "bytes", "lines")]
    return (
        sniffed.withColumn("files", F.lit(1))
        .groupBy("header", "delimiter")
        .agg(marked.alias("marked"), latin.alias("latin"), *sums)
        .groupBy("header")
        .agg(
            F.coalesce(F.max("marked"), F.max("latin"), F.lit("utf-8")).alias("encoding"),
            F.max_by("delimiter", F.struct("lines", "delimiter")).alias("delimiter"),
            *sums,
        )
    )


def source_status(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every file with what was found, and whether it can be read as a table.

    ``ok``; ``fallback`` when no delimiter was found and the file is read as one column; ``empty``
    when it has blank lines only. Spark does not list files of no bytes at all.
    """
    sniffed = sniff(spark, path).drop("bytes")
    return list_files(spark, path).join(sniffed, "path", "left").select(
        "path",
        "bytes",
        "lines",
        "encoding",
        "delimiter",
        F.when(F.col("header").isNull(), "empty")
        .when(~F.contains(F.col("header"), F.col("delimiter")), "fallback")
        .otherwise("ok")
        .alias("status"),
    )
