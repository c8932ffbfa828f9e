"""Tolerant reader for delimited text, and the loader that turns files into a typed table."""

from __future__ import annotations

import codecs
import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.cleaning import header_names
from plumbline.operators.coercion import (
    Verdict,
    apply_verdicts,
    normalise_missing,
    quoted,
    vote,
)
from plumbline.sources import rows
from plumbline.sources import sniff as sniffing
from plumbline.sources.records import read_records

_ODD = "__odd_record"
# Encodings that Spark's own reader knows, by their normal names.
_READABLE = {
    "utf-8": "UTF-8",
    "utf-8-sig": "UTF-8",
    "ascii": "UTF-8",
    "utf-16": "UTF-16",
    "iso8859-1": "ISO-8859-1",
}


def normal_encoding(name: str) -> str:
    """The normal name of an encoding, however it is spelt; an unknown one is a LookupError."""
    return codecs.lookup(name).name


def fields_in(record: Column, delimiter: str) -> Column:
    """Number of fields of a raw record; delimiters inside quoted fields do not count."""
    d = re.escape(delimiter)
    closed = F.regexp_replace(record, f'(^|{d})[ \\t]*"[^"]*+(?:""[^"]*+)*+"', "$1")
    bare = F.when(F.contains(record, F.lit('"')), closed).otherwise(record)
    return F.regexp_count(bare, F.lit(d)) + 1


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    names: list[str],
    delimiter: str = ",",
    encoding: str = "utf-8",
    multiline: bool = False,
    header: bool = True,
    path_column: str | None = None,
    line_end: str = "\n",
    keep: Column | None = None,
    places: bool = False,
) -> DataFrame:
    """All columns as text. Short records are padded, long ones dropped, blank lines skipped.

    A record with just the right number of fields is taken as it is. Only the odd ones keep their
    raw text, and their fields are counted to tell short from long. Quoted line feeds need
    ``multiline``, which reads every split twice (``records``); UTF-16 makes each file one task.
    ``path_column`` adds the path of each row's file under that name. ``keep`` is a condition on
    ``_metadata`` that says which files to read; Spark drops the others when it lists them. ``places``
    adds the columns of ``rows.PLACE``.
    """
    schema = ", ".join(f"{quoted(n)} string" for n in [*names, _ODD])
    encoding = normal_encoding(encoding)
    if encoding not in _READABLE:
        if multiline:
            raise ValueError(f"multiline is not supported for {encoding}")
        if len("\n".encode(encoding)) != 1:
            raise ValueError(f"{encoding} does not end lines with one byte; convert the files first")
        return _read_code_page(spark, path, names, delimiter, encoding, header, path_column, keep, places)
    if multiline and encoding != "utf-16":
        found = read_records(spark, path, delimiter, _READABLE[encoding], header, line_end, keep)
        record = F.regexp_replace("record", "\r$", "")
        extra = [F.col("path").alias(path_column)] if path_column else []
        extra += rows.place(F.col("path"), F.col("block"), F.col("last")) if places else []
        return _taken_apart(found.select("path", "block", "last", record.alias("line")), names, delimiter, extra)
    df = (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", _READABLE[encoding])
        .option("multiLine", multiline or encoding == "utf-16")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _ODD)
        # Pruned columns would leave the raw text of odd records empty.
        .option("columnPruning", False)
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    if keep is not None:
        df = df.where(keep)
    # The empty piece of the first column keeps that column in the scan: the reader refuses to
    # return raw records alone.
    odd = F.concat_ws("", F.substring(F.col(quoted(names[0])), 1, 0), F.col(_ODD))
    kept = df.where(fields_in(odd, delimiter) <= len(names))
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    extra = [file.alias(path_column)] if path_column else []
    extra += rows.place(file, block) if places else []
    return kept.select(*(F.col(quoted(n)) for n in names), *extra)


def _read_code_page(
    spark: SparkSession,
    path: str | list[str],
    names: list[str],
    delimiter: str,
    encoding: str,
    header: bool,
    path_column: str | None = None,
    keep: Column | None = None,
    places: bool = False,
) -> DataFrame:
    """Files in a code page that Spark's reader does not know, decoded line by line in Python.

    The lines come as raw bytes from the splittable text source and are taken apart by Spark. Line
    feeds inside quotes are not supported here. The header is the first line of each file: the first
    batch of a piece that begins a file has it at its head.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = None
        for batch in batches:
            lines, heads = [], []
            for value, path, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines.append(value.decode(encoding, "replace"))
                heads.append(header and at == 0 and (path, at) != begun)
                begun = (path, at)
            columns = [pa.array(lines, pa.string()), pa.array(heads, pa.bool_()), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["line", "is_header", "path", "block"])

    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = raw if keep is None else raw.where(keep)
    block = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    decoded = raw.select(F.col("value").cast("binary"), *block).mapInArrow(
        decode, "line string, is_header boolean, path string, block long"
    )
    lines = decoded.where(~F.col("is_header"))
    if header:
        heads = decoded.where("is_header").select("line").distinct().take(2)
        if len(heads) > 1:
            raise ValueError(f"The files do not share one header: {[h['line'] for h in heads]}")
    extra = [F.col("path").alias(path_column)] if path_column else []
    extra += rows.place(F.col("path"), F.col("block")) if places else []
    return _taken_apart(lines, names, delimiter, extra)


def _taken_apart(lines: DataFrame, names: list[str], delimiter: str, extra: list[Column] = ()) -> DataFrame:
    """The fields of raw records in the column ``line``, and further columns."""
    line = F.col("line")
    schema = ", ".join(f"{quoted(n)} string" for n in names)
    options = {
        "sep": delimiter,
        "quote": '"',
        "escape": '"',
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "false",
        "multiLine": "true",  # line ends inside quotes stay as they are
    }
    return (
        lines.where((F.trim(line) != "") & (fields_in(line, delimiter) <= len(names)))
        .withColumn("r", F.from_csv(line, schema, options))
        .select(*(F.col("r")[n].alias(n) for n in names), *extra)
    )


@dataclass(frozen=True)
class LoadedTable:
    """A typed table with the facts about its files and the votes behind its types."""

    df: DataFrame
    verdicts: list[Verdict]
    source: dict


#: Files with records that span lines which are told apart from the others by name. Where there are more,
#: all files are read as such.
LISTED_FILES = 1000


def _sniffed(spark: SparkSession, path: str | list[str], line_end: str) -> DataFrame:
    """What the files with text are, kept, as several questions are asked of it."""
    return sniffing.sniff(spark, path, line_end).where(F.col("header").isNotNull()).checkpoint()


def load_table(
    spark: SparkSession,
    path: str | list[str],
    multiline: bool = False,
    delimiter: str | None = None,
    encoding: str | None = None,
    names: list[str] | None = None,
    first_rows: int | None = None,
    path_column: str | None = None,
    header: bool = True,
    sample_rows: int | None = None,
    seed: int = 0,
    row_column: str | None = None,
    typed: bool = True,
) -> LoadedTable:
    """Find out the dialect of the files, read them, and give every column its voted type.

    All rows are read and vote. ``first_rows`` asks for the first so many instead, by path and then as they
    stand in the file; files behind the last one of them are not read. ``sample_rows`` asks for that many,
    drawn from all rows by ``seed``; the same files and seed give the same rows. Either way ``sampled`` in
    the source says that there are more, and the rows asked for are written once. ``row_column`` adds the
    number of each row in file order, from 0. ``typed=False`` leaves the columns text and spares the vote.

    Files whose quotes do not pair up line by line are read as records that may span lines, the others line
    by line. Where there are such records, the rows are written once before they vote, as putting records
    together costs more than reading rows back.
    ``header=False`` takes the first line for data; then give ``names``, else columns are numbered.
    Where delimiter, encoding and names are all given, the pass that finds the dialect out is left out,
    and ``multiline`` has to say whether records span lines.
    """
    if first_rows is not None and sample_rows is not None:
        raise ValueError("first_rows and sample_rows exclude each other")
    source = {"sampled": False}
    across, line_end, filled = [], "\n", None
    if not (delimiter and encoding and names):
        filled = _sniffed(spark, path, line_end)
        found = sniffing.dialects(filled).take(2)
        if not found:
            raise ValueError(f"No readable file at {path}")
        if "\r" in found[0]["header"]:  # lines end with a carriage return alone
            line_end = "\r"
            filled = _sniffed(spark, path, line_end)
            found = sniffing.dialects(filled).take(2)
        if len(found) > 1 and not header:
            # First lines of data differ; one of them tells how many columns there are.
            whole = sniffing.dialects(filled.withColumn("header", F.lit(found[0]["header"])))
            found = whole.take(1)
        if len(found) > 1:
            raise ValueError(
                "The files do not share one header and delimiter; load each kind by itself: "
                + "; ".join(repr(r["header"]) for r in found)
            )
        dialect = found[0].asDict()
        delimiter = delimiter or dialect["delimiter"]
        encoding = encoding or dialect["encoding"]
        first_line = dialect["header"]
        encoding = normal_encoding(encoding)
        if encoding not in _READABLE and dialect["encoding"] == "iso-8859-1":
            first_line = first_line.encode("iso-8859-1").decode(encoding)
        fields = next(csv.reader([first_line], delimiter=delimiter, skipinitialspace=True))
        names = names or (fields if header else [f"column_{i + 1}" for i in range(len(fields))])
        if encoding in _READABLE and not multiline:
            odd = filled.where("quoted_feeds").select("path").take(LISTED_FILES + 1)
            across = [r["path"] for r in odd]
        source.update({k: dialect[k] for k in ("files", "bytes", "lines")})
    source.update(encoding=encoding, delimiter=delimiter)
    names = header_names(names)
    numbers = row_column or "__row"
    by_number = first_rows is not None or sample_rows is not None or row_column is not None

    def read(up_to: str | None = None) -> DataFrame:
        """The rows of all files, or of those up to a path."""
        where = F.col("_metadata.file_path")
        ahead = F.lit(True) if up_to is None else where <= up_to
        options = {"header": header, "path_column": path_column, "line_end": line_end, "places": by_number}
        if not 0 < len(across) <= LISTED_FILES:
            keep = None if up_to is None else ahead
            return read_delimited(
                spark, path, names, delimiter, encoding, multiline or bool(across), keep=keep, **options
            )
        spanning = where.isin(across)
        return read_delimited(
            spark, path, names, delimiter, encoding, True, keep=spanning & ahead, **options
        ).unionByName(read_delimited(spark, path, names, delimiter, encoding, False, keep=~spanning & ahead, **options))

    if first_rows is not None:
        if filled is None:
            filled = sniffing.list_files(spark, path).withColumn("lines", F.lit(None).cast("long"))
        raw, more = _head(read, filled, first_rows, numbers)
        source["sampled"] = more
    elif sample_rows is not None:
        raw, total = rows.sampled_rows(read(), sample_rows, seed, numbers)
        source["sampled"] = sample_rows < total
    elif row_column:
        raw, _ = rows.first_rows(read(), 2**62, numbers)
    else:
        raw = read()
    spanning = typed and (multiline or bool(across))
    if first_rows is not None or sample_rows is not None or spanning:
        raw = raw.checkpoint()
    kept = names if not path_column else [*names, path_column]
    text = normalise_missing(raw.select(*(F.col(quoted(c)) for c in [*kept, *([row_column] if row_column else [])])))
    verdicts = vote(text, names) if typed else []
    return LoadedTable(apply_verdicts(text, verdicts), verdicts, source)


#: Files that the search for the first rows begins with; it goes on with four times as many.
HEAD_FILES = 16


def _head(read, files: DataFrame, n: int, name: str) -> tuple[DataFrame, bool]:
    """The first ``n`` rows, and whether there are more. Files are taken by path until they hold enough.

    ``files`` has (path, lines); where lines are known, files are not opened before their lines suffice.
    """
    m, every = HEAD_FILES, False
    while True:
        last, lines, every = rows.leading_files(files, m)
        if every or lines > n or not lines:
            found, total = rows.first_rows(read(None if every else last), n, name)
            if every or total > n:
                return found, total > n
        m *= 4
