"""A folder of mixed files, or one file, to one typed table with its profile, and to reports.

The plan is a manifest: every real file is listed, admitted by its ending, and looked at; files of one
kind (encoding, delimiter and header) share a reader; workbooks give the rows of a sheet. The tables are
put together by column name, and every file has a status that says what became of it.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import cached_property, reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.cleaning import header_names
from plumbline.operators import profile, render
from plumbline.operators.coercion import Verdict, apply_verdicts, normalise_missing, quoted, vote
from plumbline.session import shared_root
from plumbline.sources import admission, workbook
from plumbline.sources.delimited import LISTED_FILES, read_delimited
from plumbline.sources.sniff import list_files, sniff

TEXT_ENDINGS = (".csv", ".tsv", ".txt")
BOOK_ENDINGS = (".xlsx",)

#: Kinds of delimited files that one table is put together from; each is a reader in the plan.
MOST_KINDS = 200

_FILE = "__file"


class Refused(ValueError):
    """No file may or can be read; the message says why."""


@dataclass(frozen=True)
class LoadedFolder:
    """A typed table, its profile (a row), the facts about its source, and a row per file."""

    df: DataFrame
    verdicts: list[Verdict]
    source: dict
    status: DataFrame

    @cached_property
    def profile(self) -> DataFrame:
        """Made when it is asked for, as it reads the table."""
        return profile.table_profile(self.df.select(*(F.col(quoted(v.name)) for v in self.verdicts)))


def inventory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file, ending, bytes) of all files that hold anything. No file is opened."""
    listed = list_files(spark, path)
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select("path", F.url_decode(name).alias("file"), admission.ending(F.col("path")).alias("ending"), "bytes")


def _books(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All cells of the workbooks; they are asked several questions, so they are kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    where = F.col("_metadata.file_path")
    found = files.where(admission.has_ending(where, BOOK_ENDINGS)).select(where.alias("path"), "content")
    return workbook.named_cells(found).checkpoint()


def _text_files(endings) -> Column:
    read = [e for e in TEXT_ENDINGS if e in endings]
    return admission.has_ending(F.col("_metadata.file_path"), read)


def _manifest(listed: DataFrame, sniffed: DataFrame | None, cells: DataFrame | None, endings) -> DataFrame:
    told = "encoding string, delimiter string, header string, lines long, spans boolean"
    spark = listed.sparkSession
    text = spark.createDataFrame([], f"path string, {told}")
    if sniffed is not None:
        text = sniffed.select("path", "encoding", "delimiter", "header", "lines", F.col("quoted_feeds").alias("spans"))
    books = spark.createDataFrame([], "path string, sheets array<string>, error string")
    if cells is not None:
        sheet = F.when((F.col("row") == 0) & (F.col("sheet_no") >= 0), F.struct("sheet_no", "sheet"))
        # as many as a workbook has sheets
        sheets = F.array_sort(F.collect_list(sheet))["sheet"]
        books = cells.groupBy("path").agg(sheets.alias("sheets"), F.max("error").alias("error"))
    admitted = admission.has_ending(F.col("path"), endings)
    is_text, is_book = F.col("ending").isin(*TEXT_ENDINGS), F.col("ending").isin(*BOOK_ENDINGS)
    status = (
        F.when(~admitted, "refused")
        .when(is_text & F.col("header").isNull(), "empty")
        .when(is_text & ~F.contains("header", "delimiter"), "fallback")
        .when(is_text, "ok")
        .when(is_book & F.col("error").isNotNull(), "unreadable")
        .when(is_book, "ok")
        .otherwise("unsupported")
    )
    reason = F.when(
        ~admitted,
        F.concat(F.lit(fixed.WRONG_TYPE[0]), F.col("ending"), F.lit(fixed.WRONG_TYPE[1] + ", ".join(endings))),
    ).otherwise(F.coalesce("error", F.lit("")))
    return (
        listed.join(text, "path", "left")
        .join(books, "path", "left")
        .select(
            "path", "file", "ending", "bytes", "lines", "encoding", "delimiter", "header", "spans", "sheets",
            status.alias("status"), reason.alias("reason"),
        )
    )


def _kinds(manifest: DataFrame) -> list:
    """One row per kind of delimited files, largest first, and what its reader has to know."""
    read = manifest.where(F.col("ending").isin(*TEXT_ENDINGS) & F.col("status").isin("ok", "fallback"))
    plain = F.when(F.col("encoding") == "utf-8-sig", "utf-8").otherwise(F.col("encoding"))
    kinds = read.groupBy(plain.alias("encoding"), "delimiter", "header").agg(
        F.count("*").alias("files"), F.max("spans").alias("spans")
    )
    found = kinds.orderBy(F.desc("files"), "header", "delimiter", "encoding").take(MOST_KINDS + 1)
    if len(found) > MOST_KINDS:
        raise Refused(f"The files have more than {MOST_KINDS} kinds of headers; load them in parts")
    return found


def _paths(manifest: DataFrame, kind, others: bool = False) -> list[str]:
    plain = F.when(F.col("encoding") == "utf-8-sig", "utf-8").otherwise(F.col("encoding"))
    same = (plain == kind["encoding"]) & (F.col("delimiter") == kind["delimiter"]) & (F.col("header") == kind["header"])
    text = manifest.where(F.col("ending").isin(*TEXT_ENDINGS))
    chosen = text.where(~F.coalesce(same, F.lit(False)) if others else same)
    return [r["path"] for r in chosen.select("path").take(LISTED_FILES + 1)]


def _read_kind(spark: SparkSession, path, manifest: DataFrame, kind, alone: bool, endings) -> DataFrame:
    """The rows of the files of one kind, as text, with their file.

    Files are told apart by a condition on their path, which Spark applies when it lists them: those of
    the kind, or all text files but the others, whichever are few. Where neither are, the kind's paths
    are streamed to the reader, which keeps a list of its files in any case.
    """
    names = header_names(next(csv.reader([kind["header"].rstrip("\r")], delimiter=kind["delimiter"], skipinitialspace=True)))
    where, keep = path, _text_files(endings)
    if not alone:
        mine = _paths(manifest, kind)
        others = _paths(manifest, kind, others=True) if len(mine) > LISTED_FILES else []
        if len(mine) <= LISTED_FILES:
            keep = F.col("_metadata.file_path").isin(mine)
        elif len(others) <= LISTED_FILES:
            keep = keep & ~F.col("_metadata.file_path").isin(others)
        else:
            every = manifest.where((F.col("delimiter") == kind["delimiter"]) & (F.col("header") == kind["header"]))
            where, keep = [unquote(r["path"]) for r in every.select("path").toLocalIterator()], None
    return read_delimited(
        spark, where, names, kind["delimiter"], kind["encoding"], bool(kind["spans"]), path_column=_FILE, keep=keep
    )


def _read_sheet(cells: DataFrame, sheet: str | None) -> DataFrame | None:
    """The rows of one sheet (the first by default) of all readable workbooks, columns by name."""
    broken = cells.where(F.col("error").isNotNull()).select("path").distinct()
    chosen = cells.join(F.broadcast(broken) if broken.count() <= LISTED_FILES else broken, "path", "left_anti")
    chosen = chosen.where((F.col("sheet_no") == 0 if sheet is None else F.col("sheet") == sheet) & (F.col("row") > 0))
    # the columns of all headers, in order of their place: the schema, a row per column
    heads = chosen.where("name IS NOT NULL").groupBy("name").agg(F.min("col").alias("col"))
    names = [r["name"] for r in heads.orderBy("col", "name").collect()]
    if not names:
        return None
    values = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    rows = chosen.where("row > 1").groupBy("path", "row").agg(*values)
    return rows.select(*(F.col(quoted(n)) for n in names), F.col("path").alias(_FILE))


def load_folder(
    spark: SparkSession,
    path: str | list[str],
    sheet: str | None = None,
    endings: tuple[str, ...] = fixed.QUALITY_ENDINGS,
    path_column: str | None = None,
) -> LoadedFolder:
    """All admitted files of a folder (or one file) as one typed table.

    Delimited files are read by their own encoding, delimiter and header, workbooks by their first sheet
    or the one named; columns meet by name, and a file without a column has nulls there. Types are voted
    on by all rows together. ``path_column`` adds the path of each row's file. Refused is raised where
    there is nothing to read: no such path, no file with an admitted ending, no readable one.
    """
    shared_root(spark)
    try:
        listed = inventory(spark, path).checkpoint()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise Refused(f"{fixed.NOT_FOUND}{path}") from None
        raise
    ended = {r["ending"] for r in listed.select("ending").distinct().limit(1000).collect()}
    admitted = ended & set(endings)
    if not ended:
        raise Refused(f"{fixed.NOT_FOUND}{path}")
    if not admitted:
        raise Refused(f"{fixed.WRONG_TYPE[0]}{', '.join(sorted(ended))}{fixed.WRONG_TYPE[1]}{', '.join(endings)}")
    sniffed = sniff(spark, path, keep=_text_files(endings)) if admitted & set(TEXT_ENDINGS) else None
    cells = _books(spark, path) if admitted & set(BOOK_ENDINGS) else None
    manifest = _manifest(listed, sniffed, cells, endings).checkpoint()
    kinds = _kinds(manifest)
    parts = [_read_kind(spark, path, manifest, kind, len(kinds) == 1, endings) for kind in kinds]
    if cells is not None:
        table = _read_sheet(cells, sheet)
        parts += [table] if table is not None else []
    if not parts:
        why = manifest.where("reason != ''").select(F.max("reason")).first()[0]
        raise Refused(why or (f"Sheet not found: {sheet}" if sheet else f"No readable file at {path}"))
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in raw.columns if c != _FILE]
    text = normalise_missing(raw.select(*(F.col(quoted(n)) for n in names)))
    if path_column:
        whole = normalise_missing(raw).withColumnRenamed(_FILE, path_column)
        verdicts = vote(text, names)
        df = apply_verdicts(whole, verdicts).select(path_column, *(F.col(quoted(n)) for n in names))
    else:
        verdicts = vote(text, names)
        df = apply_verdicts(text, verdicts)
    return LoadedFolder(df, verdicts, _facts(manifest, sheet), manifest)


def _facts(manifest: DataFrame, sheet: str | None) -> dict:
    """What the reports say about the source: sums, and the values where all files agree or a few differ."""
    read = manifest.where(F.col("status").isin("ok", "fallback"))
    some = lambda c: F.array_sort(F.collect_set(c))  # noqa: E731 - encodings and delimiters are a handful
    sums = read.agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"),
        some("encoding").alias("encodings"), some("delimiter").alias("delimiters"), F.min("file").alias("file"),
        F.count("sheets").alias("books"), F.max("sheets").alias("sheets"),
    ).first()
    of_books = ["n/a (workbook)"] if sums["books"] else []
    facts = {
        "files": sums["files"], "bytes": sums["bytes"], "lines": sums["lines"], "sampled": False,
        "encoding": ", ".join(sums["encodings"] + of_books), "delimiter": ", ".join(sums["delimiters"] + of_books),
    }
    if sums["files"] == 1:
        facts["file"] = sums["file"]
    if sums["books"] == 1:  # those of several workbooks are in the status
        facts.update(sheets_available=sums["sheets"], sheet=sheet or sums["sheets"][0])
    return facts


def _told(spark: SparkSession, message: str) -> DataFrame:
    return spark.createDataFrame([(0, message)], "line_no int, line string")


def quality_report(
    spark: SparkSession, path: str | list[str], sheet: str | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """(line_no, line): the quality report of a file or folder, or one line that says why there is none."""
    try:
        loaded = load_folder(spark, path, sheet)
    except Refused as e:
        return _told(spark, f"SECURITY_ERROR: {e}")
    # the report reads the table several times, the files only once more
    return render.quality_report_lines(loaded.df.checkpoint(), order_by, source=loaded.source)


def analysis_report(spark: SparkSession, path: str | list[str], **columns) -> DataFrame:
    """(block, place, line): the analysis report, with breakdowns where the named columns are there.

    ``columns`` are those of ``render.analysis_report_lines``: product, region, revenue, units.
    """
    try:
        loaded = load_folder(spark, path, endings=fixed.ANALYSIS_ENDINGS)
    except Refused as e:
        return _told(spark, f"SECURITY_ERROR: {e}").select(
            F.lit(0).alias("block"), F.col("line_no").alias("place"), "line"
        )
    lines = render.analysis_report_lines(loaded.df, file=loaded.source.get("file"), **columns)
    return lines.select("block", "place", "line")
