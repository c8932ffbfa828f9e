"""Workbooks (.xlsx): a folder of files to long rows of cells, and sheets to tables.

A workbook is one compressed container that only a single task can open; folders of them spread
over the cluster. Cells are streamed out of the container in batches.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.cleaning import header_names

CELLS = "path string, sheet string, sheet_no int, row int, col int, value string"
_BATCH = 50_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BUILT_IN_DATES = {*range(14, 23), *range(45, 48)}


def _parse(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    targets = {
        r.get("Id"): r.get("Target").lstrip("/")
        for r in _parse(book, "xl/_rels/workbook.xml.rels")
    }
    found = []
    for sheet in _parse(book, "xl/workbook.xml").iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(_REL)]
        found.append((sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return found


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [
        "".join(t.text or "" for t in item.iter(f"{_MAIN}t"))
        for item in _parse(book, "xl/sharedStrings.xml").iter(f"{_MAIN}si")
    ]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = _parse(book, "xl/styles.xml")
    dates = set(_BUILT_IN_DATES)
    for fmt in styles.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search("[ymdhs]", code, re.IGNORECASE):
            dates.add(int(fmt.get("numFmtId")))
    formats = styles.find(f"{_MAIN}cellXfs")
    return {
        i
        for i, xf in enumerate(formats if formats is not None else [])
        if int(xf.get("numFmtId", 0)) in dates
    }


def _number(text: str, is_date: bool) -> str:
    value = float(text)
    if is_date:
        moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(
            milliseconds=round(value * 86_400_000)
        )
        return moment.isoformat(sep=" ")
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _column(reference: str) -> int:
    n = 0
    for letter in reference:
        if not letter.isalpha():
            break
        n = n * 26 + ord(letter.upper()) - 64
    return n


def _cells(content: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """(sheet, sheet number, row, column, text) of every cell that holds something."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates = _shared_strings(book), _date_styles(book)
        for sheet_no, (sheet, target) in enumerate(_sheets(book)):
            row = col = 0
            with book.open(target) as part:
                for event, node in ElementTree.iterparse(part, ("start", "end")):
                    if node.tag == f"{_MAIN}row":
                        if event == "start":
                            row, col = int(node.get("r") or row + 1), 0
                        else:
                            node.clear()
                    elif node.tag == f"{_MAIN}c" and event == "end":
                        col = _column(node.get("r") or "") or col + 1
                        kind, raw = node.get("t", "n"), node.findtext(f"{_MAIN}v")
                        if kind == "inlineStr":
                            raw = "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
                        elif raw is not None and kind == "s":
                            raw = strings[int(raw)]
                        elif raw is not None and kind == "b":
                            raw = "True" if raw == "1" else "False"
                        elif raw and kind == "n":
                            raw = _number(raw, int(node.get("s") or 0) in dates)
                        if raw is not None and kind != "e":
                            yield sheet, sheet_no, row, col, raw


def _cells_of_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "sheet", "sheet_no", "row", "col", "value"]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            batch = []
            for cell in _cells(content):
                batch.append((path, *cell))
                if len(batch) == _BATCH:
                    yield pd.DataFrame(batch, columns=names)
                    batch = []
            yield pd.DataFrame(batch, columns=names)


def workbook_cells(files: DataFrame) -> DataFrame:
    """All cells of all workbooks, given the columns path and content."""
    return files.select("path", "content").mapInPandas(_cells_of_files, CELLS)


NAMED_CELLS = CELLS + ", name string, error string"


def _named_cells_of_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "sheet", "sheet_no", "row", "col", "value", "name", "error"]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            batch, current, header = [], None, {}
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    for sheet_no, (sheet, _) in enumerate(_sheets(book)):
                        batch.append((path, sheet, sheet_no, 0, 0, None, None, None))
                for sheet, sheet_no, row, col, value in _cells(content):
                    if sheet_no != current:
                        current, header, labels = sheet_no, {}, None
                    if row == 1:
                        header[col] = value
                        label = None
                    else:
                        if labels is None:
                            labels = header_names([header.get(c) for c in range(1, max(header, default=0) + 1)])
                        label = labels[col - 1] if col <= len(labels) else f"Unnamed: {col - 1}"
                    batch.append((path, sheet, sheet_no, row, col, value, label, None))
                    if len(batch) >= _BATCH:
                        yield pd.DataFrame(batch, columns=names)
                        batch = []
            except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is that file's status
                batch.append((path, None, -1, 0, 0, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(batch, columns=names)


def named_cells(files: DataFrame) -> DataFrame:
    """Cells with the name that their own workbook's header gives their column.

    Every sheet has a row of number 0, cells or not. A workbook that cannot be read to its end has a row
    with ``error``.
    """
    return files.select("path", "content").mapInPandas(_named_cells_of_files, NAMED_CELLS)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return workbook_cells(files)


def sheets_available(cells: DataFrame) -> DataFrame:
    return cells.groupBy("path", "sheet_no", "sheet").agg(
        F.countDistinct(F.when(F.col("row") > 1, F.col("row"))).alias("rows")
    )


def sheet_table(cells: DataFrame, sheet: str | None = None) -> DataFrame:
    """One sheet (the first by default) of all workbooks as a text table, header in row one.

    Only the header cells reach the driver. Grouping is by workbook row, never wider than a row.
    """
    chosen = cells.where(F.col("sheet_no") == 0 if sheet is None else F.col("sheet") == sheet)
    head = {
        r["col"]: r["value"]
        for r in chosen.where("row = 1").groupBy("col").agg(F.max("value").alias("value")).collect()
    }
    if not head:
        raise ValueError(f"Sheet not found: {sheet}")
    names = header_names([head.get(c) for c in range(1, max(head) + 1)])
    values = [
        F.max(F.when(F.col("col") == i, F.col("value"))).alias(n)
        for i, n in enumerate(names, start=1)
    ]
    return chosen.where("row > 1").groupBy("path", "row").agg(*values)
