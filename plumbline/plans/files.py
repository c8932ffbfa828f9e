"""Files that Spark writes from the given tables, for the queries that read files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.views import every, table
from plumbline.session import scratch_path


def write_csv(df: DataFrame, label: str, **options) -> str:
    path = scratch_path(df.sparkSession, label)
    settings = {
        "header": True,
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        **options,
    }
    df.write.options(**settings).csv(path)
    return path


def write_ordered(df: DataFrame, key: str) -> str:
    """Files that hold the rows by ``key``, from the first file to the last."""
    texts = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns), F.col(key).alias("__key"))
    return write_csv(texts.orderBy("__key").drop("__key"), "ordered", maxRecordsPerFile=4000)


def write_ragged(spark: SparkSession, sf_dir: str) -> str:
    """Order lines with short and long records, quoted delimiters and blank lines."""
    start = F.concat_ws(";", F.col("o_orderkey"), F.col("o_custkey"))
    status = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit(';""x"""'))
    full = F.concat_ws(";", start, status, F.col("o_orderpriority"))
    line = (
        F.when(every("o_orderkey", 7), F.concat(full, F.lit(";;late")))
        .when(every("o_orderkey", 11), F.concat(full, F.lit(";extra")))
        .when(every("o_orderkey", 5), start)
        .otherwise(full)
    )
    blank = F.when(every("o_orderkey", 9), "\n").otherwise("")
    path = scratch_path(spark, "ragged")
    table(spark, sf_dir, "orders").select(F.concat(line, blank).alias("value")).write.text(path)
    return path


def _sheet_xml(rows: list[list]) -> str:
    out = []
    for r, row in enumerate(rows, start=1):
        cells = []
        for c, value in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(value, str):
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{value}</v></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    return f'<worksheet xmlns="{main}"><sheetData>{"".join(out)}</sheetData></worksheet>'


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A minimal .xlsx container."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    entries, links = [], []
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for i, (name, rows) in enumerate(sheets.items(), start=1):
            entries.append(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>')
            links.append(
                f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/s{i}.xml"/>'
            )
            book.writestr(f"xl/worksheets/s{i}.xml", _sheet_xml(rows))
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(entries)}</sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{package}">{"".join(links)}</Relationships>',
        )
    return buffer.getvalue()


def _customer_book(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("c_custkey")
    people = group[["c_custkey", "c_name", "c_mktsegment"]]
    money = group[["c_custkey", "c_acctbal"]]
    sheets = {
        name: [list(part.columns), *part.astype(object).values.tolist()]
        for name, part in (("People", people), ("Money", money))
    }
    path = f"book-{group['book'].iloc[0]}.xlsx"
    return pd.DataFrame({"path": [path], "content": [workbook_bytes(sheets)]})


def customer_workbooks(spark: SparkSession, sf_dir: str, per_book: int = 500) -> DataFrame:
    """Workbooks of up to ``per_book`` customers each, as (path, content) rows."""
    book = F.floor(F.col("c_custkey") / per_book).alias("book")
    return (
        table(spark, sf_dir, "customer")
        .select("*", book)
        .groupBy("book")
        .applyInPandas(_customer_book, "path string, content binary")
    )


def _write_books(rows: list, folder: str) -> None:
    """Puts (path, content) rows into a folder that every executor reaches."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        store, root = fs.FileSystem.from_uri(folder)
    else:
        store, root = fs.LocalFileSystem(), folder
    store.create_dir(root, recursive=True)
    for row in rows:
        with store.open_output_stream(f"{root}/{row['path']}") as out:
            out.write(row["content"])


def write_customer_folder(spark: SparkSession, sf_dir: str) -> str:
    """Customers as four kinds of files, by key modulo four, and files that no table is made of.

    Commas with quoted line feeds; tabs; semicolons in Latin-1 with other columns in another order; and
    workbooks whose columns are in yet another order.
    """
    folder = scratch_path(spark, "customers")
    customers = table(spark, sf_dir, "customer").withColumn("kind", F.col("c_custkey") % 4)
    columns = ["c_custkey", "c_name", "c_mktsegment"]

    def write(kind: int, rows: DataFrame, ending: str, **options):
        mine = rows.where(F.col("kind") == kind).drop("kind").repartition(2, "c_custkey")
        settings = {"header": True, "escape": '"', "extension": ending, "ignoreTrailingWhiteSpace": False, **options}
        mine.write.options(**settings).csv(f"{folder}/{ending}")

    spanning = F.when(F.col("c_custkey") % 8 == 0, F.concat("c_mktsegment", F.lit("\nline, two"))).otherwise(F.col("c_mktsegment"))
    write(0, customers.select("kind", "c_custkey", "c_name", spanning.alias("c_mktsegment")), "csv")
    write(1, customers.select("kind", *columns), "tsv", sep="\t")
    named = F.concat("c_name", F.lit(" é")).alias("c_name")
    write(2, customers.select("kind", named, "c_nationkey", "c_custkey"), "txt", sep=";", encoding="ISO-8859-1")
    books = customers.where("kind = 3").withColumn("book", F.floor(F.col("c_custkey") / 2000))
    made = books.groupBy("book").applyInPandas(_turned_book, "path string, content binary")
    made.foreachPartition(lambda rows: _write_books(rows, f"{folder}/books"))
    customers.select("c_custkey").limit(3).coalesce(1).write.json(f"{folder}/json")
    broken = [{"path": "broken.xlsx", "content": b"no workbook"}, {"path": "old.xls", "content": b"old"}]
    spark.sparkContext.parallelize(broken, 1).foreachPartition(lambda rows: _write_books(rows, f"{folder}/broken"))
    return folder


def _turned_book(group: pd.DataFrame) -> pd.DataFrame:
    rows = group.sort_values("c_custkey")[["c_mktsegment", "c_name", "c_custkey"]].astype(object)
    sheets = {"People": [list(rows.columns), *rows.values.tolist()], "Other": [["x"], [1]]}
    return pd.DataFrame({"path": [f"book-{group['book'].iloc[0]}.xlsx"], "content": [workbook_bytes(sheets)]})


#: Files of each kind that ``write_order_folder`` writes.
ORDER_FILES = 4


def write_order_folder(raw: DataFrame) -> str:
    """Rows of ``raw`` in files with semicolons and files with commas, by the order."""
    folder = scratch_path(raw.sparkSession, "orders")
    for half, sep in enumerate(";,"):
        part = raw.where(F.col("order_id").cast("long") % 2 == half).repartition(ORDER_FILES, "order_id")
        part.write.options(header=True, sep=sep).csv(f"{folder}/{half}")
    return folder
