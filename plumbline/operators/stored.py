"""Profiles of a folder that grows: what was counted of a file is stored and merged, and no file is read twice.

Of every file the store keeps, per column, the counters of cells and of the type vote and a sketch of the
distinct values, and, per distinct row, a digest of 128 bits. Counters add up, sketches have a union, and rows
with equal digests are copies. So the profile of a folder with one more file reads that file only.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import coercion, profile
from plumbline.operators.coercion import Verdict, quoted
from plumbline.session import shared_root
from plumbline.sources.delimited import LISTED_FILES, load_table
from plumbline.sources.sniff import list_files

_FILE = "__file"
_VERSION = ["path", "bytes", "modified"]

#: Distinct values per column are estimated from 2**12 registers: a standard error of 1.6 per cent.
SKETCH = 12

_COLUMNS = "batch string, path string, bytes long, modified timestamp, position int, name string, rows long, missing long, votes array<long>, sketch binary"
_ROWS = "batch string, path string, a long, b long, n long"


class ProfileStore:
    """The stored counts of the files of one table, in the folder ``root``.

    A version of a file is its path, size and time of change; a file that changed is counted anew, and one
    that is gone counts no more. An update that fails half way leaves rows of a batch that no column
    record names; they are ignored. Run one update of a store at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _listed(self, path: str) -> DataFrame:
        changed = F.col("_metadata.file_modification_time").cast("timestamp").alias("modified")
        return list_files(self.spark, path, changed)

    def update(self, path: str, **options) -> int:
        """Count the files below ``path`` that the store does not know yet; how many there were.

        ``options`` are those of ``load_table`` on encoding, delimiter, names, header and multiline. All of a
        new store's files are read at once, later ones in lots of a thousand.
        """
        shared_root(self.spark)
        known = self._table("columns", _COLUMNS).select(*_VERSION).distinct()
        new = self._listed(path).join(known, _VERSION, "left_anti").checkpoint()
        count = new.count()
        if count and known.isEmpty():
            self._count(path, new, options)
            return count
        done = None
        for _ in range(0, count, LISTED_FILES):
            rest = new if done is None else new.where(F.col("path") > done)
            lot = [r["path"] for r in rest.orderBy("path").select("path").take(LISTED_FILES)]
            done = lot[-1]
            mine = rest.where(F.col("path") <= done)
            self._count([unquote(p) for p in lot], mine, options)
        return count

    def _count(self, path: str | list[str], new: DataFrame, options: dict) -> None:
        """Append the counts of the files ``new``, which are those at ``path``, under a batch of their own."""
        batch = F.lit(uuid.uuid4().hex).alias("batch")
        try:
            text = load_table(self.spark, path, path_column=_FILE, typed=False, **options).df
        except ValueError as e:
            if "No readable file" not in str(e):
                raise
            text = self.spark.createDataFrame([], f"{_FILE} string")
        names = [c for c in text.columns if c != _FILE]
        ordered = [F.col(quoted(c)) for c in sorted(names)]
        if names:
            # columns without a value leave no trace, so that rows of files with and without them can be equal
            told = F.concat(*(F.when(c.isNotNull(), F.lit(f"{n}\0")).otherwise("") for n, c in zip(sorted(names), ordered)))
            digests = text.select(
                F.col(_FILE).alias("path"),
                F.xxhash64(told, *ordered).alias("a"),
                F.xxhash64(*ordered, told, F.lit(1)).alias("b"),
            )
            digests.groupBy("path", "a", "b").agg(F.count("*").alias("n")).select(batch, "path", "a", "b", "n").write.mode(
                "append"
            ).parquet(f"{self.root}/rows")
        places = [str(i) for i in range(len(names))]
        cells = text.select(F.col(_FILE).alias("path"), *(F.col(quoted(n)).alias(p) for n, p in zip(names, places)))
        counted = self.spark.createDataFrame([], "path string, position int, rows long, missing long, votes array<long>, sketch binary")
        if names:
            counted = (
                cells.unpivot(["path"], places, "position", "value")
                .select("path", F.col("position").cast("int").alias("position"), *coercion.looked_at())
                .groupBy("path", "position")
                .agg(
                    F.count("*").alias("rows"),
                    F.count_if(F.col("value").isNull()).alias("missing"),
                    F.array(*coercion.ballots()).alias("votes"),
                    F.hll_sketch_agg("value", F.lit(SKETCH)).alias("sketch"),
                )
            )
        called = F.get(F.array(*map(F.lit, names)), F.col("position")) if names else F.lit(None).cast("string")
        # a file without rows is known all the same
        new.join(counted, "path", "left").select(
            batch, *_VERSION, "position", called.alias("name"), "rows", "missing", "votes", "sketch"
        ).write.mode("append").parquet(f"{self.root}/columns")

    def _current(self, path: str) -> DataFrame:
        """The column records of the files as they are now, each of its last batch."""
        records = self._table("columns", _COLUMNS).join(self._listed(path), _VERSION, "left_semi")
        last = records.groupBy(*_VERSION).agg(F.max("batch").alias("batch"))
        return records.join(last, [*_VERSION, "batch"], "left_semi")

    def verdicts(self, path: str) -> list[Verdict]:
        """The types that all rows of the folder vote for, from the stored votes."""
        votes = self._current(path).where("name IS NOT NULL").select("name", "position", F.posexplode("votes"))
        sums = votes.groupBy("name", "pos").agg(F.sum("col").alias("n"), F.min("position").alias("position"))
        per_column = sums.groupBy("name").agg(
            F.min("position").alias("position"),
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda s: s["n"]).alias("votes"),
        )
        found = per_column.orderBy("position", "name").collect()
        return [coercion.verdict(r["name"], r["votes"]) for r in found]

    def columns(self, path: str) -> DataFrame:
        """The column profile of the folder, as ``profile.column_profile(exact=False)`` has it.

        Values that the voted type cannot hold count as missing, and so do the cells of files without the
        column. Distinct values are estimated, and counted as they are written: 1 and 1.0 are two.
        """
        found = self.verdicts(path)
        current = self._current(path)
        per_file = current.groupBy(*_VERSION).agg(F.max("rows").alias("rows"))
        total = F.lit(per_file.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
        kinds = [(v.name, i, v.kind, v.lost) for i, v in enumerate(found)]
        kinds = self.spark.createDataFrame(kinds, "name string, position int, dtype string, lost long")
        merged = current.where("name IS NOT NULL").groupBy("name").agg(
            F.sum(F.col("rows") - F.col("missing")).alias("present"),
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique"),
        )
        at = kinds.join(merged, "name").select(
            F.lit("table").alias("table_name"), "position", "name", "dtype", total.alias("rows"),
            (total - F.col("present") + F.col("lost")).alias("missing"),
            # the estimate of one value is exact, of many it may pass their number
            F.least("unique", "present").alias("unique"),
        )
        return profile.percentages(at)

    def duplicate_rows(self, path: str) -> DataFrame:
        """How many rows repeat another one as it is written, by 128 bits of its digest; no file is read."""
        batches = self._current(path).select("batch", "path").distinct()
        rows = self._table("rows", _ROWS).join(batches, ["batch", "path"], "left_semi")
        copies = rows.groupBy("a", "b").agg((F.sum("n") - 1).alias("n"))
        return copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))

    def profile(self, path: str, text_is_typed: bool = False) -> DataFrame:
        """The quality profile of the folder from what is stored; call ``update`` first."""
        copies = self.duplicate_rows(path).withColumn("table_name", F.lit("table"))
        return profile.table_profile({}, text_is_typed=text_is_typed, columns=self.columns(path), copies=copies)
