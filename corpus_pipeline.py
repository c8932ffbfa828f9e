"""From documents to shards: classify, deduplicate, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir) and gives the documents it keeps, with the columns it was given,
whatever their names; the last one gives the shard of each. ``doc_id`` names a document for near
duplicates and the mix: rows of equal id, and rows without an id, stay or go together there. Quality
and contamination are judged row by row, by the text. Tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard_join, mixing, quality, sharding
from plumbline.llm.common import written
from plumbline.plans.views import table

SHARDS = 40


def _whole(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name of theirs meets a name used here."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("_doc")


def _by_key(docs: DataFrame, key: Column, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose key is (left_semi) or is not (left_anti) in the one column of ``keys``; null equals null."""
    rows = docs.select(key.alias("_key"), _whole(docs))
    known = keys.toDF("_known").distinct()
    return rows.join(known, rows["_key"].eqNullSafe(known["_known"]), how).select("_doc.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of quality is below 0.3."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    whole = docs.select("doc_id", "text", _whole(docs))
    scored = quality.with_quality(whole, model, threshold=0.3)
    # a filter would be pushed below the statistics and evaluate them once per mention
    good = scored.select(F.explode(F.when(F.col("predicted") == 1, F.array("_doc"))).alias("_doc"))
    return good.select("_doc.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every component of five-word shingle sets at 0.8."""
    found = jaccard_join.near_duplicates(docs, k=5, percent=80)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    return _by_key(docs, F.col("doc_id"), first, "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words, or all words, of a benchmark item.

    Rows are told apart by id and text, so a clean row stays whatever rows share its id or have none.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("text", 256))
    found = decontaminate.contamination(
        docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), window=10
    )
    return _by_key(docs, key, found.filter("contaminated").select("doc_id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so often that the sources' words come near 5 : 2 : 1, none over three times."""
    mixed = mixing.mix(docs, weights=(5, 2, 1), limit=3)
    copies = mixed.groupBy(F.col("doc_id").alias("_taken_id")).agg(F.max("copies").alias("_copies"))
    copies = copies.filter("_copies > 0")
    rows = docs.select(F.col("doc_id").alias("_id"), _whole(docs))
    taken = rows.join(copies, rows["_id"].eqNullSafe(copies["_taken_id"]))
    times = F.sequence(F.lit(1).cast("long"), F.col("_copies"))
    return taken.select("_doc", F.explode(times).alias("_time")).select("_doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents into shards of nearly equal bytes; a document taken twice has two rows."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]

#: Models, components and knapsacks are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
