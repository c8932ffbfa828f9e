"""Benchmark decontamination by winnowing.

Of every run of ``w`` consecutive k-grams the smallest hash is a fingerprint, with w + k - 1 equal to
the window. So each shared window gives a shared fingerprint, on both sides the same. Documents and
items meet on fingerprints; a hit is extended by comparing the words of all windows of that item with
the document, so nothing rests on hashes alone.

An item shorter than the window is one window and has one fingerprint of its own length; documents are
asked for n-grams of just those lengths. Documents send only fingerprints that pass a bitmap of the
items', so the shuffle follows the hits.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bitmap import bitmap_of, maybe_in
from plumbline.llm.common import LOWER, TEXT_BATCH, UPPER, written
from plumbline.llm.wordhash import ALPHANUMERIC, mix, ngrams, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CASE = str.maketrans(UPPER, LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_CASE))


def _fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """Distinct fingerprints of one row's words for shared spans of ``window`` words."""
    k = (window + 1) // 2
    grams = ngrams(hashes, k)
    w = window - k + 1
    if len(grams) < w:
        return np.zeros(0, dtype=np.uint64)
    smallest = grams[: len(grams) - w + 1].copy()
    for j in range(1, w):
        np.minimum(smallest, grams[j : len(grams) - w + 1 + j], out=smallest)
    changes = np.ones(len(smallest), dtype=bool)
    changes[1:] = smallest[1:] != smallest[:-1]
    return np.unique(smallest[changes])


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of n words, apart from those of full windows."""
    return mix(ngrams(hashes, n) ^ np.uint64(n << 56))


def item_fingerprints(items: DataFrame, window: int) -> DataFrame:
    """(item_row, item_id, text, n_words, fp array) of the items that have words."""

    def sign(batches):
        for batch in batches:
            sizes, prints = [], []
            for part in words_of(batch.column("text"), ALPHANUMERIC):
                for r in range(part.rows):
                    own = part.hashes[part.bounds[r] : part.bounds[r + 1]]
                    sizes.append(len(own))
                    fp = _fingerprints(own, window) if len(own) >= window else _short(own, max(1, len(own)))
                    prints.append(fp.view(np.int64))
            columns = [batch.column("item_id").cast(pa.string()), batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))],
                ["item_id", "text", "n_words", "fps"],
            )

    signed = items.select("item_id", "text").mapInArrow(sign, "item_id string, text string, n_words long, fps array<long>")
    return written(
        signed.filter("n_words > 0").withColumn("item_row", F.monotonically_increasing_id()), "bench-items"
    )


def _mark(doc: list[str], items: list[tuple[str, list[str]]], window: int) -> tuple[np.ndarray, list[str]]:
    """Words inside any window of any item, and the ids of the items that have such windows."""
    hit, found = np.zeros(len(doc), dtype=bool), set()
    by_length: dict[int, dict[tuple, set[str]]] = {}
    for item_id, said in items:
        n = min(window, len(said))
        table = by_length.setdefault(n, {})
        for i in range(len(said) - n + 1):
            table.setdefault(tuple(said[i : i + n]), set()).add(item_id)
    for n, table in by_length.items():
        heads = {w[0] for w in table}
        for i in range(len(doc) - n + 1):
            if doc[i] in heads and (ids := table.get(tuple(doc[i : i + n]))):
                hit[i : i + n] = True
                found |= ids
    return hit, sorted(found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, spans, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z. ``n_hit`` counts
    words inside an occurrence of a window of ``window`` consecutive words of an item; an item of fewer
    words is one window, one without words is none. ``spans`` lists the hit words as (first, behind).
    ``items_sha256`` digests the ids of the found items as strings, sorted and joined by commas; a null
    id counts as an empty one, items of equal id count once. A null text has no words. Rows of equal id
    are judged by their own texts. Empty tables and other columns are fine.
    """
    items = item_fingerprints(benchmark, window)
    prints = items.select("item_row", F.explode("fps").alias("fp"))
    wanted = bitmap_of(prints, "fp")
    short = sorted(r[0] for r in items.filter(F.col("n_words") < window).select("n_words").distinct().collect())

    def sign(batches):
        for batch in batches:
            texts, sizes, prints = batch.column("text"), [], []
            kept = np.zeros(batch.num_rows, dtype=bool)
            for part in words_of(texts, ALPHANUMERIC):
                for r in range(part.rows):
                    own = part.hashes[part.bounds[r] : part.bounds[r + 1]]
                    sizes.append(len(own))
                    fp = [_fingerprints(own, window)] + [_short(own, n) for n in short if len(own) >= n]
                    fp = np.unique(np.concatenate(fp)).view(np.int64)
                    fp = fp[maybe_in(wanted, fp)]
                    kept[part.first + r] = len(fp) > 0
                    prints.append(fp)
            text = pa.array([t.as_py() if k else None for t, k in zip(texts, kept)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), text, pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))],
                ["doc_id", "text", "n_words", "fps"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("doc_id", "text").mapInArrow(
        sign, f"doc_id {kind}, text string, n_words long, fps array<long>"
    )
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "bench-docs", TEXT_BATCH)
    met = (
        signed.select("row", F.explode("fps").alias("fp"))
        .join(prints, "fp")
        .select("row", "item_row")
        .distinct()
        .join(items.select("item_row", F.struct("item_id", F.col("text").alias("item_text")).alias("item")), "item_row")
        .groupBy("row")
        .agg(F.collect_list("item").alias("items"))
    )

    def extend(batches):
        for batch in batches:
            n_hit, spans, n_items, digest = [], [], [], []
            for text, items in zip(batch.column("text"), batch.column("items")):
                hit, found = np.zeros(0, dtype=bool), []
                if items.is_valid:
                    named = [(i["item_id"] or "", words(i["item_text"])) for i in items.as_py()]
                    hit, found = _mark(words(text.as_py()), named, window)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                n_hit.append(int(hit.sum()))
                spans.append([{"first": int(a), "behind": int(b)} for a, b in edges.reshape(-1, 2)])
                n_items.append(len(found))
                digest.append(hashlib.sha256(",".join(found).encode()).hexdigest())
            span = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()),
                    pa.array(spans, span), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()),
                    pa.array([n > 0 for n in n_hit], pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "spans", "n_items", "items_sha256", "contaminated"],
            )

    joined = signed.join(met, "row", "left").select("doc_id", "n_words", "text", "items")
    return joined.mapInArrow(
        extend,
        f"doc_id {kind}, n_words long, n_hit long, spans array<struct<first:long,behind:long>>, n_items long, "
        "items_sha256 string, contaminated boolean",
    )
