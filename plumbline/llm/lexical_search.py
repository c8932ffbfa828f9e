"""Ranked lexical search that scores bags of words once.

For the items' words alone, many documents are the same bag: equal counts of the items' terms and an equal
length factor m. Documents are restricted to the items' vocabulary, dealt by the hash of (counts, m) and
grouped by the counts themselves, so classes rest on no hash. A class is scored once against all items,
and its members, in ascending order of doc_id, take its score.

Items are worked in blocks of bounded vocabulary, each against all documents. A block's vocabulary, with
its weights, is all that tasks are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import TEXT_BATCH, written
from plumbline.llm.wordhash import ALPHANUMERIC, words_of

#: Distinct (item, term) pairs in a block of items, on average; a block holds whole items.
BLOCK_TERMS = 1 << 19

#: Cells (class, item) and products that a task holds at once.
CELLS = 1 << 20

_MATCH_SCHEMA = "item_row long, score long, class long, m long, vec binary, first_id long"


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_row, item_id, terms, counts): the hashes of an item's terms, ascending, and their numbers."""

    def sign(batches):
        for batch in batches:
            terms, counts = [], []
            for part in words_of(batch.column("text"), ALPHANUMERIC):
                for r in range(part.rows):
                    own = part.hashes[part.bounds[r] : part.bounds[r + 1]].view(np.int64)
                    distinct, times = np.unique(own, return_counts=True)
                    terms.append(distinct)
                    counts.append(times)
            lists = [pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *lists], ["item_id", "terms", "counts"])

    kind = items.schema["item_id"].dataType.simpleString()
    signed = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(
        sign, f"item_id {kind}, terms array<long>, counts array<long>"
    )
    return written(signed.withColumn("item_row", F.monotonically_increasing_id()), "search-items", TEXT_BATCH)


def _bags(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, vec) of the documents with terms: all terms counted, and pairs (term number, tf) as bytes."""

    def count(batches):
        for batch in batches:
            for part in words_of(batch.column("text"), ALPHANUMERIC):
                hashes = part.hashes.view(np.int64)
                n = np.diff(part.bounds)
                row = np.repeat(np.arange(part.rows), n)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                keys, tf = np.unique(row[known] * len(vocabulary) + at[known], return_counts=True)
                pairs = np.column_stack([keys % len(vocabulary), tf]).astype("<u4")
                bounds = np.searchsorted(keys, np.arange(part.rows + 1) * len(vocabulary)) * 8
                buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(pairs.tobytes())]
                vec = pa.Array.from_buffers(pa.binary(), part.rows, buffers)
                ids = batch.column("doc_id").slice(part.first, part.rows)
                found = pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), vec], ["doc_id", "n", "vec"])
                yield found.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(count, "doc_id long, n long, vec binary"), "search-bags", TEXT_BATCH)


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers and counts of all bags of a batch, and where each bag begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    pairs = raw.view("<u4").reshape(-1, 2)
    return pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64), (bounds - bounds[0]).astype(np.int64) // 8


def _document_frequencies(bags: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; a task sends one number per term at most."""

    def count(batches):
        seen = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(_pairs(batch.column("vec"))[0], minlength=terms)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "df"])

    out = np.zeros(terms, dtype=np.int64)
    counts = bags.select("vec").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df"))
    for term, df in counts.collect():
        out[term] = df
    return out


def _weights(spark: SparkSession, documents: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) of every term, by the engine's own logarithm."""
    held = np.unique(df)
    rows = spark.createDataFrame([(int(d),) for d in held], "df long")
    ratio = (F.lit(2.0) * F.lit(documents) + 2) / (F.lit(2.0) * F.col("df") + 1)
    known = dict(rows.select("df", F.floor(1000 * F.log(ratio)).cast("long")).collect())
    return np.array([known[int(d)] for d in held], dtype=np.int64)[np.searchsorted(held, df)]


def _cut(item: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of every item's k best: highest score, then smallest first member; items ascend."""
    order = np.lexsort((first, -score, item))
    item = item[order]
    return order[np.arange(len(item)) - np.searchsorted(item, item) < k]


class _Best:
    """The best classes of every item so far; of others, nothing is held."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.zeros(items, dtype=np.int64)  # the k-th best score, once there are k
        self.columns: list[np.ndarray] | None = None

    def add(self, item: np.ndarray, score: np.ndarray, first: np.ndarray, others):
        """``others(places)`` gives the further columns of rows at these places; it is asked for few."""
        places = _cut(item, score, first, self.k)
        new = [item[places], score[places], first[places], *others(places)]
        if self.columns is not None:
            new = [np.concatenate(pair) for pair in zip(self.columns, new)]
            kept = _cut(*new[:3], self.k)
            new = [c[kept] for c in new]
        self.columns = new
        item, score = new[:2]
        last = np.arange(len(item)) - np.searchsorted(item, item) == self.k - 1
        self.least[item[last]] = score[last]


def _match(classes: DataFrame, asked: list, vocabulary: np.ndarray, weight: np.ndarray, k: int) -> DataFrame:
    """Per item the k best classes of every task, so that the shuffle follows tasks times items."""
    item_rows = np.array([r for r, _, _ in asked], dtype=np.int64)
    # postings by term: which items ask for it, how often
    term = np.searchsorted(vocabulary, np.concatenate([t for _, t, _ in asked]))
    order = np.argsort(term, kind="stable")
    item = np.repeat(np.arange(len(asked)), [len(t) for _, t, _ in asked])[order]
    times = np.concatenate([c for _, _, c in asked])[order]
    begin = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    uses = np.diff(begin)
    nobody = np.iinfo(np.int64).max

    def score(batches):
        best = _Best(len(asked), k)
        for batch in batches:
            first = batch.column("first_id").fill_null(nobody).to_numpy(zero_copy_only=False)
            ids, factors, vec = batch.column("class"), batch.column("m").to_numpy(), batch.column("vec")
            terms, tf, bounds = _pairs(vec)
            products = np.concatenate([[0], np.cumsum(uses[terms])])[bounds]
            row = 0
            while row < batch.num_rows:
                end = int(np.searchsorted(products, products[row] + CELLS, side="right")) - 1
                end = min(max(end, row + 1), row + max(1, CELLS // len(asked)), batch.num_rows)
                a, b = bounds[row], bounds[end]
                own, size = terms[a:b], np.diff(bounds[row : end + 1])
                m = np.repeat(factors[row:end], size)
                gain = weight[own] * ((1_000_000_000 * tf[a:b]) // (1000 * tf[a:b] + 12 * m))
                n = uses[own]
                ends = np.cumsum(n)
                posting = np.arange(int(n.sum())) + np.repeat(begin[own] - (ends - n), n)
                value = np.repeat(gain, n) * times[posting]
                cell = np.repeat(np.repeat(np.arange(end - row), size), n) * len(asked) + item[posting]
                # sums of doubles are exact below 2**53, so high and low parts are summed apart
                cells = (end - row) * len(asked)
                total = np.bincount(cell, (value >> 26).astype(float), cells).astype(np.int64) << 26
                total += np.bincount(cell, (value & ((1 << 26) - 1)).astype(float), cells).astype(np.int64)
                total = total.reshape(end - row, len(asked))
                r, i = np.nonzero((total > 0) & (total >= best.least))
                if len(r):

                    def others(places):
                        at = pa.array(row + r[places])
                        bags = np.empty(len(places), dtype=object)
                        bags[:] = vec.take(at).to_pylist()
                        return [ids.take(at).to_numpy(), factors[row + r[places]], bags]

                    best.add(i, total[r, i], first[row + r], others)
                row = end
        if best.columns is not None:
            i, total, first, ids, m, bags = best.columns
            yield pa.RecordBatch.from_arrays(
                [pa.array(item_rows[i]), pa.array(total), pa.array(ids), pa.array(m), pa.array(bags, pa.binary()),
                 pa.array(first, mask=first == nobody)],
                ["item_row", "score", "class", "m", "vec", "first_id"],
            )

    return classes.select("class", "m", "vec", "first_id").mapInArrow(score, _MATCH_SCHEMA)


def _first_rows(df: DataFrame, keys: list[str], order: list, k: int, name: str) -> DataFrame:
    """The first k rows of every group; tasks cut their own rows to k before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= k)


def _search_block(docs: DataFrame, asked: list, k: int) -> DataFrame | None:
    """(item_row, rank, doc_id, score) of one block of items; None where nothing can be found."""
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate([t for _, t, _ in asked]))
    bags = _bags(docs, vocabulary)
    documents, length = bags.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    weight = _weights(spark, documents, _document_frequencies(bags, len(vocabulary)))
    m = F.expr(f"75L + cast(cast(n * 25L as decimal(38,0)) * {documents}L div {length}L as long)")
    members = bags.filter(F.length("vec") > 0).select("doc_id", "vec", m.alias("m"))
    members = members.withColumn("class", F.xxhash64("vec", "m"))
    classes = members.groupBy("class", "vec", "m").agg(F.min("doc_id").alias("first_id"))
    matched = _match(classes, asked, vocabulary, weight, k)
    # of an item's k best classes the k smallest members are all that its k best documents can be
    best_first = [F.desc("score"), F.asc_nulls_last("first_id")]
    winners = written(_first_rows(matched, ["item_row"], best_first, k, "place"), "search-classes")
    # one row of two numbers per class: at most k times the items of the block
    keys = winners.select("class", "m").distinct()
    near = members.join(F.broadcast(keys), ["class", "m"], "left_semi")
    few = _first_rows(near, ["class", "m", "vec"], [F.asc_nulls_last("doc_id")], k, "place").drop("place")
    pairs = winners.select("item_row", "score", "class", "m", "vec").join(few, ["class", "m", "vec"])
    by_score = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = _first_rows(pairs.select("item_row", "score", "doc_id"), ["item_row"], by_score, k, "rank")
    return ranked.select("item_row", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k documents of highest score above 0 for every item: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z. Equal scores go by
    ascending doc_id, rows without an id last; rank runs from 1 without gaps. Every row is a document, so
    rows of equal id are found each by itself. A null or empty text has no terms and neither finds nor is
    found. Items of equal or null id are answered each by itself. Empty tables give no rows; other columns
    are not looked at. Words are told apart by hashes of 64 bits.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    signed = _item_terms(items).filter(F.size("terms") > 0)
    (total,) = signed.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = -(-total // block_terms)
    answers = []
    for block in range(blocks):
        mine = signed.filter(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == block)
        rows = mine.select("item_row", "terms", "counts").orderBy("item_row").collect()
        asked = [(r, np.array(t, dtype=np.int64), np.array(c, dtype=np.int64)) for r, t, c in rows]
        found = _search_block(docs, asked, k) if asked else None
        if found is not None:
            answers.append(found if blocks == 1 else written(found, "search-answers"))
    if not answers:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    return every.join(signed.select("item_row", "item_id"), "item_row").select("item_id", "rank", "doc_id", "score")
