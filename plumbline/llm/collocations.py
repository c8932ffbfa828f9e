"""Phrase collocations over a prefix-free parse of the corpus.

A document's words are cut where the hash of the next ``longest - 1`` words says so, which equal passages
do at equal places. A chunk runs to the next cut and over the words that trigger it, so every phrase lies
whole in the chunk that owns its first word, and in no other's share. Equal chunks are one entry of the
dictionary with a frequency; all counting reads the dictionary, and copies, however many, cost one entry.

Phrases are counted by length. A phrase cannot be frequent unless its parts are, so bitmaps of frequent
words, then of frequent pairs, keep other phrases from being shuffled. A fuller bitmap lets more through;
counts are of the phrases themselves and exact either way.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bitmap import bitmap_of, maybe_in
from plumbline.llm.common import written
from plumbline.llm.wordhash import hash_pieces, mix, ngrams, strings_at, text_slices

#: Words of a chunk, on average, without the overlap; and the most of them.
CHUNK, CHUNK_MOST = 24, 256

#: Rows of a word's count in the join with phrases, so that a word in most phrases is spread.
WORD_PIECES = 16

#: Pieces in which a language's best phrases are found first.
RANK_PIECES = 64

SPACE, BREAK = 0x20, 0x0A

_IS_BREAK = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_IS_WORD = ~_IS_BREAK & ~np.isin(np.arange(256), [0x20, 0x09])
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[0x41:0x5B] += 32


def chunks(docs: DataFrame, longest: int = 4) -> DataFrame:
    """(lang, own, chunk): the parse of all texts, lower-cased in A-Z.

    Words of a chunk are parted by a space, or by a line feed where a piece ends between them. Phrases that
    begin at its first ``own`` words are the chunk's to count. A null text is empty, a null lang ``und``.
    """
    overlap = longest - 1

    def parse(batches):
        for batch in batches:
            langs = batch.column("lang")
            for first, rows, data, offsets in text_slices(batch.column("text")):
                data = np.insert(_TO_LOWER[data], offsets[1:], BREAK)
                inside = _IS_WORD[data]
                edges = np.diff(inside.astype(np.int8), prepend=0)
                start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                if not len(start):
                    continue
                bounds = np.searchsorted(start, offsets + np.arange(rows + 1))
                # one byte between words: whether a piece ends there
                broken = np.concatenate([[0], np.cumsum(_IS_BREAK[data])])
                behind = np.append(start[1:], len(data))
                data[end] = np.where(broken[behind] > broken[end], BREAK, SPACE)
                inside[end] = True
                place = np.cumsum(inside) - 1
                data, begin, finish = data[inside], place[start], place[end]
                grams = ngrams(hash_pieces(data, begin, finish), overlap)
                cuts = np.flatnonzero(grams % np.uint64(CHUNK) == 0)
                row = np.searchsorted(bounds, cuts, side="right") - 1
                cuts = cuts[cuts + overlap <= bounds[row + 1]]
                cuts = np.union1d(cuts, bounds[:-1][np.diff(bounds) > 0])
                far = np.flatnonzero(np.diff(np.append(cuts, len(start))) > CHUNK_MOST)
                if len(far):
                    nexts = np.append(cuts[1:], len(start))
                    more = [np.arange(cuts[c] + CHUNK_MOST, nexts[c], CHUNK_MOST) for c in far]
                    cuts = np.union1d(cuts, np.concatenate(more))
                row = np.searchsorted(bounds, cuts, side="right") - 1
                own = np.diff(np.append(cuts, len(start)))
                last = np.minimum(cuts + own + overlap, bounds[row + 1]) - 1
                texts = strings_at(data, begin[cuts], finish[last])
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(first + row)), pa.array(own, pa.int32()), texts.cast(pa.string())],
                    ["lang", "own", "chunk"],
                )

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(parse, "lang string, own int, chunk string")


def dictionary(docs: DataFrame, longest: int = 4) -> DataFrame:
    """(lang, own, chunk, freq): the distinct chunks of the parse and how often each occurs."""
    return chunks(docs, longest).groupBy("lang", "own", "chunk").agg(F.count("*").alias("freq"))


@dataclass
class _Said:
    """The words of a batch of chunks or phrases: places in ``data``, rows, and hashes within the language."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    number: np.ndarray  # of the word in its row
    follows: np.ndarray  # whether the next word belongs to the same piece
    hashes: np.ndarray


def _said(langs: pa.Array, texts: pa.Array) -> _Said:
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    between = np.flatnonzero((data == SPACE) | (data == BREAK))
    start = np.sort(np.concatenate([offsets[:-1], between + 1]))
    end = np.sort(np.concatenate([between, offsets[1:]]))
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    coded = langs.dictionary_encode()
    salts = np.array([zlib.crc32(lang.encode()) for lang in coded.dictionary.to_pylist()], dtype=np.uint64)
    salt = salts[coded.indices.to_numpy()][row]
    return _Said(data, start, end, row, np.arange(len(start)) - bounds[row], np.append(data, BREAK)[end] == SPACE,
                 mix(hash_pieces(data, start, end) + (salt << np.uint64(32))))


def _counts(entries: DataFrame, sizes: tuple[int, ...], part: int, wanted: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f) of the phrases of these sizes whose parts of ``part`` words pass the bitmap."""

    def count(batches):
        for batch in batches:
            said = _said(batch.column("lang"), batch.column("chunk"))
            own, freq = batch.column("own").to_numpy(), batch.column("freq").to_numpy()
            mine = said.number < own[said.row]
            good = np.ones(len(said.start), dtype=bool)
            if wanted is not None:
                passed = maybe_in(wanted, ngrams(said.hashes, part) if part > 1 else said.hashes)
                good = np.concatenate([passed, np.zeros(part - 1, dtype=bool)])
            for size in sizes:
                least = len(said.start) - size + 1
                if least <= 0:
                    continue
                keep = mine[:least].copy()
                for j in range(size - 1):
                    keep &= said.follows[j : j + least]
                for j in range(size - part + 1):
                    keep &= good[j : j + least]
                at = np.flatnonzero(keep)
                phrases = strings_at(said.data, said.start[at], said.end[at + size - 1])
                found = pa.table({
                    "lang": batch.column("lang").take(pa.array(said.row[at])),
                    "phrase": phrases,
                    "f": pa.array(freq[said.row[at]], pa.int64()),
                })
                found = found.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
                found = found.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])
                found = found.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))
                yield from found.to_batches()

    parts = entries.mapInArrow(count, "lang string, phrase string, f long")
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(counts: DataFrame, part: int) -> np.ndarray:
    """The bitmap of phrases of ``part`` words."""

    def sign(batches):
        for batch in batches:
            said = _said(batch.column("lang"), batch.column("phrase"))
            hashes = ngrams(said.hashes, part)[said.number[: len(said.start) - part + 1] == 0] if part > 1 else said.hashes
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])

    return bitmap_of(counts.select("lang", "phrase").mapInArrow(sign, "hash long"), "hash")


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all words, and of all phrases of 2 to ``longest`` words with ``least`` or more."""
    entries = written(dictionary(docs, longest), "chunks")
    words = written(_counts(entries, (1,), 1, None), "words")
    levels, part, frequent = [], 1, words.filter(F.col("f") >= least)
    for sizes in ((2,), tuple(range(3, longest + 1))):
        if sizes and sizes[0] <= longest:
            counted = _counts(entries, sizes, part, _bitmap(frequent, part))
            frequent, part = written(counted.filter(F.col("f") >= least), "phrases"), 2
            levels.append(frequent)
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    return words, phrases


def _best_cuts(phrases: DataFrame, parts: DataFrame, scale: int) -> DataFrame:
    """(lang, phrase, a, l, r, score): every phrase with its lowest-scoring cut."""
    said = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.size("said") - 1))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), said.alias("said")).withColumn("k", cut)
    left = F.array_join(F.slice("said", F.lit(1), F.col("k")), " ")
    right = F.array_join(F.slice("said", F.col("k") + 1, F.size("said") - F.col("k")), " ")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), left.alias("part")),
                              F.struct(F.lit(1).alias("side"), right.alias("part"))))
    asked = cuts.select("lang", "phrase", "a", "k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.*")
    one_word = ~F.contains(F.col("part"), F.lit(" "))
    asked = asked.withColumn(
        "piece", F.when(one_word, F.pmod(F.xxhash64("phrase"), F.lit(WORD_PIECES))).otherwise(F.lit(0)).cast("int")
    )
    pieces = F.when(one_word, F.sequence(F.lit(0), F.lit(WORD_PIECES - 1))).otherwise(F.array(F.lit(0)))
    known = parts.select("lang", F.col("phrase").alias("part"), "f").withColumn("piece", F.explode(pieces))
    met = asked.join(known, ["lang", "part", "piece"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    # decimals hold the product whatever the counts
    score = F.expr(f"cast({scale} as decimal(38, 0)) * a div (cast(l as decimal(38, 0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return both.groupBy("lang", "phrase", "a").agg(best.alias("best")).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score"
    )


def _first_by_language(df: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of every language, found in pieces first, so that no task holds a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    pieces = df.withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PIECES)))
    inside = F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))
    few = pieces.withColumn("place", inside).filter(F.col("place") <= top).drop("place", "piece")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, cover: int = 80, scale: int = 2_000_000, top: int = 2000
) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Words are runs of anything but blanks and tabs within pieces, which end at ``.,;:!?`` and line ends;
    A-Z are lower-cased. ``a`` counts all occurrences of a phrase of 2 to ``longest`` words, overlapping ones
    too, ``l`` and ``r`` those of its two parts at the cut of the lowest score, ``n`` all words of the
    language. Phrases below ``least`` are left out, and so are those inside a longer phrase that has
    ``cover`` percent of their occurrences or more. Order: score, a (both falling), phrase.

    A null text is empty, a null lang ``und``; rows of equal or null id are texts of their own. Empty
    tables give no rows; other columns are not looked at.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    words, phrases = phrase_counts(docs, least, longest)
    parts = words.filter(F.col("f") >= least).unionByName(phrases)
    said, size = F.col("said"), F.size("said")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(said, i, n), " "))))
    longer = phrases.withColumn("said", F.split("phrase", " ")).filter(size > 2)
    covers = (
        longer.select("lang", F.explode(inner).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    covered = F.coalesce(F.lit(100) * F.col("longer") >= F.lit(cover) * F.col("f"), F.lit(False))
    kept = phrases.join(covers, ["lang", "phrase"], "left").filter(~covered).select("lang", "phrase", "f")
    scored = _best_cuts(kept, parts, scale)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return _first_by_language(scored, top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
