"""Token ids in a binary file format: Simple-8b words, with escapes and offsets per block.

A 64-bit word holds a selector in its low four bits and, above it, as many ids as fit at the selector's
width. Ids wider than the widest selector are escaped: the word holds the id alone. A block holds the
words of some whole documents, its documents' ids and lengths, and its first position in the partition,
so any block is decoded on its own. Blocks are rows of Parquet files written by Spark, whose commit
protocol makes lost executors harmless.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import partition_offsets, process_state

# The format (fixed values): selector -> (ids in a word, bits of an id). 60 bits hold ids.
WIDTHS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8),
          9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30)}
#: One id of up to 60 bits alone in a word.
ESCAPE = 14

#: A block is closed when it holds so many ids; a longer document has a block of its own.
BLOCK_IDS = 1 << 16

#: Words, and letters of words in lower case, that a process remembers with their ids. Beyond them words are
#: encoded again.
CACHE_WORDS, CACHE_STEMS = 750_000, 750_000

_MARK = "\x01"

#: White space to str.split() and not to the vocabulary, where each is part of a word.
_KEPT = "\x1c\x1d\x1e\x1f"
_WORD = re.compile(rf"[\S{_KEPT}]+")


def encode(ids: np.ndarray) -> np.ndarray:
    """Packs non-negative ids below 2**60 into words, greedily with as many ids as fit each time."""
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    # half the bytes to compare where the ids allow it
    ids = ids.astype(np.uint32 if ids.max() < 1 << 32 else np.uint64)
    best = np.full(n, ESCAPE, dtype=np.int8)
    step = np.ones(n, dtype=np.int8)
    # from the widest on, so that the last selector to fit at a place holds the most ids
    for selector, (count, width) in sorted(WIDTHS.items(), reverse=True):
        if count > n:
            break
        fits, spanned = ids < ids.dtype.type(1 << width), 1
        while spanned < count and fits.any():
            more = min(spanned, count - spanned)
            fits = fits[: len(fits) - more] & fits[more:]
            spanned += more
        if spanned == count:
            best[: len(fits)][fits] = selector
            step[: len(fits)][fits] = count
    ids = ids.astype(np.uint64)
    at, starts = 0, []
    steps = step.tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    selectors = best[starts].astype(np.int64)
    words = selectors.astype(np.uint64)
    for selector, (count, width) in WIDTHS.items():
        rows = np.flatnonzero(selectors == selector)
        if len(rows):
            block = ids[starts[rows][:, None] + np.arange(count)]
            shifts = (4 + width * np.arange(count)).astype(np.uint64)
            words[rows] |= np.bitwise_or.reduce(block << shifts, axis=1)
    rows = np.flatnonzero(selectors == ESCAPE)
    words[rows] |= ids[starts[rows]] << np.uint64(4)
    return words


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of packed words, all words of a selector at once."""
    selectors = (words & np.uint64(15)).astype(np.int64)
    counts = np.ones(16, dtype=np.int64)
    for selector, (count, _) in WIDTHS.items():
        counts[selector] = count
    ends = np.cumsum(counts[selectors])
    starts = ends - counts[selectors]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for selector, (count, width) in WIDTHS.items():
        rows = np.flatnonzero(selectors == selector)
        if len(rows):
            shifts = (4 + width * np.arange(count)).astype(np.uint64)
            block = (words[rows][:, None] >> shifts) & np.uint64((1 << width) - 1)
            out[starts[rows][:, None] + np.arange(count)] = block
    rows = np.flatnonzero(selectors == ESCAPE)
    out[starts[rows]] = words[rows] >> np.uint64(4)
    return out


class _Encoder:
    """Encodes texts word by word with the library, remembering words.

    The vocabulary's normaliser and splitter treat words between white space apart from each other, so a
    text's ids are its words' ids in turn. A new word of Latin-1 letters, with a full stop or comma behind
    or not, is known by its letters in lower case; they go right to the library's model where a trial
    shows that the vocabulary lower-cases and keeps such words whole. Other new words go to the library together, set apart by a control character
    that forms a token of its own. Texts that hold this character or a special token's string are
    encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        mark = self.library.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        # the byte-level alphabet: printable Latin-1 stands for itself, the rest is moved behind it
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
        moved = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.spelling = str.maketrans({c: "".join(moved.get(b, chr(b)) for b in c.encode()) for c in letters})
        self.stops = {c: self.plain(c) for c in ".,"}
        trials = [*letters, "".join(letters), "Abc.", "éÉß,", "naïve", "ÀÖØÞ.", "it.", "ªº"]
        self.direct = True
        self.direct = all(self._one(w)[0] == self.plain(w) for w in trials)

    def _one(self, word: str) -> tuple[bytes | None, bool]:
        """The ids of a word of Latin-1 letters and perhaps a stop (None for others), and whether its letters
        have been met before, in either case."""
        stem, stop = (word[:-1], self.stops[word[-1]]) if word[-1] in self.stops else (word, b"")
        if not (self.direct and stem.isalpha() and (stem.isascii() or max(stem) <= "ÿ")):
            return None, True
        stem = stem.lower()
        ids = self.stems.get(stem)
        if ids is not None:
            return ids + stop, True
        spelt = stem if stem.isascii() else stem.translate(self.spelling)
        ids = array("I", [t.id for t in self.library.model.tokenize(spelt)]).tobytes()
        if len(self.stems) < CACHE_STEMS:
            self.stems[stem] = ids
        return ids + stop, False

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        ids = np.array(
            self.library.encode_batch_fast([f" {_MARK} ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4"
        )
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) != len(new) - 1:
            return {w: self.plain(w) for w in new}
        starts, ends = np.concatenate([[0], cuts + 1]) * 4, np.append(cuts, len(ids)) * 4
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(new, starts.tolist(), ends.tolist())}

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        known = self.words
        split, found, new = [], [], set()
        for text in texts:
            if self.mark is None or _MARK in text or any(s in text for s in self.special):
                split.append(None), found.append([self.plain(text)])
                continue
            words = _WORD.findall(text) if any(c in text for c in _KEPT) else text.split()
            parts = list(map(known.get, words))
            split.append(words), found.append(parts)
            if None in parts:
                new.update(w for w, p in zip(words, parts) if p is None)
        # a word is remembered when its letters turn up again; most words never do
        fresh, once, odd = {}, {}, []
        for word in new:
            ids, again = self._one(word)
            if ids is None:
                odd.append(word)
            elif again:
                fresh[word] = ids
            else:
                once[word] = ids
        for start in range(0, len(odd), 20_000):
            fresh.update(self._learn(odd[start : start + 20_000]))
        if len(known) < CACHE_WORDS:
            known.update(fresh)
        fresh.update(once)
        out = []
        for words, parts in zip(split, found):
            if words and None in parts:
                parts = [fresh[w] if p is None else p for w, p in zip(words, parts)]
            out.append(b"".join(parts))
        return out


def encoder(path: str) -> _Encoder:
    kept = process_state()
    if path not in kept:
        kept[path] = _Encoder(path)
    return kept[path]


BLOCK_SCHEMA = (
    "part int, block long, before long, doc_ids array<long>, lengths array<long>, words binary, n_ids long"
)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Writes the ids of all texts in ascending order of doc_id (nulls first), each closed by ``end_id``.

    A null text is empty. Rows of equal id, or without one, stay next to each other, in an order of their
    own that deals them over as many tasks as they need. ``tokenizer`` is the vocabulary's file, to be found
    at the same place on all machines.
    """

    def pack(batches):
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0
        tool, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        held_ids, held, count = [], [], 0

        def close():
            nonlocal block, before, held_ids, held, count
            words = encode(np.frombuffer(b"".join(held), dtype="<u4"))
            row = {"part": part, "block": block, "before": before, "doc_ids": held_ids,
                   "lengths": [len(h) // 4 for h in held], "words": words.astype("<u8").tobytes(), "n_ids": count}
            block, before = block + 1, before + count
            held_ids, held, count = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                texts = [t or "" for t in piece.column("text").to_pylist()]
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), tool.encode_texts(texts)):
                    if held and count + len(ids) // 4 + 1 > BLOCK_IDS:
                        yield close()
                    held_ids.append(doc_id)
                    held.append(ids + end)
                    count += len(ids) // 4 + 1
        if held:
            yield close()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["doc_id", "hash", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(pack, BLOCK_SCHEMA).write.parquet(path)


def _arrow_schema() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("doc_ids", longs),
                      ("lengths", longs), ("words", pa.binary()), ("n_ids", pa.int64())])


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the files of ``write_tokens``; a row per document.

    All ids are read in any case; ``with_ids=False`` leaves their column out of the result.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    counts = [(r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()]
    offsets = partition_offsets(spark, counts).withColumnRenamed("before", "part_before")

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(np.frombuffer(row["words"], dtype="<u8")).astype("<u4")
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                parts = [ids[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begins + row["before"] + row["part_before"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                if with_ids:
                    bounds = pa.array(np.append(0, ends), pa.int32())
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    joined = blocks.join(F.broadcast(offsets), "part").select(
        "before", "part_before", "doc_ids", "lengths", "words"
    )
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [field.split()[0] for field in schema.split(", ")]
    return joined.mapInArrow(unpack, schema)
