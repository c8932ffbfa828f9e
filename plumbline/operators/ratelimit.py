"""Sliding-log rate limit per session.

A request is allowed when fewer than ``max_requests`` requests *allowed* before it lie inside the
window. Refused requests leave no trace, so no window function can express the decision; each
depends on the ones before. The only memory it needs is the last ``max_requests`` allowed times.

Scale. The log is range-partitioned and sorted by (session, time), not grouped by session. A session
holding a third of all rows is therefore cut into many chunks, and no task holds more than a
chunk. What crosses a chunk border is the memory of one session. A first pass computes the memory
each chunk leaves behind; chunks filled by a session that started earlier are computed again with
the memory of the chunk before. The driver sees one short memory per chunk. A last pass writes the
decisions of all chunks side by side.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed
from plumbline.session import shared_root

_CHUNK = "__chunk"
_KIND = "__kind"
_REQUEST, _SKIP, _RESET, _PRIOR = range(4)


def admit(times: np.ndarray, memory: list[int], limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Decide the sorted ``times`` of one session, given its last allowed times."""
    allowed = np.zeros(len(times), dtype=bool)
    if limit <= 0:
        return allowed, []
    joined = np.concatenate([np.array(memory, dtype=np.int64), times])
    if np.all(joined[limit:] - joined[:-limit] >= window):
        allowed[:] = True
        return allowed, joined[-limit:].tolist()
    asked, recent, i = times.tolist(), deque(memory, maxlen=limit), 0
    while i < len(asked):
        if len(recent) == limit and asked[i] - recent[0] < window:
            i = bisect_left(asked, recent[0] + window, i + 1)
            continue
        allowed[i] = True
        recent.append(asked[i])
        i += 1
    return allowed, list(recent)


def _micros(column: pa.Array) -> np.ndarray:
    unit = pa.timestamp("us", tz=getattr(column.type, "tz", None))
    return column.cast(unit).cast(pa.int64()).to_numpy()


class _Walk:
    """Walks one chunk in order and carries the memory of the current session."""

    def __init__(self, session: str, ts: str, limit: int, window: int, memory: list[int]):
        self.session, self.ts, self.limit, self.window = session, ts, limit, window
        self.memory = list(memory)
        self.first: tuple | None = None
        self.current: tuple | None = None

    def decide(self, batch: pa.RecordBatch, memory_only: bool = False) -> pa.Array | None:
        """Decisions of a batch; with ``memory_only`` just what its last session leaves behind.

        A request that is a full window away from the request ``limit`` rows earlier is allowed
        whatever was decided before. Sessions with only such requests are done all at once, and
        single steps are left for the busy ones, and for the first and the last, which may go on
        in the neighbouring batches.
        """
        keys = batch.column(self.session)
        codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
        times = _micros(batch.column(self.ts))
        kinds = batch.column(_KIND).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        ends = np.append(starts[1:], len(codes))
        last = len(starts) - 1
        first_key, last_key = (keys[0].as_py(),), (keys[len(codes) - 1].as_py(),)
        if self.first is None:
            self.first = first_key
        elif first_key != self.current:
            self.memory = []
        self.current = last_key
        allowed = kinds == _REQUEST
        if memory_only:
            stepwise = [last]
        else:
            busy = ~allowed
            far = max(self.limit, 0)
            busy[far:] |= (codes[far:] == codes[: len(codes) - far]) & (
                times[far:] - times[: len(codes) - far] < self.window
            )
            numbers = np.searchsorted(starts, np.flatnonzero(busy), side="right") - 1
            stepwise = np.unique(np.concatenate([[0], numbers, [last]])).astype(int).tolist()
        for i in stepwise:
            if i > 0:
                self.memory = []
            self._step(allowed, times, kinds, int(starts[i]), int(ends[i]))
        return None if memory_only else pa.array(allowed, mask=kinds != _REQUEST)

    def _step(self, allowed, times, kinds, start: int, end: int) -> None:
        """Decide the rows start..end of one session."""
        at = start
        for stop in [*(np.flatnonzero(kinds[start:end] >= _RESET) + start).tolist(), end]:
            asked = np.flatnonzero(kinds[at:stop] == _REQUEST) + at
            allowed[asked], self.memory = admit(times[asked], self.memory, self.limit, self.window)
            if stop < end:
                again = [*self.memory, int(times[stop])][-self.limit :]
                self.memory = again if kinds[stop] == _PRIOR else []
            at = stop + 1


def _leave_behind(needed: DataFrame, walk_args: tuple, entries: dict[int, list[int]]) -> dict:
    """Per chunk: its first time, its first and last session, and the memory of the last."""
    session, ts, limit, window = walk_args
    key_type = needed.schema[session].dataType
    schema = T.StructType(
        [
            T.StructField("chunk", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("first", key_type),
            T.StructField("last", key_type),
            T.StructField("memory", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = chunk = start = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if walk is None:
                chunk = batch.column(_CHUNK)[0].as_py()
                start = int(_micros(batch.column(ts).slice(0, 1))[0])
                walk = _Walk(session, ts, limit, window, entries.get(chunk, []))
            walk.decide(batch, memory_only=True)
        if walk is not None:
            key = batch.column(session).type
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([walk.first[0]], key),
                    pa.array([walk.current[0]], key),
                    pa.array([walk.memory], pa.list_(pa.int64())),
                ],
                names=["chunk", "start", "first", "last", "memory"],
            )

    return {r["chunk"]: r for r in needed.mapInArrow(run, schema).collect()}


def _entry_memories(ranged: DataFrame, walk_args: tuple) -> dict[int, list[int]]:
    """The memory each chunk must start with, for chunks whose first session began earlier.

    Only a chunk that is filled by one session hands on what it was handed. The first repetition
    takes all such chunks whose entry was assumed wrongly; it settles all sessions that forgot
    their start within a chunk. A session so crowded that it never forgets is then followed chunk
    by chunk, each time only the one whose entry is known for certain.
    """
    session, ts, _, window = walk_args
    needed = ranged.select(session, ts, _KIND, _CHUNK)
    used: dict[int, list[int]] = {}
    left = _leave_behind(needed, walk_args, used)
    repetition = 0
    while True:
        order = sorted(left)
        entries, stale, certain, exit_certain = {}, [], [], True
        for previous, chunk in zip(order, order[1:]):
            before, now = left[previous], left[chunk]
            continues = before["last"] == now["first"]
            memory = [m for m in before["memory"] if continues and now["start"] - m < window]
            entry_certain = exit_certain or not continues
            as_assumed = memory == used.get(chunk, [])
            entries[chunk] = memory
            exit_certain = True
            if now["first"] == now["last"]:
                exit_certain = entry_certain and as_assumed
                if not as_assumed:
                    stale.append(chunk)
                    if entry_certain:
                        certain.append(chunk)
        if not stale:
            return {chunk: memory for chunk, memory in entries.items() if memory}
        repetition += 1
        if repetition == 2:
            needed = needed.where(F.col(_CHUNK).isin(stale)).checkpoint()
        again = stale if repetition == 1 else certain
        used.update({chunk: entries[chunk] for chunk in again})
        left.update(_leave_behind(needed.where(F.col(_CHUNK).isin(again)), walk_args, used))


def rate_limit(
    df: DataFrame,
    session: str,
    ts: str,
    order_by: list[str],
    max_requests: int = 10,
    window_seconds: float = 60,
    reset: str | None = None,
    skip: str | None = None,
    prior: str | None = None,
    chunks: int | None = None,
    allowed: str = "allowed",
) -> DataFrame:
    """Add the decision to every request.

    Three kinds of rows, named by boolean columns, get none: ``reset`` rows clear their session,
    ``skip`` rows have no effect, and ``prior`` rows are requests allowed earlier that still count.
    ``order_by`` breaks ties between equal times; with it the order of a session must be total.
    All columns of ``df`` ride along, so select the needed ones first.
    """
    spark = df.sparkSession
    shared_root(spark)
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = F.lit(_REQUEST)
    for name, code in ((skip, _SKIP), (reset, _RESET), (prior, _PRIOR)):
        if name:
            kind = F.when(F.col(name), code).otherwise(kind)
    order = [session, ts, *order_by]
    ranged = (
        df.withColumn(_KIND, kind.cast("int"))
        .repartitionByRange(chunks, *order)
        .sortWithinPartitions(*order)
        .withColumn(_CHUNK, F.spark_partition_id())
        .checkpoint()
    )
    walk_args = (session, ts, max_requests, int(window_seconds * 1_000_000))
    entries = _entry_memories(ranged, walk_args)
    columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(allowed, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if walk is None:
                walk = _Walk(*walk_args, entries.get(batch.column(_CHUNK)[0].as_py(), []))
            decision = walk.decide(batch)
            kept = [batch.column(name) for name in columns]
            yield pa.RecordBatch.from_arrays([*kept, decision], names=[*columns, allowed])

    return ranged.mapInArrow(run, schema)


def refusal(max_requests: int, window_seconds: int) -> str:
    return fixed.LIMIT_EXCEEDED.format(max_requests, window_seconds)
