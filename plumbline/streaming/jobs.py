"""Streaming jobs. Each takes a streaming DataFrame and returns a started query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions.text import injection_match, injection_reason, sanitize
from plumbline.operators.coercion import quoted
from plumbline.operators.ratelimit import admit
from plumbline.operators.sessions import latest_values

#: Bytes of files in a micro-batch. They bound what one session can have in a batch.
BATCH_BYTES = 1 << 30


def table_stream(spark, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the files of a given table; the schema comes from the table itself."""
    # A pattern, because a stream source takes a single file only as one.
    path = f"{sf_dir}/{name}.parque[t]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES)
    return reader.parquet(path)


def guardrail_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Injection verdict and sanitised text. Stateless, so batch and stream share it."""
    match = F.col("__match")
    return (
        sanitize(df, text)
        .withColumn("__match", injection_match(F.col(text)))
        .withColumn("is_safe", match.isNull() & F.coalesce(F.col(text) != "", F.lit(False)))
        .withColumn("reason", injection_reason(F.col(text), match))
        .drop("__match")
    )


def start_guardrails(stream: DataFrame, out: str, text: str = "text") -> StreamingQuery:
    return (
        guardrail_columns(stream, text)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )


_KEY, _AT, _DATED, _STATUS = "__key", "__at", "__dated", "__status"


def _micros(ts: str, kind: T.DataType) -> Column:
    """Microseconds since 1970; a time without a zone is taken as it stands."""
    c = F.col(quoted(ts))
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c)
    seconds = F.unix_date(c.cast("date")) * F.lit(86_400) + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def start_rate_limit(
    stream: DataFrame,
    out: str,
    session: str,
    ts: str,
    seq: str,
    max_requests: int,
    window_seconds: float,
    forget_after: str | None = None,
) -> StreamingQuery:
    """The limiter over a stream, by event time; rows go to ``out/rows`` with a status.

    Spark keeps one state per session: the last allowed times and the newest row. A batch reads and
    writes the states of its own sessions only. A row older than the newest row already decided in
    its session can no longer be decided and is marked ``late``, as is one without time or ``seq``.

    The rows that one session has in a batch are sorted in one task, so the source has to bound its
    batches (``table_stream`` does). With ``forget_after``, a delay such as "1 hour", time also moves
    the states out: a session is dropped once the watermark is a window past its newest row, and
    rows behind the watermark are dropped by Spark undecided.
    """
    window = int(window_seconds * 1_000_000)
    types = {f.name: f.dataType for f in stream.schema}
    # Columns travel under plain names, and whole numbers, which nulls would turn into floats, as text.
    rest = {name: f"c{i}" for i, name in enumerate(stream.columns) if name not in (session, ts)}
    order = rest[seq]

    def carried(name: str) -> Column:
        c = F.col(quoted(name))
        return c.cast("string") if name != seq and isinstance(types[name], T.IntegralType) else c

    if forget_after:
        stream = stream.withWatermark(ts, forget_after)
    at = _micros(ts, types[ts])
    keyed = stream.select(
        F.col(quoted(session)).cast("string").alias(_KEY),
        F.coalesce(at, F.lit(0)).alias(_AT),
        (at.isNotNull() & F.col(quoted(seq)).isNotNull()).alias(_DATED),
        F.col(quoted(ts)).alias("ts"),
        *(carried(name).alias(plain) for name, plain in rest.items()),
    )
    given = {f.name: f.dataType for f in keyed.schema}
    decided = T.StructType(
        [T.StructField(c, given[c]) for c in (_KEY, _AT, _DATED, *rest.values())]
        + [T.StructField(_STATUS, T.StringType())]
    )
    state_type = T.StructType(
        [
            T.StructField("at", T.LongType()),
            T.StructField("seq", types[seq]),
            T.StructField("memory", T.ArrayType(T.LongType())),
        ]
    )

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values([_AT, order], kind="stable")
        newest_at, newest_seq, memory = state.get if state.exists else (None, None, [])
        times, dated = rows[_AT].to_numpy(np.int64), rows[_DATED].to_numpy(bool)
        late = ~dated
        if newest_at is not None:
            tied = (times == newest_at) & dated
            late |= times < newest_at
            late[tied] = (rows[order][tied] < newest_seq).to_numpy(bool)
        status = np.full(len(rows), "late", dtype=object)
        allowed, memory = admit(times[~late], list(memory), max_requests, window)
        status[~late] = np.where(allowed, "allowed", "denied")
        if len(allowed):
            last = rows[~late].iloc[-1]
            newest_at, newest_seq = int(last[_AT]), last[order]
            newest_seq = newest_seq.item() if isinstance(newest_seq, np.generic) else newest_seq
            state.update((newest_at, newest_seq, [int(m) for m in memory]))
        if forget_after and newest_at is not None:
            over = (newest_at + window) // 1000
            state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(**{_STATUS: status})[decided.names]

    timeout = GroupStateTimeout.EventTimeTimeout if forget_after else GroupStateTimeout.NoTimeout
    states = keyed.groupBy(_KEY).applyInPandasWithState(decide, decided, state_type, "append", timeout)
    if isinstance(types[ts], T.TimestampNTZType):
        back = F.timestamp_add("MICROSECOND", F.col(_AT), F.lit("1970-01-01").cast("timestamp_ntz"))
    else:
        back = F.timestamp_micros(_AT)
    restored = {session: F.col(_KEY), ts: F.when(F.col(_AT).isNotNull(), back)}
    columns = [(F.col(rest[c]) if c in rest else restored[c]).cast(types[c]).alias(c) for c in stream.columns]
    return (
        states.withColumn(_AT, F.when(F.col(_DATED) | (F.col(_AT) != 0), F.col(_AT)))
        .select(*columns, F.col(_STATUS).alias("status"))
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )


def start_session_state(
    stream: DataFrame,
    out: str,
    session: str,
    seq: str,
    key: str,
    value: str,
    clears: Column,
) -> StreamingQuery:
    """Session memory over a stream; ``current_state`` of ``out/changes`` is what lives now.

    A streaming aggregation keeps, per (session, key) and per cleared session, the latest row. These
    are plain maxima that do not depend on the order in which rows arrive, and are combined before the
    shuffle, so a hot session stays small. Every batch writes the rows that it changed; a repeated
    batch writes them again in the same place.
    """
    is_clear = F.coalesce(clears, F.lit(False))
    news = stream.select(
        F.col(quoted(session)).alias("session"),
        F.when(~is_clear, F.col(quoted(key))).alias("key"),
        F.when(~is_clear, F.col(quoted(value))).alias("value"),
        F.col(quoted(seq)).alias("seq"),
        is_clear.alias("is_clear"),
    )
    latest = news.groupBy("session", "key", "is_clear").agg(
        F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")
    )

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")

    return (
        latest.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def current_state(changes: DataFrame) -> DataFrame:
    """The live (session, key, value, seq) rows after all ``changes`` of a stream."""
    return latest_values(changes, "session", "seq", "key", "value", F.col("is_clear"))
