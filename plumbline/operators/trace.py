"""Event traces: on/off switch, clearing, and the printed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.session import shared_root


def recorded_events(
    log: DataFrame,
    session: str,
    seq: str,
    switch: Column,
    clear: Column,
    chunks: int | None = None,
) -> DataFrame:
    """Events kept by the tracer.

    ``switch`` is true or false on events that turn recording on or off and null on all others;
    recording starts on, and the switch rows themselves are not events. ``clear`` marks events
    that drop everything before them, themselves included.

    ``seq`` orders a session and is unique in it; any orderable type will do, and how its values are
    spaced does not matter. The log is cut into ``chunks`` ranges of (session, seq) of about equal row
    counts. The last switch and clear of each piece of a session are carried to its later pieces in a
    window over pieces, so a hot session never sits in one task.
    """
    shared_root(log.sparkSession)
    chunks = chunks or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Checkpointed, because the ranges are drawn from a sample and two readers have to see the same ones.
    rows = (
        log.withColumn("__switch", switch)
        .withColumn("__clear", F.coalesce(clear, F.lit(False)))
        .repartitionByRange(chunks, session, seq)
        .withColumn("__block", F.spark_partition_id())
        .checkpoint()
    )
    marked = F.col("__switch").isNotNull()
    blocks = rows.groupBy(session, "__block").agg(
        F.max_by(F.when(marked, F.col("__switch")), F.when(marked, F.col(seq))).alias("__last"),
        F.max(F.when(F.col("__clear"), F.col(seq))).alias("__cleared"),
    )
    per_session = Window.partitionBy(session)
    earlier = per_session.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        session,
        "__block",
        F.last("__last", ignorenulls=True).over(earlier).alias("__carried"),
        F.max("__cleared").over(per_session).alias("__cleared"),
    )
    here = (
        Window.partitionBy(session, "__block")
        .orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    carried = carried.select(
        F.col(session).alias("__session"), F.col("__block").alias("__at"), "__carried", "__cleared"
    )
    # Null is a session like any other.
    same = F.col(session).eqNullSafe(F.col("__session")) & F.col("__block").eqNullSafe(F.col("__at"))
    return (
        rows.join(carried, same)
        .withColumn(
            "__on",
            F.coalesce(
                F.last("__switch", ignorenulls=True).over(here), "__carried", F.lit(True)
            ),
        )
        .where(F.col("__on") & F.col("__switch").isNull() & ~F.col("__clear"))
        .where(F.col("__cleared").isNull() | (F.col(seq) > F.col("__cleared")))
        .select(*log.columns)
    )


def icon(event_type: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in fixed.TRACE_ICONS.items() for x in pair))
    return F.coalesce(F.element_at(known, event_type), F.lit(fixed.OTHER_ICON))


def trace_lines(
    events: DataFrame,
    session: str,
    seq: str,
    ts: str,
    agent: str,
    event_type: str,
    message: str,
    details: str,
) -> DataFrame:
    """The printed trace as (session, seq, line_no, line) rows.

    Each event gives a heading, its message, and one line per entry of the ``details`` map.
    """
    kind = F.col(event_type)
    head = F.concat(
        F.lit("["),
        F.date_format(ts, "HH:mm:ss"),
        F.lit("] "),
        icon(kind),
        F.lit(" "),
        F.col(agent).cast("string"),
    )
    body = F.concat(F.lit("    "), F.upper(kind), F.lit(": "), F.col(message))
    extra = F.transform(
        F.map_entries(F.coalesce(F.col(details), F.create_map().cast("map<string,string>"))),
        lambda e: F.concat(F.lit("    * "), e["key"], F.lit(": "), e["value"]),
    )
    lines = F.concat(F.array(F.lit(""), head, body), extra)
    return events.select(session, seq, F.posexplode(lines).alias("line_no", "line"))


def trace_document(lines: DataFrame, session: str, seq: str) -> DataFrame:
    """The whole printed trace, ordered by (session, part, seq, line_no).

    Part 0 of a session is its title, part 1 has the ``lines`` of its events, part 2 is the closing rule.
    """
    rule = fixed.TRACE_RULE
    frame = F.array(
        *(
            F.struct(F.lit(part).alias("part"), F.lit(no).alias("line_no"), F.lit(text).alias("line"))
            for part, no, text in (
                (0, 0, rule), (0, 1, fixed.TRACE_TITLE), (0, 2, rule), (2, 0, ""), (2, 1, rule),
            )
        )
    )
    framed = lines.select(session).distinct().select(session, F.inline(frame))
    return framed.withColumn(seq, F.lit(None).cast(lines.schema[seq].dataType)).unionByName(
        lines.withColumn("part", F.lit(1))
    )
