"""Per-session state over append logs: memory, admission, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.text import injection_match, injection_reason, is_image
from plumbline.operators.ratelimit import rate_limit, refusal
from plumbline.session import shared_root


def latest_values(
    log: DataFrame, session: str, seq: str, key: str, value: str, clears: Column
) -> DataFrame:
    """The value last set for every (session, key), honouring clears of the whole session.

    The latest set and the last clear are both plain maxima, combined before the shuffle. They
    meet only afterwards, when a session has one row per key left, so a hot session is small by
    then. A key lives if its latest set is later than the last clear. Null is a session like any other.
    """
    is_clear = F.coalesce(clears, F.lit(False))
    live = (
        log.where(~is_clear)
        .groupBy(F.col(session).alias("session"), F.col(key).alias("key"))
        .agg(F.max_by(F.col(value), F.col(seq)).alias("value"), F.max(seq).alias("seq"))
    )
    cleared = (
        log.where(is_clear)
        .groupBy(F.col(session).alias("cleared_session"))
        .agg(F.max(seq).alias("cleared_at"))
    )
    return (
        live.join(cleared, F.col("session").eqNullSafe(F.col("cleared_session")), "left")
        .where(F.col("cleared_at").isNull() | (F.col("seq") > F.col("cleared_at")))
        .select("session", "key", "value", "seq")
    )


def state_documents(latest: DataFrame) -> DataFrame:
    """One JSON object per session. A session has one row per key here, whatever the log held.

    A null key has no place in an object and is left out.
    """
    named = F.when(F.col("key").isNotNull(), F.struct("key", "value"))
    entries = F.array_sort(F.collect_list(named))
    return latest.groupBy("session").agg(
        F.to_json(F.map_from_entries(entries)).alias("memory")
    )


def validate_requests(
    requests: DataFrame,
    session: str,
    ts: str,
    order_by: list[str],
    text: str,
    max_requests: int = 10,
    window_seconds: int = 60,
    keep: list[str] = (),
) -> DataFrame:
    """Admission: injection check first, then the limiter, for which unsafe requests do not exist.

    Session, time, order and the ``keep`` columns are returned with the decision. The text itself
    is looked at before the limiter sorts, and left behind there.
    """
    match = "__match"
    unsafe = F.col(match).isNotNull() | F.coalesce(F.col(text) == "", F.lit(True))
    columns = list(dict.fromkeys([session, ts, *order_by, *keep]))
    checked = requests.withColumn(match, injection_match(F.col(text))).select(
        *columns,
        unsafe.alias("__unsafe"),
        F.when(unsafe, injection_reason(F.col(text), F.col(match))).alias("__reason"),
    )
    # Range partitioning reads its input twice. The check over the texts must not run twice, so its
    # narrow result is written out first.
    shared_root(requests.sparkSession)
    decided = rate_limit(
        checked.checkpoint(),
        session,
        ts,
        order_by,
        max_requests,
        window_seconds,
        skip="__unsafe",
        allowed="__allowed",
    )
    blocked = F.lit(fixed.BLOCKED)
    return decided.select(
        *columns,
        F.coalesce("__allowed", F.lit(False)).alias("is_valid"),
        F.when(F.col("__unsafe"), F.concat(blocked, F.col("__reason")))
        .when(F.col("__allowed"), fixed.VALIDATED)
        .otherwise(F.concat(blocked, F.lit(refusal(max_requests, window_seconds))))
        .alias("message"),
    )


def transcript_sections(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    title: str = "Chat Export",
) -> DataFrame:
    """The markdown transcript of every conversation, as ordered sections.

    Joining a conversation's sections in order gives its document. They stay rows, so that no
    conversation, however long, has to fit into one cell or one task.
    """
    speaker = F.when(F.col(role) == "user", "User").otherwise("Assistant")
    content = F.when(is_image(F.col(text)), fixed.CHART_IN_TRANSCRIPT).otherwise(F.col(text))
    first = F.min(turn)
    headings = messages.groupBy(conversation).agg((first - 1).alias("section_no")).select(
        conversation, "section_no", F.lit(f"# {title}\n\n").alias("section")
    )
    sections = messages.select(
        conversation,
        F.col(turn).alias("section_no"),
        F.concat(F.lit("## "), speaker, F.lit("\n\n"), content, F.lit("\n\n")).alias("section"),
    )
    return headings.unionByName(sections)


def write_transcripts(sections: DataFrame, path: str, conversation: str = "conv_id") -> None:
    """Text files in one folder per conversation; read in name order they are the document."""
    order = [conversation, "section_no"]
    # The writer ends every line itself.
    line = F.substring(F.col("section"), 1, F.length("section") - 1).alias("line")
    (
        sections.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(conversation, line)
        .write.partitionBy(conversation)
        .text(path)
    )


def report_lines(text: Column) -> Column:
    """The lines of a report that carry content: no blanks, no rules of ``=`` and ``-``."""
    lines = F.transform(
        F.split(text, "\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    )
    return F.filter(lines, lambda line: (line != "") & ~line.rlike("^[-=]+$"))


def report_markdown(text: Column, question: Column, footer: str = "\n\n---") -> Column:
    """An analysis report as markdown: headings, bold labels, question and footer."""

    def decorate(line: Column) -> Column:
        return (
            F.when(line == fixed.ANALYSIS_TITLE, F.concat(F.lit("## "), line))
            .when(line.isin(*fixed.SECTION_HEADINGS), F.concat(F.lit("\n## "), line))
            .when(F.endswith(line, F.lit(":")), F.concat(F.lit("\n**"), line, F.lit("**")))
            .otherwise(line)
        )

    return F.concat(
        F.lit("# Analysis Result\n\n**Question:** "),
        question,
        F.lit("\n\n"),
        F.array_join(F.transform(report_lines(text), decorate), "\n\n"),
        F.lit(footer),
    )
