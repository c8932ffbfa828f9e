"""Session memory, traces, transcripts, routing, and the streaming forms against the batch forms."""

import datetime
import random

from pyspark.sql import functions as F

from plumbline.functions import routing
from plumbline.operators import sessions, trace
from plumbline.operators.ratelimit import rate_limit
from plumbline.streaming import jobs

START = datetime.datetime(2024, 1, 1)


def ask(spark, f, *prompts):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string")
    return [r["v"] for r in df.select("i", f(F.col("p")).alias("v")).orderBy("i").collect()]


def test_paths_and_intents(spark):
    prompts = ["q (File: /a/b.csv )", "q", "q (File:)", "plot it (File: x.csv) (File: y.csv)", "paragraph (File: a)"]
    assert ask(spark, routing.file_path, *prompts) == ["/a/b.csv", None, None, "x.csv", "a"]
    assert ask(spark, routing.clean_question, *prompts)[0] == "q"
    assert ask(
        spark, routing.intent, "hello", "a graph (File: f)", "hm (File: clean.csv)", "sum (File: f)"
    ) == ["chat", "chart", "quality", "analysis"]
    assert ask(spark, routing.chart_kind, "trend", "correlation", "x") == ["line", "scatter", "bar"]


def test_column_resolution(spark):
    cols = ["Order_Date", "Amount", "qty", "Client Name"]
    got = ask(
        spark, lambda w: routing.resolve_column(w, cols),
        "amount", "REVENUE", "units", "date", "client", "zzz", "sales",
    )
    assert got == ["Amount", "Amount", "qty", "Order_Date", "Client Name", "zzz", "Amount"]
    found = ask(
        spark, lambda p: F.array_join(routing.mentioned_columns(p, cols), "|"),
        "QTY per order_date", "revenue", "nothing",
    )
    assert found == ["Order_Date|qty", "Amount", ""]
    df = spark.createDataFrame([(["qty", "Client Name", "Amount"],), ([],)], "m array<string>")
    x, y = routing.chart_axes(F.col("m"), ["Client Name"], ["Amount", "qty"], cols)
    assert [tuple(r) for r in df.select(x, y).collect()] == [("Client Name", "qty"), ("Client Name", "Amount")]
    x, y = routing.chart_axes(F.col("m"), [], [], ["one"])
    assert tuple(df.select(x, y).first()) == ("one", "one")


def test_memory(spark):
    log = spark.createDataFrame(
        [("s", 1, "set", "a", "1"), ("s", 2, "clear", None, None), ("s", 3, "set", "b", "2"),
         ("s", 4, "set", "b", "3"), ("t", 5, "set", "a", "9"), ("u", 6, "set", "a", "1"), ("u", 7, "clear", None, None)],
        "session string, seq int, op string, key string, value string",
    )
    latest = sessions.latest_values(log, "session", "seq", "key", "value", F.col("op") == "clear")
    assert {tuple(r) for r in latest.collect()} == {("s", "b", "3", 4), ("t", "a", "9", 5)}
    docs = {r["session"]: r["memory"] for r in sessions.state_documents(latest).collect()}
    assert docs == {"s": '{"b":"3"}', "t": '{"a":"9"}'}


def test_trace_blocks_do_not_matter(spark):
    rng = random.Random(5)
    rows = [(rng.choice("hhhht"), i, rng.choice(["on", "off", "clear", "e", "e", "e", "e"])) for i in range(400)]
    log = spark.createDataFrame(rows, "session string, seq bigint, kind string")
    expected = {}
    on = {}
    for s, i, k in rows:
        kept = expected.setdefault(s, [])
        if k in ("on", "off"):
            on[s] = k == "on"
        elif k == "clear":
            kept.clear()
        elif on.get(s, True):
            kept.append(i)
    switch = F.when(F.col("kind") == "on", True).when(F.col("kind") == "off", False)
    for chunks in (1, 7, 40):
        got = trace.recorded_events(log, "session", "seq", switch, F.col("kind") == "clear", chunks)
        assert sorted(r["seq"] for r in got.collect()) == sorted(i for v in expected.values() for i in v)
    # Numbers far apart, as microseconds are, change nothing.
    times = log.withColumn("seq", F.col("seq") * 86_400_000_000)
    got = trace.recorded_events(times, "session", "seq", switch, F.col("kind") == "clear", 7)
    assert sorted(r["seq"] // 86_400_000_000 for r in got.collect()) == sorted(i for v in expected.values() for i in v)


def test_trace_of_a_hot_session_is_spread(spark):
    log = spark.range(20_000).selectExpr("'hot' AS s", "id * 1000003 AS n").repartition(8)
    kept = trace.recorded_events(log, "s", "n", F.lit(None).cast("boolean"), F.col("n") == 1_000_003 * 4_999, 8)
    assert kept.count() == 15_000
    pieces = log.repartitionByRange(8, "s", "n").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in pieces.collect()) < 2 * 20_000 / 8


def test_trace_lines(spark):
    df = spark.createDataFrame(
        [("s", 1, START, "scout", "tool_call", "load", {"file": "a.csv"}), ("s", 2, START, "x", "other", "m", None)],
        "session string, seq int, ts timestamp_ntz, agent string, kind string, msg string, details map<string,string>",
    )
    got = trace.trace_lines(df, "session", "seq", "ts", "agent", "kind", "msg", "details")
    assert [r["line"] for r in got.orderBy("seq", "line_no").collect()] == [
        "", "[00:00:00] [T] scout", "    TOOL_CALL: load", "    * file: a.csv",
        "", "[00:00:00] * x", "    OTHER: m",
    ]


def test_transcripts_on_disk(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "data:image/png;base64,AAAA"), (2, 0, "user", "yo")],
        "conv_id int, turn int, role string, text string",
    )
    out = str(tmp_path / "out")
    sessions.write_transcripts(sessions.transcript_sections(df), out)
    texts = [p.read_text() for p in sorted((tmp_path / "out" / "conv_id=1").glob("part-*"))]
    assert "".join(texts) == (
        "# Chat Export\n\n## User\n\nhi\n\n## Assistant\n\n[Chart Image Generated]\n\n"
    )


def test_markdown(spark):
    report = "DATA SCOUT REPORT\n=====\n  Rows: 3\n\nNUMERIC SUMMARY\n---\nTotals:\n"
    df = spark.createDataFrame([(report,)], "r string")
    got = df.select(sessions.report_markdown(F.col("r"), F.lit("why")).alias("m")).first()["m"]
    assert got == (
        "# Analysis Result\n\n**Question:** why\n\n## DATA SCOUT REPORT\n\nRows: 3\n\n\n## NUMERIC SUMMARY"
        "\n\n\n**Totals:**\n\n---"
    )


def run_in_files(spark, df, folder, start, pieces):
    """One file per micro-batch, in the order of time."""
    schema = df.schema
    for low, high in pieces:
        df.where((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode(
            "append"
        ).parquet(folder)
        start(spark.readStream.schema(schema).parquet(folder)).awaitTermination()


def test_streams_equal_batch_over_several_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    top = events.agg(F.max("event_id")).first()[0] + 1
    cuts = [top * k // 5 for k in range(6)]
    pieces = list(zip(cuts, cuts[1:]))

    limiter = str(tmp_path / "limiter")
    run_in_files(
        spark, events.select("event_id", "ts", "user_id"), str(tmp_path / "in1"),
        lambda s: jobs.start_rate_limit(s, limiter, "user_id", "ts", "event_id", 2, 86_400), pieces,
    )
    got = {r["event_id"]: r["status"] for r in spark.read.parquet(f"{limiter}/rows").collect()}
    batch = rate_limit(events.select("event_id", "ts", "user_id"), "user_id", "ts", ["event_id"], 2, 86_400)
    assert got == {r["event_id"]: "allowed" if r["allowed"] else "denied" for r in batch.collect()}
    assert "denied" in got.values()

    memory = str(tmp_path / "memory")
    clears = F.col("event_type") == "signup"
    run_in_files(
        spark, events, str(tmp_path / "in2"),
        lambda s: jobs.start_session_state(s, memory, "user_id", "event_id", "event_type", "props", clears), pieces,
    )
    state = jobs.current_state(spark.read.parquet(f"{memory}/changes"))
    expected = sessions.latest_values(events, "user_id", "event_id", "event_type", "props", clears)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, expected.collect()))


def test_late_rows_get_no_decision(spark, tmp_path):
    def at(i, second):
        return (i, START + datetime.timedelta(seconds=second), "u")

    schema = "event_id bigint, ts timestamp_ntz, user_id string"
    df = spark.createDataFrame([at(0, 100), at(1, 50), at(2, 120), at(3, 130)], schema)
    out = str(tmp_path / "out")
    run_in_files(
        spark, df, str(tmp_path / "in"),
        lambda s: jobs.start_rate_limit(s, out, "user_id", "ts", "event_id", 2, 60), [(0, 1), (1, 2), (2, 4)],
    )
    got = {r["event_id"]: r["status"] for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == {0: "allowed", 1: "late", 2: "allowed", 3: "denied"}


def test_stream_limiter_carries_odd_rows_and_touches_only_the_sessions_of_a_batch(spark, tmp_path):
    def at(second):
        return None if second is None else START + datetime.timedelta(seconds=second, microseconds=7)

    big = 2**60 + 1
    rows = [(0, at(0), None, big, "a"), (1, at(1), "u", None, None), (2, None, "u", 1, "b"), (3, at(2), None, big, "c")]
    rows += [(4, at(3), None, None, "d"), (5, at(90), None, 5, "e"), (6, at(4), "w", 6, "f")]
    schema = "event_id bigint, ts timestamp_ntz, user_id string, `a.b` bigint, note string"
    df = spark.createDataFrame(rows, schema)
    out = str(tmp_path / "out")
    queries = []

    def start(stream):
        queries.append(jobs.start_rate_limit(stream, out, "user_id", "ts", "event_id", 2, 60))
        return queries[-1]

    run_in_files(spark, df, str(tmp_path / "in"), start, [(0, 4), (4, 6), (6, 7)])
    got = spark.read.parquet(f"{out}/rows")
    assert got.drop("status").schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, got.drop("status").collect())) == sorted(rows)
    want = {0: "allowed", 1: "allowed", 2: "late", 3: "allowed", 4: "denied", 5: "allowed", 6: "allowed"}
    assert {r["event_id"]: r["status"] for r in got.collect()} == want
    updated = [sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]) for q in queries]
    total = [q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] for q in queries]
    assert updated == [2, 1, 1] and total == [2, 2, 3]


def test_stream_limiter_forgets_sessions_behind_the_watermark(spark, tmp_path):
    def at(second):
        return datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=second)

    rows = [(0, at(0), "u"), (1, at(5_000), "w"), (2, at(9_000), "w"), (3, at(9_001), "u")]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id string")
    out = str(tmp_path / "out")
    queries = []

    def start(stream):
        queries.append(jobs.start_rate_limit(stream, out, "user_id", "ts", "event_id", 2, 60, "10 minutes"))
        return queries[-1]

    run_in_files(spark, df, str(tmp_path / "in"), start, [(0, 1), (1, 2), (2, 3), (3, 4)])
    got = {r["event_id"]: r["status"] for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == dict.fromkeys(range(4), "allowed")
    assert queries[2].recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1
