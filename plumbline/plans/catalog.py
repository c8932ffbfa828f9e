"""Every registered query: name -> f(spark, folder of the given tables) -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import cleaning, routing, text
from plumbline.operators import (
    analysis,
    coercion,
    duplicates,
    extensions,
    keys,
    profile,
    ratelimit,
    render,
    sessions,
    stored,
    trace,
)
from plumbline.plans import files, views
from plumbline.plans.views import table
from plumbline.session import scratch_path
from plumbline.sources import admission, delimited, folder, sniff, workbook
from plumbline.streaming import jobs

QUERIES = {}

MONEY = "decimal(18,2)"


def query(f):
    QUERIES[f.__name__] = f
    return f


def money(name: str):
    """Exact sums do not depend on the order of the rows."""
    return F.col(name).cast(MONEY)


def clean_orders(spark: SparkSession, d: str) -> DataFrame:
    """The raw orders after missing-word and type handling, the input of every profile."""
    return coercion.coerce_types(coercion.normalise_missing(views.raw_orders(spark, d)))


# --- Profile ------------------------------------------------------------------------------------


@query
def table_shape(spark, d):
    return profile.table_shape(clean_orders(spark, d))


@query
def column_missing(spark, d):
    return profile.column_missing(clean_orders(spark, d))


@query
def column_unique(spark, d):
    p = profile.column_profile(clean_orders(spark, d))
    return p.select("position", "name", "unique", "unique_pct")


@query
def column_samples(spark, d):
    samples = profile.column_samples(clean_orders(spark, d), ["order_id"])
    return samples.select("position", "name", F.array_join("sample", ", ").alias("sample"))


@query
def samples_tied(spark, d):
    """All rows tie in the order, so the smallest values are the samples."""
    tied = table(spark, d, "customer").select(F.lit(1).alias("k"), "c_name", "c_mktsegment")
    samples = profile.column_samples(tied, ["k"])
    return samples.select("position", "name", F.array_join("sample", ", ").alias("sample"))


@query
def duplicate_rows(spark, d):
    return duplicates.duplicate_rows(clean_orders(spark, d))


@query
def duplicate_groups(spark, d):
    return duplicates.duplicate_groups(clean_orders(spark, d))


@query
def quality_dimensions(spark, d):
    p = profile.table_profile(clean_orders(spark, d))
    return p.select("completeness", "uniqueness", "validity", "consistency")


@query
def quality_score(spark, d):
    p = profile.table_profile(clean_orders(spark, d))
    return p.select(
        "rows", "cols", "duplicate_rows", "total_missing", "quality_score", "quality_grade"
    )


@query
def quality_flags(spark, d):
    p = profile.table_profile(clean_orders(spark, d))
    return p.select(F.posexplode("flags").alias("flag_no", "flag"))


@query
def summary_cards(spark, d):
    cards = profile.summary_cards(profile.table_profile({"orders": clean_orders(spark, d)}))
    return cards


@query
def profile_many(spark, d):
    names = ("customer", "supplier", "part", "nation", "documents", "conversations")
    tables = {name: table(spark, d, name) for name in names}
    tables["orders"] = clean_orders(spark, d)
    return profile.table_profile(tables).select(
        "table_name", "rows", "cols", "duplicate_rows", "total_missing", "quality_score",
        "quality_grade",
    )


@query
def profile_groups(spark, d):
    return profile.grouped_profile(clean_orders(spark, d), "priority").select(
        "table_name", "rows", "cols", "duplicate_rows", "total_missing", "completeness",
        "uniqueness", "quality_score",
    )


# --- Coercion -----------------------------------------------------------------------------------


@query
def na_normalise(spark, d):
    raw = views.raw_orders(spark, d)
    return coercion.normalise_missing(raw).groupBy("status").agg(F.count("*").alias("n"))


@query
def coerce_numeric(spark, d):
    return clean_orders(spark, d).select("order_id", "customer", "amount")


@query
def coerce_datetime(spark, d):
    return clean_orders(spark, d).select("order_id", "order_date")


@query
def coerce_date_layouts(spark, d):
    """The order date in one layout per column."""
    layouts = {
        "name_dash": "dd-MMM-yyyy", "name_time": "MMM d, yyyy 10:00", "zone": "yyyy-MM-dd'T'10:00:00'+02:00'",
        "half_day": "MM/dd/yyyy 3:05 'PM'", "dots": "dd.MM.yyyy 10:00",
    }
    raw = table(spark, d, "orders").select(
        "o_orderkey", *(F.date_format("o_orderdate", f).alias(name) for name, f in layouts.items())
    )
    return coercion.coerce_types(raw)


@query
def coercion_loss(spark, d):
    raw = coercion.normalise_missing(views.raw_orders(spark, d))
    return coercion.vote_report(raw).select("name", "present", "numbers", "dated", "dates", "lost")


@query
def schema_listing(spark, d):
    return coercion.schema_listing(clean_orders(spark, d))


# --- Analyses -----------------------------------------------------------------------------------


@query
def numeric_summary(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    stats = analysis.numeric_summary(df)
    return stats.select(
        "name", "count", *(F.round(c, 2).alias(c) for c in ("mean", "std")), "min",
        *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3")), "max",
    )


@query
def missing_alert(spark, d):
    return analysis.missing_alert(clean_orders(spark, d))


def _sales(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_partkey", money("l_extendedprice").alias("revenue"), "l_quantity"
    )


@query
def breakdown_product(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return analysis.joined_breakdown(
        _sales(spark, d), "l_partkey", part, "p_partkey", "p_brand", "revenue", "l_quantity"
    )


@query
def breakdown_region(spark, d):
    where = (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name")
    )
    orders = table(spark, d, "orders").select(
        "o_custkey", money("o_totalprice").alias("revenue")
    )
    return analysis.joined_breakdown(
        orders, "o_custkey", where, "c_custkey", "r_name", "revenue"
    )


@query
def breakdown_top_k(spark, d):
    orders = clean_orders(spark, d).select("customer", money("amount").alias("amount"))
    return analysis.breakdown(orders, "customer", "amount", top=10)


@query
def chart_series_bar(spark, d):
    df = clean_orders(spark, d).select("status", money("amount").alias("amount"))
    return analysis.chart_series(df, "status", "amount", "bar").select(
        "x", F.col("y").cast("double").alias("y")
    )


@query
def chart_series_line(spark, d):
    df = clean_orders(spark, d).select("order_date", money("amount").alias("amount"))
    return analysis.chart_series(df, "order_date", "amount", "line").select(
        "x", F.col("y").cast("double").alias("y")
    )


@query
def chart_series_scatter(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return analysis.chart_series(df, "p_partkey", "p_retailprice", "scatter")


@query
def analysis_report(spark, d):
    df = clean_orders(spark, d).withColumn("amount", F.col("amount").cast(MONEY))
    report = analysis.analysis_report(df, "priority", "status", "amount", "customer")
    return report.select("section", "item", F.round("value", 2).alias("value"))


@query
def analysis_report_lines(spark, d):
    df = clean_orders(spark, d).withColumn("amount", F.col("amount").cast(MONEY))
    lines = render.analysis_report_lines(
        df, "priority", "status", "amount", "customer", file="orders.csv"
    )
    return lines.select("block", "place", "line")


@query
def sample_head(spark, d):
    orders = table(spark, d, "orders")
    loaded = delimited.load_table(spark, files.write_ordered(orders, "o_orderkey"), first_rows=100)
    return loaded.df.select(*(F.col(f.name).cast(f.dataType) for f in orders.schema))


@query
def file_sample(spark, d):
    orders = table(spark, d, "orders")
    path = files.write_ordered(orders, "o_orderkey")
    loaded = delimited.load_table(spark, path, sample_rows=1000, seed=5, row_column="row_no")
    return loaded.df.select("row_no", *(F.col(f.name).cast(f.dataType) for f in orders.schema))


# --- Text guardrails ----------------------------------------------------------------------------


@query
def injection_check(spark, d):
    r = views.requests(spark, d).withColumn("m", text.injection_match(F.col("prompt")))
    return r.select(
        "request_id",
        (F.col("m").isNull() & (F.col("prompt") != "")).alias("is_safe"),
        text.injection_reason(F.col("prompt"), F.col("m")).alias("reason"),
    )


@query
def pii_redact(spark, d):
    return views.texts(spark, d, "documents", "doc_id", "text").select(
        "doc_id", text.redact_personal_data(F.col("text")).alias("text")
    )


@query
def pii_counts(spark, d):
    docs = views.texts(spark, d, "documents", "source", "text")
    counts = text.count_personal_data(docs, "text", ["source"])
    return counts.groupBy("source").agg(
        *(F.count_if(F.col(k) > 0).alias(f"{k}_rows") for k in ("email", "phone", "ssn")),
        *(F.sum(k).alias(f"{k}_matches") for k in ("email", "phone", "ssn")),
    )


@query
def sanitize_output(spark, d):
    both = (
        views.texts(spark, d, "documents", "doc_id", "text")
        .select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
        .unionByName(
            views.texts(spark, d, "pages", "page_id", "html").select(
                F.lit("pages").alias("origin"), F.col("page_id").alias("id"),
                F.col("html").alias("text"),
            )
        )
    )
    return text.sanitize(both).select("origin", "id", "cleaned", "was_flagged")


@query
def safe_session_id(spark, d):
    return table(spark, d, "pages").select(
        "page_id", text.safe_session_id(F.col("url")).alias("session")
    )


@query
def response_summary(spark, d):
    return (
        table(spark, d, "conversations")
        .where(F.col("role") == "assistant")
        .select("conv_id", "turn", text.response_summary(F.col("text")).alias("summary"))
    )


@query
def cache_key(spark, d):
    prompt = F.col("prompt")
    return views.requests(spark, d).select(
        "request_id", text.cache_key(prompt, routing.file_path(prompt)).alias("key")
    )


# --- Routing ------------------------------------------------------------------------------------

ORDER_COLUMNS = [
    "order_id", "customer", "status", "amount", "order_date", "priority", "origin", "note",
]


@query
def extract_path(spark, d):
    prompt = F.col("prompt")
    return views.requests(spark, d).select(
        "request_id",
        routing.file_path(prompt).alias("path"),
        routing.clean_question(prompt).alias("question"),
    )


@query
def route_intent(spark, d):
    prompt = F.col("prompt")
    return views.requests(spark, d).select(
        "request_id",
        routing.intent(prompt).alias("intent"),
        routing.wants_summary(prompt).alias("wants_summary"),
    )


@query
def chart_kind(spark, d):
    return views.requests(spark, d).select(
        "request_id", routing.chart_kind(F.col("prompt")).alias("kind")
    )


@query
def resolve_columns(spark, d):
    words = (
        views.requests(spark, d)
        .select(F.explode(F.split("prompt", "[^A-Za-z_]+")).alias("word"))
        .where("word <> ''")
        .distinct()
    )
    return words.select(
        "word", routing.resolve_column(F.col("word"), ORDER_COLUMNS).alias("resolved")
    )


@query
def mentioned_columns(spark, d):
    found = routing.mentioned_columns(F.col("prompt"), ORDER_COLUMNS)
    return views.requests(spark, d).select(
        "request_id", F.array_join(found, ",").alias("columns")
    )


@query
def choose_axes(spark, d):
    typed = clean_orders(spark, d)
    r = views.requests(spark, d).withColumn(
        "mentioned", routing.mentioned_columns(F.col("prompt"), typed.columns)
    )
    x, y = routing.chart_axes(
        F.col("mentioned"), coercion.text_columns(typed), coercion.number_columns(typed),
        typed.columns,
    )
    return r.select("request_id", x.alias("x_column"), y.alias("y_column"))


@query
def report_line_filter(spark, d):
    lines = sessions.report_lines(F.col("text"))
    return views.texts(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.size(lines).cast("bigint").alias("n_lines"),
        F.array_join(lines, "|").alias("lines"),
    )


@query
def markdown_lines(spark, d):
    question = routing.clean_question(F.concat(F.col("source"), F.lit(" (File: x)")))
    return views.texts(spark, d, "documents", "doc_id", "source", "text").select(
        "doc_id", sessions.report_markdown(F.col("text"), question).alias("markdown")
    )


# --- Sessions -----------------------------------------------------------------------------------

DAY = 86_400


@query
def rate_limit(spark, d):
    log = table(spark, d, "events").select("user_id", "ts", "event_id")
    return ratelimit.rate_limit(log, "user_id", "ts", ["event_id"], 3, DAY).select(
        "event_id", "allowed"
    )


@query
def rate_limit_reset(spark, d):
    log = table(spark, d, "events").select(
        "user_id", "ts", "event_id", (F.col("event_type") == "signup").alias("is_reset")
    )
    return ratelimit.rate_limit(
        log, "user_id", "ts", ["event_id"], 3, DAY, reset="is_reset"
    ).select("event_id", "is_reset", "allowed")


@query
def validate_requests(spark, d):
    return sessions.validate_requests(
        views.requests(spark, d), "session", "sent_at", ["request_id"], "prompt", 3, 60
    ).select("request_id", "is_valid", "message")


@query
def session_state(spark, d):
    return sessions.latest_values(
        table(spark, d, "events"), "user_id", "event_id", "event_type", "props",
        F.col("event_type") == "signup",
    )


@query
def session_documents(spark, d):
    return sessions.state_documents(session_state(spark, d))


def _recorded(spark, d):
    return trace.recorded_events(
        views.trace_log(spark, d), "session", "seq",
        F.when(F.col("event_type") == "signup", False).when(
            F.col("event_type") == "purchase", True
        ),
        (F.col("event_type") == "error") & (F.col("seq") % 10 == 0),
    )


@query
def trace_active(spark, d):
    return _recorded(spark, d).select("session", "seq", "event_type")


@query
def trace_text(spark, d):
    return trace.trace_lines(
        _recorded(spark, d), "session", "seq", "ts", "agent_name", "event_type", "message",
        "details",
    )


@query
def trace_document(spark, d):
    return trace.trace_document(trace_text(spark, d), "session", "seq")


@query
def export_transcript(spark, d):
    return sessions.transcript_sections(table(spark, d, "conversations"))


# --- Analyses promised in words -----------------------------------------------------------------


@query
def x_correlation(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return extensions.correlations(df).select("a", "b", F.round("correlation", 6).alias("r"))


@query
def x_histogram(spark, d):
    return extensions.histogram(table(spark, d, "orders"), "o_totalprice", 20)


def _with_gaps(spark, d):
    """Events whose values are NaN in places and null in others."""
    value = F.when(views.every("event_id", 5), F.lit(float("nan"))).when(
        ~views.every("event_id", 7), F.col("value")
    )
    return table(spark, d, "events").select("event_id", "event_type", value.alias("value"))


@query
def breakdown_gaps(spark, d):
    rows = _with_gaps(spark, d)
    cents = F.when(F.isnan("value"), F.lit(float("nan"))).otherwise(F.floor("value"))
    return analysis.breakdown(rows.withColumn("value", cents), "event_type", "value")


@query
def x_histogram_gaps(spark, d):
    return extensions.histogram(_with_gaps(spark, d), "value", 10)


@query
def x_outliers_gaps(spark, d):
    return extensions.outliers(_with_gaps(spark, d), "value", 0.2).select("event_id", "value")


@query
def session_state_gaps(spark, d):
    """Sessions and keys that are null in places."""
    log = table(spark, d, "events").select(
        F.when(~views.every("user_id", 3), F.col("user_id")).alias("user_id"),
        "event_id",
        F.when(~views.every("event_id", 11), F.col("event_type")).alias("event_type"),
        "props",
    )
    clears = views.every("event_id", 50)
    latest = sessions.latest_values(log, "user_id", "event_id", "event_type", "props", clears)
    return latest.select("session", "key", "value", "seq")


@query
def x_outliers(spark, d):
    return extensions.outliers(table(spark, d, "events"), "value").select("event_id", "value")


@query
def x_growth(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderdate", "o_orderpriority", money("o_totalprice").alias("revenue")
    )
    out = extensions.growth(orders, "o_orderdate", "revenue", "o_orderpriority")
    return out.select(
        "o_orderpriority", "month", F.col("total").cast("double").alias("total"),
        F.round(F.col("growth").cast("double"), 4).alias("growth"),
    )


@query
def x_key_overlap(spark, d):
    def column(t, c):
        return table(spark, d, t).select(c)

    out = extensions.key_overlap(
        {
            "orders.o_custkey": column("orders", "o_custkey"),
            "customer.c_custkey": column("customer", "c_custkey"),
            "lineitem.l_orderkey": column("lineitem", "l_orderkey"),
            "orders.o_orderkey": column("orders", "o_orderkey"),
        }
    )
    return out.withColumn("overlap", F.round("overlap", 6))


_STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query
def x_detect_keys(spark, d):
    return keys.detect_keys({name: table(spark, d, name) for name in _STAR})


@query
def x_detect_references(spark, d):
    return keys.detect_references({name: table(spark, d, name) for name in _STAR})


@query
def x_orphans(spark, d):
    return extensions.orphans(
        table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey"
    )


@query
def x_recheck(spark, d):
    out = extensions.recheck(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 2)
    return out.select(
        "name", "count", F.round("mean", 2).alias("mean"), "min", "max", "confirmed"
    )


# --- Files --------------------------------------------------------------------------------------


@query
def load_messy_csv(spark, d):
    path = files.write_csv(
        views.raw_orders(spark, d), "orders", sep=";", encoding="ISO-8859-1"
    )
    return delimited.load_table(spark, path).df


@query
def profile_files(spark, d):
    raw = views.raw_orders(spark, d).withColumn("band", F.substring("priority", 1, 1))
    path = scratch_path(spark, "bands")
    raw.write.partitionBy("band").option("header", True).option("sep", ";").csv(path)
    loaded = delimited.load_table(spark, path, path_column="folder").df
    band = F.regexp_extract("folder", "band=([0-9])", 1)
    return profile.grouped_profile(loaded.withColumn("folder", band), "folder").select(
        "table_name", "rows", "cols", "duplicate_rows", "total_missing", "completeness",
        "uniqueness", "quality_score",
    )


@query
def profile_store(spark, d):
    raw = views.raw_orders(spark, d)
    path, store = scratch_path(spark, "grows"), stored.ProfileStore(spark, scratch_path(spark, "profiles"))
    for half in range(2):
        part = raw.where(F.coalesce(F.col("order_id").cast("long") % 2, F.lit(0)) == half)
        part.write.option("header", True).option("sep", ";").csv(f"{path}/{half}")
        store.update(path)
    return store.profile(path).select(
        "table_name", "rows", "cols", "duplicate_rows", "total_missing", "completeness",
        "uniqueness", "quality_score",
    )


@query
def folder_load(spark, d):
    return folder.load_folder(spark, files.write_customer_folder(spark, d)).df


@query
def folder_status(spark, d):
    status = folder.load_folder(spark, files.write_customer_folder(spark, d)).status
    sheets = F.array_join("sheets", "/").alias("sheets")
    return status.groupBy("ending", "encoding", "delimiter", "status", sheets).agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.max("reason").alias("reason")
    )


@query
def folder_quality_report(spark, d):
    path = files.write_order_folder(views.raw_orders(spark, d))
    return folder.quality_report(spark, path, order_by=["order_id"])


@query
def folder_analysis_report(spark, d):
    path = files.write_order_folder(views.raw_orders(spark, d))
    return folder.analysis_report(
        spark, path, product="priority", region="status", revenue="amount", units="customer"
    )


@query
def csv_roundtrip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = files.write_csv(docs, "documents", quoteAll=True)
    return delimited.load_table(spark, path).df


@query
def load_headerless(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = files.write_csv(customers, "customer", sep=";", header=False)
    return delimited.load_table(spark, path, names=customers.columns, header=False).df


@query
def code_page_rows(spark, d):
    """Every seventh row repeats the header in a code page that Spark's reader does not know."""
    header = F.lit("c_name;c_mktsegment")
    line = F.concat_ws(";", "c_name", "c_mktsegment")
    written = table(spark, d, "customer").select(F.when(views.every("c_custkey", 7), header).otherwise(line))
    path = scratch_path(spark, "code-page")
    written.write.text(path)
    return delimited.read_delimited(
        spark, path, ["c_name", "c_mktsegment"], ";", "CP1252", header=False
    )


@query
def header_normalise(spark, d):
    key = F.col("c_custkey")
    padded = table(spark, d, "customer").select(
        key.alias(" c_custkey "), "c_custkey", F.col("c_name").alias("  "), "c_mktsegment"
    )
    return delimited.load_table(spark, files.write_csv(padded, "customer", sep="|")).df


@query
def ragged_rows(spark, d):
    path = files.write_ragged(spark, d)
    return delimited.read_delimited(
        spark, path, ["order_id", "customer", "status", "priority"], ";", header=False
    )


def _one_line(column: str):
    return F.regexp_replace(column, r"\s+", " ").alias("line")


@query
def detect_encoding(spark, d):
    docs = table(spark, d, "documents")
    plain = docs.select("doc_id", _one_line("text"))
    marked = docs.select(F.col("doc_id").alias("\ufeffdoc_id"), _one_line("text"))
    folders = {
        "plain": files.write_csv(plain, "plain", sep="|"),
        "marked": files.write_csv(marked, "marked", sep="|"),
        "latin": files.write_csv(plain, "latin", sep="|", encoding="ISO-8859-1"),
    }
    parts = [
        sniff.dialects(sniff.sniff(spark, path)).select(
            F.lit(label).alias("folder"),
            "encoding",
            (F.col("lines") - F.col("files")).alias("rows"),
        )
        for label, path in folders.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def detect_delimiter(spark, d):
    paths, owners = [], []
    for name, sep in (("customer", ","), ("orders", ";"), ("lineitem", "\t"), ("part", "|")):
        df = table(spark, d, name)
        paths.append(files.write_csv(df, name, sep=sep))
        owners += [F.lit(sep.join(df.columns)), F.lit(name)]
    return sniff.dialects(sniff.sniff(spark, paths)).select(
        F.element_at(F.create_map(*owners), F.col("header")).alias("folder"),
        F.ascii("delimiter").alias("delimiter_code"),
        (F.col("lines") - F.col("files")).alias("rows"),
    )


@query
def source_meta(spark, d):
    lines = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = files.write_csv(lines, "customer", sep=";", header=False)
    return (
        sniff.source_status(spark, path)
        .where("status = 'ok'")
        .groupBy("encoding", "delimiter")
        .agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))
    )


@query
def union_chunks(spark, d):
    orders = table(spark, d, "orders")
    early = F.col("o_orderpriority") < "3"
    paths = []
    for label, chunk in (("early", orders.where(early)), ("late", orders.where(~early))):
        paths.append(scratch_path(spark, label))
        chunk.write.parquet(paths[-1])
    return spark.read.parquet(*paths)


@query
def admit_files(spark, d):
    endings = F.array(*map(F.lit, (".csv", ".xlsx", ".XLS", ".json", ".tsv", "")))

    def path(key: str):
        ending = F.get(endings, (F.col(key) % 6).cast("int"))
        return F.concat(F.lit("data/f"), F.col(key).cast("string"), ending).alias("path")

    requested = table(spark, d, "events").select(path("user_id"))
    inventory = table(spark, d, "supplier").select(
        path("s_suppkey"), (F.col("s_suppkey") % 10 != 3).alias("is_file")
    )
    return admission.admit_files(requested, inventory)


@query
def workbook_cells(spark, d):
    return workbook.workbook_cells(files.customer_workbooks(spark, d))


@query
def workbook_sheet(spark, d):
    cells = workbook.workbook_cells(files.customer_workbooks(spark, d))
    people = workbook.sheet_table(cells, "Money").drop("path", "row")
    return coercion.coerce_types(people)


@query
def quality_report_lines(spark, d):
    return render.quality_report_lines(clean_orders(spark, d), ["order_id"])


@query
def quality_report_markdown(spark, d):
    return render.quality_report_markdown(clean_orders(spark, d))


# --- Streams ------------------------------------------------------------------------------------


@query
def stream_guardrails(spark, d):
    out = scratch_path(spark, "guardrails")
    jobs.start_guardrails(jobs.table_stream(spark, d, "conversations"), out).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(
        "conv_id", "turn", "is_safe", "reason", "cleaned", "was_flagged"
    )


@query
def stream_rate_limit(spark, d):
    out = scratch_path(spark, "limiter")
    stream = jobs.table_stream(spark, d, "events").select("user_id", "ts", "event_id")
    jobs.start_rate_limit(stream, out, "user_id", "ts", "event_id", 3, DAY).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "status")


@query
def stream_session_state(spark, d):
    out = scratch_path(spark, "memory")
    stream = jobs.table_stream(spark, d, "events")
    clears = F.col("event_type") == "signup"
    jobs.start_session_state(
        stream, out, "user_id", "event_id", "event_type", "props", clears
    ).awaitTermination()
    return jobs.current_state(spark.read.parquet(f"{out}/changes"))
