"""Independent SQL for the registered queries, in DuckDB's dialect, on the same tables."""

from __future__ import annotations

from itertools import combinations

from plumbline.functions import fixed
from plumbline.plans.files import ORDER_FILES
from plumbline.plans.views import (
    DIRTY_ORDERS_SQL,
    RAW_ORDERS_SQL,
    REQUESTS_SQL,
    TRACE_LOG_SQL,
)

ORACLES: dict[str, str] = {}

ORDER_COLUMNS = (
    "order_id", "customer", "status", "amount", "order_date", "priority", "origin", "note",
)
ORDER_TYPES = (
    "bigint", "bigint", "string", "double", "timestamp_ntz", "string", "string", "string",
)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def dirty(sql: str) -> str:
    return f"WITH {DIRTY_ORDERS_SQL}\n{sql}"


def requests(sql: str) -> str:
    return f"WITH {REQUESTS_SQL}\n{sql}"


def _redacted(text: str) -> str:
    for _, pattern, placeholder in fixed.PERSONAL_DATA:
        text = f"regexp_replace({text}, {literal(pattern)}, {literal(placeholder)}, 'g')"
    return text


# --- Profile ------------------------------------------------------------------------------------


def _column_profile(table: str, columns=ORDER_COLUMNS, types=ORDER_TYPES, label: str = "t") -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{label}' AS table_name, {i} AS position, '{c}' AS name,
          {str(t != "string").lower()} AS typed, count(*) AS n,
          count(*) - count({c}) AS missing, count(DISTINCT {c}) AS uniq FROM {table}"""
        for i, (c, t) in enumerate(zip(columns, types))
    )


def _table_profile(parts: list[tuple[str, tuple, tuple, str]]) -> str:
    columns = "\nUNION ALL\n".join(_column_profile(t, c, ty, label) for t, c, ty, label in parts)
    copies = "\nUNION ALL\n".join(
        f"""SELECT '{label}' AS table_name,
          (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}))
            AS duplicate_rows"""
        for t, _, _, label in parts
    )
    return f"""cols AS ({columns}),
copies AS ({copies}),
summed AS (
  SELECT table_name, max(n) AS n, count(*) AS cols, CAST(sum(missing) AS BIGINT) AS total_missing,
         count_if(typed) AS typed_cols,
         count_if(missing = n OR (n > 1 AND uniq <= 1)) AS junk
  FROM cols GROUP BY table_name),
dims AS (
  SELECT s.*, c.duplicate_rows,
         1 - total_missing::DOUBLE / greatest(n * cols, 1) AS completeness,
         1 - duplicate_rows::DOUBLE / greatest(n, 1) AS uniqueness,
         typed_cols::DOUBLE / greatest(cols, 1) AS validity,
         1 - junk::DOUBLE / greatest(cols, 1) AS consistency
  FROM summed s JOIN copies c USING (table_name)),
scored AS (
  SELECT *, round(100 * (0.40 * completeness + 0.25 * uniqueness
                         + 0.20 * consistency + 0.15 * validity), 1) AS quality_score
  FROM dims)"""


GRADE_SQL = """CASE WHEN quality_score >= 90 THEN 'A (excellent)'
  WHEN quality_score >= 75 THEN 'B (good)'
  WHEN quality_score >= 60 THEN 'C (usable, review flags)'
  ELSE 'D (needs cleaning)' END"""

ORDERS_PROFILE = _table_profile([("dirty_orders", ORDER_COLUMNS, ORDER_TYPES, "orders")])

ORACLES["table_shape"] = dirty(
    f"SELECT count(*) AS rows, {len(ORDER_COLUMNS)} AS cols,"
    f" count(*) * {len(ORDER_COLUMNS)} AS cells FROM dirty_orders"
)
ORACLES["column_missing"] = dirty(
    f"""SELECT position, name, missing, round(100.0::DOUBLE * missing / n, 2) AS missing_pct
    FROM ({_column_profile("dirty_orders")})"""
)
ORACLES["column_unique"] = dirty(
    f"""SELECT position, name, uniq AS "unique", round(100.0::DOUBLE * uniq / n, 2) AS unique_pct
    FROM ({_column_profile("dirty_orders")})"""
)


def _sample_rows() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT {i} AS position, '{c}' AS name, string_agg(v, ', ' ORDER BY order_id, v) AS sample
        FROM (SELECT order_id, CAST({c} AS VARCHAR) AS v FROM dirty_orders WHERE {c} IS NOT NULL
              ORDER BY order_id, v LIMIT 3) HAVING count(*) > 0"""
        for i, c in enumerate(ORDER_COLUMNS)
    )


ORACLES["column_samples"] = dirty(_sample_rows())
ORACLES["duplicate_rows"] = dirty(
    "SELECT (SELECT count(*) FROM dirty_orders)"
    " - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS duplicate_rows"
)
ORACLES["duplicate_groups"] = dirty(
    "SELECT *, count(*) AS copies FROM dirty_orders GROUP BY ALL HAVING count(*) > 1"
)
ORACLES["quality_dimensions"] = dirty(
    f""", {ORDERS_PROFILE}
    SELECT round(completeness, 4) AS completeness, round(uniqueness, 4) AS uniqueness,
           round(validity, 4) AS validity, round(consistency, 4) AS consistency FROM scored"""
)
ORACLES["quality_score"] = dirty(
    f""", {ORDERS_PROFILE}
    SELECT n AS rows, CAST(cols AS INT) AS cols, duplicate_rows, total_missing, quality_score,
           {GRADE_SQL} AS quality_grade FROM scored"""
)
ORACLES["quality_flags"] = dirty(
    f""", {ORDERS_PROFILE},
worst AS (SELECT name, round(100.0::DOUBLE * missing / n, 2) AS pct FROM cols
          ORDER BY 2 DESC, position LIMIT 1)
SELECT 0 AS flag_no,
       (SELECT total_missing FROM scored) || ' missing cells; worst column ''' || name || ''' ('
       || pct || '% missing)' AS flag FROM worst
UNION ALL SELECT 1, duplicate_rows || ' duplicate row(s)' FROM scored
UNION ALL SELECT 2, 'constant/near-empty column(s): ' || string_agg(name, ', ' ORDER BY position)
FROM cols WHERE n > 1 AND uniq <= 1"""
)
ORACLES["summary_cards"] = dirty(
    f""", {ORDERS_PROFILE}
    SELECT table_name, n AS rows, CAST(cols AS INT) AS cols, quality_score,
           (total_missing > 0)::BIGINT + (duplicate_rows > 0)::BIGINT
             + (EXISTS (SELECT 1 FROM cols WHERE cols.n > 1 AND uniq <= 1))::BIGINT AS flag_count
    FROM scored"""
)
ORACLES["profile_many"] = dirty(
    ", "
    + _table_profile(
        [
            (
                "customer",
                ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
                ("bigint", "string", "int", "double", "string"),
                "customer",
            ),
            (
                "supplier",
                ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
                ("bigint", "string", "int", "double"),
                "supplier",
            ),
            (
                "part",
                ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
                ("bigint", "string", "string", "string", "int", "double"),
                "part",
            ),
            (
                "nation",
                ("n_nationkey", "n_name", "n_regionkey"),
                ("int", "string", "int"),
                "nation",
            ),
            (
                "documents",
                ("doc_id", "text", "lang", "source", "n_chars"),
                ("bigint", "string", "string", "string", "bigint"),
                "documents",
            ),
            (
                "conversations",
                ("conv_id", "turn", "role", "text"),
                ("bigint", "bigint", "string", "string"),
                "conversations",
            ),
            ("dirty_orders", ORDER_COLUMNS, ORDER_TYPES, "orders"),
        ]
    )
    + f""" SELECT table_name, n AS rows, CAST(cols AS INT) AS cols, duplicate_rows, total_missing, quality_score,
    {GRADE_SQL} AS quality_grade FROM scored"""
)

def _grouped_profile(group: str, columns: list[tuple[str, str]]) -> str:
    cells = "\nUNION ALL\n".join(
        f"""SELECT {group} AS g, {str(t != "string").lower()} AS typed, count(*) AS n,
          count(*) - count({c}) AS missing, count(DISTINCT {c}) AS uniq
        FROM dirty_orders GROUP BY {group}"""
        for c, t in columns
    )
    cols = len(columns)
    return dirty(
        f""", cells AS ({cells}),
copies AS (SELECT g, sum(k - 1) AS d FROM (
  SELECT {group} AS g, count(*) AS k FROM dirty_orders GROUP BY {", ".join(ORDER_COLUMNS)})
  GROUP BY g),
summed AS (
  SELECT g, max(n) AS n, CAST(sum(missing) AS BIGINT) AS m, CAST(max(d) AS BIGINT) AS d,
         count(*) FILTER (WHERE typed) / count(*) AS validity,
         1 - count(*) FILTER (WHERE missing = n OR (n > 1 AND uniq <= 1)) / count(*) AS consistency
  FROM cells JOIN copies USING (g) GROUP BY g)
SELECT g AS table_name, n AS rows, {cols} AS cols, d AS duplicate_rows, m AS total_missing,
       round(1 - m / (n * {cols}), 4) AS completeness, round(1 - d / n, 4) AS uniqueness,
       round(100 * (0.40 * (1 - m / (n * {cols})) + 0.25 * (1 - d / n)
                    + 0.20 * consistency + 0.15 * validity), 1) AS quality_score
FROM summed"""
    )


_TYPED_COLUMNS = list(zip(ORDER_COLUMNS, ORDER_TYPES))
ORACLES["profile_groups"] = _grouped_profile(
    "priority", [(c, t) for c, t in _TYPED_COLUMNS if c != "priority"]
)
ORACLES["profile_store"] = _grouped_profile("'table'", _TYPED_COLUMNS)
ORACLES["profile_files"] = _grouped_profile("priority[1]", _TYPED_COLUMNS)

# --- Coercion -----------------------------------------------------------------------------------

ORACLES["na_normalise"] = f"""WITH {RAW_ORDERS_SQL}
SELECT nullif(status, 'N/A') AS status, count(*) AS n FROM raw_orders GROUP BY 1"""
ORACLES["coerce_numeric"] = dirty("SELECT order_id, customer, amount FROM dirty_orders")
ORACLES["coerce_datetime"] = dirty("SELECT order_id, order_date FROM dirty_orders")

ORACLES["coerce_date_layouts"] = """
WITH d AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS t FROM orders)
SELECT o_orderkey, t AS name_dash, t + INTERVAL 10 HOUR AS name_time, t + INTERVAL 8 HOUR AS zone,
       t + INTERVAL 905 MINUTE AS half_day, t + INTERVAL 10 HOUR AS dots FROM d"""


def _loss(column: str, type_name: str | None) -> str:
    c = f"CASE WHEN {column} <> 'N/A' THEN {column} END"
    kept = f"count(TRY_CAST({c} AS {type_name}))" if type_name else f"count({c})"
    return f"""SELECT '{column}' AS name, count({c}) AS present,
      count(TRY_CAST({c} AS DOUBLE)) AS numbers,
      count(*) FILTER (WHERE regexp_matches({c}, '[-/:]')) AS dated,
      count(*) FILTER (WHERE regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS dates,
      count({c}) - {kept} AS lost FROM raw_orders"""


ORACLES["coercion_loss"] = f"WITH {RAW_ORDERS_SQL}\n" + "\nUNION ALL\n".join(
    _loss(c, {"bigint": "BIGINT", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}.get(t))
    for c, t in zip(ORDER_COLUMNS, ORDER_TYPES)
)
ORACLES["schema_listing"] = f"WITH {RAW_ORDERS_SQL}\n" + "\nUNION ALL\n".join(
    f"""SELECT {i} AS position, '{c}' AS name,
      CASE WHEN count({c}) = 0 THEN 'string'
           WHEN count(TRY_CAST({c} AS DOUBLE)) >= greatest(1, floor(0.9 * count({c})))
             THEN CASE WHEN count_if(regexp_full_match({c}, '-?[0-9]+'))
                            = count(TRY_CAST({c} AS DOUBLE)) THEN 'bigint' ELSE 'double' END
           WHEN count_if(regexp_matches({c}, '[-/:]')) > 0.5 * count({c})
             AND count(TRY_CAST({c} AS TIMESTAMP)) >= greatest(1, floor(0.9 * count({c})))
             THEN 'timestamp_ntz'
           ELSE 'string' END AS dtype FROM raw_orders"""
    for i, c in enumerate(ORDER_COLUMNS)
)

# --- Analyses -----------------------------------------------------------------------------------

ORACLES["numeric_summary"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 2) AS mean,
      round(stddev_samp({c}), 2) AS std, min({c}) AS min,
      round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
      round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
ORACLES["missing_alert"] = dirty(
    f"""SELECT CAST(sum(missing) AS BIGINT) AS total_missing,
      'ALERT: Missing values detected in '
        || string_agg(name, ', ' ORDER BY position) FILTER (missing > 0) AS alert
    FROM ({_column_profile("dirty_orders")})"""
)
ORACLES["breakdown_product"] = """
SELECT p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(sum(l_quantity) AS BIGINT) AS units
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY total DESC, p_brand"""
ORACLES["breakdown_region"] = """
SELECT r_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY total DESC, r_name"""
ORACLES["breakdown_top_k"] = dirty(
    """SELECT customer,
      CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS total
    FROM dirty_orders WHERE customer IS NOT NULL GROUP BY customer
    ORDER BY total DESC, customer LIMIT 10"""
)


def _chart(x: str) -> str:
    return dirty(
        f"""SELECT {x} AS x, CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS y
        FROM dirty_orders WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY 1"""
    )


ORACLES["chart_series_bar"] = _chart("status")
ORACLES["chart_series_line"] = _chart("order_date")
ORACLES["chart_series_scatter"] = (
    "SELECT p_partkey AS x, p_retailprice AS y FROM part ORDER BY p_partkey"
)


def _group(section: str, key: str) -> str:
    money = "coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0)"
    return "\nUNION ALL\n".join(
        f"""SELECT '{section}' AS section, {key} || '.{what}' AS item, CAST({value} AS DOUBLE) AS value
        FROM dirty_orders WHERE {key} IS NOT NULL GROUP BY {key}"""
        for what, value in (("revenue", money), ("units", "coalesce(sum(customer), 0)"))
    )


ORACLES["analysis_report"] = dirty(
    f"""SELECT section, item, round(value, 2) AS value FROM (
    SELECT 'shape' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM dirty_orders
    UNION ALL SELECT 'shape', 'columns', {len(ORDER_COLUMNS)}
    UNION ALL SELECT 'missing', name, missing FROM ({_column_profile("dirty_orders")})
    UNION ALL """
    + "\nUNION ALL\n".join(
        f"SELECT 'numeric', '{c}.{stat}', CAST({f}({c}) AS DOUBLE) FROM dirty_orders"
        for c in ("order_id", "customer", "amount")
        for stat, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    )
    + f"""
    UNION ALL {_group("product", "priority")}
    UNION ALL {_group("region", "status")})"""
)
_TYPE_LIST = ", ".join(
    f"'{c}': '{'decimal(18,2)' if c == 'amount' else t}'" for c, t in zip(ORDER_COLUMNS, ORDER_TYPES)
)
_SOLD = """'  ' || {0} || ': $'
  || format('{{:,}}', CAST(round_even(coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0)::DOUBLE, 0) AS BIGINT))
  || ' revenue, ' || CAST(coalesce(sum(customer), 0) AS BIGINT) || ' units'"""
ORACLES["analysis_report_lines"] = dirty(
    f""", cells AS ({_column_profile("dirty_orders")})
SELECT i AS block, k AS place, line FROM (VALUES
  (0, 0, 'DATA SCOUT REPORT'), (0, 1, repeat('=', 18)),
  (0, 2, 'File: orders.csv'), (2, 0, 'Columns: {len(ORDER_COLUMNS)}'),
  (2, 1, 'Column Names: {", ".join(ORDER_COLUMNS)}'), (2, 2, {literal("Data Types: {" + _TYPE_LIST + "}")}),
  (5, 0, ''), (5, 1, 'NUMERIC SUMMARY'), (5, 2, repeat('-', 15)),
  (7, 0, ''), (7, 1, 'PRODUCT-LEVEL BREAKDOWN'), (7, 2, repeat('-', 30)),
  (9, 0, ''), (9, 1, 'REGION-LEVEL BREAKDOWN'), (9, 2, repeat('-', 30)),
  (11, 0, ''), (11, 1, 'DATA QUALITY FLAGS'), (11, 2, repeat('-', 18))) AS v(i, k, line)
UNION ALL SELECT 1, 0, 'Rows: ' || count(*) FROM dirty_orders
UNION ALL SELECT 3, 0, 'Missing Values (Total): ' || CAST(sum(missing) AS BIGINT) FROM cells
UNION ALL SELECT 4, 0, 'Missing Breakdown: {{'
  || string_agg(chr(39) || name || chr(39) || ': ' || missing, ', ' ORDER BY position) || '}}' FROM cells
UNION ALL """
    + "\nUNION ALL ".join(
        f"""SELECT 6, {k}, format('  {c}: mean={{:.2f}}, std={{:.2f}}, min={{:.2f}}, max={{:.2f}}',
        avg({c}), stddev_samp({c}), min({c})::DOUBLE, max({c})::DOUBLE) FROM dirty_orders"""
        for k, c in enumerate(("order_id", "customer", "amount"))
    )
    + f"""
UNION ALL SELECT 8, 0, {_SOLD.format("priority")} FROM dirty_orders GROUP BY priority
UNION ALL SELECT 10, 0, {_SOLD.format("status")} FROM dirty_orders
  WHERE status IS NOT NULL GROUP BY status
UNION ALL SELECT 12, 0, 'ALERT: Missing values detected in '
  || string_agg(name, ', ' ORDER BY position) FILTER (missing > 0) FROM cells"""
)
ORACLES["analysis_report_lines"] = (
    f"SELECT block, place, {_redacted('line')} AS line FROM ({ORACLES['analysis_report_lines']})"
)
# The same report of the orders as read from files: several of them, so no file is named, and doubles.
ORACLES["folder_analysis_report"] = (
    ORACLES["analysis_report_lines"]
    .replace("(0, 2, 'File: orders.csv'), ", "")
    .replace("decimal(18,2)", "double")
)
ORACLES["sample_head"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100"
ORACLES["file_sample"] = """
SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no, * FROM orders)
ORDER BY md5('5:' || row_no) LIMIT 1000
"""

# --- Text guardrails ----------------------------------------------------------------------------


def _injection(text: str) -> str:
    tries = ", ".join(
        f"nullif(regexp_extract({text}, {literal(p)}, 0, 'i'), '')"
        for p in fixed.INJECTION_PATTERNS
    )
    return f"coalesce({tries})"


def _without_unsafe(text: str) -> str:
    for pattern in fixed.UNSAFE_PATTERNS:
        text = (
            f"regexp_replace({text}, {literal(pattern)}, {literal(fixed.UNSAFE_MARKER)}, 'gi')"
        )
    return text


ORACLES["injection_check"] = requests(
    f"""SELECT request_id, m IS NULL AS is_safe,
      coalesce('Prompt injection detected: ''' || m || '''. Request rejected.', 'Input safe')
        AS reason
    FROM (SELECT request_id, {_injection("prompt")} AS m FROM requests)"""
)
ORACLES["pii_redact"] = f"SELECT doc_id, {_redacted('text')} AS text FROM documents"
_counts, _step = [], "text"
for _kind, _pattern, _placeholder in fixed.PERSONAL_DATA:
    _counts.append(f"len(regexp_extract_all({_step}, {literal(_pattern)})) AS {_kind}")
    _step = f"regexp_replace({_step}, {literal(_pattern)}, {literal(_placeholder)}, 'g')"
ORACLES["pii_counts"] = f"""
SELECT source, {", ".join(f"count(*) FILTER (WHERE {k} > 0) AS {k}_rows" for k, _, _ in fixed.PERSONAL_DATA)},
       {", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}_matches" for k, _, _ in fixed.PERSONAL_DATA)}
FROM (SELECT source, {", ".join(_counts)} FROM documents) GROUP BY source"""
ORACLES["sanitize_output"] = f"""
WITH texts AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents
  UNION ALL SELECT 'pages', page_id, html FROM pages),
steps AS (SELECT *, {_without_unsafe("text")} AS step FROM texts)
SELECT origin, id, {_redacted("step")} AS cleaned, step <> text AS was_flagged FROM steps"""
ORACLES["safe_session_id"] = (
    r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_-]', '', 'g') AS session FROM pages"
)
ORACLES["response_summary"] = f"""
SELECT conv_id, turn, CASE WHEN starts_with(text, '{fixed.IMAGE_PREFIX}') THEN 'Chart generated'
  ELSE substring(text, 1, 200) END AS summary FROM conversations WHERE role = 'assistant'"""
_PATH = "nullif(trim(split_part(split_part(prompt, '(File:', 2), ')', 1)), '')"
ORACLES["cache_key"] = requests(
    f"SELECT request_id, md5(prompt || ':' || coalesce({_PATH}, '')) AS key FROM requests"
)

# --- Routing ------------------------------------------------------------------------------------

_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _any(words, text: str = "prompt") -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


ORACLES["extract_path"] = requests(
    f"""SELECT request_id, {_PATH} AS path,
      {_STRIPPED.format("split_part(prompt, '(File:', 1)")} AS question FROM requests"""
)
ORACLES["route_intent"] = requests(
    f"""SELECT request_id, CASE WHEN {_PATH} IS NULL THEN 'chat'
        WHEN {_any(fixed.CHART_WORDS)} THEN 'chart'
        WHEN {_any(fixed.QUALITY_WORDS)} THEN 'quality' ELSE 'analysis' END AS intent,
      {_any(fixed.SUMMARY_WORDS)} AS wants_summary FROM requests"""
)
ORACLES["chart_kind"] = requests(
    f"""SELECT request_id, CASE WHEN {_any(fixed.LINE_WORDS)} THEN 'line'
        WHEN {_any(fixed.SCATTER_WORDS)} THEN 'scatter' ELSE 'bar' END AS kind FROM requests"""
)
_COLUMNS_CTE = "cols(name, pos) AS (VALUES " + ", ".join(
    f"('{c}', {i})" for i, c in enumerate(ORDER_COLUMNS)
) + ")"
_SYNONYMS_CTE = "synonyms(said, target, priority, entry) AS (VALUES " + ", ".join(
    f"('{said}', '{target}', {k}, {e})"
    for e, (said, targets) in enumerate(fixed.COLUMN_SYNONYMS.items())
    for k, target in enumerate(targets)
) + ")"
ORACLES["resolve_columns"] = requests(
    f""", {_COLUMNS_CTE}, {_SYNONYMS_CTE},
words AS (SELECT DISTINCT word FROM (
  SELECT unnest(regexp_split_to_array(prompt, '[^A-Za-z_]+')) AS word FROM requests)
  WHERE word <> ''),
hits AS (
  SELECT word, name, 0 AS rank, pos AS a, 0 AS b FROM words JOIN cols ON lower(name) = lower(word)
  UNION ALL
  SELECT word, name, 1, priority, pos FROM words JOIN synonyms ON said = lower(word)
    JOIN cols ON lower(name) = target
  UNION ALL
  SELECT word, name, 2, pos, 0 FROM words JOIN cols
    ON contains(lower(name), lower(word)) OR contains(lower(word), lower(name)))
SELECT word, coalesce(arg_min(name, (rank, a, b)), word) AS resolved
FROM words LEFT JOIN hits USING (word) GROUP BY word"""
)
_MENTIONS = f"""{_COLUMNS_CTE}, {_SYNONYMS_CTE},
hits AS (
  SELECT request_id, name, 0 AS a, pos AS b, 0 AS c FROM requests
    JOIN cols ON contains(lower(prompt), lower(name))
  UNION ALL
  SELECT request_id, name, 1, entry, priority FROM requests
    JOIN synonyms ON contains(lower(prompt), said) JOIN cols ON lower(name) = target),
firsts AS (SELECT request_id, name, min((a, b, c)) AS place FROM hits GROUP BY 1, 2)"""
ORACLES["mentioned_columns"] = requests(
    f""", {_MENTIONS}
SELECT request_id, coalesce(string_agg(name, ',' ORDER BY place), '') AS columns
FROM requests LEFT JOIN firsts USING (request_id) GROUP BY request_id"""
)
ORACLES["choose_axes"] = requests(
    f""", {_MENTIONS}
SELECT request_id,
  coalesce(arg_min(name, place) FILTER (name IN ('status','priority','origin','note')), 'status')
    AS x_column,
  coalesce(arg_min(name, place) FILTER (name IN ('order_id','customer','amount')), 'order_id')
    AS y_column
FROM requests LEFT JOIN firsts USING (request_id) GROUP BY request_id"""
)
_LINES = r"""list_filter(
  list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')),
  lambda l: l <> '' AND NOT regexp_full_match(l, '[-=]+'))"""
ORACLES["report_line_filter"] = f"""
SELECT doc_id, len(l) AS n_lines, array_to_string(l, '|') AS lines
FROM (SELECT doc_id, {_LINES} AS l FROM documents)"""
_HEADINGS = ", ".join(literal(h) for h in fixed.SECTION_HEADINGS)
ORACLES["markdown_lines"] = f"""
SELECT doc_id, '# Analysis Result' || repeat(chr(10), 2) || '**Question:** ' || source
  || repeat(chr(10), 2)
  || array_to_string(list_transform({_LINES}, lambda l:
       CASE WHEN l = {literal(fixed.ANALYSIS_TITLE)} THEN '## ' || l
            WHEN l IN ({_HEADINGS}) THEN chr(10) || '## ' || l
            WHEN ends_with(l, ':') THEN chr(10) || '**' || l || '**'
            ELSE l END), repeat(chr(10), 2))
  || repeat(chr(10), 2) || '---' AS markdown FROM documents"""

# --- Sessions -----------------------------------------------------------------------------------


def _limiter(log: str, limit: int, seconds: int) -> str:
    """One row per session and step; the allowed times are carried along as a list.

    ``log`` has the columns session, ts, id, clears.
    """
    window = f"list_filter(s.kept, lambda t: g.ts - t < INTERVAL {seconds} SECOND)"
    return f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, id) AS rn FROM ({log})),
walk AS (
  SELECT session, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id,
         CAST([] AS TIMESTAMP[]) AS kept, CAST(NULL AS BOOLEAN) AS allowed
  FROM (SELECT DISTINCT session FROM numbered)
  UNION ALL
  SELECT g.session, g.rn, g.id,
         CASE WHEN g.clears THEN CAST([] AS TIMESTAMP[])
              WHEN len({window}) < {limit} THEN list_append({window}, g.ts)
              ELSE {window} END,
         CASE WHEN g.clears THEN NULL ELSE len({window}) < {limit} END
  FROM walk s JOIN numbered g ON g.session = s.session AND g.rn = s.rn + 1)"""


def _events_log(clears: str) -> str:
    return f"SELECT user_id AS session, ts, event_id AS id, {clears} AS clears FROM events"


ORACLES["rate_limit"] = f"""WITH RECURSIVE {_limiter(_events_log("false"), 3, 86_400)}
SELECT id AS event_id, allowed FROM walk WHERE id IS NOT NULL"""
ORACLES["rate_limit_reset"] = f"""
WITH RECURSIVE {_limiter(_events_log("event_type = 'signup'"), 3, 86_400)}
SELECT w.id AS event_id, n.clears AS is_reset, allowed
FROM walk w JOIN numbered n ON w.id = n.id"""
ORACLES["validate_requests"] = f"""WITH RECURSIVE {REQUESTS_SQL},
checked AS (SELECT *, {_injection("prompt")} AS m FROM requests),
{_limiter(
    "SELECT session, sent_at AS ts, request_id AS id, false AS clears FROM checked WHERE m IS NULL",
    3, 60)}
SELECT request_id, coalesce(allowed, false) AS is_valid,
  CASE WHEN m IS NOT NULL
         THEN 'SECURITY_BLOCKED: Prompt injection detected: ''' || m || '''. Request rejected.'
       WHEN allowed THEN 'Input validated'
       ELSE 'SECURITY_BLOCKED: Rate limit exceeded: 3 requests per 60s. Please wait.' END
    AS message
FROM checked LEFT JOIN walk ON request_id = id"""
_STATE = """SELECT session, key, value, seq FROM (
  SELECT user_id AS session, event_type AS key, props AS value, event_id AS seq,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS latest
  FROM events e WHERE event_type <> 'signup' AND NOT EXISTS (
    SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'signup'
      AND c.event_id > e.event_id)) WHERE latest = 1"""
ORACLES["session_state"] = _STATE
ORACLES["session_documents"] = f"""
SELECT session, '{{' || string_agg(to_json(key) || ':' || to_json(value), ',' ORDER BY key) || '}}'
  AS memory FROM ({_STATE}) GROUP BY session"""
_RECORDED = f"""WITH {TRACE_LOG_SQL},
switched AS (
  SELECT *, last_value(CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 END IGNORE NULLS)
         OVER (PARTITION BY session ORDER BY seq) AS state,
       max(CASE WHEN event_type = 'error' AND seq % 10 = 0 THEN seq END)
         OVER (PARTITION BY session) AS cleared
  FROM trace_log),
recorded AS (
  SELECT * FROM switched WHERE coalesce(state, 1) = 1
    AND event_type NOT IN ('signup', 'purchase') AND (cleared IS NULL OR seq > cleared))"""
ORACLES["trace_active"] = f"{_RECORDED} SELECT session, seq, event_type FROM recorded"
ORACLES["trace_text"] = f"""{_RECORDED}
SELECT session, seq, 0 AS line_no, '' AS line FROM recorded
UNION ALL SELECT session, seq, 1, '[' || strftime(ts, '%H:%M:%S') || '] '
  || CASE event_type WHEN 'tool_call' THEN '[T]' WHEN 'delegate' THEN '->'
       WHEN 'error' THEN '[ERR]' ELSE '*' END || ' ' || agent_name FROM recorded
UNION ALL SELECT session, seq, 2, '    ' || upper(event_type) || ': ' || message FROM recorded
UNION ALL SELECT session, seq, 3, '    * k: ' || detail FROM recorded"""
ORACLES["trace_document"] = f"""
SELECT *, 1 AS part FROM ({ORACLES["trace_text"]})
UNION ALL SELECT session, NULL, k, line, part FROM (
  SELECT DISTINCT session FROM ({ORACLES["trace_text"]})), (VALUES
  (0, 0, repeat('=', 60)), (0, 1, 'AGENT EXECUTION TRACE'), (0, 2, repeat('=', 60)),
  (2, 0, ''), (2, 1, repeat('=', 60))) AS v(part, k, line)"""
ORACLES["export_transcript"] = """
SELECT conv_id, turn AS section_no,
  '## ' || CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || repeat(chr(10), 2)
  || CASE WHEN starts_with(text, 'data:image/png;base64,') THEN '[Chart Image Generated]'
       ELSE text END || repeat(chr(10), 2) AS section FROM conversations
UNION ALL SELECT conv_id, min(turn) - 1, '# Chat Export' || repeat(chr(10), 2)
FROM conversations GROUP BY conv_id"""

# --- Analyses promised in words -----------------------------------------------------------------

_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
ORACLES["x_correlation"] = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for i, a in enumerate(_NUMERIC)
    for b in _NUMERIC[i + 1 :]
)
ORACLES["x_histogram"] = """
WITH span AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders)
SELECT CAST(least(floor((o_totalprice - low) / ((high - low) / 20)), 19) AS BIGINT) AS bin,
       count(*) AS n FROM orders, span GROUP BY 1"""
ORACLES["x_outliers"] = """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""
ORACLES["x_growth"] = """
WITH monthly AS (
  SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1, 2)
SELECT m.o_orderpriority, m.month, CAST(m.total AS DOUBLE) AS total,
       round(CAST(m.total AS DOUBLE) / nullif(CAST(b.total AS DOUBLE), 0) - 1, 4) AS growth
FROM monthly m LEFT JOIN monthly b ON b.o_orderpriority = m.o_orderpriority
  AND b.month = CAST(m.month - INTERVAL 1 MONTH AS DATE)"""
ORACLES["samples_tied"] = """
SELECT 0 AS position, 'k' AS name, '1, 1, 1' AS sample
UNION ALL SELECT 1, 'c_name', (SELECT string_agg(v, ', ' ORDER BY v)
  FROM (SELECT c_name AS v FROM customer ORDER BY v LIMIT 3))
UNION ALL SELECT 2, 'c_mktsegment', (SELECT string_agg(v, ', ' ORDER BY v)
  FROM (SELECT c_mktsegment AS v FROM customer ORDER BY v LIMIT 3))"""
_GAPS = "SELECT event_id, event_type, value FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0"
ORACLES["breakdown_gaps"] = f"""
SELECT t.event_type, coalesce(sum(floor(g.value)), 0) AS total FROM events t
LEFT JOIN ({_GAPS}) g ON g.event_id = t.event_id
GROUP BY t.event_type"""
ORACLES["x_histogram_gaps"] = f"""
WITH g AS ({_GAPS}), span AS (SELECT min(value) AS low, max(value) AS high FROM g)
SELECT CAST(least(floor((value - low) / ((high - low) / 10)), 9) AS BIGINT) AS bin, count(*) AS n
FROM g, span GROUP BY 1"""
ORACLES["x_outliers_gaps"] = f"""
WITH g AS ({_GAPS}), q AS (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM g)
SELECT event_id, value FROM g, q
WHERE value < q1 - 0.2 * (q3 - q1) OR value > q3 + 0.2 * (q3 - q1)"""
ORACLES["session_state_gaps"] = """
WITH log AS (
  SELECT CASE WHEN user_id % 3 <> 0 THEN user_id END AS session, event_id AS seq,
         CASE WHEN event_id % 11 <> 0 THEN event_type END AS key, props AS value,
         event_id % 50 = 0 AS clear FROM events),
cleared AS (SELECT session, max(seq) AS at FROM log WHERE clear GROUP BY session),
live AS (SELECT session, key, arg_max(value, seq) AS value, max(seq) AS seq
         FROM log WHERE NOT clear GROUP BY session, key)
SELECT l.session, l.key, l.value, l.seq FROM live l
LEFT JOIN cleared c ON c.session IS NOT DISTINCT FROM l.session
WHERE c.at IS NULL OR l.seq > c.at"""
_KEYS = {
    "orders.o_custkey": ("orders", "o_custkey"),
    "customer.c_custkey": ("customer", "c_custkey"),
    "lineitem.l_orderkey": ("lineitem", "l_orderkey"),
    "orders.o_orderkey": ("orders", "o_orderkey"),
}
ORACLES["x_key_overlap"] = "SELECT *, round(shared_values / left_values::DOUBLE, 6) AS overlap FROM (" + (
    "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS left_column, '{b}' AS right_column,
      (SELECT count(DISTINCT {_KEYS[a][1]}) FROM {_KEYS[a][0]}) AS left_values,
      (SELECT count(DISTINCT {_KEYS[a][1]}) FROM {_KEYS[a][0]}
       WHERE {_KEYS[a][1]} IN (SELECT {_KEYS[b][1]} FROM {_KEYS[b][0]})) AS shared_values"""
        for a in _KEYS
        for b in _KEYS
        if a != b
    )
) + ")"
#: Columns that can be keys, by table: whole numbers, text, times.
_KEY_COLUMNS = {
    "region": {"r_regionkey": "whole", "r_name": "text"},
    "nation": {"n_nationkey": "whole", "n_name": "text", "n_regionkey": "whole"},
    "customer": {"c_custkey": "whole", "c_name": "text", "c_nationkey": "whole", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "whole", "s_name": "text", "s_nationkey": "whole"},
    "part": {"p_partkey": "whole", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "whole"},
    "orders": {
        "o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_orderdate": "time", "o_orderpriority": "text",
    },
    "lineitem": {
        "l_orderkey": "whole", "l_partkey": "whole", "l_suppkey": "whole", "l_linenumber": "whole", "l_returnflag": "text",
        "l_linestatus": "text", "l_shipdate": "time",
    },
    "events": {"event_id": "whole", "ts": "time", "user_id": "whole", "event_type": "text", "props": "text"},
}


def _key_tests(size: int) -> str:
    tests = []
    for name, columns in _KEY_COLUMNS.items():
        for combo in combinations(columns, size):
            a, b = combo[0], combo[-1]
            whole = f"count({a}) = count(*) AND count({b}) = count(*)"
            tests.append(
                f"SELECT '{name}' AS table_name, '{','.join(combo)}' AS key, '{a}' AS a, '{b}' AS b FROM {name} "
                f"HAVING count(*) > 0 AND {whole} AND count(DISTINCT ({', '.join(combo)})) = count(*)"
            )
    return " UNION ALL ".join(tests)


_SINGLE_KEYS = f"single AS ({_key_tests(1)})"
ORACLES["x_detect_keys"] = f"""WITH {_SINGLE_KEYS}, pair AS ({_key_tests(2)})
SELECT table_name, key FROM single UNION ALL
SELECT table_name, key FROM pair WHERE NOT EXISTS
  (SELECT 1 FROM single s WHERE s.table_name = pair.table_name AND s.a IN (pair.a, pair.b))"""
ORACLES["x_detect_references"] = f"""WITH {_SINGLE_KEYS}, held AS ({
    " UNION ALL ".join(
        f"SELECT DISTINCT '{t}.{c}' AS col, '{kind}' AS kind, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
        for t, columns in _KEY_COLUMNS.items()
        for c, kind in columns.items()
    )
}), own AS (SELECT col, count(*) AS n FROM held GROUP BY col),
shared AS (SELECT a.col AS child, b.col AS parent, count(*) AS n FROM held a JOIN held b
           ON a.kind = b.kind AND a.v = b.v AND a.col <> b.col
           WHERE b.col IN (SELECT table_name || '.' || key FROM single) GROUP BY 1, 2)
SELECT child, parent, c.n AS child_values, p.n AS parent_values FROM shared
JOIN own c ON c.col = child JOIN own p ON p.col = parent WHERE shared.n = c.n"""
ORACLES["x_orphans"] = """
SELECT o_orderkey AS orphan_key, count(*) AS child_rows FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1"""
ORACLES["x_recheck"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 2) AS mean, min({c}) AS min,
      max({c}) AS max, true AS confirmed FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice")
)

# --- Files --------------------------------------------------------------------------------------

ORACLES["load_messy_csv"] = dirty("SELECT * FROM dirty_orders")
ORACLES["csv_roundtrip"] = "SELECT doc_id, text FROM documents"
ORACLES["load_headerless"] = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
ORACLES["code_page_rows"] = """
SELECT CASE WHEN c_custkey % 7 = 0 THEN 'c_name' ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 7 = 0 THEN 'c_mktsegment' ELSE c_mktsegment END AS c_mktsegment
FROM customer"""
ORACLES["header_normalise"] = """
SELECT c_custkey, c_custkey AS "c_custkey.1", c_name AS "Unnamed: 2", c_mktsegment FROM customer"""
ORACLES["ragged_rows"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus || ';"x"' END AS status,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0"""
ORACLES["detect_encoding"] = """
SELECT folder, encoding, (SELECT count(*) FROM documents) AS rows
FROM (VALUES ('plain', 'utf-8'), ('marked', 'utf-8-sig'), ('latin', 'iso-8859-1'))
  AS expected(folder, encoding)"""
ORACLES["detect_delimiter"] = """
SELECT 'customer' AS folder, ascii(',') AS delimiter_code, count(*) AS rows FROM customer
UNION ALL SELECT 'orders', ascii(';'), count(*) FROM orders
UNION ALL SELECT 'lineitem', 9, count(*) FROM lineitem
UNION ALL SELECT 'part', ascii('|'), count(*) FROM part"""
ORACLES["source_meta"] = """
SELECT 'utf-8' AS encoding, ';' AS delimiter, count(*) AS lines,
       CAST(sum(strlen(c_custkey || ';' || c_name || ';' || c_mktsegment) + 1) AS BIGINT) AS bytes
FROM customer"""
ORACLES["union_chunks"] = "SELECT * FROM orders"


def _file_name(key: str) -> str:
    return f"""'data/f' || {key}
      || ['.csv', '.xlsx', '.XLS', '.json', '.tsv', ''][{key} % 6 + 1]"""


ORACLES["admit_files"] = f"""
WITH asked AS (SELECT user_id AS k, {_file_name("user_id")} AS path, count(*) AS requests
               FROM events GROUP BY ALL),
known AS (SELECT {_file_name("s_suppkey")} AS path, s_suppkey % 10 <> 3 AS is_file FROM supplier),
checked AS (
  SELECT asked.*, CASE
    WHEN is_file IS NULL THEN 'File not found: ' || path
    WHEN NOT is_file THEN 'Path is not a file: ' || path
    WHEN k % 6 >= 3 THEN 'Invalid file type: ' || ['.json', '.tsv', ''][k % 6 - 2]
      || '. Allowed: .csv, .xlsx, .xls'
    ELSE '' END AS reason
  FROM asked LEFT JOIN known USING (path))
SELECT path, requests, reason = '' AS ok, reason FROM checked"""


def _number_text(c: str) -> str:
    return f"""CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR)
      ELSE CAST({c} AS VARCHAR) END"""


_BOOKS = """book AS (
  SELECT *, 'book-' || (c_custkey // 500) || '.xlsx' AS path,
         CAST(row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) + 1 AS INT)
           AS row
  FROM customer)"""
ORACLES["workbook_cells"] = f"""WITH {_BOOKS}
SELECT path, 'People' AS sheet, 0 AS sheet_no, row, 1 AS col,
       CAST(c_custkey AS VARCHAR) AS value FROM book
UNION ALL SELECT path, 'People', 0, row, 2, c_name FROM book
UNION ALL SELECT path, 'People', 0, row, 3, c_mktsegment FROM book
UNION ALL SELECT path, 'Money', 1, row, 1, CAST(c_custkey AS VARCHAR) FROM book
UNION ALL SELECT path, 'Money', 1, row, 2, {_number_text("c_acctbal")} FROM book
UNION ALL SELECT path, sheet, sheet_no, 1, col, value
FROM (SELECT DISTINCT path FROM book),
  (VALUES ('People', 0, 1, 'c_custkey'), ('People', 0, 2, 'c_name'),
          ('People', 0, 3, 'c_mktsegment'), ('Money', 1, 1, 'c_custkey'),
          ('Money', 1, 2, 'c_acctbal')) AS heads(sheet, sheet_no, col, value)"""
ORACLES["workbook_sheet"] = "SELECT c_custkey, c_acctbal FROM customer"

_DTYPES = (
    "CASE name "
    + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in zip(ORDER_COLUMNS, ORDER_TYPES))
    + " END"
)


def _pct(dim: str) -> str:
    return f"CAST(round_even(100 * round({dim}, 4), 0) AS INT) || '%'"


_SCORE = f"(SELECT quality_score || '/100  —  ' || {GRADE_SQL} FROM scored)"
_SIZE = "(SELECT 'Rows: ' || format('{:,}', n) || ' | Columns: ' || cols FROM scored)"
_FLAG_ROWS = """worst AS (SELECT name, round(100.0::DOUBLE * missing / n, 2) AS pct FROM cols
          ORDER BY 2 DESC, position LIMIT 1),
flags AS (
  SELECT 0 AS flag_no, (SELECT total_missing FROM scored) || ' missing cells; worst column '''
         || name || ''' (' || pct || '% missing)' AS flag FROM worst
  UNION ALL SELECT 1, duplicate_rows || ' duplicate row(s)' FROM scored
  UNION ALL SELECT 2, 'constant/near-empty column(s): '
    || string_agg(name, ', ' ORDER BY position) FROM cols WHERE n > 1 AND uniq <= 1)"""
_N = len(ORDER_COLUMNS)
ORACLES["quality_report_lines"] = dirty(
    f""", {ORDERS_PROFILE}, {_FLAG_ROWS},
samples AS ({_sample_rows()}),
lines AS (
  SELECT i AS line_no, line FROM (VALUES (0, {literal(fixed.QUALITY_TITLE)}),
    (1, repeat('=', 32)), (2, {_SIZE}), (3, ''), (4, 'DATA QUALITY SCORE: ' || {_SCORE}),
    (6, ''), (7, 'SCHEMA'), (8, '------'), ({9 + _N}, ''), ({10 + _N}, 'FLAGS'),
    ({11 + _N}, '-----')) AS v(i, line)
  UNION ALL SELECT 5, '  completeness=' || {_pct("completeness")} || '  uniqueness='
    || {_pct("uniqueness")} || '  validity=' || {_pct("validity")} || '  consistency='
    || {_pct("consistency")} FROM scored
  UNION ALL SELECT 9 + cols.position, '  ' || name || ' :: ' || {_DTYPES} || ' | missing '
    || round(100.0::DOUBLE * missing / n, 2) || '% | unique ' || uniq || ' | e.g. '
    || coalesce(sample, '—') FROM cols LEFT JOIN samples USING (name)
  UNION ALL SELECT {12 + _N} + flag_no, '  - ' || flag FROM flags)
SELECT line_no, {_redacted("line")} AS line FROM lines"""
)
ORACLES["quality_report_markdown"] = dirty(
    f""", {ORDERS_PROFILE}, {_FLAG_ROWS},
lines AS (
  SELECT i AS line_no, line FROM (VALUES (0, '### Data Quality Report'), (1, ''),
    (2, '## ' || {_SCORE}), (4, ''), (5, {_SIZE}), (6, ''), (7, '**Schema**'), (8, ''),
    (9, '| Column | Type | Missing | Unique |'), (10, '|---|---|---|---|'),
    ({11 + _N}, ''), ({12 + _N}, '**Data Quality Flags**'), ({13 + _N}, ''),
    ({17 + _N}, '')) AS v(i, line)
  UNION ALL SELECT 3, '**Completeness** ' || {_pct("completeness")} || ' · **Uniqueness** '
    || {_pct("uniqueness")} || ' · **Validity** ' || {_pct("validity")}
    || ' · **Consistency** ' || {_pct("consistency")} FROM scored
  UNION ALL SELECT 11 + position, '| ' || name || ' | `' || {_DTYPES} || '` | '
    || round(100.0::DOUBLE * missing / n, 2) || '% | ' || uniq || ' |' FROM cols
  UNION ALL SELECT {14 + _N} + flag_no, '- ' || flag FROM flags)
SELECT line_no, {_redacted("line")} AS line FROM lines"""
)

_HEADER = ";".join(ORDER_COLUMNS)
_ORDER_BYTES = f"""(SELECT {2 * ORDER_FILES * (len(_HEADER) + 1)}
  + CAST(sum(strlen(concat_ws(';', {", ".join(f"coalesce({c}, '')" for c in ORDER_COLUMNS)})) + 1) AS BIGINT)
  FROM raw_orders)"""
ORACLES["folder_quality_report"] = f"""
SELECT line_no + (line_no >= 2)::INT AS line_no, line FROM ({ORACLES["quality_report_lines"]})
UNION ALL SELECT 2, (SELECT 'Encoding: utf-8 | Delimiter: '',, ;'' | Size: ' || format('{{:,}}', n) || ' bytes'
  FROM ({dirty(f"SELECT {_ORDER_BYTES} AS n")}))"""

_CUSTOMER_KINDS = """kinds AS (
  SELECT c_custkey AS k, c_custkey % 4 AS kind, * FROM customer)"""
ORACLES["folder_load"] = f"""
WITH {_CUSTOMER_KINDS}
SELECT c_custkey, c_name || CASE WHEN kind = 2 THEN ' é' ELSE '' END AS c_name,
       CASE WHEN kind = 2 THEN NULL
            ELSE c_mktsegment || CASE WHEN k % 8 = 0 THEN chr(10) || 'line, two' ELSE '' END END AS c_mktsegment,
       CASE WHEN kind = 2 THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey
FROM kinds"""
ORACLES["folder_status"] = f"""
WITH {_CUSTOMER_KINDS}, found AS (
  SELECT '.csv' AS ending, 'utf-8' AS encoding, ',' AS delimiter, 'ok' AS status, NULL AS sheets, 2 AS files,
         2 + count(*) + count(*) FILTER (k % 8 = 0) AS lines, '' AS reason FROM kinds WHERE kind = 0
  UNION ALL SELECT '.tsv', 'utf-8', chr(9), 'ok', NULL, 2, 2 + count(*), '' FROM kinds WHERE kind = 1
  UNION ALL SELECT '.txt', 'iso-8859-1', ';', 'ok', NULL, 2, 2 + count(*), '' FROM kinds WHERE kind = 2
  UNION ALL SELECT '.xlsx', NULL, NULL, 'ok', 'People/Other', count(DISTINCT k // 2000), NULL, ''
            FROM kinds WHERE kind = 3
  UNION ALL SELECT '.xlsx', NULL, NULL, 'unreadable', '', 1, NULL, 'BadZipFile: File is not a zip file'
  UNION ALL SELECT '.xls', NULL, NULL, 'unsupported', NULL, 1, NULL, ''
  UNION ALL SELECT '.json', NULL, NULL, 'refused', NULL, 1, NULL,
            'Invalid file type: .json. Allowed: .csv, .tsv, .txt, .xlsx, .xls')
SELECT * FROM found"""

# --- Streams ------------------------------------------------------------------------------------

_REASON = """coalesce('Prompt injection detected: ''' || m || '''. Request rejected.', 'Input safe')"""
ORACLES["stream_guardrails"] = f"""
WITH steps AS (SELECT *, {_injection("text")} AS m, {_without_unsafe("text")} AS step
               FROM conversations)
SELECT conv_id, turn, m IS NULL AS is_safe, {_REASON} AS reason,
  {_redacted("step")} AS cleaned, step <> text AS was_flagged FROM steps"""
ORACLES["stream_rate_limit"] = f"""WITH RECURSIVE {_limiter(_events_log("false"), 3, 86_400)}
SELECT id AS event_id, CASE WHEN allowed THEN 'allowed' ELSE 'denied' END AS status
FROM walk WHERE id IS NOT NULL"""
ORACLES["stream_session_state"] = _STATE
