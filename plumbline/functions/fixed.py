"""Fixed values.

Every list, pattern, label and weight in this file is part of the observable behaviour and must
stay exactly as it is for results to be right. Nothing here is logic.
"""

# Words read as missing (exact match, after leading blanks are gone).
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Texts read as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

# Prompt-injection patterns, tried in this order, upper and lower case alike.
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?(previous|prior|earlier)\s+(instructions|commands|prompts)",
    r"forget\s+(your\s+)?(system|original|initial)\s+(prompt|instructions|role)",
    r"you\s+(are\s+now|have\s+become)\s+(a\s+)?(different|new|hacked|compromised)",
    r"disregard\s+(everything|all)\s+(above|before|prior)",
    r"override\s+(your|the)\s+(instructions|constraints|rules)",
    r"act\s+as\s+(if\s+you\s+(are|were)\s+)?(a\s+)?(different|new|unrestricted)",
    r"new\s+instructions?:",
    r"system\s+override",
    r"debug\s+mode",
    r"admin\s+access",
)

# Unsafe output patterns, applied in this order, upper and lower case alike.
UNSAFE_PATTERNS = (
    r"```\s*(python|bash|sh|shell|cmd|powershell)",
    r"</?\s*(script|iframe|object|embed)\b[^>]*>",
    r"javascript:",
    r"on\w+\s*=.*?alert\s*\(",
    r"\b(rm\s+-rf|sudo\s+|chmod\s+|curl\s+.*\||wget\s+.*\|)",
    r"\b(api_key|apikey|password|secret|token)\s*[:=]\s*['\"]",
    r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
)
UNSAFE_MARKER = "[SECURITY: Potentially unsafe content removed]"

# Personal-data patterns with their placeholders, applied in this order.
PERSONAL_DATA = (
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[REDACTED-EMAIL]"),
    (
        "phone",
        r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
        "[REDACTED-PHONE]",
    ),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[REDACTED-SSN]"),
)

# Words a user may say for a column, and the column names tried for each, in order.
COLUMN_SYNONYMS = {
    "revenue": ("amount", "sales", "total", "price"),
    "sales": ("amount", "revenue", "total"),
    "price": ("amount", "cost", "unit_price"),
    "quantity": ("units", "qty", "count"),
    "units": ("quantity", "qty", "count"),
    "customer": ("client", "buyer", "user"),
    "product": ("item", "sku", "goods"),
    "region": ("area", "zone", "territory", "location"),
    "date": ("order_date", "timestamp", "created_at", "datetime"),
}

# Words that decide the intent and the chart kind.
CHART_WORDS = (
    "chart",
    "graph",
    "plot",
    "visualize",
    "bar chart",
    "line chart",
    "scatter",
    "histogram",
)
SUMMARY_WORDS = ("summary", "summarize", "executive", "manager", "brief", "overview")
QUALITY_WORDS = (
    "quality",
    "schema",
    "columns",
    "data types",
    "dtype",
    "missing",
    "duplicate",
    "profile",
    "encoding",
    "delimiter",
    "clean",
    "inspect",
    "structure",
)
LINE_WORDS = ("line", "trend")
SCATTER_WORDS = ("scatter", "correlation")

# Quality weights, grade limits and grade labels.
WEIGHTS = {"completeness": 0.40, "uniqueness": 0.25, "consistency": 0.20, "validity": 0.15}
GRADES = ((90, "A (excellent)"), (75, "B (good)"), (60, "C (usable, review flags)"))
LOWEST_GRADE = "D (needs cleaning)"
NO_FLAGS = "no major data-quality issues detected"

# Headings of the text reports.
QUALITY_TITLE = "DATA SCOUT REPORT (robust loader)"
ANALYSIS_TITLE = "DATA SCOUT REPORT"
SECTION_HEADINGS = (
    "NUMERIC SUMMARY",
    "PRODUCT-LEVEL BREAKDOWN",
    "REGION-LEVEL BREAKDOWN",
    "DATA QUALITY FLAGS",
)

# Trace icons by event type; any other type gets the star.
TRACE_ICONS = {
    "start": ">",
    "tool_call": "[T]",
    "tool_result": "[R]",
    "delegate": "->",
    "complete": "[OK]",
    "error": "[ERR]",
}
OTHER_ICON = "*"
TRACE_TITLE = "AGENT EXECUTION TRACE"
TRACE_RULE = "=" * 60

# File endings admitted for analysis and for the quality report.
ANALYSIS_ENDINGS = (".csv", ".xlsx", ".xls")
QUALITY_ENDINGS = (".csv", ".tsv", ".txt", ".xlsx", ".xls")

# Delimiters tried, in order of preference.
DELIMITERS = (",", ";", "\t", "|")

# Fixed value: how a chart payload starts.
IMAGE_PREFIX = "data:image/png;base64,"

# Messages of the guardrails.
EMPTY_INPUT = "Empty or invalid input"
INJECTION_FOUND = ("Prompt injection detected: '", "'. Request rejected.")
INPUT_SAFE = "Input safe"
BLOCKED = "SECURITY_BLOCKED: "
VALIDATED = "Input validated"
LIMIT_EXCEEDED = "Rate limit exceeded: {} requests per {}s. Please wait."

# Reasons for refusing a file.
NO_PATH = "Invalid file path provided."
NOT_FOUND = "File not found: "
NOT_A_FILE = "Path is not a file: "
WRONG_TYPE = ("Invalid file type: ", ". Allowed: ")

# Findings of the profile and the alert of the analysis.
MISSING_FLAG = (" missing cells; worst column '", "' (", "% missing)")
DUPLICATE_FLAG = " duplicate row(s)"
CONSTANT_FLAG = "constant/near-empty column(s): "
MISSING_ALERT = "ALERT: Missing values detected in "
NO_ALERT = "No missing values detected."

# Messages of the chart.
NO_COLUMN = "Column '{}' not found. Available: {}"
WRONG_CHART = "Unsupported chart_type '{}'. Use: {}."

# What stands for a chart in memory and in a transcript.
CHART_SUMMARY = "Chart generated"
CHART_IN_TRANSCRIPT = "[Chart Image Generated]"
