"""Fixed values that results depend on.

FIXED VALUES: everything in this module must stay equal to the behaviour this
library reproduces (patterns, word lists, limits, marker texts). They are kept
together, in their natural order, as plain text. Logic lives elsewhere.
"""

from __future__ import annotations

# --- FIXED VALUES: default value-scrub rules, applied in this order ---------
# (name, Python-syntax pattern, replacement)
DEFAULT_SCRUB_RULES: tuple[tuple[str, str, str], ...] = (
    ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    ("phone_intl", r"\+\d{1,3}[\s.-]?\d{1,4}[\s.-]?\d{2,9}[\s.-]?\d{2,9}", "<phone>"),
    ("phone_na", r"\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}", "<phone>"),
)

# --- FIXED VALUES: PII by column name ---------------------------------------
PII_SKIP_PREFIXES = r"^(is_|has_|count_|num_|total_|send_|users_)"
PII_NAME_PATTERNS = (
    r"^email$"
    r"|_email$"
    r"|^email_address$"
    r"|^(first|last|middle|full)_name$"
    r"|^phone(_number)?$|_phone$"
    r"|^(twitter|linkedin|facebook|instagram|github)_(handle|bio|username|profile|followers|url)$"
    r"|^ip(_addr(ess)?)?$|_ip_addr(ess)?$"
    r"|^bio$"
    r"|^job_title$"
    r"|^password(_hash)?$|^secret(_key)?$|_secret$"
    r"|^mfa_"
)
PII_REDACTED = "<pii>"

# --- FIXED VALUES: read-only SQL guard ---------------------------------------
MUTATION_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE",
    "COPY", "GRANT", "REVOKE", "MERGE", "CALL", "EXECUTE", "DO", "COMMENT",
    "VACUUM", "ANALYZE", "LOCK", "SET", "RESET", "BEGIN", "COMMIT", "ROLLBACK",
    "SAVEPOINT", "REINDEX", "UNLOAD",
)
ALLOWED_FIRST_TOKENS = ("SELECT", "WITH")
COMMENT_BLOCK = r"(?s)/\*.*?\*/"
COMMENT_LINE = r"--[^\n]*"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
REASON_EMPTY = "empty SQL"
REASON_MULTI = "multiple statements are not allowed"
REASON_NO_KEYWORD = "no SQL keyword found"
REASON_FIRST_TOKEN = "only SELECT / WITH queries are allowed (got: {})"
REASON_KEYWORD = "query contains disallowed keyword: {}"

# --- FIXED VALUES: Python whitespace (str.split / str.strip) ----------------
# Java/RE2 character class with the same members as Python's str.isspace().
PY_WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same members as one string (for trim functions that take a character set).
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
# Line breaks of Python str.splitlines().
SPLITLINES_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
# Line breaks when a text file is read line by line (universal newlines).
FILE_LINE_BREAK = r"\r\n|\r|\n"

# --- FIXED VALUES: rendering limits and texts --------------------------------
SAMPLE_SIZE = 5
VALUE_MAX_LEN = 200
CELL_MAX_LEN = 80
ELLIPSIS = "…"
NULL_TEXT = "NULL"
SEARCH_MAX_RESULTS = 20
SEARCH_MAX_SNIPPETS = 5
SEARCH_SNIPPET_MAX_LEN = 200
SUMMARY_MAX_LEN = 200
NO_DESCRIPTION = "(no description)"
NO_COLUMNS = "## Columns\n\n_(No columns documented.)_\n"
INDEX_TITLE = "# Schema index"
INDEX_BLURB = "One file per table/source. Grep or Read directly — no scripts needed."
INDEX_FILE = "_index.md"
MANUAL_MARKER = "<!-- ↓ MANUAL NOTES BELOW (PRESERVED ACROSS REGENERATION) ↓ -->"
MANUAL_PLACEHOLDER = "\n" + MANUAL_MARKER + "\n"
EM_DASH = "—"
DEFAULT_MODEL_SCHEMA = "prod"
DEFAULT_SOURCE_SCHEMA = "public"
TEST_KWARG_SKIP = ("column_name", "model")
SOURCE_TEMPLATE = r"source\(\s*'([^']+)'\s*,\s*'([^']+)'\s*\)"
REF_TEMPLATE = r"ref\(\s*'([^']+)'\s*\)"
SAMPLE_CACHE_VERSION = 1
RESULT_CACHE_TTL_SECONDS = 24 * 60 * 60
SQL_CACHE_HEX = 24
LOG_HASH_HEX = 12

# --- FIXED VALUES: document formats ({name} marks a value) -------------------
DOC_HEADER = "# `{slug}` ({label})"
LABEL_MODEL = "model"
LABEL_SOURCE = "source"
LABEL_CATALOG = "source — {kind} catalog"
COLUMNS_HEADING = "## Columns"
COLUMN_HEADING = "### {name}"
COLUMN_TYPE = "- Type: `{data_type}`"
COLUMN_TESTS = "- Tests: {tests}"
TESTS_SEPARATOR = ", "
PARENTS_HEADING = "## Parents"
PARENT_LINE = "- `{name}` — {summary}"
SAMPLES_HEADING = "## Sample rows ({n} rows, one line per column)"
SAMPLE_LINE = "- `{column}`: {values}"
SAMPLE_SEPARATOR = " | "
SQL_HEADING = "## Compiled SQL"
SQL_FENCE_OPEN = "```sql"
SQL_FENCE_CLOSE = "```"
INDEX_MODELS = "## Models"
INDEX_SOURCES = "## Sources"
INDEX_LINE = "- [`{slug}`](./{slug}.md) — {summary}"
CATALOG_TITLE = "## {title}"
CATALOG_ENTRY = "### `{name}`"
FIELD_INLINE = "**{label}:** {value}"
FIELD_HEADING = "**{label}:**"
FIELD_ITEM = "- {item}"
FIELD_KEY_VALUE = "- `{key}` — {value}"
FIELD_KEY = "- `{key}`"
FIELD_YES = "yes"
FIELD_NO = "no"

# --- FIXED VALUES: the two worked catalog kinds (events, plans) --------------
EVENTS_INTRO = ("The `{column}` column below is a filter on the event name. Attributes live in the "
                "`{data_column}` column and are accessed as `{data_column}.\"attr\"::text`.")
EVENTS_ATTRIBUTE = '{data_column}."{attr}"::text as "{attr}"'
EVENTS_QUERY = "select\n    {columns}\nfrom {table}\nwhere {column} = '{name}'\nlimit {head_limit}"
EVENTS_QUERY_COLUMN_SEPARATOR = ",\n    "
EVENTS_QUERY_LABEL = "**Example query:**"
PLANS_INTRO = "At a glance:"
PLANS_TABLE_HEADER = "| Tier | Price | Seats |"
PLANS_TABLE_RULE = "| --- | --- | --- |"
PLANS_TABLE_ROW = "| `{name}` | {price} | {seats} |"
PLANS_DEPRECATED = "> **Deprecated** — new signups are not allowed."
PLANS_LINK = "[See `{name}` pricing]({url})"
