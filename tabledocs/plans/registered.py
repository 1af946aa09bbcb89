"""Registered jobs: one callable per operator over the given tables, plus the
independent DuckDB SQL that must give the same answer.

Every job reads whole tables (no id subsets, no row caps); a limit appears
only where it is the feature (top-k search hits, head samples).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guard import guard_reason, sql_fingerprint, sql_log_hash
from ..functions.strings import first_sentence, pre_truncate
from ..operators import audit as A
from ..operators import checks as C
from ..operators import docs as D
from ..operators import entries as N
from ..operators import keyed as K
from ..operators import protect as P
from ..operators import samples as SM
from ..operators import search as Q
from ..operators.textindex import TrigramIndex
from ..session import TABLES, delete_at_end, read_table, shared_dir, spread
from ..sources.catalogs import CatalogDecl, catalog_entries, catalogs_from_decls
from ..sources.manifest import entities_from_tables
from . import registered_metadata as M
from . import sql as S

Job = Callable[[SparkSession, str], DataFrame]


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


# ─── SQL surface ────────────────────────────────────────────────────────────

def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.monthly_revenue(spark, _t(spark, sf_dir, "orders"))


GUARDED_SQL = (
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, "
    "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines "
    "FROM lineitem WHERE l_shipdate <= date '1998-09-02' "
    "GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"
)


MARKDOWN_SQL = ("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders "
                "GROUP BY o_orderpriority, o_orderstatus ORDER BY o_orderpriority, o_orderstatus")


def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guarded query's result as a left-justified markdown table (lines)."""
    _t(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    df, _ = S.run_sql(spark, MARKDOWN_SQL)
    return S.markdown_table_lines(df)


def guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    _t(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    df, _ = S.run_sql(spark, GUARDED_SQL)
    return df


GUARDED_CTE_SQL = """
WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey),
     busy AS (SELECT * FROM spent WHERE n >= (SELECT avg(n) FROM spent))
SELECT c.c_nationkey AS nation, count(*) AS customers, round(sum(b.total), 2) AS total
FROM busy b JOIN customer c ON c.c_custkey = b.o_custkey GROUP BY c.c_nationkey
"""


def guarded_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("orders", "customer"):
        _t(spark, sf_dir, name).createOrReplaceTempView(name)
    df, _ = S.run_sql(spark, GUARDED_CTE_SQL)
    return df


# ─── protection ─────────────────────────────────────────────────────────────

def scrub_documents(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return P.scrub_column(spread(d.select("doc_id", "text")), "text")


def scrub_pages(spark, sf_dir):
    d = _t(spark, sf_dir, "pages")
    return P.scrub_column(spread(d.select("page_id", "html")), "html")


def scrub_conversations(spark, sf_dir):
    d = _t(spark, sf_dir, "conversations")
    return P.scrub_column(spread(d.select("conv_id", "turn", "text")), "text")


def mask_customer(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumnRenamed("c_name", "full_name")
    return P.protect(c)


def pii_scan(spark, sf_dir):
    parts = [P.pii_scan(spread(_t(spark, sf_dir, "documents")), "documents", ["text"]),
             P.pii_scan(spread(_t(spark, sf_dir, "pages")), "pages", ["url", "html"]),
             P.pii_scan(spread(_t(spark, sf_dir, "conversations")), "conversations", ["role", "text"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ─── document corpus ────────────────────────────────────────────────────────

SEARCH_KEYWORD = "thou"
BATCH_KEYWORDS = ["thou", "Eau", "ungs", "schön", "@", "http", "license", "the end"]


def _docs(spark, sf_dir):
    return Q.as_corpus(spread(_t(spark, sf_dir, "documents")), "doc_id", "text")


def list_documents(spark, sf_dir):
    return Q.list_documents(_docs(spark, sf_dir))


def first_sentences(spark, sf_dir):
    d = spread(_t(spark, sf_dir, "documents"))
    return d.select("doc_id", first_sentence(F.col("text")).alias("sentence"))


def search_documents(spark, sf_dir):
    r = Q.search(_docs(spark, sf_dir), SEARCH_KEYWORD)
    return r.withColumn("snippets", F.concat_ws("\n", "snippets"))


def search_batch(spark, sf_dir):
    r = Q.search_batch(_docs(spark, sf_dir), BATCH_KEYWORDS)
    return r.withColumn("snippets", F.concat_ws("\n", "snippets"))


_INDEXES: dict = {}


def _index(spark, sf_dir) -> TrigramIndex:
    """The trigram index of all documents, built in two batches once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = shared_dir(spark, f"tabledocs/indexes/{uuid.uuid4().hex}")
        index, docs = TrigramIndex(spark, path), _docs(spark, sf_dir)
        for half in (0, 1):
            index.append(docs.where(F.coalesce(F.pmod("name", F.lit(2)), F.lit(0)) == half))
        delete_at_end(spark, path)
        _INDEXES[key] = index
    return _INDEXES[key]


def search_batch_many(spark, sf_dir):
    """Eighty keywords by the index, every hit kept."""
    r = _index(spark, sf_dir).search(MANY_KEYWORDS, max_results=None)
    return r.withColumn("snippets", F.concat_ws("\n", "snippets"))


def search_index_many(spark, sf_dir):
    """Two thousand keywords by the index, the first twenty documents of each."""
    r = _index(spark, sf_dir).search(INDEX_KEYWORDS)
    return r.withColumn("snippets", F.concat_ws("\n", "snippets"))


def sample_values(spark, sf_dir):
    """Every text cut as a fetched sample value is."""
    return _t(spark, sf_dir, "documents").select("doc_id", pre_truncate("text").alias("value"))


def read_documents(spark, sf_dir):
    """All documents as a keyed table, and those whose number is a benchmark item's, read by name."""
    path = shared_dir(spark, f"tabledocs/keyed/{uuid.uuid4().hex}")
    K.write_keyed(_docs(spark, sf_dir), path)
    delete_at_end(spark, path)
    return K.lookup_many(spark, path, _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name")))


# Two-letter beginnings with endings that the corpus's words are made of.
MANY_KEYWORDS = [a + b for a in ("th", "er", "st", "in", "re", "un", "qu", "zz") for b in ("ing", "ent", "ion", "eit", "ado", "eau", "xy", "the", "her", "ung")]
INDEX_KEYWORDS = [a + b + c for a in ("th", "er", "st", "in", "re", "un", "le", "sch", "ci", "a ") for b in ("e", "in", "on", "ed", "ea", "ou", "at", "es", "or", "nd")
                  for c in ("th", "ing", "ly", "tion", "er", "en", "an", "ha", "ó", "ß", ". ", "re", "ti", "wh", "sh", "ble", "nt", "of", "is", "to")]


# ─── declared tests on data ─────────────────────────────────────────────────

def _tables(spark, sf_dir, names):
    return {n: _t(spark, sf_dir, n) for n in names}


def test_unique(spark, sf_dir):
    return C.failing_unique(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def test_accepted_values(spark, sf_dir):
    return C.failing_accepted_values(_t(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F"])


def test_relationships(spark, sf_dir):
    # Declared rule: a line's part number is a supplier's number (there are more parts).
    return C.failing_relationships(_t(spark, sf_dir, "lineitem"), "l_partkey", _t(spark, sf_dir, "supplier"), "s_suppkey")


def test_not_null(spark, sf_dir):
    return C.failing_not_null(_t(spark, sf_dir, "events"), "props")


DECLARED_TESTS = [
    C.DeclaredTest("orders", "o_orderkey", "unique"),
    C.DeclaredTest("lineitem", ["l_orderkey", "l_linenumber"], "unique"),
    C.DeclaredTest("documents", "text", "unique"),
    C.DeclaredTest("orders", "o_custkey", "not_null"),
    C.DeclaredTest("events", "props", "not_null"),
    C.DeclaredTest("orders", "o_orderstatus", "accepted_values", {"values": ["O", "F"]}),
    C.DeclaredTest("lineitem", "l_returnflag", "accepted_values", {"values": ["A", "N", "R"]}),
    C.DeclaredTest("events", "event_type", "accepted_values",
                   {"values": ["signup", "click", "view", "purchase"]}),
    C.DeclaredTest("lineitem", "l_orderkey", "relationships", {"to": "orders", "field": "o_orderkey"}),
    C.DeclaredTest("labels", "doc_id", "relationships", {"to": "documents", "field": "doc_id"}),
    C.DeclaredTest("events", "user_id", "relationships", {"to": "customer", "field": "c_custkey"}),
]


def declared_tests(spark, sf_dir):
    names = {t.table for t in DECLARED_TESTS} | {t.kwargs["to"] for t in DECLARED_TESTS if "to" in t.kwargs}
    return C.run_tests(DECLARED_TESTS, _tables(spark, sf_dir, names))


# What the declared tests must read as, spelled out.
_DECLARED_TEXTS = (
    "unique", "unique", "unique", "not_null", "not_null", "accepted_values(values=[O, F])", "accepted_values(values=[A, N, R])",
    "accepted_values(values=[signup, click, view, purchase])", "relationships(to=orders, field=o_orderkey)", "relationships(to=documents, field=doc_id)",
    "relationships(to=customer, field=c_custkey)")


def _ddb_declared_tests() -> str:
    parts = []
    for i, t in enumerate(DECLARED_TESTS):
        cols = t.column if isinstance(t.column, list) else [t.column]
        if t.test == "unique":
            nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
            q = (f"SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {t.table} WHERE {nn} "
                 f"GROUP BY {', '.join(cols)} HAVING count(*) > 1)")
        elif t.test == "not_null":
            q = f"SELECT count(*) FROM {t.table} WHERE {cols[0]} IS NULL"
        elif t.test == "accepted_values":
            vals = ", ".join(_sql_str(v) for v in t.kwargs["values"])
            q = (f"SELECT count(*) FROM {t.table} WHERE {cols[0]} IS NOT NULL "
                 f"AND CAST({cols[0]} AS VARCHAR) NOT IN ({vals})")
        else:
            to, fld = t.kwargs["to"], t.kwargs["field"]
            q = (f"SELECT count(*) FROM {t.table} c WHERE c.{cols[0]} IS NOT NULL AND NOT EXISTS "
                 f"(SELECT 1 FROM {to} p WHERE p.{fld} = c.{cols[0]})")
        col = ",".join(cols)
        text = _DECLARED_TEXTS[i]
        parts.append(
            f"SELECT {i} AS test_pos, '{t.table}' AS table_name, '{col}' AS column_name, "
            f"'{t.test}' AS test_name, '{text}' AS test_text, CAST(({q}) AS BIGINT) AS failures, "
            f"CASE WHEN ({q}) = 0 THEN 'pass' ELSE 'fail' END AS status")
    return " UNION ALL ".join(parts)


# ─── event catalog ──────────────────────────────────────────────────────────

EVENTS_CATALOG_YAML = """\
click:
  description: A user clicks a tracked element.
  attributes:
    k: Key of the clicked element.
purchase:
  description: A user completes a purchase.
  attributes:
    k: Key of the purchased item.
    amount: Amount charged.
signup:
  description: A new user signs up.
view:
  description: A user views a page.
  attributes:
    k: Key of the viewed page.
"""
EVENT_CORE = ["event_id", "ts", "event_type"]


def _event_entries(spark):
    cats = catalogs_from_decls(spark, [CatalogDecl("events", EVENTS_CATALOG_YAML, "events")], inline=True)
    return catalog_entries(cats)


def event_attributes(spark, sf_dir):
    return N.event_attributes(_t(spark, sf_dir, "events"), _event_entries(spark), "event_type",
                              "props", EVENT_CORE)


def event_examples(spark, sf_dir):
    return N.event_attributes(_t(spark, sf_dir, "events"), _event_entries(spark), "event_type",
                              "props", EVENT_CORE, head_limit=5)


_DDB_EVENT_CAT = ("(VALUES ('click', 'k'), ('purchase', 'amount'), ('purchase', 'k'), "
                  "('signup', NULL), ('view', 'k')) AS c(name, attribute)")


# ─── samples and documents ──────────────────────────────────────────────────

SAMPLE_COLUMNS = ["c_custkey", "full_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def sample_transposed(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumnRenamed("c_name", "full_name").select(*SAMPLE_COLUMNS)
    return SM.transposed_lines(SM.sample_long(c, "main.customer", order_by=["c_custkey"])).drop("project")


def sample_cells(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumnRenamed("c_name", "full_name").select(*SAMPLE_COLUMNS)
    return SM.render_cells(SM.head(c, 5, ["c_custkey"]))


# Order of each table's head: keys that tell its rows apart.
HEAD_ORDER = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "events": ["event_id"], "documents": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}


def docs_tables(spark, sf_dir):
    """One document per given table: columns from the schema, five masked and
    scrubbed sample rows, notes block. The samples are the first rows in key
    order (a top-n per task), so that they can be told in advance."""
    tables = {n: _t(spark, sf_dir, n) for n in TABLES}
    ents, cols = entities_from_tables(spark, tables)
    longs = SM.samples_long({f"main.{n}": (df, HEAD_ORDER[n]) for n, df in tables.items()})
    lineage = spark.createDataFrame([], "project string, node_id string, pos long, parent_id string, "
                                        "parent_name string, parent_description string")
    docs, _ = D.build_docs(ents, cols, lineage, samples=SM.transposed_lines(longs))
    return docs.select("slug", "body")


# Columns and types of the given tables, as the documents must show them.
_DOC_COLUMNS = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string", "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _ddb_docs_tables() -> str:
    nl, parts = "chr(10)", []
    for t, declared in _DOC_COLUMNS.items():
        cols = [c.split(" ") for c in declared.split(", ")]
        order = ", ".join(f"{c} NULLS FIRST" for c in HEAD_ORDER[t])
        heads = f" || {nl} || ".join(f"'### {c}' || {nl} || '- Type: `{k}`' || {nl}" for c, k in cols)
        lines = f" || {nl} || ".join(f"'- `{c}`: ' || string_agg({_ddb_cell(c)}, ' | ' ORDER BY {order})" for c, _ in cols)
        parts.append(
            f"SELECT 'main.{t}' AS slug, '# `main.{t}` (source)' || {nl} || {nl} || '## Columns' || {nl} || {nl} || {heads} || {nl} || '## Sample rows (' || count(*) "
            f"|| ' rows, one line per column)' || {nl} || {nl} || {lines} || {nl} || {nl} || '<!-- ↓ MANUAL NOTES BELOW (PRESERVED ACROSS REGENERATION) ↓ -->' || {nl} AS body "
            f"FROM (SELECT * FROM {t} ORDER BY {order} LIMIT 5)")
    return " UNION ALL ".join(parts)


# ─── SQL texts: guard and hashes ────────────────────────────────────────────

def sql_guard(spark, sf_dir):
    c = spread(_t(spark, sf_dir, "conversations"))
    return c.select("conv_id", "turn", guard_reason(F.col("text")).alias("reason"))


def query_log_rollup(spark, sf_dir):
    """Every document and conversation text treated as a submitted query:
    guard outcome and log hash, rolled up per hash."""
    texts = (_t(spark, sf_dir, "documents").select(F.col("text").alias("sql"))
             .unionByName(_t(spark, sf_dir, "conversations").select(F.col("text").alias("sql"))))
    return A.classify_rollup(spread(texts), "sql")


FINGERPRINT_DAY = "2024-01-01"


def sql_hashes(spark, sf_dir):
    c = spread(_t(spark, sf_dir, "conversations"))
    return c.select("conv_id", "turn", sql_log_hash(F.col("text")).alias("sql_hash"),
                    sql_fingerprint(F.col("text"), FINGERPRINT_DAY).alias("cache_key"))


def json_rows(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.json_row(o).alias("row_json"))


def _ddb_cell(x: str) -> str:
    v = f"replace(replace(CAST({x} AS VARCHAR), '|', '\\|'), chr(10), ' ')"
    return f"CASE WHEN {x} IS NULL THEN 'NULL' ELSE {_ddb_cut(_ddb_scrub(v), 80)} END"


def _ddb_sample_transposed() -> str:
    src = ("(SELECT c_custkey, c_name AS full_name, c_nationkey, c_acctbal, c_mktsegment "
           "FROM customer ORDER BY c_custkey LIMIT 5)")
    parts = []
    for i, c in enumerate(SAMPLE_COLUMNS):
        val = "'<pii>'" if c == "full_name" else _ddb_cell(c)
        parts.append(f"SELECT 'main.customer' AS slug, {i} AS col_pos, '{c}' AS column_name, "
                     f"CAST(count(*) AS INTEGER) AS n_rows, "
                     f"'- `{c}`: ' || string_agg({val}, ' | ' ORDER BY c_custkey) AS line FROM {src}")
    return " UNION ALL ".join(parts)


def _ddb_guard(col: str, table: str, keys: str) -> str:
    kw = ", ".join(_sql_str(k) for k in _KEYWORDS)
    allowed = "'SELECT', 'WITH'"
    s0 = _ddb_strip(f"regexp_replace(regexp_replace({col}, {_sql_str(r'(?s)/\*.*?\*/')}, '', 'g'), "
                    f"{_sql_str(r'--[^\n]*')}, '', 'g')")
    rstrip = lambda x: f"regexp_replace({x}, {_sql_str(_BLANK + '+' + chr(92) + 'z')}, '')"
    return (
        f"WITH a AS (SELECT {keys}, {col} AS s, {s0} AS s0 FROM {table}), "
        f"b AS (SELECT *, CASE WHEN ends_with(s0, ';') THEN {rstrip('left(s0, length(s0) - 1)')} "
        f"ELSE s0 END AS st FROM a), "
        f"c AS (SELECT *, regexp_extract(st, {_sql_str(_WORD)}, 0) AS first, "
        f"list_filter(regexp_extract_all(upper(st), {_sql_str(_WORD)}), "
        f"lambda t: list_contains([{kw}], t))[1] AS bad FROM b) "
        f"SELECT {keys}, CASE WHEN s IS NULL OR {_ddb_strip('s')} = '' THEN 'empty SQL' "
        f"WHEN contains(st, ';') THEN 'multiple statements are not allowed' "
        f"WHEN first = '' THEN 'no SQL keyword found' "
        f"WHEN upper(first) NOT IN ({allowed}) THEN "
        f"'only SELECT / WITH queries are allowed (got: ' || upper(first) || ')' "
        f"WHEN bad IS NOT NULL THEN 'query contains disallowed keyword: ' || bad "
        f"ELSE NULL END AS reason FROM c")


def _ddb_sample_cells() -> str:
    cols = ", ".join("'<pii>' AS full_name" if c == "full_name" else f"{_ddb_cell(c)} AS {c}"
                     for c in SAMPLE_COLUMNS)
    return (f"SELECT {cols} FROM (SELECT c_custkey, c_name AS full_name, c_nationkey, c_acctbal, "
            f"c_mktsegment FROM customer ORDER BY c_custkey LIMIT 5)")


def _ddb_query_log_rollup() -> str:
    src = ("(SELECT text FROM documents UNION ALL SELECT text FROM conversations) q")
    collapsed = f"trim(regexp_replace(text, {_sql_str(_BLANK + '+')}, ' ', 'g'))"
    g = _ddb_guard("text", f"(SELECT text, left(sha256({collapsed}), 12) AS sql_hash FROM {src})", "sql_hash")
    return (f"SELECT sql_hash, count(*) AS calls, CAST(count(reason) AS BIGINT) AS rejected "
            f"FROM ({g}) GROUP BY sql_hash")


def _ddb_markdown_table() -> str:
    names = ["o_orderpriority", "o_orderstatus", "n"]
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL') AS c{i}" for i, c in enumerate(names))
    widths = ", ".join(f"greatest({len(c)}, max(length(c{i}))) AS w{i}" for i, c in enumerate(names))

    def row(parts):
        return "'| ' || " + " || ' | ' || ".join(parts) + " || ' |'"
    head = row([f"rpad('{c}', CAST(w{i} AS INTEGER), ' ')" for i, c in enumerate(names)])
    rule = row([f"repeat('-', CAST(w{i} AS INTEGER))" for i in range(len(names))])
    body = row([f"rpad(c{i}, CAST(w{i} AS INTEGER), ' ')" for i in range(len(names))])
    return (f"WITH r AS ({MARKDOWN_SQL}), c AS (SELECT {cells}, 1 + row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) AS pos FROM r), w AS (SELECT {widths} FROM c) "
            f"SELECT 0::BIGINT AS pos, {head} AS line FROM w UNION ALL SELECT 1, {rule} FROM w "
            f"UNION ALL SELECT pos, {body} FROM c, w")


def _ddb_hashes() -> str:
    collapsed = f"trim(regexp_replace(text, {_sql_str(_BLANK + '+')}, ' ', 'g'))"
    return (f"SELECT conv_id, turn, left(sha256({collapsed}), 12) AS sql_hash, "
            f"left(sha256({collapsed} || '::{FINGERPRINT_DAY}'), 24) AS cache_key FROM conversations")


def _ddb_json_rows() -> str:
    return ("SELECT o_orderkey, to_json(struct_pack(o_orderkey := o_orderkey, o_custkey := o_custkey, "
            "o_orderstatus := o_orderstatus, o_totalprice := o_totalprice, "
            "o_orderdate := CAST(o_orderdate AS VARCHAR), o_orderpriority := o_orderpriority)) AS row_json "
            "FROM orders")


# ─── oracle SQL helpers ─────────────────────────────────────────────────────

# FIXED VALUES as the oracle SQL expects them, spelled apart from the library's
# own so that a wrong constant there shows.
_SCRUB = (
    ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    ("phone_intl", r"\+\d{1,3}[\s.-]?\d{1,4}[\s.-]?\d{2,9}[\s.-]?\d{2,9}", "<phone>"),
    ("phone_na", r"\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}", "<phone>"),
)
_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "COPY", "GRANT", "REVOKE", "MERGE", "CALL", "EXECUTE", "DO", "COMMENT",
    "VACUUM", "ANALYZE", "LOCK", "SET", "RESET", "BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "REINDEX", "UNLOAD",
)
_WORD = "[A-Za-z_][A-Za-z0-9_]*"
_BLANK = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ddb_scrub(expr: str) -> str:
    for _, pat, repl in _SCRUB:
        expr = f"regexp_replace({expr}, {_sql_str(pat)}, {_sql_str(repl)}, 'g')"
    return expr


def _ddb_scan(table: str, column: str) -> str:
    parts = []
    for name, pat, _ in _SCRUB:
        n = f"len(regexp_extract_all({column}, {_sql_str(pat)}))"
        parts.append(
            f"SELECT '{table}' AS table_name, CAST(count(*) AS BIGINT) AS rows_total, "
            f"'{column}' AS column_name, '{name}' AS rule, "
            f"CAST(count_if({n} > 0) AS BIGINT) AS rows_matched, "
            f"CAST(count_if({n} > 0) AS DOUBLE) / nullif(count(*), 0) AS share, "
            f"CAST(coalesce(sum({n}), 0) AS BIGINT) AS match_count FROM {table}")
    return " UNION ALL ".join(parts)


def _ddb_strip(x: str) -> str:
    return f"regexp_replace({x}, {_sql_str('^' + _BLANK + '+|' + _BLANK + '+\\z')}, '', 'g')"


def _ddb_cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '…' ELSE {x} END"


def _ddb_summary(text: str) -> str:
    lines = f"string_split_regex({text}, {_sql_str(r'\r\n|\r|\n')})"
    stripped = f"list_transform({lines}, lambda l: {_ddb_strip('l')})"
    first = f"list_filter({stripped}, lambda l: l <> '' AND NOT starts_with(l, '#'))[1]"
    return f"coalesce(left({first}, 200), '')"


def _ddb_matching(text: str, needle: str) -> str:
    return (f"list_filter(string_split_regex({text}, {_sql_str(r'\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')}), "
            f"lambda l: contains(lower(l), {needle}))")


def _ddb_snippets(m: str) -> str:
    return (f"array_to_string(list_transform({m}[1:5], lambda s: "
            f"{_ddb_cut(_ddb_strip('s'), 200)}), chr(10))")


def _ddb_first_sentence(text: str) -> str:
    t = f"trim(regexp_replace({text}, {_sql_str(_BLANK + '+')}, ' ', 'g'))"
    return (f"CASE WHEN strpos({t}, '. ') > 0 THEN left({t}, strpos({t}, '. ')) "
            f"WHEN strpos({t}, '.') > 0 THEN left({t}, strpos({t}, '.')) ELSE {t} END")


def jobs() -> dict[str, Job]:
    return {
        "monthly_revenue": monthly_revenue,
        "guarded_sql": guarded_sql,
        "guarded_cte": guarded_cte,
        "scrub_documents": scrub_documents,
        "scrub_pages": scrub_pages,
        "scrub_conversations": scrub_conversations,
        "mask_customer": mask_customer,
        "pii_scan": pii_scan,
        "list_documents": list_documents,
        "first_sentence": first_sentences,
        "search_documents": search_documents,
        "search_batch": search_batch,
        "search_batch_many": search_batch_many,
        "search_index_many": search_index_many,
        "read_documents": read_documents,
        "sample_values": sample_values,
        "test_unique": test_unique,
        "test_accepted_values": test_accepted_values,
        "test_relationships": test_relationships,
        "test_not_null": test_not_null,
        "declared_tests": declared_tests,
        "event_attributes": event_attributes,
        "event_examples": event_examples,
        "sample_transposed": sample_transposed,
        "docs_tables": docs_tables,
        "sql_guard": sql_guard,
        "sql_hashes": sql_hashes,
        "json_rows": json_rows,
        "sample_cells": sample_cells,
        "query_log_rollup": query_log_rollup,
        "markdown_table": markdown_table,
    } | M.jobs()


def oracles() -> dict[str, str]:
    return {
        "monthly_revenue": S.MONTHLY_REVENUE_SQL,
        "guarded_sql": GUARDED_SQL,
        "guarded_cte": GUARDED_CTE_SQL,
        "scrub_documents": f"SELECT doc_id, {_ddb_scrub('text')} AS text FROM documents",
        "scrub_pages": f"SELECT page_id, {_ddb_scrub('html')} AS html FROM pages",
        "scrub_conversations":
            f"SELECT conv_id, turn, {_ddb_scrub('text')} AS text FROM conversations",
        "mask_customer":
            "SELECT c_custkey, '<pii>' AS full_name, c_nationkey, c_acctbal, "
            f"{_ddb_scrub('c_mktsegment')} AS c_mktsegment FROM customer",
        "pii_scan": " UNION ALL ".join([
            _ddb_scan("documents", "text"), _ddb_scan("pages", "url"),
            _ddb_scan("pages", "html"), _ddb_scan("conversations", "role"),
            _ddb_scan("conversations", "text")]),
        "list_documents":
            f"SELECT doc_id AS name, {_ddb_summary('text')} AS description FROM documents "
            "ORDER BY name",
        "first_sentence": f"SELECT doc_id, {_ddb_first_sentence('text')} AS sentence FROM documents",
        "search_documents":
            f"WITH d AS (SELECT doc_id AS name, text, "
            f"{_ddb_matching('text', _sql_str(SEARCH_KEYWORD))} AS m FROM documents) "
            f"SELECT name, {_ddb_summary('text')} AS description, "
            f"CAST(len(m) AS INTEGER) AS match_count, {_ddb_snippets('m')} AS snippets "
            f"FROM d WHERE len(m) > 0 ORDER BY name LIMIT 20",
        "search_batch":
            "WITH k AS (SELECT unnest(["
            + ", ".join(_sql_str(x) for x in sorted({k.strip().lower() for k in BATCH_KEYWORDS}))
            + "]) AS keyword), "
            f"d AS (SELECT keyword, doc_id AS name, text, "
            f"{_ddb_matching('text', 'keyword')} AS m FROM documents, k) "
            f"SELECT keyword, name, {_ddb_summary('text')} AS description, "
            f"CAST(len(m) AS INTEGER) AS match_count, {_ddb_snippets('m')} AS snippets "
            f"FROM d WHERE len(m) > 0 "
            f"QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY name) <= 20",
        "search_batch_many":
            "WITH k AS (SELECT unnest(["
            + ", ".join(_sql_str(x) for x in MANY_KEYWORDS)
            + "]) AS keyword), "
            f"d AS (SELECT keyword, doc_id AS name, text, "
            f"{_ddb_matching('text', 'keyword')} AS m FROM documents, k) "
            f"SELECT keyword, name, {_ddb_summary('text')} AS description, "
            f"CAST(len(m) AS INTEGER) AS match_count, {_ddb_snippets('m')} AS snippets "
            "FROM d WHERE len(m) > 0",
        "sample_values": "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS value FROM documents",
        "read_documents": "SELECT doc_id AS name, text FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
        "search_index_many":
            "WITH k AS (SELECT unnest([" + ", ".join(_sql_str(x) for x in sorted({k.strip() for k in INDEX_KEYWORDS})) + "]) AS keyword), "
            "t AS (SELECT doc_id, text, lower(text) AS low FROM documents), "
            f"d AS (SELECT keyword, doc_id AS name, text, {_ddb_matching('text', 'keyword')} AS m FROM t, k WHERE contains(low, keyword)) "
            f"SELECT keyword, name, {_ddb_summary('text')} AS description, CAST(len(m) AS INTEGER) AS match_count, {_ddb_snippets('m')} AS snippets "
            "FROM d WHERE len(m) > 0 QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY name) <= 20",
        "test_unique":
            "SELECT l_orderkey, l_linenumber, count(*) AS n_records FROM lineitem "
            "WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL "
            "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
        "test_accepted_values":
            "SELECT o_orderstatus, count(*) AS n_records FROM orders WHERE o_orderstatus IS NOT NULL "
            "AND o_orderstatus NOT IN ('O', 'F') GROUP BY o_orderstatus",
        "test_relationships":
            "SELECT l_partkey, count(*) AS n_records FROM lineitem l WHERE l_partkey IS NOT NULL "
            "AND NOT EXISTS (SELECT 1 FROM supplier p WHERE p.s_suppkey = l.l_partkey) GROUP BY l_partkey",
        "test_not_null": "SELECT * FROM events WHERE props IS NULL",
        "declared_tests": _ddb_declared_tests(),
        "event_attributes":
            "SELECT e.event_id, e.ts, e.event_type, c.attribute, "
            "json_extract_string(e.props, '$.' || c.attribute) AS value "
            f"FROM events e JOIN {_DDB_EVENT_CAT} ON e.event_type = c.name",
        "event_examples":
            "WITH e AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase', 'signup', 'view') "
            "QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id, ts, event_type) <= 5) "
            "SELECT e.event_id, e.ts, e.event_type, c.attribute, "
            "json_extract_string(e.props, '$.' || c.attribute) AS value "
            f"FROM e JOIN {_DDB_EVENT_CAT} ON e.event_type = c.name",
        "sample_transposed": _ddb_sample_transposed(),
        "docs_tables": _ddb_docs_tables(),
        "sql_guard": _ddb_guard("text", "conversations", "conv_id, turn"),
        "sql_hashes": _ddb_hashes(),
        "json_rows": _ddb_json_rows(),
        "sample_cells": _ddb_sample_cells(),
        "query_log_rollup": _ddb_query_log_rollup(),
        "markdown_table": _ddb_markdown_table(),
    } | M.oracles()
