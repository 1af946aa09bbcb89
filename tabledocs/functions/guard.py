"""Read-only SQL classification, comment stripping and SQL hashes as Column
expressions, so one definition serves a single query and a table of queries
(query logs, streams) alike."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (ALLOWED_FIRST_TOKENS, COMMENT_BLOCK, COMMENT_LINE, IDENTIFIER,
                    LOG_HASH_HEX, MUTATION_KEYWORDS, REASON_EMPTY, REASON_FIRST_TOKEN,
                    REASON_KEYWORD, REASON_MULTI, REASON_NO_KEYWORD, SQL_CACHE_HEX)
from .strings import collapse_ws, let, py_rstrip, py_strip


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_comments(c) -> Column:
    """Block comments first, then ``--`` to the end of the line. String
    literals are not recognised (same as the behaviour reproduced)."""
    return F.regexp_replace(F.regexp_replace(_c(c), COMMENT_BLOCK, ""), COMMENT_LINE, "")


def guard_reason(c) -> Column:
    """Null when the text is a single SELECT / WITH statement, else the reason.

    Steps: empty check; strip comments and whitespace; drop one trailing
    ``;`` and refuse any other; the first identifier must be SELECT or WITH;
    no identifier anywhere may be a mutation keyword. The stripped text is
    computed once; the keyword scan runs only when the first token passes.
    """
    sql = _c(c)
    kw = F.array(*[F.lit(k) for k in MUTATION_KEYWORDS])
    head, tail = REASON_FIRST_TOKEN.split("{}")

    def decide(stripped: Column) -> Column:
        first = F.regexp_extract(stripped, IDENTIFIER, 0)
        first_up = F.upper(first)
        tokens = F.regexp_extract_all(F.upper(stripped), F.lit(IDENTIFIER), F.lit(0))
        bad = F.get(F.filter(tokens, lambda t: F.array_contains(kw, t)), 0)
        return (F.when(F.contains(stripped, F.lit(";")), F.lit(REASON_MULTI))
                .when(first == "", F.lit(REASON_NO_KEYWORD))
                .when(~first_up.isin(*ALLOWED_FIRST_TOKENS), F.concat(F.lit(head), first_up, F.lit(tail)))
                .when(bad.isNotNull(), F.concat(F.lit(REASON_KEYWORD.split("{}")[0]), bad))
                .otherwise(F.lit(None).cast("string")))

    def drop_semicolon(s0: Column) -> Column:
        return F.when(F.endswith(s0, F.lit(";")),
                      py_rstrip(F.substring(s0, F.lit(1), F.length(s0) - 1))).otherwise(s0)

    stripped = let(py_strip(strip_comments(sql)), drop_semicolon)
    reason = let(stripped, decide)
    # Only a blank raw text is "empty"; one made blank by comments has no keyword.
    return F.when(sql.isNull() | (py_strip(sql) == ""), F.lit(REASON_EMPTY)).otherwise(reason)


def sql_log_hash(c) -> Column:
    """Short stable hash of a query for correlating log lines (12 hex)."""
    return F.substring(F.sha2(collapse_ws(_c(c)), 256), 1, LOG_HASH_HEX)


def token_hash(c) -> Column:
    """Short fingerprint of a secret; empty or null gives ``none``."""
    c = _c(c)
    return F.when(c.isNull() | (c == ""), F.lit("none")).otherwise(
        F.substring(F.sha2(c, 256), 1, LOG_HASH_HEX))


def sql_fingerprint(c, day=None) -> Column:
    """Result-cache key: whitespace-collapsed SQL + ``::`` + day, 24 hex."""
    if day is None:
        day = _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d")
    day_col = F.lit(day) if isinstance(day, str) else day
    return F.substring(F.sha2(F.concat(collapse_ws(_c(c)), F.lit("::"), day_col), 256),
                       1, SQL_CACHE_HEX)
