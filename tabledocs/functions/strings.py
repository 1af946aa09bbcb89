"""Column expressions for Python-compatible text handling.

Python's ``str.split()`` / ``strip()`` / ``splitlines()`` use Unicode
whitespace and line-break sets that Spark's ``trim`` and ``split`` do not;
these helpers give the same results with built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (CELL_MAX_LEN, ELLIPSIS, FILE_LINE_BREAK, NULL_TEXT, PY_WS_CHARS, PY_WS_CLASS,
                    SPLITLINES_BREAK, VALUE_MAX_LEN)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace (a
    character-set trim, no regex)."""
    return F.btrim(_c(c), F.lit(PY_WS_CHARS))


def py_rstrip(c) -> Column:
    return F.rtrim(_c(c), F.lit(PY_WS_CHARS))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element
    ``transform``): expressions used in several CASE branches are otherwise
    recomputed per branch."""
    return F.get(F.transform(F.array(value), body), 0)


def collapse_ws(c) -> Column:
    """``" ".join(s.split())``: runs of whitespace become one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(c), f"{PY_WS_CLASS}+", " "))


def split_lines(c) -> Column:
    """``str.splitlines()``: Python's break set; a final empty piece is dropped."""
    parts = F.split(_c(c), SPLITLINES_BREAK, -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


def file_lines(c) -> Column:
    """Lines as a text file iterates them (``\\n``, ``\\r``, ``\\r\\n``)."""
    parts = F.split(_c(c), FILE_LINE_BREAK, -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


def cut(c, n: int, suffix: str = ELLIPSIS) -> Column:
    """Keep the first ``n`` characters; add ``suffix`` when something was cut."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def pre_truncate(c) -> Column:
    """Value cut applied to fetched sample values (null stays null)."""
    return cut(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), VALUE_MAX_LEN)


def null_text(c) -> Column:
    """A cell's text: null becomes ``NULL``."""
    return F.coalesce(_c(c).cast("string"), F.lit(NULL_TEXT))


def cell(c, scrub=None) -> Column:
    """Markdown cell text: null → NULL, escape ``|``, newline → space, scrub, cut."""
    c = _c(c)
    s = F.replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    if scrub is not None:
        s = scrub(s)
    return F.when(c.isNull(), F.lit(NULL_TEXT)).otherwise(cut(s, CELL_MAX_LEN))


# A dot followed by whitespace and then more text: it becomes ". " once the
# whitespace is collapsed (a dot followed only by trailing whitespace does not).
_DOT_SPACE = "\\.(?=" + PY_WS_CLASS + "+[^" + PY_WS_CLASS[1:-1] + "])"


def first_sentence(c) -> Column:
    """First sentence of a description: collapse whitespace, cut after the
    first ``". "``, else after the first ``"."``, else keep everything.

    The boundary is found in the raw text (the first dot that collapsing
    turns into ``". "``, else the first dot), and whitespace is collapsed up
    to it only. Collapsing commutes with taking that leading part, so the
    result equals collapsing the whole text first, without rewriting it."""
    t = F.coalesce(_c(c), F.lit(""))
    i_dot_space = F.regexp_instr(t, F.lit(_DOT_SPACE))
    i_dot = F.instr(t, ".")
    return (F.when(i_dot_space > 0, collapse_ws(F.substring(t, F.lit(1), i_dot_space)))
            .when(i_dot > 0, collapse_ws(F.substring(t, F.lit(1), i_dot)))
            .otherwise(collapse_ws(t)))


def first_sentence_or(c, fallback: str) -> Column:
    s = first_sentence(c)
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def py_title(c) -> Column:
    """``str.title()``: a letter after an uncased character is upper-cased,
    any other letter lower-cased (so ``feature-flags`` → ``Feature-Flags``,
    ``1st`` → ``1St``)."""
    chars = F.regexp_extract_all(_c(c), F.lit("(?s)."), F.lit(0))
    cased = "[\\p{Lu}\\p{Ll}\\p{Lt}]"

    def one(ch, i):
        prev = F.when(i > 0, F.element_at(chars, i)).otherwise(F.lit(""))
        return F.when(prev.rlike(cased), F.lower(ch)).otherwise(F.upper(ch))
    return F.array_join(F.transform(chars, one), "")


def template(text: str, **values) -> Column:
    """A fixed format with ``{name}`` slots filled by columns (or plain
    strings): the literal pieces stay exactly as written in the format."""
    import re as _re
    parts = []
    pos = 0
    for m in _re.finditer(r"\{(\w+)\}", text):
        if m.start() > pos:
            parts.append(F.lit(text[pos:m.start()]))
        v = values[m.group(1)]
        parts.append(v if isinstance(v, Column) else F.lit(str(v)))
        pos = m.end()
    if pos < len(text):
        parts.append(F.lit(text[pos:]))
    return F.concat(*parts) if len(parts) > 1 else (parts[0] if parts else F.lit(""))
