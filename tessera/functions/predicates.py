"""Predicates with the engine's rules for NULL, text and dates.

WHERE predicates on table columns are two-valued: a negation is the complement over all rows, so ``<>``, ``NOT IN``, ``NOT
BETWEEN``, ``NOT LIKE`` and ``NOT REGEXP`` keep rows whose column is NULL (``null_mode="complement"``, the default). With
``null_mode="sql"`` the usual three values apply; that is the rule inside CASE and IF.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col, text

DATE_ONLY = re.compile(r"\d{4}-\d{2}-\d{2}$")


def negate(p: Column, null_mode: str = "complement") -> Column:
    return F.coalesce(~p, F.lit(True)) if null_mode == "complement" else ~p


def eq(a, b) -> Column:
    """``x = NULL`` is ``x IS NULL``."""
    if b is None:
        return col(a).isNull()
    return col(a) == col(b)


def ne(a, b, null_mode: str = "complement") -> Column:
    """``x <> NULL`` is ``x IS NOT NULL``."""
    if b is None:
        return col(a).isNotNull()
    return negate(col(a) == col(b), null_mode)


_OPS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(a, op: str, b) -> Column:
    """Numbers if both sides read as numbers, else texts: numeric-looking strings are numbers on either side."""
    x, y = text(a).try_cast("double"), text(b).try_cast("double")
    made = _OPS["=" if op in ("!=", "<>") else op]
    both = F.when(x.isNotNull() & y.isNotNull(), made(x, y)).otherwise(made(text(a), text(b)))
    return negate(both) if op in ("!=", "<>") else both


def in_list(a, values) -> Column:
    given = [v for v in values if v is not None]
    found = col(a).isin(*given) if given else F.lit(False)
    return found | col(a).isNull() if len(given) < len(list(values)) else found


def not_in(a, values, null_mode: str = "complement") -> Column:
    return negate(in_list(a, values), null_mode)


def row_in(columns, rows) -> Column:
    """``(a, b) IN ((1, 2), ...)`` as a disjunction of conjunctions, which filters can be pushed from."""
    found = F.lit(False)
    for row in rows:
        every = F.lit(True)
        for c, v in zip(columns, row, strict=True):
            every = every & (col(c) == v)
        found = found | every
    return found


def between(a, low, high) -> Column:
    return col(a).between(col(low), col(high))


def not_between(a, low, high, null_mode: str = "complement") -> Column:
    return negate(between(a, low, high), null_mode)


def like(a, pattern: str) -> Column:
    """Case-sensitive; % and _ only, without escape; wildcards do not cross a new line."""
    if "_" not in pattern:  # forms that Parquet filters know
        body = pattern.strip("%")
        if "%" not in body and body:
            if pattern == body:
                return text(a) == body
            if pattern == body + "%":
                return text(a).startswith(body) & ~_crossing(a, body, "tail")
            if pattern == "%" + body:
                return text(a).endswith(body) & ~_crossing(a, body, "head")
            if pattern == "%" + body + "%" and "\n" not in body:
                return text(a).contains(body) & ~text(a).contains("\n")
    return text(a).rlike("^" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern) + r"\z")


def like_dynamic(a, pattern: Column) -> Column:
    """LIKE with a pattern that is itself an expression."""
    quoted = F.regexp_replace(text(pattern), r"([\\\\.\[\]{}()*+?^$|\-])", r"\\\\$1")
    body = F.replace(F.replace(quoted, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit("."))
    return F.rlike(text(a), F.concat(F.lit("^"), body, F.lit(r"\z")))


def _crossing(a, body: str, part: str) -> Column:
    rest = F.substr(text(a), F.lit(len(body) + 1)) if part == "tail" else F.left(text(a), F.char_length(text(a)) - len(body))
    return rest.contains("\n")


def not_like(a, pattern: str, null_mode: str = "complement") -> Column:
    return negate(like(a, pattern), null_mode)


def regexp(a, pattern: str) -> Column:
    """Unanchored; an invalid pattern matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return text(a).rlike(pattern)


def not_regexp(a, pattern: str, null_mode: str = "complement") -> Column:
    return negate(regexp(a, pattern), null_mode)


def next_day(literal: str) -> str:
    return (datetime.date.fromisoformat(literal) + datetime.timedelta(days=1)).isoformat()


def time_compare(a, op: str, literal: str) -> Column:
    """A date-only literal stands for its whole day in ``<=`` and ``>``."""
    if DATE_ONLY.fullmatch(literal) and op in ("<=", ">"):
        return _OPS["<" if op == "<=" else ">="](col(a), F.lit(next_day(literal)).cast("timestamp_ntz"))
    return _OPS[op](col(a), F.lit(literal).cast("timestamp_ntz"))


def time_between(a, low: str, high: str) -> Column:
    """Bounds as they stand: a date-only upper bound is its midnight."""
    return col(a).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))


def has_value(a, value) -> Column:
    """Equality on a set-valued column: membership."""
    return F.array_contains(col(a), value)
