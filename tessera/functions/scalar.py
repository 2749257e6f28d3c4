"""Scalar functions of the SQL surface as Column expressions.

Any NULL argument gives NULL unless stated. Numbers are doubles: ``sum``, arithmetic and rounding functions return
double. Strings count code points. Nothing here is a UDF; every function stays inside code generation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | int | float | bool | None


def col(x: ColumnLike) -> Column:
    """A Column as it is; any other value as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def num(x: ColumnLike) -> Column:
    return col(x).cast("double")


def text(x: ColumnLike) -> Column:
    return col(x).cast("string")


def _guard(cond: Column, value: Column, *args: Column) -> Column:
    """NULL if any argument is; ``value`` where ``cond``; else the empty string."""
    null = F.lit(False)
    for a in args:
        null = null | a.isNull()
    return F.when(null, F.lit(None)).when(cond, value).otherwise(F.lit(""))


# -- arithmetic --------------------------------------------------------------------------------

def add(a, b): return num(a) + num(b)
def subtract(a, b): return num(a) - num(b)
def multiply(a, b): return num(a) * num(b)
def divide(a, b):
    """Always double; division by zero is an error."""
    return F.when(num(b) == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(F.try_divide(num(a), num(b)))


def abs_(x): return F.abs(num(x))
def round_(x, d=0):
    """Half away from zero; d may be negative."""
    return F.round(num(x), d)
def floor(x): return F.floor(num(x)).cast("double")
def ceil(x): return F.ceil(num(x)).cast("double")
def truncate(x, d=0):
    """Toward zero."""
    scale = F.lit(10.0 ** d)
    return F.signum(num(x)) * F.floor(F.abs(num(x)) * scale) / scale
def mod(a, b):
    """Sign of the dividend; NULL for a zero divisor."""
    return F.try_mod(num(a), num(b))
def pow_(a, b): return F.pow(num(a), num(b))
def sign(x): return F.signum(num(x)).cast("int")


# -- conditionals ------------------------------------------------------------------------------

def coalesce(*xs): return F.coalesce(*map(col, xs))
def ifnull(a, b): return F.coalesce(col(a), col(b))
def nullif(a, b):
    """a, or NULL where a equals b; a where either is NULL."""
    return F.when(col(a) == col(b), F.lit(None)).otherwise(col(a))
def isnull(x): return col(x).isNull().cast("int")
def truthy(x) -> Column:
    """A number other than zero, or a string that reads as one; NULL and other strings are false."""
    return F.coalesce(text(x).try_cast("double") != 0, F.coalesce(text(x).try_cast("boolean") & text(x).isin("true", "false"), F.lit(False)))
def if_(cond, a, b): return F.when(truthy(cond), col(a)).otherwise(col(b))
def _extreme(pick: Callable, xs: tuple) -> Column:
    """NULL if any is; numbers if all read as numbers, else texts. The result is text unless all columns are numeric."""
    columns = [*map(col, xs)]
    null = F.lit(False)
    for c in columns:
        null = null | c.isNull()
    return F.when(~null, pick(*columns))
def greatest(*xs): return _extreme(F.greatest, xs)
def least(*xs): return _extreme(F.least, xs)


# -- strings -----------------------------------------------------------------------------------

def lower(s): return F.lower(text(s))
def upper(s): return F.upper(text(s))
def length(s): return F.char_length(text(s))
def substr(s, start, n=None):
    """1-based; start 0 gives '', a negative start is the beginning, n <= 0 gives ''."""
    s, start = text(s), col(start)
    if n is None:
        return _guard(start != 0, F.substr(s, F.greatest(start, F.lit(1))), s, start)
    return _guard((start != 0) & (col(n) > 0), F.substr(s, F.greatest(start, F.lit(1)), col(n)), s, start, col(n))
def concat(*xs): return F.concat(*map(text, xs))
def concat_ws(sep, *xs):
    """NULL for a NULL separator; NULL arguments are left out."""
    present = F.filter(F.array(*map(text, xs)), lambda x: x.isNotNull())
    return F.when(text(sep).isNotNull(), F.call_function("array_join", present, text(sep)))
_SPACE = r"[\s\u0085   -     　]+"
def ltrim(s): return F.regexp_replace(text(s), "^" + _SPACE, "")
def rtrim(s): return F.regexp_replace(text(s), _SPACE + "$", "")
def trim(s, what: str | None = None, where: str = "both"):
    """Unicode white space; with ``what`` the repeated substring, at either or both ends."""
    if what is None:
        return rtrim(ltrim(s))
    if what == "":
        return text(s)
    quoted, out = re.escape(what), text(s)
    if where in ("both", "leading"):
        out = F.regexp_replace(out, f"^(?:{quoted})+", "")
    if where in ("both", "trailing"):
        out = F.regexp_replace(out, f"(?:{quoted})+$", "")
    return out
def replace(s, old, new):
    return F.when(text(old) == "", text(s)).otherwise(F.replace(text(s), text(old), text(new)))
def left(s, n): return _guard(col(n) > 0, F.left(text(s), col(n)), text(s), col(n))
def right(s, n): return _guard(col(n) > 0, F.right(text(s), col(n)), text(s), col(n))
def repeat(s, n): return _guard(col(n) > 0, F.repeat(text(s), col(n).cast("int")), text(s), col(n))
def reverse(s): return F.reverse(text(s))
def _pad(pad: Callable, s, n, fill) -> Column:
    """NULL for n < 0; cut to n if longer; '' if there is nothing to pad with."""
    s, n, fill = text(s), col(n), text(fill)
    null = s.isNull() | n.isNull() | fill.isNull() | (n < 0)
    return F.when(null, F.lit(None)).when(n <= F.char_length(s), F.left(s, n)).when(fill == "", F.lit("")).otherwise(pad(s, n.cast("int"), fill))
def lpad(s, n, fill): return _pad(F.lpad, s, n, fill)
def rpad(s, n, fill): return _pad(F.rpad, s, n, fill)
def ascii_(s):
    """The first byte; 0 for ''."""
    return F.when(text(s) == "", 0).otherwise(F.conv(F.substring(F.hex(F.encode(text(s), "UTF-8")), 1, 2), 16, 10).cast("int"))
def locate(needle, s, start=1):
    """1-based; 0 for a start below 1; an empty needle is found at the start."""
    needle, s, start = text(needle), text(s), col(start)
    null = needle.isNull() | s.isNull() | start.isNull()
    found = F.call_function("locate", needle, s, F.greatest(start, F.lit(1)).cast("int"))
    inside = F.when(start < 1, 0).when(needle == "", F.when(start <= F.char_length(s) + 1, start).otherwise(0)).otherwise(found)
    return F.when(~null, inside).cast("int")
def instr(s, needle): return locate(needle, s)
def sha256(x): return F.sha2(text(x), 256)


# -- dates -------------------------------------------------------------------------------------

def year(d): return F.year(col(d))
def month(d): return F.month(col(d))
def yymm(d): return F.year(col(d)) * 100 + F.month(col(d))
def day(d): return F.dayofmonth(col(d))
def dayname(d): return F.date_format(col(d), "EEEE")
def monthname(d): return F.date_format(col(d), "MMMM")
def quarter(d): return F.quarter(col(d))
def week(d, mode: int = 0):
    """Weeks start on Sunday, 0 to 53; no other mode."""
    if mode != 0:
        raise ValueError("only week mode 0 is supported")
    return F.floor((F.dayofyear(col(d)) + 6 - (F.dayofweek(col(d)) - 1)) / 7).cast("int")
def dayofweek(d):
    """Sunday is 1."""
    return F.dayofweek(col(d))
def hour(d): return F.hour(col(d))
def hourofweek(d):
    """Hours since Monday 0:00."""
    return F.weekday(col(d)) * 24 + F.hour(col(d))
def micros(d): return F.unix_micros(col(d).cast("timestamp"))
def seconds(d): return F.floor(micros(d) / 1_000_000).cast("long")
def unixmillis(d): return F.floor(micros(d) / 1000).cast("long")
def date(d): return F.date_format(col(d), "yyyy-MM-dd")
def now(): return F.current_timestamp()


def _two(c: Column) -> Column: return F.lpad(c.cast("string"), 2, "0")


def _ordinal(d: Column) -> Column:
    n = F.dayofmonth(d)
    ending = F.when(n.between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def _hour12(d: Column) -> Column: return (F.hour(d) + 11) % 12 + 1


#: Specifiers of date_format: % and a letter.
_FORMATS: dict[str, Callable[[Column], Column]] = {
    "Y": lambda d: F.date_format(d, "yyyy"), "y": lambda d: F.date_format(d, "yy"),
    "m": lambda d: _two(F.month(d)), "c": lambda d: F.month(d).cast("string"), "M": monthname, "b": lambda d: F.date_format(d, "MMM"),
    "d": lambda d: _two(F.dayofmonth(d)), "e": lambda d: F.dayofmonth(d).cast("string"), "D": _ordinal,
    "H": lambda d: _two(F.hour(d)), "k": lambda d: F.hour(d).cast("string"), "h": lambda d: _two(_hour12(d)), "I": lambda d: _two(_hour12(d)),
    "l": lambda d: _hour12(d).cast("string"), "i": lambda d: _two(F.minute(d)), "s": lambda d: _two(F.second(d)), "S": lambda d: _two(F.second(d)),
    "f": lambda d: F.lpad((micros(d) % 1_000_000).cast("string"), 6, "0"), "p": lambda d: F.when(F.hour(d) < 12, "AM").otherwise("PM"),
    "r": lambda d: F.concat(_two(_hour12(d)), F.date_format(d, ":mm:ss "), F.when(F.hour(d) < 12, "AM").otherwise("PM")),
    "T": lambda d: F.date_format(d, "HH:mm:ss"), "W": dayname, "a": lambda d: F.date_format(d, "EEE"),
    "w": lambda d: (F.dayofweek(d) - 1).cast("string"), "j": lambda d: F.lpad(F.dayofyear(d).cast("string"), 3, "0"),
}


def date_format(d, pattern: str):
    """MySQL specifiers; an unknown one stands for its own character."""
    d, parts, i = col(d), [], 0
    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            make = _FORMATS.get(pattern[i + 1])
            parts.append(make(d) if make else F.lit(pattern[i + 1]))
            i += 2
        else:
            parts.append(F.lit(pattern[i]))
            i += 1
    return F.when(d.isNotNull(), F.concat(*parts) if parts else F.lit(""))


#: Microseconds in a unit of timediff.
_UNITS = {"nanoseconds": 1e-3, "microseconds": 1.0, "milliseconds": 1e3, "seconds": 1e6, "minutes": 6e7, "hours": 3.6e9}


def plain_number(x: Column) -> Column:
    """A double as text without a trailing '.0'."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def timediff(a, b, unit: str | None = None):
    """a - b as text: a number of units, or without unit hours, minutes and seconds like 4h30m0s."""
    diff = micros(a) - micros(b)
    if unit:
        whole = unit == "nanoseconds"
        return (diff * 1000).cast("string") if whole else plain_number(diff.cast("double") / _UNITS[unit])
    size = F.abs(diff)
    h, m, s = F.floor(size / 3_600_000_000), F.floor(size / 60_000_000) % 60, plain_number((size % 60_000_000).cast("double") / 1e6)
    body = F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"), s, F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))
    return F.concat(F.when(diff < 0, "-").otherwise(""), body)


# -- conversions -------------------------------------------------------------------------------

def todate(x):
    """A time from text; 'now', and 'now-1m' or 'now+1d' (s, m, h, d) relative to it."""
    if isinstance(x, str) and (m := re.fullmatch(r"now(?:([+-]\d+)([smhd]))?", x)):
        if not m[1]:
            return now()
        unit = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY"}[m[2]]
        return F.expr(f"current_timestamp() + INTERVAL '{int(m[1])}' {unit}")
    return F.to_timestamp_ntz(text(x)) if isinstance(x, str) else col(x).try_cast("timestamp_ntz")
def tostring(x): return plain_number(text(x))
def toint(x): return num(x).cast("long")
def tonumber(x): return num(x)
_CASTS = {
    **dict.fromkeys(("signed", "unsigned", "int", "integer", "bigint"), toint), **dict.fromkeys(("decimal", "double", "float", "real"), tonumber),
    **dict.fromkeys(("char", "text", "varchar"), text), **dict.fromkeys(("date", "datetime", "timestamp"), todate),
}
def cast(x, kind: str): return _CASTS[kind.lower()](x)


#: Every function by name, aliases included.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "lower": lower, "lcase": lower, "upper": upper, "ucase": upper, "length": length, "char_length": length,
    "substr": substr, "substring": substr, "mid": substr, "concat": concat, "concat_ws": concat_ws, "trim": trim, "ltrim": ltrim, "rtrim": rtrim,
    "replace": replace, "left": left, "right": right, "repeat": repeat, "reverse": reverse, "lpad": lpad, "rpad": rpad, "ascii": ascii_,
    "locate": locate, "instr": instr, "coalesce": coalesce, "ifnull": ifnull, "nullif": nullif, "isnull": isnull, "if": if_,
    "greatest": greatest, "least": least, "abs": abs_, "round": round_, "floor": floor, "ceil": ceil, "ceiling": ceil, "truncate": truncate,
    "mod": mod, "pow": pow_, "power": pow_, "sign": sign, "year": year, "yy": year, "mm": month, "monthofyear": month, "month": month, "yymm": yymm,
    "day": day, "dayofmonth": day, "dayname": dayname, "monthname": monthname, "quarter": quarter, "week": week, "dayofweek": dayofweek,
    "hourofday": hour, "hour": hour, "hourofweek": hourofweek, "seconds": seconds, "date": date, "date_format": date_format, "timediff": timediff,
    "todate": todate, "tostring": tostring, "toint": toint, "tonumber": tonumber, "cast": cast, "hash.sha256": sha256,
    "now": now, "current_timestamp": now, "unixmillis": unixmillis, "unix_millis": unixmillis,
}
