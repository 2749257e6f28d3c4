"""Scalar functions and predicates on literal rows."""

import datetime
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions import scalar as S

L = F.lit
T = lambda s: F.lit(s).cast("timestamp_ntz")


def cases():
    NULL = F.lit(None).cast("string")  # noqa: N806
    return [
        (S.lower(L("ÄbC")), "äbc"), (S.upper(L("äb")), "ÄB"), (S.length(L("añ𝄞")), 3), (S.length(NULL), None),
        (S.substr(L("alpha"), 2, 3), "lph"), (S.substr(L("alpha"), 0, 3), ""), (S.substr(L("abc"), -5, 3), "abc"), (S.substr(L("abc"), 2, 0), ""), (S.substr(L("abc"), 2), "bc"), (S.substr(NULL, 1, 2), None),
        (S.concat("a", NULL), None), (S.concat("a", 1), "a1"), (S.concat_ws("-", "a", NULL, "b"), "a-b"), (S.concat_ws(NULL, "a"), None),
        (S.trim(L(" \t a b　\n")), "a b"), (S.ltrim(L("\t a ")), "a "), (S.rtrim(L(" a\t")), " a"), (S.trim(L("xyxyzxy"), "xy", "leading"), "zxy"), (S.trim(L("xyxyzxy"), "xy"), "z"), (S.trim(L("xyz"), "yx"), "xyz"),
        (S.replace(L("aXbX"), "X", "--"), "a--b--"), (S.replace(L("ab"), "", "z"), "ab"), (S.left(L("abc"), 2), "ab"), (S.left(L("abc"), 0), ""), (S.right(L("abc"), 2), "bc"), (S.right(NULL, 1), None),
        (S.repeat(L("ab"), 3), "ababab"), (S.repeat(L("ab"), -1), ""), (S.reverse(L("añb")), "bña"),
        (S.lpad(L("x"), 3, "ab"), "abx"), (S.rpad(L("x"), 4, "ab"), "xaba"), (S.lpad(L("hello"), 2, "*"), "he"), (S.lpad(L("x"), 5, ""), ""), (S.lpad(L("x"), -1, "*"), None), (S.rpad(L("x"), 1, ""), "x"),
        (S.ascii_(L("é")), 195), (S.ascii_(L("A")), 65), (S.ascii_(L("")), 0), (S.locate("b", L("abcb")), 2), (S.locate("b", L("abcb"), 3), 4), (S.locate("b", L("abc"), 0), 0), (S.locate("", L("abc"), 2), 2), (S.instr(L("abc"), "z"), 0), (S.locate(NULL, L("a")), None),
        (S.sha256(L("a")), hashlib.sha256(b"a").hexdigest()),
        (S.coalesce(NULL, L("b")), "b"), (S.ifnull(NULL, "d"), "d"), (S.nullif(L(3), 3), None), (S.nullif(L(3), F.lit(None).cast("int")), 3), (S.isnull(NULL), 1), (S.isnull(L(0)), 0),
        (S.if_(L("2"), "y", "n"), "y"), (S.if_(L(""), "y", "n"), "n"), (S.if_(L("abc"), "y", "n"), "n"), (S.if_(L(0), "y", "n"), "n"), (S.if_(NULL, "y", "n"), "n"), (S.if_(L(3) > L(2), "y", "n"), "y"),
        (S.greatest(3, F.lit(None).cast("int"), 7), None), (S.greatest(3, 7), 7), (S.least("b", "a"), "a"),
        (S.abs_(L(-2)), 2.0), (S.round_(L(2.5)), 3.0), (S.round_(L(-2.5)), -3.0), (S.round_(L(1250.0), -2), 1300.0), (S.floor(L(-1.5)), -2.0), (S.ceil(L(1.2)), 2.0),
        (S.truncate(L(-1.29), 1), -1.2), (S.truncate(L(129.9), -1), 120.0), (S.mod(L(-7), 3), -1.0), (S.mod(L(7), 0), None), (S.pow_(L(2), 10), 1024.0), (S.sign(L(-3.2)), -1), (S.divide(L(7), 2), 3.5), (S.divide(NULL, 2), None),
        (S.year(T("1995-03-15")), 1995), (S.yymm(T("1995-03-15")), 199503), (S.dayname(T("1995-03-15")), "Wednesday"), (S.monthname(T("1995-03-15")), "March"), (S.quarter(T("1995-03-15")), 1),
        (S.week(T("1995-03-15")), 11), (S.week(T("1996-01-02")), 0), (S.dayofweek(T("1995-03-12")), 1), (S.hourofweek(T("1995-03-15 05:00:00")), 53), (S.seconds(T("1970-01-01 00:01:40")), 100), (S.unixmillis(T("1970-01-01 00:00:01.5")), 1500), (S.date(T("1995-03-15 10:00:00")), "1995-03-15"),
        (S.date_format(T("2024-02-03 04:05:06.789"), "%Y-%m-%d %H:%i:%s.%f"), "2024-02-03 04:05:06.789000"), (S.date_format(T("2024-02-03 16:05:06"), "%y %c %e %D %k %h %l %p %T %r %j %w"), "24 2 3 3rd 16 04 4 PM 16:05:06 04:05:06 PM 034 6"),
        (S.date_format(T("2024-02-11 00:05:06"), "%W %a %M %b %D %l %q%%"), "Sunday Sun February Feb 11th 12 q%"), (S.date_format(NULL.cast("timestamp_ntz"), "%Y"), None),
        (S.timediff(T("2024-01-01 04:30:00"), T("2024-01-01")), "4h30m0s"), (S.timediff(T("2024-01-01"), T("2024-01-01 00:00:01.5")), "-1.5s"), (S.timediff(T("2024-01-01 00:02:00"), T("2024-01-01")), "2m0s"),
        (S.timediff(T("2024-01-01 04:30:00"), T("2024-01-01"), "hours"), "4.5"), (S.timediff(T("2024-01-01 03:00:00"), T("2024-01-01"), "hours"), "3"), (S.timediff(T("2024-01-01 00:00:01"), T("2024-01-01"), "nanoseconds"), "1000000000"),
        (S.todate("2024-01-05"), datetime.datetime(2024, 1, 5)), (S.toint(L("3.9")), 3), (S.toint(L(-3.9)), -3), (S.tonumber(L("2.5")), 2.5), (S.tostring(L(5.0)), "5"), (S.cast(L("7"), "SIGNED"), 7), (S.cast(L(7), "char"), "7"),
        (P.ne(NULL, "a"), True), (P.ne(NULL, "a", "sql"), None), (P.eq(NULL, None), True), (P.ne(L("a"), None), True), (P.not_in(NULL, ["a"]), True), (P.not_in(L("a"), ["a"]), False), (P.not_between(F.lit(None).cast("int"), 1, 2), True),
        (P.compare(L("10.5"), ">", L(9)), True), (P.compare(L("abc"), "<", L("b")), True), (P.compare(L("07"), "=", L(7)), True), (P.compare(L("x"), "!=", L(7)), True), (P.compare(NULL, "!=", L(7)), True), (P.compare(NULL, "<", L(7)), None),
        (P.like(L("abc"), "a%"), True), (P.like(L("ABC"), "a%"), False), (P.like(L("a\nb"), "a%"), False), (P.like(L("a%b"), "a%b"), True), (P.like(L("a\\b"), "a\\_"), True), (P.like(L("abc"), "_b_"), True), (P.like(L("abc"), "%c"), True), (P.like(L("a.c"), "a.c"), True), (P.like(L("axc"), "a.c"), False), (P.like(L("a\n"), "a"), False),
        (P.not_like(NULL, "a%"), True), (P.regexp(L("xab1"), "b[0-9]"), True), (P.regexp(L("x"), "("), False), (P.not_regexp(NULL, "a"), True), (P.row_in([L(1), L("b")], [(1, "a"), (1, "b")]), True), (P.in_list(NULL, ["a", None]), True), (P.in_list(L("b"), ["a", None]), False),
        (P.time_compare(T("2024-01-10 15:00:00"), "<=", "2024-01-10"), True), (P.time_compare(T("2024-01-10 15:00:00"), ">", "2024-01-10"), False), (P.time_compare(T("2024-01-10 15:00:00"), ">=", "2024-01-10"), True), (P.time_between(T("2024-01-10 15:00:00"), "2024-01-01", "2024-01-10"), False),
        (P.has_value(F.array(L("a"), L("b")), "b"), True),
    ]


def test_functions_on_literals(spark):
    every = cases()
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(every))).first()
    wrong = [(i, str(c)[:90], got, want) for i, ((c, want), got) in enumerate(zip(every, row, strict=True)) if got != want and not (isinstance(want, float) and got == pytest.approx(want))]
    assert not wrong


def test_division_by_zero_is_an_error(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(S.divide(F.col("id") + 1, F.col("id"))).collect()


def test_relative_times_and_week_modes(spark):
    row = spark.range(1).select((S.todate("now-1d") < S.todate("now")).alias("a"), (S.todate("now+5m") > S.now()).alias("b")).first()
    assert row.a and row.b
    with pytest.raises(ValueError):
        S.week(L("2024-01-01"), 3)
    assert len(S.FUNCTIONS) >= 70
