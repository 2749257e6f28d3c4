"""Scalar functions over table columns, against the same formulas in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import load
from tessera.functions import scalar as S

from .registry import query

C = F.col


STRINGS = """SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, length(p_name)::INTEGER AS n, substr(p_name, 2, 3) AS mid, '' AS at_zero, substr(p_name, 1, 2) AS neg,
          p_brand || '/' || p_type AS cat, concat_ws('-', p_brand, nullif(p_type, 'PROMO'), p_name) AS ws, replace(p_name, 'o', '0') AS rep, reverse(p_name) AS rev FROM part"""


@query(STRINGS)
def functions_strings(spark, sf_dir):
    name = C("p_name")
    return load(spark, sf_dir, "part").select(
        "p_partkey", S.lower(name).alias("lo"), S.upper(name).alias("up"), S.length(name).alias("n"), S.substr(name, 2, 3).alias("mid"), S.substr(name, 0, 3).alias("at_zero"),
        S.substr(name, -5, 2).alias("neg"), S.concat(C("p_brand"), "/", C("p_type")).alias("cat"), S.concat_ws("-", C("p_brand"), F.nullif(C("p_type"), F.lit("PROMO")), name).alias("ws"),
        S.replace(name, "o", "0").alias("rep"), S.reverse(name).alias("rev"),
    )


STRINGS_EDGES = """SELECT p_partkey, left(p_name, 3) AS l, right(p_name, 3) AS r, '' AS none, repeat(p_type, 2) AS twice, lpad(p_type, 8, '*') AS lp, rpad(p_type, 4, '*') AS rp,
          CAST(NULL AS VARCHAR) AS neg, '' AS nofill, CASE WHEN p_name = '' THEN 0 ELSE unicode(p_name) END::INTEGER AS a, strpos(p_name, 'o')::INTEGER AS at,
          CASE WHEN strpos(substr(p_name, 3), 'o') = 0 THEN 0 ELSE strpos(substr(p_name, 3), 'o') + 2 END::INTEGER AS at3, 2 AS empty_needle FROM part"""


@query(STRINGS_EDGES)
def functions_strings_edges(spark, sf_dir):
    name, kind = C("p_name"), C("p_type")
    return load(spark, sf_dir, "part").select(
        "p_partkey", S.left(name, 3).alias("l"), S.right(name, 3).alias("r"), S.left(name, -1).alias("none"), S.repeat(kind, 2).alias("twice"), S.lpad(kind, 8, "*").alias("lp"),
        S.rpad(kind, 4, "*").alias("rp"), S.lpad(kind, -1, "*").alias("neg"), S.lpad(kind, 40, "").alias("nofill"), S.ascii_(name).alias("a"), S.instr(name, "o").alias("at"),
        S.locate("o", name, 3).alias("at3"), S.locate("", name, 2).alias("empty_needle"),
    )


TRIM_HASH = r"""SELECT p_partkey, regexp_replace(regexp_replace('  ' || p_name || chr(9), '^\s+', ''), '\s+$', '') AS both, regexp_replace('xyxy' || p_name, '^(xy)+', '') AS lead,
           regexp_replace(p_name || 'abab', '(ab)+$', '') AS trail, sha256(p_name) AS h FROM part"""


@query(TRIM_HASH)
def functions_trim_hash(spark, sf_dir):
    name = C("p_name")
    return load(spark, sf_dir, "part").select(
        "p_partkey", S.trim(F.concat(F.lit("  "), name, F.lit("\t"))).alias("both"), S.trim(F.concat(F.lit("xyxy"), name), "xy", "leading").alias("lead"),
        S.trim(F.concat(name, F.lit("abab")), "ab", "trailing").alias("trail"), S.sha256(name).alias("h"),
    )


@query("""SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r1, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, sign(c_acctbal) * floor(abs(c_acctbal)) AS t0,
          sign(c_acctbal) * floor(abs(c_acctbal) * 0.01) / 0.01 AS t2, sign(c_acctbal) * fmod(abs(c_acctbal), 7) AS m, CAST(NULL AS DOUBLE) AS m0, pow(c_nationkey::DOUBLE, 2) AS p, sign(c_acctbal)::INTEGER AS s FROM customer""")
def functions_numbers(spark, sf_dir):
    x = C("c_acctbal")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", S.abs_(x).alias("a"), S.round_(x, 1).alias("r1"), S.floor(x).alias("f"), S.ceil(x).alias("c"), S.truncate(x).alias("t0"), S.truncate(x, -2).alias("t2"),
        S.mod(x, 7).alias("m"), S.mod(x, 0).alias("m0"), S.pow_(C("c_nationkey"), 2).alias("p"), S.sign(x).alias("s"),
    )


@query("""SELECT c_custkey, coalesce(seg, 'none') AS co, coalesce(seg, c_name) AS ifn, nullif(c_nationkey, 3) AS nul, (seg IS NULL)::INTEGER AS isn,
          CASE WHEN c_nationkey <> 0 THEN 'y' ELSE 'n' END AS if_number, 'n' AS if_text, 'n' AS if_null, CASE WHEN seg IS NULL THEN NULL ELSE greatest(seg, 'H') END AS g,
          CASE WHEN seg IS NULL THEN NULL ELSE least(seg, 'H') END AS l
          FROM (SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t""")
def functions_conditionals(spark, sf_dir):
    c = load(spark, sf_dir, "customer").withColumn("seg", F.nullif(C("c_mktsegment"), F.lit("BUILDING")))
    seg = C("seg")
    return c.select(
        "c_custkey", S.coalesce(seg, "none").alias("co"), S.ifnull(seg, C("c_name")).alias("ifn"), S.nullif(C("c_nationkey"), 3).alias("nul"), S.isnull(seg).alias("isn"),
        S.if_(C("c_nationkey"), "y", "n").alias("if_number"), S.if_(C("c_name"), "y", "n").alias("if_text"), S.if_(F.lit(None), "y", "n").alias("if_null"),
        S.greatest(seg, "H").alias("g"), S.least(seg, "H").alias("l"),
    )


@query("""SELECT event_id, year(ts)::INTEGER AS y, month(ts)::INTEGER AS mo, (year(ts) * 100 + month(ts))::INTEGER AS ym, day(ts)::INTEGER AS d, dayname(ts) AS dn, monthname(ts) AS mn,
          quarter(ts)::INTEGER AS q, floor((dayofyear(ts) + 6 - dayofweek(ts)) / 7)::INTEGER AS w, (dayofweek(ts) + 1)::INTEGER AS dw, hour(ts)::INTEGER AS h,
          ((isodow(ts) - 1) * 24 + hour(ts))::INTEGER AS hw, floor(epoch(ts))::BIGINT AS s, (epoch_us(ts) // 1000)::BIGINT AS ms, strftime(ts, '%Y-%m-%d') AS da FROM events""")
def functions_dates(spark, sf_dir):
    t = C("ts")
    return load(spark, sf_dir, "events").select(
        "event_id", S.year(t).alias("y"), S.month(t).alias("mo"), S.yymm(t).alias("ym"), S.day(t).alias("d"), S.dayname(t).alias("dn"), S.monthname(t).alias("mn"),
        S.quarter(t).alias("q"), S.week(t).alias("w"), S.dayofweek(t).alias("dw"), S.hour(t).alias("h"), S.hourofweek(t).alias("hw"), S.seconds(t).alias("s"),
        S.unixmillis(t).alias("ms"), S.date(t).alias("da"),
    )


@query("""SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS a, strftime(ts, '%A %a %B %b %y') AS b, strftime(ts, '%I %p %j') AS c, dayofweek(ts)::VARCHAR AS w,
          (day(ts)::VARCHAR || CASE WHEN day(ts) BETWEEN 11 AND 13 THEN 'th' WHEN day(ts) % 10 = 1 THEN 'st' WHEN day(ts) % 10 = 2 THEN 'nd' WHEN day(ts) % 10 = 3 THEN 'rd' ELSE 'th' END) AS d,
          'x%' AS other FROM events""")
def functions_date_format(spark, sf_dir):
    t = C("ts")
    return load(spark, sf_dir, "events").select(
        "event_id", S.date_format(t, "%Y/%m/%d %H:%i:%s").alias("a"), S.date_format(t, "%W %a %M %b %y").alias("b"), S.date_format(t, "%h %p %j").alias("c"),
        S.date_format(t, "%w").alias("w"), S.date_format(t, "%D").alias("d"), S.date_format(t, "%x%%").alias("other"),
    )


@query("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, (date_diff('hour', o_orderdate, l_shipdate))::VARCHAR AS h,
          (date_diff('hour', o_orderdate, l_shipdate))::VARCHAR || 'h0m0s' AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate""")
def functions_timediff(spark, sf_dir):
    both = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), C("l_orderkey") == C("o_orderkey")).where("l_shipdate > o_orderdate")
    return both.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.timediff(C("l_shipdate"), C("o_orderdate"), "hours").alias("h"), S.timediff(C("l_shipdate"), C("o_orderdate")).alias("text"))


@query("""SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS i, o_orderkey::DOUBLE AS n, o_orderkey::VARCHAR AS s, trunc(o_totalprice)::BIGINT AS c, o_orderdate AS d FROM orders""")
def functions_casts(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", S.toint(C("o_totalprice")).alias("i"), S.tonumber(C("o_orderkey")).alias("n"), S.tostring(C("o_orderkey")).alias("s"),
        S.cast(C("o_totalprice"), "signed").alias("c"), S.todate(C("o_orderdate").cast("string")).alias("d"),
    )
