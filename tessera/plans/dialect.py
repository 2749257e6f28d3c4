"""The dialect's rules as SQL text, each against an oracle that states the rule in plain SQL."""

from __future__ import annotations

from tessera.sql.engine import Engine

from .functions import STRINGS, STRINGS_EDGES, TRIM_HASH
from .registry import ORACLES, query, sql

_SEG = "(SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t"
_SIZE = "(SELECT p_partkey, nullif(p_size, 7) AS s FROM part) t"


def _counted(source: str, conditions: dict[str, str]) -> str:
    """One row for each condition: its name and how many rows meet it."""
    return " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS n FROM {source} WHERE {c}" for name, c in conditions.items())


# -- arithmetic, NULL and coercion -------------------------------------------------------------

sql("sql_arithmetic", "SELECT p_partkey, p_size / 4 AS quarter, p_size + p_partkey AS total, -p_size AS minus, p_size * 2 - 1 AS odd, p_size % 7 AS rest, mod(p_size, 0) AS none FROM part",
    """SELECT p_partkey, p_size::DOUBLE / 4 AS quarter, p_size::DOUBLE + p_partkey AS total, -(p_size::DOUBLE) AS minus, p_size::DOUBLE * 2 - 1 AS odd,
       (p_size % 7)::DOUBLE AS rest, NULL::DOUBLE AS none FROM part""")
sql("sql_sum_of_integers", "SELECT p_type, sum(p_size) AS total, sum(p_size * 2) AS twice, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_type",
    "SELECT p_type, sum(p_size)::DOUBLE AS total, sum(p_size * 2)::DOUBLE AS twice, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_type")
sql("sql_negations_keep_null", _counted(_SEG, {
    "ne": "seg <> 'MACHINERY'", "bang": "seg != 'MACHINERY'", "not_in": "seg NOT IN ('MACHINERY', 'FURNITURE')", "not_like": "seg NOT LIKE '%E%'", "not_regexp": "seg NOT REGEXP '^M'",
    "not_eq": "NOT seg = 'MACHINERY'", "not_in_known": "seg NOT IN ('MACHINERY', 'FURNITURE') AND seg IS NOT NULL", "not_and": "NOT (seg = 'MACHINERY' AND c_nationkey = 3)",
}) + " UNION ALL " + _counted(_SIZE, {"not_between": "s NOT BETWEEN 5 AND 45", "ne_number": "s <> 9", "not_less": "NOT s < 20"}), _counted(_SEG, {
    "ne": "seg IS DISTINCT FROM 'MACHINERY'", "bang": "seg IS DISTINCT FROM 'MACHINERY'", "not_in": "coalesce(seg NOT IN ('MACHINERY', 'FURNITURE'), true)", "not_like": "coalesce(seg NOT LIKE '%E%', true)",
    "not_regexp": "coalesce(NOT regexp_matches(seg, '^M'), true)", "not_eq": "seg IS DISTINCT FROM 'MACHINERY'", "not_in_known": "seg NOT IN ('MACHINERY', 'FURNITURE')",
    "not_and": "coalesce(NOT (seg = 'MACHINERY' AND c_nationkey = 3), true)",
}) + " UNION ALL " + _counted(_SIZE, {"not_between": "coalesce(s NOT BETWEEN 5 AND 45, true)", "ne_number": "s IS DISTINCT FROM 9", "not_less": "coalesce(s >= 20, true)"}))
sql("sql_null_comparisons", _counted(_SEG, {"eq": "seg = NULL", "ne": "seg != NULL", "is": "seg IS NULL", "function": "isnull(seg)", "less": "seg < NULL"}),
    _counted(_SEG, {"eq": "seg IS NULL", "ne": "seg IS NOT NULL", "is": "seg IS NULL", "function": "seg IS NULL", "less": "false"}))
sql("sql_case_has_three_values", f"SELECT c_custkey, CASE WHEN seg <> 'MACHINERY' THEN 'other' ELSE 'rest' END AS a, CASE WHEN NOT seg = 'MACHINERY' THEN 1 END AS b, if(seg = 'MACHINERY', 'yes', 'no') AS c FROM {_SEG}")
ORACLES["sql_case_has_three_values"] = f"""SELECT c_custkey, CASE WHEN seg IS NOT NULL AND seg <> 'MACHINERY' THEN 'other' ELSE 'rest' END AS a, CASE WHEN seg <> 'MACHINERY' THEN 1 END AS b,
    CASE WHEN seg = 'MACHINERY' THEN 'yes' ELSE 'no' END AS c FROM {_SEG}"""
_TEXTS = "(SELECT CASE WHEN p_partkey % 3 = 0 THEN '10.0' WHEN p_partkey % 3 = 1 THEN '9' ELSE 'none' END AS v, p_size FROM part) t"
_TEXTS_SPARK = "(SELECT CASE WHEN p_partkey % 3 = 0 THEN '10.0' WHEN p_partkey % 3 = 1 THEN '9' ELSE 'none' END AS v, p_size FROM part) t"
sql("sql_numeric_strings", _counted(_TEXTS_SPARK, {"above": "v > 9.5", "equal": "v = 10", "literal": "p_size > '10.5'", "in_list": "p_size IN ('1', '2.0', 'x')", "between": "p_size BETWEEN '10' AND '20'", "text": "lower(v) > 'a'"}),
    _counted(_TEXTS, {"above": "coalesce(try_cast(v AS DOUBLE) > 9.5, v > '9.5')", "equal": "try_cast(v AS DOUBLE) = 10", "literal": "p_size > 10.5", "in_list": "p_size IN (1, 2)", "between": "p_size BETWEEN 10 AND 20", "text": "v = 'none'"}))
sql("sql_date_literals", _counted("events", {
    "upto": "ts <= '2024-01-10'", "after": "ts > '2024-01-10'", "before": "ts < '2024-01-10'", "from": "ts >= '2024-01-10'", "between": "ts BETWEEN '2024-01-05' AND '2024-01-10'", "typed": "ts <= DATE '2024-01-10'", "instant": "ts <= '2024-01-10 12:00:00'",
}), _counted("events", {
    "upto": "ts < TIMESTAMP '2024-01-11'", "after": "ts >= TIMESTAMP '2024-01-11'", "before": "ts < TIMESTAMP '2024-01-10'", "from": "ts >= TIMESTAMP '2024-01-10'",
    "between": "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'", "typed": "ts < TIMESTAMP '2024-01-11'", "instant": "ts <= TIMESTAMP '2024-01-10 12:00:00'",
}))
sql("sql_like_has_no_escape", r"SELECT 'a\\b' LIKE 'a\\b' AS same, 'a%b' LIKE 'a\%b' AS percent, 'a\\xb' LIKE 'a\%b' AS wild, 'A' LIKE 'a' AS kase, concat('x', p_type) LIKE concat('_', left(p_type, 2), '%') AS dynamic FROM part",
    "SELECT true AS same, false AS percent, true AS wild, false AS kase, true AS dynamic FROM part")
sql("sql_boolean_values", "SELECT count(*) AS n FROM (SELECT c_acctbal > 0 AS positive FROM customer) t WHERE positive = 1 AND positive != 0 AND positive = true", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0")

# -- names, order, sets ------------------------------------------------------------------------

sql("sql_where_alias", "SELECT o_orderkey, o_totalprice / 1000 AS thousands, upper(o_orderstatus) AS st FROM orders WHERE thousands > 300 AND st == 'O'",
    "SELECT o_orderkey, o_totalprice / 1000 AS thousands, upper(o_orderstatus) AS st FROM orders WHERE o_totalprice / 1000 > 300 AND upper(o_orderstatus) = 'O'")
sql("sql_group_by_names", "SELECT substr(p_brand, 1, 7) AS b, p_size % 2 AS odd, count(*) AS n FROM part GROUP BY b, 2 HAVING n > 1 AND sum(p_retailprice) > 0",
    "SELECT substr(p_brand, 1, 7) AS b, (p_size % 2)::DOUBLE AS odd, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
sql("sql_functions_over_groups", "SELECT upper(p_type) AS t, concat(lower(p_type), '-', count(*)) AS label, round(sum(p_retailprice) / count(*) + 1, 4) AS a FROM part GROUP BY p_type",
    "SELECT upper(p_type) AS t, lower(p_type) || '-' || count(*)::VARCHAR AS label, round(sum(p_retailprice) / count(*) + 1, 4) AS a FROM part GROUP BY p_type")
sql("sql_order_hidden_and_paged", "SELECT `o_orderkey` FROM orders ORDER BY length(o_orderpriority) DESC, o_totalprice, 1 LIMIT 30, 20", "SELECT o_orderkey FROM orders ORDER BY length(o_orderpriority) DESC, o_totalprice, o_orderkey LIMIT 20 OFFSET 30")
sql("sql_distinct_ordered", "SELECT DISTINCT p_type, left(p_brand, 6) AS b FROM part ORDER BY b DESC, p_type", "SELECT DISTINCT p_type, left(p_brand, 6) AS b FROM part")
sql("sql_union_all_ordered", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier ORDER BY name DESC LIMIT 40", "SELECT * FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier) t ORDER BY name DESC LIMIT 40")
sql("sql_rownum", "SELECT rownum, o_orderstatus FROM orders WHERE rownum BETWEEN 100 AND 120 OR @rownum = 7", "SELECT o_orderkey AS rownum, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 120 OR o_orderkey = 7")
sql("sql_row_values", "SELECT count(*) AS n FROM part WHERE (p_size, p_type) IN ((1, 'PROMO'), (2, 'SMALL'), (50, 'LARGE'))")
sql("sql_information_schema", "SELECT table_name, count(*) AS n FROM information_schema.columns GROUP BY table_name",
    "SELECT table_name, count(*) AS n FROM duckdb_columns() WHERE schema_name = 'main' AND NOT internal GROUP BY table_name")
sql("sql_text_search_quotes", "SELECT doc_id, 'MATCH(x) AGAINST(1)' AS t FROM documents WHERE MATCH(text) AGAINST('the \"licensed\", under!' IN NATURAL LANGUAGE MODE)",
    r"SELECT doc_id, 'MATCH(x) AGAINST(1)' AS t FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])licensed([^\p{L}\p{N}]|$)') AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}])under([^\p{L}\p{N}]|$)')")

# -- subqueries --------------------------------------------------------------------------------

sql("sql_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN (SELECT nullif(c_mktsegment, 'FURNITURE') FROM customer WHERE c_acctbal > 0 AND c_nationkey < 3 AND c_mktsegment <> 'BUILDING')",
    "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer d WHERE d.c_acctbal > 0 AND d.c_nationkey < 3 AND d.c_mktsegment <> 'BUILDING' AND d.c_mktsegment <> 'FURNITURE' AND d.c_mktsegment = c.c_mktsegment)")
sql("sql_membership_alone_drops_null", f"SELECT c_custkey FROM {_SEG} WHERE seg NOT IN (SELECT 'MACHINERY' FROM region)", f"SELECT c_custkey FROM {_SEG} WHERE seg <> 'MACHINERY'")
sql("sql_membership_beside_others_keeps_null", f"SELECT c_custkey FROM {_SEG} WHERE seg NOT IN (SELECT 'MACHINERY' FROM region) AND c_nationkey >= 0", f"SELECT c_custkey FROM {_SEG} WHERE seg IS NULL OR seg <> 'MACHINERY'")
sql("sql_tuple_membership", "SELECT count(*) AS n FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 25)",
    "SELECT count(*) AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity > 25 AND b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey)")
sql("sql_membership_in_or", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
sql("sql_exists_theta", "SELECT count(*) AS n FROM lineitem a WHERE NOT EXISTS (SELECT * FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)",
    "SELECT count(*) AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)")
sql("sql_on_correlated_scalar", "SELECT count(*) AS n, sum(o.o_orderkey) AS keys FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderkey = (SELECT min(o2.o_orderkey) FROM orders o2 WHERE o2.o_custkey = c.c_custkey)",
    "SELECT count(*) AS n, sum(k)::DOUBLE AS keys FROM (SELECT min(o_orderkey) AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey) t")
sql("sql_scalar_of_one_row", "SELECT r_name, (SELECT n_name FROM nation WHERE n_nationkey = 3) AS third FROM region WHERE r_regionkey < (SELECT n_regionkey + 2 FROM nation WHERE n_nationkey = 3)")
sql("sql_having_subquery", "SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 2 * avg(o_totalprice) FROM orders) AND count(*) BETWEEN 1 AND 3",
    "SELECT o_custkey, s FROM (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE s > (SELECT 2 * avg(o_totalprice) FROM orders) AND n BETWEEN 1 AND 3")
sql("sql_join_right_using", "SELECT k, count(*) AS n, count(a) AS m FROM (SELECT o_custkey AS k, o_orderkey AS a FROM orders WHERE o_totalprice > 300000) x RIGHT JOIN (SELECT c_custkey AS k FROM customer) y USING (k) GROUP BY k",
    "SELECT c_custkey AS k, count(*) AS n, count(o_orderkey) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey")

for _table, _c, _n in (("orders", "o_orderpriority", 0), ("part", "p_type", 3)):
    sql(f"sql_topn_{_table}", f"SELECT topn({_c}{f', {_n}' if _n else ''}) FROM {_table}", ORACLES["topn_all" if _table == "orders" else "topn_three"])

# -- functions: the same oracles as for the Column functions -----------------------------------

sql("sql_functions_strings", """SELECT p_partkey, lcase(p_name) AS lo, ucase(p_name) AS up, char_length(p_name) AS n, mid(p_name, 2, 3) AS mid, substr(p_name, 0, 3) AS at_zero, substring(p_name, -5, 2) AS neg,
    concat(p_brand, '/', p_type) AS cat, concat_ws('-', p_brand, nullif(p_type, 'PROMO'), p_name) AS ws, replace(p_name, 'o', '0') AS rep, reverse(p_name) AS rev FROM part""", STRINGS)
sql("sql_functions_strings_edges", """SELECT p_partkey, left(p_name, 3) AS l, right(p_name, 3) AS r, left(p_name, -1) AS none, repeat(p_type, 2) AS twice, lpad(p_type, 8, '*') AS lp, rpad(p_type, 4, '*') AS rp,
    lpad(p_type, -1, '*') AS neg, lpad(p_type, 40, '') AS nofill, ascii(p_name) AS a, instr(p_name, 'o') AS at, locate('o', p_name, 3) AS at3, locate('', p_name, 2) AS empty_needle FROM part""", STRINGS_EDGES)
sql("sql_functions_trim_hash", """SELECT p_partkey, ltrim(rtrim(concat('  ', p_name, '\\t'))) AS `both`, trim(leading 'xy' from concat('xyxy', p_name)) AS `lead`, trim(trailing 'ab' from concat(p_name, 'abab')) AS trail,
    hash.sha256(p_name) AS h FROM part""", TRIM_HASH)
sql("sql_functions_numbers", "SELECT p_partkey, abs(-p_size) AS a, round(p_retailprice, 1) AS r, floor(p_retailprice) AS f, ceiling(p_retailprice) AS c, truncate(p_retailprice, 1) AS t, pow(p_size, 2) AS p, sign(p_size - 20) AS s FROM part",
    """SELECT p_partkey, p_size::DOUBLE AS a, round(p_retailprice, 1) AS r, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, floor(p_retailprice * 10) / 10 AS t, pow(p_size::DOUBLE, 2) AS p, sign(p_size - 20)::INTEGER AS s FROM part""")
sql("sql_functions_conditionals", f"""SELECT c_custkey, coalesce(seg, c_nationkey) AS co, ifnull(seg, 'none') AS i, nullif(c_nationkey, 3) AS nul, isnull(seg) AS isn, if(c_nationkey, 'y', 'n') AS if_number,
    if('abc', 'y', 'n') AS if_text, greatest(3, null, 7) AS g, greatest(c_nationkey, 12) AS top, least(seg, 'H') AS l, greatest('10', '9.5') AS numbers FROM {_SEG}""",
    f"""SELECT c_custkey, coalesce(seg, c_nationkey::VARCHAR) AS co, coalesce(seg, 'none') AS i, nullif(c_nationkey, 3) AS nul, (seg IS NULL)::INTEGER AS isn, CASE WHEN c_nationkey <> 0 THEN 'y' ELSE 'n' END AS if_number,
    'n' AS if_text, NULL::INTEGER AS g, greatest(c_nationkey, 12) AS top, CASE WHEN seg IS NOT NULL THEN least(seg, 'H') END AS l, 10.0::DOUBLE AS numbers FROM {_SEG}""")
sql("sql_functions_dates", """SELECT event_id, yy(ts) AS y, monthofyear(ts) AS mo, mm(ts) AS mo2, yymm(ts) AS ym, dayofmonth(ts) AS d, dayname(ts) AS dn, monthname(ts) AS mn, quarter(ts) AS q, week(ts) AS w, week(ts, 0) AS w0,
    dayofweek(ts) AS dw, hourofday(ts) AS h, hourofweek(ts) AS hw, seconds(ts) AS s, date(ts) AS da, date_format(ts, '%Y/%m/%d %H:%i:%s') AS f, timediff(ts, '2024-01-01', 'seconds') AS df FROM events""",
    """SELECT event_id, year(ts)::INTEGER AS y, month(ts)::INTEGER AS mo, month(ts)::INTEGER AS mo2, (year(ts) * 100 + month(ts))::INTEGER AS ym, day(ts)::INTEGER AS d, dayname(ts) AS dn, monthname(ts) AS mn, quarter(ts)::INTEGER AS q,
    floor((dayofyear(ts) + 6 - dayofweek(ts)) / 7)::INTEGER AS w, floor((dayofyear(ts) + 6 - dayofweek(ts)) / 7)::INTEGER AS w0, (dayofweek(ts) + 1)::INTEGER AS dw, hour(ts)::INTEGER AS h,
    ((isodow(ts) - 1) * 24 + hour(ts))::INTEGER AS hw, floor(epoch(ts))::BIGINT AS s, strftime(ts, '%Y-%m-%d') AS da, strftime(ts, '%Y/%m/%d %H:%M:%S') AS f,
    CASE WHEN (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) % 1000000 = 0 THEN ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000)::VARCHAR
         ELSE rtrim(printf('%.6f', (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6), '0') END AS df FROM events""")
sql("sql_functions_casts", """SELECT o_orderkey, toint(o_totalprice) AS i, tonumber(o_orderkey) AS n, tostring(o_orderkey) AS s, cast(o_totalprice AS signed) AS c, cast(o_orderkey AS char(20)) AS ch, cast('12.5' AS decimal(10, 2)) AS de,
    todate('1995-03-15') AS d FROM orders""",
    """SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS i, o_orderkey::DOUBLE AS n, o_orderkey::VARCHAR AS s, trunc(o_totalprice)::BIGINT AS c, o_orderkey::VARCHAR AS ch, 12.5::DOUBLE AS de, TIMESTAMP '1995-03-15' AS d FROM orders""")
sql("sql_functions_constants", "SELECT trim('\\t x ') AS t, ascii('é') AS a, substring('abcdef' from 2 for 3) AS s, dayname('1995-03-15') AS d, week('1996-01-02') AS w, timediff('1995-03-15 04:30:00', '1995-03-15') AS td, '10.5' > 9 AS num, 'b' > 'a' AS txt",
    "SELECT 'x' AS t, 195 AS a, 'bcd' AS s, 'Wednesday' AS d, 0 AS w, '4h30m0s' AS td, true AS num, true AS txt")
sql("sql_session_values", "SELECT database() AS db, schema() AS s, connection_id() AS id, user() = current_user() AS same, @@autocommit AS ac, @@session.time_zone AS tz", "SELECT 'tessera' AS db, 'tessera' AS s, 1 AS id, true AS same, '1' AS ac, 'UTC' AS tz")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000.0 AND 90000 AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def sql_parameters(spark, sf_dir):
    return Engine(spark, sf_dir).run("SELECT count(*) AS n FROM orders WHERE o_orderstatus = ? AND o_totalprice BETWEEN ? AND ? AND o_orderpriority IN (?, ?)", ["F", 1000.0, 90000, "1-URGENT", "5-LOW"])
