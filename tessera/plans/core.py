"""One query or more for each operator of the SQL surface: scans, predicates, joins, subqueries, aggregates, ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera import catalog
from tessera.catalog import load
from tessera.functions import predicates as P
from tessera.functions import scalar as S
from tessera.operators import joins
from tessera.operators.textsearch import match_against
from tessera.operators.topn import topn
from tessera.sqlfront import run_sql

from .registry import query, sql

# -- scans and sources -------------------------------------------------------------------------

_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in catalog.TABLES)


@query(_COUNTS)
def scan_every_table(spark, sf_dir):
    counts = (load(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in catalog.TABLES)
    return reduce(lambda a, b: a.unionAll(b), counts)


sql("scan_pruned_columns", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < date '1995-02-01'")
sql("constant_source", "SELECT 1 AS one, 'x' AS s WHERE 3 > 2", "SELECT CAST(1 AS INTEGER) AS one, 'x' AS s WHERE 3 > 2")
sql("constant_source_empty", "SELECT 1 AS one WHERE 3 < 2")
sql("inline_rows", "SELECT k, v FROM (SELECT 1 AS k, 'a' AS v UNION ALL SELECT 2, 'b' UNION ALL SELECT 3, NULL) t WHERE k >= 2")


_TABLES = ", ".join(f"'{t}'" for t in catalog.TABLES)


@query(f"""SELECT table_name, column_name, cast(row_number() OVER (PARTITION BY table_name ORDER BY column_index) AS integer) AS ordinal_position
           FROM duckdb_columns() WHERE table_name IN ({_TABLES}) AND schema_name = 'main'""")
def information_schema_columns(spark, sf_dir):
    return catalog.information_schema(spark, sf_dir, "columns").select("table_name", "column_name", "ordinal_position")


@query("""SELECT * FROM (VALUES ('customer', 'fk_c_nationkey', 'nation'), ('lineitem', 'fk_l_orderkey', 'orders'), ('lineitem', 'fk_l_partkey', 'part'),
          ('lineitem', 'fk_l_suppkey', 'supplier'), ('nation', 'fk_n_regionkey', 'region'), ('orders', 'fk_o_custkey', 'customer'),
          ('supplier', 'fk_s_nationkey', 'nation')) t(table_name, constraint_name, referenced_table_name)""")
def information_schema_references(spark, sf_dir):
    return catalog.information_schema(spark, sf_dir, "referential_constraints")


@query("SELECT o_orderkey AS rownum, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 120")
def rownum_pseudo_column(spark, sf_dir):
    return catalog.row_number_column(load(spark, sf_dir, "orders"), "o_orderkey").where("rownum BETWEEN 100 AND 120").select("rownum", "o_orderstatus")


# -- projections and predicates ----------------------------------------------------------------

sql("project_arithmetic", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) + l_tax / 2 - 1, 4) AS net FROM lineitem""")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) / 4 AS quarter, CAST(p_size AS DOUBLE) + p_partkey AS total FROM part")
def arithmetic_is_double(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", S.divide(F.col("p_size"), 4).alias("quarter"), S.add(F.col("p_size"), F.col("p_partkey")).alias("total"))


sql("wildcards", "SELECT o.*, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
sql("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' END AS size FROM orders")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders")
sql("compare_literal", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.03")
sql("compare_same_row", "SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate")
sql("compare_expressions", "SELECT count(*) AS n FROM orders WHERE length(o_orderpriority) > length(o_orderstatus) + 7")
sql("mixed_boolean", """SELECT count(*) AS n FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderstatus = 'O' AND (o_orderpriority = '1-URGENT' OR o_totalprice < 5000))""")
sql("in_list", "SELECT count(*) AS n FROM part WHERE p_size IN (1, 5, 9) AND upper(p_type) IN ('PROMO', 'SMALL')")
sql("between_inclusive", "SELECT count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 1200")
sql("like_forms", """SELECT count(CASE WHEN p_brand LIKE 'Brand#1%' THEN 1 END) AS prefix, count(CASE WHEN p_name LIKE '%bolt%' THEN 1 END) AS inner_,
    count(CASE WHEN p_brand LIKE 'Brand#_' THEN 1 END) AS single FROM part""")
sql("boolean_field", "SELECT count(*) AS n FROM (SELECT c_acctbal > 0 AS positive FROM customer) t WHERE positive = true")

_SEG = "nullif(c_mktsegment, 'BUILDING')"


def _segments(spark, sf_dir):
    """Customers whose segment is NULL for one of the values."""
    return load(spark, sf_dir, "customer").withColumn("seg", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))


@query(f"SELECT count(*) AS n FROM (SELECT {_SEG} AS seg FROM customer) t WHERE coalesce(seg NOT IN ('MACHINERY', 'FURNITURE'), true)")
def not_in_keeps_null(spark, sf_dir):
    return _segments(spark, sf_dir).where(P.not_in(F.col("seg"), ["MACHINERY", "FURNITURE"])).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n FROM (SELECT {_SEG} AS seg FROM customer) t WHERE seg IS NOT NULL AND seg NOT IN ('MACHINERY', 'FURNITURE')")
def not_in_not_null(spark, sf_dir):
    c = _segments(spark, sf_dir)
    return c.where(P.not_in(F.col("seg"), ["MACHINERY", "FURNITURE"]) & F.col("seg").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n FROM (SELECT {_SEG} AS seg FROM customer) t WHERE seg IS NULL OR seg <> 'MACHINERY'")
def not_equal_keeps_null(spark, sf_dir):
    return _segments(spark, sf_dir).where(P.ne(F.col("seg"), "MACHINERY")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM (SELECT nullif(p_size, 7) AS s FROM part) t WHERE s IS NULL OR s NOT BETWEEN 5 AND 45")
def not_between_keeps_null(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.nullif(F.col("p_size"), F.lit(7)).alias("s"))
    return p.where(P.not_between(F.col("s"), 5, 45)).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) FILTER (WHERE seg IS NULL) AS eq_null, count(*) FILTER (WHERE seg IS NOT NULL) AS ne_null FROM (SELECT {_SEG} AS seg FROM customer) t")
def null_comparisons(spark, sf_dir):
    return _segments(spark, sf_dir).agg(F.count_if(P.eq(F.col("seg"), None)).alias("eq_null"), F.count_if(P.ne(F.col("seg"), None)).alias("ne_null"))


sql("null_literal_sql", f"SELECT count(*) AS n FROM (SELECT {_SEG} AS seg FROM customer) t WHERE seg = NULL", f"SELECT count(*) AS n FROM (SELECT {_SEG} AS seg FROM customer) t WHERE seg IS NULL")


@query(f"SELECT count(*) AS n FROM (SELECT {_SEG} AS seg FROM customer) t WHERE seg IS NULL OR seg NOT LIKE '%E%'")
def not_like_keeps_null(spark, sf_dir):
    return _segments(spark, sf_dir).where(P.not_like(F.col("seg"), "%E%")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE regexp_matches(p_brand, '#1[0-5]$')) AS hit, count(*) FILTER (WHERE NOT regexp_matches(p_brand, '#1[0-5]$')) AS miss FROM part")
def regexp_forms(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.agg(F.count_if(P.regexp(F.col("p_brand"), "#1[0-5]$")).alias("hit"), F.count_if(P.not_regexp(F.col("p_brand"), "#1[0-5]$")).alias("miss"))


@query("SELECT count(*) AS n FROM part WHERE (p_size = 1 AND p_type = 'PROMO') OR (p_size = 2 AND p_type = 'SMALL') OR (p_size = 50 AND p_type = 'LARGE')")
def row_value_in(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.where(P.row_in([F.col("p_size"), F.col("p_type")], [(1, "PROMO"), (2, "SMALL"), (50, "LARGE")])).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM part WHERE p_size > 10.5")
def numeric_string_coercion(spark, sf_dir):
    return load(spark, sf_dir, "part").where(P.compare(F.col("p_size").cast("string"), ">", "10.5")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (WHERE ts < timestamp '2024-01-11') AS upto, count(*) FILTER (WHERE ts >= timestamp '2024-01-11') AS after_,
          count(*) FILTER (WHERE ts BETWEEN timestamp '2024-01-05' AND timestamp '2024-01-10') AS between_ FROM events""")
def date_only_literals(spark, sf_dir):
    t = F.col("ts")
    return load(spark, sf_dir, "events").agg(
        F.count_if(P.time_compare(t, "<=", "2024-01-10")).alias("upto"), F.count_if(P.time_compare(t, ">", "2024-01-10")).alias("after_"),
        F.count_if(P.time_between(t, "2024-01-05", "2024-01-10")).alias("between_"),
    )


@query("""SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'click') > 0 AND count(*) FILTER (WHERE event_type = 'purchase') > 0
          AND count(*) FILTER (WHERE event_type = 'error') = 0""")
def set_valued_membership(spark, sf_dir):
    sets = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    kinds = F.col("kinds")
    return sets.where(P.has_value(kinds, "click") & P.has_value(kinds, "purchase") & P.negate(P.has_value(kinds, "error"))).select("user_id")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.0")
def prepared_parameters(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", ["F", 100000.0])


_TERM = r"(^|[^\p{L}\p{N}])%s([^\p{L}\p{N}]|$)"


@query("SELECT doc_id FROM documents WHERE " + " AND ".join(f"regexp_matches(lower(text), '{_TERM % t}')" for t in ("und", "der")))
def text_search(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(match_against(F.col("text"), "The UND, der")).select("doc_id")


sql("text_search_sql", "SELECT count(*) AS n FROM documents WHERE MATCH(text) AGAINST('licensed under' IN BOOLEAN MODE)",
    f"SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '{_TERM % 'licensed'}') AND regexp_matches(lower(text), '{_TERM % 'under'}')")

# -- joins -------------------------------------------------------------------------------------

sql("join_inner", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql("join_chain", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
sql("join_siblings", "SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
sql("join_left", "SELECT count(*) AS n, count(l_orderkey) AS matched FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45")
sql("join_right", "SELECT count(*) AS n, count(o_orderkey) AS matched FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
sql("join_bare_outer", "SELECT count(*) AS n FROM orders OUTER JOIN lineitem ON l_orderkey = o_orderkey", "SELECT count(*) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
sql("join_outer_chain", "SELECT count(*) AS n, count(o_orderkey) AS o, count(l_orderkey) AS l FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 LEFT JOIN lineitem ON l_orderkey = o_orderkey")
sql("join_anti_by_left_null", "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
sql("join_using", "SELECT count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) a JOIN (SELECT l_orderkey AS k FROM lineitem) b USING (k)")
sql("join_theta", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <= b.n_regionkey")
sql("join_self_count", "SELECT count(*) AS n FROM orders a JOIN orders b USING (o_custkey)")
sql("join_derived_grouped", "SELECT c_custkey, total FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) t ON o_custkey = c_custkey WHERE c_acctbal > 9000")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def semi_join(spark, sf_dir):
    return joins.semi(load(spark, sf_dir, "supplier"), load(spark, sf_dir, "lineitem").where("l_quantity > 49"), {"s_suppkey": "l_suppkey"}).select("s_suppkey", "s_name")


@query(f"""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {_SEG} AS seg FROM customer) d WHERE d.seg = nullif(c.c_mktsegment, 'FURNITURE'))""")
def anti_join_ignores_null(spark, sf_dir):
    c = load(spark, sf_dir, "customer").withColumn("own", F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")))
    return joins.anti(c, _segments(spark, sf_dir).select("seg").distinct(), {"own": "seg"}).select("c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)""")
def anti_join(spark, sf_dir):
    return joins.anti(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem").where("l_quantity > 10"), {"o_orderkey": "l_orderkey"}, keep_null=False).select("o_orderkey")


@query("SELECT count(*) AS n FROM lineitem WHERE (l_orderkey, l_partkey) IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity = 50)")
def semi_join_tuple(spark, sf_dir):
    a, b = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("x"), F.col("l_partkey").alias("y"))
    return joins.semi(a, b, {"l_orderkey": "x", "l_partkey": "y"}).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)")
def not_exists_theta(spark, sf_dir):
    a, b = load(spark, sf_dir, "lineitem").alias("a"), load(spark, sf_dir, "lineitem").alias("b")
    return joins.exists(a, b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") != F.col("b.l_suppkey")), negated=True).agg(F.count(F.lit(1)).alias("n"))


sql("exists_uncorrelated", "SELECT count(*) AS n FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P')")
sql("exists_correlated", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")


@query("""SELECT count(*) AS n FROM customer JOIN orders o ON o.o_custkey = c_custkey AND o.o_orderkey = (SELECT min(o2.o_orderkey) FROM orders o2 WHERE o2.o_custkey = c_custkey)""")
def join_on_correlated_scalar(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "customer").join(o.join(first, ["o_custkey", "o_orderkey"], "left_semi"), F.col("c_custkey") == F.col("o_custkey")).agg(F.count(F.lit(1)).alias("n"))


# -- subqueries, views -------------------------------------------------------------------------

sql("scalar_subquery_select", "SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) AS top FROM orders")
sql("scalar_subquery_where", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql("list_subquery", "SELECT count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("derived_table", "SELECT k FROM (SELECT p_size + 1 AS k, count(*) AS n FROM part GROUP BY p_size + 1) t WHERE k >= 48",
    "SELECT k FROM (SELECT cast(p_size AS DOUBLE) + 1 AS k, count(*) AS n FROM part GROUP BY p_size) t WHERE k >= 48")
sql("derived_wrapper", "SELECT kind, count(*) AS n FROM (SELECT o_orderstatus AS kind, o_totalprice FROM orders WHERE o_totalprice > 1000) wrapped GROUP BY kind")


@query("SELECT status, count(*) AS n FROM (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_totalprice > 250000) v GROUP BY status")
def view_with_column_names(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    spark.sql("CREATE OR REPLACE TEMP VIEW big_orders (k, status) AS SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 250000")
    return spark.sql("SELECT status, count(*) AS n FROM big_orders GROUP BY status")


# -- aggregates --------------------------------------------------------------------------------

sql("agg_global", "SELECT count(*) AS n, count(o_custkey) AS c, count(DISTINCT o_custkey) AS d, min(o_orderdate) AS lo, max(o_orderdate) AS hi, min(o_orderstatus) AS s FROM orders")
sql("agg_sum_is_double", "SELECT sum(p_size) AS total, avg(p_size) AS mean FROM part", "SELECT cast(sum(p_size) AS DOUBLE) AS total, avg(p_size) AS mean FROM part")
sql("agg_empty_input", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS lo, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0")
sql("agg_null_group", f"SELECT seg, count(*) AS n, count(seg) AS c FROM (SELECT {_SEG} AS seg FROM customer) t GROUP BY seg")
sql("agg_expressions", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, count(CASE WHEN l_quantity > 25 THEN 1 END) AS many, round(100 * sum(l_discount) / sum(l_tax), 4) AS ratio FROM lineitem GROUP BY l_returnflag")
sql("group_by_expression", "SELECT cast(year(o_orderdate) AS bigint) AS y, cast(month(o_orderdate) AS bigint) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)")
sql("group_by_alias_ordinal", "SELECT o_orderstatus AS st, o_orderpriority AS pr, count(*) AS n FROM orders GROUP BY st, 2")
sql("group_without_aggregate", "SELECT p_brand, p_type FROM part GROUP BY p_brand, p_type")
sql("group_functions_over_keys", "SELECT upper(p_type) AS t, round(avg(p_retailprice), 4) AS a FROM part GROUP BY upper(p_type)")
sql("having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 14")
sql("having_unselected", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 480000 AND count(*) > 3")
sql("having_arithmetic", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING round(sum(l_quantity) / count(*), 6) > 25.5 OR abs(min(l_discount)) > 1")
sql("count_distinct_expression", "SELECT o_orderstatus, count(DISTINCT substr(o_orderpriority, 1, 1)) AS d, count(DISTINCT o_custkey) AS c FROM orders GROUP BY o_orderstatus")
sql("relationship_value_sums", "SELECT o_orderkey, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")


def _topn_oracle(table: str, c: str, n: int) -> str:
    other = f"UNION ALL SELECT 'OTHER:', cast(sum(k) AS bigint), sum(k) / any_value(total) * 100 FROM r WHERE rn > {n} HAVING count(*) > 0" if n else ""
    return f"""WITH g AS (SELECT {c} AS v, count(*) AS k FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}),
        r AS (SELECT *, row_number() OVER (ORDER BY k DESC, v) AS rn, cast((SELECT sum(k) FROM g) AS double) AS total FROM g)
        SELECT v AS topn_{c}, k AS topn_count, k / total * 100 AS topn_percent FROM r WHERE rn <= {n or 10**9} {other}
        UNION ALL SELECT 'TOTAL:', cast(coalesce(sum(k), 0) AS bigint), CASE WHEN count(*) = 0 THEN 0.0 ELSE 100.0 END FROM g"""


for _name, _table, _column, _n in (("topn_all", "orders", "o_orderpriority", 0), ("topn_three", "part", "p_type", 3), ("topn_two", "events", "event_type", 2)):
    query(_topn_oracle(_table, _column, _n), _name)(lambda spark, sf_dir, t=_table, c=_column, n=_n: topn(load(spark, sf_dir, t), c, n))

# -- order, limit, distinct, unions ------------------------------------------------------------

sql("order_multi_key", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal, c_custkey")
sql("order_by_hidden_expression", "SELECT p_partkey FROM part ORDER BY CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END, p_retailprice * p_size DESC, p_partkey")
sql("order_by_ordinal", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
sql("order_nulls_first", f"SELECT c_custkey, seg FROM (SELECT c_custkey, {_SEG} AS seg FROM customer) t ORDER BY seg NULLS FIRST, c_custkey")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
sql("limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
sql("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
sql("offset_past_end", "SELECT r_name FROM region ORDER BY r_name LIMIT 5 OFFSET 100")
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("distinct_expression", "SELECT DISTINCT substr(p_brand, 1, 7) AS b FROM part")
sql("topk_aggregate", "SELECT l_partkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_partkey ORDER BY q DESC, l_partkey LIMIT 5")
sql("union_all", "SELECT c_name AS name, 'c' AS kind FROM customer UNION ALL SELECT s_name, 's' FROM supplier UNION ALL SELECT c_name, 'c' FROM customer")
sql("union_all_constants", "SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 2 ORDER BY a LIMIT 2")


@query("""SELECT event_id, event_type, value FROM (
            SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CAST('0x' || substr(md5('0|' || event_id || '|1'), 1, 15) AS BIGINT), event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) t
          WHERE k <= n * 5 // 100""")
def stratified_sample(spark, sf_dir):
    return joins.stratified_sample(load(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", 5.0, key=["event_id"])
