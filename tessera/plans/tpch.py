"""TPC-H shaped queries on the tables at hand (date windows and constants moved to where they have rows)."""

from .registry import sql

sql("q1_pricing_summary", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty,
           round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= date '1998-09-02' GROUP BY l_returnflag, l_linestatus""")

sql("q3_shipping_priority", """
    SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < date '1998-03-15' AND l_shipdate > date '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")

sql("q4_order_priority", """
    SELECT o_orderpriority, count(*) AS order_count FROM orders
    WHERE o_orderdate >= date '1996-07-01' AND o_orderdate < date '1996-10-01'
      AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
    GROUP BY o_orderpriority""")

sql("q5_local_supplier_revenue", """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
         JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1998-01-01' GROUP BY n_name""")

sql("q5_graph_count", """
    SELECT count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
         JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA'""")

sql("q6_discounted_revenue", """
    SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
    WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")

sql("q7_volume_shipping", """
    SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, cast(year(l_shipdate) AS bigint) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
         JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
    WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')
    GROUP BY n1.n_name, n2.n_name, year(l_shipdate)""")

sql("q8_market_share", """
    SELECT cast(year(o_orderdate) AS bigint) AS o_year,
           round(sum(CASE WHEN n2.n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
         JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
         JOIN nation n2 ON s_nationkey = n2.n_nationkey
    WHERE r_name = 'ASIA' AND p_type = 'ECONOMY' GROUP BY year(o_orderdate)""")

sql("q9_product_profit", """
    SELECT n_name AS nation, cast(year(o_orderdate) AS bigint) AS o_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS profit
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
    WHERE p_name LIKE '%bolt%' GROUP BY n_name, year(o_orderdate)""")

sql("q10_returned_items", """
    SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= date '1996-10-01' AND o_orderdate < date '1997-01-01' AND l_returnflag = 'R'
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")

sql("q11_important_suppliers", """
    SELECT l_suppkey, round(sum(l_extendedprice * l_quantity), 2) AS value FROM lineitem GROUP BY l_suppkey
    HAVING sum(l_extendedprice * l_quantity) > (SELECT sum(l_extendedprice * l_quantity) * 0.0105 FROM lineitem)""")

sql("q12_order_lines_by_date", """
    SELECT l_linestatus, cast(sum(CASE WHEN o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' THEN 1 ELSE 0 END) AS bigint) AS high_lines,
           cast(sum(CASE WHEN o_orderpriority NOT LIKE '1-%' AND o_orderpriority NOT LIKE '2-%' THEN 1 ELSE 0 END) AS bigint) AS low_lines
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01'
    GROUP BY l_linestatus""")

sql("q13_customer_distribution", """
    SELECT c_count, count(*) AS custdist FROM
      (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) t
    GROUP BY c_count""")

sql("q14_promotion_effect", """
    SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= date '1996-09-01' AND l_shipdate < date '1996-10-01'""")

sql("q15_top_supplier", """
    SELECT s_suppkey, s_name, round(total, 2) AS total_revenue FROM supplier JOIN
      (SELECT l_suppkey, sum(round(l_extendedprice * (1 - l_discount), 4)) AS total FROM lineitem WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-04-01' GROUP BY l_suppkey) r
      ON s_suppkey = l_suppkey
    WHERE round(total, 2) = (SELECT round(max(t), 2) FROM (SELECT sum(round(l_extendedprice * (1 - l_discount), 4)) AS t FROM lineitem
          WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-04-01' GROUP BY l_suppkey) m)""")

sql("q16_supplier_part_count", """
    SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3)
      AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""")

sql("q17_small_quantity_revenue", """
    SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE p_brand = 'Brand#12' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""")

sql("q18_large_orders", """
    SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 220)
    GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")

sql("q19_discounted_or", """
    SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
       OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
       OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""")

sql("q20_part_promotion", """
    SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE n_regionkey = 2 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%bolt%')
          GROUP BY l_suppkey, l_partkey HAVING sum(l_quantity) > 45)""")

sql("q21_waiting_suppliers", """
    SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
    WHERE o_orderstatus = 'F' AND n_name = 'NATION_4'
      AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
      AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
    GROUP BY s_name""")

sql("q21_sibling_exists_count", """
    SELECT count(*) AS n FROM lineitem l1 WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)""")

sql("q22_sales_opportunity", """
    SELECT substr(c_name, 1, 12) AS cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
    WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= date '2000-06-01') GROUP BY substr(c_name, 1, 12)""")

sql("shipdate_year_count", "SELECT cast(year(l_shipdate) AS bigint) AS ship_year, count(*) AS n FROM lineitem GROUP BY year(l_shipdate)")
sql("lineitem_count", "SELECT count(*) AS n FROM lineitem")
sql("part_filter_count", "SELECT count(*) AS n FROM part WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3)")
