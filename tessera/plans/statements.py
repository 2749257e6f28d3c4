"""Statements that change tables or ask the catalog, each with the rows that result; every query has a session of its own."""

from __future__ import annotations

from tessera.sql.engine import Engine

from .registry import ORACLES, QUERIES


def script(name: str, statements: list[str], last: str, oracle: str | None) -> None:
    """Register: run the statements in one session, then the query ``last``."""

    def run(spark, sf_dir):
        engine = Engine(spark, sf_dir)
        for s in statements:
            engine.run(s)
        return engine.run(last)

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"

script("stmt_insert_values", ["INSERT INTO region (r_name, r_regionkey) VALUES ('NOWHERE', 90), (concat('NO', 'NAME'), 91), (DEFAULT, 92)", "INSERT INTO region VALUES (90, 'AGAIN'), (93, 'first'), (93, 'a last one')"],
       "SELECT r_regionkey, r_name FROM region", "SELECT * FROM region UNION ALL SELECT 90, 'AGAIN' UNION ALL SELECT 91, 'NONAME' UNION ALL SELECT 92, NULL UNION ALL SELECT 93, 'a last one'")
script("stmt_insert_select", ["INSERT INTO customer (c_custkey, c_name, c_acctbal) SELECT s_suppkey + 5000000, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0"],
       "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey + 5000000, s_name, NULL, s_acctbal FROM supplier WHERE s_acctbal > 0")
script("stmt_replace", ["REPLACE INTO nation VALUES (3, 'THIRD', 0), (77, 'NEW', 1)", "INSERT INTO nation VALUES (4, 'FOURTH', 2) ON DUPLICATE KEY UPDATE n_name = 'ignored'"], "SELECT n_nationkey, n_name, n_regionkey FROM nation",
       "SELECT * FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT 3, 'THIRD', 0 UNION ALL SELECT 77, 'NEW', 1 UNION ALL SELECT 4, 'FOURTH', 2")
script("stmt_update", ["UPDATE orders SET o_orderstatus = 'X', o_totalprice = o_totalprice * 2 WHERE o_orderstatus = 'P' AND o_totalprice > 100000"], _O,
       """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
          CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""")
script("stmt_update_subquery", ["UPDATE orders SET o_orderstatus = upper(concat('v', 'ip')) WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)"], _O,
       """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders) THEN 'VIP' ELSE o_orderstatus END AS o_orderstatus,
          o_totalprice FROM orders""")
script("stmt_update_join", ["UPDATE orders o JOIN customer c ON o.o_custkey = c.c_custkey SET o.o_orderstatus = c.c_mktsegment WHERE c.c_acctbal > 9000"], _O,
       "SELECT o_orderkey, o_custkey, CASE WHEN c_acctbal > 9000 THEN c_mktsegment ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
script("stmt_update_limit", ["UPDATE orders SET o_orderstatus = 'T' WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"], _O,
       "SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 25 THEN 'T' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
script("stmt_delete", ["DELETE FROM orders WHERE o_orderstatus <> 'O' OR o_totalprice BETWEEN 1000 AND 50000"], _O, _O + " WHERE NOT (o_orderstatus <> 'O' OR o_totalprice BETWEEN 1000 AND 50000)")
script("stmt_delete_join", ["DELETE o FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey < 5"], _O, _O + " WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
script("stmt_delete_subquery", ["DELETE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"], "SELECT c_custkey FROM customer", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
script("stmt_delete_limit", ["DELETE FROM orders ORDER BY o_orderkey LIMIT 10"], _O, f"{_O} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10)")
script("stmt_truncate", ["TRUNCATE TABLE region"], "SELECT r_regionkey, r_name FROM region", "SELECT * FROM region WHERE false")
script("stmt_create_as_select", ["CREATE TABLE big AS SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey", "CREATE TABLE IF NOT EXISTS big AS SELECT 1 AS one"], "SELECT k, n, round(s, 2) AS s FROM big WHERE n > 3",
       "SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 3")
script("stmt_temporary_tables", ["CREATE TEMPORARY TABLE t (id int PRIMARY KEY, label varchar(20) DEFAULT 'none', seen datetime)", "INSERT INTO t (id) VALUES (1), (2)", "INSERT INTO t VALUES (2, 'two', '2024-01-02'), (3, 'three', NULL)",
                                 "CREATE TEMPORARY TABLE u LIKE t", "INSERT INTO u SELECT * FROM t WHERE id > 1", "CREATE TEMPORARY TABLE w AS SELECT id FROM u", "DROP TEMPORARY TABLE IF EXISTS absent"],
       "SELECT t.id, t.label, t.seen, w.id AS w FROM t LEFT JOIN w ON t.id = w.id", "SELECT * FROM (VALUES (1, 'none', NULL::TIMESTAMP, NULL::INTEGER), (2, 'two', TIMESTAMP '2024-01-02', 2), (3, 'three', NULL, 3)) v(id, label, seen, w)")
script("stmt_add_column", ["ALTER TABLE region ADD COLUMN r_note varchar(9)", "INSERT INTO region VALUES (99, 'NOWHERE', 'added')", "UPDATE region SET r_note = 'set' WHERE r_regionkey = 1"], "SELECT r_regionkey, r_name, r_note FROM region",
       "SELECT r_regionkey, r_name, CASE WHEN r_regionkey = 1 THEN 'set' END AS r_note FROM region UNION ALL SELECT 99, 'NOWHERE', 'added'")
script("stmt_views", ["CREATE VIEW v (k, status) AS SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 250000", "CREATE OR REPLACE VIEW names AS SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier",
                      "CREATE VIEW gone AS SELECT 1 AS one", "DROP VIEW gone"],
       "SELECT status, count(*) AS n FROM v GROUP BY status UNION ALL SELECT 'names', count(*) FROM names", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1 UNION ALL SELECT 'names', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")
script("stmt_drop_table", ["CREATE TABLE x AS SELECT 1 AS a", "DROP TABLE x", "DROP TABLE IF EXISTS x CASCADE", "DROP TABLE region", "CREATE TABLE region"], "SELECT r_regionkey FROM region", "SELECT r_regionkey FROM region")
script("stmt_transactions", ["BEGIN", "DELETE FROM region WHERE r_regionkey = 0", "ROLLBACK", "START TRANSACTION", "COMMIT", "USE tessera", "SET @x = 5, autocommit = 0", "SET NAMES utf8mb4"], "SELECT r_regionkey, @x AS x FROM region", "SELECT r_regionkey, 5 AS x FROM region WHERE r_regionkey <> 0")
script("stmt_describe", [], "DESCRIBE orders", """SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'NO', 'PRI', NULL, ''), ('o_custkey', 'bigint', 'YES', '', NULL, ''), ('o_orderstatus', 'varchar(255)', 'YES', '', NULL, ''),
       ('o_totalprice', 'double', 'YES', '', NULL, ''), ('o_orderdate', 'datetime', 'YES', '', NULL, ''), ('o_orderpriority', 'varchar(255)', 'YES', '', NULL, '')) v("Field", "Type", "Null", "Key", "Default", "Extra")""")
script("stmt_show_tables", [], "SHOW TABLES LIKE '%o%s'", "SELECT view_name AS Tables_in_tessera FROM duckdb_views() WHERE NOT internal AND view_name LIKE '%o%s'")
script("stmt_show_index", [], "SHOW INDEX FROM part", """SELECT 'part' AS "Table", 0 AS Non_unique, 'PRIMARY' AS Key_name, 1 AS Seq_in_index, 'p_partkey' AS Column_name""")
script("stmt_show_variables", [], "SHOW VARIABLES LIKE 'character_set_%'", "SELECT 'character_set_' || x AS Variable_name, 'utf8mb4' AS Value FROM (VALUES ('client'), ('connection'), ('results'), ('server')) v(x)")
script("stmt_explain", [], "EXPLAIN SELECT count(*) FROM orders WHERE o_totalprice > 5", None)
