"""The SQL dialect: what it refuses, statements over a session's tables, and rules that need rows of their own."""

import re

import pytest

from tessera.operators.dml import MissingPredicate
from tessera.sql.engine import Engine
from tessera.sql.parser import Parser, tokens
from tessera.sql.tree import Bin, Col, Lit, SqlError

SF = "/root/testdata/sf0.001"


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, SF, f"file://{tmp_path}")
    e.run("CREATE TEMPORARY TABLE t (id int PRIMARY KEY, s varchar(20), x double, at datetime)")
    e.run("INSERT INTO t VALUES (1, 'a', 1.5, '2024-01-10 12:00:00'), (2, 'b', -2, '2024-01-11'), (3, NULL, NULL, NULL), (4, '10', 10, '2024-01-09')")
    return e


def ids(engine, where, *args):
    return sorted(r.id for r in engine.run(f"SELECT id FROM t WHERE {where}", list(args)).collect())


def one(engine, sql):
    return tuple(engine.run(sql).first())


def test_tokens_and_precedence():
    assert [t.text for t in tokens("a<>'it''s' -- note\n`b c` /* x */ 1.5e3 @@x \"q\"")] == ["a", "<>", "it's", "b c", "1.5e3", "@@x", "q"]
    tree = Parser("a + 2 * 3 = 7 or not b and c").expression()
    assert tree.op == "or" and tree.right.op == "and" and tree.left == Bin("=", Bin("+", Col("a"), Bin("*", Lit(2), Lit(3))), Lit(7))


@pytest.mark.parametrize("sql", [
    "SELECT 1 UNION SELECT 2", "SELECT * FROM t, t u", "SELECT * FROM t CROSS JOIN t u", "SELECT * FROM t FULL OUTER JOIN t u ON 1 = 1", "SELECT nothing FROM t", "SELECT bogus(1)", "SELECT id FROM t GROUP BY s",
    "SELECT id id FROM t WHERE", "SELECT s FROM t RLIKE 'x'", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT id FROM t t1 JOIN t t2 ON t1.id = t2.id", "SELECT date_format(at, s) FROM t", "SELECT week(at, 1) FROM t",
    "SELECT id FROM t ORDER BY 5", "SELECT * FROM absent", "SELECT cast(id AS wibble) FROM t", "SELECT sum(count(*)) FROM t", "CREATE TABLE z (a int)", "CREATE TABLE region2", "DROP TABLE absent", "INSERT INTO t (id, nope) VALUES (1, 2)",
    "INSERT INTO t VALUES (1)", "SELECT id FROM t WHERE id = ?", "SHOW NONSENSE", "USE elsewhere", "CREATE TABLE d AS SELECT id, s AS id FROM t",
])
def test_refused(engine, sql):
    with pytest.raises((SqlError, ValueError)):
        engine.run(sql)


def test_predicates(engine):
    assert ids(engine, "s <> 'a'") == [2, 3, 4] and ids(engine, "NOT s = 'a'") == [2, 3, 4] and ids(engine, "s NOT IN ('a', 'b')") == [3, 4]
    assert ids(engine, "x NOT BETWEEN 0 AND 5") == [2, 3, 4] and ids(engine, "s NOT LIKE 'a%'") == [2, 3, 4] and ids(engine, "s = NULL") == [3] and ids(engine, "s != NULL") == [1, 2, 4]
    assert ids(engine, "at <= '2024-01-10'") == [1, 4] and ids(engine, "at > '2024-01-10'") == [2] and ids(engine, "at BETWEEN '2024-01-09' AND '2024-01-10'") == [4]
    assert ids(engine, "s = 10") == [4] and ids(engine, "s > 9.5") == [1, 2, 4] and ids(engine, "x = '10.0'") == [4] and ids(engine, "x IN (?, ?)", 1.5, "10") == [1, 4]
    assert ids(engine, "s REGEXP '^[ab]'") == [1, 2] and ids(engine, "s REGEXP '('") == [] and ids(engine, "s NOT REGEXP '('") == [1, 2, 3, 4] and ids(engine, "lower(s) = s") == [1, 2, 3, 4]
    assert ids(engine, "s NOT IN (SELECT NULL FROM region)") == [1, 2, 4] and ids(engine, "s NOT IN (SELECT 'a' FROM region) AND id > 0") == [2, 3, 4]
    assert ids(engine, "if(s = 'a', 1, 0)") == [1] and ids(engine, "CASE WHEN s <> 'a' THEN true ELSE false END") == [2, 4] and ids(engine, "MATCH(s) AGAINST('B')") == [2]


def test_scalar_subqueries(spark, engine):
    assert one(engine, "SELECT (SELECT s FROM t WHERE id = 1) AS v") == ("a",)
    for inner in ("SELECT s FROM t WHERE id = 99", "SELECT s FROM t"):
        with pytest.raises(Exception, match="scalar subquery"):
            engine.run(f"SELECT ({inner}) AS v").collect()
    with pytest.raises(Exception, match="division by zero"):
        engine.run("SELECT id / 0 AS v FROM t").collect()
    assert one(engine, "SELECT (SELECT max(u.x) FROM t u WHERE u.id <= t.id) AS v FROM t WHERE id = 2") == (1.5,)


def test_names_and_shapes(engine):
    assert engine.run("SELECT t.*, id + 1, count(*) AS n FROM t GROUP BY id, s, x, at").columns == ["id", "s", "x", "at", "id + 1", "n"]
    assert one(engine, "SELECT count(*) AS n, sum(id) AS s, min(s) AS m FROM t WHERE id > 99") == (0, None, None)
    assert [tuple(r) for r in engine.run("SELECT a.id, b.id AS other FROM t a LEFT JOIN t b ON b.id = a.id + 1 ORDER BY a.id DESC LIMIT 2, 1").collect()] == [(2, 3)]
    assert engine.run("SELECT id, s FROM t a JOIN (SELECT id AS id2 FROM t) b ON id = id2 ORDER BY x").count() == 4
    assert engine.run("SELECT * FROM t a JOIN t b USING (id)").columns == ["id", "s", "x", "at", "s", "x", "at"]
    assert [r[0] for r in engine.run("SELECT s FROM t ORDER BY s").collect()] == [None, "10", "a", "b"]
    assert one(engine, "SELECT least(3, 1, 2) AS a, greatest('b', 'a') AS b, truncate(-1.57, 1) AS c, hash.sha256('x') AS d, concat('a', NULL) AS e")[:3] == (1, "b", -1.5)


def test_statements(engine):
    run = engine.run
    for bad in ("UPDATE t SET s = 'x'", "DELETE FROM t"):
        with pytest.raises(MissingPredicate):
            run(bad)
    assert one(engine, "UPDATE t SET x = x + 1, s = concat(s, '!') WHERE s IS NOT NULL AND id < 4") == (2,)
    assert {r.id: (r.s, r.x) for r in run("SELECT id, s, x FROM t").collect()} == {1: ("a!", 2.5), 2: ("b!", -1.0), 3: (None, None), 4: ("10", 10.0)}
    assert one(engine, "DELETE FROM t LIMIT 1") == (1,) and one(engine, "DELETE FROM t WHERE id IN (SELECT id FROM t WHERE x < 0)") == (1,)
    assert one(engine, "REPLACE INTO t (id) VALUES (3), (5), (5)") == (3,) and ids(engine, "id > 0")[-2:] == [4, 5]
    run("CREATE TABLE keep AS SELECT id, s FROM t")
    with pytest.raises(SqlError):
        run("CREATE TABLE keep AS SELECT 1 AS one")
    run("CREATE VIEW v (n) AS SELECT count(*) FROM keep")
    assert one(engine, "SELECT n FROM v")[0] == run("SELECT id FROM t").count()
    run("DROP VIEW v")
    run("ALTER TABLE keep ADD PRIMARY KEY (id)")
    run("INSERT INTO keep VALUES (5, 'again')")
    assert one(engine, "SELECT s FROM keep WHERE id = 5") == ("again",)
    run("TRUNCATE keep")
    assert run("SELECT * FROM keep").count() == 0
    run("DROP TABLE keep")
    run("DROP TEMPORARY TABLE t")
    with pytest.raises(SqlError):
        run("SELECT * FROM t")


def test_set_valued_columns(spark, tmp_path):
    from tessera.operators.dml import StoredTable

    e = Engine(spark, None, f"file://{tmp_path}")
    e.stored["people"] = StoredTable(spark, f"file://{tmp_path}/people", "id int, phones array<string>", ("id",))
    e.run("INSERT INTO people VALUES (1, 'cell;home'), (2, NULL)")
    e.run("UPDATE people SET phones = 'work' WHERE id > 0")
    assert [r.id for r in e.run("SELECT id FROM people WHERE phones = 'cell' AND phones = 'work'").collect()] == [1]
    assert [r.id for r in e.run("SELECT id FROM people WHERE phones <> 'cell'").collect()] == [2]
    e.run("UPDATE people SET phones = NULL WHERE id = 1")
    assert [r.id for r in e.run("SELECT id FROM people WHERE phones IS NULL").collect()] == [1]


def test_catalog_and_session(engine):
    rows = lambda sql: [tuple(r) for r in engine.run(sql).collect()]
    assert ("orders",) in rows("SHOW TABLES") and rows("SHOW FULL TABLES LIKE 'region'") == [("region", "BASE TABLE")]
    assert rows("SHOW COLUMNS FROM region WHERE `Key` = 'PRI'")[0][0] == "r_regionkey" and rows("DESC t")[0][:2] == ("id", "bigint")
    assert "r_name" in rows("SHOW CREATE TABLE region")[0][1] and rows("SHOW DATABASES")[1] == ("tessera",)
    for what in "TABLE STATUS;INDEX FROM t;VARIABLES;STATUS;WARNINGS;ERRORS;ENGINES;CHARACTER SET;COLLATION;PROCESSLIST;GRANTS;PRIVILEGES;TRIGGERS;EVENTS;PROCEDURE STATUS;FUNCTION STATUS;PLUGINS;OPEN TABLES;KEYS FROM region;FIELDS FROM region;SCHEMAS".split(";"):
        assert engine.run(f"SHOW {what}").columns, what
    for view in "tables views schemata columns statistics table_constraints key_column_usage referential_constraints character_sets collations".split():
        assert engine.run(f"SELECT * FROM information_schema.{view}").columns, view
    engine.run("CREATE VIEW v AS SELECT 1 AS one")
    assert rows("SELECT table_name FROM information_schema.views") == [("v",)]
    engine.run("SET @limit = 3, time_zone = 'UTC'")
    assert one(engine, "SELECT @limit AS a, @@time_zone AS b, version() AS c")[:2] == (3, "UTC")
    assert "Scan" in str(rows("EXPLAIN FORMAT=JSON SELECT * FROM orders")) and engine.run("EXPLAIN SELECT 1").count() > 0


def _tables(plan, pairs):
    """First letters of the columns of the tables whose rows a plan joins; ``pairs`` takes those of each inner join."""
    below = [_tables(plan.children().apply(i), pairs) for i in range(plan.children().size())]
    kind = plan.nodeName()
    if kind == "Union":  # each side has been looked at
        return set()
    if not below:
        return {plan.output().apply(0).name()[0]}
    if kind == "Join" and plan.joinType().sql() == "LEFT SEMI":
        return below[0]
    out = set().union(*below)
    if kind == "Join":
        pairs.append(out)
    return out


_SIBLINGS = "nation n JOIN customer c ON c_nationkey = n_nationkey JOIN supplier s ON s_nationkey = n_nationkey"


@pytest.mark.parametrize(("source", "keys", "values"), [
    (_SIBLINGS, "n_name", "count(DISTINCT c_custkey), count(DISTINCT s_suppkey)"),
    (_SIBLINGS, "n_regionkey", "min(s_acctbal), max(c_name), count(DISTINCT c_mktsegment, c_nationkey), count(DISTINCT n_name), count(DISTINCT 1)"),
    (_SIBLINGS, "n_name", "sum(DISTINCT s_suppkey), max(c_acctbal * 2 + n_nationkey)"),
    (_SIBLINGS, None, "count(DISTINCT c_custkey), count(DISTINCT s_suppkey), min(n_name)"),
    (_SIBLINGS, "n_regionkey * 2, lower(n_name)", "count(DISTINCT s_suppkey)"),
    (_SIBLINGS, "n_name", None),
    (f"{_SIBLINGS} AND s_acctbal > 2000 WHERE c_acctbal > 1000 AND n_regionkey <> 2", "n_name", "count(DISTINCT c_custkey), count(DISTINCT s_suppkey)"),
    (f"{_SIBLINGS} AND s_acctbal > 1e9", None, "count(DISTINCT c_custkey), min(s_suppkey)"),
    (f"{_SIBLINGS} JOIN orders o ON o_custkey = c_custkey JOIN region r ON r_regionkey = n_regionkey", "r_name", "count(DISTINCT o_orderkey), count(DISTINCT c_custkey), count(DISTINCT s_suppkey)"),
    ("nation n JOIN customer c ON c_nationkey = n_nationkey JOIN supplier s ON s_nationkey < n_nationkey", "n_name", "count(DISTINCT c_custkey), count(DISTINCT s_suppkey)"),
    (f"{_SIBLINGS} JOIN customer d ON d.c_nationkey = n_nationkey", "n_name", "count(DISTINCT c.c_custkey), max(d.c_custkey), min(s_suppkey)"),
])
def test_siblings_are_not_paired(spark, source, keys, values):
    engine = Engine(spark, SF)
    named = [*([f"{k} AS k{i}" for i, k in enumerate(keys.split(", "))] if keys else []), *([f"{v} AS v{i}" for i, v in enumerate(re.split(r", (?=\w+\()", values))] if values else [])]
    tail = f" GROUP BY {keys}" if keys else ""
    made = engine.run(f"SELECT {', '.join(named)} FROM {source}{tail}")
    # From a derived table, whose pairs are all made, as from views.
    columns = "n_name, n_nationkey, n_regionkey, c.c_custkey AS c_custkey, c.c_name AS c_name, c.c_nationkey AS c_nationkey, c.c_acctbal AS c_acctbal, c.c_mktsegment AS c_mktsegment, s_suppkey, s_acctbal"
    columns += ", o_orderkey, r_name" if "orders" in source else ", d.c_custkey AS d_custkey" if "customer d" in source else ""
    paired = engine.run(f"SELECT {', '.join(named)} FROM (SELECT {columns} FROM {source}) j{tail}".replace("max(d.c_custkey)", "max(d_custkey)").replace("c.c_custkey)", "c_custkey)"))
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, paired.collect()), key=str) and made.dtypes == paired.dtypes
    for df, expected in ((made, False), (paired, True)):
        _tables(df._jdf.queryExecution().optimizedPlan(), pairs := [])
        assert any({"c", "s"} <= p for p in pairs) == expected


def test_siblings_with_nulls_and_repeated_rows(engine):
    engine.run("CREATE TEMPORARY TABLE mid (k int, g varchar(9))")
    engine.run("INSERT INTO mid VALUES (1, 'a'), (1, 'a'), (2, 'a'), (2, NULL), (3, NULL), (4, 'only a'), (5, 'only b'), (NULL, 'none')")
    for t in ("a", "b"):
        engine.run(f"CREATE TEMPORARY TABLE {t}{t} ({t}k int, {t}v double)")
    engine.run("INSERT INTO aa VALUES (1, 5), (1, 5), (1, 6), (2, 6), (2, 7), (3, NULL), (4, 1), (NULL, 9)")
    engine.run("INSERT INTO bb VALUES (1, -1), (2, NULL), (2, -2), (3, -3), (3, -3), (5, 1), (NULL, 9)")
    source = "mid JOIN aa ON ak = k JOIN bb ON bk = k"
    both = "count(DISTINCT av) AS a, count(DISTINCT bv) AS b, max(av) AS high"
    rows = {tuple(r) for r in engine.run(f"SELECT g, {both} FROM {source} GROUP BY g").collect()}
    assert rows == {("a", 3, 2, 7.0), (None, 2, 2, 7.0)}
    assert one(engine, f"SELECT {both} FROM {source}") == (3, 3, 7.0)
    # Where repeated rows count, or a row without a match stays, the pairs are made.
    assert {tuple(r) for r in engine.run(f"SELECT g, count(*) AS n, count(DISTINCT av) AS a FROM {source} GROUP BY g").collect()} == {("a", 10, 3), (None, 6, 2)}
    assert {tuple(r) for r in engine.run("SELECT g, count(DISTINCT av) AS a, count(DISTINCT bv) AS b FROM mid JOIN aa ON ak = k LEFT JOIN bb ON bk = k GROUP BY g").collect()} == {("a", 3, 2), (None, 2, 2), ("only a", 1, 0)}
