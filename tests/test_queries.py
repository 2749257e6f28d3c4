"""Every registered query of the SQL surface against DuckDB, plans, and the entry module without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessera import plans
from tessera.catalog import TABLES

SF, ROOT = "/root/testdata/sf0.001", Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    found = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    mine = df.toArrow()
    assert rows(mine.column_names, list(zip(*(c.to_pylist() for c in mine.columns), strict=True))) == rows(columns, found.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(plans.QUERIES["q6_discounted_revenue"](spark, SF))
    assert "PushedFilters" in plan and "l_comment" not in plan
    scan = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "l_orderkey" not in scan and "GreaterThanOrEqual(l_ship" in plan


def test_memberships_are_plain_anti_joins(spark):
    plan = plan_of(plans.QUERIES["q16_supplier_part_count"](spark, SF))
    assert "LeftAnti" in plan and "isnull" not in plan.split("LeftAnti")[1].splitlines()[0] and ", true" not in plan.split("LeftAnti")[1].splitlines()[0]


def test_no_python_in_the_plans(spark):
    for name, make in plans.QUERIES.items():
        text = plan_of(make(spark, SF))
        assert "Python" not in text and "MapInArrow" not in text and "CartesianProduct" not in text, name


def test_entry_works_without_the_optional_subpackage(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q6_discounted_revenue' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
