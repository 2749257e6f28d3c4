"""Table descriptors, loading, relationships and the information schema."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the known tables. Reading with them spares the job that infers a schema.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(COLUMNS)


@dataclass(frozen=True)
class FieldSpec:
    """A column: SQL type, and the flags that change what it means."""

    name: str
    type: str
    required: bool = False
    default: str | None = None  # SQL expression for a missing value
    set_valued: bool = False
    delimiter: str = ";"
    searchable: bool = False


@dataclass(frozen=True)
class Relationship:
    child: str
    foreign_key: str
    parent: str
    primary_key: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    primary_key: tuple[str, ...]
    fields: tuple[FieldSpec, ...]
    time_field: str | None = None
    time_quantum: str | None = None  # YMD or YMDH
    selector: str | None = None  # SQL condition that routes an event here
    relationships: tuple[Relationship, ...] = field(default=())

    def ddl(self) -> str:
        return ", ".join(f"`{f.name}` {f'array<{f.type}>' if f.set_valued else f.type}" for f in self.fields)


RELATIONSHIPS = (
    Relationship("nation", "n_regionkey", "region", "r_regionkey"),
    Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
    Relationship("supplier", "s_nationkey", "nation", "n_nationkey"),
    Relationship("orders", "o_custkey", "customer", "c_custkey"),
    Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Relationship("lineitem", "l_partkey", "part", "p_partkey"),
    Relationship("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)
PRIMARY_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reader = spark.read.schema(COLUMNS[table]) if table in COLUMNS else spark.read
    return reader.parquet(f"{sf_dir}/{table}.parquet")


@cache
def fields(table: str) -> list[T.StructField]:
    """The fields of a known table."""
    return T.StructType.fromDDL(COLUMNS[table]).fields


def register(spark: SparkSession, sf_dir: str, tables=TABLES) -> None:
    for t in tables:
        load(spark, sf_dir, t).createOrReplaceTempView(t)


_NAMES = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "string": "string", "boolean": "bool", "date": "time", "timestamp": "time", "timestamp_ntz": "time"}


def information_schema(spark: SparkSession, sf_dir: str, view: str, tables=TABLES) -> DataFrame:
    """A virtual table of the catalog for the given tables (metadata only: no table is read)."""
    schemas = {t: load(spark, sf_dir, t).schema for t in tables}
    return virtual_table(spark, view, schemas, {t: k for t, k in PRIMARY_KEYS.items() if t in schemas})


def virtual_table(spark: SparkSession, view: str, schemas: dict, keys: dict[str, str], views: list[tuple[str, str]] = (), database: str = "tessera") -> DataFrame:
    """One of the ten virtual tables, from the tables' schemas and keys and the views' names and texts."""
    links = [r for r in RELATIONSHIPS if r.child in schemas and r.parent in schemas]
    rows: dict[str, tuple[str, list[tuple]]] = {
        "tables": ("table_schema string, table_name string, table_type string", [(database, t, "BASE TABLE") for t in schemas] + [(database, v, "VIEW") for v, _ in views]),
        "views": ("table_schema string, table_name string, view_definition string", [(database, v, text) for v, text in views]),
        "schemata": ("schema_name string", [("information_schema",), (database,)]),
        "columns": (
            "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string",
            [(database, t, f.name, i + 1, "NO" if keys.get(t) == f.name else "YES", _NAMES.get(f.dataType.simpleString(), "unknown")) for t, s in schemas.items() for i, f in enumerate(s.fields)],
        ),
        "statistics": ("table_name string, index_name string, column_name string", [(t, "PRIMARY", k) for t, k in keys.items()]),
        "table_constraints": (
            "table_name string, constraint_name string, constraint_type string",
            [(t, "PRIMARY", "PRIMARY KEY") for t in keys] + [(r.child, f"fk_{r.foreign_key}", "FOREIGN KEY") for r in links],
        ),
        "key_column_usage": (
            "table_name string, column_name string, constraint_name string, referenced_table_name string, referenced_column_name string",
            [(t, k, "PRIMARY", None, None) for t, k in keys.items()] + [(r.child, r.foreign_key, f"fk_{r.foreign_key}", r.parent, r.primary_key) for r in links],
        ),
        "referential_constraints": ("table_name string, constraint_name string, referenced_table_name string", [(r.child, f"fk_{r.foreign_key}", r.parent) for r in links]),
        "character_sets": ("character_set_name string, maxlen int", [("utf8mb4", 4)]),
        "collations": ("collation_name string, character_set_name string", [("utf8mb4_bin", "utf8mb4")]),
    }
    if view not in rows:
        raise ValueError(f"unknown virtual table {view}")
    schema, found = rows[view]
    return spark.createDataFrame(found, schema)


def row_number_column(df: DataFrame, *keys: str, name: str = "rownum") -> DataFrame:
    """The row-id pseudo column: the integer key itself where there is one, else an id that is unique but not gapless."""
    return df.withColumn(name, F.col(keys[0]).cast("long") if len(keys) == 1 else F.monotonically_increasing_id())
