"""The engine: a session's tables, views, variables and statements over DataFrames.

Tables are looked up as temporary tables and views of the session, stored tables (versioned Parquet under ``home``), the Parquet
tables of ``sf_dir``, the virtual tables of ``information_schema`` and Spark's own views, in this order. A Parquet table
is never changed: the first change makes a stored table that begins as its copy. There are no transactions: COMMIT and ROLLBACK are
accepted, and what was written stays.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import predicates as P
from tessera.functions import scalar as S
from tessera.operators import dml
from tessera.session import shared_folder

from .compiler import Compiler, Scope, inside, kind_of
from .statements import StatementParser
from .tree import Col, Default, Exists, Join, Lit, Query, SqlError, Statement, Sub, Table

#: Types of column definitions.
TYPES = {
    **dict.fromkeys(("int", "integer", "smallint", "tinyint", "mediumint"), "int"), "bigint": "bigint",
    **dict.fromkeys(("double", "float", "real", "decimal", "numeric"), "double"), **dict.fromkeys(("char", "varchar", "text", "string", "json", "longtext"), "string"),
    **dict.fromkeys(("date", "datetime", "timestamp"), "timestamp_ntz"), **dict.fromkeys(("bool", "boolean"), "boolean"),
}
_SQL_NAMES = {"num": "bigint", "str": "varchar(255)", "time": "datetime", "bool": "tinyint(1)", "set": "set", "null": "null", "other": "text"}

#: Session variables at the start.
VARIABLES = {
    "version": "8.0.0-tessera", "version_comment": "tessera", "autocommit": "1", "sql_mode": "", "time_zone": "UTC", "system_time_zone": "UTC", "max_allowed_packet": "67108864",
    "character_set_client": "utf8mb4", "character_set_connection": "utf8mb4", "character_set_results": "utf8mb4", "character_set_server": "utf8mb4",
    "collation_connection": "utf8mb4_bin", "collation_server": "utf8mb4_bin", "lower_case_table_names": "0", "wait_timeout": "28800",
    "interactive_timeout": "28800", "net_write_timeout": "60", "transaction_isolation": "READ-COMMITTED", "tx_isolation": "READ-COMMITTED", "read_only": "0", "license": "Apache-2.0",
}
_EMPTY_SHOWS = {
    "warnings": "Level string, Code int, Message string", "errors": "Level string, Code int, Message string", "triggers": "Trigger string, Event string, Table string",
    "events": "Db string, Name string", "procedure status": "Db string, Name string", "function status": "Db string, Name string", "plugins": "Name string, Status string",
    "open tables": "Database string, Table string", "profiles": "Query_ID int, Duration double, Query string", "master status": "File string, Position long",
    "binary logs": "Log_name string, File_size long", "replica status": "Replica_IO_State string", "slave status": "Slave_IO_State string",
}


class Engine:
    def __init__(self, spark: SparkSession, sf_dir: str | None = None, home: str | None = None):
        self.spark, self.sf_dir, self._home = spark, sf_dir, home
        self.temporary: dict[str, dml.StoredTable] = {}
        self.views: dict[str, tuple[Query, tuple]] = {}
        self.stored: dict[str, dml.StoredTable] = {}
        self.dropped: set[str] = set()
        self.defaults: dict[str, dict] = {}
        self.variables, self.schema = dict(VARIABLES), "tessera"

    @property
    def home(self) -> str:
        """The folder of stored tables: given, or one of the session's own in the shared folder."""
        if self._home is None:
            self._home = f"{shared_folder(self.spark)}/tables-{uuid.uuid4().hex}"
        return self._home

    # -- lookup ------------------------------------------------------------------------------

    def run(self, sql: str, args: list | None = None) -> DataFrame:
        """One statement. Queries and SHOW give rows; changes of rows give ``affected_rows``; the rest an empty ``status``."""
        parsed = StatementParser(sql, args)
        tree = parsed.statement()
        if parsed.used != len(parsed.args):
            raise SqlError("more arguments than ?")
        if isinstance(tree, Query):
            return self.select(tree)
        return getattr(self, "_" + tree.kind.replace(" ", "_"))(tree)

    def select(self, q: Query) -> DataFrame:
        return Compiler(self).query(q)[0]

    def table(self, name: str) -> tuple[DataFrame, str | None]:
        """A table's rows and its integer key."""
        short = name.split(".")[-1].lower()
        if name.lower().startswith("information_schema."):
            return self.virtual(short), None
        if short in self.views:
            q, columns = self.views[short]
            df, names, _ = Compiler(self).query(q)
            return df.toDF(*(columns or names)), None
        store = self.temporary.get(short) or self.stored.get(short)
        if store is not None:
            return store.read(), store.primary_key[0] if len(store.primary_key) == 1 else None
        if self._given(short):
            return catalog.load(self.spark, self.sf_dir, short), catalog.PRIMARY_KEYS.get(short)
        if short not in self.dropped and self.spark.catalog.tableExists(short):
            return self.spark.table(short), None
        raise SqlError(f"unknown table {name}")

    def fields(self, name: str):
        """The fields of a table of the folder, without asking Spark; None for others."""
        short = name.split(".")[-1].lower()
        hidden = name.lower().startswith("information_schema.") or short in self.views or short in self.temporary or short in self.stored
        return catalog.fields(short) if not hidden and self._given(short) else None

    def steady(self, name: str) -> bool:
        """Whether a table's rows are the same each time that a query reads them; a view's may not be."""
        short = name.split(".")[-1].lower()
        hidden = name.lower().startswith("information_schema.") or short in self.views
        return not hidden and (short in self.temporary or short in self.stored or self._given(short))

    def _given(self, name: str) -> bool:
        return self.sf_dir is not None and name in catalog.COLUMNS and name not in self.dropped

    def exists(self, name: str) -> bool:
        return name in self.views or name in self.temporary or name in self.stored or self._given(name)

    def names(self) -> list[str]:
        given = [t for t in catalog.TABLES if self._given(t)]
        return sorted({*given, *self.stored})

    def variable(self, name: str):
        return self.variables.get(name.lower())

    def session_value(self, name: str):
        return {"database": self.schema, "schema": self.schema, "version": self.variables["version"], "connection_id": 1}.get(name, "tessera@localhost")

    def store(self, name: str) -> dml.StoredTable:
        """The table for a change; a Parquet table is copied first."""
        short = name.split(".")[-1].lower()
        if short in self.temporary or short in self.stored:
            return self.temporary.get(short) or self.stored[short]
        if not self._given(short):
            raise SqlError(f"unknown table {name}")
        df, key = self.table(short)
        made = dml.StoredTable(self.spark, f"{self.home}/{short}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), (key,) if key else ())
        made.write(df)
        self.stored[short] = made
        return made

    def _status(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "status string")

    def _affected(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "affected_rows long")

    # -- changes of rows ---------------------------------------------------------------------

    def _insert(self, s: Statement) -> DataFrame:
        store = self.store(s.table)
        have = store.read().schema
        columns = [c for c in (s.columns if s.columns is not None else have.names)]
        low = {n.lower(): n for n in have.names}
        if unknown := [c for c in columns if c.lower() not in low]:
            raise SqlError(f"unknown column {unknown[0]}")
        compiler, default = Compiler(self), self.defaults.get(s.table.split(".")[-1].lower(), {})
        values_of = lambda node: compiler.value(compiler.bind(node, Scope([])), Scope([]))
        fill = {n: values_of(default[n]) if n in default else F.lit(None) for n in have.names}
        if s.query is not None:
            df = compiler.query(s.query)[0]
            if len(df.columns) != len(columns):
                raise SqlError("the numbers of columns and values differ")
            new = df.toDF(*(f"v{i}" for i in range(len(columns))))
            of = {low[c.lower()]: F.col(f"v{i}") for i, c in enumerate(columns)}
            rows = new.select(*(self._fitted(of.get(f.name, fill[f.name]), f).alias(f.name) for f in have.fields))
            affected = None
        else:
            parts = []
            for row in s.rows:
                row = row if row or columns == [] else ()
                if len(row) != len(columns) and row:
                    raise SqlError("the numbers of columns and values differ")
                of = {low[c.lower()]: v for c, v in zip(columns, row, strict=False) if not isinstance(v, Default)}
                parts.append(F.struct(*(self._fitted(values_of(of[f.name]) if f.name in of else fill[f.name], f).alias(f.name) for f in have.fields)))
            place = next(n for n in (f"insert_{i}" for i in range(len(have) + 1)) if n not in low)
            rows = self.spark.range(1, numPartitions=1).select(F.posexplode(F.array(*parts)).alias(place, "insert_row")).select(place, "insert_row.*")
            affected = len(s.rows)
        if affected is None:
            affected = rows.count()
        store.insert(rows, F.col(place) if s.rows is not None else None)
        return self._affected(affected)

    @staticmethod
    def _fitted(value: Column, f) -> Column:
        if f.dataType.typeName() == "array":
            return F.when(value.isNotNull(), F.split(S.text(value), ";")).cast(f.dataType)
        return S.todate(value).cast(f.dataType) if kind_of(f.dataType) == "time" else value.cast(f.dataType)

    def _rows_for(self, store: dml.StoredTable, name: str, alias: str, s: Statement) -> tuple[DataFrame, DataFrame, Scope, Compiler]:
        """The table's rows with a row number that is written with them; the joined rows that a change is about."""
        keyed = store.numbered()
        compiler, scope = Compiler(self), Scope([])
        engine_table = self.table

        def table(other: str):
            return (keyed, None) if other.split(".")[-1].lower() == name else engine_table(other)

        compiler.engine = _With(self, table)
        df = compiler.source(s.source, scope)
        if s.where is not None:
            df = compiler.filtered(df, s.where, scope)
        number = scope.find(Col(dml.ROW_NUMBER, alias)).name
        if s.order:
            keys = [compiler._directed(compiler.value(compiler.bind(k.value, scope), scope), k) for k in s.order]
            df = df.orderBy(*keys, number)
        elif s.limit is not None:
            df = df.orderBy(number)
        if s.limit is not None:
            df = df.limit(s.limit)
        return keyed, df, scope, compiler

    @staticmethod
    def _target(source, target: str | None = None) -> Table:
        """The table that a change is about: the one named, else the first."""
        tables, todo = [], [source]
        while todo:
            node = todo.pop()
            if isinstance(node, Join):
                todo += [node.right, node.left]
            elif isinstance(node, Table):
                tables.append(node)
        for t in tables:
            if target is None or target.lower() in (t.alias.lower(), t.name.lower()):
                return t
        raise SqlError(f"unknown table {target}")

    @staticmethod
    def _plain(s: Statement, *values) -> bool:
        """Whether a change looks at its own row only: no join, limit or subquery."""
        return isinstance(s.source, Table) and s.limit is None and not any(inside(n, lambda x: isinstance(x, (Sub, Exists))) for n in (s.where, *values))

    def _plain_change(self, store: dml.StoredTable, at: Table, s: Statement) -> DataFrame:
        """One pass over the table, without numbering its rows."""
        compiler, scope = Compiler(self), Scope([])
        rows = store.read()
        names = rows.columns
        df = compiler._named(rows, at.alias, scope)
        hit = F.coalesce(compiler.condition(compiler.bind(s.where, scope), scope), F.lit(False))
        n = df.where(hit).count()
        if s.kind == "delete":
            store.write(df.where(~hit).toDF(*names))
            return self._affected(n)
        assignments = {}
        for name, node in s.assignments:
            found = scope.sources[0].columns.get(name.split(".")[-1].lower())
            if found is None:
                raise SqlError(f"unknown column {name}")
            f = rows.schema[found[0]]
            value = compiler.value(compiler.bind(node, scope), scope)
            cleared = isinstance(node, Lit) and node.value is None
            assignments[f.name] = None if cleared else self._fitted(value, f)
        store.write(dml.update(df, hit, assignments).toDF(*names))
        return self._affected(n)

    def _update(self, s: Statement) -> DataFrame:
        if s.where is None and s.limit is None:
            raise dml.MissingPredicate("mutation_missing_predicate")
        first = s.assignments[0][0].rpartition(".")[0] or None
        at = self._target(s.source, first)
        store = self.store(at.name)
        if self._plain(s, *(v for _, v in s.assignments)):
            return self._plain_change(store, at, s)
        keyed, df, scope, compiler = self._rows_for(store, at.name.split(".")[-1].lower(), at.alias, s)
        fields = {f.name.lower(): f for f in store.read().schema.fields}
        own = {c: scope.find(Col(c, at.alias)) for c in fields}
        new = {}
        for name, node in s.assignments:
            f = fields.get(name.split(".")[-1].lower())
            if f is None:
                raise SqlError(f"unknown column {name}")
            value = compiler.value(compiler.bind(node, scope), scope)
            if f.dataType.typeName() == "array" and not (isinstance(node, Lit) and node.value is None):
                value = F.array_union(F.coalesce(F.col(own[f.name.lower()].name), F.array().cast(f.dataType)), self._fitted(value, f))
            new[f.name] = self._fitted(value, f) if f.dataType.typeName() != "array" else value.cast(f.dataType)
        number = F.col(scope.find(Col(dml.ROW_NUMBER, at.alias)).name)
        changed = df.select(number.alias("n"), *(v.alias(f"new_{i}") for i, v in enumerate(new.values())))
        changed = changed.groupBy("n").agg(*(F.first(f"new_{i}").alias(f"new_{i}") for i in range(len(new))), F.lit(True).alias("hit"))
        both = keyed.join(changed, F.col(dml.ROW_NUMBER) == F.col("n"), "left")
        place = {c: f"new_{i}" for i, c in enumerate(new)}
        out = both.select(*(F.when(F.col("hit"), F.col(place[f.name])).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in place else F.col(f"`{f.name}`") for f in fields.values()))
        n = changed.count()
        store.write(out)
        return self._affected(n)

    def _delete(self, s: Statement) -> DataFrame:
        if s.where is None and s.limit is None:
            raise dml.MissingPredicate("mutation_missing_predicate")
        at = self._target(s.source, s.target)
        store = self.store(at.name)
        if self._plain(s):
            return self._plain_change(store, at, s)
        keyed, df, scope, _ = self._rows_for(store, at.name.split(".")[-1].lower(), at.alias, s)
        gone = df.select(F.col(scope.find(Col(dml.ROW_NUMBER, at.alias)).name).alias("n")).distinct()
        n = gone.count()
        store.write(keyed.join(gone, F.col(dml.ROW_NUMBER) == F.col("n"), "left_anti").drop(dml.ROW_NUMBER))
        return self._affected(n)

    def _truncate(self, s: Statement) -> DataFrame:
        self.store(s.table).truncate()
        return self._status("truncated")

    # -- tables and views --------------------------------------------------------------------

    def _create_table(self, s: Statement) -> DataFrame:
        name = s.name.split(".")[-1].lower()
        taken = name in self.temporary if s.temporary else name in self.stored or self._given(name) or name in self.views
        if taken:
            if s.absent or (s.query is None and s.like is None and s.columns is None and self._given(name)):
                return self._status("exists")
            raise SqlError(f"table {name} exists")
        rows = None
        if s.query is not None:
            rows, names, kinds = Compiler(self).query(s.query)
            if len({n.lower() for n in names}) < len(names):
                raise SqlError("two columns of one name")
            rows = rows.select(*(F.col(f"`{n}`").cast("string").alias(n) if k == "null" else F.col(f"`{n}`") for n, k in zip(names, kinds, strict=True)))
            fields, key = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields], s.key
        elif s.like is not None:
            like, found = self.table(s.like)
            fields, key = [(f.name, f.dataType.simpleString()) for f in like.schema.fields], (found,) if found else ()
        elif s.columns is not None:
            if not s.temporary:
                raise SqlError("columns are defined for temporary tables only; others come from a descriptor or AS SELECT")
            if unknown := [c[1] for c in s.columns if c[1] not in TYPES]:
                raise SqlError(f"unknown type {unknown[0]}")
            fields, key = [(c[0], TYPES[c[1]]) for c in s.columns], s.key
            self.defaults[name] = {c[0]: c[2] for c in s.columns if c[2] is not None}
        elif name in catalog.COLUMNS and self.sf_dir is not None:
            self.dropped.discard(name)
            return self._status("activated")
        else:
            raise SqlError(f"there is no descriptor of {name}")
        ddl = ", ".join(f"`{n}` {t}" for n, t in fields)
        made = dml.StoredTable(self.spark, f"{self.home}/{'tmp-' + uuid.uuid4().hex + '-' if s.temporary else uuid.uuid4().hex + '-'}{name}", ddl, tuple(key))
        made.write(rows if rows is not None else self.spark.createDataFrame([], ddl))
        (self.temporary if s.temporary else self.stored)[name] = made
        return self._status("created")

    def _drop_table(self, s: Statement) -> DataFrame:
        for name in (n.split(".")[-1].lower() for n in s.names):
            if name in self.temporary:
                self.temporary.pop(name).remove()
            elif s.temporary or not (name in self.stored or self._given(name)):
                if not s.absent:
                    raise SqlError(f"unknown table {name}")
            else:
                if name in self.stored:
                    self.stored.pop(name).remove()
                self.dropped.add(name)
        return self._status("dropped")

    def _create_view(self, s: Statement) -> DataFrame:
        name = s.name.split(".")[-1].lower()
        if not s.replace and self.exists(name):
            raise SqlError(f"{name} exists")
        names = Compiler(self).query(s.query)[1]
        if s.columns and len(s.columns) != len(names):
            raise SqlError("the view has another number of columns")
        self.views[name] = (s.query, s.columns)
        return self._status("created")

    def _drop_view(self, s: Statement) -> DataFrame:
        if self.views.pop(s.name.split(".")[-1].lower(), None) is None and not s.absent:
            raise SqlError(f"unknown view {s.name}")
        return self._status("dropped")

    def _add_column(self, s: Statement) -> DataFrame:
        if s.type not in TYPES:
            raise SqlError(f"unknown type {s.type}")
        store = self.store(s.table)
        if s.name.lower() in (n.lower() for n in store.read().columns):
            raise SqlError(f"column {s.name} exists")
        store.add_column(s.name, TYPES[s.type])
        if s.default is not None:
            self.defaults.setdefault(s.table.split(".")[-1].lower(), {})[s.name] = s.default
        return self._status("added")

    def _add_key(self, s: Statement) -> DataFrame:
        store = self.store(s.table)
        if store.primary_key:
            raise SqlError("the table has a primary key")
        rows = store.read()
        if not rows.groupBy(*s.columns).count().where("count > 1").isEmpty():
            raise SqlError("the key is not unique")
        store.primary_key = tuple(s.columns)
        return self._status("added")

    # -- catalog and session -----------------------------------------------------------------

    def virtual(self, view: str) -> DataFrame:
        views = [(n, "select") for n in sorted(self.views)]
        schemas = {t: self.table(t)[0].schema for t in self.names()}
        keys = {t: k for t in schemas for k in [self.table(t)[1]] if k}
        return catalog.virtual_table(self.spark, view, schemas, keys, views, self.schema)

    def _explain(self, s: Statement) -> DataFrame:
        text = self.select(s.query)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        if s.json:
            return self.spark.createDataFrame([(json.dumps({"plan": text.splitlines()}),)], "EXPLAIN string")
        return self.spark.createDataFrame([(i + 1, line) for i, line in enumerate(text.splitlines()) if line.strip()], "id int, plan string")

    def _show(self, s: Statement) -> DataFrame:
        what = s.what
        made = self._shown(what, s)
        if s.like is not None:
            made = made.where(P.like(F.lower(F.col(f"`{made.columns[0]}`")), s.like.lower()))
        if s.where is not None:
            compiler, scope = Compiler(self), Scope([])
            names = made.columns
            made = compiler.filtered(compiler._named(made, "shown", scope), s.where, scope).toDF(*names)
        return made

    def _shown(self, what: str, s: Statement) -> DataFrame:
        frame = self.spark.createDataFrame
        if what == "tables":
            rows = [(n, "BASE TABLE") for n in self.names()] + [(n, "VIEW") for n in sorted(self.views)]
            name = f"Tables_in_{self.schema}"
            return frame(rows, f"`{name}` string, Table_type string") if s.full else frame([r[:1] for r in rows], f"`{name}` string")
        if what == "table status":
            return frame([(n, "Parquet", "utf8mb4_bin") for n in self.names()], "Name string, Engine string, Collation string")
        if what in ("columns", "fields"):
            df, key = self.table(s.table)
            rows = [(f.name, _SQL_NAMES[kind_of(f.dataType)] if f.dataType.typeName() != "double" else "double", "NO" if f.name == key else "YES", "PRI" if f.name == key else "", None, "") for f in df.schema.fields]
            return frame(rows, "Field string, Type string, `Null` string, `Key` string, `Default` string, Extra string")
        if what in ("index", "indexes", "keys"):
            key = self.table(s.table)[1]
            rows = [(s.table, 0, "PRIMARY", 1, key)] if key else []
            return frame(rows, "`Table` string, Non_unique int, Key_name string, Seq_in_index int, Column_name string")
        if what == "create table":
            df, key = self.table(s.table)
            lines = [f"  `{f.name}` {_SQL_NAMES[kind_of(f.dataType)] if f.dataType.typeName() != 'double' else 'double'}" for f in df.schema.fields] + ([f"  PRIMARY KEY (`{key}`)"] if key else [])
            return frame([(s.table, f"CREATE TABLE `{s.table}` (\n" + ",\n".join(lines) + "\n)")], "`Table` string, `Create Table` string")
        if what == "create view":
            if s.table.lower() not in self.views:
                raise SqlError(f"unknown view {s.table}")
            return frame([(s.table, f"CREATE VIEW `{s.table}`")], "View string, `Create View` string")
        if what in ("databases", "schemas"):
            return frame([("information_schema",), (self.schema,)], "Database string")
        if what in ("create database", "create schema"):
            return frame([(s.table, f"CREATE DATABASE `{s.table}`")], "Database string, `Create Database` string")
        if what == "variables":
            return frame(sorted((k, str(v)) for k, v in self.variables.items()), "Variable_name string, Value string")
        if what == "status":
            return frame([("Threads_connected", "1"), ("Uptime", "1")], "Variable_name string, Value string")
        if what in ("engines", "storage engines"):
            return frame([("Parquet", "DEFAULT", "Columnar files")], "Engine string, Support string, Comment string")
        if what in ("character set", "charset"):
            return frame([("utf8mb4", "UTF-8 Unicode", "utf8mb4_bin", 4)], "Charset string, Description string, `Default collation` string, Maxlen int")
        if what == "collation":
            return frame([("utf8mb4_bin", "utf8mb4", 46)], "Collation string, Charset string, Id int")
        if what == "processlist":
            return frame([(1, "tessera", "localhost", self.schema, "Query")], "Id int, User string, Host string, db string, Command string")
        if what.startswith("grants"):
            return frame([("GRANT ALL PRIVILEGES ON *.* TO 'tessera'@'localhost'",)], "Grants string")
        if what == "privileges":
            return frame([("Select", "Tables", "To read rows")], "Privilege string, Context string, Comment string")
        if what in _EMPTY_SHOWS:
            return frame([], _EMPTY_SHOWS[what])
        raise SqlError(f"unknown SHOW {what}")

    def _use(self, s: Statement) -> DataFrame:
        if s.name.lower() not in (self.schema, "information_schema"):
            raise SqlError(f"unknown database {s.name}")
        return self._status("changed")

    def _set(self, s: Statement) -> DataFrame:
        for name, node in s.values:
            value = node.value if isinstance(node, Lit) else getattr(node, "name", None)
            self.variables[name] = {True: "1", False: "0"}.get(value, value) if isinstance(value, bool) else value
        return self._status("set")

    def _transaction(self, s: Statement) -> DataFrame:
        return self._status("accepted")


class _With:
    """An engine that reads one of its tables in another way."""

    def __init__(self, engine: Engine, table):
        self._engine, self.table = engine, table

    def fields(self, name: str):
        return None

    def __getattr__(self, name: str):
        return getattr(self._engine, name)

