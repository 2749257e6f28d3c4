"""INSERT, upsert, UPDATE, DELETE and TRUNCATE as rewrites of versioned Parquet tables.

A table is a folder with one folder for each version; a writer makes the next version and readers read the newest that is
complete (Spark's ``_SUCCESS``), so a lost task or a failed writer leaves the table as it was. There are no transactions beyond that.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The column of ``StoredTable.numbered``.
ROW_NUMBER = "tessera_row"


class MissingPredicate(ValueError):
    """UPDATE or DELETE without WHERE (and without LIMIT) is refused."""


class StoredTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, primary_key: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.primary_key = spark, path.rstrip("/"), schema, primary_key
        self._spent: list[str] = []

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath() for s in fs.listStatus(at)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def version(self) -> int:
        return max(self._versions(), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        return self.spark.createDataFrame([], self.schema) if at < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{at}")

    def write(self, df: DataFrame) -> int:
        at = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{at}")
        while self._spent:
            self._delete(self._spent.pop())
        return at

    def insert(self, rows: DataFrame, order: Column | None = None) -> int:
        """Rows with a known primary key replace the old ones, as REPLACE and ON DUPLICATE KEY UPDATE do; of new rows with one
        key the last (by ``order``, else as they come) stays."""
        old = self.read()
        if self.primary_key:
            return self.write(upsert(old, rows, self.primary_key, order))
        return self.write(old.unionByName(rows.select(*(c for c in old.columns if c in rows.columns)), allowMissingColumns=True))

    def numbered(self) -> DataFrame:
        """The rows with a unique number, written so that every use sees the same numbers; the next version that is written
        takes their place."""
        at = f"{self.path}/numbered-{uuid.uuid4().hex}"
        rows = self.read().withColumn(ROW_NUMBER, F.monotonically_increasing_id())
        rows.write.parquet(at)
        self._spent.append(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def remove(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def update(self, predicate: Column | None, assignments: dict[str, Column]) -> int:
        return self.write(update(self.read(), predicate, assignments))

    def delete(self, predicate: Column | None, limit: int | None = None, order: list[Column] | None = None) -> int:
        return self.write(delete(self.read(), predicate, limit, order))

    def truncate(self) -> int:
        return self.write(self.read().limit(0))

    def add_column(self, name: str, kind: str) -> None:
        """Old rows read as NULL: Parquet readers fill columns that a file lacks."""
        self.schema = f"{self.schema}, {name} {kind}"


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...], order: Column | None = None) -> DataFrame:
    """Old rows whose key is not in ``new``, and of ``new`` the last row (by ``order``, else by place) of each key."""
    columns = old.columns
    rest = [c for c in columns if c not in key]
    place = order if order is not None else F.monotonically_increasing_id()
    value = lambda c: F.col(f"`{c}`") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
    aligned = new.select(*(F.col(f"`{k}`") for k in key), F.struct(place.alias("place"), *(value(c).alias(c) for c in rest)).alias("upsert_row"))
    latest = aligned.groupBy(*key).agg(F.max_by("upsert_row", "upsert_row.place").alias("upsert_row"))
    latest = latest.select(*(F.col(f"`{c}`") if c in key else F.col(f"upsert_row.`{c}`").alias(c) for c in columns))
    return old.join(new.select(*key).distinct(), list(key), "left_anti").select(*(f"`{c}`" for c in columns)).unionByName(latest)


def update(df: DataFrame, predicate: Column | None, assignments: dict[str, Column]) -> DataFrame:
    """Assignments see the old values. A set-valued column gains what is assigned; NULL clears it."""
    if predicate is None:
        raise MissingPredicate("mutation_missing_predicate")
    hit = F.coalesce(predicate, F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    new = {}
    for name, value in assignments.items():
        if kinds[name].typeName() == "array" and value is not None:
            value = F.array_union(F.coalesce(F.col(name), F.array().cast(kinds[name])), value)
        value = F.lit(None) if value is None else value
        new[name] = F.when(hit, value.cast(kinds[name])).otherwise(F.col(name))
    return df.select(*(new.get(c, F.col(c)).alias(c) for c in df.columns))


def delete(df: DataFrame, predicate: Column | None, limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """With ``limit``, of the rows that match only the first in ``order`` (all columns by default)."""
    if predicate is None and limit is None:
        raise MissingPredicate("mutation_missing_predicate")
    hit = F.coalesce(predicate, F.lit(False)) if predicate is not None else F.lit(True)
    if limit is None:
        return df.where(~hit)
    # The rows to go by their values, and how many of each; equal rows are numbered, so that only so many go.
    columns = [F.col(f"`{c}`") for c in df.columns]
    doomed = df.where(hit).orderBy(*(order or columns), *columns).limit(limit).groupBy(*columns).agg(F.count(F.lit(1)).alias("doomed_n"))
    doomed = doomed.toDF(*(f"doomed_{i}" for i in range(len(columns))), "doomed_n")
    same = reduce(lambda a, b: a & b, (c.eqNullSafe(F.col(f"doomed_{i}")) for i, c in enumerate(columns)))
    nth = F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(1)))
    some = df.join(doomed, same).withColumn("doomed_nth", nth).where("doomed_nth > doomed_n").select(*columns)
    return df.join(doomed, same, "left_anti").unionByName(some)


def union_all(*branches: DataFrame) -> DataFrame:
    """Columns by position, named by the first branch."""
    return reduce(lambda a, b: a.union(b), branches)
