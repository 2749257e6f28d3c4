"""File sources and sinks beyond the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tbl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pipe-delimited dbgen files; a bar at the end of the line is no column."""
    return spark.read.csv(path, sep="|", schema=schema, mode="PERMISSIVE", timestampFormat="yyyy-MM-dd")


def read_json_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as texts, for ``streaming.ingest.normalise``."""
    return spark.read.text(path)


def write_partitioned(df: DataFrame, path: str, time_field: str, quantum: str = "YMD") -> None:
    """Parquet partitioned by day (YMD) or hour (YMDH) in UTC; rows of one partition are written by few tasks."""
    unit = {"YMD": "day", "YMDH": "hour"}[quantum]
    keyed = df.withColumn("quantum", F.date_format(F.date_trunc(unit, F.col(time_field)), "yyyy-MM-dd" if unit == "day" else "yyyy-MM-dd-HH"))
    keyed.hint("rebalance", "quantum").write.mode("overwrite").partitionBy("quantum").parquet(path)


def read_partitioned(spark: SparkSession, path: str, time_field: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Rows with ``low <= time < high``; the same bounds prune partitions."""
    df = spark.read.parquet(path)
    if low:
        df = df.where((F.col("quantum") >= F.lit(low[:10])) & (F.col(time_field) >= F.lit(low).cast("timestamp_ntz")))
    if high:  # partition names compare as texts; one that starts with the bound's own day may hold rows
        df = df.where((F.substring("quantum", 1, 10) <= F.lit(high[:10])) & (F.col(time_field) < F.lit(high).cast("timestamp_ntz")))
    return df.drop("quantum")


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """Partition names and rows."""
    return spark.read.parquet(path).groupBy(F.col("quantum").cast("string").alias("quantum")).agg(F.count(F.lit(1)).alias("n"))


def drop_partitions_before(spark: SparkSession, path: str, quantum: str) -> list[str]:
    """Delete the partitions older than ``quantum``; their names."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("quantum=") and name.removeprefix("quantum=") < quantum:
            fs.delete(s.getPath(), True)
            gone.append(name.removeprefix("quantum="))
    return sorted(gone)


#: Avro types of Spark types.
_AVRO = {"string": "string", "bigint": "long", "int": "long", "double": "double", "float": "double", "boolean": "boolean"}


def avro_schema(name: str, schema: T.StructType) -> dict:
    """A record schema for a table's columns; times are longs."""
    kinds = [(f.name, {"type": "long", "logicalType": "date"} if f.dataType.typeName() == "date" else _AVRO.get(f.dataType.simpleString(), "long" if "timestamp" in f.dataType.simpleString() else "string")) for f in schema.fields]
    return {"type": "record", "name": name, "fields": [{"name": n, "type": ["null", k]} for n, k in kinds]}
