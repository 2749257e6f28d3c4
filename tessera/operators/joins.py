"""Join operators with the engine's NULL rules. All are equi-joins that Spark plans itself (broadcast of a small
side, sort-merge with skew handling otherwise); NULL keys never match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relate(child: DataFrame, parent: DataFrame, foreign_key: str, primary_key: str, how: str = "inner") -> DataFrame:
    """Follow a relationship from child to parent."""
    return child.join(parent, child[foreign_key] == parent[primary_key], how)


def semi(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``(a, b) IN (SELECT x, y ...)``."""
    return left.join(right, _on(left, right, keys), "left_semi")


def anti(left: DataFrame, right: DataFrame, keys: dict[str, str], keep_null: bool = True) -> DataFrame:
    """``NOT IN (SELECT ...)``: NULLs on the right do not matter. ``keep_null=False`` drops rows with a NULL key first, as
    happens when the membership is the only predicate."""
    if not keep_null:
        for k in keys:
            left = left.where(F.col(k).isNotNull())
    return left.join(right, _on(left, right, keys), "left_anti")


def exists(left: DataFrame, right: DataFrame, condition: Column, negated: bool = False) -> DataFrame:
    """Correlated EXISTS with equality and further comparisons in ``condition``."""
    return left.join(right, condition, "left_anti" if negated else "left_semi")


def _on(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    on = F.lit(True)
    for a, b in keys.items():
        on = on & (left[a] == right[b])
    return on


#: Leading bits of the hash by which a value's rows are counted; only those with the bits where its sample ends are ordered.
HASH_BITS = 12


def stratified_sample(df: DataFrame, column: str, percent: float, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """``percent`` of the rows of each value of ``column`` (NULL is a value too), rounded down: those of the least salted hash of
    ``key`` (all columns by default). Identical rows are numbered and hashed apart, so the sample is the same in every run."""
    drawn = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key or df.columns), F.col("__i").cast("string"))
    drawn = drawn.withColumn("__hash", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")).withColumn("__range", F.shiftright("__hash", 60 - HASH_BITS))
    counts = drawn.groupBy(F.col(column).alias("__value"), F.col("__range").alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy("__value")
    counts = counts.withColumn("__take", F.floor(F.sum("__rows").over(whole) * F.lit(round(percent * 10_000)) / F.lit(1_000_000)))
    counts = counts.withColumn("__before", F.sum("__rows").over(whole.orderBy("__part")) - F.col("__rows")).where("__before < __take")
    near = drawn.join(counts, F.col(column).eqNullSafe(F.col("__value")) & (F.col("__range") == F.col("__part")))
    inner = near.where("__before + __rows <= __take")
    edge = near.where("__before + __rows > __take").withColumn("__rank", F.row_number().over(Window.partitionBy("__value").orderBy("__hash", *df.columns, "__i")))
    return inner.select(*df.columns).unionByName(edge.where("__before + __rank <= __take").select(*df.columns))
