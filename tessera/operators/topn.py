"""Top-n distribution profile of one column.

``topn_<field>``, ``topn_count``, ``topn_percent``: the n most frequent values (count descending, then text), a row `OTHER:`
for the rest if n cuts any off, and always a last row `TOTAL:`. NULLs are not counted anywhere; n = 0 keeps all values.

The values are counted once (partial counts before the shuffle); the total is the number of non-null fields, read without a
shuffle. With n the first n counts come from a distributed top-k and meet the total in one row of n entries; without it the
total is broadcast (one row). No task ever ranks all distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topn(df: DataFrame, column: str, n: int = 0) -> DataFrame:
    value, count, percent = f"topn_{column}", "topn_count", "topn_percent"
    c = F.col(f"`{column}`")
    counts = df.where(c.isNotNull()).groupBy(c.cast("string").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = df.agg(F.count(c).alias("total"))
    entry = lambda part, v, k: F.struct(F.lit(part).alias("part"), v.alias("v"), k.alias("c"))
    last = entry(2, F.lit("TOTAL:"), F.col("total"))
    if n > 0:
        kept = counts.orderBy(F.desc("c"), "v").limit(n).agg(F.collect_list(entry(0, F.col("v"), F.col("c"))).alias("kept"), F.coalesce(F.sum("c"), F.lit(0)).alias("most"))
        other = F.when(F.col("total") > F.col("most"), F.array(entry(1, F.lit("OTHER:"), F.col("total") - F.col("most")))).otherwise(F.slice(F.array(last), 1, 0))
        rows = kept.join(F.broadcast(total), F.lit(True)).select("total", F.explode(F.concat("kept", other, F.array(last))).alias("e")).select("total", "e.*")
    else:
        rows = counts.join(F.broadcast(total), F.lit(True)).select("total", F.lit(0).alias("part"), "v", "c").unionByName(total.select("total", F.explode(F.array(last)).alias("e")).select("total", "e.*"))
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("c") / F.col("total") * 100)
    return rows.orderBy("part", F.desc("c"), "v").select(F.col("v").alias(value), F.col("c").alias(count), share.alias(percent))
