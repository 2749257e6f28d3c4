"""Packing into optimal length buckets.

The lengths of all documents are counted in one global histogram. Dynamic programming over it chooses ``n_buckets``
upper boundaries that minimise the total padding when each document is padded to its bucket's boundary: with C
and S the counts and token sums of the lengths up to i, a bucket (i, j] pads ``len_j * (C_j - C_i) - (S_j - S_i)``, and
the best predecessor of each j is found on the lower envelope of lines of slope ``-C_i``, so a layer is linear in the
number of distinct lengths. Batches form inside each bucket: a batch has ``budget // boundary`` documents, so its padded
size stays within the token budget.

Buckets are for documents that fit the budget, which also bounds the histogram that the driver sees: at most
``budget`` rows, every length counted exactly. A longer document is a batch of its own, of its own length and without
padding, in one more bucket: the only batches over the budget, as documents are never cut.

Documents are numbered inside their bucket by counts of (bucket, part) and ranks within a part, never by ranking a whole bucket in
one task. The order is that of a hash of the row and of its number among equal rows, so copies of a document come
apart. Equal rows are numbered by counts of (row, input task) and ranks within one, so that a hot row is shared out.

The length, and so the budget, is in words: the number of words plus one for the end of the text. Defined results: a null or empty
text has length 1; null doc_ids and repeated rows are documents like others; an empty table gives an empty result; other columns,
whatever they are called, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, text_of

N_BUCKETS, BUDGET = 8, 16384
#: Parts that documents are numbered in: at least so many, and one for so many rows.
PARTS, PART_ROWS = 1024, 250_000


def n_tokens() -> Column:
    """Words of the text, and its end."""
    trimmed = F.regexp_replace(text_of(), f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")
    return F.when(trimmed == "", 1).otherwise(F.size(F.split(trimmed, f"[{SPACE_CLASS}]+")) + 1).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, n_buckets: int) -> list[int]:
    """Optimal upper boundaries, ascending; fewer if there are fewer distinct lengths. ``sums``: tokens of each class."""
    n = len(lengths)
    if not n:
        return []
    c = [0, *np.cumsum(counts).tolist()]
    s = [0, *np.cumsum(sums).tolist()]
    length = [0, *map(int, lengths)]
    best = [0] + [math.inf] * n  # padding of the first j classes with the buckets so far
    back: list[list[int]] = []
    for _ in range(min(n_buckets, n)):
        now, pick = [math.inf] * (n + 1), [0] * (n + 1)
        hull: list[int] = []  # candidates i by rising C_i; line: best_i + S_i - C_i * len_j
        head = 0
        value = lambda i, x: best[i] + s[i] - c[i] * x  # noqa: E731, B023
        for j in range(1, n + 1):
            i = j - 1
            if best[i] < math.inf:
                b = best[i] + s[i]
                while len(hull) - head >= 2:
                    p, q = hull[-2], hull[-1]
                    bp, bq = best[p] + s[p], best[q] + s[q]
                    if (b - bp) * (c[q] - c[p]) <= (bq - bp) * (c[i] - c[p]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
            x = length[j]
            while len(hull) - head >= 2 and value(hull[head + 1], x) <= value(hull[head], x):
                head += 1
            if len(hull) > head:
                pick[j] = hull[head]
                now[j] = x * c[j] - s[j] + value(hull[head], x)
        best = now
        back.append(pick)
    out, j = [], n
    for pick in reversed(back):
        out.append(length[j])
        j = pick[j]
    return out[::-1]


def optimal_buckets(sized: DataFrame, n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> list[int]:
    """Boundaries for a table with ``n_tokens``, from the histogram of all its rows that fit the budget."""
    histogram = sized.where(F.col("n_tokens") <= budget).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(histogram.collect())  # at most ``budget`` rows
    lengths, counts = np.array(rows, dtype=np.int64).reshape(-1, 2).T
    return boundaries(lengths, counts, lengths * counts, n_buckets)


def _numbered(sized: DataFrame) -> DataFrame:
    """``nth``: the number of each row among those with the same ``h``."""
    own = sized.groupBy("h", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    own = cut(own.select("h", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "repeats")
    inside = F.row_number().over(Window.partitionBy("h", "task").orderBy(F.lit(1))) - 1
    return sized.withColumn("nth", inside).join(own, ["h", "task"]).withColumn("nth", F.col("base") + F.col("nth")).drop("base", "task")


def pack(docs: DataFrame, n_buckets: int = N_BUCKETS, budget: int = BUDGET, seed: int = 2) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch (number within the bucket), place (in the batch) and padding."""
    sized = docs.select("doc_id", n_tokens().alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), F.spark_partition_id().alias("task"))
    sized = cut(sized, "lengths")
    bounds = optimal_buckets(sized, n_buckets, budget)
    upper, bucket = F.col("n_tokens"), F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        inside = F.col("n_tokens") <= bounds[i]
        upper, bucket = F.when(inside, bounds[i]).otherwise(upper), F.when(inside, i).otherwise(bucket)
    parts = max(PARTS, sized.count() // PART_ROWS)
    placed = _numbered(sized).withColumns({"bucket": bucket.cast("int"), "bucket_len": upper.cast("long"), "order": F.xxhash64("h", "nth")})
    placed = cut(placed.withColumn("part", F.pmod(F.xxhash64("order"), F.lit(parts)).cast("int")).drop("h", "nth"), "numbered", sized)
    # Rank = documents of the bucket in lower parts + rank within the part.
    sizes = cut(placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n")), "part-sizes")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(sizes.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases", sizes)
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("order", "doc_id")) - 1)
    ranked = ranked.join(bases, ["bucket", "part"]).withColumn("rank", F.col("base") + F.col("rank"))
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")).cast("long"))
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.floor(F.col("rank") / per).cast("long").alias("batch"), F.pmod("rank", per).cast("int").alias("place"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
