"""Shared helpers of the training-data operators.

Intermediate results are cut from their lineage by writing Parquet to the folder that the cluster
names in ``spark.checkpoint.dir``; every executor can read it again after another one is lost.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class body and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a temporary one only in a local session that names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later uses do not compute it again. ``spent`` results of
    earlier cuts, which nothing needs any more once this one is written, are deleted."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    for old in spent:
        remove(df.sparkSession, old._cut_path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores added until the input has none of them (names differ by more than case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of a sieve: at most SIEVE / 64 words at any scale, which is what makes them fit for a broadcast (8 MB of bits).
SIEVE = 1 << 25


def sieve(keys: DataFrame) -> DataFrame:
    """A bitmap of the places (modulo SIEVE) of the ``key`` longs, as rows (word, bits): a Bloom filter of one hash."""
    place = F.pmod(F.col("key"), F.lit(SIEVE))
    return keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))


def sift(df: DataFrame, key: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among the sieve's, and rows whose key is not; a broadcast join, no shuffle of ``df``."""
    word, bits = free_names(df, "sieve_word", "sieve_bits")
    place = F.pmod(F.col(key), F.lit(SIEVE))
    found = df.withColumn(word, F.shiftright(place, 6)).join(F.broadcast(bitmap.select(F.col("word").alias(word), F.col("bits").alias(bits))), word, "left")
    hit = F.call_function("getbit", F.coalesce(F.col(bits), F.lit(0).cast("long")), place.bitwiseAND(F.lit(63)).cast("int")) == 1
    return found.where(hit).select(*df.columns), found.where(~hit).select(*df.columns)


def settled(docs: DataFrame, key: Column, marks: dict[str, Column], doubtful: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``doubtful`` lists (key, marks, stays) as not staying, and with one each of those that it
    lists as staying. Rows whose key is not in the sieve of the list's keys stay without having been shuffled; ``marks`` say
    exactly which row it is and are computed for the others alone."""
    own = free_names(docs, "row_key")[0]
    hits, clear = sift(docs.withColumn(own, key), own, sieve(doubtful))
    mine = dict(zip(marks, free_names(hits, *(f"row_{m}" for m in marks)), strict=True))
    hits = hits.withColumns({mine[m]: c for m, c in marks.items()})
    of = dict(zip(["key", *marks], free_names(hits, "of_key", *(f"of_{m}" for m in marks)), strict=True))
    named = lambda rows: rows.select(*(F.col(c).alias(n) for c, n in of.items()))
    same = F.col(own) == F.col(of["key"])
    for m in marks:
        same = same & F.col(mine[m]).eqNullSafe(F.col(of[m]))
    out = clear.select(*docs.columns).unionByName(hits.join(named(doubtful), same, "left_anti").select(*docs.columns))
    again = doubtful.where("stays")
    if not again.isEmpty():
        one = hits.join(named(again), same, "left_semi").dropDuplicates([own, *mine.values()])
        out = out.unionByName(one.select(*docs.columns))
    return out


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A hash of the columns as a double in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


# ---------------------------------------------------------------------------------------------
# Vectorised word and shingle hashing for Arrow batches (numpy; no Python loop over words).

_MUL = np.uint64(0x9E3779B97F4A7C15)
_POLY = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_POLY_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _POLY), np.full(size, _POLY_INV)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """64-bit hashes of the words of one text, given as its UTF-8 bytes (uint8); after them, for each length in
    ``prefixes``, those of the beginnings of so many bytes of the longer words."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    edge = np.diff(np.concatenate(([True], _IS_SPACE[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * down[starts]
    out = [mix64(value + (ends - starts).astype(np.uint64) * _MUL)]
    for n in prefixes:
        at = starts[ends - starts > n]
        out.append(mix64((prefix[at + n] - prefix[at]) * down[at] ^ np.uint64(n)))
    return np.concatenate(out) if prefixes else out[0]


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the runs of ``k`` words; a shorter text that has words is one shingle."""
    if not len(words):
        return words
    k_own = min(k, len(words))
    n = len(words) - k_own + 1
    out = np.full(n, np.uint64(k_own), dtype=np.uint64)
    for j in range(k_own):
        out = (out ^ words[j : j + n]) * _MUL
        out ^= out >> np.uint64(29)
    return mix64(out)


def text_bytes(value: str | None) -> np.ndarray:
    return np.frombuffer((value or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
