"""Exact deduplication by stateful streaming.

Each arriving row is reduced to a digest of its normalised text, a stable identifier, a content
locator and an arrival number; a streaming query keeps one state row per digest in RocksDB (on disk, without watermark, so
nothing expires): the best row so far (identifier and locator) and the number of arrivals. Its log of arrivals,
checkpoint and sink are in one folder, ``home``, on the shared store; a micro-batch takes ``BATCH_BYTES`` of new log files and writes a
folder of its own by number, so ``absorb`` carries on with the same home: after a restart, or when more documents come.

A hit on a digest is not trusted: the full normalised bytes of every row whose digest occurred more than
once are compared with those at the keeper's locator, and rows that differ leave the group for groups of
their own by full text.

Texts are equal when identical after deleting white space. Of equal texts the row with the most code
points in the original text stays, then the smallest doc_id, then (rows repeated with the same id) one of them: exactly
one row of a group is kept.

Hot digests are salted: their rows are dealt over ``ceil(rows / SALT_ROWS)`` parts and the one state row is
repeated for each part. Texts move only where a sieve (see ``common``) says that their digest may have occurred again.

Defined results: null text counts as empty, and empty texts are copies of each other; null doc_ids sort
after all others; an empty table gives an empty result; other columns, whatever their names, are carried by
``deduplicate`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, new_path, settled, sieve, sift, text_of

SALT_ROWS = 2000
#: Log files of so many bytes, one file at least, make a micro-batch.
BATCH_BYTES = 256 << 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Without it every state partition sets aside several MB of disk, whatever it holds.
_ALLOCATE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What the stream reads of each row: digest, identifier, length, the locator of its content
    (identifier, length in bytes and CRC of the original text, and a hash of identifier and text) and an arrival number."""
    norm = normalised(text_of())
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(norm).alias("digest"),
        sha256(norm).alias("text_sha256"),
        F.char_length(text_of()).cast("long").alias("code_points"),
        F.crc32(text_of()).cast("long").alias("crc"),
        _row_key().alias("key"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _better() -> Column:
    """Smallest is best: most code points, then the smallest doc_id (null last); of the same id and text any one."""
    return F.struct(
        (-F.col("code_points")).alias("neg_points"),
        F.col("doc_id").isNull().alias("no_id"),
        F.col("doc_id").alias("doc_id"),
        F.col("crc").alias("crc"),
        F.col("seq").alias("seq"),
    )


_KEPT = "digest string, best struct<neg_points:bigint,no_id:boolean,doc_id:bigint,crc:bigint,seq:bigint>, arrived bigint, batch int"


def keyed_state(log_path: str, schema, spark, home: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run the streaming query over what is new in ``log_path`` since the last run with this home; the latest state row of each digest."""
    home = home or new_path(spark, "state")
    out = f"{home}/batches"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    had = {k: spark.conf.get(k, None) for k in (_PROVIDER, _ALLOCATE)}
    spark.conf.set(_PROVIDER, ROCKSDB)
    spark.conf.set(_ALLOCATE, "false")
    try:
        query = (
            spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).option("recursiveFileLookup", "true").parquet(log_path)
            .groupBy("digest").agg(F.min(_better()).alias("best"), F.count(F.lit(1)).alias("arrived"))
            .writeStream.outputMode("update").foreachBatch(put)
            .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    try:
        seen = spark.read.schema(_KEPT).option("recursiveFileLookup", "true").parquet(out)
    except Exception as error:  # an empty stream has no batch and so no folder
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _KEPT).drop("batch")
    return seen.groupBy("digest").agg(F.max_by("best", "batch").alias("best"), F.max("arrived").alias("arrived"))


def absorb(docs: DataFrame, home: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Add ``docs`` to the log of ``home`` and bring its state up to date: digest, best row and arrivals over all that was
    ever absorbed there. Safe to run again after a failure: what is in the log is read once. Rows are told apart by
    arrival numbers that are unique within one call."""
    rows = arrivals(docs, digest)
    rows.write.mode("append").parquet(f"{home}/log")
    return keyed_state(f"{home}/log", rows.schema, docs.sparkSession, home, batch_bytes)


def _parts() -> Column:
    return F.ceil(F.col("arrived") / F.lit(SALT_ROWS)).cast("int")


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, code_points, crc, key."""
    spark = docs.sparkSession
    home = new_path(spark, "exact")
    state = cut(absorb(docs, home, digest, batch_bytes), "state")
    log = spark.read.parquet(f"{home}/log")

    # Rows meet their state row, in as many parts as the digest's size asks for.
    hot = cut(state.where(_parts() > 1).select("digest", _parts().alias("parts")), "hot")
    joined = _deal(log, hot).join(state.select("digest", "best", "arrived", F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("salt")), ["digest", "salt"])
    joined = cut(joined, "met")
    odd = _false_hits(docs, joined, state, hot, digest)
    if odd is None:
        return _verdicts(joined)
    true = joined.join(odd.select("seq"), "seq", "left_anti")
    lost = cut(odd.groupBy("digest").agg(F.count(F.lit(1)).alias("lost")), "lost")
    true = true.join(lost, "digest", "left").withColumn("arrived", F.col("arrived") - F.coalesce("lost", F.lit(0)))
    own = cut(odd.groupBy("norm").agg(F.min(_better()).alias("best"), F.count(F.lit(1)).alias("arrived")), "own")
    return _verdicts(true).unionByName(_verdicts(odd.drop("best", "arrived").join(own, "norm")))


def _deal(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Add the part of each row. A left join with the hot digests: they are few (at most rows / SALT_ROWS),
    and broadcast only if their counted number is small; else Spark splits the skewed partitions."""
    few = hot.count() <= 100_000
    with_parts = rows.join(F.broadcast(hot) if few else hot, "digest", "left")
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "crc", "seq"), F.col("parts"))).cast("int")
    return with_parts.withColumn("salt", salt).drop("parts")


def _verdicts(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("arrived").alias("group_size"), (F.col("seq") == F.col("best.seq")).alias("kept"),
        "text_sha256", "code_points", "crc", "key",
    )


def _false_hits(docs: DataFrame, joined: DataFrame, state: DataFrame, hot: DataFrame, digest: Callable[[Column], Column]) -> DataFrame | None:
    """Rows whose digest hit a keeper with other bytes, with their normalised text; None if there are none."""
    again = joined.where("arrived > 1")
    texts, _ = sift(docs.select(_row_key().alias("key"), text_of().alias("text")), "key", sieve(again))
    # One text for each key and digest: rows repeated with the same id and text have the same bytes.
    texts = texts.select("key", normalised(F.col("text")).alias("norm")).withColumn("text_sha256", sha256(F.col("norm")))
    texts = texts.groupBy("key", "text_sha256").agg(F.first("norm").alias("norm"))
    members = cut(again.join(texts, ["key", "text_sha256"]), "hits")
    keepers = members.where(F.col("seq") == F.col("best.seq")).select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("salt"))
    odd = members.join(keepers, ["digest", "salt"]).where(F.col("norm") != F.col("kept_norm")).drop("kept_norm", "salt")
    odd = cut(odd, "false-hits", members)
    return None if odd.isEmpty() else odd


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each group, with the columns of ``docs``."""
    seen = groups(docs).groupBy("key", "doc_id", "text_sha256", "code_points", "crc").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays"))
    doubtful = cut(seen.where("n > 1 or not stays").drop("n"), "doubtful")
    marks = {"doc_id": F.col("doc_id").cast("long"), "text_sha256": sha256(normalised(text_of())), "code_points": F.char_length(text_of()).cast("long"), "crc": F.crc32(text_of()).cast("long")}
    return settled(docs, _row_key(), marks, doubtful)
