"""Sharding by fixed virtual slots (DataFrame functions only).

Records hash into a fixed number of virtual slots (thousands, whatever the number of shards). The
bytes of each slot are summed before anything else moves, and a slot-to-shard map is drawn up from
those sums: the largest slot first, always to the shard with the least bytes so far. The map is a small table
with a version; rebalancing reads one version and writes the next with some slots edited, so a
record's shard is found from its slot and a map version alone.

The law of the result is ``bytes``: the shards' sizes are near equal. Everything that is gathered
into one row has at most ``n_slots`` entries; everything that follows the rows is partitioned by slot.

Defined results: a null text has size 1 (no bytes, plus one) and the CRC of the empty string; null
and repeated doc_ids are ordinary records (a slot is found from id, CRC and size together, so equal texts under different ids are
different records and need not share a shard: the law is about sizes); an empty table
gives an empty result and an empty map; other columns of the input, whatever they are called, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, text_of

N_SLOTS = 4096


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every record."""
    sized = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of()).cast("long").alias("text_crc32"),
    )
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int")
    return sized.withColumn("virtual_slot", slot)


def slot_sizes(recs: DataFrame) -> DataFrame:
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def slot_map(sizes: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """The first map: slots by falling bytes, each to the shard that has the least bytes."""
    step = f"""
        transform(array(array_position(s.load, array_min(s.load))), to -> named_struct(
            'load', transform(s.load, (l, i) -> l + if(i + 1 = to, x.bytes, 0L)),
            'out', array_append(s.out, named_struct('virtual_slot', x.virtual_slot, 'shard', int(to - 1), 'bytes', x.bytes, 'rows', x.rows))
        ))[0]"""
    placed = f"""aggregate(
        slots,
        named_struct('load', array_repeat(0L, {n_shards}), 'out', cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint>>)),
        (s, x) -> {step},
        s -> s.out)"""
    return (
        _in_one_row(sizes, "bytes", "virtual_slot", "rows")
        .select(F.explode(F.expr(placed)).alias("e"))
        .select("e.virtual_slot", "e.shard", "e.bytes", "e.rows", F.lit(version).alias("version"))
    )


def _in_one_row(sizes: DataFrame, *cols: str) -> DataFrame:
    """At most n_slots entries, largest first."""
    one = sizes.agg(F.sort_array(F.collect_list(F.struct(*cols)), asc=False).alias("slots"))
    return one


def rebalance(current: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map for one more shard: slots move to the new shard only, largest first,
    while their old shard keeps its even share and the new one stays within it."""
    step = """
        transform(array(s.load[x.shard] - x.bytes >= floor(t * (1D - 1D / size(s.load))) and s.new + x.bytes <= t), moves -> named_struct(
            'load', transform(s.load, (l, i) -> l - if(moves and i = x.shard, x.bytes, 0L)),
            'new', s.new + if(moves, x.bytes, 0L),
            'out', array_append(s.out, named_struct('virtual_slot', x.virtual_slot, 'shard', if(moves, NEW, x.shard), 'bytes', x.bytes, 'rows', x.rows, 'version', x.version + 1))
        ))[0]"""
    moved = f"""aggregate(
        slots,
        named_struct('load', transform(sequence(0, NEW - 1), k -> aggregate(filter(slots, y -> y.shard = k), 0L, (a, y) -> a + y.bytes)), 'new', 0L,
                     'out', cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint,version:int>>)),
        (s, x) -> {step},
        s -> s.out)""".replace("NEW", str(n_shards - 1))
    one = _in_one_row(current, "bytes", "virtual_slot", "shard", "rows", "version")
    total = "ceil(aggregate(slots, 0L, (a, y) -> a + y.bytes) / NEW)".replace("NEW", str(n_shards))
    return one.select("slots", F.expr(total).alias("t")).select(F.explode(F.expr(moved)).alias("e")).select("e.virtual_slot", "e.shard", "e.bytes", "e.rows", "e.version")


def place(recs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Shard, and gapless place in the shard, of every record. The places of a virtual slot follow those
    of the shard's lower slots, so only slots are ranked, never a whole shard."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = mapping.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = recs.withColumn("rank", F.row_number().over(within) - 1)
    # The map has at most n_slots rows.
    return ranked.join(F.broadcast(bases), "virtual_slot").withColumn("slot", F.col("base") + F.col("rank")).drop("base", "rank")


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS) -> tuple[DataFrame, str]:
    """Every record with its virtual slot, shard and place, and the folder of the stored map's versions."""
    recs = cut(records(docs, n_slots), "records")
    path = new_path(docs.sparkSession, "slot-map")
    slot_map(slot_sizes(recs), n_shards).write.partitionBy("version").parquet(path)
    return place(recs, read_map(docs.sparkSession, path, 1)), path


def read_map(spark, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, bytes long, rows long, version int").parquet(path).where(F.col("version") == version)


def add_shard(spark, path: str, version: int, n_shards: int) -> None:
    """Write version + 1 of a stored map, for n_shards shards in place of n_shards - 1."""
    rebalance(read_map(spark, path, version), n_shards).write.mode("append").partitionBy("version").parquet(path)
