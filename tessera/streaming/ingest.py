"""Ingest of JSON events into tables: envelope, routing, nested children, references, defaults, upsert.

The same functions serve a batch DataFrame and each micro-batch of a stream (``foreachBatch``), so both load the same rows.
A stream is as safe as its checkpoint: a batch that is run again upserts the same keys. Everything is column
expressions and joins; payload fields shadow envelope fields in selectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.dml import StoredTable

ENVELOPE = "mode string, event_id string, source string, event_time timestamp, source_offset string, shard_key string, headers map<string,string>, payload string"


@dataclass(frozen=True)
class Child:
    """An array in the payload whose elements are rows of another table, with the parent's key as ``foreign_key``."""

    path: str
    table: str
    foreign_key: str


@dataclass(frozen=True)
class Target:
    """A table that events go to: payload type (DDL), selector over payload and envelope (SQL), key, defaults, references."""

    table: str
    payload: str
    selector: str
    key: tuple[str, ...]
    defaults: dict[str, str] = field(default_factory=dict)  # field -> SQL expression
    required: tuple[str, ...] = ()
    children: tuple[Child, ...] = ()
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)  # foreign key -> (table, key)
    mappers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def normalise(raw: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes from JSON texts: an object, an array of them, or one with ``events`` or ``records``. An object without
    ``payload`` is a payload itself. Texts that are no JSON come out with a NULL payload."""
    t = F.trim(F.col(column))
    many = F.when(t.startswith("["), t).otherwise(F.coalesce(F.get_json_object(t, "$.events"), F.get_json_object(t, "$.records"), F.concat(F.lit("["), t, F.lit("]"))))
    one = raw.select(F.explode_outer(F.from_json(many, "array<string>")).alias("e"))
    shape = F.from_json("e", ENVELOPE)
    fields = [f.split()[0] for f in ENVELOPE.split(", ")]
    return one.select(shape.alias("v"), "e").select(*(F.col(f"v.{f}").alias(f) for f in fields if f != "payload"), F.coalesce("v.payload", "e").alias("payload"))


def shard_key(primary: Column) -> Column:
    """Explicit, else from source and event id, else the primary key."""
    return F.coalesce("shard_key", F.when(F.col("source").isNotNull() & F.col("event_id").isNotNull(), F.concat_ws(":", "source", "event_id")), primary)


def route(envelopes: DataFrame, targets: list[Target]) -> DataFrame:
    """``target``: the first table whose selector holds; NULL for rejected events."""
    choice = None
    for t in targets:
        hit = _shadowed(t)
        choice = F.when(hit, t.table) if choice is None else choice.when(hit, t.table)
    return envelopes.withColumn("target", choice)


def _shadowed(t: Target) -> Column:
    """The selector with ``{name}`` for a payload field that shadows the envelope field of that name."""
    import re

    envelope = {f.split()[0] for f in ENVELOPE.split(", ")}
    fill = lambda m: f"coalesce(get_json_object(payload, '$.{m[1]}'), {f'cast({m[1]} AS string)' if m[1] in envelope else 'NULL'})"
    return F.coalesce(F.expr(re.sub(r"\{([\w.]+)\}", fill, t.selector)), F.lit(False))


def rows_of(routed: DataFrame, t: Target) -> DataFrame:
    """Typed rows of one table's events, with mappers and defaults applied, and the event they came with."""
    own = routed.where(F.col("target") == t.table).select(F.from_json("payload", t.payload).alias("p"), "event_id", "source", "event_time", F.col("payload").alias("event_payload"))
    own = own.select("p.*", "event_id", "source", "event_time", "event_payload")
    for name, mapper in t.mappers.items():
        own = own.withColumn(name, mapper(F.col(name)))
    for name, default in t.defaults.items():
        own = own.withColumn(name, F.coalesce(F.col(name), F.expr(default)))
    return own


def expand(rows: DataFrame, t: Target, child: Child) -> DataFrame:
    """Child rows from a nested array, with the parent's key."""
    parent = F.col(t.key[0]).alias(child.foreign_key)
    return rows.select(parent, F.explode(child.path).alias("c")).select(child.foreign_key, "c.*")


def check_parents(rows: DataFrame, t: Target, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows whose references exist (NULL references do not count), and the rest. References to tables that are not given
    are not checked."""
    checked, missing = rows, F.lit(False)
    for i, (fk, (table, key)) in enumerate(t.parents.items()):
        if table in tables:
            known = tables[table].select(F.col(key).alias(f"parent_{i}")).where(F.col(f"parent_{i}").isNotNull()).distinct()
            checked = checked.join(known, F.col(fk) == F.col(f"parent_{i}"), "left")
            missing = missing | (F.col(fk).isNotNull() & F.col(f"parent_{i}").isNull())
    return checked.where(~missing).select(*rows.columns), checked.where(missing).select(*rows.columns)


def classify_duplicates(envelopes: DataFrame) -> DataFrame:
    """One row per (source, event_id): new (once), duplicate (the same payload again) or conflict (another payload)."""
    seen = envelopes.groupBy("source", "event_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.sha2("payload", 256)).alias("payloads"))
    kind = F.when(F.col("payloads") > 1, "conflict").when(F.col("n") > 1, "duplicate").otherwise("new")
    return seen.select("source", "event_id", "n", kind.alias("kind"))


EVENT = ("event_id", "source", "event_time", "event_payload")
REJECTS = "target string, reason string, event_id string, source string, payload string"


def accepted(envelopes: DataFrame, targets: list[Target], known: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables' new rows from a batch of envelopes, and the rejected events with the reason: no table wants it, a required or key
    field is missing, or a parent is unknown (neither in ``known`` nor new in this batch). Later events (by time,
    then id) win over earlier ones of one key, with their children: those of superseded events are not loaded. Rows of a
    table that come directly and nested are put together."""
    routed, out, known = route(envelopes, targets), {}, dict(known or {})
    told = lambda rows, table, why: rows.select(
        F.lit(table).cast("string").alias("target"), F.lit(why).alias("reason"), "event_id", "source", F.col("event_payload").alias("payload")
    )
    rejects = told(routed.where(F.col("target").isNull()).withColumn("event_payload", F.col("payload")), None, "no table")

    def add(table: str, rows: DataFrame) -> None:
        out[table] = out[table].unionByName(rows, allowMissingColumns=True) if table in out else rows

    for t in targets:
        rows = rows_of(routed, t)
        lacking = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in (*t.required, *t.key)), F.lit(False))
        rejects = rejects.unionByName(told(rows.where(lacking), t.table, "missing field"))
        parents = {table: known[table].unionByName(out[table], allowMissingColumns=True) if table in out and table in known else known.get(table, out.get(table)) for table, _ in t.parents.values() if table in known or table in out}
        good, orphans = check_parents(rows.where(~lacking), t, parents)
        rejects = rejects.unionByName(told(orphans, t.table, "unknown parent"))
        order = F.struct(F.coalesce("event_time", F.lit("1970-01-01").cast("timestamp")), F.coalesce("event_id", F.lit("")))
        won = good.groupBy(*t.key).agg(F.max_by(F.struct(*(c for c in good.columns if c not in t.key)), order).alias("won_row"))
        won = won.select(*(F.col(c) if c in t.key else F.col(f"won_row.{c}").alias(c) for c in good.columns))
        add(t.table, won.drop(*EVENT, *(c.path for c in t.children)))
        for c in t.children:
            add(c.table, expand(won, t, c))
    return out, rejects


def tables_of(envelopes: DataFrame, targets: list[Target], known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The new rows of ``accepted``."""
    return accepted(envelopes, targets, known)[0]


def load_batch(envelopes: DataFrame, targets: list[Target], stores: dict[str, StoredTable], rejects: StoredTable | None = None) -> None:
    """Upsert a batch into the stored tables; a batch that comes later overwrites. Parents are looked up in the stores."""
    parents = {table for t in targets for table, _ in t.parents.values()}
    out, refused = accepted(envelopes, targets, {name: stores[name].read() for name in parents if name in stores})
    if rejects is not None:
        rejects.insert(refused)
    for name, rows in out.items():
        stores[name].insert(rows)


def load_stream(spark: SparkSession, folder: str, checkpoint: str, targets: list[Target], stores: dict[str, StoredTable], rejects: StoredTable | None = None) -> StreamingQuery:
    """Load every file of JSON lines that has arrived in ``folder`` and stop; run again for what comes later."""

    def put(batch: DataFrame, number: int) -> None:
        load_batch(normalise(batch), targets, stores, rejects)

    lines = spark.readStream.format("text").load(folder)
    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extension beyond table loading: events in tumbling windows, with a watermark on streams."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks are on instants
    stamped = stamped.withWatermark("ts", late) if events.isStreaming else stamped
    counted = stamped.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast(events.schema["ts"].dataType).alias("start"), "event_type", "n")
