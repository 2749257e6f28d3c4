"""Changes of tables and ingest of events, each as the rows that result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import load
from tessera.operators import dml
from tessera.streaming import ingest

from .registry import query


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
          UNION ALL SELECT c_custkey + 1000000, 'NEW', c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0""")
def dml_upsert(spark, sf_dir):
    old = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    again = old.where("c_custkey % 10 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return dml.upsert(old, again.unionByName(again.withColumn("c_custkey", F.col("c_custkey") + 1000000)), ("c_custkey",))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def dml_update(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return dml.update(o, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000), {"o_orderstatus": F.lit("X")}).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 50000 OR o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000 AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 5))")
def dml_delete(spark, sf_dir):
    left = dml.delete(load(spark, sf_dir, "orders"), F.col("o_totalprice") < 50000)
    return dml.delete(left, F.col("o_orderstatus") == "O", limit=5, order=[F.col("o_orderkey")]).select("o_orderkey")


ORDER_EVENTS = [
    ingest.Target(
        "orders", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, lineitems array<struct<l_linenumber:int,l_partkey:bigint,l_quantity:double>>",
        "{kind} = 'order'", ("o_orderkey",), defaults={"o_orderstatus": "'N'"}, children=(ingest.Child("lineitems", "lineitem", "l_orderkey"),), parents={"o_custkey": ("customer", "c_custkey")},
    ),
    ingest.Target("events", "event_key bigint, event_type string", "{kind} = 'event' and source = 'web'", ("event_key",)),
]


def order_envelopes(spark, sf_dir):
    """Orders with their lines, and some events, as JSON envelopes."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("lineitems"))
    o = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    customer = F.when(F.col("o_orderkey") % 11 == 0, -1).when(F.col("o_orderkey") % 11 != 1, F.col("o_custkey")).alias("o_custkey")  # unknown, none, known
    payload = F.struct(F.lit("order").alias("kind"), "o_orderkey", customer, status.alias("o_orderstatus"), "lineitems")
    orders = o.select(F.to_json(F.struct(F.lit("stream").alias("mode"), F.col("o_orderkey").cast("string").alias("event_id"), F.lit("shop").alias("source"), payload.alias("payload"))).alias("value"))
    e = load(spark, sf_dir, "events")
    payload = F.struct(F.lit("event").alias("kind"), F.col("event_id").alias("event_key"), "event_type")
    source = F.when(F.col("event_id") % 3 == 0, "web").otherwise("app")
    return orders.unionByName(e.select(F.to_json(F.struct(F.concat(F.lit("e"), "event_id").alias("event_id"), source.alias("source"), payload.alias("payload"))).alias("value")))


def _ingested(spark, sf_dir):
    return ingest.accepted(ingest.normalise(order_envelopes(spark, sf_dir)), ORDER_EVENTS, {"customer": load(spark, sf_dir, "customer")})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 1 THEN o_custkey END AS o_custkey, coalesce(nullif(o_orderstatus, 'P'), 'N') AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0
          AND (o_orderkey % 11 = 1 OR o_custkey IN (SELECT c_custkey FROM customer))""")
def ingest_parents(spark, sf_dir):
    return _ingested(spark, sf_dir)[0]["orders"]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0
          AND (o_orderkey % 11 = 1 OR o_custkey IN (SELECT c_custkey FROM customer)))""")
def ingest_children(spark, sf_dir):
    return _ingested(spark, sf_dir)[0]["lineitem"]


@query("""SELECT 'orders' AS target, 'unknown parent' AS reason, o_orderkey::VARCHAR AS event_id FROM orders WHERE o_orderkey % 11 = 0 OR (o_orderkey % 11 <> 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer))
          UNION ALL SELECT NULL, 'no table', 'e' || event_id FROM events WHERE event_id % 3 <> 0""")
def ingest_rejects(spark, sf_dir):
    return _ingested(spark, sf_dir)[1].select("target", "reason", "event_id")


@query("SELECT CASE WHEN k = 0 THEN 'orders' WHEN k = 1 THEN 'events' END AS target, count(*) AS n FROM (SELECT 0 AS k FROM orders UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 1 END FROM events) t GROUP BY k")
def ingest_routing(spark, sf_dir):
    routed = ingest.route(ingest.normalise(order_envelopes(spark, sf_dir)), ORDER_EVENTS)
    return routed.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source, event_id, n, kind FROM (SELECT 's' AS source, user_id::VARCHAR AS event_id, count(*) AS n,
          CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate' ELSE 'new' END AS kind FROM events GROUP BY user_id) t""")
def ingest_duplicates(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return ingest.classify_duplicates(e.select(F.lit("s").alias("source"), F.col("user_id").cast("string").alias("event_id"), F.col("event_type").alias("payload")))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def extension_windowed_counts(spark, sf_dir):
    return ingest.windowed_counts(load(spark, sf_dir, "events"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
