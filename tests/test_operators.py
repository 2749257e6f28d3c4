"""Operators: top-n, text search, table changes, dialect, catalog, files, ingest."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import dml, joins
from tessera.operators.textsearch import match_against, query_terms
from tessera.operators.topn import topn
from tessera.sources import files
from tessera.sqlfront import run_sql
from tessera.streaming import ingest

SF = "/root/testdata/sf0.001"


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_topn(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", "b", "d", None]], "v string")
    assert tuples(topn(df, "v")) == [("a", 2, 2 / 6 * 100), ("b", 2, 2 / 6 * 100), ("c", 1, 1 / 6 * 100), ("d", 1, 1 / 6 * 100), ("TOTAL:", 6, 100.0)]
    assert tuples(topn(df, "v", 1)) == [("a", 2, 2 / 6 * 100), ("OTHER:", 4, 4 / 6 * 100), ("TOTAL:", 6, 100.0)]
    assert tuples(topn(df, "v", 4))[-2:] == [("d", 1, 1 / 6 * 100), ("TOTAL:", 6, 100.0)]
    assert tuples(topn(df.limit(0), "v", 3)) == [("TOTAL:", 0, 0.0)] and topn(df, "v", 1).columns == ["topn_v", "topn_count", "topn_percent"]


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "The quick, brown FOX"), (2, "quickly foxes"), (3, None), (4, "fox-quick")], "id int, t string")
    assert [r.id for r in docs.where(match_against(F.col("t"), "the Quick fox")).collect()] == [1, 4]
    assert docs.where(match_against(F.col("t"), "the of")).count() == 0 and query_terms("The Café café!") == ["café"]
    docs.createOrReplaceTempView("search_docs")
    assert [r.id for r in run_sql(spark, None, "SELECT id FROM search_docs WHERE MATCH(t) AGAINST('quick fox' IN NATURAL LANGUAGE MODE)").collect()] == [1, 4]


def test_text_search_of_decomposed_texts(spark):
    docs = spark.createDataFrame([(1, "un cafe\u0301 noir"), (2, "un caf\u00e9 noir"), (3, "un cafe noir")], "id int, t string")
    for query in ("cafe\u0301", "CAF\u00c9"):
        assert [r.id for r in docs.where(match_against(F.col("t"), query)).collect()] == [1, 2]
    assert [r.id for r in docs.where(match_against(F.col("t"), "cafe")).collect()] == [3]


def test_table_changes(spark, tmp_path):
    t = dml.StoredTable(spark, f"file://{tmp_path}/t", "k int, v string, tags array<string>", ("k",))
    make = lambda *rows: spark.createDataFrame(rows, t.schema)
    assert t.read().count() == 0
    t.insert(make((1, "a", ["x"]), (2, "b", None)))
    t.insert(make((2, "c", ["y"]), (3, "d", None), (3, "e", None)))
    assert sorted(map(str, tuples(t.read()))) == ["(1, 'a', ['x'])", "(2, 'c', ['y'])", "(3, 'e', None)"]
    t.update(F.col("k") == 1, {"tags": F.array(F.lit("z"), F.lit("x")), "v": F.concat("v", F.lit("!"))})
    t.update(F.col("k") == 2, {"tags": None})
    assert {r.k: (r.v, r.tags) for r in t.read().collect()} == {1: ("a!", ["x", "z"]), 2: ("c", None), 3: ("e", None)}
    for bad in (lambda: t.update(None, {"v": F.lit("")}), lambda: t.delete(None)):
        with pytest.raises(dml.MissingPredicate):
            bad()
    t.delete(None, limit=1, order=[F.col("k").desc()])
    t.delete(F.col("v") == "c")
    assert [r.k for r in t.read().collect()] == [1] and [r.k for r in t.read(1).collect() if r.k == 3] == [3]
    t.add_column("extra", "double")
    assert t.read().first().extra is None
    t.truncate()
    assert t.read().count() == 0


def test_the_last_row_of_a_key_wins(spark):
    schema = "k int, v string"
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], schema), spark.createDataFrame([(2, "z"), (2, "b"), (3, "y"), (3, "x")], schema).coalesce(1)
    assert sorted(tuples(dml.upsert(old, new, ("k",)))) == [(1, "a"), (2, "b"), (3, "x")]
    assert sorted(tuples(dml.upsert(old, new, ("k",), F.col("v")))) == [(1, "a"), (2, "z"), (3, "y")]
    assert sorted(tuples(dml.upsert(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (2,), (2,)], "k int"), ("k",)))) == [(1,), (2,)]


def test_delete_with_a_limit_takes_just_so_many(spark):
    df = spark.createDataFrame([(1, None)] * 5 + [(2, "x")] * 3 + [(3, "y")], "k int, v string").repartition(4)
    left = Counter(r.k for r in dml.delete(df, F.col("k") < 3, limit=4, order=[F.col("k").desc()]).collect())
    assert left == {1: 4, 3: 1}
    assert dml.delete(df, None, limit=0).count() == 9 and dml.delete(df, F.col("k") > 0, limit=99).count() == 0


def test_anti_join_null_rules(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(2,), (None,)], "b int")
    assert {r.a for r in joins.anti(left, right, {"a": "b"}).collect()} == {1, None}
    assert {r.a for r in joins.anti(left, right, {"a": "b"}, keep_null=False).collect()} == {1}
    assert {r.a for r in joins.semi(left, right, {"a": "b"}).collect()} == {2}


def test_stratified_sample(spark):
    df = catalog.load(spark, "/root/testdata/sf0.01", "lineitem")
    n = Counter({r.l_returnflag: r["count"] for r in joins.stratified_sample(df, "l_returnflag", 10.0).groupBy("l_returnflag").count().collect()})
    every = {r.l_returnflag: r["count"] for r in df.groupBy("l_returnflag").count().collect()}
    assert all(abs(n[k] / every[k] - 0.1) < 0.02 for k in every)


def test_stratified_sample_takes_its_share_of_each_value(spark):
    rows = [("copies", 1)] * 500 + [("many", i) for i in range(1000)] + [(None, i) for i in range(45)] + [("rare", i) for i in range(10)] + [("few", 1)]
    df = spark.createDataFrame(rows, "v string, n int")
    out = joins.stratified_sample(df, "v", 10.0)
    assert Counter(r.v for r in out.collect()) == {"copies": 50, "many": 100, None: 4, "rare": 1}
    assert sorted(map(str, out.collect())) == sorted(map(str, joins.stratified_sample(df.repartition(7), "v", 10.0).collect()))
    assert joins.stratified_sample(df, "v", 100.0).count() == len(rows) and joins.stratified_sample(df, "v", 0.0).count() == 0


def test_information_schema(spark):
    for view in "tables views schemata columns statistics table_constraints key_column_usage referential_constraints character_sets collations".split():
        assert catalog.information_schema(spark, SF, view, ("region", "nation")).columns
    rows = tuples(catalog.information_schema(spark, SF, "columns", ("nation",)))
    assert rows[0] == ("tessera", "nation", "n_nationkey", 1, "NO", "int")


def test_files(spark, tmp_path):
    (tmp_path / "r.tbl").write_text("0|AFRICA|note|\n1|ASIA||\n")
    assert tuples(files.read_tbl(spark, str(tmp_path / "r.tbl"), "k int, name string, note string")) == [(0, "AFRICA", "note"), (1, "ASIA", None)]
    events, out = catalog.load(spark, SF, "events"), str(tmp_path / "e")
    files.write_partitioned(events, out, "ts")
    some = files.read_partitioned(spark, out, "ts", "2024-01-05", "2024-01-07")
    assert some.count() == events.where("ts >= timestamp_ntz '2024-01-05' AND ts < timestamp_ntz '2024-01-07'").count() > 0
    assert "PartitionFilters: [isnotnull(quantum" in some._jdf.queryExecution().toString() or "quantum" in some._jdf.queryExecution().toString()
    gone = files.drop_partitions_before(spark, out, "2024-01-05")
    assert gone and files.partitions(spark, out).agg(F.min("quantum")).first()[0] == "2024-01-05"
    schema = files.avro_schema("events", events.schema)
    assert {"name": "ts", "type": ["null", "long"]} in schema["fields"] and {"name": "value", "type": ["null", "double"]} in schema["fields"]


TARGETS = [
    ingest.Target("orders", "id bigint, customer bigint, status string, lines array<struct<n:int,q:double>>", "{type} = 'order' and source = 'shop'", ("id",), defaults={"status": "'new'"},
                  children=(ingest.Child("lines", "lines", "order_id"),), parents={"customer": ("customers", "c")}, mappers={"status": F.lower}),
    ingest.Target("other", "id bigint, v string", "{type} = 'other'", ("id",)),
]


def order(i, event, status="A", source="shop", **more):
    return {"event_id": event, "source": source, "event_time": f"2024-01-01T00:00:{i:02d}", "payload": {"type": "order", "id": i, "customer": i % 3, "status": status, "lines": [{"n": 1, "q": 2.0}, {"n": 2, "q": 3.5}], **more}}


def test_normalise_forms(spark):
    texts = [json.dumps(order(1, "a")), json.dumps([order(2, "b"), order(3, "c")]), json.dumps({"events": [order(4, "d")]}), json.dumps({"records": [order(5, "e")]}), json.dumps({"type": "other", "id": 9, "v": "x"})]
    out = ingest.normalise(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert sorted(r.event_id or "" for r in out.collect()) == ["", "a", "b", "c", "d", "e"]
    routed = ingest.route(out, TARGETS)
    assert Counter(r.target for r in routed.collect()) == {"orders": 5, "other": 1}
    keys = {r[0] for r in out.select(ingest.shard_key(F.get_json_object("payload", "$.id"))).collect()}
    assert keys == {"shop:a", "shop:b", "shop:c", "shop:d", "shop:e", "9"}


def test_batch_and_stream_load_the_same_and_restart(spark, tmp_path):
    first = [order(1, "a"), order(2, "b", status=None), order(7, "x", source="elsewhere"), order(1, "z", status="LATER") | {"event_time": "2024-01-02T00:00:00"}]
    second = [order(2, "c", status="B"), order(3, "d")]

    def stores(name):
        return {t: dml.StoredTable(spark, f"file://{tmp_path}/{name}/{t}", s, k) for t, s, k in (
            ("orders", "id bigint, customer bigint, status string", ("id",)), ("lines", "order_id bigint, n int, q double", ("order_id", "n")), ("other", "id bigint, v string", ("id",)))}

    batch, stream, drop = stores("batch"), stores("stream"), tmp_path / "drop"
    drop.mkdir()
    for k, events in enumerate((first, second)):
        text = "\n".join(map(json.dumps, events))
        (drop / f"{k}.json").write_text(text + "\n")
        ingest.load_batch(ingest.normalise(files.read_json_events(spark, str(drop / f"{k}.json"))), TARGETS, batch)
        for _ in range(2):  # a second start finds nothing new
            ingest.load_stream(spark, str(drop), f"{tmp_path}/marks", TARGETS, stream).awaitTermination()
    want = {1: "later", 2: "b", 3: "a"}
    for s in (batch, stream):
        assert {r.id: r.status for r in s["orders"].read().collect()} == want
        assert sorted(tuples(s["lines"].read())) == [(i, n, q) for i in (1, 2, 3) for n, q in ((1, 2.0), (2, 3.5))]
    good, bad = ingest.check_parents(batch["orders"].read(), TARGETS[0], {"customers": spark.createDataFrame([(0,), (1,)], "c bigint")})
    assert {r.id for r in good.collect()} == {1, 3} and {r.id for r in bad.collect()} == {2}


def test_rejects_parents_and_superseded_children(spark):
    events = [
        order(1, "a"), order(1, "b", lines=[{"n": 9, "q": 1.0}]) | {"event_time": "2024-01-02T00:00:00"}, order(2, "c"), order(3, "d", id=None), order(4, "e", source="elsewhere"),
        {"event_id": "f", "source": "shop", "payload": {"type": "line", "order_id": 1, "n": 10, "q": 7.0}},
    ]
    direct = ingest.Target("lines", "order_id bigint, n int, q double", "{type} = 'line'", ("order_id", "n"), parents={"order_id": ("orders", "id")})
    envelopes = ingest.normalise(spark.createDataFrame([(json.dumps(e),) for e in events], "value string"))
    out, rejects = ingest.accepted(envelopes, [*TARGETS, direct], {"customers": spark.createDataFrame([(0,), (1,)], "c bigint")})
    assert {r.id for r in out["orders"].collect()} == {1}
    assert sorted(tuples(out["lines"].select("order_id", "n", "q"))) == [(1, 9, 1.0), (1, 10, 7.0)]
    assert sorted((r.event_id, r.reason) for r in rejects.collect()) == [("c", "unknown parent"), ("d", "missing field"), ("e", "no table")]


def test_duplicates(spark):
    out = ingest.normalise(spark.createDataFrame([(json.dumps(e),) for e in (order(1, "a"), order(1, "a"), order(2, "b"), order(3, "b"), order(4, "c"))], "value string"))
    assert {(r.event_id, r.kind) for r in ingest.classify_duplicates(out).collect()} == {("a", "duplicate"), ("b", "conflict"), ("c", "new")}


def test_windows_on_a_stream_match_the_batch(spark, tmp_path):
    events = catalog.load(spark, SF, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuples(spark.table("windows"))) == sorted(tuples(ingest.windowed_counts(events)))
