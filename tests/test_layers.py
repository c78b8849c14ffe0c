"""Layers over batches, snapshots that differ, stages that are counted as they write, hot pairs, kept fixtures."""

import pytest
from pyspark.sql import functions as F

from kinloom import session
from kinloom.operators import canonical, documents, entities, graph, joins, metrics, relations
from kinloom.session import shared_path
from kinloom.streaming import flows


def interactions(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, source string, touchpoint_type string, occurred_at long, actor string, target string, topic string, source_event_id string")


def test_a_hot_pair_is_cut_before_it_is_shuffled(spark):
    rows = [("t", "mail", "email", k, "a", "b", None, f"e{k:05d}") for k in range(2000)] + [("t", "mail", "email", k, "a", f"x{k}", None, f"f{k}") for k in range(50)]
    found = relations.evidence(interactions(spark, rows).repartition(6))
    plan = found._jdf.queryExecution().executedPlan().toString()
    first = plan.index("Exchange hashpartitioning(tenant_id") if "Exchange hashpartitioning(tenant_id" in plan else plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[first:]  # plans are read from the bottom: the limit stands below the shuffle
    hot = {r.target: [e.source_event_id for e in r.evidence] for r in found.collect()}
    assert hot["b"] == [f"e{k:05d}" for k in range(1995, 2000)] and len(hot) == 51


def test_changes_between_snapshots(spark):
    a = spark.range(5000).select((F.col("id") % 70).alias("x"), F.col("id").alias("y"), (F.col("id") * 3).alias("v"), F.when(F.col("id") % 9 > 0, F.lit("s")).alias("s"))
    assert graph.changes(a, a.repartition(3), ["x", "y"]).isEmpty()
    b = a.where("y <> 17").withColumn("v", F.when(F.col("y") == 4000, F.lit(-1)).otherwise(F.col("v"))).withColumn("s", F.when(F.col("y") != 9, F.col("s")))
    b = b.unionByName(a.where("y = 3").withColumn("y", F.lit(9999).cast("long")))
    b = b.withColumn("s", F.when(F.col("y") == 9, F.lit("was null")).when(F.col("y") % 9 > 0, F.lit("s")))
    got = {(r.y, r.change) for r in graph.changes(a, b, ["x", "y"]).collect()}
    assert got == {(17, "removed"), (4000, "changed"), (9, "changed"), (9999, "added")}
    assert {r.change for r in graph.changes(a.limit(0), a.limit(3), ["x", "y"]).collect()} == {"added"}


def test_stages_are_logged_as_they_end(spark):
    log = metrics.StageLog(spark, shared_path(spark, "log"), "r")
    out = log.run("one", spark.range(10), failed=F.count_if(F.col("id") > 7))
    with pytest.raises(Exception, match="DIVIDE"):
        log.run("two", out.select(F.lit(1) / (F.col("id") * 0)))
    rows = {r.stage: r for r in log.stages().collect()}
    assert (rows["one"].records_out, rows["one"].failed, rows["one"].status) == (10, 2, "succeeded")
    assert rows["two"].status == "failed" and "DIVIDE_BY_ZERO" in rows["two"].error and out.count() == 10


def test_kept_fixtures_follow_their_files(spark):
    path = shared_path(spark, "folder")
    spark.range(3).write.parquet(path)
    read = lambda: spark.read.schema("id long").parquet(path)
    assert session.once(read(), path, "kept").count() == 3 and session.once(read(), path, "kept").inputFiles() == session.once(read(), path, "kept").inputFiles()
    spark.range(5).write.mode("overwrite").parquet(path)
    assert session.once(read(), path, "kept").count() == 5


def test_metadata_by_key(spark):
    people = spark.createDataFrame([("1", "t", "a@x", {"k": "old", "own": "1"}), ("2", "t", None, None), ("3", "t", "c@x", None)], "entity_id string, tenant_id string, primary_email string, metadata map<string,string>")
    found = spark.createDataFrame([("t", "a@x", 1, {"k": "new", "z": "1"}), ("t", "a@x", 2, {"z": None}), ("t", "c@x", 1, {"q": "r"}), ("u", "a@x", 9, {"k": "other tenant"}), ("t", None, 9, {"k": "?"}), ("t", "nobody", 9, {"k": "?"})], "tenant_id string, primary_email string, raw_event_id long, metadata map<string,string>")
    got = {r.entity_id: r.metadata for r in entities.layer_metadata(people, found).collect()}
    assert got == {"1": {"own": "1", "k": "new", "z": None}, "2": None, "3": {"q": "r"}}


def test_shapes_of_payloads(spark):
    shapes = {
        "google_contacts": [('{"emailAddresses":[{"value":"a@b.c"},{}]}', False), ('{"emailAddresses":[{"value":"a"},null]}', True), ('{"email":7}', True), ('{"email":""}', False), ('{"names":["x"]}', True), ('{"names":{"displayName":"x"}}', False), ("[]", True), ("3", True), ("null", True), (None, True), ("{", True)],
        "gmail": [('{"payload":{"headers":[{"name":"To"},"x"]}}', True), ('{"payload":"x"}', False), ('{"payload":{"headers":[[]]}}', True)],
        "google_calendar": [('{"attendees":[{"email":"a"},{"email":[1]}]}', True), ('{"attendees":[{"email":false}]}', False), ('{"attendees":[1]}', True)],
    }
    rows = [(k, s, p, bad) for k, (s, p, bad) in enumerate((s, p, bad) for s, ps in shapes.items() for p, bad in ps)]
    got = {r.raw_event_id: r.failure for r in canonical.route(spark.createDataFrame(rows, "raw_event_id int, source string, payload string, bad boolean")).collect()}
    assert {k: f is not None for k, f in got.items()} == {k: bad for k, _, _, bad in rows}


def test_versions_of_cache_entries(spark):
    put = lambda rows: spark.createDataFrame(rows, "namespace string, key string, value int, put_at timestamp, version string, ttl_seconds int")
    at = lambda s: f"2024-01-0{s} 00:00:00"
    rows = put([]).unionByName(spark.createDataFrame([("n", "k", 1, "v1", 86400, at(1)), ("n", "k", 2, "v2", None, at(1)), ("n", "j", 3, "v1", 172800, at(1))], "namespace string, key string, value int, version string, ttl_seconds int, p string").withColumn("put_at", F.to_timestamp("p")).drop("p"))
    store = rows.drop("ttl_seconds").withColumn("expires_at", F.col("put_at")).where("false")
    now = documents.put_ttl(store, rows, F.lit(at(2)).cast("timestamp"))
    assert {(r.key, r.version): r.value for r in now.collect()} == {("k", "v2"): 2, ("j", "v1"): 3}


def test_lifetimes_end_by_timers(spark):
    """Batches out of order; state goes when the watermark has passed it, and what comes too late is left out."""
    source, path, log = shared_path(spark, "in"), shared_path(spark, "out"), shared_path(spark, "log")
    got = []
    with flows.states_on_disk(spark):
        for batch in ([("a", 100), ("a", 105), ("a", 90), ("b", 100), (None, 5)], [("a", 95), ("a", 109)], [("a", 111), ("a", 100), ("b", 130)], [("c", 1000)], [("c", 1005), ("a", 1001), ("a", 1)]):
            spark.createDataFrame(batch, "k string, s long").select("k", F.timestamp_seconds("s").alias("t")).coalesce(1).write.mode("append").parquet(source)
            found = flows.new_keys(flows.read(spark, source), ["k"], "t", 20, "500 seconds")
            flows.drain(found, log, flows.put_batches(path))
        kept = spark.read.schema(found.schema).option("recursiveFileLookup", "true").parquet(path)
        got = sorted(((r.k, r.s) for r in kept.select("k", F.unix_seconds("first_at").alias("s")).collect()), key=str)
    # a: new at 90, so alive to 110; 111 is new again; 1001 is new; 1 is behind the watermark of 500.
    assert got == sorted([("a", 90), ("b", 100), (None, 5), ("a", 111), ("b", 130), ("c", 1000), ("a", 1001)], key=str)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_key_filters_lose_nothing(spark, limit):
    keys = spark.range(0, 30_000, 3).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    rows = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"), "id").unionByName(spark.createDataFrame([(None, -1)], "key string, id long"))
    made = joins.key_filter(keys, "key", limit)
    assert (made is None) == (limit == 0)
    n = {(r.there, r.maybe): r["count"] for r in joins.may_hold(rows, "key", made, "maybe").groupBy((F.col("id") % 3 == 0).alias("there"), "maybe").count().collect()}
    assert n.get((True, False), 0) == 0 and n[True, True] == 10_000
    if made:
        assert 0.02 < n[False, True] / 20_000 < 0.15
