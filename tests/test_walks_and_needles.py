"""Searches by grams and prefixes against plain scans; walks over hubs against plain walks, and how their rows are dealt."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import graph, joins, search

PEOPLE = "entity_id string, name string, primary_email string, domain string"
rows = [("1", "Ann Lee", "ann@x-corp.com", "x-corp.com"), ("2", None, "LEE@lee.io", "lee.io"), ("3", "Bo", None, None), ("4", "", "", ""), ("5", "annabel ann", "b@ann.com", "ANN.com"), ("6", "ÉLAN Ünit", "u@élan.fr", None), ("7", "aaaaaa", "aa@aa.aa", "aa.aa"), ("7", "aaaaaa", "aa@aa.aa", "aa.aa")]


def text(v):
    return None if v is None else v.lower()


@pytest.mark.parametrize("needles", [["ann", "LEE", "élan", "zzz", None, "aaa"], ["ann", "a", "", "Bo", None], [None], []])
def test_needles(spark, needles):
    people = spark.createDataFrame(rows, PEOPLE)
    asked = spark.createDataFrame([(k, n) for k, n in enumerate(needles)], "query_id int, needle string")
    got = sorted((r.query_id, r.entity_id) for r in search.by_name(people, asked).collect())
    want = sorted((k, i) for k, n in enumerate(needles) for i, name, mail, _ in rows if n is not None and any(v is not None and text(n) in text(v) for v in (name, mail)))
    assert got == want


def test_long_needles_have_no_nested_loop(spark):
    people = spark.createDataFrame(rows, PEOPLE)
    asked = spark.createDataFrame([(1, "annab"), (2, "lee.io")], "query_id int, needle string")
    for df in (search.by_name(people, asked), search.by_domain(people, asked, "needle"), search.autocomplete(people, asked.withColumnRenamed("needle", "prefix"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_prefixes(spark):
    people = spark.createDataFrame(rows, PEOPLE)
    prefixes = ["a", "ANN", "ann", "annabel ann", "annabel ann x", "", None, "é"]
    asked = spark.createDataFrame([(k, p) for k, p in enumerate(prefixes)], "query_id int, prefix string")
    got = sorted((r.query_id, r.entity_id) for r in search.starting(people, ["name", "primary_email"], asked, "prefix").collect())
    want = sorted((k, i) for k, p in enumerate(prefixes) for i, name, mail, _ in rows if p is not None and any(v is not None and text(v).startswith(text(p)) for v in (name, mail)))
    assert got == want
    assert search.starting(people, ["name"], asked.limit(0), "prefix").isEmpty()


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, s) for a, b, s in pairs], "from_id string, to_id string, strength double")


def test_paths_between_are_the_shortest_paths(spark):
    r = random.Random(4)
    names = [f"p{k:02d}" for k in range(30)]
    pairs = [(a, b, r.random()) for a, b in itertools.permutations(names, 2) if r.random() < 0.06]
    pairs += [("p00", f"p{k:02d}", 0.5) for k in range(1, 12)] + [("p05", "p05", 1.0), pairs[0]]
    edges = edges_of(spark, pairs)
    anchors = spark.createDataFrame([("p00",), ("p07",), ("nobody",)], "anchor string")
    every = {(x.anchor, x.entity_id): (x.path_length, tuple(x.path)) for x in graph.shortest_paths(edges, anchors, 4).collect()}
    wanted = [(a, n) for a in ("p00", "p07") for n in (*names[::3], "p00", "elsewhere")]
    got = {(x.anchor, x.entity_id): (x.path_length, tuple(x.path)) for x in graph.paths_between(edges, spark.createDataFrame(wanted, "anchor string, entity_id string"), 4).collect()}
    assert got == {k: every[k] for k in wanted if k in every}


def test_a_hub_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY_ROWS", 16)
    # A third of all edges leave one person.
    pairs = [("hub", f"t{k}", 0.5) for k in range(1000)] + [(f"t{k}", f"t{(k * 7 + j) % 1000}", 0.3) for k in range(1000) for j in (1, 2)] + [("me", "hub", 0.9)]
    edges = edges_of(spark, pairs).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        heavy = joins.heavy_keys(edges, "from_id")
        assert {(r.from_id, r.parts) for r in heavy.collect()} == {("hub", 63)}
        few = spark.createDataFrame([("me", "hub"), ("you", "hub"), ("me", "t3")], "anchor string, at string")
        out = joins.split_join(few, edges, "at", "from_id", heavy, F.col("to_id"))
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 2 * 1000 + 2 and max(tasks) < 0.25 * sum(tasks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    anchors = spark.createDataFrame([("u", "me")], "user_id string, anchor string")
    two = {(r.target, r.via) for r in graph.intro_paths(edges, anchors).collect()}
    assert two == {("hub", None), *((f"t{k}", "hub") for k in range(1000))}
    assert {r.entity_id: r.shared_connections for r in graph.shared(edges, anchors).collect()} == {f"t{k}": 1 for k in range(1000)}
