"""What the findings of round 3 named: rows that are shuffled once, and work that grows no faster than its input."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinloom.operators import documents, graph, keyed, search
from kinloom.operators.upsert import upsert
from kinloom.session import materialise, shared_path

KINDS = "a string, b string, v string, at int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_upsert_shuffles_its_rows_once(spark):
    t = keyed.KeyedTable(spark, shared_path(spark, "keyed"), ["a", "b"], 30)
    t.create(spark.createDataFrame([(f"a{k % 9}", f"b{k}", "old", 0) for k in range(200)], KINDS))
    source = materialise(spark.createDataFrame([("a1", "b1", "new", 1), ("z", "z", "new", 1)], KINDS), "source")
    names = t.touched(source)
    assert names and plan_of(t._merged(names, source, 100, ["at"])).count("Exchange") == 1


@pytest.mark.parametrize("first", [1, 7, 100_000])
def test_batches_that_are_ready_are_upserts(spark, monkeypatch, first):
    monkeypatch.setattr(keyed, "FIRST_KEYS", first)
    rng = random.Random(first)
    t = keyed.KeyedTable(spark, shared_path(spark, "keyed"), ["a", "b"], 12)
    row = lambda k, at: (None if k % 17 == 0 else f"a{k % 7}", None if k % 19 == 0 else f"b{k}", rng.choice([None, f"v{at}"]), at)
    rows = materialise(spark.createDataFrame([row(k, at) for k in range(1, 16) for at in (1, 2)], KINDS), "rows")
    t.create(rows, ["at"])
    want = spark.createDataFrame(upsert(rows.where("false"), rows, ["a", "b"], ["at"]).collect(), KINDS)
    for turn in range(3):
        batch = materialise(spark.createDataFrame([row(rng.randrange(1, 90), 10 * turn + at) for at in range(40)] + [(None, "b", "x", 0), ("a", None, "x", 0)], KINDS), "batch")
        t.put(batch, ["at"], keep=("at",), fill=("v",), ready=True)
        want = spark.createDataFrame(upsert(want, batch, ["a", "b"], ["at"], keep=("at",), fill=("v",)).collect(), KINDS)
    assert sorted(map(str, t.read().collect())) == sorted(map(str, want.collect()))
    plain = t.files().count()
    some = want.where("b LIKE 'b1%'")
    held = {r["f"] for r in t.read().withColumn("f", F.col("_metadata.file_path")).join(some.select("a", "b"), ["a", "b"], "left_semi").select("f").distinct().collect()}
    assert plain > 1 and set(t.touched(some)) == held


def test_few_people_walk_where_the_edges_are(spark):
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(40)}", f"p{rng.randrange(40)}", rng.random()) for _ in range(160)]
    edges = materialise(spark.createDataFrame(rows + rows[:5], "from_id string, to_id string, strength double"), "edges")
    anchors = materialise(spark.createDataFrame([("u", "p1"), ("w", "p2")], "user_id string, anchor string"), "anchors")
    step = graph._steps(edges)(anchors, "anchor")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan_of(step) and "hashpartitioning" not in plan_of(step)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ways = {}
    for a in ("p1", "p2"):
        for f, m, _ in rows + rows[:5]:
            for g, t, _ in rows + rows[:5]:
                if f == a and g == m:
                    ways[a, t] = ways.get((a, t), 0) + 1
    for limit in (graph.BROADCAST_BYTES, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(graph, "BROADCAST_BYTES", limit)
            assert {(r.anchor, r.entity_id): r.shared_connections for r in graph.shared(edges, anchors).collect()} == ways


def test_only_wanted_decoration_is_made(spark):
    edges = spark.createDataFrame([("me", "a", 0.5, 1, 1), ("a", "b", 0.25, 1, 1)], "from_id string, to_id string, strength double, interaction_count int, last_at int")
    works = spark.createDataFrame([("a", "x")], "entity_id string, company_id string")
    firms = spark.createDataFrame([("x", "X", "x.com")], "company_id string, name string, domain string")
    found = spark.createDataFrame([("q", "a", "me"), ("q", "b", "me")], "query_id string, entity_id string, anchor string")
    every = {r.entity_id: r.asDict() for r in search.decorate(found, edges, works, firms).collect()}
    assert every["a"]["company_name"] == "X" and (every["a"]["degree"], every["b"]["degree"], every["b"]["shared_connections"]) == (2, 1, 1)
    few = search.decorate(found, edges, works, firms, ("strength", "shared_connections"))
    assert few.columns == ["query_id", "entity_id", "anchor", "strength", "shared_connections"]
    assert {r.entity_id: r.asDict() for r in few.collect()} == {k: {c: v[c] for c in few.columns} for k, v in every.items()}


def test_exact_nearest_against_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8)).astype(np.float32).astype(float)
    x[40:90] = x[3]  # many copies of one vector, some of them queries
    odd = {7: None, 11: [1.0, None] + [0.5] * 6, 13: [float("nan")] * 8, 17: [1.0, 2.0], 100: None}
    rows = [(i, odd[i] if i in odd else x[i].tolist()) for i in range(120)]
    vectors = materialise(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), "vectors")
    queries = vectors.where("vec_id % 5 = 0 OR vec_id IN (7, 13, 17)").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = lambda df, ident, out: df.select(ident, F.transform("embedding", lambda e: e / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y * y))).alias(out))
    pairs = unit(vectors, "vec_id", "v").crossJoin(unit(queries, "query_id", "q")).where("query_id <> vec_id")
    cos = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    want = pairs.select("query_id", "vec_id", cos.alias("cosine")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where("rank <= 4")
    for block in (1_000, 6):
        got = documents.nearest(queries, vectors, 4, block)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert "NestedLoop" not in plan_of(got)
