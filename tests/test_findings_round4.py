"""Pairs of events: made after their events are shuffled, with the rows that the plain operators give."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinloom import session
from kinloom.operators import canonical as C
from kinloom.operators import entities as E
from kinloom.operators import graph as G
from kinloom.operators import relations as R
from kinloom.plans import fixtures, ingest

SF = "/root/testdata/sf0.001"
MAIL = "tenant_id string, source string, sender string, recipients array<string>, subject string, source_event_id string, occurred_at long"
MEETINGS = "tenant_id string, source string, attendees array<string>, summary string, source_event_id string, occurred_at long"


def odd_events(spark, n=300):
    """Mail and meetings with repeated, missing and unknown addresses, of few times, of which one is null and one is that of most."""
    r = random.Random(8)
    names = [f"p{k}@x.y" for k in range(12)]
    one = lambda: r.choice([*names, *names, "", None, " P3@x.y", "Bo <p4@x.y>", "nobody@z"])
    when = lambda: r.choice([None, 1, 1, 1, 2, 3, r.randrange(50)])
    tenant = lambda: r.choice(["t", "t", "u"])
    mail = [(tenant(), "m", one(), r.choice([None, [], [one() for _ in range(r.randrange(7))]]), "s", r.choice([None, f"e{k % 40}"]), when()) for k in range(n)]
    meetings = [(tenant(), "c", r.choice([None, [one() for _ in range(r.randrange(7))]]), None, f"e{k % 40}", when()) for k in range(n)]
    return spark.createDataFrame(mail, MAIL).repartition(3), spark.createDataFrame(meetings, MEETINGS).repartition(4)


def odd_people(spark):
    """One address is that of two people, some have none."""
    rows = [(t, f"p{k}@x.y", f"{t}{k}") for t in "tu" for k in range(11)] + [("t", "p2@x.y", "t2b"), ("t", None, "t99")]
    return spark.createDataFrame(rows, "tenant_id string, primary_email string, entity_id string")


def exchanged(df, column):
    """The shuffles of a plan whose keys name the column."""
    return [x for x in re.findall(r"Exchange (?:hash|range)partitioning\(.*", df._jdf.queryExecution().executedPlan().toString()) if column in x]


@pytest.mark.parametrize("most", [R.MOST_EVENTS, 20])
def test_facts_of_events(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_EVENTS", most)
    monkeypatch.setattr(R, "EVENTS", 50)
    mail, meetings = odd_events(spark)
    people = odd_people(spark)
    found = R.facts_of(mail, meetings, people)
    assert bool(exchanged(found, "actor_id")) == (most == 20)  # pairs are shuffled only of the times that are crowded
    got = Counter(map(tuple, found.collect()))
    want = R.facts(R.from_mail(mail).unionByName(R.from_meetings(meetings)), people, ())
    assert got == Counter(map(tuple, want.select(found.columns).collect())) and len(got) > 500


def test_r4_shuffles_no_pairs(spark):
    assert not exchanged(ingest.reg.queries["r4_facts"](spark, SF), "target_id")


@pytest.mark.parametrize("most", [R.MOST_EVENTS, 25])
def test_strength_of_events(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_EVENTS", most)
    monkeypatch.setattr(R, "EVENTS", 50)
    mail, meetings = odd_events(spark)
    found = R.strength_of(mail, meetings)
    assert bool(exchanged(found, "other")) == (most == 25)  # pairs are shuffled only of the people who are crowded
    got = Counter(map(tuple, found.collect()))
    want = R.strength(R.from_mail(mail).unionByName(R.from_meetings(meetings)))
    assert got == Counter(map(tuple, want.select(found.columns).collect())) and len(got) > 200


def test_relations_of_events(spark):
    """Pairs are resolved before they become two rows; relations of another type and of people who aren't met again stay."""
    mail, meetings = odd_events(spark)
    people = odd_people(spark)
    old = spark.createDataFrame([("t", "t0", "t1", "direct", 999, 0.5, 1, 1), ("t", "t0", "t1", "other", 7, 0.5, 1, 1), ("t", "a", "b", "direct", 3, 0.5, 1, 1), ("t", "t3", "t4", None, 1, 0.5, 1, 1)], "tenant_id string, from_id string, to_id string, relationship_type string, interaction_count long, strength double, first_at long, last_at long")
    strengths = R.strength(R.from_mail(mail).unionByName(R.from_meetings(meetings)))
    got = Counter(map(tuple, R.put_relations(old, R.relations_of(mail, meetings, people)).collect()))
    new = R.resolve(R.resolve(strengths, people, "actor", "from_id"), people, "target", "to_id").where("from_id is not null and to_id is not null")
    new = new.withColumn("relationship_type", F.lit("direct")).select(*R.RELATION)
    want = Counter(map(tuple, R.upsert(old, new, ["tenant_id", "from_id", "to_id", "relationship_type"], ["last_at"]).collect()))
    assert got == want == Counter(map(tuple, R.upsert_relations(old, strengths, people).collect())) and len(got) > 200


def test_r5_and_r7_shuffle_events(spark, monkeypatch):
    monkeypatch.setattr(R, "EVENTS", 50)
    assert not exchanged(ingest.reg.queries["r5_strength"](spark, SF), "target")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size
    try:
        plan = ingest.reg.queries["r7_upsert"](spark, SF)
        assert len(exchanged(plan, "to_id")) == 2  # each side of the upsert once: the new rows aren't shuffled anew for the join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layers_write_no_payloads(spark, tmp_path):
    """A batch's payloads are read where they are, and its pairs of people are made after the shuffle."""
    from kinloom.operators.layers import Layers

    t = fixtures.Tables(spark, SF)
    raw = t.raw_contacts.unionByName(t.raw_mail).unionByName(t.raw_meetings).unionByName(t.raw_contacts.limit(3).withColumns({"payload": F.lit("nul"), "raw_event_id": -F.col("raw_event_id")}))
    before = set(Path(session.shared_dir(spark)).rglob("*.parquet"))
    found = Layers(spark, str(tmp_path / "layers")).run(raw, "r1", F.lit(0).cast("timestamp"))
    made = {f.parent for f in set(Path(session.shared_dir(spark)).rglob("*.parquet")) - before}
    assert made and not [f for f in made if {"payload", "v"} & set(spark.read.parquet(str(f)).columns)]
    assert found["raw"] == raw.count() and found["failed"] == C.failures(C.route(raw)).count() > 0
    people = E.entity_id(E.merge(E.candidates(t.contacts)))
    strengths = R.strength(R.from_mail(t.mail).unionByName(R.from_meetings(t.meetings)))
    want = R.resolve(R.resolve(strengths, people, "actor", "a"), people, "target", "b").where("a is not null and b is not null")
    assert found["relations"] == want.count() > 0


def test_known_pairs_are_shuffled_as_events(spark, monkeypatch):
    """Known pairs are made once, after the shuffle; those that are there already start no job."""
    monkeypatch.setattr(R, "EVENTS", 40)
    t = fixtures.Tables(spark, "/root/testdata/sf0.001/..//sf0.001")
    plans = []
    ways = R.ways
    monkeypatch.setattr(R, "ways", lambda pairs, *a, **k: (plans.append(pairs), ways(pairs, *a, **k))[1])
    n = F.count("*")
    kinds = F.bit_or(F.when(F.col("kind") == "email", 1).otherwise(2)).alias("kinds")
    want = t.pair_facts.groupBy("from_id", "to_id").agg(n.alias("interaction_count"), F.round(F.least(F.lit(1.0), n / F.lit(10.0)), 4).alias("strength"), F.max("occurred_at").alias("last_at"), kinds).withColumn("tenant_id", F.lit("t1"))
    got = t.known_pairs.select(want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert len(plans) == 1 and not exchanged(plans[0], "other")
    assert fixtures.Tables(spark, t.dir).known_pairs.count() == got.count() and len(plans) == 1


def test_routes_take_strengths_where_they_walk(spark):
    r = random.Random(3)
    rows = [(f"p{r.randrange(30)}", f"p{r.randrange(30)}", r.choice([None, 0.1, 0.4, 0.9])) for _ in range(70)]
    rows += rows[:20] + [(a, b, 0.7) for a, b, _ in rows[:10]]
    edges = spark.createDataFrame(rows, "from_id string, to_id string, strength double")
    wanted = spark.createDataFrame([(a, f"p{k}") for a in ("p1", "p2", "none") for k in range(32)], "anchor string, entity_id string")
    for steps in (1, 3):
        got = Counter(repr(x) for x in G.shortest_routes(edges, wanted, steps).collect())
        want = Counter(repr(x) for x in G.routes(G.shortest_paths(edges, wanted.select("anchor").distinct(), steps), edges, wanted).collect())
        assert got == want and len(got) > 60


def test_mirror_in_parts(spark):
    """Rows that are dealt out for the mirror aren't shuffled anew to be put there, and come to the same."""
    works = spark.createDataFrame([("t", f"e{k % 40}", f"c{k % 7}", str(k % 3)) for k in range(200)], "tenant_id string, entity_id string, company_id string, title string")
    topics = spark.createDataFrame([("t", f"e{k}", "x->y", 0.5) for k in range(50)] + [("t", None, "x", 0.5)], "tenant_id string, entity_id string, topic_id string, confidence double")
    edges = {"WORKS_AT": works, "HAS_TOPIC": topics}
    rows, plain = G.edge_mirror(edges, 5), G.edge_mirror(edges)
    store = G.put_mirror(rows.where("edge_type = 'WORKS_AT'"), rows)
    assert sorted(map(tuple, store.collect())) == sorted(map(tuple, plain.collect())) and store.count() > 100
    assert len(exchanged(rows, "edge_key")) == 1 and "edge_key" in exchanged(rows, ", 5)")[0]


def test_intermediates_are_packed(spark, tmp_path):
    """Identifiers in hexadecimal digits take about half of their digits on disk, in intermediates and in keyed tables."""
    from kinloom.operators.keyed import KeyedTable

    size = lambda path: sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), "id").coalesce(1)
    kept = session.materialise(rows, "packed", dense=True)
    table = KeyedTable(spark, str(tmp_path / "keyed"), ["key"])
    table.create(rows)
    table.put(rows.limit(10), ["id"])
    plain = size(Path(session.materialise(rows, "plain").inputFiles()[0].removeprefix("file:")).parent)
    for path in (Path(kept.inputFiles()[0].removeprefix("file:")).parent, Path(table.read().inputFiles()[0].removeprefix("file:")).parent):
        assert size(path) < 0.7 * plain
    assert kept.count() == table.read().count() == 20_000
