"""Pairs of orders, mail and meetings: made where they are read, in parts of bounded rows."""

import random

from pyspark.sql import functions as F

from kinloom import session
from kinloom.operators import canonical, relations
from kinloom.plans import fixtures, graphs

SF = "/root/testdata/sf0.001"


def test_pairs_of_orders_are_made_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "EVENTS", 40)
    t = fixtures.Tables(spark, SF)
    known = {(r["from_id"], r["to_id"]): [e["touchpoint_type"] for e in r["evidence"]] for r in graphs.relations(t).collect()}
    assert not [k for k in session._kept if "pair_facts" in k]
    assert t.order_people.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    want = {(r["from_id"], r["to_id"]): sorted(r["kinds"]) for r in t.pair_facts.groupBy("from_id", "to_id").agg(F.collect_set("kind").alias("kinds")).collect()}
    assert known == want and {tuple(v) for v in want.values()} == {("email", "meeting"), ("meeting",)}


def test_events_become_pairs_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "FILE_ROWS", 37)
    t = fixtures.Tables(spark, "/root/testdata/sf0.001/.")
    pairs = t.interactions
    assert not [k for k in session._kept if "interactions" in k]
    sizes = [r["n"] for r in t.meetings.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) <= 37
    assert pairs.count() == t.pair_facts.count()


def test_addresses_are_read_before_attendees_are_paired(spark):
    meetings = spark.createDataFrame([("t", "cal", 1, "s", "e1", [" A@x.y", "Bo <b@x.y>", "a@x.y ", "", None, "b@x.y"])], "tenant_id string, source string, occurred_at long, summary string, source_event_id string, attendees array<string>")
    found = relations.from_meetings(meetings)
    got = sorted((r["actor"], r["target"]) for r in found.collect())
    assert got == sorted([("a@x.y", "b@x.y"), ("b@x.y", "a@x.y")] * 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan[: plan.rindex("Generate")]


def test_latest_evidence_against_a_plain_version(spark):
    rng = random.Random(5)
    rows = [("t", "m", rng.choice(["email", "meeting"]), rng.randrange(40), f"a{rng.randrange(4)}", f"b{rng.randrange(3)}", None, f"e{k}") for k in range(300)] + [("u", "m", "email", 1, "a0", "b0", "x", "e")]
    df = spark.createDataFrame(rows, "tenant_id string, source string, touchpoint_type string, occurred_at long, actor string, target string, topic string, source_event_id string")
    made = relations.evidence(df.repartition(5))
    want = {}
    for r in rows:
        want.setdefault((r[0], r[4], r[5]), []).append((r[3], r[2], r[7]))
    got = {(r["tenant_id"], r["actor"], r["target"]): [(e["occurred_at"], e["touchpoint_type"], e["source_event_id"]) for e in r["evidence"]] for r in made.collect()}
    assert got == {k: sorted(v)[-5:] for k, v in want.items()}
    assert "_actor" in made._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_parsed_once(spark):
    raw = spark.createDataFrame([(1, "gmail", '{"payload":{"headers":[{"name":"SUBJECT","value":"a"},{"name":"subject","value":7},{"name":"From","value":"x@y"},{"name":"subject","value":"b"}]}}'), (2, "gmail", '{"payload":{"headers":["x"]}}'), (3, "gmail", "[1]"), (4, "gmail", "nul")], "raw_event_id long, source string, payload string")
    raw = raw.select("*", F.lit("t").alias("tenant_id"), F.lit("u").alias("user_id"), F.lit("e").alias("source_event_id"), F.lit(0).cast("timestamp").alias("occurred_at"))
    mail = canonical.flatten_mail(canonical.route(raw))
    assert [(r["raw_event_id"], r["subject"], r["sender"]) for r in mail.collect()] == [(1, "b", "x@y")]
    assert mail._jdf.queryExecution().optimizedPlan().toString().count("Parse") + mail._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 2


def test_facts_shuffle_only_wanted_columns(spark):
    rows = [("t", "m", "email", 1, "a@x", "b@x", "hi", "e1"), ("t", "m", "email", 1, "a@x", "b@x", "ho", "e2"), ("t", "m", "email", 2, "a@x", "b@x", "ho", "e3"), ("t", "m", "email", 1, "a@x", "no@x", "hi", "e4")]
    inter = spark.createDataFrame(rows, "tenant_id string, source string, touchpoint_type string, occurred_at long, actor string, target string, topic string, source_event_id string")
    people = spark.createDataFrame([("t", "a@x", "A"), ("t", "b@x", "B")], "tenant_id string, primary_email string, entity_id string")
    few = relations.facts(inter, people, ())
    assert few.columns == ["tenant_id", "actor_id", "target_id", "touchpoint_type", "occurred_at", "source_event_id"]
    assert sorted(map(tuple, few.collect())) == [("t", "A", "B", "email", 1, "e2"), ("t", "A", "B", "email", 2, "e3")]
    whole = relations.facts(inter, people)
    assert {(r["source_event_id"], r["topic"], r["actor"], r["target_id"]) for r in whole.collect()} == {("e2", "ho", "a@x", "B"), ("e3", "ho", "a@x", "B")}


def test_contacts_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "FILE_ROWS", 40)
    t = fixtures.Tables(spark, SF)
    parts = t.contact_items.where("raw_event_id % 10 = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 2 and sum(r["count"] for r in parts) == t.people.count()
