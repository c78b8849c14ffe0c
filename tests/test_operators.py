import json

import pytest
from pyspark.sql import functions as F

from kinloom.operators import canonical as C
from kinloom.operators import documents as D
from kinloom.operators import entities as E
from kinloom.operators import graph as G
from kinloom.operators import relations as R
from kinloom.operators import search as Q
from kinloom.operators.upsert import upsert, upsert_counts
from kinloom.sources import events as S


def raw(spark, *rows):
    """(id, source, payload)."""
    made = [(i, "t1", "u1", s, f"{s}/{i}", f"2025-01-0{i}", "tr", p if isinstance(p, str) else json.dumps(p)) for i, s, p in rows]
    return spark.createDataFrame(made, "raw_event_id long, tenant_id string, user_id string, source string, source_event_id string, occurred_at string, trace_id string, payload string").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


CONTACT = {"resourceName": "people/c_1", "names": [{"displayName": "Mira Okafor"}], "emailAddresses": [{"value": "MIRA.O@BROOK.EXAMPLE"}], "organizations": [{"name": "brackwater   ", "title": "harbour pilot"}]}
MAIL = {"id": "m1", "threadId": "t", "snippet": "s", "internalDate": "1735725600000", "payload": {"headers": [{"name": "Subject", "value": "Hi"}, {"name": "From", "value": "Jon Vega <jon@quarry.example>"}, {"name": "To", "value": "Mira Okafor <mira@brook.example>"}]}}
MEETING = {"id": "e1", "status": "confirmed", "summary": "Sync", "start": {"dateTime": "2025-01-01T10:00:00Z"}, "attendees": [{"email": x} for x in ("mira@brook.example", "jon@quarry.example", "tess@brook.example")]}


def test_three_sources_parse(spark):
    got = C.route(raw(spark, (1, "google_contacts", CONTACT), (2, "gmail", MAIL), (3, "google_calendar", MEETING)))
    assert {r["event_type"] for r in got.collect()} == {"contact", "email_message", "calendar_event"}
    assert got.where("failure is not null").isEmpty()


def test_failures_are_kept_apart(spark):
    rows = raw(spark, (1, "twitter", {}), (2, "google_contacts", {"names": ["str"]}), (3, "gmail", "not json"), (4, "google_contacts", {"names": [{"displayName": "Only Name"}]}))
    got = {r["raw_event_id"]: r["reason"] for r in C.failures(C.route(rows)).collect()}
    assert got == {1: "unsupported_source:twitter", 2: "parse_error:shape", 3: "parse_error:shape"}
    (one,) = C.flatten_contacts(C.route(rows)).collect()
    assert (one["full_name"], one["emails"]) == ("Only Name", [])


def test_enrichment(spark):
    (r,) = C.enrich_contacts(C.flatten_contacts(C.route(raw(spark, (1, "google_contacts", CONTACT))))).collect()
    assert (r["company"], r["title"], r["emails"]) == ("Brackwater", "Harbour Pilot", ["mira.o@brook.example"])
    assert r["tags"] == ["company:brackwater", "title:harbour_pilot"] and r["warnings"][-1] == "enrichment_applied"


def test_validation(spark):
    rows = spark.createDataFrame([(1, "contact", '"bad-shape"'), (2, "unsupported", "{}"), (3, "contact", '{"full_name": 7}'), (4, "contact", '{"full_name": "x"}'), (5, "email_message", '{"occurred_at": "x", "to": [1]}'), (6, "contact", None)], "i int, event_type string, normalized string")
    got = [r["reason"] for r in C.validate(rows).orderBy("i").collect()]
    assert got == ["normalized_payload_not_object", "unsupported_event_type:unsupported", "type:full_name", None, "type:to", "normalized_payload_not_object"]


def test_two_contacts_one_address_are_one_person(spark):
    a, b = dict(CONTACT, names=[{"displayName": "Mira"}]), CONTACT
    merged = E.merge(E.candidates(C.enrich_contacts(C.flatten_contacts(C.route(raw(spark, (1, "google_contacts", a), (2, "google_contacts", b)))))))
    (r,) = merged.collect()
    assert r["display_name"] == "Mira Okafor"


def test_relationships(spark):
    mail = C.enrich_mail(C.flatten_mail(C.route(raw(spark, (1, "gmail", MAIL)))))
    mail = mail.withColumn("recipients", F.transform("recipients", lambda x: x))
    meet = C.enrich_calendar(C.flatten_calendar(C.route(raw(spark, (2, "google_calendar", MEETING)))))
    inter = R.from_mail(mail).unionByName(R.from_meetings(meet))
    assert inter.count() == 7
    got = {(r["actor"], r["target"]): (r["interaction_count"], r["strength"]) for r in R.strength(inter).collect()}
    assert len(got) == 6 and got["jon@quarry.example", "mira@brook.example"] == (2, 0.2)
    assert {v for k, v in got.items() if k != ("jon@quarry.example", "mira@brook.example")} == {(1, 0.1)}


def test_upsert_is_idempotent_and_keeps_rules(spark):
    old = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "y", 1)], "k string, v int, w string, created int")
    new = spark.createDataFrame([("b", 3, None, 9), ("b", 4, None, 9), ("c", 5, "z", 9)], "k string, v int, w string, created int")
    once = upsert(old, new, ["k"], ["v"], keep=("created",), fill=("w",))
    want = {("a", 1, "x", 1), ("b", 4, "y", 1), ("c", 5, "z", 9)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in upsert(once, new, ["k"], ["v"], keep=("created",), fill=("w",)).collect()} == want
    assert tuple(upsert_counts(old, new, ["k"]).first()) == (1, 1)


def test_admission(spark):
    rows = [("google_contacts", '{"contacts":[{},{}]}'), ("gmail", '{"messages":[{},{}]}'), ("linkedin", '{"profiles":[{}]}'), ("gmail", '{"contacts":[{}]}'), ("gmail", "{}"), ("gmail", None)]
    got = S.admission(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source string, payload string")).orderBy("i").collect()
    assert [(r["accepted"], r["records"]) for r in got] == [(True, 2), (True, 2), (True, 1), (False, 0), (False, 0), (False, 0)]
    assert [r["shape"] for r in got[:5]] == ["list", "list", "list", "list", "empty_object"]
    with pytest.raises(ValueError, match="no events"):
        S.check_envelopes(raw(spark, (1, "gmail", {})).where("false"))


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, float(s)) for a, b, s in rows], "from_id string, to_id string, strength double")


def test_paths(spark):
    e = edges(spark, ("a", "b", 0.5), ("b", "c", 0.9), ("a", "c", 0.4), ("c", "d", 1.0), ("d", "e", 1.0), ("e", "a", 1.0))
    anchor = spark.createDataFrame([("u", "a")], "user_id string, anchor string")
    got = {r["entity_id"]: r["path"] for r in G.shortest_paths(e, anchor.select("anchor"), 4).collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "c", "d"], "e": ["a", "c", "d", "e"]}
    intro = {r["target"]: (r["via"], r["intro_likelihood"]) for r in G.intro_paths(e, anchor).collect()}
    assert intro == {"b": (None, 0.5), "c": ("b", 0.45), "d": ("c", 0.4)}
    second = G.second_degree(e, anchor.select("anchor")).collect()
    assert [(r["entity_id"], r["via_entity_ids"], r["path_strength"]) for r in second] == [("d", ["c"], 1.0)]


def test_checksum_ignores_order(spark):
    rows = [(i, str(i)) for i in range(20)]
    sums = [G.checksum({"x": spark.createDataFrame(r, "a int, b string").repartition(n)}).first() for r, n in ((rows, 1), (rows[::-1], 3))]
    assert sums[0] == sums[1]
    assert sums[0] != G.checksum({"x": spark.createDataFrame([*rows[:-1], (19, "x")], "a int, b string")}).first()


@pytest.mark.parametrize(("text", "intent", "what"), [
    ("intro to Ada Lovelace", "intro_path", "Ada Lovelace"), ("how do I meet Bob", "intro_path", "Bob"), ("People at Brackwater", "company_search", "Brackwater"),
    ("mail ada@x.com please", "person_search", "ada@x.com"), ("stripe.com", "company_search", "stripe.com"), ("find the boss", "person_search", "boss"), ("who is the", "general", None),
])
def test_intents(spark, text, intent, what):
    r = Q.parse(spark.createDataFrame([("q", text)], "query_id string, text string")).first()
    assert r["intent"] == intent
    assert what is None or what in (r["target_name"], r["company"], r["email"], r["domain"], " ".join(r["name_tokens"]))


def test_rank(spark):
    rows = [("q", 1, ["ada"], "Ada L", "ada@x.com", None, 0.5, 9, "2025-01-01", 60, 3), ("q", 2, ["ada"], "Bob", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "query_id string, rn int, tokens array<string>, name string, primary_email string, company_name string, strength double, interaction_count long, last_at string, degree long, shared_connections long").withColumn("last_at", F.col("last_at").cast("timestamp"))
    a, b = Q.rank(df, F.lit("2025-04-01").cast("timestamp")).orderBy("rn").collect()
    import math

    want = 0.35 + 0.25 * 0.5 + 0.15 * (0.7 * math.exp(-1) + 0.3 * math.log(10) / math.log(201)) + 0.15 * 0.97 + 0.1 * 0.3
    assert a["score"] == round(want, 4) and b["score"] == 0.15 and (a["position"], b["position"]) == (1, 2)


def test_hash_vector(spark):
    import hashlib

    key = "email::hello"
    got = spark.range(1).select(D.hash_vector(F.lit(key)).alias("v")).first()["v"]
    want = [round(int(hashlib.sha256(f"{key}{c}".encode()).hexdigest()[4 * j : 4 * j + 4], 16) / 65535 * 2 - 1, 6) for c in range(96) for j in range(16)]
    assert got == want


def test_nearest_in_blocks_is_nearest(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    whole, blocks = ({tuple(r) for r in D.nearest(q, v, 3, most_queries=m).select("query_id", "vec_id", "rank").collect()} for m in (100, 4))
    assert whole == blocks and len(whole) == 27
