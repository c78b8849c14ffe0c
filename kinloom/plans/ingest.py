"""Registered queries of sources, canonical events, people, interactions and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.operators import canonical as C
from kinloom.operators import documents as D
from kinloom.operators import entities as E
from kinloom.operators import relations as R
from kinloom.operators import vectors as V
from kinloom.operators.upsert import latest_by, upsert, upsert_counts
from kinloom.sources import events as S

from .fixtures import AS_OF, CONTACTS, INTER, ORDERS, Tables
from .registry import Registry

reg = Registry()
query = reg.query


def secs(c: str = "occurred_at") -> Column:
    return F.unix_seconds(F.col(c)).alias("t_s")


def joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def files(t: Tables, raw: DataFrame, key: str, by: Column) -> DataFrame:
    """Payload files as a provider sends them: lists of items under one key."""
    body = F.concat(F.lit(f'{{"{key}":['), F.array_join(F.collect_list("payload"), ","), F.lit("]}"))
    many = max(64, raw.count() // 500)  # about 500 events a file, as providers page
    by = F.pmod(by, F.lit(many))
    return raw.groupBy(by.alias("part")).agg(body.alias("payload")).select(F.lit("t1").alias("tenant_id"), F.lit("u1").alias("user_id"), F.lit("tr").alias("trace_id"), "part", "payload")


def contact_files(t: Tables) -> DataFrame:
    return files(t, t.raw_contacts, "connections", F.xxhash64("source_event_id"))


def mail_files(t: Tables) -> DataFrame:
    return files(t, t.raw_mail, "messages", F.xxhash64("source_event_id"))


def calendar_files(t: Tables) -> DataFrame:
    return files(t, t.raw_meetings, "items", F.xxhash64("source_event_id"))


NOW = "1009843200"
S1 = f"SELECT 'google_contacts' AS source, sid AS source_event_id, CASE WHEN seq % 5 <> 0 AND kind <> 'bad' THEN t_s ELSE {NOW} END AS t_s FROM ckind"
S2 = f"SELECT 'gmail' AS source, sid AS source_event_id, CASE WHEN k % 4 = 1 THEN t_s ELSE {NOW} END AS t_s FROM mail"
S3 = "SELECT 'google_calendar' AS source, sid AS source_event_id, t_s FROM meet"


@query("s1_contacts", f"WITH {CONTACTS} {S1}")
def s1(t: Tables) -> DataFrame:
    return S.contacts(contact_files(t), as_of()).select("source", "source_event_id", secs())


@query("s2_mail", f"WITH {ORDERS} {S2}")
def s2(t: Tables) -> DataFrame:
    return S.mail(mail_files(t), as_of()).select("source", "source_event_id", secs())


@query("s3_calendar", f"WITH {ORDERS} {S3}")
def s3(t: Tables) -> DataFrame:
    return S.calendar(calendar_files(t), as_of()).select("source", "source_event_id", secs())


def all_events(t: Tables) -> DataFrame:
    return S.together(S.contacts(contact_files(t), as_of()), S.mail(mail_files(t), as_of()), S.calendar(calendar_files(t), as_of()))


BOTH = CONTACTS + ORDERS[len(ORDERS.split(",\nop AS", 1)[0]) :]


@query("s4_union", f"WITH {BOTH} SELECT source, count(*) AS n FROM ({S1} UNION ALL {S2} UNION ALL {S3}) GROUP BY source")
def s4(t: Tables) -> DataFrame:
    return S.by_source(all_events(t))


@query("s5_admission", """
SELECT source, part, n > 0 AS accepted, n AS records, shape FROM (
  SELECT 'gmail' AS source, CAST(o_orderkey AS VARCHAR) AS part, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END AS n, CASE o_orderkey % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'list' ELSE 'object' END AS shape FROM orders
  UNION ALL SELECT 'csv_import', 'e' || event_id, 0, 'int' FROM events)""")
def s5(t: Tables) -> DataFrame:
    """Lists of zero to three messages, under the right key or another; and events' own objects."""
    k = F.col("o_orderkey")
    items = F.array_join(F.array_repeat(F.lit("{}"), (k % 4).cast("int")), ",")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"contacts":['), items, F.lit("]}"))).when(k % 3 == 1, F.concat(F.lit('{"messages":['), items, F.lit("]}"))).otherwise(F.concat(F.lit('{"messages":['), items, F.lit('],"next":1}')))
    mail = t.orders.select(F.lit("gmail").alias("source"), k.cast("string").alias("part"), body.alias("payload"))
    other = t.events.select(F.lit("csv_import").alias("source"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("part"), F.col("props").alias("payload"))
    return S.admission(mail.unionByName(other)).select("source", "part", "accepted", F.col("records").cast("long").alias("records"), "shape")


@query("s6_envelope", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing source_event_id' WHEN event_type = 'click' THEN 'unknown source' END AS fault FROM events")
def s6(t: Tables) -> DataFrame:
    source = F.when(F.col("event_type") == "click", "fax").otherwise("csv_import")
    rows = t.events.select("event_id", F.lit("t1").alias("tenant_id"), F.lit("u1").alias("user_id"), source.alias("source"), F.when(F.col("event_type") != "error", F.col("event_id").cast("string")).alias("source_event_id"), F.col("ts").alias("occurred_at"), F.lit("tr").alias("trace_id"), F.col("props").alias("payload"))
    return S.envelope_faults(rows).select("event_id", "fault")


@query("s7_raw_upsert", """
SELECT 'u' || user_id AS user_id, 'x' || event_id AS source_event_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS payload,
  CASE WHEN event_id % 3 = 0 THEN 'run2' ELSE 'run1' END AS run_id, 'v1' AS ingest_version, CAST(CASE WHEN event_id % 3 = 0 THEN 1009843260 ELSE 1009843200 END AS BIGINT) AS captured_s
FROM events""")
def s7(t: Tables) -> DataFrame:
    """Every event is captured by one run; every third one is sent again, changed, and captured by a second."""
    e = t.events.select(F.lit("t1").alias("tenant_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), F.lit("csv_import").alias("source"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("source_event_id"), F.col("ts").alias("occurred_at"), F.lit("tr").alias("trace_id"), F.col("event_type").alias("payload"), "event_id")
    first = S.stamped(e, "run1", as_of())
    again = S.stamped(e.where("event_id % 3 = 0").withColumn("payload", F.upper("payload")), "run2", as_of() + F.expr("INTERVAL 60 SECONDS"))
    store = S.capture(S.capture(first.where(F.lit(False)), first), again)
    return store.select("user_id", "source_event_id", "payload", "run_id", "ingest_version", F.unix_seconds("captured_at").alias("captured_s"))


@query("s8_raw_by_trace", f"WITH {CONTACTS} SELECT 'tr' || raw_event_id % 10 AS trace_id, raw_event_id, sid AS source_event_id FROM ckind WHERE raw_event_id % 10 = 1")
def s8(t: Tables) -> DataFrame:
    return S.of_trace(t.raw_contacts, "tr1", "trace_id", "raw_event_id", "source_event_id")


CANON = f"SELECT raw_event_id, 'contact' AS event_type, sid AS source_event_id, full_name AS label FROM contacts UNION ALL SELECT raw_event_id, 'email_message', sid, coalesce(subject, '') FROM mail UNION ALL SELECT raw_event_id, 'calendar_event', sid, coalesce(summary, '') FROM meet"


def canonical(t: Tables) -> DataFrame:
    head = ["raw_event_id", "event_type", "source_event_id"]
    contacts = t.contacts.select(*head, F.col("full_name").alias("label"))
    mail = t.mail.select(*head, F.coalesce("subject", F.lit("")).alias("label"))
    return contacts.unionByName(mail).unionByName(t.meetings.select(*head, F.coalesce("summary", F.lit("")).alias("label")))


@query("s9_canonical_upsert", f"""WITH {BOTH} SELECT raw_event_id, event_type, source_event_id, CASE WHEN raw_event_id % 2 = 0 THEN 'run2' ELSE 'run1' END AS run_id, 'parsed' AS parse_status, 'v1' AS schema_version, 'v1' AS parser_version,
  sha256('{{"label":"' || label || '","source_event_id":"' || source_event_id || '"}}') AS canonical_hash FROM ({CANON})""")
def s9(t: Tables) -> DataFrame:
    """Canonical rows put under (raw event, type, version) by one run, and every second one again by another."""
    first = C.stored(canonical(t), "run1", as_of(), "label", "source_event_id")
    again = C.stored(canonical(t).where("raw_event_id % 2 = 0"), "run2", as_of() + F.expr("INTERVAL 60 SECONDS"), "label", "source_event_id")
    return C.put(C.put(first.where(F.lit(False)), first), again).select("raw_event_id", "event_type", "source_event_id", "run_id", "parse_status", "schema_version", "parser_version", "canonical_hash")


@query("s10_canonical_by_trace", f"WITH {BOTH} SELECT * FROM ({CANON}) WHERE raw_event_id % 10 = 3")
def s10(t: Tables) -> DataFrame:
    rows = canonical(t).withColumn("trace_id", F.concat(F.lit("tr"), (F.col("raw_event_id") % 10).cast("string")))
    return S.of_trace(rows, "tr3").drop("trace_id")


@query("s11_tenant_scan", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def s11(t: Tables) -> DataFrame:
    """Market segments stand for tenants: the filter and the two columns reach the scan."""
    return S.of_tenant(t.customer, "BUILDING", "c_custkey", "c_name", tenant_col="c_mktsegment")


@query("s14_payload_size", "SELECT event_id, CAST(strlen(props) AS INTEGER) AS payload_size_bytes FROM events")
def s14(t: Tables) -> DataFrame:
    return S.payload_size(t.events.select("event_id", F.col("props").alias("payload"))).select("event_id", "payload_size_bytes")


@query("s15_cursor", """
WITH m AS (SELECT user_id, max(ts) AS t_s FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id)
SELECT e.event_id, e.user_id FROM events e LEFT JOIN m ON e.user_id = m.user_id WHERE m.t_s IS NULL OR e.ts > m.t_s""")
def s15(t: Tables) -> DataFrame:
    """Marks are of what came before the fifteenth; what is beyond them is new."""
    e = t.events.withColumn("occurred_at", F.col("ts"))
    marks = S.cursor(e.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp")), ["user_id"])
    return S.after_cursor(e, marks, ["user_id"]).select("event_id", "user_id")


ROUTED = """SELECT raw_event_id, 'google_contacts' AS source, 'contact' AS event_type, CASE WHEN kind = 'bad' THEN 'parse_error:shape' END AS failure FROM ckind
  UNION ALL SELECT raw_event_id, 'gmail', 'email_message', NULL FROM mail UNION ALL SELECT raw_event_id, 'google_calendar', 'calendar_event', NULL FROM meet
  UNION ALL SELECT event_id + 90000000000, 'twitter', NULL, 'unsupported_source:twitter' FROM events"""


@query("c1_route", f"WITH {BOTH} {ROUTED}")
def c1(t: Tables) -> DataFrame:
    return t.routed.select("raw_event_id", "source", "event_type", "failure")


@query("c2_contact", f"WITH {CONTACTS} SELECT raw_event_id, full_name, first_name, last_name, emails, phones, comp AS company, raw_title AS title, warnings FROM contacts")
def c2(t: Tables) -> DataFrame:
    return C.flatten_contacts(C.route(t.raw_contacts)).select("raw_event_id", "full_name", "first_name", "last_name", joined("emails"), joined("phones"), "company", "title", joined("warnings"))


@query("c3_mail", f"WITH {ORDERS} SELECT raw_event_id, thread_id, subject, replace(replace(sender, lower(split_part(sender, ' <', 1)), name), email, upper(email)) AS sender, recipients, snippet, t_s, CASE WHEN subject IS NULL THEN 'missing_subject' ELSE '' END AS warnings FROM mail JOIN (SELECT o_orderkey, name FROM op) ON o_orderkey = k")
def c3(t: Tables) -> DataFrame:
    return C.flatten_mail(C.route(t.raw_mail)).select("raw_event_id", "thread_id", "subject", "sender", joined("recipients"), "snippet", secs(), joined("warnings"))


@query("c4_calendar", f"WITH {ORDERS} SELECT raw_event_id, summary, location, start_at, who AS attendees, 'confirmed' AS status, CASE WHEN summary IS NULL THEN 'missing_summary' ELSE '' END AS warnings FROM meet")
def c4(t: Tables) -> DataFrame:
    return C.flatten_calendar(C.route(t.raw_meetings)).select("raw_event_id", "summary", "location", "start_at", joined("attendees"), "status", joined("warnings"))


@query("c5_quarantine", f"WITH {BOTH} SELECT raw_event_id, source, failure AS reason FROM ({ROUTED}) WHERE failure IS NOT NULL")
def c5(t: Tables) -> DataFrame:
    return C.failures(t.routed)


#: Payloads of eight shapes, by the last digits of an event's id: which of them a parser of contacts can read.
SHAPES = ['{"emailAddresses":[{"value":"A@x.y"},"str"]}', '{"organizations":["a",{"name":"b"}]}', "[1]", '{"organizations":[{"name":"b"},"a"],"names":[]}', '{"emailAddresses":[{"value":5}]}', '{"phoneNumbers":[null]}', '"text"', '{"emailAddresses":"none","email":null}']


@query("c5_shapes", "SELECT event_id AS raw_event_id, 'parse_error:shape' AS reason FROM events WHERE event_id % 8 NOT IN (3, 7)")
def c5_shapes(t: Tables) -> DataFrame:
    """Mixed lists, payloads that are no objects and addresses that are no text are quarantined; lists of which only the first is read are not."""
    payload = F.element_at(F.array(*[F.lit(x) for x in SHAPES]), (F.col("event_id") % 8 + 1).cast("int"))
    rows = t.events.select(F.col("event_id").alias("raw_event_id"), F.lit("google_contacts").alias("source"), payload.alias("payload"))
    return C.failures(C.route(rows)).select("raw_event_id", "reason")


@query("c6_header_date", "SELECT o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) - CASE WHEN o_orderkey % 3 = 1 THEN 7200 ELSE 0 END AS t_s FROM orders")
def c6(t: Tables) -> DataFrame:
    """Dates as headers write them: named zones, an offset, none."""
    k = F.col("o_orderkey") % 3
    header = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.when(k == 0, " GMT").when(k == 1, " +0200").otherwise(""))
    return t.orders.select("o_orderkey", F.unix_seconds(X.header_date(header)).alias("t_s"))


@query("c7_name_split", f"WITH {CONTACTS} SELECT raw_event_id, split_part(disp, ' ', 1) AS first_name, substr(replace(disp, '  ', ' '), strpos(disp, ' ') + 1) AS last_name FROM ckind")
def c7(t: Tables) -> DataFrame:
    return t.contact_items.select("raw_event_id", X.first_name(F.col("disp")).alias("first_name"), X.last_name(F.col("disp")).alias("last_name"))


@query("c8_validate", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'type:emails' WHEN 2 THEN 'missing:occurred_at' WHEN 3 THEN 'normalized_payload_not_object' WHEN 4 THEN 'unsupported_event_type:' || event_type ELSE 'missing:full_name' END AS reason FROM events""")
def c8(t: Tables) -> DataFrame:
    k = F.col("event_id") % 6
    body = F.when(k == 0, '{"summary":"x","attendee_emails":["a@b.c"],"status":null}').when(k == 1, '{"full_name":"x","emails":[1,2]}').when(k == 2, '{"subject":"x","to":[]}').when(k == 3, '"bad-shape"').when(k == 4, "{}").otherwise('{"full_name":""}')
    kind = F.when(k == 0, "calendar_event").when(k.isin(1, 5), "contact").when(k.isin(2, 3), "email_message").otherwise(F.col("event_type"))
    return C.validate(t.events.select("event_id", kind.alias("event_type"), body.alias("normalized"))).select("event_id", "reason")


@query("c9_enrich", f"WITH {CONTACTS} SELECT raw_event_id, company_t AS company, title_t AS title, tags, CASE WHEN warnings = '' THEN 'enrichment_applied' ELSE warnings || ',enrichment_applied' END AS warnings FROM tagged")
def c9(t: Tables) -> DataFrame:
    return C.enrich_contacts(C.flatten_contacts(C.route(t.raw_contacts))).select("raw_event_id", "company", "title", joined("tags"), joined("warnings"))


C10 = """'{"company":"' || company_t || '","emails":[' || CASE WHEN emails = '' THEN '' ELSE '"' || emails || '"' END || ']' || CASE WHEN first_name IS NULL THEN '' ELSE ',"first_name":"' || first_name || '"' END || ',"full_name":"' || full_name || '"'
  || CASE WHEN last_name IS NULL THEN '' ELSE ',"last_name":"' || last_name || '"' END || ',"phones":[' || CASE WHEN phones = '' THEN '' ELSE '"' || phones || '"' END || '],"title":"' || title_t || '"}'"""


@query("c10_hash", f"WITH {CONTACTS} SELECT raw_event_id, sha256({C10}) AS canonical_hash FROM tagged")
def c10(t: Tables) -> DataFrame:
    return C.canonical_hash(t.contacts, "full_name", "first_name", "last_name", "emails", "phones", "company", "title").select("raw_event_id", "canonical_hash")


@query("c11_title_case", f"WITH {CONTACTS} SELECT raw_event_id, company_t || '-O''Neil' AS company FROM contacts")
def c11(t: Tables) -> DataFrame:
    return t.contact_items.where("kind <> 'bad'").select("raw_event_id", X.title_case(F.concat("comp", F.lit("-o'NEIL"))).alias("company"))


@query("c12_counts", f"""WITH {BOTH} SELECT source, count(*) AS raw, count(*) FILTER (failure IS NULL) AS parsed, count(failure) AS failed,
  count(*) FILTER (failure IS NULL AND raw_event_id % 7 <> 0) AS valid, count(*) FILTER (failure IS NULL AND raw_event_id % 7 = 0) AS invalid, count(*) FILTER (failure IS NULL AND raw_event_id % 7 <> 0) AS enriched FROM ({ROUTED}) GROUP BY source""")
def c12(t: Tables) -> DataFrame:
    """Every seventh event loses its shape on the way to validation; valid ones are enriched."""
    rows = C.normalized(t.contacts, t.mail, t.meetings)
    checked = C.validate(rows.withColumn("normalized", F.when(F.col("raw_event_id") % 7 == 0, F.lit("[]")).otherwise(F.col("normalized"))))
    valid = checked.where("reason is null").select("raw_event_id", "event_type")
    rich = [df.join(valid, ["raw_event_id", "event_type"], "left_semi").select("source") for df in (t.contacts, t.mail, t.meetings)]
    return C.ingest_counts(t.routed, checked, rich[0].unionByName(rich[1]).unionByName(rich[2]))


CAND = CONTACTS + """,
cand AS (SELECT *, CASE WHEN emails = '' THEN 't1:source:google_contacts:' || sid ELSE 't1:email:' || emails END AS merge_key FROM tagged),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY merge_key ORDER BY raw_event_id DESC) AS r FROM cand) WHERE r = 1)"""


@query("e1_candidates", f"WITH {CAND} SELECT raw_event_id, sid AS source_identity, full_name AS display_name, nullif(emails, '') AS primary_email, company_t AS company, title_t AS title, tags FROM cand")
def e1(t: Tables) -> DataFrame:
    return E.candidates(t.contacts).select("raw_event_id", "source_identity", "display_name", "primary_email", "company", "title", joined("tags"))


@query("e2_merge", f"WITH {CAND} SELECT merge_key, raw_event_id, full_name AS display_name FROM merged")
def e2(t: Tables) -> DataFrame:
    return E.merge(E.candidates(t.contacts)).select("merge_key", "raw_event_id", "display_name")


def known(t: Tables) -> DataFrame:
    """The entity table before the batch: every person but suppliers."""
    return t.entities.where("title <> 'SUPPLIER'")


def known_identities(t: Tables) -> DataFrame:
    rows = t.entities.where("title = 'SUPPLIER'")
    return rows.select("tenant_id", F.lit("google_contacts").alias("source"), F.concat(F.lit("people/"), "entity_id").alias("source_identity"), "entity_id", "primary_email", F.lit(0).cast("long").alias("raw_event_id"), F.lit(0.5).cast("decimal(5,4)").alias("confidence"), F.lit(True).alias("is_primary"))


def resolved(t: Tables) -> DataFrame:
    found = E.lookup(E.merge(E.candidates(t.contacts)), known_identities(t), known(t))
    return found.withColumn("entity_id", F.coalesce("entity_id", F.sha2("merge_key", 256)))


FOUND = CAND + """,
found AS (SELECT *, CASE WHEN entity_id LIKE 's%' AND sid = 'people/' || entity_id THEN entity_id WHEN entity_id LIKE 'c%' AND emails <> '' THEN entity_id END AS found_id FROM merged),
resolved AS (SELECT *, coalesce(found_id, sha256(merge_key)) AS eid FROM found)"""


@query("e3_lookup", f"WITH {FOUND} SELECT merge_key, found_id AS entity_id FROM found")
def e3(t: Tables) -> DataFrame:
    return E.lookup(E.merge(E.candidates(t.contacts)), known_identities(t), known(t)).select("merge_key", "entity_id")


@query("e4_upsert", f"""WITH {FOUND}, old AS (SELECT * FROM people WHERE title <> 'SUPPLIER'), new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY raw_event_id DESC) AS rr FROM resolved) WHERE rr = 1)
SELECT coalesce(eid, old.entity_id) AS entity_id, coalesce(full_name, old.name) AS display_name, coalesce(nullif(emails, ''), old.email) AS primary_email, coalesce(company_t, old.company) AS company, coalesce(title_t, old.title) AS title,
  coalesce(new.tags, 'company:' || lower(old.company) || ',' || lower(old.title)) AS tags FROM new FULL JOIN old ON eid = old.entity_id""")
def e4(t: Tables) -> DataFrame:
    return E.upsert_entities(known(t), resolved(t)).select("entity_id", "display_name", "primary_email", "company", "title", joined("tags"))


@query("e4_counts", f"WITH {FOUND} SELECT count(*) FILTER (o IS NULL) AS created, count(o) AS updated FROM (SELECT DISTINCT eid, p.entity_id AS o FROM resolved LEFT JOIN (SELECT entity_id FROM people WHERE title <> 'SUPPLIER') p ON p.entity_id = eid)")
def e4_counts(t: Tables) -> DataFrame:
    return upsert_counts(known(t), resolved(t), ["entity_id"])


@query("e5_identities", f"""WITH {FOUND}, old AS (SELECT entity_id, 'people/' || entity_id AS sid, email FROM people WHERE title = 'SUPPLIER')
SELECT coalesce(n.sid, old.sid) AS source_identity, coalesce(eid, old.entity_id) AS entity_id, CASE WHEN n.sid IS NULL THEN old.email ELSE nullif(n.emails, '') END AS primary_email, CASE WHEN old.sid IS NULL THEN 1e0 ELSE 0.5e0 END AS confidence
FROM resolved n FULL JOIN old ON n.sid = old.sid""")
def e5(t: Tables) -> DataFrame:
    return E.upsert_identities(known_identities(t), resolved(t)).select("source_identity", "entity_id", "primary_email", F.col("confidence").cast("double").alias("confidence"))


@query("e6_metadata", f"WITH {CAND} SELECT raw_event_id, emails AS primary_email, company_t AS company_norm, title_t AS title_norm, full_name, tags FROM cand WHERE emails <> ''")
def e6(t: Tables) -> DataFrame:
    return E.metadata(t.contacts).select("raw_event_id", "primary_email", "company_norm", "title_norm", "full_name", joined("tags"))


@query("e7_metadata_upsert", f"""WITH {CAND}, m AS (SELECT emails, count(*) AS n, max_by(full_name, raw_event_id) AS full_name, max_by(company_t, raw_event_id) AS company_t, max_by(title_t, raw_event_id) AS title_t, max_by(tags, raw_event_id) AS tags FROM cand WHERE emails <> '' GROUP BY emails)
SELECT entity_id, coalesce(full_name, name) AS display_name, coalesce(company_t, company) AS company, coalesce(title_t, title) AS title, coalesce(tags, 'company:' || lower(company) || ',' || lower(title)) AS tags, coalesce(n, 0) AS updates FROM people LEFT JOIN m ON m.emails = email""")
def e7(t: Tables) -> DataFrame:
    return E.merge_metadata(t.entities.select(*E.ENTITY), E.metadata(t.contacts)).select("entity_id", "display_name", "company", "title", joined("tags"), "updates")


@query("e7_layers", """
WITH u AS (SELECT DISTINCT user_id FROM events), m AS (SELECT user_id, event_type AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY 1, 2)
SELECT user_id AS entity_id, key, value FROM m UNION ALL SELECT user_id, 'kept', 'yes' FROM u
UNION ALL SELECT user_id, 'click', 'old' FROM u WHERE user_id NOT IN (SELECT user_id FROM m WHERE key = 'click')""")
def e7_layers(t: Tables) -> DataFrame:
    """Free metadata of users: each event's type is a key, of which the last value wins; other keys stay as they were."""
    users = t.events.select(F.col("user_id").alias("entity_id"), F.lit("t1").alias("tenant_id"), F.col("user_id").cast("string").alias("primary_email")).distinct()
    users = users.withColumn("metadata", F.create_map(F.lit("kept"), F.lit("yes"), F.lit("click"), F.lit("old")))
    found = t.events.select(F.lit("t1").alias("tenant_id"), F.col("user_id").cast("string").alias("primary_email"), F.col("event_id").alias("raw_event_id"), F.create_map(F.col("event_type"), F.col("event_id").cast("string")).alias("metadata"))
    return E.layer_metadata(users, found).select("entity_id", F.explode("metadata").alias("key", "value"))


@query("e8_resolve", f"WITH {ORDERS} SELECT raw_event_id, 'c' || o_custkey AS sender_id FROM mail JOIN orders ON o_orderkey = k")
def e8(t: Tables) -> DataFrame:
    return E.resolve(t.mail.withColumn("email", X.address(F.col("sender"))), t.entities, "email", "sender_id").select("raw_event_id", "sender_id")


def shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("touchpoint_type").alias("kind"), "actor", "target", "topic", "source_event_id", secs())


@query("r1_mail", f"WITH {INTER} SELECT kind, actor, target, topic, sid AS source_event_id, t_s FROM inter WHERE kind = 'email'")
def r1(t: Tables) -> DataFrame:
    return shown(R.from_mail(t.mail))


@query("r2_meetings", f"WITH {INTER} SELECT kind, actor, target, topic, sid AS source_event_id, t_s FROM inter WHERE kind = 'meeting'")
def r2(t: Tables) -> DataFrame:
    return shown(R.from_meetings(t.meetings))


@query("r3_address", f"WITH {ORDERS} SELECT raw_event_id, email AS address FROM mail")
def r3(t: Tables) -> DataFrame:
    return C.flatten_mail(C.route(t.raw_mail)).select("raw_event_id", X.address(F.col("sender")).alias("address"))


@query("r4_facts", f"WITH {INTER} SELECT split_part(actor, '@', 1) AS actor_id, split_part(target, '@', 1) AS target_id, kind, t_s, max(sid) AS source_event_id FROM inter GROUP BY ALL")
def r4(t: Tables) -> DataFrame:
    return R.facts_of(t.mail, t.meetings, t.entities).select("actor_id", "target_id", F.col("touchpoint_type").alias("kind"), secs(), "source_event_id")


STRENGTH = "SELECT actor, target, count(*) AS interaction_count, round(least(1e0, count(*) / 1e1), 4) AS strength, min(t_s) AS first_at, max(t_s) AS last_at FROM inter GROUP BY actor, target"


@query("r5_strength", f"WITH {INTER} {STRENGTH}")
def r5(t: Tables) -> DataFrame:
    return R.strength_of(t.mail, t.meetings).select("actor", "target", "interaction_count", "strength", F.unix_seconds("first_at").alias("first_at"), F.unix_seconds("last_at").alias("last_at"))


@query("r6_evidence", f"""WITH {INTER}, n AS (SELECT *, row_number() OVER (PARTITION BY actor, target ORDER BY t_s DESC, kind DESC, sid DESC) AS r FROM inter)
SELECT actor, target, string_agg(kind || ':' || sid, ',' ORDER BY t_s, kind, sid) AS evidence FROM n WHERE r <= 5 GROUP BY actor, target""")
def r6(t: Tables) -> DataFrame:
    return R.evidence(t.interactions).select("actor", "target", F.array_join(F.transform("evidence", lambda e: F.concat(e["touchpoint_type"], F.lit(":"), e["source_event_id"])), ",").alias("evidence"))


@query("r7_upsert", f"WITH {INTER} SELECT split_part(actor, '@', 1) AS from_id, split_part(target, '@', 1) AS to_id, interaction_count, strength FROM ({STRENGTH})")
def r7(t: Tables) -> DataFrame:
    """Strengths of mail alone are put first, then those of everything: measures are overwritten."""
    empty = R.strength(R.from_mail(t.mail)).select("tenant_id", F.split_part("actor", F.lit("@"), F.lit(1)).alias("from_id"), F.split_part("target", F.lit("@"), F.lit(1)).alias("to_id"), F.lit("direct").alias("relationship_type"), "interaction_count", "strength", "first_at", "last_at")
    return R.put_relations(empty, R.relations_of(t.mail, t.meetings, t.entities)).select("from_id", "to_id", "interaction_count", "strength")


DOC1 = "SELECT 'contact_profile' AS doc_type, nullif(emails, '') AS owner_email, replace(full_name, '  ', ' ') || ' | ' || title_t || ' | ' || company_t || CASE WHEN emails = '' THEN '' ELSE ' | ' || emails END AS content, sid AS source_event_id, t_s FROM tagged"
DOC2 = "SELECT 'email_summary' AS doc_type, email AS owner_email, CASE WHEN subject IS NULL THEN snippet ELSE subject || ' | ' || snippet END AS content, sid AS source_event_id, t_s FROM mail"
DOC3 = "SELECT 'calendar_summary' AS doc_type, split_part(who, ',', 1) AS owner_email, CASE WHEN summary IS NULL THEN location ELSE summary || ' | ' || location END AS content, sid AS source_event_id, t_s FROM meet"
BOTH2 = CONTACTS + ORDERS[len(ORDERS.split(",\nop AS", 1)[0]) :] + f""",
docs AS ({DOC1} UNION ALL {DOC2} UNION ALL {DOC3}),
bound AS (SELECT d.*, p.entity_id FROM docs d LEFT JOIN people p ON p.email = d.owner_email),
store AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, doc_type, content ORDER BY t_s DESC, source_event_id DESC) AS r FROM bound WHERE entity_id IS NOT NULL) WHERE r = 1)"""


def doc_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_type", "owner_email", "content", "source_event_id", secs("source_updated_at"))


@query("d1_contact", f"WITH {CONTACTS} {DOC1}")
def d1(t: Tables) -> DataFrame:
    return doc_rows(D.contact_documents(t.contacts))


@query("d2_mail", f"WITH {ORDERS} {DOC2}")
def d2(t: Tables) -> DataFrame:
    return doc_rows(D.mail_documents(t.mail))


@query("d3_calendar", f"WITH {ORDERS} {DOC3}")
def d3(t: Tables) -> DataFrame:
    return doc_rows(D.calendar_documents(t.meetings))


@query("d4_clean", r"SELECT doc_id, md5(nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '')) AS clean FROM documents")
def d4(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.squish(F.col("text"))).alias("clean"))


def all_documents(t: Tables) -> DataFrame:
    return D.contact_documents(t.contacts).unionByName(D.mail_documents(t.mail)).unionByName(D.calendar_documents(t.meetings))


@query("d5_bind", f"WITH {BOTH2} SELECT entity_id, doc_type, content, source_event_id FROM store")
def d5(t: Tables) -> DataFrame:
    bound = D.bind(all_documents(t), t.entities)
    store = bound.select(*D.KEY, "owner_email", "source_event_id", "source_updated_at").where(F.lit(False))
    return D.upsert_documents(store, bound).select("entity_id", "doc_type", "content", "source_event_id")


@query("d5_skipped", f"WITH {BOTH2} SELECT doc_type, count(*) AS documents, count(*) FILTER (entity_id IS NULL) AS skipped_no_entity FROM bound GROUP BY doc_type")
def d5_skipped(t: Tables) -> DataFrame:
    return D.skipped(D.bind(all_documents(t), t.entities))


@query("d6_dedup", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, text ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def d6(t: Tables) -> DataFrame:
    """The newest of the documents of a source with the same text; texts meet by hash."""
    rows = t.documents.select("source", "doc_id", F.sha2("text", 256).alias("content"))
    return D.dedup(rows, ["source", "content"], ["doc_id"]).select("doc_id", "source")


@query("d7_requests", "SELECT doc_id, lower(source) AS owner_email FROM documents WHERE trim(text) <> ''")
def d7(t: Tables) -> DataFrame:
    return D.embedding_requests(t.documents.select("doc_id", F.upper("source").alias("owner_email"), F.col("text").alias("content"))).select("doc_id", "owner_email")


def turns(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.col("role").alias("doc_type"), F.col("text").alias("content"))


CACHE = "k AS (SELECT conv_id, turn, role || '::' || text AS key FROM conversations), cached AS (SELECT DISTINCT role || '::' || text AS key FROM conversations WHERE turn = 0)"


def cached(t: Tables) -> DataFrame:
    """Vectors are known for what opens a conversation."""
    return D.generate(turns(t).where("turn = 0"), 16)


@query("d8_cache_split", f"WITH {CACHE} SELECT conv_id, turn, key IN (SELECT key FROM cached) AS hit FROM k WHERE key IS NOT NULL")
def d8(t: Tables) -> DataFrame:
    hits, misses = D.cache_split(turns(t), cached(t))
    return hits.select("conv_id", "turn", F.lit(True).alias("hit")).unionByName(misses.select("conv_id", "turn", F.lit(False).alias("hit")))


@query("d9_cache_store", f"WITH {CACHE} SELECT DISTINCT md5(key) AS key FROM k WHERE key IS NOT NULL")
def d9(t: Tables) -> DataFrame:
    store = cached(t)
    return D.cache_store(store, D.generate(D.cache_split(turns(t), store)[1], 16)).select(F.md5("cache_key").alias("key"))


@query("d10_hash_vector", """
WITH k AS (SELECT DISTINCT role || '::' || text AS key FROM conversations WHERE text IS NOT NULL)
SELECT md5(key) AS key, CAST(1536 AS INTEGER) AS dims, round(CAST('0x' || substr(sha256(key || '0'), 1, 4) AS INTEGER) / 65535e0 * 2 - 1, 6) AS first, round(CAST('0x' || substr(sha256(key || '95'), 61, 4) AS INTEGER) / 65535e0 * 2 - 1, 6) AS last FROM k""")
def d10(t: Tables) -> DataFrame:
    return D.generate(turns(t).where("content is not null")).select(F.md5("cache_key").alias("key"), F.size("embedding").alias("dims"), F.get("embedding", 0).alias("first"), F.get("embedding", 1535).alias("last"))


@query("d11_persist", f"WITH {CACHE} SELECT conv_id, turn, CASE WHEN key IN (SELECT key FROM cached) THEN round(CAST('0x' || substr(sha256(key || '0'), 1, 4) AS INTEGER) / 65535e0 * 2 - 1, 6) END AS first FROM k")
def d11(t: Tables) -> DataFrame:
    return D.persist_vectors(turns(t), cached(t)).select("conv_id", "turn", F.get("embedding", 0).alias("first"))


@query("d11_counts", f"WITH {CACHE} SELECT role AS doc_type, count(*) FILTER (key IN (SELECT key FROM cached)) AS applied, count(*) FILTER (key IS NULL OR key NOT IN (SELECT key FROM cached WHERE key IS NOT NULL)) AS skipped FROM (SELECT c.role, k.key FROM conversations c JOIN k ON c.conv_id = k.conv_id AND c.turn = k.turn) GROUP BY role")
def d11_counts(t: Tables) -> DataFrame:
    return D.applied(D.persist_vectors(turns(t), cached(t)), "embedding")


@query("d12_keywords", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), f AS (SELECT doc_id, list_filter(ws, lambda x: length(x) >= 3) AS ws FROM w),
d AS (SELECT doc_id, word, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM f) GROUP BY doc_id, word),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM d)
SELECT w.doc_id, coalesce(string_agg(word, ' ' ORDER BY n), '') AS keywords FROM w LEFT JOIN (SELECT * FROM r WHERE n <= 12) k ON k.doc_id = w.doc_id GROUP BY w.doc_id""")
def d12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


@query("d13_signals", f"WITH {CACHE} SELECT conv_id, turn, key IN (SELECT key FROM cached) AS embedding_ready FROM k WHERE key IS NOT NULL")
def d13(t: Tables) -> DataFrame:
    return D.signals(D.persist_vectors(turns(t), cached(t))).select("conv_id", "turn", "embedding_ready")


def indexed(t: Tables) -> DataFrame:
    """Documents of mail and meetings with the signals of those that have a subject."""
    docs = D.bind(D.mail_documents(t.mail).unionByName(D.calendar_documents(t.meetings)), t.entities).where("entity_id is not null")
    docs = docs.select(*D.KEY).distinct()
    found = D.signals(docs.where(F.contains("content", F.lit("|"))).withColumn("embedding", F.array(F.lit(1.0))))
    return D.apply_signals(docs, found)


IDX = BOTH2 + ", idx AS (SELECT DISTINCT entity_id, doc_type, content FROM store WHERE doc_type <> 'contact_profile')"


@query("d14_apply", f"WITH {IDX} SELECT entity_id, doc_type, content, strpos(content, '|') > 0 AS indexed FROM idx")
def d14(t: Tables) -> DataFrame:
    return indexed(t).select("entity_id", "doc_type", "content", "indexed")


@query("d14_counts", f"WITH {IDX} SELECT doc_type, count(*) FILTER (strpos(content, '|') > 0) AS applied, count(*) FILTER (strpos(content, '|') = 0) AS skipped FROM idx GROUP BY doc_type")
def d14_counts(t: Tables) -> DataFrame:
    return D.applied(indexed(t), "indexed")


@query("d15_health", f"WITH {IDX} SELECT 't1' AS tenant_id, count(*) AS documents, count(*) FILTER (strpos(content, '|') > 0) AS indexed_documents, count(*) FILTER (strpos(content, '|') > 0) > 0 AS index_ready FROM idx")
def d15(t: Tables) -> DataFrame:
    return D.health(indexed(t))


@query("d16_knn", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS c FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 5""")
def d16(t: Tables) -> DataFrame:
    """A stated set of queries (ids that 50 divides) against all vectors."""
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return D.nearest(q, t.embeddings, 5).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("d16_index", None)
def d16_index(t: Tables) -> DataFrame:
    """The same queries by the index: every vector is in it, and tests hold its recall against the exact way."""
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    model = V.fit(t.embeddings)
    found = V.search(q, t.embeddings, V.build(t.embeddings, model), model)
    return found.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


_STOPS = ", ".join(f"'{w}'" for w in D.STOP_WORDS)


@query("d17_fulltext", rf"""
WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
tf AS (SELECT term, id, count(*) AS tf FROM w WHERE length(term) > 1 AND term NOT IN ({_STOPS}) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) WHERE length(term) > 1 AND term NOT IN ({_STOPS})),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, id, round(sum((1 + ln(tf)) * ln(1 + (SELECT count(*) FROM documents) / CAST(df AS DOUBLE))), 6) AS score FROM tf JOIN q ON q.term = tf.term JOIN df ON df.term = tf.term GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id AS doc_id, round(score, 4) AS score FROM r WHERE rank <= 3""")
def d17(t: Tables) -> DataFrame:
    """Benchmark items are the queries."""
    terms = D.inverted_index(t.benchmark, "item_id", "text").select(F.col("id").alias("query_id"), "term")
    found = D.match_terms(D.of_terms(t.documents, "doc_id", "text", terms), terms, t.documents.count(), 3)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


@query("d17_stemmed", None)
def d17_stemmed(t: Tables) -> DataFrame:
    """The same queries by stems: terms that differ by their endings match."""
    terms = D.stems_of(D.inverted_index(t.benchmark, "item_id", "text")).select(F.col("id").alias("query_id"), "term")
    found = D.match_terms(D.stems_of(D.inverted_index(t.documents, "doc_id", "text")), terms, t.documents.count(), 3)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


@query("d18_ttl", """
WITH l AS (SELECT event_type AS namespace, user_id AS key, max(ts) AS t_s FROM events GROUP BY 1, 2)
SELECT namespace, count(*) AS n FROM l WHERE t_s + INTERVAL 90 DAY > TIMESTAMP '2024-04-28 00:00:00' GROUP BY namespace""")
def d18(t: Tables) -> DataFrame:
    e = t.events.select(F.col("event_type").alias("namespace"), F.col("user_id").alias("key"), "value", F.col("ts").alias("put_at"))
    empty = e.withColumn("expires_at", F.col("put_at")).where(F.lit(False))
    return D.put_ttl(empty, e, F.lit("2024-04-28").cast("timestamp")).groupBy("namespace").agg(F.count("*").alias("n"))


@query("d18_versions", """
WITH e AS (SELECT event_type AS namespace, 'v' || event_id % 3 AS version, user_id AS key, event_id, ts, ts + to_seconds(86400 * (30 + event_id % 60)) AS expires_at FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY namespace, version, key ORDER BY ts DESC, event_id DESC) AS r FROM e)
SELECT namespace, version, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS folded FROM l WHERE r = 1 AND expires_at > TIMESTAMP '2024-03-01 00:00:00' GROUP BY 1, 2""")
def d18_versions(t: Tables) -> DataFrame:
    """Entries of three versions, each with its own time to live."""
    e = t.events.select(F.col("event_type").alias("namespace"), F.concat(F.lit("v"), F.col("event_id") % 3).alias("version"), F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("put_at"), (86400 * (30 + F.col("event_id") % 60)).alias("ttl_seconds"))
    last = latest_by(e, ["namespace", "version", "key"], ["put_at", "value"])
    empty = last.drop("ttl_seconds").withColumn("expires_at", F.col("put_at")).where(F.lit(False))
    kept = D.put_ttl(empty, last, F.lit("2024-03-01").cast("timestamp"))
    return kept.groupBy("namespace", "version").agg(F.count("*").alias("n"), F.sum("value").alias("folded"))
