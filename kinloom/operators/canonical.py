"""Canonical events: flatten by source, quarantine, validate, enrich, hash."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.sources.events import get

from .upsert import upsert

TYPES = {"google_contacts": "contact", "gmail": "email_message", "google_calendar": "calendar_event"}
PARSER_VERSION = SCHEMA_VERSION = "v1"
#: The lists of objects that each parser reads whole, and the field that it takes for an address; lists of which it reads the first.
LISTS = {
    "contact": (("$.emailAddresses", "$.value"), ("$.phoneNumbers", None)),
    "email_message": (("$.payload.headers", None),),
    "calendar_event": (("$.attendees", "$.email"),),
}
FIRSTS = {"contact": ("$.names", "$.organizations"), "email_message": (), "calendar_event": ()}
#: Addresses that stand by themselves.
SINGLE = {"contact": ("$.email",), "email_message": (), "calendar_event": ()}


def _texts(v: Column, path: str, field: str) -> Column:
    """Strings of one field of a list of objects; empty if there is none."""
    return F.transform(F.coalesce(get(v, path, "array<variant>"), F.array()), lambda x: get(x, f"$.{field}"))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _object(v: Column) -> Column:
    return get(v, "$", "map<string,variant>").isNotNull()


def _no_address(v: Column) -> Column:
    """True for what is there, isn't empty, and is no text, so it can't be stripped."""
    return ~_kind(v).isin("STRING", "VOID") & ~F.coalesce(F.to_json(v), F.lit("0")).isin("0", "0.0", "false", "[]", "{}")


def _address_missing(field: str) -> Callable[[Column], Column]:
    return lambda x: _no_address(get(x, field, "variant"))


def _unreadable(v: Column, kind: str) -> Column:
    """True if a parser of this kind chokes on the payload: it is no object, a list has something else than objects where
    objects are read (in part or as a whole), or an address is no text."""
    why = [~_object(v)]
    items = lambda path: F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    for path, field in LISTS[kind]:
        why.append(F.exists(items(path), lambda x: ~_object(x)))
        if field:
            why.append(F.exists(items(path), _address_missing(field)))
    why += [(F.size(items(path)) > 0) & ~_object(F.get(items(path), 0)) for path in FIRSTS[kind]]
    why += [_no_address(get(v, path, "variant")) for path in SINGLE[kind]]
    return reduce(Column.__or__, why)


def route(raw: DataFrame) -> DataFrame:
    """(…, v, event_type, failure): what each raw event is, or why it can't be parsed.

    The payload is parsed below an explode, so that later filters and columns read what was parsed and don't parse anew.
    """
    v = F.try_parse_json("payload")
    kind = F.coalesce(*[F.when(F.col("source") == s, F.lit(t)) for s, t in TYPES.items()])
    raw = raw.select("*", F.explode(F.array(v)).alias("v")).withColumn("event_type", kind)
    bad = F.coalesce(F.col("v").isNull() | F.coalesce(*[F.when(F.col("event_type") == t, _unreadable(F.col("v"), t)) for t in LISTS]), F.lit(False))
    why = F.when(F.col("event_type").isNull(), F.concat(F.lit("unsupported_source:"), F.col("source"))).when(bad, F.lit("parse_error:shape"))
    return raw.withColumn("failure", why)


def failures(routed: DataFrame) -> DataFrame:
    return routed.where("failure is not null").select("raw_event_id", "source", F.col("failure").alias("reason"))


def _kept(routed: DataFrame, kind: str) -> DataFrame:
    return routed.where((F.col("event_type") == kind) & F.col("failure").isNull())


_HEAD = ("raw_event_id", "tenant_id", "user_id", "source", "source_event_id", "event_type")


def flatten_contacts(routed: DataFrame) -> DataFrame:
    """Names, addresses, phones, employer of contact events."""
    v = F.col("v")
    name = X.first_of(F.trim(get(v, "$.names[0].displayName")), F.trim(get(v, "$.name")))
    emails = X.addresses(F.concat(_texts(v, "$.emailAddresses", "value"), F.array(get(v, "$.email"))))
    phones = F.array_sort(F.array_distinct(F.filter(F.transform(_texts(v, "$.phoneNumbers", "value"), lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))))
    full = F.coalesce(name, F.lit("Unknown"))
    warn = F.when(name.isNull(), F.array(F.lit("missing_contact_name"))).otherwise(F.array().cast("array<string>"))
    return _kept(routed, "contact").select(
        *_HEAD, "occurred_at", full.alias("full_name"), X.first_name(name).alias("first_name"), X.last_name(name).alias("last_name"), emails.alias("emails"), phones.alias("phones"),
        X.first_of(get(v, "$.organizations[0].name"), get(v, "$.company")).alias("company"), X.first_of(get(v, "$.organizations[0].title"), get(v, "$.title")).alias("title"), warn.alias("warnings"),
    )


def _headers(v: Column) -> Column:
    """(name, value) of the headers: names lower, values only if they are texts."""
    heads = F.coalesce(get(v, "$.payload.headers", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda h: F.when(F.schema_of_variant(get(h, "$.value", "variant")) == "STRING", get(h, "$.value"))
    return F.transform(heads, lambda h: F.struct(F.lower(get(h, "$.name")).alias("name"), text(h).alias("value")))


def _header(heads: Column, name: str) -> Column:
    """The last header of that name whose value is a text."""
    own = F.filter(heads, lambda h: (h["name"] == name) & h["value"].isNotNull())
    return F.try_element_at(own, F.lit(-1))["value"]


def flatten_mail(routed: DataFrame) -> DataFrame:
    """Thread, subject, sender, recipients and time of mail events."""
    v, head = F.col("v"), lambda name: F.col(f"_head.{name}")
    subject = X.first_of(head("subject"), get(v, "$.subject"))
    listed = F.split(X.first_of(head("to"), F.array_join(get(v, "$.to", "array<string>"), ","), get(v, "$.to")), ",")
    ms = get(v, "$.internalDate")
    time = F.coalesce(X.header_date(head("date")), F.when(ms.rlike("^[0-9]+$"), F.timestamp_millis(ms.try_cast("long"))), F.col("occurred_at"))
    warn = F.when(subject.isNull(), F.array(F.lit("missing_subject"))).otherwise(F.array().cast("array<string>"))
    rows = _kept(routed, "email_message").select("*", F.explode(F.array(_headers(v))).alias("_heads"))
    rows = rows.select("*", F.explode(F.array(F.struct(*[_header(F.col("_heads"), name).alias(name) for name in ("subject", "to", "date", "from")]))).alias("_head"))
    return rows.select(
        *_HEAD, time.alias("occurred_at"), get(v, "$.threadId").alias("thread_id"), subject.alias("subject"), X.first_of(head("from"), get(v, "$.from")).alias("sender"),
        X.addresses(F.coalesce(listed, F.array().cast("array<string>"))).alias("recipients"), get(v, "$.snippet").alias("snippet"), warn.alias("warnings"),
    )


def flatten_calendar(routed: DataFrame) -> DataFrame:
    """C4: what, where, when and who of calendar events."""
    v = F.col("v")
    at = lambda k: X.first_of(get(v, f"$.{k}.dateTime"), get(v, f"$.{k}.date"))
    summary = X.blank_to_null(get(v, "$.summary"))
    warn = F.when(summary.isNull(), F.array(F.lit("missing_summary"))).otherwise(F.array().cast("array<string>"))
    return _kept(routed, "calendar_event").select(
        *_HEAD, "occurred_at", summary.alias("summary"), get(v, "$.location").alias("location"), at("start").alias("start_at"), at("end").alias("end_at"),
        X.addresses(_texts(v, "$.attendees", "email")).alias("attendees"), get(v, "$.status").alias("status"), warn.alias("warnings"),
    )


#: Field kinds of each event type: s string, l list of strings; ! required.
FIELDS = {
    "contact": {"full_name": "s!", "first_name": "s", "last_name": "s", "company": "s", "title": "s", "emails": "l", "phones": "l"},
    "email_message": {"thread_id": "s", "subject": "s", "from": "s", "snippet": "s", "to": "l", "occurred_at": "s!"},
    "calendar_event": {"summary": "s", "location": "s", "start_at": "s", "end_at": "s", "status": "s", "attendee_emails": "l"},
}


def validate(events: DataFrame) -> DataFrame:
    """Rows (event_type, normalized JSON text) with ``reason``: null if valid; valid rows are unchanged."""
    v = F.try_parse_json("normalized")
    events = events.withColumn("_v", v).withColumn("_s", F.schema_of_variant("_v"))

    def fault(name: str, kind: str) -> Column:
        s = F.schema_of_variant(get(F.col("_v"), f"$.{name}", "variant"))
        absent = s.isNull() | (s == "VOID")
        wrong = ~s.isin("STRING") if kind[0] == "s" else ~s.isin("ARRAY<STRING>", "ARRAY<VOID>")
        value = get(F.col("_v"), f"$.{name}")
        missing = (absent | (value == "")) if name == "full_name" else absent
        return F.when(missing, F.lit(f"missing:{name}") if kind.endswith("!") else F.lit(None)).when(~absent & wrong, F.lit(f"type:{name}"))

    per_type = [F.when(F.col("event_type") == t, F.coalesce(*[fault(n, k) for n, k in fs.items()])) for t, fs in FIELDS.items()]
    reason = F.when(~F.coalesce(F.col("_s").startswith("OBJECT"), F.lit(False)), F.lit("normalized_payload_not_object")).when(~F.col("event_type").isin(*FIELDS), F.concat(F.lit("unsupported_event_type:"), F.col("event_type"))).otherwise(F.coalesce(*per_type))
    return events.withColumn("reason", reason).drop("_v", "_s")


def _applied(df: DataFrame) -> DataFrame:
    return df.withColumn("warnings", F.array_append("warnings", F.lit("enrichment_applied")))


def enrich_contacts(contacts: DataFrame) -> DataFrame:
    """Employer and role in title case, and sorted tags from them."""
    rows = _applied(contacts).withColumns({"company": X.title_case(F.col("company")), "title": X.title_case(F.col("title"))})
    return rows.withColumn("tags", F.array_sort(F.array_compact(F.array(X.tag("company", F.col("company")), X.tag("title", F.col("title"))))))


def enrich_mail(mail: DataFrame) -> DataFrame:
    return _applied(mail).withColumns({"sender": F.lower(F.trim("sender")), "recipients": X.addresses(F.col("recipients"))})


def enrich_calendar(meetings: DataFrame) -> DataFrame:
    return _applied(meetings).withColumn("attendees", X.addresses(F.col("attendees")))


def canonical_hash(df: DataFrame, *fields: str) -> DataFrame:
    """sha256 of the fields as JSON in sorted order."""
    return df.withColumn("canonical_hash", F.sha2(F.to_json(F.struct(*sorted(fields))), 256))


def normalized(contacts: DataFrame, mail: DataFrame, meetings: DataFrame) -> DataFrame:
    """(raw_event_id, source, event_type, normalized): flattened events as the JSON texts that validate() reads."""
    text = lambda **cols: F.to_json(F.struct(*[F.col(c).alias(k) for k, c in cols.items()])).alias("normalized")
    head = ("raw_event_id", "source", "event_type")
    mail = mail.withColumn("occurred_at", F.col("occurred_at").cast("string"))
    out = contacts.select(*head, text(**{k: k for k in FIELDS["contact"]}))
    out = out.unionByName(mail.select(*head, text(thread_id="thread_id", subject="subject", **{"from": "sender"}, snippet="snippet", to="recipients", occurred_at="occurred_at")))
    return out.unionByName(meetings.select(*head, text(summary="summary", location="location", start_at="start_at", end_at="end_at", status="status", attendee_emails="attendees")))


def stored(events: DataFrame, run_id: str, parsed_at: Column, *fields: str) -> DataFrame:
    """Canonical rows as they are kept: stamped with run, status, versions and the hash of ``fields``."""
    stamps = {"run_id": F.lit(run_id), "parse_status": F.lit("parsed"), "schema_version": F.lit(SCHEMA_VERSION), "parser_version": F.lit(PARSER_VERSION), "parsed_at": parsed_at}
    return canonical_hash(events, *fields).withColumns(stamps)


def put(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows under (raw event, type, parser version); the last put wins."""
    return upsert(store, rows.select(*store.columns), ["raw_event_id", "event_type", "parser_version"], ["parsed_at"])


def ingest_counts(routed: DataFrame, validated: DataFrame, enriched: DataFrame) -> DataFrame:
    """For each source the raw, parsed and failed events, and of the parsed the valid, invalid and enriched ones."""
    valid = validated.groupBy("source").agg(F.count_if(F.col("reason").isNull()).alias("valid"), F.count("reason").alias("invalid"))
    rich = enriched.groupBy("source").agg(F.count("*").alias("enriched"))
    return counts(routed).join(valid, "source", "left").join(rich, "source", "left").na.fill(0, ["valid", "invalid", "enriched"])


def counts(routed: DataFrame) -> DataFrame:
    """Raw, parsed and failed events of each source, in one pass."""
    return routed.groupBy("source").agg(F.count("*").alias("raw"), F.count_if(F.col("failure").isNull()).alias("parsed"), F.count_if(F.col("failure").isNotNull()).alias("failed"))
