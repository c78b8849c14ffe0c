"""Sources: raw provider payloads to event envelopes, admission, validation of envelopes, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = ("google_contacts", "gmail", "google_calendar", "linkedin", "twitter", "csv_import")
#: The key whose list a source's payload must have; any source that is not here needs ``profiles``.
LISTS = {"google_contacts": "contacts", "gmail": "messages"}


def get(v: Column, path: str, kind: str = "string") -> Column:
    """A value of a VARIANT column by path; null if it is missing or of another shape."""
    return F.try_variant_get(v, path, kind)


def unwrap(files: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """One row for each element of the first list key that the payload has, or the payload itself; column ``item``."""
    v = F.try_parse_json("payload")
    items = F.coalesce(*[get(v, f"$.{k}", "array<variant>") for k in lists], F.array(v))
    return files.select("*", F.explode(items).alias("item")).drop("payload")


def _events(rows: DataFrame, source: str, id_path: str, time: Column) -> DataFrame:
    """The envelope. A payload without an id gets the hash of its content, so reruns agree."""
    body = F.to_json("item")
    ident = F.coalesce(F.nullif(get(F.col("item"), id_path), F.lit("")), F.sha2(body, 256))
    return rows.select("tenant_id", "user_id", "trace_id", F.lit(source).alias("source"), ident.alias("source_event_id"), time.alias("occurred_at"), body.alias("payload"))


def contacts(files: DataFrame, as_of: Column) -> DataFrame:
    """Contact events; time is the first metadata source's update time."""
    t = F.try_to_timestamp(get(F.col("item"), "$.metadata.sources[0].updateTime"))
    return _events(unwrap(files, ("connections", "contacts")), "google_contacts", "$.resourceName", F.coalesce(t, as_of))


def mail(files: DataFrame, as_of: Column) -> DataFrame:
    """Mail events; time from the digits of internalDate, in milliseconds."""
    ms = get(F.col("item"), "$.internalDate")
    t = F.when(ms.rlike("^[0-9]+$"), F.timestamp_millis(ms.try_cast("long")))
    return _events(unwrap(files, ("messages",)), "gmail", "$.id", F.coalesce(t, as_of))


def calendar(files: DataFrame, as_of: Column) -> DataFrame:
    """S3: calendar events; time is updated, else created."""
    item = F.col("item")
    t = F.coalesce(F.try_to_timestamp(get(item, "$.updated")), F.try_to_timestamp(get(item, "$.created")), as_of)
    return _events(unwrap(files, ("items", "events")), "google_calendar", "$.id", t)


def together(*events: DataFrame) -> DataFrame:
    """All sources in one."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e)
    return out


def by_source(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count("*").alias("n"))


def admission(payloads: DataFrame) -> DataFrame:
    """(…, accepted, records, shape) for rows (source, payload): the source's key must hold a non-empty list.

    shape: ``empty_object``, the type of the sole value, or ``object``.
    """
    v = F.try_parse_json("payload")
    key = F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for s, k in LISTS.items()], F.lit("profiles"))
    size = F.coalesce(*[F.when(key == k, F.size(get(v, f"$.{k}", "array<variant>"))) for k in (*LISTS.values(), "profiles")], F.lit(0))
    top = F.map_values(get(v, "$", "map<string,variant>"))
    kind = F.schema_of_variant(F.get(top, 0))
    sole = F.when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "dict").when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "NoneType").when(kind == "BIGINT", "int").otherwise("float")
    shape = F.when(F.size(top) == 0, "empty_object").when(F.size(top) == 1, sole).otherwise("object")
    return payloads.select("*", (size > 0).alias("accepted"), F.greatest(size, F.lit(0)).alias("records"), shape.alias("shape"))


ENVELOPE = ("tenant_id", "user_id", "source", "source_event_id", "occurred_at", "trace_id", "payload")


def envelope_faults(events: DataFrame) -> DataFrame:
    """Each event with ``fault``: the first field that is missing, ``unknown source``, or null."""
    missing = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}")) for c in ENVELOPE]
    return events.select("*", F.coalesce(*missing, F.when(~F.col("source").isin(*SOURCES), F.lit("unknown source"))).alias("fault"))


def check_envelopes(events: DataFrame) -> DataFrame:
    """Valid events; an empty batch is an error."""
    if events.isEmpty():
        raise ValueError("no events in the batch")
    return envelope_faults(events).where("fault is null").drop("fault")


NATURAL_KEY = ("tenant_id", "user_id", "source", "source_event_id")


def capture(store: DataFrame, events: DataFrame) -> DataFrame:
    """The raw store after ``events`` are put under their natural key; the last captured of a key wins."""
    from kinloom.operators.upsert import upsert

    return upsert(store, events.select(*store.columns), list(NATURAL_KEY), ["captured_at", "occurred_at"])


def stamped(events: DataFrame, run_id: str, captured_at: Column, ingest_version: str = "v1") -> DataFrame:
    """Events as they are captured: by which run, when, and under which version."""
    return events.withColumns({"run_id": F.lit(run_id), "captured_at": captured_at, "ingest_version": F.lit(ingest_version)})


def payload_size(df: DataFrame) -> DataFrame:
    """Bytes of the payload text."""
    return df.withColumn("payload_size_bytes", F.octet_length("payload"))


def cursor(events: DataFrame, keys: list[str]) -> DataFrame:
    """The high-water mark of each key."""
    return events.groupBy(*keys).agg(F.max("occurred_at").alias("last_event_at"))


def after_cursor(events: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Events beyond their key's mark, or of keys without one."""
    return events.join(marks, keys, "left").where(F.col("last_event_at").isNull() | (F.col("occurred_at") > F.col("last_event_at"))).drop("last_event_at")


def of_trace(rows: DataFrame, trace_id: str, *columns: str) -> DataFrame:
    """The raw or canonical events of one trace, in order; the filter and the columns reach the scan."""
    found = rows.where(F.col("trace_id") == trace_id)
    return (found.select(*columns) if columns else found).orderBy("raw_event_id")


def of_tenant(rows: DataFrame, tenant: str, *columns: str, tenant_col: str = "tenant_id") -> DataFrame:
    """A tenant's rows; the filter and the columns reach the scan."""
    found = rows.where(F.col(tenant_col) == tenant)
    return found.select(*columns) if columns else found
