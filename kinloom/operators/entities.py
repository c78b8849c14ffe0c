"""People: candidates, exact-match merge, identity lookup, upserts, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import text as X

from .upsert import latest_by, upsert


def candidates(contacts: DataFrame) -> DataFrame:
    """One candidate for each enriched contact; the first address is the primary one."""
    return contacts.select("raw_event_id", "tenant_id", "source", F.col("source_event_id").alias("source_identity"), F.coalesce(X.blank_to_null(F.col("full_name")), F.lit("Unknown")).alias("display_name"), F.get("emails", 0).alias("primary_email"), "company", "title", "tags")


def merge_key(df: DataFrame) -> DataFrame:
    by_email = F.concat(F.col("tenant_id"), F.lit(":email:"), F.col("primary_email"))
    by_source = F.concat(F.col("tenant_id"), F.lit(":source:"), F.col("source"), F.lit(":"), F.col("source_identity"))
    return df.withColumn("merge_key", F.coalesce(by_email, by_source))


def merge(cands: DataFrame) -> DataFrame:
    """The last candidate of each address, or of each source identity where there is no address."""
    return latest_by(merge_key(cands), ["merge_key"], ["raw_event_id"])


def entity_id(df: DataFrame) -> DataFrame:
    return df.withColumn("entity_id", F.sha2("merge_key", 256))


def lookup(merged: DataFrame, identities: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity_id`` by source identity, else by address, else null."""
    by_identity = identities.select("tenant_id", "source", "source_identity", F.col("entity_id").alias("_a"))
    by_email = entities.where("primary_email is not null").select("tenant_id", "primary_email", F.col("entity_id").alias("_b"))
    out = merged.join(by_identity, ["tenant_id", "source", "source_identity"], "left").join(by_email, ["tenant_id", "primary_email"], "left")
    return out.withColumn("entity_id", F.coalesce("_a", "_b")).drop("_a", "_b")


ENTITY = ["entity_id", "tenant_id", "display_name", "primary_email", "company", "title", "tags"]


def upsert_entities(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Names and tags are overwritten; addresses and employers only by values."""
    rows = resolved.select(*ENTITY, "raw_event_id")
    old = entities.select(*ENTITY, F.lit(0).cast("long").alias("raw_event_id"))
    return upsert(old, rows, ["entity_id"], ["raw_event_id"], keep=("tenant_id",), fill=("primary_email", "company", "title")).drop("raw_event_id")


def upsert_identities(identities: DataFrame, resolved: DataFrame) -> DataFrame:
    """E5: the entity of each source identity."""
    new = resolved.select("tenant_id", "source", "source_identity", "entity_id", "primary_email", "raw_event_id", F.lit(1.0).cast("decimal(5,4)").alias("confidence"), F.lit(True).alias("is_primary"))
    return upsert(identities, new, ["tenant_id", "source", "source_identity"], ["raw_event_id"], keep=("confidence", "is_primary"))


def metadata(contacts: DataFrame) -> DataFrame:
    """What a contact with an address tells of its person; tags are the old ones lower-cased and the computed ones."""
    c = F.col
    tags = F.array_sort(F.array_union(F.transform("tags", lambda t: F.lower(t)), F.array_compact(F.array(X.tag("company", c("company")), X.tag("title", c("title"))))))
    return contacts.where(F.size("emails") > 0).select("tenant_id", "raw_event_id", F.get("emails", 0).alias("primary_email"), X.squish(c("company")).alias("company_norm"), X.squish(c("title")).alias("title_norm"), "full_name", tags.alias("tags"), F.col("source_event_id").alias("source_id"))


def merge_metadata(entities: DataFrame, found: DataFrame) -> DataFrame:
    """Entities with metadata layered on by (tenant, address): of each field the last value that isn't null wins."""
    last = lambda c: F.max_by(c, "raw_event_id").alias(f"_{c}")
    some = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("raw_event_id"))).alias(f"_{c}")
    layered = found.groupBy("tenant_id", "primary_email").agg(some("company_norm"), some("title_norm"), some("full_name"), last("tags"), F.count("*").alias("_n"))
    out = entities.join(layered, ["tenant_id", "primary_email"], "left")
    return out.withColumns({"display_name": F.coalesce("_full_name", "display_name"), "company": F.coalesce("_company_norm", "company"), "title": F.coalesce("_title_norm", "title"), "tags": F.coalesce("_tags", "tags"), "updates": F.coalesce("_n", F.lit(0))}).select(*ENTITY, "updates")


def layer_metadata(entities: DataFrame, found: DataFrame) -> DataFrame:
    """Entities (…, metadata map) with the maps of ``found`` (tenant_id, primary_email, raw_event_id, metadata) laid on.

    Key by key: of each key the last value wins, null values too; keys that no update has keep the entity's value. Keys are
    reduced before they are brought together, so an address with very many updates is no large group.
    """
    each = found.where("primary_email is not null").select("tenant_id", "primary_email", "raw_event_id", F.explode("metadata").alias("key", "value"))
    last = each.groupBy("tenant_id", "primary_email", "key").agg(F.max_by(F.struct("value"), "raw_event_id").alias("v"))
    new = last.groupBy("tenant_id", "primary_email").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("v.value").alias("value")))).alias("_new"))
    old = F.coalesce("metadata", F.expr("CAST(map() AS MAP<STRING, STRING>)"))
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
    out = entities.join(new, ["tenant_id", "primary_email"], "left")
    return out.withColumn("metadata", F.when(F.col("_new").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, "_new"))).select(*entities.columns)


def resolve(df: DataFrame, entities: DataFrame, email: str, out: str) -> DataFrame:
    """``out``: the entity of (tenant, ``email``), null if there is none."""
    who = entities.where("primary_email is not null").select(F.col("tenant_id").alias("_t"), F.col("primary_email").alias("_e"), F.col("entity_id").alias(out))
    return df.join(who, (F.col("tenant_id") == F.col("_t")) & (F.col(email) == F.col("_e")), "left").drop("_t", "_e")
