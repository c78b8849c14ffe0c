"""All layers over a batch of raw events, into tables that grow from batch to batch (ST1, ST3).

A batch goes through routing, flattening and enrichment; its canonical rows, people, identities, relations and documents
are put into keyed tables; the graph is projected from these. A batch that is run again puts the same rows under the same
keys. The canonical rows of another parser version stand beside those of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.session import materialise

from . import canonical as C
from . import documents as D
from . import entities as E
from . import graph as G
from . import relations as R
from .keyed import KeyedTable

KEYS = {
    "canonical": ["raw_event_id", "event_type", "parser_version"],
    "entities": ["entity_id"],
    "identities": ["source_identity", "source", "tenant_id"],
    "relations": ["from_id", "to_id", "tenant_id", "relationship_type"],
    "documents": ["entity_id", "doc_type", "content", "tenant_id"],
}


class Layers:
    """The tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.tables = {name: KeyedTable(spark, f"{path}/{name}", keys) for name, keys in KEYS.items()}

    def _put(self, name: str, rows: DataFrame, order: list[str], ready: bool = False, **how: tuple[str, ...]) -> None:
        table = self.tables[name]
        if table.versions():
            table.put(rows, order, ready=ready, **how)
        elif ready:
            table.create(rows, order)
        else:
            table.create(D.latest_by(rows, table.keys, order))

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        """A table's rows; before anything was put, no rows of the columns of ``like``."""
        return self.tables[name].read() if like is None or self.tables[name].versions() else like.where(F.lit(False))

    def run(self, raw: DataFrame, run_id: str, as_of: Column, parser_version: str = C.PARSER_VERSION) -> dict[str, int]:
        """Put a batch of raw events (…, trace_id) and return how many rows it had for each layer."""
        routed = C.route(raw)  # Not written: it would hold every payload twice. Each layer parses its own source's events alone.
        contacts = materialise(C.enrich_contacts(C.flatten_contacts(routed)), "contacts", dense=True)
        mail = materialise(C.enrich_mail(C.flatten_mail(routed)), "mail", dense=True)
        meetings = materialise(C.enrich_calendar(C.flatten_calendar(routed)), "meetings", dense=True)
        head = ["raw_event_id", "tenant_id", "event_type", "source", "source_event_id"]
        label = lambda c: F.coalesce(c, F.lit("")).alias("label")
        rows = contacts.select(*head, label(F.col("full_name"))).unionByName(mail.select(*head, label(F.col("subject")))).unionByName(meetings.select(*head, label(F.col("summary"))))
        rows = materialise(C.stored(rows, run_id, as_of, "label", "source_event_id").withColumn("parser_version", F.lit(parser_version)), "canonical-rows", dense=True)
        self._put("canonical", rows, ["parsed_at"], ready=True)

        found = E.merge(E.candidates(contacts))
        known = self.read("identities", E.entity_id(found).select("tenant_id", "source", "source_identity", "entity_id"))
        there = self.read("entities", E.entity_id(found).select("tenant_id", "primary_email", "entity_id"))
        people = materialise(E.lookup(found, known, there).withColumn("entity_id", F.coalesce("entity_id", F.sha2("merge_key", 256))), "people", dense=True)
        self._put("entities", people.select(*E.ENTITY, "raw_event_id"), ["raw_event_id"], keep=("tenant_id",), fill=("primary_email", "company", "title"))
        self._put("identities", people.select("source_identity", "source", "tenant_id", "entity_id", "primary_email", "raw_event_id"), ["raw_event_id"])

        everyone = self.read("entities")
        pairs = materialise(R.relations_of(mail, meetings, everyone).withColumn("relationship_type", F.lit("direct")).select(*R.RELATION), "pairs", dense=True)
        self._put("relations", pairs, ["last_at"], ready=True)

        texts = D.contact_documents(contacts).unionByName(D.mail_documents(mail)).unionByName(D.calendar_documents(meetings))
        texts = D.bind(texts, everyone).where("entity_id is not null").select(*KEYS["documents"], "owner_email", "source_event_id", "source_updated_at")
        texts = materialise(texts, "bound-documents", dense=True)
        self._put("documents", texts, ["source_updated_at", "source_event_id"])
        return {"raw": raw.count(), "failed": routed.where("failure is not null").count(), "canonical": rows.count(), "people": people.count(), "relations": pairs.count(), "documents": texts.count()}

    def graph(self) -> dict[str, DataFrame]:
        """The projection of what is there: people, their employers, and who knows whom."""
        people = self.read("entities").withColumnsRenamed({"raw_event_id": "seq"}).withColumn("location", F.lit(None).cast("string"))
        knows = self.read("relations").withColumn("evidence", F.array().cast("array<struct<touchpoint_type:string>>"))
        return {"Person": G.persons(people), "Company": G.companies(people), "WORKS_AT": G.works_at(people), "KNOWS": G.knows(knows)}
