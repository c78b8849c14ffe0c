"""Interactions from mail and meetings, and relationship strength."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.session import materialise

from .entities import resolve
from .upsert import latest_by, upsert

INTERACTION = ["tenant_id", "source", "touchpoint_type", "occurred_at", "actor", "target", "topic", "source_event_id"]
EVIDENCE, FULL_STRENGTH = 5, 10
#: Events that a task expands to pairs, about. A key of more events than MOST_EVENTS and than one CROWDED-th of all is crowded; so at most CROWDED keys are.
EVENTS, MOST_EVENTS, CROWDED = 50_000, 100_000, 2_000


def from_mail(mail: DataFrame) -> DataFrame:
    """Sender to each recipient; empty addresses and self go."""
    who = F.struct(X.address(F.col("sender")).alias("actor"), F.transform("recipients", lambda a: X.address(a)).alias("to"))
    rows = mail.select("tenant_id", "source", F.lit("email").alias("touchpoint_type"), "occurred_at", F.col("subject").alias("topic"), "source_event_id", F.explode(F.array(who)).alias("_who"))
    rows = rows.select("*", F.col("_who.actor").alias("actor"), F.explode("_who.to").alias("target"))
    return rows.where("actor <> target").select(*INTERACTION)


def from_meetings(meetings: DataFrame) -> DataFrame:
    """R2: every ordered pair of the attendees of a meeting of two or more; arrays are expanded, nothing is joined.

    Addresses are read once for each attendee, not for each pair.
    """
    who = F.transform("attendees", lambda a: X.address(a))
    rows = meetings.where(F.size("attendees") > 1).select("tenant_id", "source", F.lit("meeting").alias("touchpoint_type"), "occurred_at", F.col("summary").alias("topic"), "source_event_id", F.explode(F.array(who)).alias("_who"))
    rows = rows.select("*", F.explode("_who").alias("actor")).select("*", F.explode("_who").alias("target"))
    return rows.where("actor <> target").select(*INTERACTION)


def strength(interactions: DataFrame) -> DataFrame:
    """Count, capped strength, first and last time of each directed pair."""
    n = F.count("*")
    return interactions.groupBy("tenant_id", "actor", "target").agg(n.alias("interaction_count"), F.round(F.least(F.lit(1.0), n / F.lit(float(FULL_STRENGTH))), 4).alias("strength"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


#: Bits: whose interactions a row of sides() has: mail from one to other, from other to one, meetings of both.
OUT, BACK, MET = 1, 2, 4


def sides(events: DataFrame) -> DataFrame:
    """(tenant_id, one, other, out, back, met): of each two people how they are in touch, with one < other.

    events: (tenant_id, occurred_at, way, one, others): rows of MET with one and those of an event's people who come after,
    or of OUT and BACK with those to or from whom the mail is; one row may be of several. out, back, met: (n, first_at,
    last_at) or null.

    Rows are shuffled to where ``one`` is and are made into pairs there. People with very many rows (one CROWDED-th of all)
    are dealt out by pair, which combines before the shuffle.
    """
    keys = ["tenant_id", "one"]
    events = events.where(F.size("others") > 0)
    counts = materialise(events.groupBy(*keys).agg(F.count("*").alias("_n")), "rows-of-people")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n")).first()["n"]
    crowded = counts.where(F.col("_n") > max(MOST_EVENTS, total // CROWDED)).select(*keys)

    def pairs(rows: DataFrame) -> DataFrame:
        rows = rows.select(*keys, "way", "occurred_at", F.explode("others").alias("other"))
        has = lambda way: F.col("way").bitwiseAND(way) != 0
        n = lambda way: F.count_if(has(way))
        at = lambda f, way: f(F.when(has(way), F.col("occurred_at")))
        found = rows.groupBy(*keys, "other").agg(*[x.alias(f"_{f}{way}") for way in (OUT, BACK, MET) for f, x in (("n", n(way)), ("a", at(F.min, way)), ("z", at(F.max, way)))])
        return found.select(*keys, "other", *[F.when(F.col(f"_n{way}") > 0, F.struct(F.col(f"_n{way}").alias("n"), F.col(f"_a{way}").alias("first_at"), F.col(f"_z{way}").alias("last_at"))).alias(c) for way, c in ((OUT, "out"), (BACK, "back"), (MET, "met"))])

    parts = max(1, -(-total // (EVENTS * 2)))
    if crowded.isEmpty():
        return pairs(events.repartition(parts, *keys))
    light = events.join(F.broadcast(crowded), keys, "left_anti").repartition(parts, *keys)
    return pairs(light).unionByName(pairs(events.join(F.broadcast(crowded), keys, "left_semi")))


def sides_of(mail: DataFrame, meetings: DataFrame) -> DataFrame:
    """sides() of all mail and meetings, by address: what from_mail() and from_meetings() make pairs of."""
    some = lambda c: F.filter(c, lambda a: a.isNotNull())
    row = lambda way, one, others: F.struct(F.lit(way).cast("byte").alias("way"), one.alias("one"), others.alias("others"))
    a, b, w = F.col("_who.a"), F.col("_who.b"), F.col("_who")
    sent = mail.select("tenant_id", "occurred_at", F.explode(F.array(F.struct(X.address(F.col("sender")).alias("a"), some(F.transform("recipients", lambda x: X.address(x))).alias("b")))).alias("_who")).where(a.isNotNull())
    out = F.array(row(OUT, a, F.filter(b, lambda x: x > a)))
    sent = sent.select("tenant_id", "occurred_at", F.inline(F.concat(out, F.transform(F.filter(b, lambda x: x < a), lambda x: row(BACK, x, F.array(a))))))
    met = meetings.select("tenant_id", "occurred_at", F.explode(F.array(F.array_sort(some(F.transform("attendees", lambda x: X.address(x)))))).alias("_who"))
    met = met.select("tenant_id", "occurred_at", F.inline(F.transform(w, lambda x, k: row(MET, x, F.filter(F.slice(w, k + 2, F.size(w)), lambda y: y > x)))))
    return sides(sent.unionByName(met))


def ways(pairs: DataFrame, one: str = "one", other: str = "other", into: tuple[str, str] = ("actor", "target"), kinds: bool = False) -> DataFrame:
    """strength() of sides(): each way of a pair, from ``one`` to ``other`` and back, if there is an interaction that way.

    kinds: one column more, of which kinds they are: 1 mail, 2 meetings, 3 both.
    """
    n = lambda s: F.coalesce(F.col(s)["n"], F.lit(0))
    kind = (F.when(F.col("mail.n") > 0, 1).otherwise(0) + F.when(F.col("met.n") > 0, 2).otherwise(0)).alias("kinds")
    each = lambda a, b, mail: F.struct(F.col(a).alias(into[0]), F.col(b).alias(into[1]), F.col(mail).alias("mail"))
    rows = pairs.select("tenant_id", "met", F.inline(F.array(each(one, other, "out"), each(other, one, "back")))).where("mail is not null or met is not null")
    rows = rows.select("tenant_id", *into, (n("mail") + n("met")).alias("interaction_count"), F.least("mail.first_at", "met.first_at").alias("first_at"), F.greatest("mail.last_at", "met.last_at").alias("last_at"), *([kind] if kinds else []))
    full = F.round(F.least(F.lit(1.0), F.col("interaction_count") / F.lit(float(FULL_STRENGTH))), 4).alias("strength")
    return rows.select("tenant_id", *into, "interaction_count", full, "first_at", "last_at", *(["kinds"] if kinds else []))


def strength_of(mail: DataFrame, meetings: DataFrame) -> DataFrame:
    """strength() of all mail and meetings. Pairs are made after the shuffle, once for both ways."""
    return ways(sides_of(mail, meetings))


def evidence(interactions: DataFrame) -> DataFrame:
    """The latest EVIDENCE interactions of each pair, oldest first. Only those are kept while grouping.

    Rows are sorted once, by a hash of the actor before the pair itself; a pair's latest row takes those next to it.
    """
    item = F.struct("occurred_at", "touchpoint_type", "source_event_id", "source", "topic")
    pair = ["tenant_id", "actor", "target"]
    w = Window.partitionBy("_actor", *pair).orderBy(F.desc("occurred_at"), F.desc("touchpoint_type"), F.desc("source_event_id"))
    last = interactions.withColumn("_actor", F.xxhash64("actor")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= EVIDENCE)
    last = last.withColumn("_items", F.collect_list(item).over(w.rowsBetween(0, EVIDENCE - 1)))
    return last.where("_n = 1").select(*pair, F.array_sort("_items").alias("evidence"))


def facts(interactions: DataFrame, entities: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Interactions with both people resolved, once for each (tenant, actor, target, type, time).

    columns: those of the interactions that are wanted beside these, by default all; others aren't shuffled. Rows are sorted
    by a hash of the actor first, since tenants and beginnings of ids hardly tell rows apart.
    """
    rows = resolve(resolve(interactions, entities, "actor", "actor_id"), entities, "target", "target_id").where("actor_id is not null and target_id is not null")
    keys = ["tenant_id", "actor_id", "target_id", "touchpoint_type", "occurred_at"]
    if columns is not None:
        rows = rows.select(*keys, "source_event_id", *[c for c in columns if c not in (*keys, "source_event_id")])
    return latest_by(rows.withColumn("_actor", F.xxhash64("actor_id")), ["_actor", *keys], ["source_event_id"]).drop("_actor")


def _events(mail: DataFrame, meetings: DataFrame) -> DataFrame:
    """(tenant_id, touchpoint_type, occurred_at, source_event_id, who): what from_mail() and from_meetings() make pairs of.

    who: (address, k, acts, hears) of each address of an event; k tells the event's addresses apart, and pairs are of one who
    acts and one who hears.
    """
    head = ["tenant_id", "touchpoint_type", "occurred_at", "source_event_id"]
    one = lambda a, all_, acts, hears: F.struct(a.alias("address"), F.array_position(all_, a).cast("int").alias("k"), F.lit(acts).alias("acts"), F.lit(hears).alias("hears"))
    some = lambda c: F.filter(c, lambda a: a.isNotNull())
    sent = mail.withColumns({"touchpoint_type": F.lit("email"), "_from": F.array(X.address(F.col("sender"))), "_to": F.transform("recipients", lambda a: X.address(a))}).select(*head, F.explode(F.array(F.struct(some(F.col("_from")).alias("a"), some(F.col("_to")).alias("b")))).alias("_who"))
    both = F.concat("_who.a", "_who.b")
    sent = sent.select(*head, F.concat(F.transform("_who.a", lambda a: one(a, both, True, False)), F.transform("_who.b", lambda a: one(a, both, False, True))).alias("who"))
    met = meetings.withColumn("touchpoint_type", F.lit("meeting")).select(*head, F.explode(F.array(some(F.transform("attendees", lambda a: X.address(a))))).alias("_who"))
    return sent.unionByName(met.select(*head, F.transform("_who", lambda a: one(a, F.col("_who"), True, True)).alias("who")))


def facts_of(mail: DataFrame, meetings: DataFrame, entities: DataFrame) -> DataFrame:
    """facts() of all mail and meetings with no column beside the keys: (tenant, actor, target, type, time, source_event_id).

    People are resolved once for each address of an event, and events are shuffled to where their type and time are; they are
    made into pairs there, so pairs are never shuffled. Times at which very many events are (one CROWDED-th of all) go by
    facts(), whose rows are dealt out by pair.
    """
    at = ["tenant_id", "touchpoint_type", "occurred_at"]
    events = _events(mail, meetings)
    counts = materialise(events.groupBy(*at).agg(F.count("*").alias("_n")), "events-of-times")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n")).first()["n"]
    crowded = counts.where(F.col("_n") > max(MOST_EVENTS, total // CROWDED)).select(*at)
    full = not crowded.isEmpty()
    few = F.broadcast(crowded.select(*[F.col(c).alias(f"_{c}") for c in at]))
    here = F.lit(True)
    for c in at:
        here = here & F.col(c).eqNullSafe(F.col(f"_{c}"))

    rows = events.join(few, here, "left_anti") if full else events
    rows = rows.withColumn("_event", F.monotonically_increasing_id()).select(*at, "source_event_id", "_event", F.explode("who").alias("w"))
    rows = resolve(rows.select(*at, "source_event_id", "_event", "w.*"), entities, "address", "id").where("id is not null")
    rows = rows.repartition(max(1, -(-total // EVENTS)), *at).groupBy(*at, "_event", "source_event_id").agg(F.collect_list(F.struct("id", "k", "acts", "hears")).alias("who"))
    pairs = rows.select(*at, "source_event_id", "who", F.inline(F.filter("who", lambda a: a["acts"])))
    pairs = pairs.select(*at, "source_event_id", F.col("id").alias("actor_id"), F.explode(F.filter("who", lambda b: b["hears"] & (b["k"] != F.col("k")))["id"]).alias("target_id"))
    out = latest_by(pairs.withColumn("_actor", F.xxhash64("actor_id")), ["_actor", "tenant_id", "actor_id", "target_id", "touchpoint_type", "occurred_at"], ["source_event_id"])
    columns = ["tenant_id", "actor_id", "target_id", "touchpoint_type", "occurred_at", "source_event_id"]
    if full:
        out = out.unionByName(facts(from_mail(mail).unionByName(from_meetings(meetings)).join(few, here, "left_semi"), entities, ()), allowMissingColumns=True)
    return out.select(*columns)


RELATION = ["tenant_id", "from_id", "to_id", "relationship_type", "interaction_count", "strength", "first_at", "last_at"]


def relations_of(mail: DataFrame, meetings: DataFrame, entities: DataFrame) -> DataFrame:
    """R5 by entity: (tenant_id, from_id, to_id, interaction_count, strength, first_at, last_at); unresolved pairs go.

    People are resolved before a pair becomes two rows: the first where the pairs are, the second by one shuffle of them.
    """
    rows = resolve(resolve(sides_of(mail, meetings), entities, "one", "one_id").where("one_id is not null"), entities, "other", "other_id").where("other_id is not null")
    return ways(rows, "one_id", "other_id", ("from_id", "to_id"))


def put_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Direct relations (tenant_id, from_id, to_id, measures) put into the table: measures are overwritten."""
    keys = ["tenant_id", "from_id", "to_id"]
    old, direct = relations.select(*RELATION), F.col("relationship_type").eqNullSafe(F.lit("direct"))
    # The type is the same in all that meet. As a key it would be a constant, and keys of other rows are shuffled anew for a join.
    put = upsert(old.where(direct).drop("relationship_type"), new, keys, ["last_at"])
    return put.withColumn("relationship_type", F.lit("direct")).select(*RELATION).unionByName(old.where(~direct))


def upsert_relations(relations: DataFrame, strengths: DataFrame, entities: DataFrame) -> DataFrame:
    """Strengths by entity; unresolved pairs go; measures are overwritten."""
    rows = resolve(resolve(strengths, entities, "actor", "from_id"), entities, "target", "to_id").where("from_id is not null and to_id is not null")
    return put_relations(relations, rows.select("tenant_id", "from_id", "to_id", "interaction_count", "strength", "first_at", "last_at"))
