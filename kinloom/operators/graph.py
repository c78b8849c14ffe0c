"""The property graph as DataFrames: four node sets, six edge sets, their sinks, checks and mirrors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.session import materialise

from .joins import BROADCAST_BYTES, heavy_keys, measured, split_join
from .upsert import upsert

LISTS = ("topics", "skills", "interests", "tags")


def company_id(name: Column) -> Column:
    return F.concat(F.lit("cmp_"), X.slug(name))


def topic_id(name: Column) -> Column:
    return F.concat(F.lit("top_"), X.slug(name))


def persons(entities: DataFrame) -> DataFrame:
    """G1."""
    return entities.select("tenant_id", "entity_id", F.coalesce(X.blank_to_null(F.col("display_name")), F.lit("Unknown")).alias("name"), "primary_email", X.domain(F.col("primary_email")).alias("domain"), F.col("title").alias("seniority"), "location")


def companies(entities: DataFrame) -> DataFrame:
    """One for each id; the first entity gives name and location, the first with an address the domain."""
    rows = entities.where(F.trim("company") != "").withColumn("company_id", company_id(F.col("company"))).withColumn("_d", X.domain(F.col("primary_email")))
    return rows.groupBy("tenant_id", "company_id").agg(F.min_by("company", "seq").alias("name"), F.min_by("location", "seq").alias("location"), F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col("seq"))).alias("domain"))


def topic_mentions(entities: DataFrame) -> DataFrame:
    """G3, exploded: a row for each list element of each entity, with the list's name as its source."""

    def tagged(k: str) -> Column:
        if k not in entities.columns:
            return F.array().cast("array<struct<name:string,source:string>>")
        return F.transform(F.coalesce(F.col(k), F.array().cast("array<string>")), lambda x: F.struct(F.trim(x).alias("name"), F.lit(k).alias("source")))

    rows = entities.select("tenant_id", "entity_id", "seq", F.explode(F.concat(*map(tagged, LISTS))).alias("t"))
    return rows.select("tenant_id", "entity_id", "seq", F.col("t.name").alias("topic"), F.col("t.source").alias("source")).where("topic <> ''")


def topics(mentions: DataFrame) -> DataFrame:
    """One node for each topic id, named as first seen."""
    return mentions.withColumn("topic_id", topic_id(F.col("topic"))).groupBy("tenant_id", "topic_id").agg(F.min_by("topic", F.struct("seq", "topic")).alias("name"))


def users(tenant_users: DataFrame) -> DataFrame:
    """G4."""
    return tenant_users.select("tenant_id", "user_id", F.coalesce(X.blank_to_null(F.col("name")), F.col("user_id")).alias("name"), "email", F.coalesce(X.blank_to_null(F.col("role")), F.lit("member")).alias("role"))


def works_at(entities: DataFrame) -> DataFrame:
    """G5."""
    return entities.where(F.trim("company") != "").select("tenant_id", "entity_id", company_id(F.col("company")).alias("company_id"), "title", F.lit(True).alias("is_current"))


def has_topic(mentions: DataFrame) -> DataFrame:
    """Each entity and topic once."""
    return mentions.withColumn("topic_id", topic_id(F.col("topic"))).groupBy("tenant_id", "entity_id", "topic_id").agg(F.min("source").alias("source")).withColumn("confidence", F.lit(0.7))


def member_of(user_nodes: DataFrame, company_nodes: DataFrame) -> DataFrame:
    """Users and the company of their address's domain; of companies with one domain the last id."""
    by_domain = company_nodes.where("domain is not null").groupBy("tenant_id", F.lower("domain").alias("domain")).agg(F.max("company_id").alias("company_id"))
    return user_nodes.withColumn("domain", X.domain(F.col("email"))).join(by_domain, ["tenant_id", "domain"]).select("tenant_id", "user_id", "company_id", "role")


def knows(relations: DataFrame) -> DataFrame:
    """Person to person, with the sorted channels of the evidence."""
    rows = relations.where("from_id is not null and to_id is not null")
    return rows.withColumn("relationship_type", F.coalesce("relationship_type", F.lit("direct"))).withColumn("channels", F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["touchpoint_type"]))))


def interacted_with(facts: DataFrame) -> DataFrame:
    """One edge for each interaction; without an event id a hash of who and when stands for it."""
    rows = facts.where("actor_id is not null and target_id is not null")
    ident = F.coalesce("source_event_id", F.xxhash64("actor_id", "target_id", "occurred_at").cast("string"))
    return rows.select("tenant_id", "actor_id", "target_id", ident.alias("source_event_id"), F.col("touchpoint_type").alias("channel"), "occurred_at")


def _steps(edges: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A function that joins rows, which are written, to the edges that leave the person in a column.

    Rows that are measured to be few are broadcast, and the edges stay where they are. Else both are shuffled, and people
    with very many edges are dealt out.
    """
    heavy: list[DataFrame] = []

    def step(rows: DataFrame, at: str) -> DataFrame:
        if measured(rows) <= BROADCAST_BYTES:
            return edges.join(F.broadcast(rows), F.col(at) == F.col("from_id")).select(*rows.columns, *edges.columns)
        if not heavy:
            heavy.append(materialise(heavy_keys(edges, "from_id"), "heavy-people"))
        return split_join(rows, edges, at, "from_id", heavy[0], F.col("to_id"))

    return step


def intro_paths(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each user's own person (user_id, anchor) the best path of one or two KNOWS steps to everyone else.

    Likelihood is the product of strengths; then the shorter path, then the smaller person between.
    """
    e = edges.select("from_id", "to_id", F.col("strength").cast("double").alias("strength"))
    step = _steps(e)
    one = materialise(step(anchors, "anchor").select("user_id", "anchor", F.col("to_id").alias("mid"), F.col("strength").alias("s1")), "one-step")
    direct = one.select("user_id", "anchor", F.col("mid").alias("target"), F.lit(None).cast("string").alias("via"), F.lit(1).alias("path_length"), F.col("s1").alias("p"))
    two = step(one, "mid").select("user_id", "anchor", F.col("to_id").alias("target"), F.col("mid").alias("via"), F.lit(2).alias("path_length"), (F.col("s1") * F.col("strength")).alias("p"))
    best = direct.unionByName(two).where("target <> anchor").groupBy("user_id", "target").agg(F.min(F.struct((-F.col("p")).alias("p"), "path_length", "via")).alias("b"))
    return best.select("user_id", "target", F.col("b.via").alias("via"), F.col("b.path_length").alias("path_length"), F.round(-F.col("b.p"), 4).alias("intro_likelihood"))


def checksum(parts: dict[str, DataFrame]) -> DataFrame:
    """For each part its rows and two order-free folds of row hashes."""
    one = lambda n, d: d.select(F.xxhash64(*sorted(d.columns)).alias("h")).agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("folded"), F.sum(F.col("h").cast("decimal(38,0)")).alias("summed")).select(F.lit(n).alias("part"), "*")
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in parts.items()])


def part_counts(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of each part by tenant."""
    return reduce(DataFrame.unionByName, [d.groupBy("tenant_id").agg(F.count("*").alias("n")).select("tenant_id", F.lit(k).alias(name), "n") for k, d in parts.items()])


def verify(expected: DataFrame, actual: DataFrame, name: str) -> DataFrame:
    """Parts of which fewer are there than expected."""
    both = expected.withColumnRenamed("n", "expected").join(actual.withColumnRenamed("n", "actual"), ["tenant_id", name], "full_outer").na.fill(0, ["expected", "actual"])
    return both.withColumn("ok", F.col("actual") >= F.col("expected"))


#: Leaves of a hash tree, and how many of its children a node has.
LEAVES, CHILDREN = 1 << 16, 1 << 8


def hash_tree(df: DataFrame, keys: list[str]) -> DataFrame:
    """(level, node, n, folded, summed): order-free folds of row hashes by leaf of the keys (level 2), by LEAVES / CHILDREN
    groups of leaves (level 1) and of all (level 0). One pass over ``df`` makes the leaves; the rest is made from those."""
    rows = df.select(F.pmod(F.xxhash64(*keys), F.lit(LEAVES)).alias("node"), F.xxhash64(*sorted(df.columns)).alias("h"))
    fold = [F.bit_xor("h").alias("folded"), F.sum(F.col("h").cast("decimal(38,0)")).alias("summed")]
    leaves = materialise(rows.groupBy("node").agg(F.count("*").alias("n"), *fold), "hash-leaves")
    up = [F.sum("n").alias("n"), F.bit_xor("folded").alias("folded"), F.sum("summed").cast("decimal(38,0)").alias("summed")]
    tree = leaves.select(F.lit(2).alias("level"), "node", "n", "folded", F.col("summed").cast("decimal(38,0)").alias("summed"))
    tree = tree.unionByName(leaves.groupBy(F.floor(F.col("node") / CHILDREN).cast("long").alias("node")).agg(*up).select(F.lit(1).alias("level"), "*"))
    return tree.unionByName(leaves.agg(*up).na.fill(0, ["n"]).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), "*"))


def changed_nodes(a: DataFrame, b: DataFrame) -> list[int]:
    """The leaves in which two hash trees differ, going down only where the nodes above differ. At most LEAVES numbers."""
    both = a.select("level", "node", F.struct("n", "folded", "summed").alias("x")).join(b.select("level", "node", F.struct("n", "folded", "summed").alias("y")), ["level", "node"], "full_outer")
    unlike = ~F.col("x").eqNullSafe(F.col("y"))
    nodes = [0]
    for level, children in ((0, None), (1, None), (2, CHILDREN)):
        here = both.where((F.col("level") == level) & unlike)
        if children:
            here = here.where(F.floor(F.col("node") / children).isin(nodes))
        nodes = sorted(r["node"] for r in here.select("node").collect())
        if not nodes:
            break
    return nodes


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): rows that are added, removed or changed from one snapshot to the next; keys are unique.

    The snapshots' hash trees name the leaves that differ; only rows of those leaves meet. If nothing differs, no rows do.
    """
    nodes = changed_nodes(hash_tree(before, keys), hash_tree(after, keys))
    near = lambda df: df.select(*keys, F.xxhash64(*sorted(df.columns)).alias("h")).where(F.pmod(F.xxhash64(*keys), F.lit(LEAVES)).isin(nodes) if nodes else F.lit(False))
    both = near(before).withColumnRenamed("h", "_a").join(near(after).withColumnRenamed("h", "_b"), keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*keys, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))


def _hash(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)


#: Fixed: the keys under which nodes and edges are mirrored.
NODE_KEYS = {"Person": "entity_id", "User": "user_id", "Company": "company_id", "Topic": "topic_id"}
EDGE_KEYS = {
    "KNOWS": ("from_id", "to_id", "relationship_type"), "INTERACTED_WITH": ("actor_id", "target_id", "source_event_id"), "WORKS_AT": ("entity_id", "company_id"),
    "MEMBER_OF": ("user_id", "company_id"), "HAS_TOPIC": ("entity_id", "topic_id"), "INTRO_PATH": ("user_id", "target"),
}


def node_mirror(nodes: dict[str, DataFrame]) -> DataFrame:
    """(tenant, label, key, hash) of every node; empty keys go."""
    rows = [d.select("tenant_id", F.lit(k).alias("node_label"), F.col(NODE_KEYS[k]).alias("node_key"), _hash(d).alias("row_hash")) for k, d in nodes.items()]
    return reduce(DataFrame.unionByName, rows).where("node_key <> ''").groupBy("tenant_id", "node_label", "node_key").agg(F.max("row_hash").alias("row_hash"))


def edge_mirror(edges: dict[str, DataFrame], parts: int | None = None) -> DataFrame:
    """(tenant, type, ``a->b`` or ``a->b:c``, hash) of every edge.

    parts: into how many rows are dealt out, where Spark's number would make them too large to be sorted in memory. What
    is put into the mirror then stays where it is.
    """

    def key(k: str) -> Column:
        a, b, *c = (F.col(x) for x in EDGE_KEYS[k])
        return F.concat(a, F.lit("->"), b, *[x for y in c for x in (F.lit(":"), y)])

    rows = [d.select("tenant_id", F.lit(k).alias("edge_type"), key(k).alias("edge_key"), _hash(d).alias("row_hash")) for k, d in edges.items()]
    keys = ["tenant_id", "edge_type", "edge_key"]
    out = reduce(DataFrame.unionByName, rows).where("edge_key is not null")
    return (out.repartition(parts, *keys) if parts else out).groupBy(*keys).agg(F.max("row_hash").alias("row_hash"))


def put_mirror(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The mirror after ``rows`` are put under their keys."""
    keys = [c for c in store.columns if c != "row_hash"]
    return upsert(store, rows.select(*store.columns), keys, ["row_hash"])


def projection_run(run_id: str, node_checks: DataFrame, edge_checks: DataFrame, sums: DataFrame, as_of: Column) -> DataFrame:
    """The record of a projection: status and mismatches by verify(), what the graph has, and a checksum of the snapshot.

    sums: checksum() of the snapshot; the checksum doesn't depend on the order of rows or parts. as_of: when it was recorded.
    """
    bad = F.when(~F.col("ok"), F.concat_ws(":", "part", F.concat(F.lit("expected>="), "expected"), F.concat(F.lit("actual="), "actual")))
    both = node_checks.select("*", F.lit("node").alias("kind")).unionByName(edge_checks.select("*", F.lit("edge").alias("kind")))
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("actual"))), F.lit(0))
    run = both.agg(F.when(F.bool_and("ok"), F.lit("verified")).otherwise(F.lit("mismatch")).alias("status"), F.array_sort(F.collect_list(bad)).alias("mismatches"), total("node").alias("node_count"), total("edge").alias("edge_count"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "part", F.col("n_rows").cast("string"), F.col("folded").cast("string"), F.col("summed").cast("string"))))
    mark = sums.agg(F.sha2(F.array_join(parts, ","), 256).alias("snapshot_checksum"))
    return run.join(mark).select(F.lit(run_id).alias("run_id"), "*", as_of.alias("recorded_at"))


def put_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    """The table of runs after one is recorded; of one id the latest record stays."""
    return upsert(runs, run.select(*runs.columns), ["run_id"], ["recorded_at"])


def put_nodes(graph: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Nodes merged by key; created_at is that of the first time."""
    return upsert(graph, snapshot.select(*graph.columns), ["tenant_id", key], ["updated_at"], keep=("created_at",))


def put_edges(graph: DataFrame, snapshot: DataFrame, keys: list[str], ends: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Edges whose two ends are nodes, merged by key."""
    for column, (nodes, key) in ends.items():
        snapshot = snapshot.join(nodes.select("tenant_id", F.col(key).alias(column)).distinct(), ["tenant_id", column], "left_semi")
    return upsert(graph, snapshot.select(*graph.columns), ["tenant_id", *keys], ["updated_at"])


def degree(edges: DataFrame) -> DataFrame:
    """Q11: incident edges of each person, either way."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))


def shared(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Q12: how many two-step paths lead from each anchor to a person."""
    step = _steps(edges.select("from_id", "to_id"))
    one = materialise(step(anchors, "anchor").groupBy("anchor", F.col("to_id").alias("_mid")).agg(F.count("*").alias("_ways")), "one-step")
    return step(one, "_mid").groupBy("anchor", F.col("to_id").alias("entity_id")).agg(F.sum("_ways").alias("shared_connections"))


def second_degree(edges: DataFrame, anchors: DataFrame, most_via: int = 5) -> DataFrame:
    """Q9: people two steps from an anchor and not one; the first ``most_via`` people between, the best second step."""
    step = _steps(edges.select("from_id", "to_id", "strength"))
    one = materialise(step(anchors, "anchor").select("anchor", F.col("to_id").alias("mid")), "one-step")
    two = step(one, "mid").select("anchor", "mid", F.col("to_id").alias("entity_id"), "strength").where("entity_id <> anchor")
    two = two.join(one.select("anchor", F.col("mid").alias("entity_id")).distinct(), ["anchor", "entity_id"], "left_anti")
    best = two.groupBy("anchor", "entity_id", "mid").agg(F.max("strength").alias("s"))
    ranked = best.withColumn("_n", F.row_number().over(Window.partitionBy("anchor", "entity_id").orderBy("mid")))
    return ranked.groupBy("anchor", "entity_id").agg(F.array_sort(F.collect_list(F.when(F.col("_n") <= most_via, F.col("mid")))).alias("via_entity_ids"), F.max("s").alias("path_strength"))


def second_degree_people(edges: DataFrame, anchors: DataFrame, people: DataFrame, works: DataFrame, companies: DataFrame, k: int = 25) -> DataFrame:
    """Q9: the ``k`` people of the best second step for each anchor, then by id, with who they are and where they work.

    Of several employers the one with the smallest id.
    """
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc_nulls_last("path_strength"), "entity_id"))
    best = second_degree(edges, anchors).withColumn("rn", rank).where(F.col("rn") <= k)
    at = works.groupBy("entity_id").agg(F.min("company_id").alias("company_id")).join(companies.select("company_id", F.col("name").alias("company_name")), "company_id", "left")
    return best.join(people.select("entity_id", "name", "primary_email", "domain", "seniority"), "entity_id", "left").join(at, "entity_id", "left")


def shortest_routes(edges: DataFrame, wanted: DataFrame, most_steps: int = 4) -> DataFrame:
    """Q10: routes() of shortest_paths() from the anchors of ``wanted``. A step's strength is taken where it is walked.

    So edges aren't joined to the steps of all paths afterwards. Of edges that are there twice the greatest strength counts.
    """
    cost = F.coalesce(-F.col("strength").cast("double"), F.lit(float("inf")))
    pairs = materialise(edges.select("from_id", "to_id", cost.alias("cost")).where("from_id <> to_id"), "pairs", dense=True)
    found = _walked(pairs, wanted.select("anchor").distinct(), most_steps, "cost")
    hit = wanted.join(found.where("path_length > 0"), ["anchor", "entity_id"], "left")
    strengths = F.transform("costs", lambda c: F.when(c != float("inf"), -c))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return hit.select("anchor", "entity_id", F.col("path").isNotNull().alias("found"), "path_length", none(F.col("path"), "string").alias("path"), none(strengths, "double").alias("strengths"))


def routes(paths: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Q10: for each wanted (anchor, entity_id): found, path_length, the people on the path and the strength of each step.

    paths: of shortest_paths(). Where none leads there, found is false and the rest is null or empty.
    """
    hit = wanted.join(paths.where("path_length > 0"), ["anchor", "entity_id"], "left")
    steps = hit.where("path is not null").select("anchor", "entity_id", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "from_id"), "path")
    steps = steps.select("anchor", "entity_id", "at", "from_id", F.get("path", F.col("at") + 1).alias("to_id"))
    strong = edges.groupBy("from_id", "to_id").agg(F.max("strength").alias("strength"))
    taken = steps.join(strong, ["from_id", "to_id"]).groupBy("anchor", "entity_id").agg(F.array_sort(F.collect_list(F.struct("at", "strength"))).alias("s"))
    out = hit.join(taken, ["anchor", "entity_id"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return out.select("anchor", "entity_id", F.col("path").isNotNull().alias("found"), "path_length", none(F.col("path"), "string").alias("path"), none(F.col("s.strength"), "double").alias("strengths"))


def shortest_paths(edges: DataFrame, anchors: DataFrame, most_steps: int = 4) -> DataFrame:
    """Q10: (anchor, entity_id, path_length, path) to everyone within ``most_steps`` KNOWS steps; ties by the smaller path.

    One equality join for each step, from the people reached last; those seen before are left out. Each level is a
    checkpoint, so a lost executor costs one level.
    """
    return _walked(_pairs(edges), anchors, most_steps)


def _walked(pairs: DataFrame, anchors: DataFrame, most_steps: int, cost: str | None = None) -> DataFrame:
    """cost: a column of ``pairs``, a number that isn't null; the least of each step comes along as ``costs``."""
    walk, more = _steps(pairs), ["costs"] if cost else []
    level = anchors.select("anchor", F.col("anchor").alias("entity_id"), F.lit(0).alias("path_length"), F.array("anchor").alias("path"), *([F.array().cast("array<double>").alias("costs")] if cost else []))
    seen = level
    for step in range(1, most_steps + 1):
        on = [F.concat("path", F.array("to_id")).alias("path"), *([F.concat("costs", F.array(cost)).alias("costs")] if cost else [])]
        nxt = walk(level, "entity_id").select("anchor", F.col("to_id").alias("entity_id"), *on)
        best = F.min(F.struct("path", *more)).alias("b") if cost else F.min("path").alias("path")
        nxt = nxt.groupBy("anchor", "entity_id").agg(best)
        nxt = (nxt.select("anchor", "entity_id", "b.*") if cost else nxt).join(seen.select("anchor", "entity_id"), ["anchor", "entity_id"], "left_anti")
        level = nxt.select("anchor", "entity_id", F.lit(step).alias("path_length"), "path", *more).checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def _pairs(edges: DataFrame) -> DataFrame:
    """Who leads to whom. Edges that are there twice change no path, so they aren't shuffled to be told apart."""
    return materialise(edges.select("from_id", "to_id").where("from_id <> to_id"), "pairs", dense=True)


def paths_between(edges: DataFrame, wanted: DataFrame, most_steps: int = 4) -> DataFrame:
    """Q10: (anchor, entity_id, path_length, path) for the ``wanted`` pairs that are within ``most_steps`` KNOWS steps.

    As shortest_paths(), ties by the smaller path, but for pairs that are named: one frontier goes from the anchors, one
    back from those who are looked for, and they meet half-way. A shortest path's two halves are each the smallest of their
    kind, so their sum is the smallest path.
    """
    pairs = _pairs(edges)
    wanted = materialise(wanted.select("anchor", "entity_id").distinct(), "wanted")
    there = _walked(pairs, wanted.select("anchor").distinct(), (most_steps + 1) // 2)
    there = there.select("anchor", F.col("entity_id").alias("mid"), F.col("path_length").alias("n1"), F.col("path").alias("p1"))
    # Back along reversed steps; of the paths to one person the smallest from there on is wanted.
    back = wanted.select(F.col("entity_id").alias("target"), F.col("entity_id").alias("at"), F.lit(0).alias("n2"), F.array("entity_id").alias("p2")).distinct()
    walk, level = _steps(pairs.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))), back
    for step in range(1, most_steps // 2 + 1):
        nxt = walk(level, "at").select("target", F.col("to_id").alias("at"), F.concat(F.array("to_id"), "p2").alias("p2"))
        nxt = nxt.groupBy("target", "at").agg(F.min("p2").alias("p2")).join(back.select("target", "at"), ["target", "at"], "left_anti")
        level = nxt.select("target", "at", F.lit(step).alias("n2"), "p2").checkpoint()
        if level.isEmpty():
            break
        back = back.unionByName(level)
    back = materialise(back, "back")
    met = split_join(there, back, "mid", "at", materialise(heavy_keys(back, "at"), "heavy-mids"), F.col("target"))
    met = met.join(wanted.withColumnRenamed("entity_id", "target"), ["anchor", "target"], "left_semi")
    whole = F.concat("p1", F.slice("p2", F.lit(2), F.greatest(F.size("p2") - 1, F.lit(0))))
    best = met.groupBy("anchor", F.col("target").alias("entity_id")).agg(F.min(F.struct((F.col("n1") + F.col("n2")).alias("n"), whole.alias("path"))).alias("b"))
    return best.select("anchor", "entity_id", F.col("b.n").alias("path_length"), F.col("b.path").alias("path"))


def connectors(edges: DataFrame, k: int = 5) -> DataFrame:
    """Q15: the ``k`` people with the most outgoing edges."""
    return edges.groupBy(F.col("from_id").alias("entity_id")).agg(F.count("*").alias("connections")).orderBy(F.desc("connections"), "entity_id").limit(k)
