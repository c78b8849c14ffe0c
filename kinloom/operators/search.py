"""Search over the graph: what a query means, who matches, and in which order.

Queries come as a DataFrame, one row each; they are the small side (a stated set, checked by MOST_QUERIES) and are
broadcast against the people, so people are never shuffled for matching. Text is found by trigrams: of each needle the
trigram that the fewest rows have is joined by equality, and what it brings is held against the whole needle. Prefixes are
joined by equality, too, with the beginnings of the lengths that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.session import materialise

from . import graph as G
from .joins import side

MOST_QUERIES = 100_000

#: Fixed: the patterns and words by which a query's intent is told, in order.
INTRO = "(?i)\\b(?:intro(?:duce me)?\\s+to|how\\s+(?:do\\s+i\\s+)?meet|connect\\s+me\\s+(?:with|to))\\b\\s+(.+)"
COMPANY = "(?i)\\b(?:people\\s+at|contacts?\\s+at|works?\\s+at|from|employees?\\s+(?:at|of))\\b\\s+(.+)"
EMAIL = "([a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,})"
DOMAIN = "(?i)\\b([\\w\\-]+\\.(?:com|io|ai|co|net|org|dev))\\b"
NOISE = "find search show me who is the a an".split()

#: Fixed: what each part of a score weighs.
WEIGHTS = {"retrieval": 0.35, "strength": 0.25, "temporal": 0.15, "degree": 0.15, "shared": 0.10}


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(c)), "\\s+"), lambda w: w != "")


def parse(queries: DataFrame) -> DataFrame:
    """Q1: (query_id, text) with intent, target_name, company, email, domain and name_tokens."""
    q = F.trim("text")
    found = lambda p: F.nullif(F.trim(F.regexp_extract(q, p, 1)), F.lit(""))
    rows = queries.withColumns({"_intro": found(INTRO), "_company": found(COMPANY), "_email": found(EMAIL), "_domain": F.lower(found(DOMAIN)), "_words": _tokens(q)})
    rest = F.filter("_words", lambda w: ~w.isin(*NOISE))
    short = F.col("_domain").isNotNull() & (F.size("_words") <= 3)
    step = F.when(F.col("_intro").isNotNull(), 1).when(F.col("_company").isNotNull(), 2).when(F.col("_email").isNotNull(), 3).when(short, 4).when(F.size(rest) > 0, 5).otherwise(6)
    rows = rows.withColumn("_k", step).withColumn("_rest", rest)
    at = lambda *ks: F.col("_k").isin(*ks)
    none = F.array().cast("array<string>")
    return rows.select(
        *queries.columns,
        F.when(at(1), "intro_path").when(at(2, 4), "company_search").when(at(3, 5), "person_search").otherwise("general").alias("intent"),
        F.when(at(1), F.col("_intro")).alias("target_name"), F.when(at(2), F.col("_company")).alias("company"), F.when(at(3), F.col("_email")).alias("email"),
        F.when(at(3), F.lower(F.substring_index("_email", "@", -1))).when(at(4), F.col("_domain")).alias("domain"),
        F.when(at(1), _tokens(F.col("_intro"))).when(at(5), F.col("_rest")).otherwise(none).alias("name_tokens"),
    )


def _asked(queries: DataFrame) -> DataFrame:
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries at once; take them in blocks")
    return F.broadcast(queries)


def holds(c: Column, needle: Column) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lower(needle)), F.lit(False))


#: Letters of a gram. Shorter needles are held against every row.
GRAM = 3


def grams(c: Column) -> Column:
    """The distinct grams of a text in lower case; none for null or shorter texts."""
    text = F.lower(F.coalesce(c, F.lit("")))
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    # Within transform() the text is made once.
    return F.array_distinct(F.flatten(F.transform(F.array(text), lambda t: F.transform(starts, lambda i: F.substr(t, i, F.lit(GRAM))))))


def holding(rows: DataFrame, fields: list[str], queries: DataFrame, needle: str) -> DataFrame:
    """Each row of ``rows`` with each query whose needle one of its ``fields`` holds, whatever the case.

    The needles' rarest grams are found by one pass over ``rows``, and the rows that have them by a second; no row is
    held against a needle whose gram it lacks. Null needles are in nothing.
    """
    queries = materialise(queries, "asked-needles")
    long = F.length(F.lower(needle)) >= GRAM
    none = queries.where(F.col(needle).isNotNull() & ~long)
    found = rows.join(_asked(none), _any_holds(fields, needle)) if not none.isEmpty() else None
    needles = queries.where(long).select(F.lower(needle).alias("_needle")).distinct()
    asked = needles.select("_needle", F.explode(grams(F.col("_needle"))).alias("_gram"))
    there = rows.select(F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col(f)) for f in fields])))).alias("_gram"))
    there = there.join(side(materialise(asked.select("_gram").distinct(), "asked-grams")), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = asked.join(there, "_gram", "left").groupBy("_needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r"))
    rarest = rarest.where("_r.n > 0").select("_needle", F.col("_r._gram").alias("_gram"))
    keyed = queries.where(long).withColumn("_needle", F.lower(needle)).join(F.broadcast(rarest), "_needle").drop("_needle")
    with_grams = rows.withColumn("_gram", F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col(f)) for f in fields])))))
    hits = with_grams.join(_asked(materialise(keyed, "rarest-grams")), "_gram").where(_any_holds(fields, needle)).drop("_gram")
    return hits if found is None else hits.unionByName(found)


def _any_holds(fields: list[str], needle: str) -> Column:
    out = holds(F.col(fields[0]), F.col(needle))
    for f in fields[1:]:
        out = out | holds(F.col(f), F.col(needle))
    return out


def starting(rows: DataFrame, fields: list[str], queries: DataFrame, prefix: str) -> DataFrame:
    """Each row with each query whose prefix one of its ``fields`` starts with, whatever the case; null starts nothing."""
    queries = materialise(queries.where(F.col(prefix).isNotNull()).withColumn("_prefix", F.lower(prefix)), "asked-prefixes")
    lengths = sorted(n for (n,) in queries.select(F.length("_prefix")).distinct().collect())
    if not lengths:
        return rows.join(_asked(queries.drop("_prefix")), F.lit(False))
    cut = lambda f: [F.when(F.length(F.lower(f)) >= n, F.substring(F.lower(f), 1, n)) for n in lengths]
    begins = rows.withColumn("_prefix", F.explode(F.array_compact(F.array_distinct(F.array(*[c for f in fields for c in cut(f)])))))
    return begins.join(_asked(queries), "_prefix").drop("_prefix")


def by_email(people: DataFrame, queries: DataFrame) -> DataFrame:
    """Q2: people whose address is the query's, whatever the case."""
    return people.join(_asked(queries), F.lower("primary_email") == F.lower("email"))


def by_domain(people: DataFrame, queries: DataFrame, domain: str = "q_domain") -> DataFrame:
    """Q3: people of the query's domain, or whose address holds it."""
    of = people.join(_asked(queries), F.lower("domain") == F.lower(domain)).where(~holds(F.col("primary_email"), F.col(domain)))
    held = holding(people, ["primary_email"], queries, domain)
    return held.unionByName(of.select(*held.columns))


def by_name(people: DataFrame, queries: DataFrame, needle: str = "needle") -> DataFrame:
    """Q4, Q7: people whose name or address holds the needle."""
    return holding(people, ["name", "primary_email"], queries, needle)


#: What decorate() adds.
DECORATION = ("strength", "interaction_count", "last_at", "company_id", "company_name", "company_domain", "degree", "shared_connections")


def decorate(found: DataFrame, edges: DataFrame, works: DataFrame, companies: DataFrame, columns: tuple[str, ...] = DECORATION) -> DataFrame:
    """What search returns of each person: employer, and the KNOWS edge from the query's anchor, degree and shared connections.

    found: (…, entity_id, anchor); each query has its own anchor, the person of who asks. Several edges or employers of a
    person give several rows. columns: those of DECORATION that are wanted; others aren't made.
    """
    found = materialise(found, "found")
    anchors = side(materialise(found.select("anchor").distinct(), "anchors"))
    out, want = found, set(columns)
    if want & {"strength", "interaction_count", "last_at"}:
        own = edges.join(anchors, F.col("from_id") == F.col("anchor")).select("anchor", F.col("to_id").alias("entity_id"), *[c for c in ("strength", "interaction_count", "last_at") if c in want])
        out = out.join(own, ["anchor", "entity_id"], "left")
    if want & {"company_id", "company_name", "company_domain"}:
        out = out.join(works.select("entity_id", "company_id"), "entity_id", "left")
        out = out.join(companies.select("company_id", F.col("name").alias("company_name"), F.col("domain").alias("company_domain")), "company_id", "left")
    if "degree" in want:
        out = out.join(G.degree(edges), "entity_id", "left").na.fill(0, ["degree"])
    if "shared_connections" in want:
        out = out.join(G.shared(edges, anchors), ["anchor", "entity_id"], "left").na.fill(0, ["shared_connections"])
    return out.select(*found.columns, *[c for c in DECORATION if c in want])


def top(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query."""
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rn") <= k)


def people_search(found: DataFrame, k: int) -> DataFrame:
    """Q4, Q7: strongest first, then most shared, then by id."""
    return top(found, k, F.desc_nulls_last("strength"), F.desc("shared_connections"), F.asc("entity_id"))


def company_search(companies: DataFrame, works: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Q5: companies of the domain, else whose name holds the text, by employees."""
    staff = works.groupBy("company_id").agg(F.count("*").alias("employee_count"))
    named = holding(companies, ["name"], queries.where("q_domain is null"), "company")
    of = companies.join(_asked(queries.where("q_domain is not null")), F.lower("domain") == F.lower("q_domain"))
    found = named.unionByName(of.select(*named.columns)).join(staff, "company_id", "left").na.fill(0, ["employee_count"])
    return top(found, k, F.desc("employee_count"), F.asc("company_id"))


def intro_search(found: DataFrame, reach: DataFrame, k: int) -> DataFrame:
    """Q6: matches with the length of the shortest path from the anchor, shortest first, then strongest."""
    rows = found.join(reach.select("anchor", "entity_id", "path_length"), ["anchor", "entity_id"], "left")
    return top(rows, k, F.asc_nulls_last("path_length"), F.desc_nulls_last("strength"), F.asc("entity_id"))


def autocomplete(people: DataFrame, prefixes: DataFrame, k: int = 8) -> DataFrame:
    """Q8: people whose name or address starts with the prefix, by name."""
    return top(starting(people, ["name", "primary_email"], prefixes, "prefix"), k, F.asc("name"), F.asc("entity_id"))


def retrieval_score(tokens: Column, *fields: Column) -> Column:
    """Q17: the share of tokens that the fields hold; 1 without tokens."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.contains(text, t))) / F.size(tokens)).otherwise(F.lit(1.0))


def temporal_score(last: Column, n: Column, as_of: Column) -> Column:
    """Q18: how recently and how often; 0 without a last time. Days are whole and never negative."""
    days = F.greatest(F.floor((F.unix_micros(as_of) - F.unix_micros(last)) / 86_400_000_000), F.lit(0))
    often = F.least(F.log(F.coalesce(n, F.lit(0)) + 1) / F.log(F.lit(201.0)), F.lit(1.0))
    return F.when(last.isNull(), F.lit(0.0)).otherwise(0.7 * F.exp(-days / F.lit(90.0)) + 0.3 * often)


def degree_score(degree: Column) -> Column:
    """Q19: hubs count for less beyond 50 edges."""
    return F.greatest(F.lit(0.0), 1 - 0.003 * F.greatest(F.coalesce(degree, F.lit(0)) - 50, F.lit(0)))


def shared_score(shared: Column) -> Column:
    """Q20."""
    return F.least(F.coalesce(shared, F.lit(0)) / F.lit(10.0), F.lit(1.0))


def rank(found: DataFrame, as_of: Column, explain: bool = True) -> DataFrame:
    """Q16, Q21: ``score`` to four places from five weighted parts, and the parts where asked for; ordered within a query."""
    strong = F.least(F.coalesce(F.col("strength").cast("double"), F.lit(0.0)), F.lit(1.0))
    parts = {"retrieval": retrieval_score(F.col("tokens"), F.col("name"), F.col("primary_email"), F.col("company_name")), "strength": strong, "temporal": temporal_score(F.col("last_at"), F.col("interaction_count"), as_of), "degree": degree_score(F.col("degree")), "shared": shared_score(F.col("shared_connections"))}
    out = found.withColumns({f"_{k}": WEIGHTS[k] * v for k, v in parts.items()})
    out = out.withColumn("score", F.round(sum((F.col(f"_{k}") for k in parts), F.lit(0.0)), 4))
    if explain:
        out = out.withColumn("explain", F.struct(*[F.round(f"_{k}", 4).alias(k) for k in parts]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rn")
    return out.withColumn("position", F.row_number().over(order)).drop(*[f"_{k}" for k in parts])


def run(queries: DataFrame, people: DataFrame, edges: DataFrame, works: DataFrame, companies: DataFrame, as_of: Column, k: int = 20, most_steps: int = 4) -> DataFrame:
    """Q22: queries (query_id, text, anchor) answered: what each means, its ``k`` matches, and their order and scores.

    A query goes by its intent: to the people of its address, domain or name; to the people of its name with the shortest
    path from its anchor; to companies; or, if it means nothing of these, to people who hold its whole text. Rows: query_id,
    intent, result_type, total, position, result_id, name, path_length, score, explain.
    """
    asked = parse(queries).withColumns({"q_domain": F.col("domain"), "q_email": F.col("email"), "tokens": F.when(F.size("name_tokens") > 0, F.col("name_tokens")).otherwise(_tokens(F.col("text")))})
    asked = materialise(asked.select("query_id", "text", "anchor", "intent", "target_name", F.col("company").alias("q_company"), "q_domain", "q_email", "name_tokens", "tokens"), "asked")
    head = ["query_id", "intent", "anchor", "tokens"]
    person = F.col("intent") == "person_search"

    def needle(rows: DataFrame, c: Column) -> DataFrame:
        return by_name(people, rows.select(*head, c.alias("needle"))).drop("needle")

    by_mail = by_email(people, asked.where(person & F.col("q_email").isNotNull()).select(*head, F.col("q_email").alias("email"))).drop("email")
    by_dom = by_domain(people, asked.where(person & F.col("q_email").isNull() & F.col("q_domain").isNotNull()).select(*head, "q_domain")).drop("q_domain")
    named = needle(asked.where(person & F.col("q_email").isNull() & F.col("q_domain").isNull()), F.array_join("name_tokens", " "))
    general = needle(asked.where("intent = 'general'"), F.col("text"))
    found = decorate(by_mail.unionByName(by_dom).unionByName(named).unionByName(general), edges, works, companies)
    found = people_search(found, k).withColumn("path_length", F.lit(None).cast("int"))
    intro = asked.where("intent = 'intro_path'")
    led = materialise(decorate(needle(intro, F.col("target_name")), edges, works, companies), "led-to")
    met = intro_search(led, G.paths_between(edges, led, most_steps).where("path_length > 0"), k)
    persons = found.unionByName(met.select(*found.columns)).withColumns({"result_type": F.lit("persons"), "result_id": F.col("entity_id")})
    firms = asked.where("intent = 'company_search'").select(*head, F.col("q_company").alias("company"), "q_domain")
    firms = company_search(companies, works, firms, k).withColumns({"result_type": F.lit("companies"), "result_id": F.col("company_id")})
    shared = [*head, "result_type", "result_id", "name", "rn"]
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    firms = firms.select(*shared, null("primary_email", "string"), null("company_name", "string"), null("strength", "double"), null("last_at", "timestamp"), null("interaction_count", "long"), null("degree", "long"), null("shared_connections", "long"), null("path_length", "int"))
    rows = persons.select(*firms.columns).unionByName(firms)
    total = F.count("*").over(Window.partitionBy("query_id"))
    return rank(rows, as_of).withColumn("total", total).select("query_id", "intent", "result_type", "total", "position", "result_id", "name", "path_length", "score", "explain")
