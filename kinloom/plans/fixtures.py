"""Provider data made from the given tables, for the registered queries, and the same facts as DuckDB CTEs.

People are customers and suppliers; an order is a mail from its customer to its suppliers and a meeting of all of
them. Payload noise (cases, blanks, missing parts) follows from key arithmetic, so both sides can state it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.session import once

AS_OF = "2002-01-01 00:00:00"
#: Orders that a task expands to pairs, about; rows of a file of what is made, so that readers get more tasks than its bytes would give.
EVENTS, FILE_ROWS = 50_000, 10_000
#: What is short when written, but dear to read or expanded when it is.
EXPANDED = ("raw_contacts", "raw_mail", "raw_meetings", "mail", "meetings")


class Tables:
    """The given tables and what is made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, k in df.dtypes if k == "timestamp_ntz"})

    def _once(self, name: str, df: DataFrame) -> DataFrame:
        """What is made from the tables is written once for each application, so queries measure their operators."""
        return once(df, self.dir, name, file_rows=FILE_ROWS if name in EXPANDED else 0)

    @cached_property
    def people(self) -> DataFrame:
        """entity_id, name, email, company, title, location, seq."""
        nation = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        out = None
        for table, p, title, base in ((self.customer, "c", F.col("c_mktsegment"), 0), (self.supplier, "s", F.lit("SUPPLIER"), 1_000_000_000)):
            key = F.col("c_custkey") if p == "c" else F.col("s_suppkey")
            ident = F.concat(F.lit(p), key.cast("string"))
            rows = table.join(F.broadcast(nation), F.col(f"{p}_nationkey") == F.col("n_nationkey")).select(ident.alias("entity_id"), F.col(f"{p}_name").alias("name"), F.concat(ident, F.lit("@"), F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")), F.lit(".com")).alias("email"), F.col("n_name").alias("company"), title.alias("title"), F.col("r_name").alias("location"), (key + base).alias("seq"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _raw(self, df: DataFrame, source: str) -> DataFrame:
        return df.select(F.lit("t1").alias("tenant_id"), F.lit("u1").alias("user_id"), F.lit(source).alias("source"), "source_event_id", "occurred_at", F.concat(F.lit("tr"), (F.col("raw_event_id") % 10).cast("string")).alias("trace_id"), "raw_event_id", "payload")

    @cached_property
    def contact_items(self) -> DataFrame:
        """People's contacts, before they are JSON. Dealt out by rows: the files of people are few and short, what is made of a row is dear."""
        p = self.people.repartition(-(-(self.customer.count() + self.supplier.count()) // FILE_ROWS) or 1, "entity_id")
        rows = p.withColumns({"raw_event_id": F.col("seq") * 10, "disp": F.concat("name", F.lit(" of  "), "company"), "sid": F.concat(F.lit("people/"), "entity_id")})
        again = p.where("seq % 10 = 0").withColumns({"raw_event_id": F.col("seq") * 10 + 1, "disp": F.concat(F.lit("Re "), "name"), "sid": F.concat(F.lit("people/"), "entity_id", F.lit("/2"))})
        rows = rows.unionByName(again)
        m = lambda n: F.col("seq") % n == 0
        kind = F.when(m(17), "bad").when(m(13), "noemail").when(m(11), "noname").when(m(7), "flat").otherwise("full")
        rows = rows.withColumn("kind", kind).withColumn("comp", F.when(m(4), F.concat(F.lit(" "), F.lower("company"), F.lit("  group"))).otherwise(F.col("company")))
        noisy = F.when(m(3), F.concat(F.lit(" "), F.upper("email"), F.lit(" "))).otherwise(F.col("email"))
        parts = {
            "resourceName": F.col("sid"),
            "names": F.when(F.col("kind").isin("full", "noemail"), F.array(F.struct(F.col("disp").alias("displayName")))),
            "name": F.when(F.col("kind") == "flat", F.col("disp")),
            "emailAddresses": F.when(F.col("kind").isin("full", "noname"), F.array(F.struct(noisy.alias("value")), F.struct(F.col("email").alias("value")))),
            "email": F.when(F.col("kind") == "flat", noisy),
            "phoneNumbers": F.when(F.col("kind") == "full", F.array(F.struct(F.concat(F.lit(" +1-"), "entity_id", F.lit(" ")).alias("value")), F.struct(F.concat(F.lit("+1-"), "entity_id").alias("value")))),
            "organizations": F.when(F.col("kind") != "flat", F.array(F.struct(F.col("comp").alias("name"), F.col("title").alias("title")))),
            "company": F.when(F.col("kind") == "flat", F.col("comp")), "title": F.when(F.col("kind") == "flat", F.col("title")),
            "metadata": F.when(~m(5), F.struct(F.array(F.struct(F.date_format(self._contact_time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updateTime"))).alias("sources"))),
        }
        body = F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))
        broken = F.to_json(F.struct(F.col("sid").alias("resourceName"), F.array(F.lit("str")).alias("names")))
        return rows.withColumn("payload", F.when(F.col("kind") == "bad", broken).otherwise(body)).withColumn("occurred_at", self._contact_time)

    @property
    def _contact_time(self):
        return F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("seq") % 1000) * 3600)

    @cached_property
    def raw_contacts(self) -> DataFrame:
        return self._once("raw_contacts", self._raw(self.contact_items.withColumnRenamed("sid", "source_event_id"), "google_contacts"))

    @cached_property
    def orders_with_people(self) -> DataFrame:
        """Each order with its customer and the sorted addresses of its suppliers. Mail and meetings are made from it."""
        who = self.people.select("entity_id", "email", "name")
        sup = self.lineitem.select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("entity_id")).join(who, "entity_id").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("email")).alias("to"))
        o = self.orders.withColumn("entity_id", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).join(who, "entity_id")
        rows = o.join(sup, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("to", F.coalesce("to", F.array().cast("array<string>")))
        return self._once("orders_with_people", rows.drop("l_orderkey", "entity_id", "o_custkey", "o_totalprice"))

    @cached_property
    def raw_mail(self) -> DataFrame:
        k = F.col("o_orderkey")
        h = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
        zone = F.when(k % 4 == 0, " GMT").otherwise(" +0000")
        headers = F.array_compact(F.array(
            h("From", F.concat("name", F.lit(" <"), F.upper("email"), F.lit(">"))), h("TO", F.array_join(F.transform("to", lambda e: F.upper(e)), ", ")),
            F.when(k % 5 == 0, h("Subject", F.lit("old"))), F.when(k % 9 != 0, h("subject", F.col("o_orderpriority"))),
            F.when(k % 2 == 0, h("Date", F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), zone))),
        ))
        body = F.to_json(F.struct(F.concat(F.lit("m"), k.cast("string")).alias("id"), F.concat(F.lit("th"), (k % 1000).cast("string")).alias("threadId"), F.col("o_orderstatus").alias("snippet"), F.when(k % 4 == 1, F.unix_millis("o_orderdate").cast("string")).alias("internalDate"), F.struct(headers.alias("headers")).alias("payload")))
        rows = self.orders_with_people.select(F.concat(F.lit("m"), k.cast("string")).alias("source_event_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("occurred_at"), (k + 50_000_000_000).alias("raw_event_id"), body.alias("payload"))
        return self._once("raw_mail", self._raw(rows, "gmail"))

    @cached_property
    def raw_meetings(self) -> DataFrame:
        k = F.col("o_orderkey")
        iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        start = F.when(k % 3 == 0, F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")))).otherwise(F.to_json(F.struct(iso(F.col("o_orderdate")).alias("dateTime"))))
        who = F.transform(F.array_append("to", F.col("email")), lambda e: F.struct(F.concat(F.lit(" "), F.upper(e)).alias("email")))
        head = F.to_json(F.struct(F.concat(F.lit("e"), k.cast("string")).alias("id"), F.lit("confirmed").alias("status"), F.when(k % 8 != 0, F.col("o_orderpriority")).alias("summary"), F.concat(F.lit("Room "), (k % 5).cast("string")).alias("location"), F.when(k % 2 == 0, iso(F.col("o_orderdate"))).alias("updated"), F.when(k % 2 == 1, iso(F.col("o_orderdate"))).alias("created"), who.alias("attendees")))
        body = F.concat(F.expr("substring({0}, 1, length({0}) - 1)".format("_h")), F.lit(',"start":'), F.col("_s"), F.lit("}"))
        rows = self.orders_with_people.withColumn("_h", head).withColumn("_s", start)
        return self._once("raw_meetings", self._raw(rows.select(F.concat(F.lit("e"), k.cast("string")).alias("source_event_id"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"), (k + 70_000_000_000).alias("raw_event_id"), body.alias("payload")), "google_calendar"))

    @cached_property
    def raw_other(self) -> DataFrame:
        rows = self.events.select(F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("source_event_id"), F.col("ts").cast("timestamp").alias("occurred_at"), (F.col("event_id") + 90_000_000_000).alias("raw_event_id"), F.col("props").alias("payload"))
        return self._raw(rows, "twitter")

    @cached_property
    def raw(self) -> DataFrame:
        return self.raw_contacts.unionByName(self.raw_mail).unionByName(self.raw_meetings).unionByName(self.raw_other)

    @cached_property
    def routed(self) -> DataFrame:
        from kinloom.operators.canonical import route

        return route(self.raw)

    @cached_property
    def contacts(self) -> DataFrame:
        from kinloom.operators import canonical as C

        return self._once("contacts", C.enrich_contacts(C.flatten_contacts(C.route(self.raw_contacts))))

    @cached_property
    def mail(self) -> DataFrame:
        from kinloom.operators import canonical as C

        return self._once("mail", C.enrich_mail(C.flatten_mail(C.route(self.raw_mail))))

    @cached_property
    def meetings(self) -> DataFrame:
        from kinloom.operators import canonical as C

        return self._once("meetings", C.enrich_calendar(C.flatten_calendar(C.route(self.raw_meetings))))

    @cached_property
    def entities(self) -> DataFrame:
        """Resolved people by their given ids: the entity table that later operators join to."""
        c = F.col
        tags = F.array(F.concat(F.lit("company:"), F.lower("company")), F.lower("title"))
        return self.people.select("entity_id", F.lit("t1").alias("tenant_id"), c("name").alias("display_name"), c("email").alias("primary_email"), "company", "title", tags.alias("tags"), "location", "seq")

    @cached_property
    def interactions(self) -> DataFrame:
        """Made anew from the events where they are read: written, they would be over twenty rows for each event."""
        from kinloom.operators import relations as R

        return R.from_mail(self.mail).unionByName(R.from_meetings(self.meetings))

    @cached_property
    def order_people(self) -> DataFrame:
        """(o_orderkey, occurred_at, c, ss): who an order brings together. Parts are of so many orders that the pairs of one fit its task."""
        n = max(1, -(-self.orders.count() // EVENTS))
        o = self.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("occurred_at"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("c")).repartition(n, "o_orderkey")
        s = self.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s")).repartition(n, "o_orderkey")
        return o.join(s.groupBy("o_orderkey").agg(F.sort_array(F.collect_set("s")).alias("ss")), "o_orderkey")

    @cached_property
    def pair_facts(self) -> DataFrame:
        """Interactions by entity id, straight from the orders: mail from customer to supplier, meetings of all.

        Made anew from the orders where they are read: written, they would be over twenty rows for each order.
        """
        mail = F.transform("ss", lambda s: F.struct(F.lit("email").alias("kind"), F.col("c").alias("from_id"), s.alias("to_id")))
        who = F.array_append("ss", F.col("c"))
        pairs = F.flatten(F.transform(who, lambda a: F.transform(F.filter(who, lambda b: b != a), lambda b: F.struct(F.lit("meeting").alias("kind"), a.alias("from_id"), b.alias("to_id")))))
        rows = self.order_people.select("occurred_at", "o_orderkey", F.inline(F.concat(mail, pairs)))
        event = F.concat(F.when(F.col("kind") == "email", "m").otherwise("e"), F.col("o_orderkey").cast("string"))
        return rows.select("occurred_at", "kind", "from_id", "to_id", event.alias("event"))

    @cached_property
    def known_pairs(self) -> DataFrame:
        """knows, and of which kinds a pair's interactions are (1 mail, 2 meetings, 3 both). Pairs are made after the shuffle."""
        from kinloom.operators import relations as R

        # The tenant comes out of the expanded rows: as a constant it would be dropped from the keys, and rows be shuffled anew.
        row = lambda way, one, others: F.struct(F.lit("t1").alias("tenant_id"), F.lit(way).alias("way"), one.alias("one"), others.alias("others"))
        # A customer's id is before every supplier's, so of all that an order brings together mail is the customer's row.
        met = F.transform("ss", lambda s, k: row(R.MET, s, F.slice(F.col("ss"), k + 2, F.size("ss"))))
        rows = self.order_people.select("occurred_at", F.inline(F.concat(F.array(row(R.OUT + R.MET, F.col("c"), F.col("ss"))), met)))
        made = lambda rows: R.ways(R.sides(rows), into=("from_id", "to_id"), kinds=True).select("from_id", "to_id", "interaction_count", "strength", "last_at", "kinds", "tenant_id")
        return once(rows, self.dir, "knows", made=made)

    @cached_property
    def knows(self) -> DataFrame:
        return self.known_pairs.drop("kinds")

    @cached_property
    def anchors(self) -> DataFrame:
        """The customer with the most orders of each market segment: (user_id, anchor)."""
        n = self.orders.groupBy("o_custkey").count().join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return n.groupBy("c_mktsegment").agg(F.max(F.struct("count", "c_custkey")).alias("b")).select(F.concat(F.lit("u:"), "c_mktsegment").alias("user_id"), F.concat(F.lit("c"), F.col("b.c_custkey").cast("string")).alias("anchor"))

    @cached_property
    def asked(self) -> DataFrame:
        """Queries of every kind for each nation: (query_id, text)."""
        first = self.people.groupBy("company").agg(F.min("name").alias("first"), F.max("name").alias("last"), F.max("email").alias("email"))
        kinds = [("a", F.concat(F.lit("people at "), "company")), ("b", F.concat(F.lit("intro to "), "first")), ("c", F.concat(F.lit("mail of "), "email")), ("d", F.concat(F.replace(F.lower("company"), F.lit("_"), F.lit("-")), F.lit(".com"))), ("e", F.concat(F.lit("Find the "), "last")), ("f", F.lit("who is the"))]
        return first.select("company", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), t.alias("text")) for k, t in kinds])).alias("q")).select(F.concat("q.k", F.lit(":"), "company").alias("query_id"), "q.text")


PEOPLE = """people AS (
  SELECT 'c' || c_custkey AS entity_id, c_name AS name, 'c' || c_custkey || '@' || replace(lower(n_name), '_', '-') || '.com' AS email, n_name AS company, c_mktsegment AS title, r_name AS location, c_custkey AS seq
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 's' || s_suppkey, s_name, 's' || s_suppkey || '@' || replace(lower(n_name), '_', '-') || '.com', n_name, 'SUPPLIER', r_name, 1000000000 + s_suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CONTACTS = PEOPLE + """,
crow AS (
  SELECT *, seq * 10 AS raw_event_id, name || ' of  ' || company AS disp, 'people/' || entity_id AS sid FROM people
  UNION ALL SELECT *, seq * 10 + 1, 'Re ' || name, 'people/' || entity_id || '/2' FROM people WHERE seq % 10 = 0),
ckind AS (
  SELECT *, CASE WHEN seq % 17 = 0 THEN 'bad' WHEN seq % 13 = 0 THEN 'noemail' WHEN seq % 11 = 0 THEN 'noname' WHEN seq % 7 = 0 THEN 'flat' ELSE 'full' END AS kind,
    CASE WHEN seq % 4 = 0 THEN ' ' || lower(company) || '  group' ELSE company END AS comp, 1704067200 + (seq % 1000) * 3600 AS t_s FROM crow),
contacts AS (
  SELECT raw_event_id, sid, t_s, seq, entity_id, kind, title AS raw_title, comp, email, CASE WHEN kind = 'noname' THEN 'Unknown' ELSE disp END AS full_name,
    CASE WHEN kind <> 'noname' THEN split_part(disp, ' ', 1) END AS first_name, CASE WHEN kind <> 'noname' THEN substr(replace(disp, '  ', ' '), strpos(disp, ' ') + 1) END AS last_name,
    CASE WHEN kind = 'noemail' THEN '' ELSE email END AS emails, CASE WHEN kind = 'full' THEN '+1-' || entity_id ELSE '' END AS phones,
    CASE WHEN kind = 'noname' THEN 'missing_contact_name' ELSE '' END AS warnings,
    'Nation_' || substr(company, 8) || CASE WHEN seq % 4 = 0 THEN ' Group' ELSE '' END AS company_t, upper(title[1]) || lower(title[2:]) AS title_t
  FROM ckind WHERE kind <> 'bad'),
tagged AS (SELECT *, 'company:' || replace(lower(company_t), ' ', '_') || ',title:' || replace(lower(title_t), ' ', '_') AS tags FROM contacts)"""
ORDERS = PEOPLE + """,
op AS (SELECT o.*, p.email, p.name FROM orders o JOIN people p ON p.entity_id = 'c' || o_custkey),
sup AS (SELECT DISTINCT l_orderkey AS k, p.email FROM lineitem JOIN people p ON p.entity_id = 's' || l_suppkey),
sups AS (SELECT k, string_agg(email, ',' ORDER BY email) AS to_list FROM sup GROUP BY k),
att AS (SELECT k, email FROM sup WHERE k IN (SELECT o_orderkey FROM op) UNION SELECT o_orderkey, email FROM op),
atts AS (SELECT k, string_agg(email, ',' ORDER BY email) AS who, count(*) AS n FROM att GROUP BY k),
mail AS (SELECT o_orderkey AS k, 'm' || o_orderkey AS sid, o_orderkey + 50000000000 AS raw_event_id, lower(name) || ' <' || email || '>' AS sender, email, coalesce(to_list, '') AS recipients,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN 'old' END AS subject, o_orderstatus AS snippet, 'th' || o_orderkey % 1000 AS thread_id,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) + CASE WHEN o_orderkey % 4 = 3 THEN 86400 ELSE 0 END AS t_s FROM op LEFT JOIN sups ON k = o_orderkey),
meet AS (SELECT o_orderkey AS k, 'e' || o_orderkey AS sid, o_orderkey + 70000000000 AS raw_event_id, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderpriority END AS summary, 'Room ' || o_orderkey % 5 AS location, who, n,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS start_at, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t_s FROM op JOIN atts ON k = o_orderkey)"""
INTER = ORDERS + """,
inter AS MATERIALIZED (
  SELECT 'email' AS kind, m.t_s, m.email AS actor, s.email AS target, m.subject AS topic, m.sid FROM mail m JOIN sup s ON s.k = m.k
  UNION ALL SELECT 'meeting', m.t_s, a.email, b.email, m.summary, m.sid FROM meet m JOIN att a ON a.k = m.k JOIN att b ON b.k = m.k WHERE a.email <> b.email)"""
KNOWS = PEOPLE + """,
os AS MATERIALIZED (SELECT DISTINCT o_orderkey AS k, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t_s, 'c' || o_custkey AS c, 's' || l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
who AS MATERIALIZED (SELECT DISTINCT k, t_s, c AS p FROM os UNION SELECT DISTINCT k, t_s, s FROM os),
pairs AS MATERIALIZED (SELECT 'email' AS kind, t_s, c AS from_id, s AS to_id, 'm' || k AS event FROM os UNION ALL SELECT 'meeting', a.t_s, a.p, b.p, 'e' || a.k FROM who a JOIN who b ON a.k = b.k WHERE a.p <> b.p),
knows AS MATERIALIZED (SELECT from_id, to_id, count(*) AS interaction_count, round(least(1e0, count(*) / 1e1), 4) AS strength, max(t_s) AS last_at FROM pairs GROUP BY 1, 2),
anchors AS MATERIALIZED (SELECT 'u:' || c_mktsegment AS user_id, 'c' || c_custkey AS anchor FROM (
  SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_custkey DESC) AS r
  FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey) WHERE r = 1)"""
ASKED = """firsts AS (SELECT company, min(name) AS first, max(name) AS last, max(email) AS email FROM people GROUP BY company),
asked AS (
  SELECT 'a:' || company AS query_id, 'people at ' || company AS text, company, first, last, email FROM firsts UNION ALL SELECT 'b:' || company, 'intro to ' || first, company, first, last, email FROM firsts
  UNION ALL SELECT 'c:' || company, 'mail of ' || email, company, first, last, email FROM firsts UNION ALL SELECT 'd:' || company, replace(lower(company), '_', '-') || '.com', company, first, last, email FROM firsts
  UNION ALL SELECT 'e:' || company, 'Find the ' || last, company, first, last, email FROM firsts UNION ALL SELECT 'f:' || company, 'who is the', company, first, last, email FROM firsts)"""
