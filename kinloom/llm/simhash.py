"""SimHash near-duplicates (operator 10).

Fingerprints are made in Arrow batches. Links (fingerprints at most ``RADIUS`` bits apart) are found by pigeonring
filtering: the 64 bits are a ring of four 16-bit segments; if two fingerprints differ in at most 3 bits, there is a
segment from which every chain of consecutive segments stays within its share of the budget: no difference in the
first, at most 1 in the first two, 2 in three, 3 in all four. The index holds, for each start, the first segment and
the second with at most one bit flipped, so an equality join finds all chains of length two; where so many distinct
fingerprints share a key that pairs would pile up, the key is lengthened to three segments. Longer chains and the
whole distance are then checked on what is left. Equal fingerprints are collapsed before, so copies form no pairs, and
a fingerprint has at most 43,744 links (all words of 64 bits within 3), whatever the corpus.

A fingerprint, a component or the neighbours of a node may hold a third of all rows: where rows meet what is known of
their key, heavy keys go by broadcast and only the others by a shuffle (see spread_join).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, spread_join

RADIUS = 3
#: Keys under which probes times index rows exceed this get the longer chain.
CROWDED = 4096


def fingerprint(text: str | None, k: int = 3) -> int:
    """The 64-bit SimHash of whole ``text``: A-Z lower-cased, ``k``-word shingles with repeats, XXH64 with seed 42."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.array([len(w) + 1 for w in words])).tolist()[: len(words) - k + 1]
    ends = (ends - 1).tolist()[k - 1 :]
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], dtype=">u8")
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, row_col: str | None = None) -> DataFrame:
    """(doc_id, fp long) for each row, and with ``row_col`` (a text) also row and text_hash; null and empty texts have 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), k) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    more = [F.col(row_col).cast("string").alias("row"), F.xxhash64(F.col(text_col)).alias("text_hash")] if row_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    return rows.mapInArrow(work, "doc_id long, fp long" + (", row string, text_hash long" if row_col else ""))


def _segment(fp: Column | str, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


_ONE = [1 << b for b in range(16)]
_TWO = [a | b for i, a in enumerate(_ONE) for b in _ONE[:i]]


def _flips(masks: list[int]) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in masks])


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct long values ``fp`` that differ in at most RADIUS bits; each pair once."""
    starts = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), _segment("fp", i).alias("s0"), _segment("fp", i + 1).alias("s1"), _segment("fp", i + 2).alias("s2")) for i in range(4)]))
    rows = fps.select("fp", starts.alias("c")).select("fp", "c.*")

    def key(second: Column) -> Column:
        return F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("s0"), 16)).bitwiseOR(second).alias("key")

    probe = rows.select(key(F.col("s1")), "fp", "s2")
    # One of two segments a bit apart has an odd number of ones: flipping only those finds each such pair once.
    flips = F.when(F.bit_count("s1") % 2 == 1, _flips([0, *_ONE])).otherwise(_flips([0]))
    index = rows.select("fp", "start", "s0", "s1", "s2", F.explode(flips).alias("m")).select(key(F.col("s1").bitwiseXOR(F.col("m"))), F.col("fp").alias("fp2"), F.col("s2").alias("t2"), (F.col("m") != 0).cast("int").alias("used"))
    crowds = probe.groupBy("key").agg(F.count("*").alias("np")).join(index.groupBy("key").agg(F.count("*").alias("ni")), "key").where(F.col("np") * F.col("ni") > CROWDED).select("key")
    crowds = materialise(crowds, "crowded-keys")

    def checked(pairs: DataFrame) -> DataFrame:
        near = (_differ(F.col("s2"), F.col("t2")) + F.col("used") <= 2) & (_differ(F.col("fp"), F.col("fp2")) <= RADIUS) & (F.col("fp") != F.col("fp2"))
        return pairs.where(near).select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"))

    # The sides are some times larger than what Spark expects of an explode, so they are shuffled whatever it expects.
    if crowds.isEmpty():
        return checked(probe.join(index.hint("merge"), "key")).distinct()
    crowded = lambda df, how: df.join(crowds, "key", how)
    short = checked(crowded(probe, "left_anti").join(crowded(index, "left_anti").hint("merge"), "key"))
    masks = F.when(F.col("used") == 0, _flips([0, *_ONE, *_TWO])).otherwise(_flips([0, *_ONE]))
    longer = crowded(index, "left_semi").withColumn("m", F.explode(masks)).withColumn("third", F.col("t2").bitwiseXOR(F.col("m")))
    chains = checked(crowded(probe, "left_semi").withColumn("third", F.col("s2")).join(longer.hint("merge"), ["key", "third"]))
    return short.unionByName(chains).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b), the smallest node that it reaches.

    Alternating large-star and small-star rounds; each is aggregations and equality joins, written to shared storage.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())

    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = spread_join(both.where("b > a"), least, "a", "n", seen[0])
        large = materialise(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, "a", "n", large.count())
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = materialise(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        mark_now = mark(now)
        if mark_now == seen:
            break
        seen = mark_now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, row_col: str | None = None) -> DataFrame:
    """One row (doc_id, fp, component, component_id, n_links) for each row of ``docs``; with ``row_col`` also row and text_hash.

    component: the smallest fingerprint (as a signed number) reachable over links of at most RADIUS bits. component_id:
    the smallest doc_id of those, null ids last. n_links: the number of other distinct fingerprints linked to its own.
    Null or empty texts: fingerprint 0, linked like any other. Rows that repeat a doc_id each keep their row. An empty
    table gives no rows; extra columns are ignored.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, k, row_col), "fingerprints")
    total = fps.count()
    first = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    pairs = materialise(links(first), "links")
    comp = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    joined = first.join(comp, first["fp"] == comp["node"], "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    joined = materialise(joined.join(degree, "fp", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))), "memberships")
    smallest = materialise(joined.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "components")
    classes = spread_join(joined, smallest, "component", "members", total)
    classes = materialise(classes.select("fp", "component", "component_id", "n_links", "n"), "classes")
    more = ["row", "text_hash"] if row_col else []
    return spread_join(fps, classes, "fp", "n", total).select("doc_id", "fp", "component", "component_id", "n_links", *more)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: fingerprint in hex and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
