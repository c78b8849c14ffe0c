"""Benchmark decontamination with SimHash windows (operator 1); DataFrame functions only.

A document is contaminated by a benchmark item if a window of the item's size in it has a weighted-shingle similarity
of ``SIMILAR`` or more with the item. Windows get a SimHash of their ``SHINGLE``-word shingles. The index cuts the 64 bits
of the items' SimHashes into BLOCKS blocks, each with up to FLIPS bits flipped: two fingerprints that differ in at most
RADIUS bits differ in at most FLIPS bits in one of the blocks, so an equality join finds every item within RADIUS of a
window. The exact similarity then decides.

A similarity of 0.8 is about 10 of 64 bits and may be more than RADIUS. An index that guarantees those needs so many or
so narrow blocks that it finds nearly all pairs. So what lies beyond RADIUS is found by an exact way beside it: two bags
of such a similarity share one of their rarest shingles (a share of 1 - SIMILAR of them, and one), so an equality join of
those finds them all. A shingle that thousands of items share is among the rarest of hardly any.

A similarity of s between bags of a and b shingles needs s * (a + b) / (1 + s) shared ones. So only windows with so many
positions that hold a shingle of some item of their size are fingerprinted, wherever in the window these stand: all starts
from which the window spans that many. That join is by equality of shingle hashes; hashes only propose, and the
similarity is counted on words. A text shorter than an item is one window as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, materialise, small

SHINGLE, SIMILAR = 5, 0.8
BLOCKS, FLIPS = 4, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; marks and white space only part them. Null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles(ws: Column, k: Column) -> Column:
    """The ``k``-word shingles of an array of at least k > 0 words, in order, repeats included."""
    return F.transform(F.sequence(F.lit(1), F.size(ws) - k + 1), lambda i: F.array_join(F.slice(ws, i, k), " "))


def simhash(hashes: Column) -> Column:
    """The SimHash of an array of 64-bit hashes: a bit is set if it is in over half of them; repeats weigh as often."""
    spread = 0x0000000100000001  # two 32-bit counters in a long: bits b and b + 32

    def total_of(b: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(spread)))

    total = [total_of(b) for b in range(32)]
    half = F.size(hashes)

    def packed(counts: Column) -> Column:
        low = [F.when(F.get(counts, b).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > half, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(32)]
        high = [F.when(F.shiftrightunsigned(F.get(counts, b), 32) * 2 > half, F.shiftleft(F.lit(1).cast("long"), b + 32)).otherwise(F.lit(0).cast("long")) for b in range(32)]
        return reduce(lambda x, y: x.bitwiseOR(y), low + high)

    return F.get(F.transform(F.array(F.array(*total)), packed), 0)


def _hashed(sh: Column) -> Column:
    return F.transform(sh, lambda s: F.xxhash64(s))


def block(fp: Column, i: int) -> Column:
    """Block ``i`` of the bits of ``fp``."""
    bits = 64 // BLOCKS
    return F.shiftrightunsigned(fp, bits * i).bitwiseAND(F.lit((1 << bits) - 1))


def flips() -> list[int]:
    """All masks of a block with at most FLIPS bits."""
    masks = {0}
    for _ in range(FLIPS):
        masks |= {m | 1 << b for m in masks for b in range(64 // BLOCKS)}
    return sorted(masks)


def near(kinds: DataFrame, items: DataFrame) -> DataFrame:
    """(wid, n, item_id) of the windows (wid, n, fp) and the items (item_id, n, fp) within RADIUS bits of each other."""
    cut = F.inline(F.array(*[F.struct(F.lit(i).alias("no"), block(F.col("fp"), i).alias("bits")) for i in range(BLOCKS)]))
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in flips()]))
    index = items.select("item_id", "n", F.col("fp").alias("item_fp"), cut).select("*", masks.alias("m"))
    index = index.select("item_id", "n", "item_fp", "no", F.col("bits").bitwiseXOR(F.col("m")).alias("bits"))
    found = kinds.select("wid", "n", "fp", cut).join(index, ["n", "no", "bits"])
    return found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("wid", "n", "item_id").distinct()


def _elements(sh: Column) -> Column:
    """The shingles of a bag, repeats told apart by their number: (hash, how many of it came before)."""
    hs = _hashed(sh)
    return F.transform(hs, lambda h, i: F.struct(h.alias("h"), F.size(F.filter(F.slice(hs, 1, i), lambda x: x == h)).alias("occ")))


def beside(kinds: DataFrame, items: DataFrame, similar: float) -> DataFrame:
    """(wid, n, item_id) of the windows (wid, n, sh) and items (item_id, n, sh) that share one of their rarest shingles."""
    own = materialise(items.select("item_id", "n", F.size("sh").alias("size"), F.inline(_elements(F.col("sh")))), "item-elements")
    often = own.groupBy("n", "h", "occ").agg(F.count("*").alias("often"))

    def rarest(elements: DataFrame, key: str) -> DataFrame:
        """The prefix of each bag in the order of how many items have an element; what no item has comes first."""
        ranked = elements.join(F.broadcast(often) if few else often, ["n", "h", "occ"], "left")
        ranked = ranked.groupBy(key, "n", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "h", "occ"))).alias("e"))
        length = (F.col("size") - F.ceil(F.col("size") * similar - 1e-6) + 1).cast("int")
        return ranked.select(key, "n", F.inline(F.slice("e", 1, length))).where("often > 0").drop("often")

    few = small(often)
    mine = rarest(own, "item_id")
    theirs = rarest(kinds.select("wid", "n", F.size("sh").alias("size"), F.inline(_elements(F.col("sh")))), "wid")
    return theirs.join(mine, ["n", "h", "occ"]).select("wid", "n", "item_id").distinct()


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles: sum of lesser counts over sum of greater counts."""
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))))
    return both / (F.size(a) + F.size(b) - both)


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n, ws, k, sh, fp) of each item with a word; k is the shingle size: all words of an item with fewer than SHINGLE."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("ws")).where("size(ws) > 0")
    rows = rows.withColumn("n", F.size("ws")).withColumn("k", F.least("n", F.lit(SHINGLE)))
    return rows.withColumn("sh", shingles(F.col("ws"), F.col("k"))).withColumn("fp", simhash(_hashed(F.col("sh"))))


def window_starts(hits: DataFrame, similar: float) -> DataFrame:
    """(doc_id, row, n, k, start) of all windows that have shared shingles enough for ``similar``, once each.

    hits: (doc_id, row, size, n, k, pos), the positions of a text's shingles that are in an item of n words. Hits i to
    i + need - 1, if they fit in a window, are spanned by the starts from the last less the window's length to the first.
    """
    hits = hits.withColumn("whole", F.least("n", "size") - F.col("k") + 1)
    # The slack is for rounding: a start too many is harmless.
    need = F.ceil((F.col("n") - F.col("k") + 1 + F.col("whole")) * (similar / (1 + similar)) - 1e-6).cast("int")
    hits = hits.withColumn("need", F.greatest(F.lit(1), need))
    held = hits.groupBy("doc_id", "row", "size", "n", "k", "whole", "need").agg(F.array_sort(F.collect_set("pos")).alias("at")).where(F.size("at") >= F.col("need"))
    first = F.explode(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.struct(F.get("at", i).alias("low"), F.get("at", i + F.col("need") - 1).alias("high"))))
    spans = held.select("doc_id", "row", "size", "n", "k", "whole", first.alias("s")).where(F.col("s.high") - F.col("s.low") < F.col("whole"))
    low, high = F.greatest(F.lit(0), F.col("s.high") - F.col("whole") + 1), F.least(F.col("s.low"), F.col("size") - F.col("k") + 1 - F.col("whole"))
    return spans.select("doc_id", "row", "n", "k", low.alias("low"), high.alias("high")).distinct().where("low <= high").select("doc_id", "row", "n", "k", F.explode(F.sequence("low", "high")).alias("start")).distinct()


def _span(hs: Column, at: Column, k: int) -> Column:
    """The hash of the ``k`` word hashes from ``at`` on."""
    return F.xxhash64(*[F.get(hs, at + i) for i in range(k)])


def shared(rows: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, row, size, n, k, pos): where ``rows`` (doc_id, row, ws) have a shingle of an item of n words, for each such n."""
    found = []
    for k in sizes:
        own = items.where(F.col("k") == k).select("n", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - k)).alias("pos"))
        grams = materialise(own.select("n", _span(_hashed(F.col("ws")), F.col("pos"), k).alias("h")).distinct(), "item-shingles")
        mine = rows.where(F.size("ws") >= k).select("doc_id", "row", F.size("ws").alias("size"), _hashed(F.col("ws")).alias("hs"))
        # Word hashes are taken once; a shingle's is made of them in the row that its position becomes.
        mine = mine.select("doc_id", "row", "size", "hs", F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("pos"))
        found.append(attach(mine.select("doc_id", "row", "size", "pos", _span(F.col("hs"), F.col("pos"), k).alias("h")), grams, "h").select("doc_id", "row", "size", "n", F.lit(k).alias("k"), "pos"))
    return reduce(DataFrame.unionByName, found)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row (doc_id, item_id, start, n_words, similarity, distance) for each document and item that it holds.

    start: the first word of the most similar window (ties: the first); n_words: its size, which is the item's, or the
    text's if that is shorter; distance: bits between the SimHashes. Null and empty texts and items give no rows. Rows
    that repeat a doc_id count as one document with all their windows; a null doc_id gives no rows. Empty tables give no
    rows; extra columns are ignored.
    """
    items = materialise(items_of(benchmark), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SHINGLE values
    if not sizes:
        none = {"start": "long", "n_words": "long", "similarity": "double", "distance": "int"}
        ids = docs.select(F.col(id_col).alias("doc_id")).crossJoin(benchmark.select("item_id").limit(0))
        return ids.withColumns({c: F.lit(None).cast(k) for c, k in none.items()})
    # ``row`` tells rows that repeat a doc_id apart.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text")).where("doc_id is not null")
    split = rows.select("doc_id", "row", words(F.col("text")).alias("ws"))
    hits = materialise(shared(split, items, sizes), "shared-shingles")
    starts = window_starts(hits, similar).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n", "k")).alias("starts"))
    starts = materialise(starts, "window-starts")
    held = rows.join(F.broadcast(starts) if small(starts) else starts, ["doc_id", "row"])
    held = held.select("doc_id", words(F.col("text")).alias("ws"), "starts")
    windows = held.select("doc_id", F.inline(F.transform("starts", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["k"].alias("k"), F.slice("ws", s["start"] + 1, s["n"]).alias("win")))))
    # Equal windows, of which a passage that many documents share makes as many, are judged once.
    windows = materialise(windows.withColumn("wid", F.sha2(F.array_join("win", " "), 256)), "windows")
    kinds = windows.groupBy("wid", "n", "k").agg(F.any_value("win").alias("win"))
    kinds = materialise(kinds.withColumn("sh", shingles(F.col("win"), F.col("k"))).withColumn("hs", _hashed(F.col("sh"))).drop("win"), "window-shingles")
    kinds = materialise(kinds.withColumn("fp", simhash(F.col("hs"))).drop("hs"), "window-kinds")
    pairs = near(kinds, items).unionByName(beside(kinds, items, similar)).distinct()
    of_item = items.select(F.col("item_id").alias("_item"), "n", F.col("sh").alias("item_sh"), F.col("fp").alias("item_fp"))
    judged = pairs.join(kinds.select("wid", "n", "sh", "fp"), ["wid", "n"]).join(of_item.withColumnRenamed("n", "_n"), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("n") == F.col("_n")))
    judged = judged.withColumn("similarity", similarity(F.col("sh"), F.col("item_sh"))).where(F.col("similarity") >= similar)
    judged = materialise(judged.select("wid", "n", "item_id", "similarity", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance")), "judged")
    found = attach(windows.select("doc_id", "start", F.col("n").alias("_n"), "wid", F.size("win").alias("size")), judged, "wid").where("n = _n")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "size", "distance")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.before")).cast("long").alias("start"), F.col("b.size").cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"), F.col("b.distance").alias("distance"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document and the benchmark items that it holds."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
