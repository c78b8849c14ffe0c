"""Ranked lexical search, reversed (operator 12): the items are indexed and the documents stream through the index.

Items are few against documents, so it is their terms that get an inverted index: for each term, the items that hold it.
It is broadcast; items beyond a bound of bytes are taken in blocks, each with an index and a pass of its own. A first
pass turns each document into its length and its counts of the index's terms, which are written; from these come the
corpus' statistics (documents, terms, document frequencies). The second streams the counts through the index: each
posting adds to the scores of its term's items, and every task keeps, for each item, a heap of its best documents. The
heaps are bounded, and are merged in two rounds, so no task reads the heaps of all tasks.

Scores are 64-bit integers (term weights are the floor of a double), so order of addition doesn't matter.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, numbered

BEST = 10
#: Bytes of item texts in one index; scores (documents times items) and postings that are looked at together.
ITEM_BYTES, CELLS, POSTINGS = 32 << 20, 1 << 21, 1 << 16
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Groups in which the tasks' heaps are merged first.
GROUPS = 64
#: 100 times the share of length in a document's norm.
LENGTH_SHARE = 90

# 0-9, A-Z as a-z, a-z and all bytes of code points from U+0080 on stay; every other byte parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: str | None) -> Counter[bytes]:
    """The terms of whole ``text`` (UTF-8) and how often they occur; null has none."""
    raw = (text or "").encode().translate(_TERM_BYTES)
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


@dataclass
class Index:
    """Of each term its number; of each number its items (``items[offset[t]:offset[t + 1]]``) and weight."""

    number: dict[bytes, int]
    offset: np.ndarray
    items: np.ndarray
    n_items: int
    weight: np.ndarray | None = None
    documents: int = 0
    length: int = 0


def index_of(texts: Iterable[str | None]) -> Index:
    """The inverted index over the items' terms, each once an item."""
    number: dict[bytes, int] = {}
    postings: list[list[int]] = []
    n = 0
    for n, text in enumerate(texts, 1):
        for term in term_counts(text):
            k = number.setdefault(term, len(number))
            if k == len(postings):
                postings.append([])
            postings[k].append(n - 1)
    offset = np.zeros(len(postings) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in postings], out=offset[1:])
    return Index(number, offset, np.array([i for p in postings for i in p], dtype=np.int64), n)


def weight(documents: int, df: int) -> int:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def norm(n: int, documents: int, length: int) -> int:
    """A document's m, from its terms and the corpus' documents and terms."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // length


class Best:
    """For each item the ``k`` best documents so far: highest score, then smallest doc_id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        # A document gets onto a full heap if its score is higher than its least one, or equal and the id smaller.
        self.least = np.ones(n_items, dtype=np.int64)
        self.last = np.full(n_items, np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """Scores of some documents (rows) for all items (columns)."""
        own = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], dtype=np.int64)
        rows, cols = np.nonzero((scores > self.least) | ((scores == self.least) & (own[:, None] <= self.last)))
        for r, c, s in zip(rows.tolist(), cols.tolist(), scores[rows, cols].tolist(), strict=True):
            heap, one = self.heaps[c], (s, ids[r] is not None, -(ids[r] or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, one)
            elif one > heap[0]:
                heapq.heapreplace(heap, one)
            if len(heap) == self.k:
                self.least[c], self.last[c] = heap[0][0], -heap[0][2] if heap[0][1] else np.iinfo(np.int64).max

    def rows(self) -> tuple[list[int], list[int], list[int | None]]:
        flat = [(i, s, -d if known else None) for i, heap in enumerate(self.heaps) for s, known, d in heap]
        return tuple([x[j] for x in flat] for j in range(3))


def scores(index: Index, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    """Documents times items: the sum over shared terms of w * ((10**9 tf) div (1000 tf + 8 m))."""
    m = np.array([norm(x, index.documents, index.length) for x in n.tolist()], dtype=np.int64)
    of = np.repeat(np.arange(len(n)), np.diff(offsets))
    gain = index.weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[of]))
    many = index.offset[terms + 1] - index.offset[terms]
    at = np.repeat(index.offset[terms] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    out = np.zeros(len(n) * index.n_items, dtype=np.int64)
    np.add.at(out, np.repeat(of * index.n_items, many) + index.items[at], np.repeat(gain, many))
    return out.reshape(len(n), index.n_items)


COUNTS = "doc_id long, n long, terms array<int>, tfs array<long>"


def document_terms(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): each row's terms with repeats, and the counts of those that ``index`` has."""
    held = docs.sparkSession.sparkContext.broadcast(index.number)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for b in batches:
            n, ends, terms, tfs = [], [0], [], []
            for t in b.column(1):
                found = term_counts(t.as_py())
                n.append(found.total())
                for term in found.keys() & number.keys():
                    terms.append(number[term])
                    tfs.append(found[term])
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, COUNTS)


def best_documents(counts: DataFrame, index: Index, k: int = BEST) -> DataFrame:
    """(item, score, doc_id): of each task's documents the ``k`` best of every item of ``index``, by its number."""
    held = counts.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        best, most = Best(index.n_items, k), max(1, CELLS // max(index.n_items, 1))
        for b in batches:
            ids, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            offsets = b.column(2).offsets.to_numpy().astype(np.int64)
            terms, tfs = b.column(2).values.to_numpy().astype(np.int64), b.column(3).values.to_numpy()
            at = 0
            while at < len(ids):
                to = min(at + most, max(at + 1, int(np.searchsorted(offsets, offsets[at] + POSTINGS, "right")) - 1), len(ids))
                x, y = offsets[at], offsets[to]
                best.add(scores(index, n[at:to], offsets[at : to + 1] - x, terms[x:y], tfs[x:y]), ids[at:to])
                at = to
        cols = zip(best.rows(), (pa.int64(), pa.int64(), pa.int64()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["item", "score", "doc_id"])

    return counts.mapInArrow(work, "item long, score long, doc_id long")


def merged_heaps(heaps: DataFrame, k: int = BEST) -> DataFrame:
    """(item, rank, doc_id, score): the tasks' heaps merged, first in GROUPS groups of tasks, then all."""

    def top(df: DataFrame, *keys: Column | str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    groups = top(heaps.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS))), "item", "part")
    return top(groups.select("item", "score", "doc_id"), "item").select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its ``k`` highest-scoring rows of ``docs`` with a score above 0.

    Terms are maximal runs of 0-9, A-Z (as a-z), a-z and of code points from U+0080 on. Equal scores go by ascending
    doc_id, null ids last; ranks are unique. Every row of ``docs`` is a document and every row of ``items`` an item, also
    where ids repeat or are null. Null or empty texts have no terms: such documents are not counted, such items get no
    rows; nor do items whose terms no document holds. An empty table on either side gives no rows. Extra columns are
    ignored.

    Items are taken in as many blocks as their texts need at ``item_bytes`` each; a block costs a pass over ``docs``.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("item_text"))
    rows, row = numbered(materialise(rows, "items"), "_row")
    blocks = 1 + (rows.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0) // item_bytes
    found = []
    for block in range(blocks):
        here = rows.where(F.pmod(F.xxhash64(row), F.lit(blocks)) == block).select("item_id", "item_text").collect()
        index = index_of(r["item_text"] for r in here)
        counts = materialise(document_terms(docs, index, id_col, text_col), "term-counts")
        index.documents, index.length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        index.weight = np.array([weight(index.documents, df.get(t, 0)) for t in range(len(index.number))], dtype=np.int64)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(here)], f"item long, item_id {rows.schema['item_id'].dataType.simpleString()}")
        best = merged_heaps(best_documents(counts, index, k), k)
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the ten best documents of every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
items AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
norms AS (SELECT r, 100 - 90 + (90 * n * docs) // terms AS m FROM lengths, corpus),
scored AS (
  SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY i, r),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
