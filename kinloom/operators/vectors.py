"""An inverted-file index over vectors with product-quantised residuals.

Vectors are scaled to length one, so cosine is the inner product. Coarse centroids part them into lists; what is left of a
vector after its centroid is cut into parts, and each part is stored as the number of the nearest of 256 codewords. The
model (centroids and codewords) is fitted on a bounded sample; every vector is assigned and coded. A search takes the
lists whose centroids are nearest, adds up table entries in place of reading vectors, keeps a bounded heap of each query in
every task, and ranks the best candidates anew by exact cosine. How many lists are probed and how many candidates are
ranked follow from a target of recall, measured on the sample.

documents.nearest() is the exact way, and what recall is measured against.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.session import materialise

#: Vectors that a model is fitted on at most, rounds of fitting, and vectors of the sample that stand in for queries.
SAMPLE, ROUNDS, TRIALS = 20_000, 12, 300
#: Queries whose tables are broadcast at once.
BLOCK = 2_000
#: Groups in which the tasks' heaps are merged first.
GROUPS = 64
WORDS = 256


@dataclass
class Model:
    """Centroids (lists x dimensions), codewords (parts x 256 x dimensions of a part), and what a search needs for its recall."""

    centroids: np.ndarray
    codewords: np.ndarray
    probes: int = 1
    candidates: int = 100

    @property
    def parts(self) -> int:
        return len(self.codewords)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row of ``x`` and the codes of what is left."""
        at = np.argmax(x @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1), axis=1)
        left = (x - self.centroids[at]).reshape(len(x), self.parts, -1)
        codes = [_nearest(left[:, p], self.codewords[p]) for p in range(self.parts)]
        return at, np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all codewords: queries x parts x 256."""
        return np.einsum("qpd,pwd->qpw", q.reshape(len(q), self.parts, -1), self.codewords)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The nearest lists of each query, best first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids; an empty one starts again at a row."""
    now = x[rng.permutation(len(x))[:k]]
    now = now if len(now) == k else np.concatenate([now, np.zeros((k - len(now), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        at = _nearest(x, now)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(now)
        np.add.at(sums, at, x)
        now = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return now


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero stays."""
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of rows that have a vector without nulls."""
    v = F.col(vector_col)
    return df.select(F.col(id_col).alias("id"), F.transform(v, lambda x: x.cast("float")).alias("v")).where(F.size("v") > 0).where(~F.exists("v", lambda x: x.isNull()))


def fit(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, parts: int = 16,
    recall: float = 0.95, k: int = 5, sample: int = SAMPLE, seed: int = 3,
) -> Model:
    """A model from about ``sample`` vectors, drawn by the hash of their ids (all, if there are fewer).

    ``lists``: by default the square root of the number of vectors, but no more than a sample of 30 rows a list fits.
    Vectors of a length that ``parts`` doesn't divide are filled up with zeros. ``recall`` is reached at ``k`` on the
    sample, some of whose vectors stand in for queries.
    """
    rows = _usable(vectors, id_col, vector_col)
    total = rows.count()
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1)))
    x = _matrix(rows.where(draw).orderBy("id").select("v").limit(2 * sample).toArrow().column(0).combine_chunks(), parts)
    if not len(x):
        raise ValueError("an index needs vectors")
    rng = np.random.default_rng(seed)
    n_lists = lists or max(1, min(round(total**0.5), len(x) // 30 or 1))
    centroids = _k_means(x, n_lists, ROUNDS, rng)
    left = (x - centroids[_nearest(x, centroids)]).reshape(len(x), parts, -1)
    model = Model(centroids, np.stack([_k_means(left[:, p], WORDS, ROUNDS, rng) for p in range(parts)]))
    _settle(model, x, recall, k, rng)
    return model


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Unit vectors as rows, filled up to a multiple of ``parts``. All have the same length."""
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, parts), np.float32)
    sizes = np.diff(column.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors of one index have one length")
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(len(column), -1)
    return unit(np.pad(x, ((0, 0), (0, -x.shape[1] % parts))))


def _settle(model: Model, x: np.ndarray, recall: float, k: int, rng: np.random.Generator) -> None:
    """The fewest probes, then the fewest candidates, by which the sample's own nearest vectors are found."""
    trial = rng.permutation(len(x))[:TRIALS]
    exact = x[trial] @ x.T
    exact[np.arange(len(trial)), trial] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    at, codes = model.assign(x)
    order = np.argsort(-(x[trial] @ model.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each list among those of a query
    depth = np.sort(np.take_along_axis(place, at[best], axis=1).ravel())
    model.probes = min(len(model.centroids), int(depth[min(len(depth) - 1, int(np.ceil(len(depth) * (1 + recall) / 2)) - 1)]) + 1)
    table = model.tables(x[trial])
    near = x[trial] @ model.centroids.T
    rank = []
    for i in range(len(trial)):
        score = near[i, at] + table[i, np.arange(model.parts), codes].sum(axis=1)
        score[trial[i]] = -np.inf
        score[place[i, at] >= model.probes] = -np.inf
        rank.append((score[None, :] > score[best[i]][:, None]).sum(axis=1))
    rank = np.sort(np.concatenate(rank))
    model.candidates = max(4 * k, 2 * int(rank[min(len(rank) - 1, int(np.ceil(len(rank) * (1 + recall) / 2)) - 1)]) + 2)


INDEX = "list int, id long, code binary"


def build(vectors: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding", partitions: int | None = None) -> DataFrame:
    """Every usable vector with its list and code, written in order of lists so that a search reads what it probes.

    A list may hold a third of all vectors: the ranges are cut by (list, hash of the id).
    """
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            at, codes = held.value.assign(_matrix(b.column(1), held.value.parts))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "code"])

    n = partitions or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _usable(vectors, id_col, vector_col).select(F.col("id").cast("long").alias("id"), "v").mapInArrow(work, INDEX)
    return materialise(rows.repartitionByRange(n, "list", F.xxhash64("id")).sortWithinPartitions("list"), "vector-index")


def _heaped(index: DataFrame, held, k: int) -> DataFrame:
    """(query, id, score): each task's ``k`` best vectors of each query, by the tables."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, near, probed = held.value  # queries x parts x 256, queries x lists, queries of each list
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in (b for b in batches if b.num_rows):
            at, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
            for one in np.unique(at).tolist():
                rows = np.nonzero(at == one)[0]
                for q in probed.get(one, ()):
                    score = near[q, one] + table[q][np.arange(codes.shape[1]), codes[rows]].sum(axis=1)
                    old = best.get(q)
                    s, i = (score, ids[rows]) if old is None else (np.concatenate([old[0], score]), np.concatenate([old[1], ids[rows]]))
                    if len(s) > k:
                        keep = np.lexsort((i, -s))[:k]
                        s, i = s[keep], i[keep]
                    best[q] = (s, i)
        for q, (s, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q), pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.float32())], ["query", "id", "score"])

    return index.mapInArrow(work, "query int, id long, score float")


def _top(df: DataFrame, k: int, score: str, *keys: Column | str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    queries: DataFrame, vectors: DataFrame, index: DataFrame, model: Model, k: int = 5,
    query_col: str = "query_id", id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, candidates: int | None = None,
) -> DataFrame:
    """(query_id, vec_id, cosine, rank): about the ``k`` vectors of greatest cosine for each query, itself left out.

    Queries are taken BLOCK at a time; a block's tables are broadcast. Ties go by id. Rows without a vector have no
    answers and are none. Cosine is exact, of the candidates that were found.
    """
    spark = queries.sparkSession
    asked = materialise(_usable(queries, query_col, vector_col), "vector-queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    probe = Model(model.centroids, model.codewords, probes or model.probes, candidates or model.candidates)
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toArrow()
        q = _matrix(part.column(1).combine_chunks(), model.parts)
        lists: dict[int, list[int]] = {}
        for n, row in enumerate(probe.probed(q).tolist()):
            for one in row:
                lists.setdefault(one, []).append(n)
        held = spark.sparkContext.broadcast((model.tables(q), q @ model.centroids.T, lists))
        rows = index.where(F.col("list").isin(sorted(lists))) if len(lists) < len(model.centroids) // 2 else index
        heaps = _heaped(rows, held, probe.candidates + 1).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        near = _top(_top(heaps, probe.candidates + 1, "score", "query", "part").select("query", "id", "score"), probe.candidates + 1, "score", "query")
        names = spark.createDataFrame([(n, i) for n, i in enumerate(part.column(0).to_pylist())], f"query int, {query_col} long")
        hits = near.join(F.broadcast(names), "query").select(query_col, "id")
        found = hits if found is None else found.unionByName(hits)
    exact = lambda df, out: df.select("id", F.transform("v", lambda x: x.cast("double")).alias(out))
    hits = materialise(found.where(F.col(query_col) != F.col("id")), "candidates")
    # At most queries x candidates rows; a stated set of queries is small beside the vectors.
    wanted = exact(_usable(vectors, id_col, vector_col), "_v").join(hits, "id")
    wanted = wanted.join(exact(asked, "_q").withColumnRenamed("id", query_col), query_col)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot("_v", "_v")) * F.sqrt(dot("_q", "_q"))
    scored = wanted.select(query_col, "id", (dot("_q", "_v") / F.when(size > 0, size).otherwise(F.lit(1.0))).alias("cosine"))
    return _top(scored, k, "cosine", query_col).select(query_col, F.col("id").alias(id_col), "cosine", "rank")
