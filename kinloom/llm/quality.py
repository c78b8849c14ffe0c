"""Document quality by attention-based multiple-instance learning (operator 8).

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by measures of its characters and words and
by hashed counts of its words and pairs of words; a gated attention network, learned from document labels only, weighs the passages, and the weighted sum is scored. All passages
of the whole text count. Fitting uses a bounded sample of labelled rows; scoring runs over Arrow batches of all rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bounded_sample, mix64, prefix_hash, span_hash

PASSAGE = 64
#: Measures of form, and buckets of words and of pairs of words.
N_FORM, BUCKETS = 20, 64
N_FEATURES = N_FORM + 2 * BUCKETS
_KNOWN = 0x3000
#: What holds the weights back.
HOLD = np.float32(3e-4)
_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _BANG, _BAR, _MARK, _REST = range(9)


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(_KNOWN + 1, _REST, dtype=np.int64)
    for c in range(_KNOWN):
        ch = chr(c)
        kind = unicodedata.category(ch)
        out[c] = _SPACE if ch.isspace() else _UPPER if kind in ("Lu", "Lt") else _LOWER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _STOP if ch in ".,;:?'\"-()" else _BANG if ch == "!" else _BAR if ch == "|" else _MARK if kind[0] in "PS" else _REST
    return out


@lru_cache(1)
def _table() -> np.ndarray:
    return np.random.default_rng(8).integers(1, 1 << 63, _KNOWN + 1, dtype=np.uint64)


def encode(text: str | None) -> np.ndarray:
    """A row of N_FEATURES for each passage of the text; one row of zeros if it has no word."""
    cp = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    cp = np.minimum(cp, _KNOWN)
    kind = _classes()[cp]
    space = np.concatenate([[True], kind == _SPACE, [True]])
    edge = np.diff(space.view(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    n = len(start)
    if not n:
        return np.zeros((1, N_FEATURES), dtype=np.float32)
    first = np.arange(0, n, PASSAGE)
    m = len(first)
    cuts = np.concatenate([[0], start[first[1:]], [len(cp)]])
    of = np.repeat(np.arange(m), np.diff(cuts))
    chars = np.bincount(of * 9 + kind, minlength=9 * m).reshape(m, 9).astype(float)
    lines = np.bincount(of, weights=cp == 10, minlength=m)
    words = np.diff(np.append(first, n)).astype(float)
    size = (end - start).astype(float)
    passage = np.arange(n) // PASSAGE
    whole = span_hash(prefix_hash(cp, _table()), start, end)
    again = np.zeros(n)
    again[1:] = whole[1:] == whole[:-1]
    order = np.lexsort((whole, passage))
    fresh = np.ones(n)
    fresh[order[1:]] = (whole[order[1:]] != whole[order[:-1]]) | (passage[order[1:]] != passage[order[:-1]])
    seen = np.ones(n)
    by_word = np.argsort(whole, kind="stable")
    seen[by_word[1:]] = whole[by_word[1:]] == whole[by_word[:-1]]
    seen[by_word[0]] = 0
    mean = lambda v: np.add.reduceat(v, first) / words
    length = mean(size)
    letters = np.maximum(chars[:, _LOWER] + chars[:, _UPPER], 1)
    total = np.maximum(chars.sum(axis=1), 1)
    caps = (kind[start] == _UPPER).astype(float)
    ends = (kind[end - 1] >= _BANG).astype(float)
    f = [
        chars[:, _UPPER] / letters, chars[:, _DIGIT] / total, chars[:, _STOP] / words, chars[:, _BANG] / words, chars[:, _BAR] / words,
        chars[:, _MARK] / words, chars[:, _REST] / total, chars[:, _SPACE] / words, lines / words, length / 10,
        np.sqrt(np.maximum(mean(size**2) - length**2, 0)) / 10, mean(again), mean(fresh), mean(seen), mean(caps),
        mean(ends), mean((size > 20).astype(float)), np.log1p(words) / 4, np.full(m, np.log1p(n) / 10), letters / total,
    ]
    form = np.minimum(np.stack(f, axis=1), 4)
    pair = mix64(whole[:-1] * np.uint64(3) + whole[1:])
    grams = [np.bincount(of_gram * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=m * BUCKETS).reshape(m, BUCKETS) for of_gram, h in ((passage, mix64(whole)), (passage[:-1], pair))]
    return np.hstack([form, *(np.sqrt(g) / np.sqrt(words)[:, None] for g in grams)]).astype(np.float32)


class Network:
    """tanh encoding of passages, gated attention, and a linear score; trained by Adam on whole bags."""

    def __init__(self, width: int = 16, gate: int = 8, seed: int = 8):
        rng = np.random.default_rng(seed)
        shapes = {"W": (N_FEATURES, width), "b": (width,), "V": (width, gate), "U": (width, gate), "a": (gate,), "w": (width,), "c": ()}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(max(s[0] if s else 1, 1)), s) if k not in "bc" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """x: all bags' passages; starts: where each bag begins. No bag is empty."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["a"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        weight = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(weight[:, None] * h, starts)
        out = 1 / (1 + np.exp(-np.clip(z @ p["w"] + p["c"], -30, 30)))
        return out, x, h, t, s, weight, z, bag

    def fit(self, bags: list[np.ndarray], y: np.ndarray, rounds: int = 200, rate: float = 0.02) -> None:
        x = np.concatenate(bags)
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + np.float32(0.05)
        y = y.astype(np.float32)
        share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for k in range(1, rounds + 1):
            p = self.p
            out, xs, h, t, s, weight, z, bag = self.forward(x, starts)
            d = share * (out - y)
            g = {"w": z.T @ d + HOLD * p["w"], "c": d.sum()}
            dz = d[:, None] * p["w"]
            dh = weight[:, None] * dz[bag]
            dweight = (h * dz[bag]).sum(axis=1)
            de = weight * (dweight - np.add.reduceat(weight * dweight, starts)[bag])
            g["a"] = (t * s).T @ de
            dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
            g["V"], g["U"] = h.T @ dt, h.T @ ds
            dh += dt @ p["V"].T + ds @ p["U"].T
            dh *= 1 - h * h
            g["W"], g["b"] = xs.T @ dh + HOLD * p["W"], dh.sum(axis=0)
            for n in p:
                first[n] = 0.9 * first[n] + 0.1 * g[n]
                second[n] = 0.999 * second[n] + 0.001 * g[n] ** 2
                p[n] = (p[n] - rate * (first[n] / (1 - 0.9**k)) / (np.sqrt(second[n] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1500, most_passages: int = 256) -> Network | None:
    """Learn from about ``per_label`` of the ``labels`` (doc_id, label) of each value, 0 and 1. None if a label has no row.

    Of a text that has more than ``most_passages`` passages so many are learned from, at even distances; so the driver gets
    at most 2 * per_label * most_passages of N_FEATURES numbers. Scoring reads all passages of every text. Labels are drawn before texts are looked up, so only the bounded draw is broadcast and texts aren't shuffled.
    """

    def learned(passages: np.ndarray) -> np.ndarray:
        n = len(passages)
        return passages if n <= most_passages else passages[np.linspace(0, n - 1, most_passages).round().astype(int)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([learned(encode(t)).astype("<f4").tobytes() for t in b.column(0).to_pylist()], pa.binary())], ["label", "x"])

    drawn = bounded_sample(labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")), "doc_id", "label", per_label)
    got = attach(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), drawn, "doc_id").select("text", "label").mapInArrow(work, "label int, x binary").toPandas().sort_values(["label", "x"])
    y = got["label"].to_numpy(dtype=float)
    if not 0 < y.sum() < len(y):
        return None
    net = Network()
    net.fit([np.frombuffer(v, "<f4").reshape(-1, N_FEATURES) for v in got["x"]], y)
    return net


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_passages, attention of the passage that counts most) for each row; 0.5 if nothing was learned."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            bags = [encode(t) for t in b.column(1).to_pylist()]
            n = np.array([len(x) for x in bags])
            starts = np.cumsum(n) - n
            if held.value is None:
                out, most = np.full(len(n), 0.5), 1 / n
            else:
                out, *_, weight, _, _ = held.value.forward(np.concatenate(bags), starts)
                most = np.maximum.reduceat(weight, starts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.astype(float)), pa.array(n.astype(np.int64)), pa.array(most.astype(float))], ["doc_id", "score", "n_passages", "attention"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, score double, n_passages long, attention double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from the labelled rows that aren't held out and score every row of ``docs``.

    Null and empty texts are one empty passage. Rows that repeat a doc_id are each scored. Labels of documents that
    aren't there, and null labels, are ignored. An empty table gives no rows; extra columns are ignored.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    net = fit(docs, known)
    out = score(docs, net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "attention")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the quality of every document."""
    return rate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
