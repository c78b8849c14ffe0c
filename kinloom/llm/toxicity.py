"""Toxicity by weak supervision (operator 7).

Many voters look at a document: one for each word or word beginning of a lexicon (a fixed seed, and terms mined from
labelled rows), and patterns of style. A generative label model, fitted by expectation maximisation on a bounded sample
of rows, estimates from the votes alone how often each voter fires in either class and how voters correlate beyond the
class; voters that repeat each other share their say. Labels give it the share of toxic rows, and nothing else. A linear
classifier is then trained on the model's posterior labels and scores every row from Arrow batches.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bounded_sample, drawn, materialise

#: Fixed: a seed of English insults; the rest of the lexicon is mined.
SEED = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting")
BEGINNING = 5
#: Most mined terms, and the least rows and score that a term needs.
MOST_TERMS, LEAST_ROWS, LEAST_SCORE = 300, 5, 5.0
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[str]:
    """Distinct lower-cased words of the whole text and, after a caret, their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {"^" + w[:BEGINNING] for w in words if len(w) > BEGINNING}


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point: 1 if it is a letter, and 2 more if it is an upper-case one."""
    return np.fromiter((chr(c).isalpha() + 2 * chr(c).isupper() for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


_TO_YOU = re.compile(r"\byou\b[^.!?\n]{0,40}!")


def patterns(text: str | None) -> list[float]:
    """Votes of style: shouting, repeated exclamation, marks strewn in, direct address next to an exclamation."""
    text = text or ""
    kinds = _kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    letters, upper = int(np.count_nonzero(kinds & 1)) or 1, int(np.count_nonzero(kinds & 2))
    marks = sum(text.count(c) for c in "$%&*#@")
    address = "!" in text and _TO_YOU.search(text.lower()) is not None
    return [float(upper > 0.5 * letters), float(text.count("!!") >= 3), float(marks > 0.02 * letters), float(address)]


N_PATTERNS = 4


@dataclass
class Model:
    lexicon: list[str]
    weights: np.ndarray  # one for each feature, then the bias

    def __post_init__(self) -> None:
        self.place = {t: k for k, t in enumerate(self.lexicon)}

    def votes(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(self.lexicon) + N_PATTERNS, dtype=np.uint8)
        out[[self.place[t] for t in terms(text) & self.place.keys()]] = 1
        out[len(self.lexicon) :] = patterns(text)
        return out

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(votes) @ self.weights, -30, 30)))


def design(votes: np.ndarray) -> np.ndarray:
    """Features of the linear classifier: the votes, whether any term fired, how many did, and one for the bias."""
    hits = votes[:, :-N_PATTERNS].sum(axis=1, dtype=float)[:, None]
    return np.hstack([votes, np.minimum(hits, 1), np.log1p(hits), np.ones_like(hits)])


def label_model(votes: np.ndarray, prior: float, share: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Posterior probability of class 1 for each row of votes; no row's label is known to it.

    ``share``: how many rows of the corpus each row stands for. Each voter fires with one rate in each class and else
    abstains; that no term fires is a vote of its own. A voter speaks for class 1, so its rate there is held to be the higher
    one. To begin with, rows are ranked by how many voters fire, a rare voter's vote weighing more, and a ``prior`` share of
    them is taken for class 1. Residual correlations of voters given the class cut their log-odds: a voter's weight is 1 over
    1 plus the sum of its positive correlations.
    """
    v = votes.astype(float)
    prior = min(max(prior, 0.01), 0.99)
    r = np.ones(len(v)) if share is None else share * len(v) / share.sum()
    n = r.sum()
    say = v @ np.log((n + 1) / (r @ v + 1))
    some = say[say > 0]
    down = np.argsort(-say, kind="stable")
    at = min(np.searchsorted(np.cumsum(r[down]), prior * n), len(say) - 1)  # the last row of the first ``prior`` share
    mark = max(say[down[at]], some.min() if len(some) else 1.0)
    post = np.where(say >= mark, 0.9, 0.1 * prior)
    none = ~v[:, :-N_PATTERNS].any(axis=1)
    weight = np.ones(v.shape[1])
    for k in range(rounds):
        one, zero = r * post, r * (1 - post)
        on = (v.T @ one + 0.05) / (one.sum() + 0.6)
        off = (v.T @ zero + 0.005) / (zero.sum() + 1)
        on, off = np.clip(on, 1e-4, 0.999), np.clip(off, 1e-4, 0.999)
        on = np.maximum(on, off)
        if k % 10 == 0:
            rest = v - post[:, None] * on - (1 - post[:, None]) * off
            rest -= (r @ rest) / n
            rest /= np.sqrt((r @ rest**2) / n) + 1e-6
            tie = np.clip(rest.T @ (r[:, None] * rest) / n, 0, 1)
            np.fill_diagonal(tie, 0)
            weight = 1 / (1 + np.where(tie > 0.3, tie, 0).sum(axis=1))
        rate = [((none * q).sum() + 0.5) / (q.sum() + 1) for q in (one, zero)]
        odds = np.log(prior / (1 - prior)) + v @ (weight * np.log(on / off)) + none * min(0.0, np.log(rate[0] / rate[1]))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def fit_linear(x: np.ndarray, y: np.ndarray, share: np.ndarray | None = None, rounds: int = 30, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; ``share`` as in label_model(). The bias is not held back."""
    w = np.zeros(x.shape[1])
    r = np.ones(len(x)) if share is None else share * len(x) / share.sum()
    hold = np.full(len(w), ridge)
    hold[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (r * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(bend, x.T @ (r * (p - y)) + hold * w)
        w -= move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
    return w


def mine(rows: DataFrame) -> list[str]:
    """Terms that labelled toxic rows (text, label) have far more often than clean ones, after near copies are dropped.

    Near copies: rows whose two least hashed terms are the same.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([sorted(terms(text))], pa.list_(pa.string())), pa.array([label], pa.int32())], ["terms", "label"])

    bags = rows.mapInArrow(work, "terms array<string>, label int").where("size(terms) > 0")
    least = lambda s: F.array_min(F.transform("terms", lambda t: F.xxhash64(t, F.lit(s))))
    bags = bags.withColumn("m1", least(1)).withColumn("m2", least(2))
    # Of near copies the one whose terms have the least hash stays, so reruns agree.
    bags = materialise(bags.groupBy("m1", "m2", "label").agg(F.min_by("terms", F.xxhash64("terms")).alias("terms")), "bags")
    n = {r["label"]: r["count"] for r in bags.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return []
    counts = bags.select(F.explode("terms").alias("term"), "label").groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    p = (F.col("a") + F.col("b")) / F.lit(toxic + clean)
    score = (F.col("a") / toxic - F.col("b") / clean) / F.sqrt(p * (1 - p) * F.lit(1 / toxic + 1 / clean) + 1e-12)
    found = counts.where((F.col("a") >= LEAST_ROWS) & (F.col("a") / toxic > 20 * F.col("b") / clean)).withColumn("score", score).where(F.col("score") >= LEAST_SCORE)
    return sorted(r["term"] for r in found.orderBy(F.desc("score"), "term").limit(MOST_TERMS).collect())


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 4000, unlabelled: int = 4000) -> Model:
    """Learn from about ``per_label`` of the ``labels`` (doc_id, label) of each value and ``unlabelled`` other rows.

    The draws are by hash and bounded; texts stay on the executors, the driver gets their votes. The lexicon is mined from
    the labelled rows; the label model sees the votes of all rows drawn and the share of label 1 among all labels given.
    Each labelled row drawn stands for as many as its label has rows for each one drawn, so what is learned doesn't depend
    on how many of each label are drawn.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    there = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    known = materialise(attach(rows, bounded_sample(labels, "doc_id", "label", per_label), "doc_id").select("text", "label"), "labelled")
    model = Model(sorted({*SEED, *mine(known)}), np.zeros(0))
    others = drawn(rows.select(F.xxhash64("doc_id", "text").alias("id"), "text"), "id", unlabelled).select("text", F.lit(-1).alias("label"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = pa.array([model.votes(t).tobytes() for t in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(1), votes], ["label", "votes"])

    got = known.unionByName(others).mapInArrow(work, "label int, votes binary").toPandas().sort_values(["label", "votes"])
    votes = np.array([np.frombuffer(v, np.uint8) for v in got["votes"]]).reshape(len(got), len(model.lexicon) + N_PATTERNS)
    if not len(votes):
        votes, post, share = np.zeros((1, votes.shape[1]), np.uint8), np.zeros(1), np.ones(1)
    else:
        own = got["label"].to_numpy()
        all_labels = sum(there.values())
        prior = there.get(1, 0) / all_labels if all_labels else 0.1
        # Labelled rows weigh 1 on average; so do the others.
        drawn_of = {k: int((own == k).sum()) for k in (0, 1)}
        stands = {k: there.get(k, 0) / all_labels * (drawn_of[0] + drawn_of[1]) / max(drawn_of[k], 1) for k in (0, 1)} if all_labels else {}
        share = np.array([stands.get(k, 1.0) for k in own.tolist()])
        post = label_model(votes, prior, share)
    model.weights = fit_linear(design(votes), post, share)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_terms) for each row; n_terms: lexicon terms found."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            votes = np.array([held.value.votes(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(votes)), pa.array(votes[:, :-N_PATTERNS].sum(axis=1).astype(np.int64))], ["doc_id", "score", "n_terms"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, score double, n_terms long")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Learn from labels that aren't held out and score every row of ``docs``.

    Null and empty texts fire no voter and get the score of that. Rows that repeat a doc_id are each scored. Without
    labels the seed's voters alone are modelled. An empty table gives no rows; extra columns are ignored.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    out = score(docs, fit(docs, known))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_terms")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the toxicity of every document."""
    return rate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
