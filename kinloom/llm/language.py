"""Language identification in two steps (operator 5).

A document's language family is predicted first; then one-versus-one linear support vector machines separate the
languages within it. Features are hashed one- to three-character grams of the whole text, counted, damped by the square
root and scaled to length one. Fitting uses a bounded sample of labelled rows (``per_language``): each machine is fitted
by an executor from the rows of its two sides, and the driver gets weights only. Prediction runs over Arrow batches of
all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bounded_sample, materialise

#: Fixed: the families of some ISO 639-1 codes; a language that is not here is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic",
}
UNKNOWN = "und"
BITS = 12
#: Characters whose grams are counted at once.
CHUNK_CHARS = 1 << 17
_LETTER = regex.compile(r"\p{L}")
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def features(text: str) -> np.ndarray:
    """2**BITS floats of length one (or zero) for a whole text, lower-cased."""
    text = text.lower()
    counts = np.zeros(1 << BITS)
    for at in range(0, len(text), CHUNK_CHARS):
        part = np.frombuffer(text[at : at + CHUNK_CHARS + 2].encode("utf-32-le"), np.uint32).astype(np.uint64)
        total = part * _MULTIPLY[0]
        for n in range(3):
            if n:
                total = total[:-1] * _MULTIPLY[1] + part[n:] * _MULTIPLY[n]
            own = total[:CHUNK_CHARS]
            h = (own ^ (own >> np.uint64(29))) * _MULTIPLY[2]
            counts += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    out = np.sqrt(counts)
    return (out / max(np.sqrt((out * out).sum()), 1e-12)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 200) -> tuple[np.ndarray, float, float]:
    """(weights, bias, steepness) of a linear machine for y in {-1, 1}: squared hinge loss, accelerated gradient steps.

    Classes weigh the same. The steepness turns a margin into a probability: 1 / (1 + exp(-steepness * margin)), fitted
    on the same rows.
    """
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    y = y.astype(np.float32)
    xb = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = last = np.zeros(xb.shape[1], np.float32)
    step = np.float32(1 / (1 + 4 * c))
    for k in range(rounds):
        at = w + np.float32(k / (k + 3)) * (w - last)
        short = np.maximum(0, 1 - y * (xb @ at))
        grad = at - np.float32(2 * c) * ((share * y * short) @ xb)
        w, last = at - step * grad, w
    margin = y * (xb @ w)
    steep = min((1.0, 2.0, 4.0, 8.0), key=lambda s: float((share * np.logaddexp(0, -s * margin)).sum()))
    return w[:-1], float(w[-1]), steep


def _votes(values: np.ndarray, names: list[str], machines: list[tuple[int, int, np.ndarray, float, float]]) -> np.ndarray:
    """A row of shares for each row of ``values``: the mean of what the machines of each name give it."""
    out = np.zeros((len(values), len(names)))
    if len(names) == 1:
        return out + 1
    for i, j, w, b, steep in machines:
        p = 1 / (1 + np.exp(-steep * (values @ w + b)))
        out[:, i] += p
        out[:, j] += 1 - p
    return out / (len(names) - 1)


@dataclass
class Model:
    """families: the names; by_family: the languages of each; machines: one-versus-one among families, then within each."""

    families: list[str]
    by_family: dict[str, list[str]]
    machines: dict[str, list[tuple[int, int, np.ndarray, float, float]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        first = _votes(x, self.families, self.machines["*"])
        family = first.argmax(axis=1)
        names = np.empty(len(x), dtype=object)
        score = first.max(axis=1)
        for k, f in enumerate(self.families):
            own = family == k
            if own.any():
                then = _votes(x[own], self.by_family[f], self.machines[f])
                names[own] = np.array(self.by_family[f], dtype=object)[then.argmax(axis=1)]
                score[own] *= then.max(axis=1)
        return names.tolist(), np.clip(score, 0, 1)


def _machines(names: list[str], by_family: dict[str, list[str]]) -> list[tuple[str, int, int]]:
    """(family, or * among families; i; j): every pair of names, one machine each."""
    of = {"*": names, **by_family}
    return [(f, i, j) for f, members in of.items() for i in range(len(members)) for j in range(i)]


def fit(
    docs: DataFrame, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, str] = FAMILIES
) -> Model:
    """Learn from about ``per_language`` rows of each non-null language, of whole texts with a letter.

    The 1,000 most frequent languages are learned; texts of others are given one of those.
    Fewer rows or languages give a smaller model; no rows give one that knows none and predicts ``und``. Rows are drawn by
    id and text; those that repeat both count once.
    """
    rows = docs.select(F.xxhash64(id_col, text_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang, features(t).astype("<f2").tobytes()) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], ["lang", "x"])

    sample = materialise(bounded_sample(rows, "id", "lang", per_language).select("text", "lang").mapInArrow(work, "lang string, x binary"), "language-sample")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    names = sorted({families.get(v, v) for v in langs})
    model = Model(names, {f: [v for v in langs if families.get(v, v) == f] for f in names}, {f: [] for f in ("*", *names)})
    pairs = _machines(names, model.by_family)
    if not pairs:
        return model
    # Each row goes to the machines that have its language on a side: 1 or -1.
    sides = [(v, f, i, j, 1.0 if k == i else -1.0) for f, i, j in pairs for v in langs for k in (_side_of(model, f, v),) if k in (i, j)]
    spark = docs.sparkSession
    dealt = sample.join(F.broadcast(spark.createDataFrame(sides, "lang string, family string, i int, j int, y double")), "lang")

    def machine(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["lang", "x"])
        w, b, steep = fit_svm(np.array([np.frombuffer(v, "<f2") for v in own["x"]], dtype=np.float32), own["y"].to_numpy())
        return pd.DataFrame({"family": [key[0]], "i": [key[1]], "j": [key[2]], "w": [w.tobytes()], "b": [b], "steep": [steep]})

    fitted = dealt.groupBy("family", "i", "j").applyInPandas(machine, "family string, i int, j int, w binary, b double, steep double")
    for r in sorted(fitted.collect(), key=lambda r: (r["family"], r["i"], r["j"])):
        model.machines[r["family"]].append((r["i"], r["j"], np.frombuffer(r["w"], np.float32), r["b"], r["steep"]))
    return model


def _side_of(model: Model, family: str, lang: str) -> int:
    """The place of ``lang``, or of its family among families; -1 if it isn't there."""
    if family == "*":
        return next(k for k, f in enumerate(model.families) if lang in model.by_family[f])
    members = model.by_family[family]
    return members.index(lang) if lang in members else -1


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with two more columns, ``pred_col`` and ``score_col``, which it must not have.

    Null texts and texts without a letter: ``und`` and 0.
    """
    if {pred_col.lower(), score_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {pred_col} or {score_col}; name others")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
            texts = b.column(at).to_pylist()
            real = [k for k, t in enumerate(texts) if t is not None and _LETTER.search(t)]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if real:
                found, score = held.value.predict(np.array([features(texts[k]) for k in real]))
                scores[real] = score
                for k, n in zip(real, found, strict=True):
                    names[k] = n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names), pa.array(scores)], [*b.schema.names, pred_col, score_col])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out and predict every row.

    An empty table gives no rows; rows that repeat a doc_id are each predicted; extra columns are ignored.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the predicted language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
