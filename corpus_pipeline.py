"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token-ID output.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last returns where each document's ids are in the files it wrote. run() writes each stage's rows as
Parquet in shared storage and reads them back for the next, so a lost executor never costs more than a stage.

Stages tell rows apart by a number of the row's own, not by doc_id, so rows without an id, and different rows that share
one, are each kept or dropped by the rule that the stage states. Extra columns, whatever their names, are kept as they
are by all stages but the last. Every stage gives no rows for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import decontaminate, language, mixing, simhash, tokens
from kinloom.llm.common import free_name, keep_ids, materialise, missing_ids, numbered
from kinloom.session import bounded_batches

#: Four languages leave at least a quarter of the votes to the best; less than this is no decision.
LEAST_LANGUAGE_SCORE = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """Texts go to Python in batches of bounded bytes, whoever calls the stage."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in no known language go: null text, no letter, or no decision. ``lang`` becomes the predicted one.

    Learned from the rows of ``docs`` that have a ``lang`` and aren't held out; where there are none, no language is known
    and every row goes.
    """
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    pred, score = free_name(docs, "lang_pred", "score")
    out = language.predict(docs, model, pred_col=pred, score_col=score).where((F.col(pred) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return out.withColumn("lang", F.col(pred)).select(*docs.columns)


@_bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates stays, and all others go.

    It is the row with the smallest doc_id, null ids last; of rows that share it, the one whose text has the least hash;
    of equal texts, which are alike to this stage, any one. Null and empty texts are one component.
    """
    docs, row = numbered(docs, "_row")
    found = materialise(simhash.near_duplicates(docs, row_col=row), "near-duplicates")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row"))
    kept = found.groupBy("component").agg(least.alias("first")).select(F.col("first.row").alias(row))
    return keep_ids(docs, kept, row).drop(row)


@_bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; null and empty texts hold none and stay."""
    docs, row = numbered(docs, "_row")
    return missing_ids(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row).select(F.col("doc_id").alias(row)), row).drop(row)


@_bounded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each turn in which the mix serves a row, in the order of the turns; texts without a word have none."""
    return mixing.mixed(docs, mixing.WEIGHTS)


@_bounded
def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: doc_id, start, n_tokens, ids_crc32, a row for each row of ``docs``.

    Documents stand in the files in the order in which they stand in the files of ``docs``, which is that of the mix's
    turns; rows that come from elsewhere stand in the order of their doc_id. Null text counts as empty.
    """
    return tokens.tokenized(spark, docs, in_order=True, most_pieces=200_000, keep_pieces=False)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
