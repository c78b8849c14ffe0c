"""Runs, stages and tenant scoping."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .upsert import upsert


def observability(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """O1: every run with its stages, if any."""
    return runs.join(stages, "run_id", "left")


def latest_run(runs: DataFrame) -> DataFrame:
    """O2: the last requested run of each trace."""
    rest = [c for c in runs.columns if c != "trace_id"]
    best = runs.groupBy("trace_id").agg(F.max_by(F.struct(*rest), F.struct("requested_at", "run_id")).alias("r"))
    return best.select("trace_id", "r.*")


def stage_metrics(events: DataFrame) -> DataFrame:
    """O3: (run_id, stage, attempt) with start, duration in ms, records in and out, status, and the error of its first failed event.

    events: (run_id, stage, attempt, ts, ok, error).
    """
    started, ended = F.min("ts"), F.max("ts")
    return events.groupBy("run_id", "stage", "attempt").agg(started.alias("started_at"), (F.unix_millis(ended) - F.unix_millis(started)).alias("duration_ms"), F.count("*").alias("records_in"), F.count_if(F.col("ok")).alias("records_out"), F.when(F.bool_and("ok"), "completed").otherwise("failed").alias("status"), F.min_by("error", F.when(~F.col("ok"), F.col("ts"))).alias("error"))


STAGES = "run_id string, stage string, place int, started_at timestamp, duration_ms long, status string, records_out long, failed long, error string"


class StageLog:
    """O3: the stages of a run, each written and counted in one action, and what each came to."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id, self.place = spark, path, run_id, 0

    def run(self, stage: str, rows: DataFrame, **counts: Column) -> DataFrame:
        """Write ``rows`` as the result of a stage and read them back.

        ``counts`` (of which ``failed`` is kept by that name) are observed while the rows are written. The stage's row goes
        to the log as soon as it ends; a stage that fails leaves its error there, and raises it.
        """
        watch, place, began = Observation(), f"{self.path}/{self.run_id}/{self.place:03d}-{stage}", time.time()
        self.place += 1
        try:
            rows.observe(watch, F.count(F.lit(1)).alias("records_out"), *[c.alias(name) for name, c in counts.items()]).write.parquet(place)
        except Exception as error:
            self._note(stage, began, "failed", None, None, str(error)[:2000])
            raise
        self._note(stage, began, "succeeded", watch.get["records_out"], watch.get.get("failed"), None)
        return self.spark.read.schema(rows.schema).parquet(place)

    def _note(self, stage: str, began: float, status: str, records: int | None, failed: int | None, error: str | None) -> None:
        row = (self.run_id, stage, self.place, datetime.fromtimestamp(began, UTC), int((time.time() - began) * 1000), status, records, failed, error)
        self.spark.createDataFrame([row], STAGES).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def stages(self) -> DataFrame:
        return self.spark.read.schema(STAGES).parquet(f"{self.path}/log")


def put_stages(stages: DataFrame, new: DataFrame) -> DataFrame:
    """O3: idempotent for each attempt."""
    return upsert(stages, new, ["run_id", "stage", "attempt"], ["started_at"])


def run_summary(stages: DataFrame) -> DataFrame:
    """One row for each run: its totals, and its stages in order of their start with what each came to."""
    each = F.struct("started_at", "stage", "attempt", "status", "records_in", "records_out", "duration_ms", "error")
    return stages.groupBy("run_id").agg(F.array_sort(F.collect_list(each)).alias("by_stage"), F.count("*").alias("stages"), F.count_if(F.col("status") == "failed").alias("failed_stages"), F.sum("records_in").alias("records_in"), F.sum("records_out").alias("records_out"), F.sum("duration_ms").alias("duration_ms"))


def scoped(df: DataFrame, tenant: str, user: str | None = None) -> DataFrame:
    """Rows of the tenant, and of the user if one is given."""
    out = df.where(F.col("tenant_id") == tenant)
    return out if user is None else out.where(F.col("user_id") == user)


def visible_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is visible."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def workspace(tenants: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """Tenants of which the user is an active member, with the role."""
    own = members.where((F.col("user_id") == user) & (F.col("status") == "active")).select("tenant_id", "role")
    return tenants.join(own, "tenant_id")


def register(known: DataFrame, events: DataFrame) -> DataFrame:
    """(tenant_id, user_id, updated_at) with those of a batch of events put in."""
    return upsert(known, events.groupBy("tenant_id", "user_id").agg(F.max("occurred_at").alias("updated_at")), ["tenant_id", "user_id"], ["updated_at"])
