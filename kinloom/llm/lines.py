"""Line deduplication over levelled sorted runs (operator 11); DataFrame functions only.

A store is a set of runs. A run is a table of line hashes (128 bits of SHA-256, so collisions need no thought) with the
number of documents that hold the line, dealt into as many buckets as the store has and sorted within each; it sits on a
level. New files come in batches, as a stream. A batch's lines become (hash, documents), summed before they are
shuffled; a merge join drops those that a run already counts as settled (found often enough); what is left is the
batch's own run, on level 0. When a level holds two runs they are merged into one run of the next level, so a hash is
rewritten only as often as there are levels. Runs are bucketed tables: joins and merges of runs neither shuffle nor sort
them again.

A count stops at the settling number, as nothing after that can matter; with a settling number of 1 the store is the set
of all lines seen. A batch that is delivered twice overwrites its own run; the list of runs is written after each batch,
and replaced as one file, so a lost driver goes on from the last complete batch.

A line may be in a third of all documents. Counts are summed before the shuffle, and where documents meet the frequent
lines, these are broadcast if measured to be small, or else the heavy ones are (see spread_join).
"""

from __future__ import annotations

import json
import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.streaming.flows import drain, read

from .common import free_name, materialise, numbered, shared_path, small, spread_join

#: What is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
_RUN = "h binary, n long"


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def lines(text: Column) -> Column:
    """The lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of each line: stripped at both ends, A-Z lower-cased."""
    return F.transform(lines(lowered(text)), lambda x: F.btrim(x, F.lit(BLANK)))


def line_hash(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key.cast("binary"), 256), 1, 32))


def document_counts(docs: DataFrame, text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """(h, n): for each line key of at least ``least_chars`` code points, how many rows of ``docs`` hold it."""
    keys = docs.select(F.explode(F.array_distinct(line_keys(F.col(text_col)))).alias("key")).where(F.length("key") >= least_chars)
    return keys.select(line_hash(F.col("key")).alias("h")).groupBy("h").agg(F.count("*").alias("n"))


class LineRuns:
    """The levelled runs under ``path``: a new store of ``buckets`` buckets, or the one that is there.

    ``settled``: the number of documents from which on a line needn't be counted any further.
    """

    def __init__(self, spark: SparkSession, path: str, settled: int, buckets: int | None = None):
        self.spark, self.path, self.settled = spark, path, settled
        self.names: dict[str, str] = {}
        found = self._manifest()
        self.buckets = found["buckets"] if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if found and found["settled"] != settled:
            raise ValueError(f"this store counts up to {found['settled']} documents")
        self.last_batch = found["batch"] if found else -1
        self.levels: list[list[str]] = found["levels"] if found else [[]]

    # The list of runs is one small file, renamed into place.

    def _fs(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _manifest(self) -> dict | None:
        fs, where = self._fs()
        found = sorted((int(x.getPath().getName()), x.getPath().toString()) for x in fs.listStatus(where) if x.getPath().getName().isdigit()) if fs.exists(where) else []
        return json.loads(self.spark.read.text(found[-1][1], wholetext=True).first()[0]) if found else None

    def _commit(self, batch: int) -> None:
        fs, where = self._fs()
        state = json.dumps({"batch": batch, "levels": self.levels, "buckets": self.buckets, "settled": self.settled})
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        temporary = make(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(bytearray(state.encode()))
        out.close()
        fs.delete(make(where, str(batch)), False)
        if not fs.rename(temporary, make(where, str(batch))):
            raise OSError(f"the list of runs could not be put at {where}")
        self.last_batch = batch

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed, sorted table."""
        if name not in self.names:
            table = f"kinloom_lines_{uuid.uuid4().hex}"
            place = f"{self.path}/{name}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {table} ({_RUN}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            self.names[name] = table
        return self.spark.table(self.names[name])

    def _put(self, rows: DataFrame, name: str) -> None:
        table = f"kinloom_lines_{uuid.uuid4().hex}"
        rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(table)
        if old := self.names.pop(name, None):
            self.spark.sql(f"DROP TABLE {old}")
        self.names[name] = table

    def _sorted(self, work: Callable[[], None], session: SparkSession | None = None) -> None:
        """A run has one file a bucket, so Spark may take its order for granted, in the session of a stream's batch, too."""
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        sessions = [self.spark, *([session] if session is not None else [])]
        before = [s.conf.get(key) for s in sessions]
        for s in sessions:
            s.conf.set(key, "true")
        try:
            work()
        finally:
            for s, value in zip(sessions, before, strict=True):
                s.conf.set(key, value)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def fresh(self, counts: DataFrame) -> DataFrame:
        """The rows of ``counts`` (h, n) whose line no run has settled: merge anti-joins with the runs."""
        for name in self.runs():
            counts = counts.join(self.run(name).where(F.col("n") >= self.settled).select("h").hint("merge"), "h", "left_anti")
        return counts

    def add(self, counts: DataFrame, batch: int) -> None:
        """The batch's own run, then a merge of each level that is full. A batch that was taken before is left out."""
        if batch <= self.last_batch:
            return
        name = f"run-{batch}-0"

        def work() -> None:
            rows = self.fresh(counts.repartition(self.buckets, "h")).select("h", F.least("n", F.lit(self.settled)).cast("long").alias("n"))
            self._put(rows, name)
            self.levels[0].append(name)
            for k, level in enumerate(self.levels):
                if len(level) < 2:
                    break
                merged = f"run-{batch}-{k + 1}"
                self._merge(*level, merged)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

        self._sorted(work, counts.sparkSession)
        self._commit(batch)

    def _merge(self, first: str, second: str, name: str) -> None:
        """One run of two, by a full outer merge join; counts stop at ``settled``."""
        other = self.run(second).select(F.col("h").alias("h2"), F.col("n").alias("n2"))
        both = self.run(first).join(other.hint("merge"), F.col("h") == F.col("h2"), "full")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
        self._put(both.select(F.coalesce("h", "h2").alias("h"), F.least(n, F.lit(self.settled)).cast("long").alias("n")), name)

    def counted(self) -> DataFrame:
        """(h, n) of all runs, n at most ``settled``: the runs are merged, lowest levels first, until one is left."""
        names = self.runs()
        if len(names) > 1:

            def work() -> None:
                first, *rest = names
                for k, second in enumerate(rest):
                    self._merge(first, second, first := f"all-{self.last_batch}-{k}")

            self._sorted(work)
            self.levels = [[] for _ in self.levels[:-1]] + [[f"all-{self.last_batch}-{len(names) - 2}"]]
            self._commit(self.last_batch)
        return self.run(self.runs()[0]) if names else self.spark.createDataFrame([], _RUN)

    def close(self) -> None:
        """Drop the tables' names; their files stay until the folder goes."""
        for table in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.names.clear()


def ingest(spark: SparkSession, source: str, store: str, settled: int, text_col: str = "text", least_chars: int = 1, files_per_batch: int | None = None) -> LineRuns:
    """Take what is new under ``source`` (Parquet) into the runs under ``store``.

    Call again with the same ``store`` as files arrive: only new files are read.
    """
    runs = LineRuns(spark, f"{store}/runs", settled)
    drain(read(spark, source, files_per_batch=files_per_batch).select(text_col), f"{store}/log", lambda batch, number: runs.add(document_counts(batch, text_col, least_chars), number))
    return runs


def unseen_lines(runs: LineRuns, docs: DataFrame, text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """(h, n): the lines of ``docs`` that no run has settled; with a settling number of 1, those never seen."""
    return runs.fresh(document_counts(docs, text_col, least_chars))


def drop_lines(docs: DataFrame, frequent: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped: every line whose hash is in ``frequent`` (h, n) goes.

    The hashes of frequent lines are broadcast if measured to be small; else the heavy ones are and the others meet their
    lines in a shuffle. Texts move only if the places of the lines that go are too many to broadcast.
    """
    docs, row = numbered(docs, "_row")
    keys = docs.select(F.col(row).alias("row"), F.posexplode(line_keys(F.col(text_col))).alias("at", "key")).where("key <> ''")
    at = keys.select("row", "at", line_hash(F.col("key")).alias("h"))
    if small(frequent):
        found = at.join(F.broadcast(frequent.select("h")), "h")
    else:
        at = materialise(at, "line-places")
        found = spread_join(at, materialise(at.join(frequent.select("h"), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n")), "line-rows"), "h", "n", at.count())
    gone = materialise(found.groupBy("row").agg(F.collect_set("at").alias("gone")), "lines-gone")
    names = free_name(docs, "row", "gone")
    gone = gone.select(F.col("row").alias(names[0]), F.col("gone").alias(names[1]))
    joined = docs.join(F.broadcast(gone) if small(gone) else gone.hint("merge"), F.col(row) == F.col(names[0]), "left")
    dropped = F.coalesce(F.col(names[1]), F.array().cast("array<int>"))

    def kept(rows: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), dropped)
        return F.array_join(F.transform(stay, lambda i: F.get(rows, i)), "\n")

    # Within transform() a text is split once, and not again for each of its lines.
    text = F.when(F.size(dropped) > 0, F.get(F.transform(F.array(lines(F.col(text_col))), kept), F.lit(0))).otherwise(F.coalesce(F.col(text_col), F.lit("")))
    more = {"kept_text": text, "n_lines": F.size(lines(F.col(text_col))).cast("long"), "n_dropped": F.size(dropped).cast("long")}
    own = [c for c in docs.columns if c != row and c not in more]
    return joined.select(*[F.col(f"`{c}`") for c in own], *[c.alias(name) for name, c in more.items()])


def line_dedup(
    spark: SparkSession, source: str, least_docs: int = 10, least_chars: int = 1, text_col: str = "text", batches: int = 4, store: str | None = None
) -> DataFrame:
    """The rows under ``source`` (Parquet), each with kept_text, n_lines and n_dropped.

    Lines are what stands between line feeds. A line's key is the line without U+0020 and U+0009 to U+000D at both ends, A-Z
    lower-cased. Keys of ``least_chars`` code points or more that ``least_docs`` rows or more hold lose all their lines;
    a line that repeats within a row counts once. The empty key is never dropped. Null text counts as empty: one empty line.
    Every row is a document, whatever its other columns: rows without a doc_id, or with the same one, count each. A row
    that loses all lines keeps an empty text. An empty table gives no rows. Extra columns stay (those named like the
    three new ones are replaced). The files are taken in about ``batches`` batches.
    """
    docs = spark.read.parquet(source)
    files = len(docs.inputFiles())
    runs = ingest(spark, source, store or shared_path(spark, "lines"), least_docs, text_col, least_chars, max(1, -(-files // batches)))
    frequent = materialise(runs.counted().where(F.col("n") >= least_docs), "frequent-lines")
    runs.close()
    return drop_lines(docs, frequent, text_col)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: what is left of every document, by its hash."""
    out = line_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
gone AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY p) AS body, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM gone) GROUP BY r)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(body, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""
