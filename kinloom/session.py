"""The session settings the operators assume, and access to shared storage."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Texts go to Python in batches of so many bytes, whatever their lengths; by Spark's default, 10,000 rows of any size do.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "1m"}


#: How intermediates are written that are large or mostly identifiers in hexadecimal digits, which Spark's default hardly packs.
DENSE = {"compression": "zstd"}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    conf = SETTINGS | BATCHES | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | more
    return SparkSession.builder.master(master).appName("kinloom").config(map=conf).getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Set BATCHES where the application hasn't set them itself."""
    for key, value in BATCHES.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Where none is set, a local session gets a temporary one.

    On a cluster a temporary folder would be another on each machine, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _folders.get(spark.sparkContext.applicationId)
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found:
        if not jvm.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = jvm.get() if jvm.isDefined() else tempfile.mkdtemp(prefix="kinloom-")
        _folders[spark.sparkContext.applicationId] = found  # a running session doesn't take the setting
    if not jvm.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_folders: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in this application's part of it."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/kinloom/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete all that this application has put into the shared folder: intermediates live until then.

    Results are read from them lazily, so call it once those are written.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        del _kept[key]


_kept: dict[tuple[str, ...], str] = {}


def once(df: DataFrame, *key: str, file_rows: int = 0, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """materialise(), but what is written under ``key`` is written once for each application and state of the files read.

    file_rows: so many rows a file at most; 0 is no bound. Many small files are dealt to more tasks than their bytes would be.
    made: what makes the rows from ``df``, called only if they aren't there; for what runs jobs while it is put together.
    """
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, *key, *_state(spark, df.inputFiles()))
    if key not in _kept:
        path = shared_path(spark, key[-2])
        (made(df) if made else df).write.options(**DENSE).option("maxRecordsPerFile", file_rows).parquet(path)
        _kept[key] = path
    return spark.read.parquet(_kept[key]) if made else spark.read.schema(df.schema).parquet(_kept[key])


def _state(spark: SparkSession, files: list[str]) -> tuple[str, ...]:
    """Names, lengths and times of files, folded to one text: files that are written anew make another."""
    make, conf, seen = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration(), []
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        where = make(folder)
        seen += [f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in where.getFileSystem(conf).listStatus(where)]
    return (hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest(),)


def ship(spark: SparkSession, *folders: str) -> None:
    """Send the packages in ``folders`` to the executors, which needn't see the driver's disk. Once for each application."""
    if spark.sparkContext.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="kinloom-code-"), "kinloom_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder in folders:
            for path in sorted(Path(folder).rglob("*.py")):
                z.write(path, path.relative_to(Path(folder).parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)


_shipped: set[str] = set()


def materialise(df: DataFrame, name: str, dense: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, so a lost executor costs a re-read only.

    dense: packed as DENSE says, for less disk and some more time.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**(DENSE if dense else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
