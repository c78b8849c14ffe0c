"""A keyed table over Parquet files of which an upsert rewrites only those that it touches.

The table is a list of files, each with the range of its first key and its rows; the list is itself a Parquet table, named by
a version. An upsert prunes files by the range of its keys, reads nothing but the key columns of those that are left to
find the ones that hold a key of the batch, and writes these anew with the batch merged in; all other files stay as they
are. A version counts once its pointer, one small file, is renamed into place, so a writer that is lost leaves the version
before it valid, and what it wrote unread. Two writers of one version don't both succeed where the file system refuses to
rename onto a file; elsewhere the second is told that the version is taken if it comes later. Old versions stay readable.
"""

from __future__ import annotations

import uuid

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.session import DENSE, materialise

from .joins import side
from .upsert import latest_by, merged

#: Rows of a file, about.
FILE_ROWS = 1_000_000
#: Keys of a batch that are looked for first; the files that hold one of these needn't be looked at again.
FIRST_KEYS = 200_000


class KeyedTable:
    """The table under ``path``. ``keys``: its key columns; files are cut by the first."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], file_rows: int = FILE_ROWS):
        self.spark, self.path, self.keys, self.file_rows = spark, path.rstrip("/"), keys, file_rows

    # Versions.

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/versions")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(where) if x.getPath().getName().isdigit()) if fs.exists(where) else []

    def files(self, version: int | None = None) -> DataFrame:
        """(file, low, high, n) of a version, by default the last: each file, the range of its first key, and its rows."""
        there = self.versions()
        if not there:
            raise ValueError(f"there is no table at {self.path}")
        (name,) = self.spark.read.text(f"{self.path}/versions/{there[-1] if version is None else version}", wholetext=True).first()
        return self.spark.read.parquet(f"{self.path}/files/{name.strip()}")

    def _commit(self, version: int, files: DataFrame) -> int:
        name = uuid.uuid4().hex
        files.write.parquet(f"{self.path}/files/{name}")
        fs, where = self._fs(f"{self.path}/versions/{version}")
        _, temporary = self._fs(f"{self.path}/versions/_{name}")
        out = fs.create(temporary)
        out.write(bytearray(name.encode()))
        out.close()
        if fs.exists(where) or not fs.rename(temporary, where):
            raise RuntimeError(f"version {version} of {self.path} was written by another; read it and try again")
        return version

    # Rows.

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        return self._rows([r["file"] for r in self.files(version).select("file").collect()])

    def _rows(self, names: list[str]) -> DataFrame:
        (schema,) = self.spark.read.text(f"{self.path}/schema", wholetext=True).first()
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> DataFrame:
        """A file of each partition of ``rows``, in the order of the keys, and what is known of them."""
        place = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.sortWithinPartitions(*self.keys).write.options(**DENSE).parquet(place)
        written = self.spark.read.schema(rows.schema).parquet(place).select(F.col(self.keys[0]).alias("_k"), F.col("_metadata.file_path").alias("file"))
        return written.groupBy("file").agg(F.min("_k").alias("low"), F.max("_k").alias("high"), F.count("*").alias("n"))

    def _merged(self, names: list[str], source: DataFrame, rows: int, order: list, keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
        """upsert() of ``source`` into the files ``names``, about ``rows`` rows, dealt out by ranges of the keys.

        Rows of both sides are shuffled once: they meet, and the last of a key is taken, where they are to be written.
        """
        columns = source.columns
        none = reduce(Column.__or__, [F.col(k).isNull() for k in self.keys])
        # Null keys match nothing: the table's rows with such keys stay by themselves.
        both = source.select(*columns, F.when(none, F.lit("")).alias("_apart"), F.lit(True).alias("_put"))
        if names:
            place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
            both = both.unionByName(self._rows(names).select(*columns, F.when(none, place).alias("_apart"), F.lit(False).alias("_put")))
        both = both.repartitionByRange(max(1, -(-rows // self.file_rows)), *self.keys)
        cols = [c for c in columns if c not in self.keys]
        row = F.struct(*cols, F.lit(True).alias("_hit"))
        at = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)])
        picked = both.groupBy(*self.keys, "_apart").agg(F.max_by(row, F.when(F.col("_put"), at)).alias("_new"), F.max_by(row, F.when(~F.col("_put"), F.lit(1))).alias("_old"))
        return picked.select(*self.keys, *[merged(c, keep, fill) for c in cols]).select(*columns)

    def create(self, rows: DataFrame, order: list | None = None) -> int:
        """The first version. Its columns are the table's. With ``order``, rows are as put(…, ready=True) takes them."""
        fs, where = self._fs(f"{self.path}/schema")
        if fs.exists(where):
            raise ValueError(f"there is a table at {self.path}")
        out = fs.create(where)
        out.write(bytearray(", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes).encode()))
        out.close()
        if order is not None:
            return self._commit(0, self._write(self._merged([], rows, rows.count(), order)))
        rows = materialise(rows, "keyed-rows", dense=True)
        return self._commit(0, self._write(rows.repartitionByRange(max(1, -(-rows.count() // self.file_rows)), *self.keys)))

    def touched(self, source: DataFrame) -> list[str]:
        """The files of the last version that hold a key of ``source``."""
        return sorted(self._met(source.select(*self.keys).distinct()))

    def _met(self, source: DataFrame) -> dict[str, int]:
        """Of each file of the last version that holds a key of ``source``: about how many of its rows have one.

        Of a large batch a share of the keys, by their hash, is looked for first, and the others only in the files that hold
        none of these. So a batch that touches nearly all files isn't shuffled to find them.
        """
        first = F.col(self.keys[0])
        low, high, n = source.agg(F.min(first), F.max(first), F.count("*")).first()
        if low is None:
            return {}
        near = [r["file"] for r in self.files().where((F.col("high") >= F.lit(low)) & (F.col("low") <= F.lit(high))).select("file").collect()]
        share, found = max(1, n // FIRST_KEYS), {}
        for every in (share, 1) if share > 1 else (1,):
            left = [f for f in near if f not in found]
            if not left:
                break
            drawn = F.pmod(F.xxhash64(*self.keys), F.lit(every)) == 0
            wanted = side(materialise(source.select(*self.keys).where(drawn), "keys"))
            # Only the key columns of these files are read, and of them what the range leaves.
            rows = self._rows(left).select(*self.keys, F.col("_metadata.file_path").alias("_file")).where(first.between(F.lit(low), F.lit(high)) & drawn)
            hits = rows.join(wanted, self.keys, "left_semi").groupBy("_file").agg(F.count("*").alias("n")).collect()
            found |= {r["_file"]: r["n"] * every for r in hits}
        return found

    def put(self, source: DataFrame, order: list, keep: tuple[str, ...] = (), fill: tuple[str, ...] = (), ready: bool = False) -> dict[str, int]:
        """Upsert ``source`` as upsert() does and commit a new version.

        ready: ``source`` is written, and no key has many rows; then it is neither written anew nor reduced to a row a key
        before it meets the table. Returns the version and how many files were rewritten, written and left alone. Rows whose
        keys the table lacks go into new files of their own range. An empty source commits nothing.
        """
        version = self.versions()[-1]
        (schema,) = self.spark.read.text(f"{self.path}/schema", wholetext=True).first()
        columns = self.spark.createDataFrame([], schema).columns
        source = source.select(*columns) if ready else materialise(latest_by(source.select(*columns), self.keys, order), "batch", dense=True)
        before = self.files()
        n = source.count()
        if not n:
            return {"version": version, "rewritten": 0, "written": 0, "untouched": before.count()}
        met = self._met(source)
        names = sorted(met)
        gone = self.spark.createDataFrame([(f,) for f in names], "file string")
        old = before.join(F.broadcast(gone), "file", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        new = materialise(self._write(self._merged(names, source, old + max(0, n - sum(met.values())), order, keep, fill)), "new-files")
        rest = before.join(F.broadcast(gone), "file", "left_anti")
        counts = {"version": version + 1, "rewritten": len(names), "written": new.count(), "untouched": rest.count()}
        self._commit(version + 1, rest.select("file", "low", "high", "n").unionByName(new))
        return counts
