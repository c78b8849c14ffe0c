"""What the corpus operators share: word rules, shared tables, checked broadcasts, bounded samples and array hashing."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.session import materialise, shared_dir, shared_path

__all__ = [
    "SPACES", "attach", "bounded_sample", "drawn", "free_name", "keep_ids", "materialise", "missing_ids", "mix64", "n_words", "numbered",
    "place_in_files", "prefix_hash", "running", "shared_dir", "shared_path", "small", "span_hash", "spread_join",
]

#: The whitespace of the word rule: U+0020 and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"
#: A side of at most so many measured bytes may be broadcast.
BROADCAST_BYTES = 48 << 20
#: A key is heavy if it has more than HEAVY_ROWS rows and more than one HEAVY_KEYS-th of all; so at most HEAVY_KEYS keys are.
HEAVY_ROWS, HEAVY_KEYS = 64, 20_000


def n_words(text: Column) -> Column:
    """The number of maximal runs of non-whitespace; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACES), lambda w: w != "")), F.lit(0)).cast("long")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name, or a longer one if ``df`` has such a column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def place_in_files(df: DataFrame) -> list[Column] | None:
    """File and row of each row of ``df``, if it is a scan of files; else None."""
    where = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        df.select(*where).schema  # noqa: B018
    except AnalysisException:
        return None
    return where


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a key of each row's own, a text, and that column's name: rows without an id or with the same stay apart.

    The key is the row's place in its file; rows that come from elsewhere are numbered and written.
    """
    (name,) = free_name(df, name)
    if where := place_in_files(df):
        return df.withColumn(name, F.concat_ws("#", F.md5(where[0].cast("binary")), where[1].cast("string"))), name
    return materialise(df.withColumn(name, F.monotonically_increasing_id().cast("string")), "numbered"), name


def small(df: DataFrame, limit: int | None = None) -> bool:
    """True if the rows of ``df`` measure at most ``limit`` (BROADCAST_BYTES) bytes: 16 and 8 a column for each, and what texts and arrays hold."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    sizes += [F.greatest(F.size(c), F.lit(0)) * 48 for c, kind in df.dtypes if kind.startswith("array")]
    row = sum(sizes, F.lit(16 + 8 * len(df.columns)))
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= (BROADCAST_BYTES if limit is None else limit)


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df) else df


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids``. The ids are broadcast if measured to be small, else both sides are shuffled."""
    return df.join(_side(materialise(ids.select(on).distinct(), "ids")), on, "left_semi")


def missing_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not in ``ids``, null included; joined as in keep_ids()."""
    return df.join(_side(materialise(ids.select(on).distinct(), "missing-ids")), on, "left_anti")


def attach(df: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """Inner join on ``on``; ``few`` is broadcast if measured to be small, else both sides are shuffled."""
    return df.join(_side(few), on)


def spread_join(rows: DataFrame, table: DataFrame, on: str | list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has a row for each key and in ``count`` how many of all ``total`` rows have it.

    Heavy keys go by broadcast, of which there are at most HEAVY_KEYS by their definition; the others are shuffled, and
    none of them fills a task. Keys aren't null.
    """
    bound = max(HEAVY_ROWS, total // HEAVY_KEYS)
    on = [on] if isinstance(on, str) else on
    heavy = F.broadcast(table.where(F.col(count) > bound))
    light = rows.join(F.broadcast(table.where(F.col(count) > bound).select(*on)), on, "left_anti").join(table.where(F.col(count) <= bound), on)
    return rows.join(heavy, on).unionByName(light)


def running(df: DataFrame, order: list, number: str, name: str, **sums: str) -> DataFrame:
    """``df`` with ``number``, the place of each row by ``order`` from 0, and for each new=old of ``sums`` the sum of old over the rows before.

    Rows are range-sorted; the totals of the ranges, of which there are as many as shuffle partitions, are summed first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), name)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(old).alias(f"_{new}") for new, old in sums.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_rows", *(f"_{new}" for new in sums))])
    within = Window.partitionBy("_range").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(totals), "_range").withColumn(number, F.col("_rows") + F.row_number().over(within) - 1)
    for new, old in sums.items():
        rows = rows.withColumn(new, F.col(f"_{new}") + F.coalesce(F.sum(old).over(so_far), F.lit(0)))
    return rows.drop("_range", "_rows", *(f"_{new}" for new in sums))


def drawn(df: DataFrame, key: str, about: int) -> DataFrame:
    """About ``about`` rows of ``df`` (all, if it has fewer), drawn by the hash of ``key``, each key once: reruns agree."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("drawn")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(draw < about / max(df.count(), 1)).dropDuplicates([key])


def bounded_sample(df: DataFrame, key: str, label: str, per_class: int, most_classes: int = 1000) -> DataFrame:
    """About ``per_class`` rows of each value of ``label`` (all, if it has fewer), drawn by the hash of ``key``.

    The draw depends on the rows alone, so reruns agree; rows that repeat a key and label count once. Its size is bounded
    by ``per_class * most_classes`` whatever the size of ``df``; it is for fitting classifiers only.
    """
    counts = df.groupBy(label).count().orderBy(F.desc("count"), label).limit(most_classes)
    share = counts.select(F.col(label).alias("_label"), (F.lit(float(per_class)) / F.col("count")).alias("_share"))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = df.join(F.broadcast(share), F.col(label) == F.col("_label")).where(draw < F.col("_share"))
    return found.drop("_label", "_share").dropDuplicates([key, label])


# Hashes of spans of an array: a polynomial over a random table, summed once, so that any span's hash is a difference.
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _grown(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_cache.get(name, ())) < n:
        _cache[name] = _powers(base, max(n, 1 << 16) * 5 // 4)
    return _cache[name][:n]


def prefix_hash(symbols: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums P (one longer than ``symbols``) for span_hash(); ``table`` holds a random uint64 for each symbol."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(table[symbols] * _grown("r", _R, len(symbols)), out=out[1:])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal spans hash alike wherever they stand."""
    return mix64((prefix[end] - prefix[start]) * _grown("i", _RINV, len(prefix))[start])
