"""Keyed upsert on plain files: the newest row of each key wins, and a new snapshot is returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key: the last in ``order``. A struct maximum, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    at = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)]
    ranked = df.withColumn("_row", F.struct(*rest)).groupBy(*keys).agg(F.max_by("_row", F.struct(*at)).alias("_row"))
    return ranked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def merged(c: str, keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> Column:
    """A column of a key's row, by upsert(), from its structs _new and _old, whose _hit is true if there is such a row."""
    if c in keep:
        picked = F.when(F.col("_old._hit"), F.col(f"_old.`{c}`")).otherwise(F.col(f"_new.`{c}`"))
    elif c in fill:
        picked = F.coalesce(F.col(f"_new.`{c}`"), F.col(f"_old.`{c}`"))
    else:
        picked = F.when(F.col("_new._hit"), F.col(f"_new.`{c}`")).otherwise(F.col(f"_old.`{c}`"))
    return picked.alias(c)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str | Column], keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """The snapshot after ``source`` is put into ``target`` (same columns).

    The last source row of each key wins. Matched rows take the new values, but keep the old ones of ``keep``, and of
    ``fill`` where the new one is null. Unmatched rows of either side stay. Null keys match nothing.
    """
    cols = [c for c in target.columns if c not in keys]
    new = latest_by(source.select(*target.columns), keys, order)
    new = new.select(*keys, F.struct(*cols, F.lit(True).alias("_hit")).alias("_new"))
    old = target.select(*keys, F.struct(*cols, F.lit(True).alias("_hit")).alias("_old"))

    return old.join(new, keys, "full_outer").select(*keys, *[merged(c, keep, fill) for c in cols]).select(*target.columns)


def upsert_counts(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """(created, updated): distinct keys of ``source`` that ``target`` lacks and has."""
    known = target.select(*keys, F.lit(1).alias("_known")).distinct()
    return source.select(*keys).distinct().join(known, keys, "left").agg(F.count_if(F.col("_known").isNull()).alias("created"), F.count("_known").alias("updated"))
