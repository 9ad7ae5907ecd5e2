"""Relational building blocks: latest rows, diffs, merges, spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    """One row for each key: the newest, of equals the one with the largest ``tie``.

    An aggregate of the whole row by its maximum, so rows combine before the shuffle, where a
    ranking window would send and sort all of them.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(newest, tie)).alias("_row"))
    return picked.select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order`` (a ranking window, for mixed directions)."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, rank: str) -> DataFrame:
    """(key, change) of two snapshots: new, resolved, worsened, improved or unchanged by rank."""
    rows = before.select(key, F.col(rank).alias("_a")).join(after.select(key, F.col(rank).alias("_b")), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "resolved").when(F.col("_b") > F.col("_a"), "worsened").when(F.col("_b") < F.col("_a"), "improved").otherwise("unchanged")
    return rows.select(key, change.alias("change"))


def delta_merge(previous: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """``changed``, and the previous rows whose keys it does not hold."""
    return changed.unionByName(previous.join(changed.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """The table after an insert-or-replace by key; of repeated keys in ``rows`` the one with the largest ``newest`` stays, of equals (or without it) the largest row."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*([newest] if newest else []), *rest)
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*rows.columns) if rest else rows.distinct()
    return delta_merge(table, picked, keys)


def insert_once(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """An insert-only table after adding those rows whose key it lacks, each key once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def single(df: DataFrame):
    """The only row, or None; more than one is an error. Reads two rows at most."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("expected one row at most")
    return rows[0] if rows else None


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def day_spine(df: DataFrame, first: str, last: str) -> DataFrame:
    """One row for each day from ``first`` to ``last``, both included."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the one with the least ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")
