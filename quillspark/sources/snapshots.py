"""Keyed tables that are rewritten as new versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], position: list[str] | None = None) -> DataFrame:
    """Rows of ``updates`` replace those of ``base`` with the same keys, or are added.

    Of updates that share their keys the last by ``position`` counts (without one, the largest by its other columns).
    """
    rest = [c for c in updates.columns if c not in keys]
    last = last_per_key(updates, keys, position or rest) if rest else updates.distinct()
    return base.join(updates.select(*keys).distinct(), keys, "left_anti").select(*base.columns).unionByName(last.select(*base.columns))


def last_per_key(log: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """An append-only log read back: of each key the last row."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*position)).alias("x"))
    return last.select(*keys, "x.*").select(*log.columns)


def still_to_do(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys are not done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def cache_key(*parts: Column) -> Column:
    """A content address: SHA-256 of the parts as JSON."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).cast("binary"), 256)


def through_cache(work: DataFrame, cache: DataFrame, key: str, value: str, compute) -> DataFrame:
    """``work`` with ``value`` from ``cache``, worked out by ``compute`` only where it is missing; ``hit`` tells which."""
    hits = work.join(cache.select(key, value), key).withColumn("hit", F.lit(True))
    misses = compute(work.join(cache.select(key), key, "left_anti")).withColumn("hit", F.lit(False))
    return hits.unionByName(misses)
