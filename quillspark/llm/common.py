"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, scratch, shared_dir

__all__ = ["ascii_lower", "discard", "div", "give_back", "join_hot", "materialize", "scratch", "shared_dir", "table", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """``text`` with A to Z alone lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def div(a: Column, b: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b)


def join_hot(rows: DataFrame, groups: DataFrame, key: str, n: str, share: int = 512, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``rows`` with one row per group, whose ``n`` counts the rows of ``key``.

    At most ``share`` groups can have more than one in ``share`` of the rows: those few are broadcast, so
    that no task gets the rows of a hot group; the others meet by an ordinary join.  Both sides should be
    written tables, for both are read twice.
    """
    least = (groups.agg(F.sum(n)).first()[0] or 0) // share
    hot, rest = groups.where(F.col(n) > least), groups.where(F.col(n) <= least)
    if least == 0:
        return rows.join(groups, key, how)
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key, how))


def give_back(run):
    """``run`` (for ``mapInArrow``), after whose last batch the worker's free memory goes back: workers outlive their tasks."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
