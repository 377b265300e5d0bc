"""What the normalisers share: a name for a value, and their result ``value, status, warnings``.

The status is ``ok``, ``missing``, ``invalid`` or ``ambiguous``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` worked out once: the optimiser would otherwise copy it to every use."""
    return F.transform(F.array(value), body)[0]


def result(value: Column, status: Column, warnings: Column | None = None) -> Column:
    return F.struct(value.alias("value"), status.alias("status"), F.coalesce(warnings if warnings is not None else F.array().cast("array<string>"), F.array().cast("array<string>")).alias("warnings"))


def strip_zeros(c: Column) -> Column:
    """A decimal string without zeros after the last digit that counts."""
    return F.when(c.contains("."), F.regexp_replace(F.regexp_replace(c, "0+$", ""), "[.]$", "")).otherwise(c)
