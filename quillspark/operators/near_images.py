"""Near-duplicate images, the cheap tests first, and reviews that override the rule.

An image is a row ``id, sha, width, height`` with a grid of grey values from 0 to 1.  Shape and two hashes decide which pairs
are compared at all, by an equi-join; the grids, which are large, are read for those pairs only.  Equal images
(one ``sha``) are no pair: the first of them stands for all.

Edge cases: rows without hash, shape or sha meet nothing; repeated rows count once; an image without area has no shape.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the rule, and what it calls its outcomes.
ASPECT, HASH_BITS, SURE_BITS, SURE_ASPECT, SURE_RMS, APART_RMS = 0.08, 4, 1, 0.01, 0.01, 0.03
CONFIRMED = "CONFIRMED_STRONG_NEAR_DUPLICATE"
CONFIRMED_FIELDS = "CONFIRMED_STRONG_NEAR_DUPLICATE_MATCHING_COMPANY_DATE_TOTAL"
DISTINCT_BOTH = "DISTINCT_RECEIPTS_DIFFERENT_DATE_AND_TOTAL"
DISTINCT_EITHER = "DISTINCT_RECEIPTS_DIFFERENT_DATE_OR_TOTAL"
REVIEW = "CANDIDATE_REQUIRES_REVIEW"


def bits_of(tests: Column) -> Column:
    """Up to 64 truths as a whole number, the first highest."""
    return F.aggregate(tests, F.lit(0).cast("long"), lambda acc, t: F.shiftleft(acc, 1).bitwiseOR(t.cast("long")))


def average_hash(grid: Column) -> Column:
    """A bit for each value: not below the mean of all."""
    mean = F.aggregate(grid, F.lit(0.0), lambda s, v: s + v) / F.size(grid)
    return bits_of(F.transform(grid, lambda v: v >= mean))


def difference_hash(grid: Column, width: int) -> Column:
    """A bit for each value but the last of its row of ``width``: above its right neighbour."""
    inner = F.filter(F.sequence(F.lit(0), F.size(grid) - 2), lambda i: (i + 1) % width != 0)
    return bits_of(F.transform(inner, lambda i: grid[i] > grid[i + 1]))


def slices(value: Column, n: int) -> list[Column]:
    edges = [64 * i // n for i in range(n + 1)]
    return [F.shiftrightunsigned(value, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def candidate_pairs(images: DataFrame, aspect: float = ASPECT, bits: int = HASH_BITS) -> DataFrame:
    """``a, b, dhash_bits, ahash_bits, aspect_difference`` of images (``id, sha, width, height, dhash, ahash``) that may be near copies.

    Of ``bits + 1`` slices of each hash one at least is equal, so near images agree in a slice of one hash, a slice of the
    other, and the range of their shape (or the next): such a key has some 26 bits and the shape, so it stays rare in tables of
    thousands of millions.  A pair counts where it meets by the first equal slices, once.
    """
    step, n = -math.log(1 - aspect), bits + 1
    shape = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width").cast("double") / F.col("height"))
    known = images.withColumn("shape", shape).where("shape is not null and dhash is not null and ahash is not null and sha is not null")
    first = known.groupBy("sha").agg(F.min_by(F.struct("id", "shape", "dhash", "ahash"), "id").alias("x")).select("sha", "x.*")
    d, h = slices(F.col("dhash"), n), slices(F.col("ahash"), n)
    choices = F.array(*(F.struct(F.lit(n * i + j).alias("choice"), F.xxhash64(x, y).alias("part")) for i, x in enumerate(d) for j, y in enumerate(h)))
    keyed = first.select("id", "shape", "dhash", "ahash", F.floor(F.log("shape") / step).alias("range"), F.explode(choices).alias("k")).select("*", "k.choice", "k.part").drop("k")
    side = lambda s: keyed.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "shape", "dhash", "ahash")), "choice", "part", "range")
    near = side("a").withColumn("range", F.explode(F.array(*(F.col("range") + i for i in (-1, 0, 1)))))
    x, y = F.col("dhash_a").bitwiseXOR(F.col("dhash_b")), F.col("ahash_a").bitwiseXOR(F.col("ahash_b"))
    difference = F.abs(F.col("shape_a") - F.col("shape_b")) / F.greatest("shape_a", "shape_b")
    met = near.join(side("b"), ["choice", "part", "range"]).where((F.col("id_a") < F.col("id_b")) & (F.bit_count(x) <= bits) & (F.bit_count(y) <= bits) & (difference <= aspect))
    equal = lambda v: F.array_position(F.array(*(s == 0 for s in slices(v, n))), True) - 1
    once = met.where(F.col("choice") == n * equal(x) + equal(y))
    return once.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.bit_count(x).alias("dhash_bits"), F.bit_count(y).alias("ahash_bits"), difference.alias("aspect_difference"))


def with_rms(pairs: DataFrame, grids: DataFrame) -> DataFrame:
    """``pairs`` with ``rms``, the root of the mean squared difference of their grids (``id, grid``), read for these images only."""
    left, right = (grids.select(F.col("id").alias(s), F.col("grid").alias(f"grid_{s}")) for s in "ab")
    both = pairs.join(left, "a").join(right, "b")
    total = F.aggregate(F.zip_with("grid_a", "grid_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return both.withColumn("rms", F.sqrt(total / F.size("grid_a"))).drop("grid_a", "grid_b")


def cascade(images: DataFrame, grids: DataFrame, fields: DataFrame) -> DataFrame:
    """Candidate pairs with ``rms`` and ``status``; ``fields`` has ``id, date, total``."""
    found = with_rms(candidate_pairs(images), grids)
    left, right = (fields.select(F.col("id").alias(s), F.col("date").alias(f"date_{s}"), F.col("total").alias(f"total_{s}")) for s in "ab")
    both = found.join(left, "a").join(right, "b")
    differs = lambda c: ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    sure = (F.col("dhash_bits") <= SURE_BITS) & (F.col("ahash_bits") <= SURE_BITS) & (F.col("aspect_difference") <= SURE_ASPECT) & (F.col("rms") <= SURE_RMS)
    status = F.when(sure, CONFIRMED).when(differs("date") & differs("total") & (F.col("rms") > APART_RMS), DISTINCT_BOTH).otherwise(REVIEW)
    return both.withColumn("status", status).select(*found.columns, "status")


def reviewed_status(candidates: DataFrame, reviews: DataFrame, fields: DataFrame) -> DataFrame:
    """``candidates`` (``a, b, dhash_bits, phash_bits``) with ``status``: that of a review of the pair, in either order, else the rule's.

    ``reviews``: ``a, b, review_status, position``; of several reviews of a pair the last counts.  ``fields``: ``id, company, date, total``.
    """
    pair = F.array_sort(F.array("a", "b")).alias("pair")
    last = reviews.where("a is not null and b is not null").groupBy(pair).agg(F.max_by("review_status", "position").alias("review"))
    sides = [fields.select(F.col("id").alias(s), F.struct("company", "date", "total").alias(f"of_{s}")) for s in "ab"]
    both = candidates.withColumn("pair", pair).join(last, "pair", "left").join(sides[0], "a", "left").join(sides[1], "b", "left")
    same = lambda c: F.col(f"of_a.{c}").eqNullSafe(F.col(f"of_b.{c}"))
    sure = (F.col("dhash_bits") <= SURE_BITS) & (F.col("phash_bits") <= SURE_BITS) & same("company") & same("date") & same("total")
    rule = F.when(sure, CONFIRMED_FIELDS).when(~same("date") | ~same("total"), DISTINCT_EITHER).otherwise(REVIEW)
    return both.withColumn("status", F.coalesce("review", rule)).withColumn("by_review", F.col("review").isNotNull()).select(*candidates.columns, "status", "by_review")
