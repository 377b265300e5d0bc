"""Exports of training samples: one pass over the regions, several files, and a count for everything that is left out.

Every region gets one outcome, the first that holds; the counts are observed while the tagged rows are written, so they cost no pass of
their own, and they add up to the input.  Files are then written from the tagged rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import scratch

KEPT, EMPTY, VOCABULARY, CROP = "kept", "skipped_empty_text", "skipped_out_of_vocab", "skipped_bad_crop"
LEAST_SIDE = 4


def foreign_characters(text: Column, vocabulary: str) -> Column:
    """The distinct characters of a text that a vocabulary does not have."""
    return F.array_except(F.split(text, ""), F.array(*map(F.lit, vocabulary), F.lit("")))


def sample_rows(regions: DataFrame, vocabulary: str, least_side: float = LEAST_SIDE) -> DataFrame:
    """``regions`` (``split, img_id, region, label, text, width, height`` of the crop) with ``sample``, ``foreign``, ``path`` and ``outcome``.

    An empty or null text comes first, then characters that are unknown, then crops that are missing or too small.
    """
    text = F.coalesce(X.clean_label(F.col("text")), F.lit(""))
    named = regions.withColumn("sample", text).withColumn("foreign", foreign_characters(F.col("sample"), vocabulary))
    small = F.coalesce(F.least("width", "height") < least_side, F.lit(True)) | F.col("width").isNull() | F.col("height").isNull()
    outcome = F.when(F.col("sample") == "", EMPTY).when(F.size("foreign") > 0, VOCABULARY).when(small, CROP).otherwise(KEPT)
    stem = F.regexp_replace(F.col("img_id"), "(?<=.)[.][^.]*$", "")
    path = F.concat("split", F.lit("/"), stem, F.lit("_"), F.format_string("%03d", "region"), F.lit(".png"))
    return named.withColumn("path", path).withColumn("outcome", outcome)


def export_samples(regions: DataFrame, vocabulary: str, out: str, splits: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Write annotation lines and a table of the samples below ``out``; returns the tagged rows and the counts.

    Counts are named ``<split>/<outcome>``, with ``rows`` for all of them and ``other_splits`` for regions of no named split, which are
    not exported.  A count that does not add up raises.
    """
    spark, seen = regions.sparkSession, Observation("export")
    known = F.col("split").isin(splits)
    outcomes = (KEPT, EMPTY, VOCABULARY, CROP)
    counters = [F.count_if((F.col("split") == s) & (F.col("outcome") == o)).alias(f"{s}/{o}") for s in splits for o in outcomes]
    path = scratch(spark, "samples")
    tagged = sample_rows(regions, vocabulary).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(known, F.lit(False))).alias("other_splits"), *counters)
    tagged.write.parquet(path)
    counts = {k: int(v) for k, v in seen.get.items()}
    if sum(counts.values()) != 2 * counts["rows"]:
        raise RuntimeError(f"samples do not add up: {counts}")
    tagged = spark.read.parquet(path).where(known)
    kept = tagged.where(F.col("outcome") == KEPT)
    kept.select("split", F.concat_ws("\t", "path", "sample").alias("value")).write.partitionBy("split").text(f"{out}/annotations")
    kept.select("split", "path", "img_id", "region", "label", F.col("sample").alias("text")).write.options(header=True, escape='"').csv(f"{out}/samples")
    return tagged, counts


def summary(tagged: DataFrame) -> DataFrame:
    """``split, kind, name, n``: outcomes, labels of what is kept, and unknown characters of what is not."""
    outcomes = tagged.select("split", F.lit("outcome").alias("kind"), F.col("outcome").alias("name"))
    labels = tagged.where(F.col("outcome") == KEPT).select("split", F.lit("label").alias("kind"), F.col("label").alias("name"))
    foreign = tagged.where(F.col("outcome") == VOCABULARY).select("split", F.lit("character").alias("kind"), F.explode("foreign").alias("name"))
    return outcomes.unionByName(labels).unionByName(foreign).groupBy("split", "kind", "name").agg(F.count("*").alias("n"))
