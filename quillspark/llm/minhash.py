"""One-permutation MinHash fingerprints, with DataFrame expressions only.

Every shingle of five words is hashed once; the top bits of the hash choose one of ``BINS`` bins and
each bin keeps its smallest hash.  An empty bin borrows from the non-empty bin that comes first in a
pseudo-random order of its own (optimal densification: each probe is uniform and independent of the
bin's neighbours).  Of every bin the low ``BITS`` bits are stored; the likeness of two fingerprints
is the share of equal bins, corrected for bins that agree by chance.

Edge cases: a null text is an empty one; fewer than five words are one shingle, no words one empty
shingle, so equal texts always have equal fingerprints and likeness 1; rows with a null ``doc_id``
come last in the order of documents, rows that share an id follow one another in the order of their
texts; a single document is its own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole_text

WORDS, BINS, BITS = 5, 128, 8
SHIFT = 64 - BINS.bit_length() + 1


def with_minhash(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the packed bins of ``text_col`` (no nulls) as an array of ``BINS`` tinyints.

    Each step is a column of its own, so that nothing is worked out twice.
    """
    w, h, s, m = (f"__{out}_{x}" for x in "whsm")
    word_hashes = F.transform(F.filter(F.split(F.lower(text_col), r"\s+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    at = lambda i, k: F.col(w)[i + k]
    shingles = F.when(F.size(w) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(at(i, k) for k in range(WORDS))))).otherwise(F.array(F.xxhash64(w)))
    minima = F.filter(h, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, SHIFT) != F.shiftrightunsigned(F.col(h)[F.greatest(i - 1, F.lit(0))], SHIFT)))
    bin_of = lambda x: F.shiftrightunsigned(x, SHIFT).cast("int")
    low = lambda x: x.bitwiseAND((1 << BITS) - 1).cast("int")
    borrowed = lambda b: F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(b, bin_of(x)).alias("order"), low(x).alias("low"))))["low"]
    place = lambda b: F.array_position(s, b).cast("int")
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: (F.when(place(b) > 0, low(F.col(m)[F.greatest(place(b) - 1, F.lit(0))])).otherwise(borrowed(b)) - 128).cast("tinyint"))
    steps = df.withColumn(w, word_hashes).withColumn(h, F.sort_array(shingles)).drop(w).withColumn(m, minima).drop(h)
    return steps.withColumn(s, F.transform(m, bin_of)).withColumn(out, bins).drop(s, m)


def packed(bins: Column) -> Column:
    """The bins as lowercase hexadecimal digits, two a bin."""
    return F.lower(F.array_join(F.transform(bins, lambda v: F.lpad(F.hex(v.cast("int") + 128), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard index: equal bins, less those that agree by chance."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))


def with_next(rows: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """``rows`` (``doc_id``, ``text`` and others) with ``next_<c>`` of the next row in descending ``doc_id``, cyclic.

    Rows are dealt by ranges of ids; the first row of each range also goes, as a ghost, to the range
    before it, so one shuffle of bounded ranges replaces a sort of everything in one task.  The
    bounds and first ids of the ranges are all that reaches the driver.
    """
    cuts = rows.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    # Buckets count from the largest ids; ids that are null have the last.
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(len(cuts) - F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))))
    dealt = rows.withColumn("__bucket", bucket.cast("int"))
    firsts = sorted((r[0], r[1]) for r in rows.select("doc_id").withColumn("__bucket", bucket.cast("int")).groupBy("__bucket").agg(F.max("doc_id")).collect())
    if not firsts:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    size = len(cuts) + 2
    top, before = [None] * size, [-1] * size
    for k, (j, first) in enumerate(firsts):
        top[j], before[j] = first, firsts[k - 1][0]
    lookup = lambda values, kind: F.array(*(F.lit(v).cast(kind) for v in values))[F.col("__bucket")]
    here = F.struct(F.col("__bucket").alias("to"), F.lit(0).alias("ghost"))
    there = F.struct(lookup(before, "int").alias("to"), F.lit(1).alias("ghost"))
    both = F.explode(F.when(F.col("doc_id").eqNullSafe(lookup(top, "bigint")), F.array(here, there)).otherwise(F.array(here)))
    spread = dealt.select("*", both.alias("__at"))
    order = Window.partitionBy("__at.to").orderBy("__at.ghost", F.col("doc_id").desc_nulls_last(), "text")
    led = spread.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.where("__at.ghost = 0").drop("__at", "__bucket")


def op6_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    own = with_minhash(docs, "text", "bins")
    led = with_next(own, ["text", "bins"], 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = led.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))).drop("next_text", "text")
    both = with_minhash(edited, "edited", "edited_bins")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
