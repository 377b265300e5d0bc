"""Exact and near duplicates, record linkage keys, and groups that must not cross splits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed value: a time of so many digits holds a clock.
CLOCK_DIGITS = 10


def stable_group_id(dataset: str, members: Column) -> Column:
    """``dataset_`` and 16 hexadecimal digits of the digest of the sorted members."""
    return F.concat(F.lit(f"{dataset}_"), F.substring(F.sha2(F.array_join(F.array_sort(members), "\n").cast("binary"), 256), 1, 16))


def exact_groups(df: DataFrame, key: Column, member: str) -> DataFrame:
    """Rows with equal ``key``: size and smallest member of each group of two or more."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("size"), F.min(member).alias("first")).where("size > 1")


def simhash60(df: DataFrame, id_col: str, text: str, out: str) -> DataFrame:
    """``id_col`` and 60 bits of ``text`` for every row: each the majority over distinct words of a bit of their SHA-256 prefix.

    Words are exploded and their bits summed, two counts to a number, in one aggregate that each task ends for its own rows; a
    text without words has no bit set.
    """
    words = F.array_distinct(F.filter(F.split(F.col(text), "[ \\n]+"), lambda w: w != ""))
    rows = df.select(id_col, text).withColumn("__row", F.monotonically_increasing_id())
    each = rows.select(id_col, "__row", F.explode_outer(words).alias("__w")).select(id_col, "__row", F.conv(F.substring(F.sha2(F.col("__w").cast("binary"), 256), 1, 15), 16, 10).cast("long").alias("__h"))
    bit = lambda b: F.shiftright("__h", b).bitwiseAND(1)
    sums = [F.sum(bit(b) + F.shiftleft(bit(b + 30), 32)).alias(f"__s{b}") for b in range(30)]
    counted = each.groupBy(id_col, "__row").agg(F.count("__h").alias("__n"), *sums)
    low = lambda b: F.col(f"__s{b}").bitwiseAND((1 << 32) - 1)
    high = lambda b: F.shiftright(f"__s{b}", 32)
    voted = lambda votes, b: F.when(votes * 2 > F.col("__n"), F.lit(1 << b)).otherwise(F.lit(0)).cast("long")
    return counted.select(id_col, reduce(add, [voted(low(b), b) + voted(high(b), b + 30) for b in range(30)]).alias(out))


def hamming_pairs(prints: DataFrame, id_col: str, fp: str, at_most: int, bits: int = 60, together: int | None = None) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints at ``at_most`` bits or fewer, each once.

    Of ``at_most + together`` slices, ``together`` at least are equal: fingerprints meet in an equi-join by
    each choice of so many slices, and a pair counts where it meets by its first equal slices.  How many are taken
    together follows from the number of fingerprints: keys get as many bits as it has, so that by chance few share one.
    """
    if together is None:
        together, wanted = 2, max(1, prints.count()).bit_length()
        while bits * together // (at_most + together) < wanted and together < 6:
            together += 1
    slices = at_most + together
    edges = [bits * i // slices for i in range(slices + 1)]
    part = lambda c, i: F.shiftright(c, edges[i]).bitwiseAND((1 << edges[i + 1] - edges[i]) - 1)
    choices = list(combinations(range(slices), together))
    keys = F.array(*(F.struct(F.lit(n).alias("choice"), F.xxhash64(*(part(F.col(fp), i) for i in c)).alias("parts")) for n, c in enumerate(choices)))
    keyed = prints.select(id_col, fp, F.explode(keys).alias("k")).select(id_col, fp, F.col("k.choice").alias("choice"), F.col("k.parts").alias("parts"))
    left, right = (keyed.select(F.col(id_col).alias(n), F.col(fp).alias(f"fp_{n}"), "choice", "parts") for n in "ab")
    x = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    # Keys are many times the prints they come from, which the planner's sizes do not show: never a broadcast.
    near = left.join(right.hint("merge"), ["choice", "parts"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= at_most))
    equal = F.slice(F.filter(F.array(*(F.when(part(x, i) == 0, i) for i in range(slices))), lambda i: i.isNotNull()), 1, together)
    first = F.array(*(F.array(*map(F.lit, c)) for c in choices))[F.col("choice")]
    return near.where(equal == first).select("a", "b", F.bit_count(x).alias("distance"))


def near_status(distance: Column, reviewed: Column) -> Column:
    """A review decides; else 0 bits is confirmed, up to 2 likely, more is possible."""
    return F.coalesce(reviewed, F.when(distance == 0, "confirmed").when(distance <= 2, "likely").otherwise("possible"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def record_key(timestamp: Column, total: Column) -> Column:
    """Digits of the time and of the total joined by a bar; null where either has none."""
    t, a = digits(timestamp), digits(total)
    return F.when((t != "") & (a != ""), F.concat_ws("|", t, a))


def name_key(text: Column) -> Column:
    """Upper case without marks, all but letters and digits as single spaces; empty for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.upper(X.fold(F.upper(text))), "[^A-Z0-9]+", " ")), F.lit(""))


def seller_key(seller: Column) -> Column:
    """The name key of a seller, ``<NO_SELLER>`` where nothing is left of it."""
    return F.coalesce(F.nullif(name_key(seller), F.lit("")), F.lit("<NO_SELLER>"))


def receipt_key(timestamp: Column, total: Column, names: Column) -> Column:
    """Digits of the time and of the total, joined by a bar; a time without a clock (under ``CLOCK_DIGITS`` digits)
    needs the sorted name keys ``names`` of the items too.  Null where a part is missing."""
    t, a = (F.coalesce(digits(c), F.lit("")) for c in (timestamp, total))
    known = (t != "") & (a != "")
    return F.when(known & (F.length(t) >= CLOCK_DIGITS), F.concat_ws("|", t, a)).when(known & (F.size(names) > 0), F.concat_ws("|", t, a, F.array_sort(names)))


def seller_strata(docs: DataFrame, member: str, key: str, seller: str, least: int = 20) -> DataFrame:
    """``member, group_id, stratum``: documents with one ``key`` are a group named by its smallest member; without a key each is its own.

    A seller with ``least`` documents or more is a bucket, the others are ``<OTHER>``; the stratum of a
    group is its most frequent bucket, of equally frequent ones that with the smallest member.
    """
    first = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(member).alias("__first"))
    often = docs.groupBy(seller).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(seller, F.lit(True).alias("__often"))
    grouped = docs.select(member, key, seller).join(first, key, "left").join(often, seller, "left")
    placed = grouped.select(member, F.coalesce("__first", member).alias("group_id"), F.when(F.col("__often"), F.col(seller)).otherwise("<OTHER>").alias("bucket"))
    counts = placed.groupBy("group_id", "bucket").agg(F.count("*").alias("n"), F.min(member).alias("m"))
    strata = counts.groupBy("group_id").agg(F.min_by("bucket", F.struct(-F.col("n"), "m")).alias("stratum"))
    return placed.select(member, "group_id").join(strata, "group_id").select(member, "group_id", "stratum")


def leakage(members: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return members.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows")).where("splits > 1")


def duplicate_groups(docs: DataFrame, member: str, key: str, near: DataFrame, components) -> DataFrame:
    """``member, group_id, size, reasons``: groups by equal ``key`` and confirmed links ``a, b``; documents without either are groups of one.

    ``components`` joins links between members (``node, root``).  Reasons are ``exact`` and ``near``, in order.
    """
    least = docs.groupBy(key).agg(F.min(member).alias("b"), F.count("*").alias("n"))
    exact = docs.join(least, key).where((F.col(member) != F.col("b")) & (F.col("n") > 1)).select(F.col(member).alias("a"), "b")
    links = exact.withColumn("reason", F.lit("exact")).unionByName(near.select("a", "b").withColumn("reason", F.lit("near")))
    roots = components(links).withColumnRenamed("node", member)
    rooted = docs.select(member).join(roots, member, "left").withColumn("root", F.coalesce("root", member))
    why = links.select(F.col("a").alias(member), "reason").join(rooted, member).groupBy("root").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    size = rooted.groupBy("root").agg(F.count("*").alias("size"))
    out = rooted.join(size, "root").join(why, "root", "left")
    return out.select(member, F.col("root").alias("group_id"), "size", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
