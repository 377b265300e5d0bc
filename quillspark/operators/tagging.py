"""Rules and post-processing around line items: token kinds, overlaps, routing, warnings, contracts."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_kind(token: Column) -> Column:
    """``barcode``, ``money``, ``number``, ``junk`` or ``word``, the first that fits."""
    return (
        F.when(token.rlike("^[0-9]{8,14}$"), "barcode")
        .when(token.rlike("^-?[0-9]{1,3}([.,][0-9]{3})+([.,][0-9]{1,2})?$"), "money")
        .when(token.rlike("^-?[0-9]+([.,][0-9]+)?$"), "number")
        .when(F.char_length(F.regexp_replace(token, "[^0-9A-Za-z]", "")) * 2 < F.char_length(token), "junk")
        .otherwise("word")
    )


def header_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur between word edges; they are plain text, not patterns."""
    low = F.lower(text)
    return reduce(add, (low.rlike(f"(^|[^a-z0-9])\\Q{k}\\E([^a-z0-9]|$)").cast("int") for k in keywords))


def best_overlap(words: DataFrame, regions: DataFrame, doc: str, least: float, cell: float = 64.0) -> DataFrame:
    """For each word (``x0..y1``) the region that covers most of it, from ``least`` on; the first region wins ties.

    Both sides are dealt by document and grid cell, so the join is an equi-join however large a page.
    """

    def cells(df: DataFrame) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        return df.withColumn("__cx", F.explode(span("x0", "x1"))).withColumn("__cy", F.explode(span("y0", "y1")))

    w = cells(words.select(doc, "word", "x0", "y0", "x1", "y1"))
    r = cells(regions.select(doc, "region", *(F.col(c) for c in ("x0", "y0", "x1", "y1")))).select(doc, "__cx", "__cy", "region", *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    wide = F.least("x1", "rx1") - F.greatest("x0", "rx0")
    high = F.least("y1", "ry1") - F.greatest("y0", "ry0")
    near = w.join(r, [doc, "__cx", "__cy"]).withColumn("cover", F.when((wide > 0) & (high > 0), wide * high / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).otherwise(0.0)).where(F.col("cover") >= least)
    best = near.groupBy(doc, "word").agg(F.min(F.struct((-F.col("cover")).alias("c"), F.col("region").alias("region"))).alias("b"))
    return best.select(doc, "word", F.col("b.region").alias("region"), (-F.col("b.c")).alias("cover"))


def route_for_review(flagged: Column, wrong: Column) -> Column:
    """Confusion of a review flag with whether a document has errors."""
    return F.when(flagged & wrong, "caught").when(flagged, "needless").when(wrong, "missed").otherwise("clean")


def recoverability(items: DataFrame, keys: list[str], label: str) -> DataFrame:
    """What can be said of each item's quantity from the labels that were detected."""
    has = lambda n: F.coalesce(F.bool_or(F.col(label) == n), F.lit(False))
    per = items.groupBy(*keys).agg(has("QUANTITY").alias("q"), has("UNIT_PRICE").alias("p"), has("LINE_TOTAL").alias("t"))
    return per.select(F.when(F.col("q"), "detected").when(F.col("p") & F.col("t"), "inferable").otherwise("not_recoverable").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def collect_warnings(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())


def contract(identity: Column, items: Column, warnings: Column) -> Column:
    """The result message as JSON with explicit nulls."""
    return F.to_json(F.struct(F.lit("v2").alias("version"), identity.alias("id"), items.alias("items"), warnings.alias("warnings")), {"ignoreNullFields": "false"})


def choice_among(values: Column, label: Column) -> Column:
    """Which of several candidates a label names: ``all``, ``first_only``, ``last_only``, ``mixed`` or ``none``."""
    hit = lambda x: x == label
    return (
        F.when(~F.exists(values, hit), "none")
        .when(F.forall(values, hit), "all")
        .when(hit(values[0]) & (F.size(F.filter(values, hit)) == 1), "first_only")
        .when(hit(F.element_at(values, -1)) & (F.size(F.filter(values, hit)) == 1), "last_only")
        .otherwise("mixed")
    )


def upload_status(name_known: Column, same_hash: Column, hash_known: Column) -> Column:
    """Same name and hash: existing; same name only: conflict; same hash only: duplicate; else new."""
    return F.when(name_known & same_hash, "existing").when(name_known, "conflict").when(hash_known, "duplicate").otherwise("new")


def parse_config_name(name: Column) -> Column:
    """``[V6]{L|C}<n>[_b..][_u..][_t..][_s1]`` as a struct; null fields where a part is absent."""
    part = lambda k: F.nullif(F.regexp_extract(name, f"_{k}([0-9.]+)", 1), F.lit(""))
    head = "^(V6)?([LC])([0-9]+)"
    return F.struct((F.regexp_extract(name, head, 1) == "V6").alias("v6"), F.nullif(F.regexp_extract(name, head, 2), F.lit("")).alias("mode"), F.regexp_extract(name, head, 3).try_cast("int").alias("side"), part("b").alias("box"), part("u").alias("unclip"), part("t").alias("threshold"), name.rlike("_s1($|_)").alias("single"))


def rank_rows(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with its rank by a total order inside ``group``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
