"""End-to-end scores: groups by exact sets and pairs, cells of matched, missed and extra items, review routing.

Ratios are rounded to four places, null where nothing is counted.  Documents without gold groups do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineitems import greedy_match

OVERALL = "__all"


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4))


def sets(rows: DataFrame, doc: str, group: str, member: str) -> DataFrame:
    """``doc, members, n``: the distinct sets of members that groups of a document have, as sorted lists."""
    grouped = rows.where(F.col(group).isNotNull()).groupBy(doc, group).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return grouped.select(doc, "members").distinct().withColumn("n", F.size("members").cast("long"))


def group_scores(gold: DataFrame, pred: DataFrame, layouts: DataFrame, doc: str, group: str, member: str) -> DataFrame:
    """Per ``layout`` and over all: exact documents, exact items, and pairs of members that share a group.

    A set is compared as a whole by equality of its sorted members.  Pairs are counted from the sizes of sets and of their
    intersections, n(n-1)/2, and are not made; a member is in one group of each side.
    """
    g, p = sets(gold, doc, group, member), sets(pred, doc, group, member)
    pairs = F.expr("div(n * (n - 1), 2)")
    ours = g.groupBy(doc).agg(F.count("*").alias("gold_items"), F.sum(pairs).alias("pair_gold"))
    theirs = p.groupBy(doc).agg(F.count("*").alias("pred_items"), F.sum(pairs).alias("pair_pred"))
    exact = g.join(p.select(doc, "members"), [doc, "members"]).groupBy(doc).agg(F.count("*").alias("exact_items"))
    numbered = lambda df, s: df.select(doc, F.col("members").alias(s), F.explode("members").alias("m"))
    met = numbered(g, "g").join(numbered(p, "p"), [doc, "m"]).groupBy(doc, "g", "p").agg(F.count("*").alias("n")).groupBy(doc).agg(F.sum(pairs).alias("pair_both"))
    joined = ours.join(theirs, doc, "left").join(exact, doc, "left").join(met, doc, "left").join(layouts.select(doc, "layout"), doc, "left")
    counts = ["gold_items", "pred_items", "exact_items", "pair_gold", "pair_pred", "pair_both"]
    filled = joined.na.fill(0, counts).withColumn("same", (F.col("gold_items") == F.col("pred_items")) & (F.col("exact_items") == F.col("gold_items")))
    doubled = filled.withColumn("layout", F.explode(F.array(F.coalesce("layout", F.lit("none")), F.lit(OVERALL))))
    total = doubled.groupBy("layout").agg(F.count("*").alias("documents"), F.count_if("same").alias("documents_exact"), *(F.sum(c).alias(c) for c in counts))
    c = F.col
    precision, recall = rate(c("pair_both"), c("pair_pred")), rate(c("pair_both"), c("pair_gold"))
    return total.select(
        "layout", "documents", rate(c("documents_exact"), c("documents")).alias("document_exact_rate"), "gold_items", "pred_items",
        rate(c("exact_items"), c("gold_items")).alias("item_recall"), rate(c("exact_items"), c("pred_items")).alias("item_precision"),
        precision.alias("pair_precision"), recall.alias("pair_recall"),
        F.when((precision > 0) & (recall > 0), F.round(2 * precision * recall / (precision + recall), 4)).alias("pair_f1"))


def matched_cells(gold: DataFrame, pred: DataFrame, doc: str, item: str, cells: list[str]) -> DataFrame:
    """``doc, gold_item, pred_item, cell, expected, found, outcome`` of every cell of items paired by :func:`lineitems.greedy_match`.

    ``outcome``: ``equal``, ``wrong``, ``missing`` (expected only) or ``extra`` (found only); cells empty on both sides are left out.
    Rows that share an item number, or have none, are items of their own.
    """
    both = greedy_match(gold, pred, doc, item, cells, keep=True)
    one = F.inline(F.array(*(F.struct(F.lit(c).alias("cell"), F.col(f"gold.{c}").cast("string").alias("expected"), F.col(f"pred.{c}").cast("string").alias("found")) for c in cells)))
    each = both.select(doc, "gold_item", "pred_item", one).where("expected is not null or found is not null")
    outcome = F.when(F.col("expected").eqNullSafe(F.col("found")), "equal").when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("wrong")
    return each.withColumn("outcome", outcome)


def cell_rates(cells: DataFrame) -> DataFrame:
    """Per cell name and over all: how many cells, those of each outcome, and the share that a user would have to correct."""
    outcomes = ("equal", "wrong", "missing", "extra")
    each = cells.groupBy("cell").agg(F.count("*").alias("cells"), *(F.count_if(F.col("outcome") == o).alias(o) for o in outcomes))
    doubled = each.withColumn("cell", F.explode(F.array("cell", F.lit(OVERALL))))
    total = doubled.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("cells", *outcomes)))
    return total.withColumn("correction_rate", rate(F.col("cells") - F.col("equal"), F.col("cells")))


def routing(cells: DataFrame, flagged: DataFrame, doc: str) -> DataFrame:
    """How review flags (``doc, flagged``) meet documents with errors: ``caught``, ``needless``, ``missed``, ``clean``, with their numbers."""
    wrong = cells.groupBy(doc).agg(F.bool_or(F.col("outcome") != "equal").alias("wrong"))
    both = flagged.join(wrong, doc, "left").withColumn("wrong", F.coalesce("wrong", F.lit(False)))
    name = F.when(F.col("flagged") & F.col("wrong"), "caught").when(F.col("flagged"), "needless").when(F.col("wrong"), "missed").otherwise("clean")
    return both.groupBy(name.alias("outcome")).agg(F.count("*").alias("documents"))
