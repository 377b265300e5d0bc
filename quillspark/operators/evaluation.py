"""Scores of predictions against ground truth, with masked, absent and empty values kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of a ground-truth slot that can be right or wrong; the other two are masked.
EVALUABLE = ("annotated", "annotated_empty", "absent")
MASKED = ("source_missing", "unlabeled")


def ratio(n: Column, d: Column) -> Column:
    """Null where the denominator is zero."""
    return F.when(d != 0, n / d)


def precision_recall_f1(tp: Column, fp: Column, fn: Column, evaluable: Column) -> tuple[Column, Column, Column]:
    """Nothing evaluable: all null.  No predictions: precision 0 if there is support, else null.
    No support: recall null.  Both zero: F1 0; either null: F1 null."""
    some = evaluable > 0
    p = F.when(some, F.when(tp + fp > 0, tp / (tp + fp)).when(tp + fn > 0, F.lit(0.0)))
    r = F.when(some & (tp + fn > 0), tp / (tp + fn))
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    return p, r, f1


def evaluate_fields(slots: DataFrame) -> DataFrame:
    """``document_id, field, status, gt, pred`` -> one row per field and one, ``ALL``, over all.

    A masked slot is neither right nor wrong.  A wrong value counts as a false positive and a false
    negative at once.  ``macro_f1`` is the mean of the defined F1 of the fields.
    """
    marked = slots.withColumns({"evaluable": F.col("status").isin(*EVALUABLE), "hit": F.col("gt").eqNullSafe(F.col("pred"))})
    one = lambda c: F.coalesce(F.sum((F.col("evaluable") & c).cast("long")), F.lit(0))
    has_gt, has_pred = F.col("gt").isNotNull(), F.col("pred").isNotNull()
    counted = marked.rollup("field").agg(
        F.sum(F.col("evaluable").cast("long")).alias("evaluable"),
        F.sum((~F.col("evaluable")).cast("long")).alias("masked"),
        one(F.col("hit")).alias("correct"),
        one(F.col("hit") & has_gt).alias("tp"),
        one(~F.col("hit") & has_pred).alias("fp"),
        one(~F.col("hit") & has_gt).alias("fn"),
        one(has_gt).alias("support"),
        F.grouping("field").alias("total"),
    )
    p, r, f1 = precision_recall_f1(*(F.col(c) for c in ("tp", "fp", "fn", "evaluable")))
    scored = counted.select(F.when(F.col("total") == 1, "ALL").otherwise(F.col("field")).alias("field"), "evaluable", "masked", "correct", "tp", "fp", "fn", "support", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "total")
    # At most one row per field: a window over all of them is a handful of rows.
    macro = F.avg(F.when(F.col("total") == 0, F.col("f1"))).over(Window.partitionBy(F.lit(1)))
    return scored.withColumn("macro_f1", F.when(F.col("total") == 1, macro)).drop("total")


def document_exact_match(slots: DataFrame) -> DataFrame:
    """Documents with something evaluable, and how many have every evaluable slot right."""
    per = slots.where(F.col("status").isin(*EVALUABLE)).groupBy("document_id").agg(F.bool_and(F.col("gt").eqNullSafe(F.col("pred"))).alias("ok"))
    return per.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0)).alias("exact"))


def bio_spans(tags: DataFrame, keys: list[str], pos: str, tag: str) -> DataFrame:
    """``keys, label, start, end`` of the entities of tag sequences (end exclusive).

    ``B-x``, or ``I-x`` not continuing an open ``x``, opens; anything else closes.  ``IGNORE`` reads as ``O``.
    """
    order = Window.partitionBy(*keys).orderBy(pos)
    t = F.when(F.col(tag) == "IGNORE", "O").otherwise(F.col(tag))
    marked = tags.withColumn("__t", t).withColumn("__before", F.lag("__t").over(order))
    label = F.when(F.col("__t") != "O", F.substring("__t", 3, 1000))
    inside = F.col("__t").startswith("I-") & F.col("__before").isNotNull() & (F.col("__before") != "O") & (F.substring("__before", 3, 1000) == label)
    opened = marked.withColumn("label", label).withColumn("__n", F.sum((~inside & label.isNotNull()).cast("int")).over(order))
    return opened.where("label is not null").groupBy(*keys, "__n", "label").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("__n")


def bio_invalid(tags: DataFrame, keys: list[str], pos: str, tag: str) -> DataFrame:
    """``keys, valid``: an ``I-x`` must follow ``B-x`` or ``I-x``; ``IGNORE`` is transparent."""
    order = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col(tag) != "IGNORE", F.col(tag)), ignorenulls=True).over(order)
    bad = F.col(tag).startswith("I-") & ~(F.coalesce(F.substring(before, 3, 1000), F.lit("")) == F.substring(F.col(tag), 3, 1000))
    return tags.select(*keys, bad.alias("bad")).groupBy(*keys).agg((~F.bool_or("bad")).alias("valid"))


def evaluate_spans(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Exact multiset match of spans by ``keys`` and label; ratios with a zero denominator are 0."""
    on = [*keys, "label", "start", "end"]
    g = gold.groupBy(*on).agg(F.count("*").alias("g"))
    p = pred.groupBy(*on).agg(F.count("*").alias("p"))
    both = g.join(p, on, "full_outer").withColumns({"g": F.coalesce("g", F.lit(0)), "p": F.coalesce("p", F.lit(0))})
    summed = both.rollup("label").agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("p").alias("predicted"), F.sum("g").alias("support"), F.grouping("label").alias("total"))
    zero = F.lit(0.0)
    pr, rc = F.coalesce(ratio(F.col("tp"), F.col("predicted")), zero), F.coalesce(ratio(F.col("tp"), F.col("support")), zero)
    return summed.select(F.when(F.col("total") == 1, "ALL").otherwise(F.col("label")).alias("label"), "tp", "predicted", "support", pr.alias("precision"), rc.alias("recall"), F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(zero).alias("f1"))


def corpus_cer(pairs: DataFrame, label: str, ref: str, hyp: str) -> DataFrame:
    """Character error rate per label and over all: edits over reference characters, and the share exactly right."""
    edits = pairs.withColumn("__e", F.levenshtein(ref, hyp)).withColumn("__n", F.char_length(ref))
    out = edits.rollup(label).agg(F.count("*").alias("pairs"), F.sum("__e").cast("long").alias("edits"), F.sum("__n").cast("long").alias("chars"), F.sum((F.col(ref) == F.col(hyp)).cast("long")).alias("exact"), F.grouping(label).alias("__all"))
    return out.select(F.when(F.col("__all") == 1, "ALL").otherwise(F.col(label)).alias("label"), "pairs", "edits", "chars", "exact", ratio(F.col("edits"), F.col("chars")).alias("cer"))


def nearest_rank(values: Column, share: float) -> Column:
    """The element of a sorted array at index ``round_half_even((n - 1) * share)``."""
    return F.element_at(values, F.bround((F.size(values) - 1) * F.lit(share), 0).cast("int") + 1)


def nearest_rank_stats(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Count, smallest, largest and nearest-rank percentiles by ``key``.

    Ranks come from a window over each key's distinct values with running counts, so no group is
    gathered into one array.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    # Distinct values per key are summed in ranges first, then within: see running_counts.
    order = Window.partitionBy(key).orderBy(value)
    ranked = counted.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    pick = lambda s: F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * F.lit(s), 0), F.col(value)))
    return ranked.groupBy(key).agg(F.max("total").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *(pick(s).alias(name) for name, s in shares.items()))


def pair_f1(gold: DataFrame, pred: DataFrame, doc: str, group: str, member: str) -> DataFrame:
    """Precision, recall and F1 over pairs of members that share a group.

    Counted from group sizes (n(n-1)/2 for gold, predicted, and their intersections), never as pairs.
    """
    both = gold.select(doc, member, F.col(group).alias("g")).join(pred.select(doc, member, F.col(group).alias("p")), [doc, member], "full_outer")
    pairs = lambda *keys: both.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(doc, *keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("div(n * (n - 1), 2)")), F.lit(0)).alias("x"))
    return pair_scores(pairs("g", "p"), pairs("g"), pairs("p"))


def pair_scores(shared: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Ratios of three one-row counts ``x``."""
    one = shared.select(F.col("x").alias("shared")).crossJoin(gold.select(F.col("x").alias("gold"))).crossJoin(predicted.select(F.col("x").alias("predicted")))
    pr, rc = ratio(F.col("shared"), F.col("predicted")), ratio(F.col("shared"), F.col("gold"))
    return one.select("shared", "gold", "predicted", pr.alias("precision"), rc.alias("recall"), F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).alias("f1"))


def mode_first_seen(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The most frequent value by ``key``; of equally frequent ones that seen first by ``order``."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    rank = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("first"))
    return counted.withColumn("r", F.row_number().over(rank)).where("r = 1").select(key, F.col(value).alias("mode"), "n")


def weighted_median(df: DataFrame, key: str, value: str, weight: str, least_rows: int = 1) -> DataFrame:
    """The smallest value at which the running weight reaches half the total; null below ``least_rows`` rows."""
    summed = df.groupBy(key, value).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    upto = F.sum("w").over(Window.partitionBy(key).orderBy(value))
    total = F.sum("w").over(Window.partitionBy(key))
    run = summed.withColumns({"upto": upto, "total": total})
    return run.groupBy(key).agg(F.sum("n").alias("rows"), F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col(value))).alias("m")).select(key, "rows", F.when(F.col("rows") >= least_rows, F.col("m")).alias("weighted_median"))


GRID_ROWS = 1000


def parameter_sweep(df: DataFrame, grid: DataFrame, correct: Column, tie: list[str]) -> DataFrame:
    """Score every parameter row of the small ``grid`` by the share of rows where ``correct`` holds; ``best`` marks the winner.

    The grid has at most ``GRID_ROWS`` rows, else it is refused; the rows are scanned once and multiplied in place.
    """
    points = grid.limit(GRID_ROWS + 1).collect()
    if len(points) > GRID_ROWS:
        raise ValueError(f"a grid of more than {GRID_ROWS} rows")
    kinds = dict(grid.dtypes)
    every = F.array(*(F.struct(*(F.lit(p[c]).cast(kinds[c]).alias(c) for c in grid.columns)) for p in points))
    each = df.withColumn("__grid", F.explode(every)).select(*(df[c] for c in df.columns), "__grid.*")
    scored = each.groupBy(*grid.columns).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("correct"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("correct").desc(), *tie))  # as many rows as the grid
    return scored.select(*grid.columns, "n", "correct", (rank == 1).alias("best"))
