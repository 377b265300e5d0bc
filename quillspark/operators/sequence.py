"""Operators that depend on order inside a document or a key."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted


def running_offset(width: Column, keys: list[str], order: list[str]) -> Column:
    """The sum of ``width`` over the rows before, 0 at the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(width).over(w), F.lit(0))


def ordered_text(value: str, order: list[str], separator: str = " ") -> Column:
    """The non-empty values in order, joined; null where there are none."""
    kept = F.collect_list(F.when((F.col(value) != "") & F.col(value).isNotNull(), F.struct(*order, value)))
    return F.nullif(F.array_join(F.transform(F.array_sort(kept), lambda x: x[value]), separator), F.lit(""))


def merge_windows(df: DataFrame, keys: list[str], margin: str, window: str) -> DataFrame:
    """Of several predictions for one position, that farthest from its window's edge; the first window wins ties."""
    order = Window.partitionBy(*keys).orderBy(F.col(margin).desc(), window)
    return df.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def repair_bio(tags: DataFrame, doc: str, pos: str, tag: str, region: str) -> DataFrame:
    """``I-x`` becomes ``B-x`` where the word before (``IGNORE`` aside) belongs to another region."""
    order = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col(tag) != "IGNORE", F.struct(region)), ignorenulls=True).over(order)
    fixed = F.when(F.col(tag).startswith("I-") & ~before[region].eqNullSafe(F.col(region)), F.concat(F.lit("B-"), F.substring(tag, 3, 1000))).otherwise(F.col(tag))
    return tags.withColumn(tag, fixed)


def nearest_later_first(left: DataFrame, right: DataFrame, key: str, at: str, other: str) -> DataFrame:
    """For each row of ``left`` the row of ``right`` with the same key nearest in ``at``; of equally near ones the later.

    Both sides are merged in one order per key and looked at once: no pairs are made.
    """
    l = left.withColumns({"__side": F.lit(1), "__other": F.lit(None).cast(dict(right.dtypes)[other]), "__t": F.col(at)})
    r = right.select(key, F.lit(0).alias("__side"), F.col(other).alias("__other"), F.col(at).alias("__t"))
    both = l.unionByName(r, allowMissingColumns=True)
    tie = [F.col("__t"), F.col("__side")]
    seen = F.when(F.col("__side") == 0, F.struct(F.col("__t").alias("t"), F.col("__other").alias("o")))
    before = F.last(seen, ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col("__t"), F.col("__side"), F.col("__other").desc()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(seen, ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col("__t").desc(), F.col("__side"), F.col("__other").desc()).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"b": before, "a": after}).where("__side = 1")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap_b, gap_a = (us("__t") - us("b.t")), (us("a.t") - us("__t"))
    pick = F.when(F.col("a").isNotNull() & (F.col("b").isNull() | (gap_a <= gap_b)), F.struct(F.col("a.o").alias("o"), gap_a.alias("g"))).otherwise(F.struct(F.col("b.o").alias("o"), gap_b.alias("g")))
    return found.select(*left.columns, pick["o"].alias("nearest"), pick["g"].alias("distance_us"))


def row_bands(boxes: list[tuple[float, float, float, float]]) -> list[list[int]]:
    """Positions of ``x0, y0, x1, y1`` boxes in reading order, by rows.

    Boxes are taken by centre, then left edge; one joins the current band if they overlap by half the
    smaller height, and the band is the running mean of its members.
    """
    rows: list[list[int]] = []
    top = bottom = 0.0
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][1] + boxes[i][3], boxes[i][0])):
        _, a, _, b = boxes[i]
        if rows and min(b, bottom) - max(a, top) >= 0.5 * min(b - a, bottom - top):
            n = len(rows[-1])
            top, bottom = (top * n + a) / (n + 1), (bottom * n + b) / (n + 1)
            rows[-1].append(i)
        else:
            top, bottom = a, b
            rows.append([i])
    return [sorted(row, key=lambda i: boxes[i][0]) for row in rows]


def band_rows(boxes: DataFrame, doc: str, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """``boxes`` with ``row_no`` and ``col_no`` by :func:`row_bands`: a fold over one document's boxes, which are few."""
    at = [boxes.columns.index(c) for c in (x0, y0, x1, y1)]

    def fold(rows: list[tuple]) -> list[tuple]:
        found = row_bands([tuple(r[k] for k in at) for r in rows])
        return [(*rows[i], k, j) for k, row in enumerate(found) for j, i in enumerate(row)]

    schema = ", ".join(f"`{n}` {t}" for n, t in boxes.dtypes) + ", row_no int, col_no int"
    return fold_sorted(boxes, [doc], [x0, *(c for c in boxes.columns if c not in (doc, x0))], fold, schema)


def union_bands(boxes: DataFrame, doc: str, x0: str, y0: str, y1: str) -> DataFrame:
    """The adapter's order: boxes by centre, then left edge; one joins the band it overlaps most (half the smaller
    height at least, of equal ones the first), and bands grow to the union; bands are read by top, then left edge."""
    at = {c: boxes.columns.index(c) for c in (x0, y0, y1)}

    def fold(rows: list[tuple]) -> list[tuple]:
        bands: list[list] = []
        for r in rows:
            a, b = r[at[y0]], r[at[y1]]
            shared = [max(0.0, min(b, band[1]) - max(a, band[0])) / max(1e-9, min(b - a, band[1] - band[0])) for band in bands]
            best = bands[shared.index(max(shared))] if shared and max(shared) >= 0.5 else None
            if best is None:
                bands.append([a, b, [r]])
            else:
                best[0], best[1] = min(best[0], a), max(best[1], b)
                best[2].append(r)
        bands.sort(key=lambda x: (x[0], min(r[at[x0]] for r in x[2])))
        flat = [(r, k) for k, band in enumerate(bands) for r in sorted(band[2], key=lambda r: (r[at[x0]], r[at[y0]]))]
        return [(*r[:-1], k, n) for n, (r, k) in enumerate(flat)]

    schema = ", ".join(f"`{n}` {t}" for n, t in boxes.dtypes) + ", row_no int, reading_order int"
    centred = boxes.withColumn("__c", F.col(y0) + F.col(y1))
    return fold_sorted(centred, [doc], ["__c", x0, *(c for c in boxes.columns if c not in (doc, x0))], fold, schema)


def window_bounds(sizes: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """``(first, beyond the last)`` of windows over items of ``sizes``, by sums up to each item.

    A window takes what fits the budget, one item at least; the next begins at the earliest later item
    from which on at most ``overlap`` is shared.
    """
    upto = [0, *accumulate(sizes)]
    out = [(0, max(1, bisect_right(upto, budget) - 1))] if sizes else []
    while out and out[-1][1] < len(sizes):
        first, end = out[-1]
        first = bisect_left(upto, upto[end] - overlap, first + 1, end)
        out.append((first, max(first + 1, bisect_right(upto, upto[first] + budget, first) - 1)))
    return out


def plan_windows(words: DataFrame, doc: str, pos: str, tokens: str, budget: int, overlap: int) -> DataFrame:
    """``doc, window, first, last`` of windows of at most ``budget`` tokens that share at most ``overlap`` with the one before.

    Windows begin and end at words; a word longer than the budget has a window of its own.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        return [(rows[0][0], k, rows[a][1], rows[b - 1][1]) for k, (a, b) in enumerate(window_bounds([r[2] for r in rows], budget, overlap))]

    kinds = dict(words.dtypes)
    return fold_sorted(words.select(doc, pos, tokens), [doc], [pos], fold, f"{doc} {kinds[doc]}, window int, first {kinds[pos]}, last {kinds[pos]}")
