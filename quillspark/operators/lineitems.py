"""Line items: number roles, inferred quantities, grouping by anchors, and matching against truth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .folds import fold_sorted
from .sequence import row_bands


def infer_quantity(quantity: Column, price: Column, total: Column) -> Column:
    """A missing quantity as ``total / price`` to 3 decimals (half to even) if it gives the total to within 1."""
    d = lambda c: c.cast("decimal(18,4)")
    q = F.bround((d(total) / d(price)).cast("decimal(30,12)"), 3)
    ok = (d(price) > 0) & (d(total) != 0) & (F.abs(q * d(price) - d(total)) <= 1)
    return F.coalesce(quantity.cast("decimal(18,3)"), F.when(ok, q.cast("decimal(18,3)")))


def align_to_anchors(values: list[float], anchors: list[float], gap: float) -> list[int]:
    """For each value the anchor it is aligned with, or -1: monotone, least total distance, ``gap`` a skipped one."""
    n, m = len(values), len(anchors)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                cost[i][j] = min(cost[i - 1][j - 1] + abs(values[i - 1] - anchors[j - 1]), cost[i - 1][j] + gap, cost[i][j - 1] + gap)
            elif i or j:
                cost[i][j] = (i + j) * gap
    out, i, j = [-1] * n, n, m
    while i and j:
        if cost[i][j] == cost[i - 1][j - 1] + abs(values[i - 1] - anchors[j - 1]):
            out[i - 1], i, j = j - 1, i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + gap:
            i -= 1
        else:
            j -= 1
    return out


#: Numeric labels in the order in which ties between them go, the label of names, and the costs
#: (in heights of a line) of a skipped value, an anchor without a name and a head that reads like a continuation.
NUMERIC, NAME = ("LINE_TOTAL", "UNIT_PRICE", "QUANTITY"), "ITEM_NAME"
GAP, NO_NAME, CONTINUES, NAME_LINES = 2.5, 4.0, 1.0, 4


def name_owners(places: list[float], anchors: list[float], extra: list[float], most: float = float("inf")) -> tuple[float, list[int]]:
    """Cost and the anchor of each name line: every anchor takes the next run of lines, or none.

    Costs only grow from anchor to anchor, so it ends, at no finite cost, once every way costs more than ``most``.
    """
    states: list[tuple[float, tuple | None]] = [(0.0, None)] + [(float("inf"), None)] * len(places)
    for k, anchor in enumerate(anchors):
        # A run's cost from its first line on does not depend on where it ends.
        heads = [states[j][0] + abs(place - anchor) + extra[j] for j, place in enumerate(places)]
        after = []
        for i, (cost, runs) in enumerate(states):
            least, first = cost + NO_NAME, -1
            for j in range(max(0, i - NAME_LINES), i):
                if heads[j] < least:
                    least, first = heads[j], j
            after.append((least, runs if first < 0 else (k, first, i, states[first][1])))
        states = after
        if min(states, key=lambda s: s[0])[0] > most:
            return float("inf"), []
    cost, runs = states[-1]
    owner = [0] * len(places)
    while runs:
        k, first, end, runs = runs
        owner[first:end] = [k] * (end - first)
    return cost, owner


def anchored_items(entities: list[tuple]) -> list[list[int]]:
    """Positions of ``(label, text, x0, y0, x1, y1)`` by items: the most frequent numeric label anchors them.

    The other numbers align to the anchors at the upper median of their offsets; those that do not are
    items of their own, at the end.  Name lines fall to anchors in runs, at the offset that costs least.
    """
    middle = [(e[3] + e[5]) / 2 for e in entities]
    by = {n: sorted((i for i, e in enumerate(entities) if e[0] == n), key=middle.__getitem__) for n in NUMERIC}
    first = max(NUMERIC, key=lambda n: len(by[n]))
    places = [middle[i] for i in by[first]]
    heights = sorted(e[5] - e[3] for e in entities)
    unit = max(1.0, heights[len(heights) // 2])
    items, alone = [[i] for i in by[first]], []
    for n in NUMERIC:
        if n != first and by[n]:
            ys = [middle[i] for i in by[n]]
            offset = sorted(min((y - a for a in places), key=abs) for y in ys)[len(ys) // 2]
            for i, k in zip(by[n], align_to_anchors([(y - offset) / unit for y in ys], [a / unit for a in places], GAP), strict=True):
                (items[k] if k >= 0 else alone).append(i if k >= 0 else [i])
    order = [i for row in row_bands([e[2:6] for e in entities]) for i in row if entities[i][0] == NAME]
    if order:
        ys = [middle[i] for i in order]
        starts = [(entities[i][1] or "").strip()[:1] for i in order]
        extra = [CONTINUES if s.islower() or s in ("(", "[") else 0.0 for s in starts]
        step = unit / 4
        tried = sorted({round((y - a) / step) * step for y in ys for a in places if abs(y - a) <= 4 * unit}) or [0.0]
        lines = [a / unit for a in places]
        least, owner = float("inf"), [0] * len(order)
        for d in sorted(tried, key=abs):  # of equal costs the smallest offset
            cost, own = name_owners([(y - d) / unit for y in ys], lines, extra, least)
            if cost < least:
                least, owner = cost, own
        for i, k in zip(order, owner, strict=True):
            items[k].append(i)
    return items + alone


def walked_items(entities: list[tuple]) -> list[list[int]]:
    """The same without numbers to anchor on: rows in reading order open items or go on with the last.

    Inline layouts (half the rows with a name hold numbers) open an item at a row with both, others at a
    name after numbers; a row of numbers goes on unless a label of it is there already.
    """
    rows = row_bands([e[2:6] for e in entities])
    label = lambda i: entities[i][0]
    named = [r for r in rows if any(label(i) == NAME for i in r)]
    inline = not named or 2 * sum(any(label(i) in NUMERIC for i in r) for r in named) >= len(named)
    items: list[list[int]] = []
    for row in rows:
        now = {label(i) for i in row}
        have = {label(i) for i in items[-1]} if items else set()
        name, numbers, counted = NAME in now, now & set(NUMERIC), have & set(NUMERIC)
        if name and numbers:
            goes_on = not inline and NAME in have and not counted
        elif name:
            goes_on = inline or not counted
        else:
            goes_on = not numbers & have
        if items and goes_on:
            items[-1] += row
        else:
            items.append(list(row))
    return items


def group_line_items(entities: DataFrame, doc: str, ref: str, label: str, text: str, box: tuple[str, str, str, str]) -> DataFrame:
    """``doc, item_no, label, ref, method`` of names and numbers: ``anchored`` where a document has numbers, else ``rows``.

    No entity of these labels is lost.  A fold over one document's entities.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        found = [r[2:8] for r in rows]
        anchored = any(e[0] in NUMERIC for e in found)
        items = (anchored_items if anchored else walked_items)(found)
        return [(rows[i][0], n, rows[i][2], rows[i][1], "anchored" if anchored else "rows") for n, item in enumerate(items, 1) for i in sorted(item)]

    kinds = dict(entities.dtypes)
    wanted = entities.where(F.col(label).isin(*NUMERIC, NAME)).select(doc, ref, label, text, *box)
    return fold_sorted(wanted, [doc], [ref, label, *box], fold, f"{doc} {kinds[doc]}, item_no int, {label} {kinds[label]}, {ref} {kinds[ref]}, method string")


def value_codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where values are; nulls have -1."""
    if pa.types.is_null(column.type):
        return np.full(len(column), -1)
    if pa.types.is_floating(column.type):
        column = pc.add(column, pa.scalar(0.0, column.type))  # of two zeros one
    elif pa.types.is_nested(column.type):
        column = pa.array([None if v is None else repr(v) for v in column.to_pylist()], pa.string())
    return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def cell_codes(column: pa.Array) -> np.ndarray:
    """The same for cells: what is not a number equals nothing, like a null."""
    return value_codes(pc.if_else(pc.is_nan(column), pa.scalar(None, column.type), column) if pa.types.is_floating(column.type) else column)


def boundaries(keys: pa.Array) -> np.ndarray:
    """Where a key differs from the one before it."""
    return np.flatnonzero(np.diff(value_codes(keys))) + 1


def greedy_partners(docs: np.ndarray, predicted: np.ndarray, cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of gold items and of their partners (-1: none), with equal cells, then predictions that are left.

    ``docs`` numbers the documents, whose rows stand together.  The first gold items of all documents choose at once, then the
    second ones; a step holds one number for each prediction of the documents that still have an item to match.
    """
    gold, pred = np.flatnonzero(~predicted), np.flatnonzero(predicted)
    n = int(docs[-1]) + 1 if len(docs) else 0
    counts, golds = np.bincount(docs[pred], minlength=n), np.bincount(docs[gold], minlength=n)
    starts, rank = np.cumsum(counts) - counts, np.arange(len(gold)) - (np.cumsum(golds) - golds)[docs[gold]]
    partner, same, free = np.full(len(gold), -1), np.zeros(len(gold), np.int64), np.ones(len(pred), bool)
    left, right = [c[gold] for c in cells], [c[pred] for c in cells]
    able = np.flatnonzero(counts[docs[gold]] > 0)
    able = able[np.argsort(rank[able], kind="stable")]
    for now in np.split(able, np.flatnonzero(np.diff(rank[able])) + 1) if len(able) else []:
        each = counts[docs[gold[now]]]
        first, most = np.cumsum(each) - each, int(each.max())
        place = np.arange(each.sum()) - np.repeat(first, each)
        at, who = place + np.repeat(starts[docs[gold[now]]], each), np.repeat(now, each)
        equal = np.zeros(len(at), np.int64)
        for x, y in zip(left, right, strict=True):
            equal += (x[who] == y[at]) & (x[who] >= 0)
        # Of equally good ones the earliest: the place counts below the number of equal cells.
        best = np.maximum.reduceat(equal * free[at] * most + (most - 1 - place), first)
        hit = best >= most
        took = starts[docs[gold[now]]] + most - 1 - best % most
        partner[now[hit]], same[now[hit]] = pred[took[hit]], best[hit] // most
        free[took[hit]] = False
    alone = pred[free]
    none = np.full(len(alone), -1)
    return np.concatenate([gold, none]), np.concatenate([partner, alone]), np.concatenate([same, np.zeros(len(alone), np.int64)])


def greedy_match(gold: DataFrame, pred: DataFrame, doc: str, item: str, cells: list[str], keep: bool = False) -> DataFrame:
    """``doc, gold_item, pred_item, equal_cells``: each gold item, in order, takes the unused predicted item with most equal cells.

    Of equally good ones the earliest; without an equal cell none (a missed item), and predictions that
    are left stand alone (extra items).  Null cells never agree.  With ``keep`` also ``gold`` and ``pred``, the cells of both.
    Rows are dealt by document and sorted by Spark; a task holds a batch and what is left of one document.
    """
    g = gold.select(doc, item, *cells).withColumn("__side", F.lit(False))
    both = g.unionByName(pred.select(doc, item, *cells).withColumn("__side", F.lit(True)))
    kinds = dict(both.dtypes)
    inner = ", ".join(f"`{c}`: {kinds[c]}" for c in cells)
    schema = f"`{doc}` {kinds[doc]}, gold_item {kinds[item]}, pred_item {kinds[item]}, equal_cells int" + (f", gold struct<{inner}>, pred struct<{inner}>" if keep else "")
    out_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out_schema)

    def matched(rows: pa.Table) -> pa.RecordBatch:
        key, *columns, side = (c.combine_chunks() for c in rows.columns)
        docs = np.zeros(len(key), np.int64)
        docs[boundaries(key)] = 1
        a, b, same = greedy_partners(np.cumsum(docs), side.to_numpy(zero_copy_only=False), [cell_codes(c) for c in columns[1:]])
        x, y = pa.array(a, mask=a < 0), pa.array(b, mask=b < 0)
        found = [key.take(pa.array(np.where(a < 0, b, a))), columns[0].take(x), columns[0].take(y), pa.array(same, pa.int32())]
        for at in (x, y) if keep else ():
            found.append(pa.StructArray.from_arrays([c.take(at) for c in columns[1:]], names=cells, mask=at.is_null()))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(found, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0)
            cuts = boundaries(pa.concat_arrays([held[-1].column(0)[-1:], key])) - 1 if held else boundaries(key)
            if len(cuts):
                yield matched(pa.Table.from_batches([*held, batch[: cuts[-1]]]))
                held, batch = [], batch[cuts[-1] :]
            held.append(batch)
        if held:
            yield matched(pa.Table.from_batches(held))

    return both.repartition(doc).sortWithinPartitions(doc, item, *cells).mapInArrow(run, out_schema)


def number_roles(numbers: DataFrame, row: list[str], x: str, value: str, money: str, tolerance: float = 1.0) -> DataFrame:
    """``row, total, quantity, price`` of rows with a money value: the rightmost is the total.

    Of the other numbers (nulls and zeros aside) the first pair in either order, by the place of the
    quantity, then of the price, whose product gives the total to within ``tolerance`` is quantity and
    price; else the first number that is no money is the quantity and the last money the price.  Pairs
    are made among the numbers of one row of one document, which are a handful.
    """
    whole = numbers.where(F.col(value).isNotNull() & (F.col(value) != 0))
    right = whole.where(F.col(money)).groupBy(*row).agg(F.max_by(value, x).alias("total"), F.max(x).alias("last"))
    rest = whole.join(right, row).where(F.col(x) != F.col("last"))
    fall = rest.groupBy(*row).agg(F.min_by(value, F.when(~F.col(money), F.col(x))).alias("small"), F.max_by(value, F.when(F.col(money), F.col(x))).alias("dear"))
    q = rest.select(*row, "total", F.col(x).alias("qx"), F.col(value).alias("q"))
    p = rest.select(*row, F.col(x).alias("px"), F.col(value).alias("p"))
    fit = q.join(p, row).where((F.col("qx") != F.col("px")) & (F.abs(F.col("q") * F.col("p") - F.col("total")) <= tolerance))
    best = fit.groupBy(*row).agg(F.min_by(F.struct("q", "p"), F.struct("qx", "px")).alias("b"))
    pick = lambda pair, other: F.when(F.col("b").isNotNull(), F.col(pair)).otherwise(F.col(other))
    return right.join(best, row, "left").join(fall, row, "left").select(*row, "total", pick("b.q", "small").alias("quantity"), pick("b.p", "dear").alias("price"))


def cell_errors(gold: DataFrame, pred: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    """Per cell name: compared, wrong; rows of one side alone count every non-null cell as wrong."""
    g = gold.select(*keys, F.struct(*cells).alias("g"))
    p = pred.select(*keys, F.struct(*cells).alias("p"))
    both = g.join(p, keys, "full_outer")
    each = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("cell"), F.col(f"g.{c}").cast("string").alias("a"), F.col(f"p.{c}").cast("string").alias("b")) for c in cells))).alias("x")).select("x.*")
    return each.where("a is not null or b is not null").groupBy("cell").agg(F.count("*").alias("compared"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("wrong"))
