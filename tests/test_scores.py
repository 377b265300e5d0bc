"""Scores over groups and matched items against plain counting."""

import random
from collections import Counter, defaultdict
from itertools import combinations

from quillspark.operators import scores as S

MEMBERS = "d long, m int, g int"


def ratio(a, b):
    return round(a / b, 4) if b else None


def test_groups_by_exact_sets_and_pairs(spark):
    rng = random.Random(7)
    gold = [(d, m, rng.choice([None, 0, 1, 2])) for d in range(40) for m in range(rng.randint(1, 7))]
    pred = [(d, m, rng.choice([g, g, 0, 3])) for d, m, g in gold if rng.random() < 0.9] + [(99, 1, 1)]
    layouts = [(d, f"l{d % 3}") for d in range(40) if d % 10]
    of = dict(layouts)
    counts = defaultdict(Counter)

    def sets(rows, d):
        groups = defaultdict(set)
        for e, m, g in rows:
            if e == d and g is not None:
                groups[g].add(m)
        return {frozenset(x) for x in groups.values()}

    for d in range(40):
        g, p = sets(gold, d), sets(pred, d)
        if not g:
            continue
        pairs = lambda s: {c for x in s for c in combinations(sorted(x), 2)}
        for key in (of.get(d, "none"), S.OVERALL):
            c = counts[key]
            c["n"] += 1
            c["same"] += g == p
            c["gi"] += len(g)
            c["pi"] += len(p)
            c["ex"] += len(g & p)
            c["pg"] += len(pairs(g))
            c["pp"] += len(pairs(p))
            c["pb"] += len(pairs(g) & pairs(p))
    got = {r["layout"]: tuple(r)[1:] for r in S.group_scores(*(spark.createDataFrame(x, MEMBERS) for x in (gold, pred)), spark.createDataFrame(layouts, "d long, layout string"), "d", "g", "m").collect()}
    want = {}
    for k, c in counts.items():
        p, r = ratio(c["pb"], c["pp"]), ratio(c["pb"], c["pg"])
        want[k] = (c["n"], ratio(c["same"], c["n"]), c["gi"], c["pi"], ratio(c["ex"], c["gi"]), ratio(c["ex"], c["pi"]), p, r, round(2 * p * r / (p + r), 4) if p and r else None)
    assert got == want


def test_cells_of_matched_missed_and_extra_items(spark):
    schema = "d long, item int, name string, price string"
    gold = [(1, 1, "a", "5"), (1, 2, "b", None), (1, 3, "c", "7"), (2, 1, "x", "1")]
    pred = [(1, 8, "b", "9"), (1, 9, "a", "6"), (1, 10, None, "4"), (3, 1, "z", None)]
    cells = S.matched_cells(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema), "d", "item", ["name", "price"]).cache()
    got = Counter((r["d"], r["gold_item"], r["pred_item"], r["cell"], r["outcome"]) for r in cells.collect())
    assert got == Counter([
        (1, 1, 9, "name", "equal"), (1, 1, 9, "price", "wrong"), (1, 2, 8, "name", "equal"), (1, 2, 8, "price", "extra"),
        (1, 3, None, "name", "missing"), (1, 3, None, "price", "missing"), (1, None, 10, "price", "extra"),
        (2, 1, None, "name", "missing"), (2, 1, None, "price", "missing"), (3, None, 1, "name", "extra")])
    rates = {r["cell"]: (r["cells"], r["equal"], r["wrong"], r["missing"], r["extra"], r["correction_rate"]) for r in S.cell_rates(cells).collect()}
    assert rates == {"name": (5, 2, 0, 2, 1, 0.6), "price": (5, 0, 1, 2, 2, 1.0), S.OVERALL: (10, 2, 1, 4, 3, 0.8)}
    flagged = spark.createDataFrame([(1, True), (2, False), (4, True), (5, False)], "d long, flagged boolean")
    assert {r["outcome"]: r["documents"] for r in S.routing(cells, flagged, "d").collect()} == {"caught": 1, "missed": 1, "needless": 1, "clean": 1}
