"""Polygons against rasterised areas, page alignment against a plain sequential version."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import polygons as P
from quillspark.functions import text as X
from quillspark.operators import alignment as A
from quillspark.operators.sequence import row_bands

PAGES = "d long, width int, height int, rotation double"
LINES = f"d long, line int, text string, polygon {P.POLYGON}, score double"
REGIONS = f"d long, region int, label string, text string, polygon {P.POLYGON}"


def corners(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def rows(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


# -- polygons -------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=3, max_size=8), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=3, max_size=8))
def test_common_area_is_what_a_raster_counts(a, b):
    a, b = P.hull(a), P.hull(b)
    if len(a) < 3 or len(b) < 3:
        return
    inside = lambda ring, x, y: all((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0 for p, q in zip(ring, ring[1:] + ring[:1], strict=True))
    step = 0.25
    centres = [step * (k + 0.5) for k in range(int(40 / step))]
    both = [[inside(r, x, y) for x in centres for y in centres] for r in (a, b)]
    count = step * step * sum(p and q for p, q in zip(*both, strict=True))
    got = P.shoelace(P.clipped(a, b))
    assert abs(got - count) <= 0.5 * step * 240  # a raster is off by half a cell along the edges at most
    assert abs(got - P.shoelace(P.clipped(b, a))) < 1e-6
    assert got <= min(P.shoelace(a), P.shoelace(b)) + 1e-6


def test_hull_leaves_out_what_lies_within():
    assert sorted(P.hull([(0, 0), (4, 0), (2, 0), (2, 1), (4, 4), (0, 4), (0, 0), (1, 3)])) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    assert P.hull([(1, 1), (1, 1)]) == [(1, 1)] and P.shoelace(P.hull([(0, 0), (1, 1), (2, 2)])) == 0


def test_meeting_finds_every_touching_pair_once(spark):
    rng = random.Random(3)
    poly = lambda: [(rng.uniform(-50, 250), rng.uniform(-50, 250)) for _ in range(4)] if rng.random() < 0.9 else [(-1e6, -1e6), (1e6, -1e6), (1e6, 1e6)]
    left = [(d, k, rows(poly()), 200, 100) for d in (1, 2) for k in range(25)] + [(3, 0, [], 200, 100), (3, 1, None, 0, 0)]
    right = [(d, k, rows(poly()), 200, 100) for d in (1, 2, 3) for k in range(15)]
    l = spark.createDataFrame(left, f"d long, a int, p {P.POLYGON}, width int, height int")
    r = spark.createDataFrame(right, f"d long, b int, q {P.POLYGON}, width int, height int")
    got = [tuple(x) for x in P.meeting(l, r, "d", "p", "q").select("d", "a", "b").collect()]
    box = lambda p: (min(x["x"] for x in p), min(x["y"] for x in p), max(x["x"] for x in p), max(x["y"] for x in p))
    meets = lambda p, q: p[2] > q[0] and q[2] > p[0] and p[3] > q[1] and q[3] > p[1]
    assert sorted(got) == sorted((d, a, b) for d, a, p, *_ in left if p for e, b, q, *_ in right if d == e and meets(box(p), box(q)))


@pytest.mark.parametrize("degrees", [0.0, 90.0, 180.0, 270.0, 360.0, 33.0])
def test_upright_turns_about_the_centre(spark, degrees):
    df = spark.createDataFrame([(rows([(0, 0), (200, 0), (200, 100), (0, 100), (60, 20)]), 200, 100, degrees)], f"p {P.POLYGON}, w int, h int, r double")
    got, size = df.select(P.upright(F.col("p"), F.col("w"), F.col("h"), F.col("r")), P.upright_size(F.col("w"), F.col("h"), F.col("r"))).first()
    t = math.radians(degrees)
    for a, (x, y) in zip(got, [(0, 0), (200, 0), (200, 100), (0, 100), (60, 20)], strict=True):
        dx, dy = x - 100, y - 50
        assert a["x"] == pytest.approx(size["width"] / 2 + math.cos(t) * dx - math.sin(t) * dy) and a["y"] == pytest.approx(size["height"] / 2 + math.sin(t) * dx + math.cos(t) * dy)
    if degrees == 90.0:
        assert (size["width"], size["height"]) == (100, 200) and (got[4]["x"], got[4]["y"]) == (80.0, 60.0)


# -- texts ----------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=6), st.text("abc ", max_size=9))
def test_substring_distance_is_the_least_over_all_parts(needle, hay):
    costs = {(i, j): X.edit_distance(needle, hay[i:j]) for i in range(len(hay) + 1) for j in range(i, len(hay) + 1)}
    cost = min(costs.values())
    got, start, end = X.substring_distance(needle, hay)
    assert got == cost == costs[start, end] and end == max(j for (_, j), c in costs.items() if c == cost)


def test_words_of_a_line():
    w = A.word_places("Ngày:15/08 10:41  x")
    assert [x["text"] for x in w] == ["Ngày:", "15/08", "10:41", "x"] and w[0]["end"] == w[1]["start"] and w[0]["start"] == 0.0 and w[-1]["end"] == pytest.approx(1.0)
    assert A.word_places(None) == A.word_places("  ") == []
    assert A.character_width("Ế") == A.CAPITAL_WIDTH and A.character_width("7") == A.DIGIT_WIDTH and A.character_width("m") == A.WIDE_WIDTH


def test_a_regions_text_is_matched_to_lines():
    assert X.region_match("abc", ["xxabdxx", "zz"]) == pytest.approx(1 / 3) and X.region_match("abc", []) == 1.0 and X.region_match("", ["a"]) is None


# -- pages ----------------------------------------------------------------------------------------


def plain(lines, regions):
    """Word by word and region by region; boxes are upright."""
    words = []
    for i, (text, (x0, y0, x1, y1)) in enumerate(lines):
        words += [[i, w["text"], (x0 + (x1 - x0) * w["start"], y0, x0 + (x1 - x0) * w["end"], y1)] for w in A.word_places(text)]
    seen = [i for i in range(len(lines)) if any(w[0] == i for w in words)]
    around = lambda bs: (min(b[0] for b in bs), min(b[1] for b in bs), max(b[2] for b in bs), max(b[3] for b in bs))
    rank = {seen[k]: n for n, k in enumerate(k for row in row_bands([around([w[2] for w in words if w[0] == i]) for i in seen]) for k in row)}
    words = [w for _, w in sorted(enumerate(words), key=lambda x: (rank[x[1][0]], x[0]))]
    size = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    common = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    owner, vague, members = {}, {}, {k: [] for k in range(len(regions))}
    for k, (_, _, box) in enumerate(words):
        covers = [common(box, r[2]) / size(box) for r in regions]
        best = max(range(len(regions)), key=lambda r: (covers[r], -r)) if regions else None
        top = covers[best] if regions else 0
        owner[k], vague[k] = (best if top >= 0.5 else None), 0.2 <= top < 0.5
        if owner[k] is not None:
            members[best].append(k)
    norm = A.match_text
    for r, (_, text, box) in enumerate(regions):
        have = norm(" ".join(words[k][1] for k in members[r]))
        near = [k for k, w in enumerate(words) if min(size(lines[w[0]][1]), size(box)) > 0 and common(lines[w[0]][1], box) >= 0.5 * min(size(lines[w[0]][1]), size(box))]
        if not norm(text) or have == norm(text) or not near:
            continue
        joined = " ".join(norm(words[k][1]) for k in near)
        cost, start, end = X.substring_distance(norm(text), joined)
        at, chosen = 0, []
        for k in near:
            n = len(norm(words[k][1]))
            if min(at + n, end) - max(at, start) >= n / 2:
                chosen.append(k)
            at += n + 1
        old = X.edit_distance(norm(text), have) / len(norm(text)) if members[r] else 1.0
        if chosen and all(owner[k] in (None, r) for k in chosen) and cost / len(norm(text)) < min(old, 0.34):
            for k in {*members[r], *chosen}:
                owner[k], vague[k] = (r if k in chosen else None), False
            members[r] = chosen
    for r, (_, text, box) in enumerate(regions):
        if not members[r]:
            able = [k for k, w in enumerate(words) if owner[k] is None and len(w[1]) <= 2 * len(text.replace(" ", "")) + 2 and size(box) > 0 and common(w[2], box) / size(box) >= 0.5]
            if able:
                k = max(able, key=lambda k: (common(words[k][2], box) / size(box), k))
                owner[k], vague[k], members[r] = r, False, [k]
    tags = {k: "IGNORE" if vague[k] else "O" for k in range(len(words))}
    for r, (label, _, _) in enumerate(regions):
        texts = [words[k][1] for k in members[r]]
        skip = 0
        for n, t in enumerate(texts[:3] if label in A.CAPTIONED else [], 1):
            if any(c.isdigit() for c in t):
                break
            if t.endswith(":"):
                skip = n if n < len(texts) else 0
                break
        for n, k in enumerate(members[r]):
            tags[k] = "O" if n < skip else ("B-" if n == skip else "I-") + label
            owner[k] = None if n < skip else r
    last = None
    for k in range(len(words)):
        if tags[k].startswith("I-") and last != owner[k]:
            tags[k] = "B-" + tags[k][2:]
        if tags[k] != "IGNORE":
            last = owner[k] if tags[k][:2] in ("B-", "I-") else None
    return [(words[k][1], tags[k], owner[k] if tags[k][:2] in ("B-", "I-") else None) for k in range(len(words))]


def random_page(rng):
    vocabulary = ["ĐC:", "Lê", "Lợi", "sữa", "chua", "12", "50.000", "Ngày:", "15/08/2020", "đam", "VAT10%", "1", "10", "Tổng", "x"]
    lines, regions = [], []
    for k in range(rng.randint(2, 6)):
        y, x = 40 * k + rng.uniform(-6, 6), rng.uniform(0, 60)
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))
        wide = 9 * len(text)
        lines.append((text, (x, y, x + wide, y + 22)))
        tokens, at = text.split(), 0
        while at < len(tokens) and rng.random() < 0.8:
            n = rng.randint(1, 3)
            part = tokens[at : at + n]
            place = A.word_places(text)
            start = len(A.word_places(" ".join(tokens[:at])))
            stop = len(A.word_places(" ".join(tokens[: at + n])))
            a, b = place[start]["start"], place[min(stop, len(place)) - 1]["end"]
            shift = rng.choice([0, 0, rng.uniform(-30, 30), rng.uniform(-8, 8)])
            spoken = " ".join(part) if rng.random() < 0.7 else " ".join(part).replace("1", "7").lower()
            box = (x + wide * a + shift, y + rng.uniform(-5, 5), x + wide * b + shift + rng.choice([0, -wide * (b - a) * 0.6]), y + 22 + rng.uniform(-5, 5))
            regions.append((rng.choice(["ADDRESS", "TIMESTAMP", "NAME", "QUANTITY"]), spoken, box))
            at += n
    rng.shuffle(regions)
    return lines, regions


def test_alignment_is_the_sequential_one(spark):
    rng = random.Random(11)
    pages = {d: random_page(rng) for d in range(120)}
    got = align(spark, pages)
    want = {d: plain(*p) for d, p in pages.items()}
    assert {d: got.get(d, []) for d in pages} == want
    kinds = {t for w in want.values() for _, t, _ in w}
    assert "IGNORE" in kinds and "O" in kinds and any(k.startswith("I-") for k in kinds)


def align(spark, pages, rotation=0.0, source=False):
    p = spark.createDataFrame([(d, 400, 300, rotation) for d in pages], PAGES)
    lines = spark.createDataFrame([(d, k, t, rows(corners(*b)), 0.9) for d, (ls, _) in pages.items() for k, (t, b) in enumerate(ls)], LINES)
    regions = spark.createDataFrame([(d, k, l, t, rows(corners(*b))) for d, (_, rs) in pages.items() for k, (l, t, b) in enumerate(rs)], REGIONS)
    words, stats = A.align_pages(p, lines, regions, "d", source)
    out = {}
    for r in words.orderBy("d", "word").collect():
        out.setdefault(r["d"], []).append((r["text"], r["tag"], r["region"]))
    align.stats = {(r["d"], r["region"]): r for r in stats.collect()}
    return out


def test_each_box_is_one_entity_and_captions_are_left_out(spark):
    regions = [("ADDRESS", "ĐC: 12 Lê Lợi", (10, 10, 210, 30)), ("NAME", "Sữa chua", (10, 100, 150, 120)), ("QUANTITY", "1", (200, 100, 220, 120)), ("NAME", "đam", (10, 125, 60, 145)), ("TOTAL", "none", (300, 200, 340, 220))]
    lines = [("ĐC: 12 Lê Lợi", (10, 10, 210, 30)), ("Hotline 0909", (10, 50, 200, 70)), ("Sữa chua", (10, 100, 150, 120)), ("1", (200, 100, 220, 120)), ("đam", (10, 125, 60, 145)), (None, (0, 0, 1, 1)), (" ", (0, 0, 1, 1))]
    got = [(t, g) for t, g, _ in align(spark, {1: (lines, regions)})[1]]
    assert got == [("ĐC:", "O"), ("12", "B-ADDRESS"), ("Lê", "I-ADDRESS"), ("Lợi", "I-ADDRESS"), ("Hotline", "O"), ("0909", "O"), ("Sữa", "B-NAME"), ("chua", "I-NAME"), ("1", "B-QUANTITY"), ("đam", "B-NAME")]
    first, last = align.stats[1, 0], align.stats[1, 4]
    assert (first["truth"], first["read"], first["words"], first["cer"]) == ("12 Lê Lợi", "12 Lê Lợi", 3, 0.0) and (last["words"], last["cer"]) == (0, None)


def test_small_regions_take_a_free_word_of_their_length(spark):
    page = ([("10", (85, 100, 122, 120)), ("VAT10%", (80, 200, 130, 220))], [("QUANTITY", "10", (100, 100, 120, 120)), ("QUANTITY", "1", (100, 200, 110, 220))])
    assert [g for _, g, _ in align(spark, {1: page})[1]] == ["B-QUANTITY", "IGNORE"]


def test_lines_of_the_source_frame_are_turned(spark):
    p = spark.createDataFrame([(1, 200, 100, 90.0)], PAGES)
    lines = spark.createDataFrame([(1, 0, "ABC", rows([(60, 20), (60, 80), (40, 80), (40, 20)]), 0.9)], LINES)
    regions = spark.createDataFrame([(1, 0, "SELLER", "ABC", rows(corners(40, 20, 60, 80)))], REGIONS)
    words, _ = A.align_pages(p, lines, regions, "d", True)
    assert [r["tag"] for r in words.collect()] == ["B-SELLER"]


def test_pages_without_lines_or_regions(spark):
    p = spark.createDataFrame([(1, 200, 100, 0.0)], PAGES)
    line = spark.createDataFrame([(1, 0, "a b", rows(corners(0, 0, 20, 10)), 0.9)], LINES)
    region = spark.createDataFrame([(1, 0, "X", None, rows(corners(0, 0, 9, 10)))], REGIONS)
    words, stats = A.align_pages(p, line, region.limit(0), "d")
    assert [(r["tag"], r["region"]) for r in words.orderBy("word").collect()] == [("O", None)] * 2 and stats.count() == 0
    words, stats = A.align_pages(p, line.limit(0), region, "d")
    assert words.count() == 0 and [r["words"] for r in stats.collect()] == [0]
    words, _ = A.align_pages(p, line, region, "d")
    assert [r["tag"] for r in words.orderBy("word").collect()] == ["B-X", "O"]
