"""JSON trees against recursion, near-image candidates against all pairs."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import linkage, near_images, trees


def random_tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice([None, True, False, 0, -3, 2.5, "", "text", "a/b~c"])
    if kind < 0.7:
        return {k: random_tree(rng, depth - 1) for k in rng.sample(["a", "b", "a/b", "~", "0", "rec_texts", ""], rng.randint(0, 4))}
    return [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]


def walk(tree, path="", name=None):
    kind = "object" if isinstance(tree, dict) else "array" if isinstance(tree, list) else "null" if tree is None else "boolean" if isinstance(tree, bool) else "string" if isinstance(tree, str) else "number"
    yield path, name, kind, tree
    steps = tree.items() if kind == "object" else enumerate(tree) if kind == "array" else ()
    for k, v in steps:
        yield from walk(v, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}", str(k))


def opened(spark, texts):
    return trees.nodes(spark.createDataFrame(list(enumerate(texts)), "d int, text string").select("d", F.try_parse_json("text").alias("tree")), ["d"], "tree")


def test_nodes_of_trees_of_any_depth(spark):
    rng = random.Random(2)
    docs = [random_tree(rng, 5) for _ in range(60)]
    deep = {"end": [1]}
    for k in range(14):
        deep = {"in": deep} if k % 2 else [deep]
    docs.append(deep)
    got = Counter((r["d"], r["path"], r["name"], r["kind"], None if r["value"] is None else json.dumps(json.loads(r["value"]))) for r in opened(spark, [json.dumps(d) for d in docs] + [None, "{not json"]).collect())
    want = Counter((d, p, n, k, None if k in ("object", "array") else json.dumps(v)) for d, t in enumerate(docs) for p, n, k, v in walk(t))
    assert got == want


def test_members_and_holders_of_a_key(spark):
    docs = [{"rec_texts": ["a", {"rec_texts": [1, [2]]}], "x": [{"rec_texts": "no"}, {"rec_texts": []}]}, [[["rec_texts"]]]]
    found = opened(spark, [json.dumps(d) for d in docs])
    got = [(r["parent"], r["position"], r["kind"], r["value"]) for r in trees.collect_key(found, ["d"], "rec_texts").orderBy("parent", "position").collect()]
    assert got == [("/rec_texts", 0, "string", '"a"'), ("/rec_texts", 1, "object", None), ("/rec_texts/1/rec_texts", 0, "number", "1"), ("/rec_texts/1/rec_texts", 1, "array", None)]
    assert sorted(r["path"] for r in trees.holders(found, ["d"], "rec_texts").collect()) == ["", "/rec_texts/1", "/x/1"]


def faults(expected, actual, path=""):
    kind = lambda v: next(walk(v))[2]
    if kind(expected) != kind(actual):
        return [(path, "KIND")]
    down = lambda k: f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}"
    if isinstance(expected, dict):
        return [x for k, v in expected.items() for x in (faults(v, actual[k], down(k)) if k in actual else [(down(k), "MISSING")])]
    if isinstance(expected, list):
        pairs = [x for k, (v, w) in enumerate(zip(expected, actual, strict=False)) for x in faults(v, w, down(k))]
        return pairs + [(down(k), "MISSING") for k in range(len(actual), len(expected))] + [(down(k), "EXTRA") for k in range(len(expected), len(actual))]
    return [] if expected == actual else [(path, "VALUE")]


def changed(rng, tree):
    if isinstance(tree, dict):
        out = {k: changed(rng, v) for k, v in tree.items() if rng.random() < 0.9}
        return out | ({"new": 1} if rng.random() < 0.3 else {})
    if isinstance(tree, list):
        return [changed(rng, v) for v in tree if rng.random() < 0.9] + ([0] if rng.random() < 0.2 else [])
    return random_tree(rng, 0) if rng.random() < 0.2 else tree


def test_expected_is_a_part_of_actual(spark):
    rng = random.Random(4)
    expected = [random_tree(rng, 4) for _ in range(80)] + [{"n": 1}, {"n": 1.5}]
    actual = [changed(rng, t) for t in expected[:80]] + [{"n": 1.0}, {"n": "1.5"}]
    e, a = (opened(spark, [json.dumps(t) for t in x]) for x in (expected, actual))
    got = sorted((r["d"], r["path"], r["fault"]) for r in trees.subset_faults(e, a, ["d"]).collect())
    want = sorted((d, *f) for d, (x, y) in enumerate(zip(expected, actual, strict=True)) for f in faults(x, y))
    assert got == want and {f for *_, f in want} == {"KIND", "MISSING", "EXTRA", "VALUE"}


IMAGES = "id long, sha string, width int, height int, dhash long, ahash long"


def test_candidates_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    seeds = [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63, rng.randint(60, 200)) for _ in range(12)]
    flip = lambda v, n: v ^ sum((1 << b if b < 63 else -(1 << 63)) for b in rng.sample(range(64), n))
    rows = []
    for k in range(160):
        d, a, w = rng.choice(seeds)
        rows.append((k, f"s{k}", w + rng.randint(-8, 8), 100, flip(d, rng.randint(0, 4)), flip(a, rng.randint(0, 4))))
    rows += [rows[3], (900, "s3", *rows[3][2:]), (901, None, 100, 100, 1, 1), (902, "x", 0, 100, 1, 1), (903, "y", 100, 100, None, 1)]
    got = {(r["a"], r["b"], r["dhash_bits"], r["ahash_bits"]) for r in near_images.candidate_pairs(spark.createDataFrame(rows, IMAGES)).collect()}
    bits = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    plain = [r for r in rows[:160]]
    shape = lambda r: r[2] / r[3]
    want = {(p[0], q[0], bits(p[4], q[4]), bits(p[5], q[5])) for p in plain for q in plain if p[0] < q[0] and bits(p[4], q[4]) <= 4 and bits(p[5], q[5]) <= 4 and abs(shape(p) - shape(q)) / max(shape(p), shape(q)) <= 0.08}
    assert got == want and len(want) > 20


def test_hashes_of_grids(spark):
    grid = [float((i * 37) % 64) for i in range(64)]
    df = spark.createDataFrame([(grid,)], "g array<double>")
    d, a = df.select(near_images.difference_hash(F.col("g"), 8), near_images.average_hash(F.col("g"))).first()
    want_d = int("".join(str(int(grid[i] > grid[i + 1])) for i in range(63) if i % 8 != 7), 2)
    want_a = int("".join(str(int(v >= sum(grid) / 64)) for v in grid), 2)
    assert d == want_d and a & (2**64 - 1) == want_a


def test_the_last_review_of_a_pair_counts_in_either_order(spark):
    fields = spark.createDataFrame([(1, "c", "d", "t"), (2, "c", "d", "t"), (3, "c", "e", "t"), (4, "x", "d", "t")], "id long, company string, date string, total string")
    pairs = spark.createDataFrame([(1, 2, 0, 1), (1, 3, 0, 0), (1, 4, 0, 0), (2, 4, 0, 0), (2, 3, 9, 9)], "a long, b long, dhash_bits int, phash_bits int")
    reviews = spark.createDataFrame([(4, 2, "FIRST", 1), (2, 4, "SECOND", 2), (None, 2, "X", 1)], "a long, b long, review_status string, position int")
    got = {(r["a"], r["b"]): (r["status"], r["by_review"]) for r in near_images.reviewed_status(pairs, reviews, fields).collect()}
    assert got == {(1, 2): (near_images.CONFIRMED_FIELDS, False), (1, 3): (near_images.DISTINCT_EITHER, False), (1, 4): (near_images.REVIEW, False), (2, 4): ("SECOND", True), (2, 3): (near_images.DISTINCT_EITHER, False)}


def test_simhash_is_the_majority_of_bits(spark):
    import hashlib

    texts = ["one two two three", "", None, "x", "a b c d e f g\nh  i"]
    got = {r["id"]: r["fp"] for r in linkage.simhash60(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", "fp").collect()}
    for k, t in enumerate(texts):
        words = set((t or "").replace("\n", " ").split(" ")) - {""}
        h = [int(hashlib.sha256(w.encode()).hexdigest()[:15], 16) for w in words]
        assert got[k] == sum(1 << b for b in range(60) if sum(x >> b & 1 for x in h) * 2 > len(h))
