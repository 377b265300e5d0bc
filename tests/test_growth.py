"""What fails only on larger tables: sums beyond 64 bits, tables too large to broadcast, loops that grow with their own files."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import fields
from quillspark.functions import polygons as P
from quillspark.operators import alignment, annotations, contracts, lineitems, linkage, scores, trees
from quillspark.plans import receipts
from quillspark.sources import records, versions
from quillspark.streaming import requests


def plan(df):
    return df._jdf.queryExecution().toString()


def test_digests_go_on_beyond_64_bits(spark):
    df = spark.range(70_000).select(F.col("id").alias("k"), (F.col("id") % 100 == 0).alias("flag"))
    hashes = {True: [], False: []}
    for k in range(70_000):
        hashes[k % 100 == 0].append(int(hashlib.sha256(f'{{"flag":{str(k % 100 == 0).lower()},"k":{k}}}'.encode()).hexdigest()[:12], 16))
    want = {f: (len(h), (sum(h) + (1 << 63)) % (1 << 64) - (1 << 63)) for f, h in hashes.items()}
    assert sum(hashes[False]) >= 1 << 63 and sum(hashes[True]) == want[True][1]
    assert {r[0]: (r[1], r[2]) for r in records.lines_digest(df, "flag").collect()} == want


def test_keys_of_prints_are_never_broadcast(spark):
    prints = spark.range(100).select("id", F.xxhash64("id").bitwiseAND((1 << 60) - 1).alias("fp"))
    assert "BroadcastHashJoin" not in plan(linkage.hamming_pairs(prints, "id", "fp", 4))


def test_nodes_are_never_broadcast(spark):
    texts = spark.createDataFrame([(1, '{"a": [1, {"b": 2}]}'), (2, '{"a": [1]}')], "d long, t string").select("d", F.try_parse_json("t").alias("tree"))
    found = trees.nodes(texts, ["d"], "tree")
    for df in (trees.subset_faults(found, found.where("path <> '/a/1/b'"), ["d"]), trees.collect_key(found, ["d"], "a"), trees.holders(found, ["d"], "a")):
        assert "BroadcastHashJoin" not in plan(df)
        assert df.count()


def test_a_batch_sends_as_many_retry_files_as_a_batch_reads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("".join(f'{{"id": "{k}", "url": "u"}}\n' for k in range(200)))
    seen = []

    def write(df, out, kind, number):
        requests.write_batch(df, out, kind, number)
        seen.append((kind, number, sum(f.suffix == ".txt" for f in (tmp_path / "out" / kind / f"batch={number}").iterdir())))

    failing = lambda df: df.withColumns({"body": F.col("url"), "failure": F.lit("TRANSIENT_DOWNLOAD")})
    results, _ = requests.run_requests(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), failing, 1, write=write)
    assert results.count() == 200 and results.where("attempts = 3").count() == 200
    assert all(files <= 1 for kind, _, files in seen if kind == "retry") and len({n for _, n, _ in seen}) <= 9


def test_a_digest_of_two_levels_joins_all_leaves(spark, monkeypatch):
    monkeypatch.setattr(versions, "LEAF", 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    hashes = [sha(x) for x in sorted(f'{{"k":{k}}}' for k in range(50))]
    leaves = [sha("".join(hashes[i : i + 3])) for i in range(0, 50, 3)]
    df = spark.range(50).select(F.col("id").alias("k"))
    assert tuple(versions.tree_digest(df, levels=2).first()) == (50, sha("".join(leaves)))
    assert tuple(versions.tree_digest(df.where("k < 3"), levels=2).first()) == (3, sha("".join(sha(f'{{"k":{k}}}') for k in range(3))))


def test_meeting_makes_cells_for_large_documents_only(spark, monkeypatch):
    square = lambda k: F.array(*(F.struct((k + x).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (9, 0), (9, 9), (0, 9))))
    size = {"width": F.lit(100), "height": F.lit(100)}
    at = F.col("id") % 20 * 5
    left = spark.range(60).select((F.col("id") % 3).alias("d"), F.col("id").alias("a"), square(at).alias("p")).where("d > 0 or a < 15").withColumns(size)
    right = left.select("d", F.col("a").alias("b"), F.col("p").alias("q")).withColumns(size)
    found = lambda: P.meeting(left, right, "d", "p", "q")
    pairs = lambda df: sorted(tuple(r) for r in df.select("d", "a", "b").collect())
    plain = found()
    assert "Generate explode" not in plan(plain) and "BroadcastHashJoin" not in plan(plain)
    for bound in (0, 10, 1000):
        monkeypatch.setattr(P, "DENSE", bound)
        assert pairs(found()) == pairs(plain) and len(pairs(plain)) == len(set(pairs(plain))) > 0


def test_slots_are_never_broadcast(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "d long, field string, status string")
    df = contracts.with_all_fields(rows, "d", "field", ["a", "b"], "status")
    assert "BroadcastHashJoin" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [(1, "a", "x"), (1, "b", "unlabeled"), (2, "a", "unlabeled"), (2, "b", "y")]


def test_lines_are_split_once(spark):
    line = "array(named_struct('x', 0d, 'y', 0d), named_struct('x', 9d, 'y', 0d), named_struct('x', 9d, 'y', 2d), named_struct('x', 0d, 'y', 2d)) AS polygon"
    lines = spark.range(4).selectExpr("id AS d", "0 AS line", "'a bc' AS text", line)
    split = alignment.split_lines(lines, "d").where(F.size("words") > 1)
    assert plan(split).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("ArrowEvalPython") == 1
    assert [[w["text"] for w in r["words"]] for r in split.collect()] == [["a", "bc"]] * 4


def test_rectangles_of_a_batch_are_those_of_single_polygons():
    box = [(0.1, 0.2), (7.3, 0.2), (7.3, 5.7), (0.1, 5.7)]
    some = [box, [box[2], box[0], box[3], box[1]], [box[0], box[1], box[2], box[0]], box[:3], [*box, box[0]], [(0.1, 0.2), (7.3, 0.3), (7.3, 5.7), (0.1, 5.7)], [(0.0, 0.0), (float("inf"), 0.0), (float("inf"), 1.0), (0.0, 1.0)], []]
    xs, ys = (pa.array([[p[i] for p in ps] for ps in some] + [None], pa.list_(pa.float64())) for i in (0, 1))
    sides, found = P.rectangles(xs, ys)
    assert found.tolist() == [True, True] + [False] * 7
    assert [tuple(s) for s in sides[:2]] == [P.rectangle(p) for p in some[:2]]
    assert P.rectangle_areas(sides)[:2].tolist() == [P.shoelace(P.hull(p)) for p in some[:2]]


def test_offsets_of_names_that_cost_more_are_left_early(monkeypatch):
    seen, whole = [], lineitems.name_owners

    def counted(places, anchors, extra, most=float("inf")):
        seen.append((whole(places, anchors, extra), whole(places, anchors, extra, most), most))
        return seen[-1][1]

    monkeypatch.setattr(lineitems, "name_owners", counted)
    entities = [(n, "Part", x, 20.0 * k + k % 3, x + 60, 20.0 * k + k % 3 + 12) for k in range(6) for n, x in (("LINE_TOTAL", 400.0), ("ITEM_NAME", 100.0))]
    assert lineitems.anchored_items(entities) == [[2 * k, 2 * k + 1] for k in range(6)]
    assert any(got[0] == float("inf") for _, got, _ in seen)
    for full, got, most in seen:
        assert got == full if full[0] <= most else got == full or got[0] == float("inf")


def test_polygons_of_rows_are_read_once(spark):
    polygon = "[{'category_id': 15, 'segmentation': [[0, 0, 9, 0, 9, 8, 0, 8]], 'area': 1, 'bbox': [0, 0, 1, 1], 'width': 9, 'height': 9}]"
    rows = spark.createDataFrame([("a", polygon, "shop", "SELLER", "1", ""), ("b", "{}", "shop", "SELLER", "1", "")], "img_id string, anno_polygons string, anno_texts string, anno_labels string, anno_num string, anno_line_item_ids string")
    images = rows.selectExpr("img_id", "9 AS width", "9 AS height")
    regions, fields, refused = annotations.convert_rows(rows, images)
    decoded, not_read = annotations.decode_rows(rows)
    assert [df.count() for df in (regions, fields, refused, decoded, not_read)] == [1, 4, 1, 1, 1]
    assert all("ArrowEvalPython" not in plan(df) for df in (regions, fields, refused, decoded, not_read))


def test_plain_numbers_are_read_without_the_rules_and_lines_dealt_once(spark, data):
    some = ["17", "560,00", "12.50", "25.000", "1.234.567", "1,234,567.8", "1.234,00", "0.00", "1,234,56", "9" * 40, "0123", "1,23,4"]
    texts = spark.createDataFrame([(x, f" {x} ") for x in some], "plain string, spaced string")
    for locale in ("vi-VN", None):
        read = lambda c: fields.amount_field(F.col(c), F.lit(locale))  # noqa: B023, E731
        assert all(r[0] == r[1] for r in texts.select(read("plain"), read("spaced")).collect())
    assert all(r[0] == r[1] for r in texts.select(fields.quantity_field(F.col("plain")), fields.quantity_field(F.col("spaced"))).collect())
    assert fields.PLAIN_AMOUNT in plan(texts.select(fields.amount_field(F.col("plain"), F.lit("vi-VN"))))
    physical = plan(receipts.QUERIES["postprocess_items"](spark, data)).split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning") == 1


def test_items_are_matched_by_the_batch_without_joins(spark):
    schema = "d long, item int, name string, price double"
    some = lambda s: [(d if d else None, 3 * k % 7, "abc"[(d + k * s) % 3], (None, 1.0, 0.0, -0.0, float("nan"))[(d * s + k) % 5]) for d in range(60) for k in range((d * s + d) % 6 if d != 9 else 40)]
    gold, pred = some(1), some(2)
    want = Counter()
    rank = lambda r: (r[1], r[2], r[3] is not None, r[3] if r[3] is not None and r[3] == r[3] else float("inf") if r[3] is not None else 0.0)
    for d in {r[0] for r in gold + pred}:
        left, free = (sorted((r for r in rows if r[0] == d), key=rank) for rows in (gold, pred))
        for a in left:
            same = [sum(x == y and x is not None for x, y in zip(a[2:], b[2:], strict=True)) for b in free]
            best = max(range(len(free)), key=same.__getitem__, default=None)
            b = free.pop(best) if best is not None and same[best] else None
            want[d, a[1], b and b[1], same[best] if b else 0] += 1
        want.update((d, None, b[1], 0) for b in free)
    g, p = spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert Counter(tuple(r) for r in lineitems.greedy_match(g, p, "d", "item", ["name", "price"]).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    twice = spark.createDataFrame([(1, 1, "a", 2.0), (1, 1, "b", 3.0)], schema)
    cells = scores.matched_cells(twice, twice, "d", "item", ["name", "price"])
    assert "Join" not in plan(cells) and Counter(r["outcome"] for r in cells.collect()) == {"equal": 4}


def test_leaves_of_trees_are_written_as_texts(spark, monkeypatch):
    written, real = [], trees.materialize
    monkeypatch.setattr(trees, "materialize", lambda df, name: written.append(real(df, name)) or written[-1])
    texts = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}, null, true], "c": {}}'), (2, "2.5")], "d long, t string").select("d", F.try_parse_json("t").alias("tree"))
    found = {(r["d"], r["path"]): (r["kind"], r["value"]) for r in trees.nodes(texts, ["d"], "tree").collect()}
    assert found == {
        (1, ""): ("object", None), (1, "/a"): ("array", None), (1, "/a/0"): ("number", "1"), (1, "/a/1"): ("object", None), (1, "/a/1/b"): ("string", '"x"'),
        (1, "/a/2"): ("null", "null"), (1, "/a/3"): ("boolean", "true"), (1, "/c"): ("object", None), (2, ""): ("number", "2.5")}
    assert len(written) == 4 and all(df.where("kind not in ('object', 'array') and v is not null").isEmpty() for df in written)
