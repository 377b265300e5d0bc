"""Pages settled some thousands at a time: the same as one by one, with one shuffle and nothing joined."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import polygons as P
from quillspark.operators import alignment as A
from quillspark.plans import pages
from quillspark.plans.bindings import table


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def three_tables(spark, data):
    """Pages, lines and regions of :func:`pages.page_rows`, each as a table of its own."""
    corners, share = pages._corners, lambda a, b: pages._corners(20 + 380 * a, y, 20 + 380 * b, y + 20)
    rows = lambda names, *each: F.inline(F.array(*(F.struct(*((v if not isinstance(v, int | str) else F.lit(v)).alias(n) for n, v in zip(names.split(), row, strict=True))) for row in each)))
    items = pages._lines(spark, data).join(table(spark, data, "part").select(F.col("p_partkey").alias("part"), "p_name"), "part")
    orders = table(spark, data, "orders").select(F.col("o_orderkey").alias("d"), "o_custkey", "o_orderdate")
    rotation = (F.col("d") % 4 * 90).cast("double")
    sizes = orders.select("d", F.when(F.col("d") % 2 == 0, 600).otherwise(400).alias("width"), F.when(F.col("d") % 2 == 0, 400).otherwise(600).alias("height"), rotation.alias("rotation"))
    address, date = F.concat(F.lit("ĐC: "), F.col("o_custkey").cast("string"), F.lit(" Đường Dài")), F.concat(F.lit("Ngày bán: "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    heads = orders.select("d", rows("line text polygon", [0, address, corners(20, 10, 320, 32)], [1, F.concat(date, F.lit(" Thu ngân")), corners(20, 40, 380, 60)]))
    quantity, price = F.col("quantity").cast("int").cast("string"), F.format_string("%,.0f", "price")
    y, shift, wide = 70 + 25 * F.col("k"), (F.col("part") % 5 - 2) * 12, F.when(F.col("part") % 3 == 0, 420).otherwise(380)
    whole = F.concat_ws(" ", "p_name", quantity, price)
    lines = items.select("d", (F.col("k") + 10).cast("int").alias("line"), whole.alias("text"), corners(20 + shift, y, 20 + shift + wide, y + 20).cast(P.POLYGON).alias("polygon"))
    n = F.char_length(whole)
    at, end = F.char_length("p_name") / n, (F.char_length("p_name") + F.char_length(quantity) + 1) / n
    nth = lambda i: (3 * F.col("k") + 10 + i).cast("int")
    of_orders = orders.select("d", rows("region label text polygon", [0, "ADDRESS", address, corners(18, 9, 322, 33)], [1, "TIMESTAMP", date, corners(20, 40, 280, 60)]))
    of_items = items.select("d", rows("region label text polygon", [nth(0), "NAME", F.col("p_name"), share(F.lit(0.0), at)], [nth(1), "QUANTITY", quantity, share(at, end)], [nth(2), "PRICE", price, share(end, F.lit(1.0))]))
    back = P.upright(F.col("polygon").cast(P.POLYGON), F.lit(600), F.lit(400), F.pmod(360 - rotation, F.lit(360.0)))
    return sizes, heads.withColumn("polygon", F.col("polygon").cast(P.POLYGON)).unionByName(lines), of_orders.unionByName(of_items).withColumn("polygon", back)


def test_words_are_those_of_pages_lines_and_regions(spark, data):
    words, _ = A.align_pages(*three_tables(spark, data), "d")
    want = words.select("d", "word", "text", F.array_join("box", ",").alias("box"), "tag", "region")
    got = pages.page_alignment(spark, data)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_pages_are_dealt_once_and_nothing_is_joined(spark):
    p = spark.createDataFrame([], "d long, width int, height int, rotation double")
    lines = spark.createDataFrame([], f"d long, line int, text string, polygon {P.POLYGON}")
    regions = spark.createDataFrame([], f"d long, region int, label string, text string, polygon {P.POLYGON}")
    for df in A.align_pages(p, lines, regions, "d"):
        assert "Join" not in plan(df) and "FileScan" not in plan(df) and plan(df).count("Exchange ") <= 1


def test_lines_split_together_are_those_split_alone():
    rng = random.Random(5)
    texts = ["", " ", "Ngày:15/08 10:41  x", "a:b:c", "1:2", ":x", "é:é", "_:_", " a b", "x" * 300 + ":y z"]
    texts += ["".join(rng.choice("aĐm1:_ .\t́\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["ab: c:d " * 60]
    line, found, start, end = A.words_of_lines(texts)
    got = [[] for _ in texts]
    for i, *w in zip(line.tolist(), found, start.tolist(), end.tolist(), strict=True):
        got[i].append(dict(zip(("text", "start", "end"), w, strict=True)))
    assert got == [A.word_places(t) for t in texts]


def test_boxes_that_touch_are_found_on_dense_pages_and_others(monkeypatch):
    rng = np.random.default_rng(2)

    def boxes(n):
        at = rng.uniform(0, 100, (n, 2))
        out = np.concatenate([at, at + rng.uniform(0, 30, (n, 2))], 1)
        out[rng.random(n) < 0.1] = np.nan
        return out

    a, b = boxes(90), boxes(70)
    docs, others = np.sort(rng.integers(0, 6, 90)), np.sort(rng.integers(0, 6, 70))
    want = {(i, j) for i in range(90) for j in range(70) if docs[i] == others[j] and P.touch(a[i : i + 1], b[j : j + 1])[0]}
    for dense in (0, 5, 1000):
        monkeypatch.setattr(P, "DENSE", dense)
        for most in (1, 50, 1 << 20):
            got = list(zip(*(x.tolist() for x in P.touching(docs, a, others, b, most)), strict=True))
            assert set(got) == want and len(got) == len(want) > 40


def test_records_of_a_page_stay_together(monkeypatch):
    docs = [d for d, n in enumerate((3, 1, 40, 2, 2, 9, 1)) for _ in range(n)]
    for size in (1, 4, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"d": docs[k : k + size]}) for k in range(0, len(docs), size)]
        for least in (1, 5, 1000):
            monkeypatch.setattr(A, "RECORDS", least)
            found = [t.column(0).to_pylist() for t in A.whole_pages(iter([*batches, batches[0][:0]]))]
            assert [d for t in found for d in t] == docs
            assert all(a[-1] != b[0] for a, b in zip(found, found[1:], strict=False))
            assert len(found) == 1 if least == 1000 else len(found) > 1 or size == 100


def test_an_exact_part_needs_no_table_of_edits(monkeypatch):
    monkeypatch.setattr(A.X, "edit_distance", None)
    assert A.spelling_words("b C", ["a"], *A.joined_words(["a", "B", "c"])) == [1, 2]
    assert A.spelling_words("a b", ["a", "b"], *A.joined_words(["a", "b"])) is None and A.spelling_words("zzz", ["a"], *A.joined_words(["a"])) is None


def test_odd_records(spark):
    quad = [{"x": 0.0, "y": 0.0}, {"x": 20.0, "y": 0.0}, {"x": 20.0, "y": 10.0}, {"x": 0.0, "y": 10.0}]
    p = spark.createDataFrame([("a", 200, 100, 0.0), (None, 200, 100, 0.0)], "d string, width int, height int, rotation double")
    lines = spark.createDataFrame([("a", 5, "x y", quad), ("a", 6, "z", None), ("a", None, "no", quad), ("b", 1, "no page", quad), (None, 1, "w", quad)], f"d string, line long, text string, polygon {P.POLYGON}")
    regions = spark.createDataFrame([("a", "r", None, "x y", quad), ("a", "s", "L", None, []), ("b", "t", "L", "no page", quad)], f"d string, region string, label string, text string, polygon {P.POLYGON}")
    words, stats = A.align_pages(p, lines, regions, "d")
    assert sorted((r["line"], r["text"], r["tag"], r["region"]) for r in words.collect()) == [(5, "x", None, "r"), (5, "y", None, "r"), (6, "z", "IGNORE", None)]
    assert sorted((r["region"], r["read"], r["words"], r["cer"]) for r in stats.collect()) == [("r", "x y", 2, 0.0), ("s", "", 0, None)]


def test_readings_are_those_of_pages_lines_and_regions(spark, data):
    _, stats = A.align_pages(*three_tables(spark, data), "d")
    want = stats.withColumn("cer", F.round("cer", 6))
    got = pages.region_readings(spark, data)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_error_rates_are_of_composed_texts_and_go_to_python_once(spark):
    corners = lambda x: [{"x": a, "y": b} for a, b in ((x, 0.0), (x + 20, 0.0), (x + 20, 10.0), (x, 10.0))]
    texts = [("Đà́  Na", "đà́ Na"), ("a\tb", "a b"), ("abcd", "abXd"), (" ", "q"), ("SỮA", "sữa")]
    p = spark.createDataFrame([(1, 400, 100, 0.0)], "d long, width int, height int, rotation double")
    lines = spark.createDataFrame([(1, k, t, corners(30.0 * k)) for k, (_, t) in enumerate(texts)], f"d long, line int, text string, polygon {P.POLYGON}")
    regions = spark.createDataFrame([(1, k, "NAME", t, corners(30.0 * k)) for k, (t, _) in enumerate(texts)], f"d long, region int, label string, text string, polygon {P.POLYGON}")
    _, stats = A.align_pages(p, lines, regions, "d")
    assert plan(stats).count("Python") + plan(stats).count("MapInArrow") == 1
    rows = stats.orderBy("region").collect()
    assert [(r["truth"], r["read"], r["words"], r["cer"]) for r in rows] == [("Đà́ Na", "đà́ Na", 2, 0.0), ("a b", "a b", 2, 0.0), ("abcd", "abXd", 1, 0.25), ("", "q", 1, None), ("SỮA", "sữa", 1, 0.0)]
