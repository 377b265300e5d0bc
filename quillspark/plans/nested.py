"""Queries over JSON trees of any depth, and over near-duplicate images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import near_images, trees
from ..storage import materialize
from .bindings import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_LINES = """
lines AS (SELECT l_orderkey AS d, l_linenumber AS k, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY d) AS n FROM lines)"""


def _orders(spark, sf_dir):
    """``d`` and an array ``lines`` of ``k, q`` for every order that has lines."""
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("k")).agg(F.min("l_quantity").cast("long").alias("q"))
    return lines.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("k", "q"))).alias("lines"))


@query(f"""
WITH {_LINES}, orders_ AS (SELECT DISTINCT d, n FROM placed)
SELECT d, '' AS path, 'object' AS kind, NULL AS value FROM orders_
UNION ALL SELECT d, '/a~1b', 'object', NULL FROM orders_
UNION ALL SELECT d, '/a~1b/lines', 'array', NULL FROM orders_
UNION ALL SELECT d, '/a~1b/name', 'string', '"o' || d || '"' FROM orders_
UNION ALL SELECT d, '/a~1b/none', 'null', 'null' FROM orders_ WHERE d % 2 = 0
UNION ALL SELECT d, '/a~1b/lines/' || i, 'object', NULL FROM placed
UNION ALL SELECT d, '/a~1b/lines/' || i || '/k', 'number', CAST(k AS VARCHAR) FROM placed
UNION ALL SELECT d, '/a~1b/lines/' || i || '/big', 'boolean', CAST(q > 25 AS VARCHAR) FROM placed
""")
def json_nodes(spark, sf_dir):
    """Orders as JSON text, opened again node by node."""
    line = F.transform("lines", lambda x: F.struct(x["k"].alias("k"), (x["q"] > 25).alias("big")))
    name = F.concat(F.lit("o"), F.col("d").cast("string"))
    whole = F.concat(F.lit('{"a/b":{"lines":'), F.to_json(line), F.lit(',"name":"'), name, F.when(F.col("d") % 2 == 0, '","none":null}}').otherwise('"}}'))
    texts = _orders(spark, sf_dir).select("d", F.try_parse_json(whole).alias("tree"))
    return trees.nodes(texts, ["d"], "tree").select("d", "path", "kind", "value")


@query(f"""
WITH {_LINES},
faults AS (
  SELECT d, '/lines/' || i AS path, 'MISSING' AS fault FROM placed WHERE d % 4 = 1 AND i = n - 1
  UNION ALL SELECT d, '/lines/' || i || '/q', 'VALUE' FROM placed WHERE d % 4 = 2 AND q % 2 = 1
  UNION ALL SELECT d, '/lines/' || n, 'EXTRA' FROM placed WHERE d % 4 = 3 AND i = 0
  UNION ALL SELECT DISTINCT d, '/id', 'KIND' FROM placed WHERE d % 5 = 0)
SELECT d, path, fault FROM faults
""")
def json_subset(spark, sf_dir):
    """Expected trees against changed ones: a line gone, a quantity rounded to even, a line more, a number as text; additions to objects are no fault."""
    o, m = _orders(spark, sf_dir), F.col("d") % 4
    expected = F.to_json(F.struct(F.col("d").alias("id"), "lines"))
    even = F.transform("lines", lambda x: F.struct(x["k"].alias("k"), (x["q"] - x["q"] % 2).alias("q"), F.lit("more").alias("note")))
    kept = F.transform("lines", lambda x: F.struct(x["k"].alias("k"), x["q"].alias("q"), F.lit("more").alias("note")))
    extra = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("q"), F.lit("extra").alias("note")))
    lines = F.when(m == 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).when(m == 2, even).when(m == 3, F.concat(kept, extra)).otherwise(kept)
    number, text = F.to_json(F.struct(F.col("d").alias("id"), lines.alias("lines"))), F.to_json(F.struct(F.col("d").cast("string").alias("id"), lines.alias("lines")))
    both = materialize(o.select("d", expected.alias("e"), F.when(F.col("d") % 5 == 0, text).otherwise(number).alias("a")), "tree-texts")
    opened = [trees.nodes(both.select("d", F.try_parse_json(c).alias("tree")), ["d"], "tree") for c in ("e", "a")]
    return trees.subset_faults(*opened, ["d"])


@query(f"""
WITH {_LINES}
SELECT d, '/page/' || (i % 2) || '/rec_texts' AS parent, CAST(row_number() OVER (PARTITION BY d, i % 2 ORDER BY i) - 1 AS INTEGER) AS position, '"t' || q || '"' AS value FROM placed
""")
def json_collect_key(spark, sf_dir):
    """Members of every list under one key, wherever it stands in the tree."""
    o = _orders(spark, sf_dir)
    half = lambda r: F.transform(F.filter("lines", lambda x, i: i % 2 == r), lambda x: F.concat(F.lit("t"), x["q"].cast("string")))
    page = F.array(*(F.struct(half(r).alias("rec_texts"), F.lit(r).alias("n")) for r in (0, 1)))
    tree = F.try_parse_json(F.to_json(F.struct(page.alias("page"), F.lit("x").alias("rec_text"))))
    found = trees.nodes(o.select("d", tree.alias("tree")), ["d"], "tree")
    return trees.collect_key(found, ["d"], "rec_texts").select("d", "parent", "position", "value")


_IMAGES = """
vectors AS (SELECT vec_id, unnest(range(0, 2)) AS copy, list_transform(embedding, lambda x: (CAST(x AS DOUBLE) + 1) / 2) AS v FROM embeddings),
images AS (
  SELECT vec_id + 1000000 * copy AS id, 100 + vec_id % 7 * 5 + copy * (vec_id % 3) AS width, 100 AS height, vec_id % (2 + copy) AS date, vec_id % (3 + copy) AS total,
    list_transform(range(1, 65), lambda i: v[i] + 0.004 * copy * ((i * 7 + vec_id) % (1 + vec_id % 5) - 1)) AS grid FROM vectors),
hashed AS (
  SELECT *, list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0), lambda i: grid[i] > grid[i + 1]) AS dh,
    list_transform(grid, lambda x: x >= list_reduce(grid, lambda a, b: a + b) / 64) AS ah FROM images),
near AS (
  SELECT a.id AS a, b.id AS b, a.grid AS ga, b.grid AS gb, a.date <> b.date AND a.total <> b.total AS differ,
    abs(a.width / a.height - b.width / b.height) / greatest(a.width / a.height, b.width / b.height) AS aspect,
    list_sum(list_transform(range(1, 57), lambda i: CAST(a.dh[i] <> b.dh[i] AS INTEGER))) AS d, list_sum(list_transform(range(1, 65), lambda i: CAST(a.ah[i] <> b.ah[i] AS INTEGER))) AS h
  FROM hashed a JOIN hashed b ON a.id < b.id AND a.grid <> b.grid),
close AS (
  SELECT *, sqrt(list_reduce(list_transform(range(1, 65), lambda i: (ga[i] - gb[i]) * (ga[i] - gb[i])), lambda x, y: x + y) / 64) AS rms
  FROM near WHERE aspect <= 0.08 AND d <= 4 AND h <= 4)
"""


def _images(spark, sf_dir):
    """Embeddings as grey grids of eight by eight, each with a slightly changed copy."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("copy"), F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("v"))
    i, c = F.col("vec_id"), F.col("copy")
    grid = F.transform("v", lambda x, k: x + F.lit(0.004) * c * (((k + 1) * 7 + i) % (1 + i % 5) - 1))
    out = v.select((i + 1000000 * c).alias("id"), (100 + i % 7 * 5 + c * (i % 3)).alias("width"), F.lit(100).alias("height"), (i % (2 + c)).alias("date"), (i % (3 + c)).alias("total"), grid.alias("grid"))
    sha = F.sha2(F.array_join(F.transform("grid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    return materialize(out.withColumns({"sha": sha, "dhash": near_images.difference_hash(F.col("grid"), 8), "ahash": near_images.average_hash(F.col("grid"))}), "images")


@query(f"""
WITH {_IMAGES}
SELECT a, b, CAST(d AS INTEGER) AS dhash_bits, CAST(h AS INTEGER) AS ahash_bits, round(aspect, 6) AS aspect_difference, round(rms, 6) AS rms,
  CASE WHEN d <= 1 AND h <= 1 AND aspect <= 0.01 AND rms <= 0.01 THEN 'CONFIRMED_STRONG_NEAR_DUPLICATE'
    WHEN differ AND rms > 0.03 THEN 'DISTINCT_RECEIPTS_DIFFERENT_DATE_AND_TOTAL' ELSE 'CANDIDATE_REQUIRES_REVIEW' END AS status
FROM close
""")
def near_image_cascade(spark, sf_dir):
    """Near-duplicate images by shape and two hashes, then by the difference of their grids."""
    images = _images(spark, sf_dir)
    found = near_images.cascade(images, images.select("id", "grid"), images.select("id", "date", "total"))
    return found.withColumns({"aspect_difference": F.round("aspect_difference", 6), "rms": F.round("rms", 6)})


@query("""
WITH pairs AS (SELECT vec_id AS a, vec_id + 1 AS b, vec_id % 3 AS d, vec_id % 2 AS h FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)),
fields AS (SELECT vec_id AS id, vec_id // 2 % 5 AS company, vec_id // 4 AS date, vec_id // 2 % 3 AS total FROM embeddings)
SELECT a, b, CASE WHEN a % 10 = 0 THEN 'REVIEWED_SECOND' WHEN d <= 1 AND h <= 1 AND x.company = y.company AND x.date = y.date AND x.total = y.total
    THEN 'CONFIRMED_STRONG_NEAR_DUPLICATE_MATCHING_COMPANY_DATE_TOTAL'
  WHEN x.date <> y.date OR x.total <> y.total THEN 'DISTINCT_RECEIPTS_DIFFERENT_DATE_OR_TOTAL' ELSE 'CANDIDATE_REQUIRES_REVIEW' END AS status, a % 10 = 0 AS by_review
FROM pairs JOIN fields x ON x.id = a JOIN fields y ON y.id = b
""")
def near_image_reviews(spark, sf_dir):
    """Candidate pairs with reviews that name them in either order, the last of several."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"))
    pairs = e.join(e.select((F.col("a") - 1).alias("a")), "a", "left_semi").select("a", (F.col("a") + 1).alias("b"), (F.col("a") % 3).alias("dhash_bits"), (F.col("a") % 2).alias("phash_bits"))
    asked = pairs.where("a % 10 = 0")
    reviews = asked.select("a", "b", F.lit("REVIEWED_FIRST").alias("review_status"), F.lit(1).alias("position")).unionByName(asked.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("REVIEWED_SECOND").alias("review_status"), F.lit(2).alias("position")))
    at = lambda n: F.floor(F.col("a") / n)
    fields = e.select(F.col("a").alias("id"), (at(2) % 5).alias("company"), at(4).alias("date"), (at(2) % 3).alias("total"))
    return near_images.reviewed_status(pairs, reviews, fields).select("a", "b", "status", "by_review")
