"""Queries over annotated documents made from parts: conversion with refusals, and rows that are read and written back."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..operators import annotations, scores
from ..sources import exports
from ..storage import scratch
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


_PARTS = """parts AS (
  SELECT DISTINCT p_partkey AS k, p_name AS name, p_size AS size, 30 + p_partkey % 20 AS width, p_partkey % 10 AS high, 15 + p_partkey % 13 // 12 AS category,
    CASE WHEN p_partkey % 11 = 0 THEN 3 ELSE 2 END AS num, CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 30 + p_partkey % 20 END AS said FROM part)"""


def _rows(spark, sf_dir):
    """A seller whose rectangle is ``size`` by ``high``, and an address; sizes, counts and categories disagree here and there."""
    k, size = F.col("p_partkey"), F.col("p_size")
    width = 30 + k % 20
    text = lambda *xs: F.concat(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs))
    record = lambda category, x, y, said: text("{'category_id': ", category, ", 'segmentation': [[0, 0, ", x, ", 0, ", x, ", ", y, ", 0, ", y, "]], 'area': 1, 'bbox': [0, 0, 1, 1], 'width': ", said, ", 'height': 50}")
    seller = record(15 + F.floor(k % 13 / 12), size, k % 10, width)
    address = record(F.lit(16), F.lit(9), F.lit(8), F.when(k % 17 == 0, 1).otherwise(width))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").distinct().select(
        k.cast("string").alias("img_id"),
        text("[", seller, ", ", address, "]").alias("anno_polygons"),
        text(F.col("p_name"), "|||12 street ", size).alias("anno_texts"),
        F.lit("SELLER|||ADDRESS").alias("anno_labels"),
        F.when(k % 11 == 0, "3").otherwise("2").alias("anno_num"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, "[null,1]").otherwise("[null,null]").alias("anno_line_item_ids"),
        width.cast("int").alias("width"),
        F.lit(50).alias("height"),
    )


@query(f"""
WITH {_PARTS}
SELECT CAST(k AS VARCHAR) AS img_id, code, CASE WHEN code IS NULL THEN name END AS company, CASE WHEN code IS NULL THEN CAST(greatest(size, 0) AS DOUBLE) END AS right_side FROM (
  SELECT *, CASE WHEN num <> 2 THEN 'ANNOTATION_LENGTH_MISMATCH' WHEN category <> 15 THEN 'CATEGORY_LABEL_MISMATCH' WHEN size > width OR high > 50 THEN 'POLYGON_OUT_OF_IMAGE'
    WHEN size * high = 0 THEN 'DEGENERATE_POLYGON' WHEN said <> width THEN 'ANNOTATION_IMAGE_SIZE_MISMATCH' END AS code FROM parts)
""")
def document_conversion(spark, sf_dir):
    """Every part as an annotated document: its seller and the right side of the seller's box, or why it is refused."""
    rows = _rows(spark, sf_dir)
    regions, fields, refused = annotations.convert_rows(rows, rows.select("img_id", "width", "height"))
    company = fields.where("field = 'company'").select("img_id", F.col("raw_value").alias("company"))
    side = regions.where("field = 'company'").select("img_id", F.col("bbox")[2].alias("right_side"))
    none = F.lit(None).cast("string")
    accepted = company.join(side, "img_id").select("img_id", none.alias("code"), "company", "right_side")
    return accepted.unionByName(refused.select("img_id", "code", none.alias("company"), F.lit(None).cast("double").alias("right_side")))


@query(f"""
WITH {_PARTS}
SELECT CAST(k AS VARCHAR) AS img_id,
  '[{{''category_id'': 15, ''segmentation'': [[0, 0, ' || size || ', 0, ' || size || ', ' || high || ', 0, ' || high || ']], ''area'': 1, ''bbox'': [0, 0, 1, 1], ''width'': ' || width || ', ''height'': 50}}, ' ||
  CASE WHEN said = width THEN '{{''category_id'': 16, ''segmentation'': [[0, 0, 9, 0, 9, 8, 0, 8]], ''area'': 1, ''bbox'': [0, 0, 1, 1], ''width'': ' || width || ', ''height'': 50}}]'
    ELSE '{{''category_id'': 16, ''segmentation'': [[0, 0, 9, 0, 9, 8, 0, 8]], ''area'': 72, ''bbox'': [0, 0, 9, 8], ''width'': ' || width || ', ''height'': 50}}]' END AS anno_polygons,
  name || '|||12 street ' || size AS anno_texts
FROM parts WHERE k % 7 <> 1 AND category = 15 AND size <= width AND size > 0 AND high > 0
""")
def annotation_round_trip(spark, sf_dir):
    """Rows of the labelling table read into regions and written again; records of another image size are made anew."""
    rows = _rows(spark, sf_dir)
    regions, _ = annotations.decode_rows(rows)
    again, _ = annotations.encode_regions(regions, rows.select("img_id", "width", "height"))
    return again.select("img_id", "anno_polygons", "anno_texts")


@query("""
WITH lines AS (SELECT l_orderkey AS d, l_linenumber AS m, min(l_suppkey) % 3 AS g, (min(l_suppkey) + CASE WHEN min(l_partkey) % 9 = 0 THEN 1 ELSE 0 END) % 3 AS p FROM lineitem GROUP BY ALL),
gold AS (SELECT DISTINCT d, list_sort(list(m)) AS s FROM lines GROUP BY d, g),
pred AS (SELECT DISTINCT d, list_sort(list(m)) AS s FROM lines GROUP BY d, p),
docs AS (
  SELECT d, count(*) AS gold_items, sum(len(s) * (len(s) - 1) // 2) AS pair_gold,
    (SELECT count(*) FROM pred x WHERE x.d = gold.d) AS pred_items, (SELECT sum(len(s) * (len(s) - 1) // 2) FROM pred x WHERE x.d = gold.d) AS pair_pred FROM gold GROUP BY d),
exact AS (SELECT d, count(*) AS exact_items FROM gold JOIN pred USING (d, s) GROUP BY d),
met AS (SELECT a.d, count(*) AS pair_both FROM lines a JOIN lines b ON a.d = b.d AND a.m < b.m AND a.g = b.g AND a.p = b.p GROUP BY 1),
joined AS (SELECT docs.*, coalesce(exact_items, 0) AS exact_items, coalesce(pair_both, 0) AS pair_both FROM docs LEFT JOIN exact USING (d) LEFT JOIN met USING (d)),
each AS (SELECT unnest(['l' || d % 4, '__all']) AS layout, * FROM joined),
total AS (SELECT layout, count(*) AS documents, count(*) FILTER (gold_items = pred_items AND exact_items = gold_items) AS same, sum(gold_items)::BIGINT AS gold_items, sum(pred_items)::BIGINT AS pred_items,
    sum(exact_items) AS exact, sum(pair_gold) AS pg, sum(pair_pred) AS pp, sum(pair_both) AS pb FROM each GROUP BY 1),
rates AS (SELECT *, round(pb / pp, 4) AS pair_precision, round(pb / pg, 4) AS pair_recall FROM total)
SELECT layout, documents, round(same / documents, 4) AS document_exact_rate, gold_items, pred_items, round(exact / gold_items, 4) AS item_recall, round(exact / pred_items, 4) AS item_precision,
  pair_precision, pair_recall, round(2 * pair_precision * pair_recall / (pair_precision + pair_recall), 4) AS pair_f1 FROM rates
""")
def grouping_scores(spark, sf_dir):
    """Lines of orders grouped by supplier, against groups of which some lines are moved: exact sets and pairs by layout."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("m")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("part"))
    gold = lines.select("d", "m", (F.col("s") % 3).alias("g"))
    pred = lines.select("d", "m", ((F.col("s") + F.when(F.col("part") % 9 == 0, 1).otherwise(0)) % 3).alias("g"))
    layouts = lines.select("d").distinct().withColumn("layout", F.concat(F.lit("l"), (F.col("d") % 4).cast("string")))
    return scores.group_scores(gold, pred, layouts, "d", "g", "m")


@query()
def matched_cell_rates(spark, sf_dir):
    """Items of orders against predictions that lack some, hold others and misread cells: outcomes by cell over greedily matched items."""
    k = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("d"), k.alias("item")).agg(
        F.min("l_partkey").cast("string").alias("name"), F.min("l_quantity").cast("string").alias("quantity"), F.min("l_extendedprice").cast("string").alias("price"))
    part = F.col("name").cast("long")
    pred = lines.where(part % 7 != 0).withColumns({"quantity": F.when(part % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("quantity")), "price": F.when(part % 11 == 0, "0").otherwise(F.col("price"))})
    extra = lines.where(part % 13 == 0).select("d", (F.col("item") + 100).alias("item"), F.lit("extra").alias("name"), F.lit(None).cast("string").alias("quantity"), F.lit("1").alias("price"))
    return scores.cell_rates(scores.matched_cells(lines, pred.unionByName(extra), "d", "item", ["name", "quantity", "price"]))


@query("""
WITH regions AS (
  SELECT CASE p_partkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' WHEN 2 THEN 'spare' ELSE 'train' END AS split, p_brand AS label, p_size AS side,
    CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_name || CASE p_partkey % 8 WHEN 1 THEN '~' WHEN 2 THEN '^~^' ELSE '' END END AS text FROM part),
tagged AS (
  SELECT *, CASE WHEN text = '' THEN 'skipped_empty_text' WHEN contains(text, '~') OR contains(text, '^') THEN 'skipped_out_of_vocab' WHEN side < 4 THEN 'skipped_bad_crop' ELSE 'kept' END AS outcome
  FROM regions WHERE split <> 'spare')
SELECT split, 'outcome' AS kind, outcome AS name, count(*) AS n FROM tagged GROUP BY ALL
UNION ALL SELECT split, 'label', label, count(*) FROM tagged WHERE outcome = 'kept' GROUP BY ALL
UNION ALL SELECT split, 'character', c, count(*) FROM tagged, (SELECT unnest(['~', '^']) AS c) WHERE outcome = 'skipped_out_of_vocab' AND contains(text, c) GROUP BY ALL
UNION ALL SELECT split, 'written', 'lines', count(*) FROM tagged WHERE outcome = 'kept' GROUP BY ALL
""")
def export_samples(spark, sf_dir):
    """Samples of parts exported with a count for all that is left out; the annotation lines are read back."""
    k = F.col("p_partkey")
    split = F.when(k % 10 == 0, "test").when(k % 10 == 1, "val").when(k % 10 == 2, "spare").otherwise("train")
    text = F.when(k % 6 == 0, "").otherwise(F.concat("p_name", F.when(k % 8 == 1, "~").when(k % 8 == 2, "^~^").otherwise("")))
    regions = table(spark, sf_dir, "part").select(split.alias("split"), F.concat(k.cast("string"), F.lit(".jpg")).alias("img_id"), F.lit(1).alias("region"), F.col("p_brand").alias("label"), text.alias("text"), F.lit(50).alias("width"), F.col("p_size").alias("height"))
    out = scratch(spark, "export")
    tagged, _ = exports.export_samples(regions, string.ascii_letters + string.digits + " -#", out, ["train", "val", "test"])
    lines = spark.read.text(f"{out}/annotations").groupBy("split").agg(F.count("*").alias("n")).select("split", F.lit("written").alias("kind"), F.lit("lines").alias("name"), "n")
    return exports.summary(tagged).unionByName(lines)
