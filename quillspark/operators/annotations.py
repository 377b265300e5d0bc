"""Annotated documents: rows of compound cells to regions and fields, what is refused and why, and the way back.

A row holds parallel cells: polygons as a list in Python notation, texts and labels delimited by three bars.  Checks form a
cascade; of a row the first that fails is named: cells, counts, then the regions in their order, then sizes.  Conversion reads
every part of a polygon; the codec of the labelling table reads the largest one and writes a row that gives the same regions.

Edge cases: a null cell is an empty one; a row whose image is unknown is refused; repeated rows are converted apart only if their
ids differ (``img_id`` is the key); an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import ast
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import geometry as G
from ..functions import text as X
from ..storage import materialize
from .contracts import plain_number

#: Labels with their categories and fields, other spellings, labels of line items, and codes of refusal.
CATEGORIES = {"SELLER": 15, "ADDRESS": 16, "TIMESTAMP": 17, "TOTAL_COST": 18, "ITEM_NAME": 19, "QUANTITY": 20, "UNIT_PRICE": 21, "LINE_TOTAL": 22}
FIELDS = {"SELLER": "company", "ADDRESS": "address", "TIMESTAMP": "date", "TOTAL_COST": "total"}
ALIASES = {"TOTAL_TOTAL_COST": "TOTAL_COST"}
ITEM_LABELS = ["ITEM_NAME", "QUANTITY", "UNIT_PRICE", "LINE_TOTAL"]
NO_IMAGE, BAD_LITERAL, BAD_LITERAL_TYPE, BAD_NUMBER = "IMAGE_DECODE_ERROR", "INVALID_LITERAL", "INVALID_LITERAL_TYPE", "INVALID_ANNO_NUM"
COUNTS, NOTHING, BAD_LABEL, BAD_RECORD = "ANNOTATION_LENGTH_MISMATCH", "EMPTY_DOCUMENT_ANNOTATION", "UNKNOWN_SOURCE_LABEL", "INVALID_POLYGON_RECORD"
CATEGORY, NO_PARTS, BAD_PART, FEW_POINTS = "CATEGORY_LABEL_MISMATCH", "MISSING_SEGMENTATION", "INVALID_SEGMENTATION_PART", "INVALID_POLYGON"
NOT_FINITE, OUTSIDE, NO_AREA, SIZES = "NONFINITE_COORDINATE", "POLYGON_OUT_OF_IMAGE", "DEGENERATE_POLYGON", "ANNOTATION_IMAGE_SIZE_MISMATCH"


def literal_items(text: str | None) -> dict:
    """The members of a list in Python notation, each as JSON text with its keys in order; numbers that are not finite as null."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v if isinstance(v, str | int | float | bool) or v is None else repr(v)

    if not text or not text.strip():
        return {"items": [], "error": None}
    try:
        value = ast.literal_eval(text.strip())
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return {"items": None, "error": BAD_LITERAL}
    if not isinstance(value, list):
        return {"items": None, "error": BAD_LITERAL_TYPE}
    return {"items": [json.dumps(plain(v), ensure_ascii=False) for v in value], "error": None}


@F.pandas_udf(StructType().add("items", ArrayType(StringType())).add("error", StringType()))
def _literal_items(cells: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([literal_items(c) for c in cells], columns=["items", "error"])


#: Said to differ each time, so that the planner does not copy it to every use of its members.
_items_once = _literal_items.asNondeterministic()


@F.pandas_udf(StringType())
def _as_literal(items: pd.Series) -> pd.Series:
    """JSON texts as one list in Python notation."""
    return items.map(lambda xs: None if xs is None else repr([json.loads(x) for x in xs]))


def _lookup(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _is_number(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")


def _numbers(part: Column) -> Column:
    """Numbers of a variant list, null for other members; null if it is no list."""
    return F.transform(F.try_variant_get(part, "$", "array<variant>"), lambda x: F.when(_is_number(x), F.try_variant_get(x, "$", "double")))


def part_fault(p: Column, width: Column, height: Column) -> Column:
    """The first fault of one part ``x0 y0 x1 y1 ...`` of a polygon, null if it has none."""
    axis = lambda k: F.filter(p, lambda _, i: i % 2 == k)
    beyond = (F.array_min(p) < 0) | (F.array_max(axis(0)) > width) | (F.array_max(axis(1)) > height)
    return (
        F.when(p.isNull(), BAD_PART)
        .when((F.size(p) < 6) | (F.size(p) % 2 == 1), FEW_POINTS)
        .when(F.exists(p, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), NOT_FINITE)
        .when(beyond, OUTSIDE)
        .when(G.polygon_area(G.points(p)) == 0, NO_AREA)
    )


def convert_rows(rows: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions, fields and refusals of annotation rows.

    ``rows``: ``img_id, anno_polygons, anno_texts, anno_labels, anno_num`` as text; ``images``: ``img_id, width, height``.
    Regions: ``img_id, region_id, label, field, text, parts, bbox``.  Fields, four for each accepted document: ``img_id, field, status,
    raw_value`` (the texts in order, a line each), ``region_ids``.  Refusals: ``img_id, code``.
    """
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    read = rows.select("img_id", _items_once("anno_polygons").alias("p"), X.split_compound(cell("anno_texts")).alias("texts"), X.split_compound(cell("anno_labels")).alias("labels"), F.trim(cell("anno_num")).try_cast("int").alias("num"))
    sized = read.join(images.select("img_id", "width", "height", F.lit(True).alias("known")), "img_id", "left")
    items, n = F.col("p.items"), F.size("p.items")
    same = (n == F.size("texts")) & (n == F.size("labels")) & (n == F.col("num"))
    row_fault = F.when(F.col("known").isNull(), NO_IMAGE).when(F.col("p.error").isNotNull(), F.col("p.error")).when(F.col("num").isNull(), BAD_NUMBER).when(~same, COUNTS).when(n == 0, NOTHING)
    checked = materialize(sized.withColumn("row_fault", row_fault), "annotation-rows")
    each = checked.where("row_fault is null").select("img_id", "width", "height", F.posexplode(F.arrays_zip(items.alias("item"), "texts", "labels")).alias("pos", "x"))
    each = each.select("img_id", "width", "height", "pos", F.col("x.texts").alias("text"), F.col("x.labels").alias("label"), F.try_parse_json("x.item").alias("v"))
    parts = F.transform(F.try_variant_get("v", "$.segmentation", "array<variant>"), _numbers)
    category = F.try_variant_get("v", "$.category_id", "variant")
    agreed = _is_number(category) & (F.try_variant_get("v", "$.category_id", "int") == _lookup(CATEGORIES)[F.col("label")])
    each = each.withColumns({"parts": parts, "agreed": F.coalesce(agreed, F.lit(False))})
    whole = lambda c: F.coalesce(F.try_variant_get("v", f"$.{c}", "int") == F.col(c), F.lit(False))
    fault = (
        F.when(~F.col("label").isin(*FIELDS), BAD_LABEL)
        .when(~F.schema_of_variant("v").startswith("OBJECT"), BAD_RECORD)
        .when(~F.col("agreed"), CATEGORY)
        .when(F.coalesce(F.size("parts") < 1, F.lit(True)), NO_PARTS)
        .otherwise(F.get(F.filter(F.transform("parts", lambda p: part_fault(p, F.col("width"), F.col("height"))), lambda x: x.isNotNull()), F.lit(0)))
    )
    # Rows and regions are read several times: both are written, so no polygon is opened again.
    each = each.withColumns({"fault": fault, "fits": whole("width") & whole("height")}).drop("v")
    each = materialize(each, "annotation-regions")
    judged = each.groupBy("img_id").agg(F.min_by(F.when(F.col("fault").isNotNull(), F.col("fault")), F.when(F.col("fault").isNotNull(), F.col("pos"))).alias("region_fault"), F.bool_and("fits").alias("fits"))
    codes = checked.select("img_id", "row_fault").join(judged, "img_id", "left").select("img_id", F.coalesce("row_fault", "region_fault", F.when(~F.col("fits"), SIZES)).alias("code"))
    accepted = codes.where("code is null").select("img_id")
    flat, axis = F.flatten("parts"), lambda k: F.flatten(F.transform("parts", lambda p: F.filter(p, lambda _, i: i % 2 == k)))
    box = F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1)))
    regions = each.join(accepted, "img_id").where(F.size(flat) > 0).select("img_id", F.format_string("r%04d", "pos").alias("region_id"), "label", _lookup(FIELDS)[F.col("label")].alias("field"), "text", "parts", box.alias("bbox"))
    values = regions.groupBy("img_id", "field").agg(F.array_sort(F.collect_list(F.struct("region_id", "text"))).alias("x"))
    every = accepted.select("img_id", F.explode(F.array(*map(F.lit, FIELDS.values()))).alias("field")).join(values, ["img_id", "field"], "left")
    column = lambda c: F.transform("x", lambda r: r[c])
    fields = every.select("img_id", "field", F.when(F.col("x").isNull(), "unlabeled").otherwise("annotated").alias("status"), F.array_join(column("text"), "\n").alias("raw_value"), F.coalesce(column("region_id"), F.array().cast("array<string>")).alias("region_ids"))
    return regions, fields, codes.where("code is not null")


def convert_pairs(images: DataFrame, boxes: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Regions, fields, flags and refusals of documents that come as three files.

    ``images``: ``img_id, width, height``; ``boxes`` and ``entities``: ``img_id, text``, lines of eight numbers and a text, and an object of
    fields.  A field that is not there is ``source_missing``, an empty one ``annotated_empty``; a text of three stars is uncertain.
    Flags are sorted; refusals name what file is missing.
    """
    named = lambda df, n, *more: df.select("img_id", *more, F.lit(True).alias(n))
    every = named(images, "image", "width", "height").join(named(boxes, "box", F.col("text").alias("lines")), "img_id", "full_outer").join(named(entities, "entities", F.col("text").alias("object")), "img_id", "full_outer")
    missing = F.filter(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in ("image", "box", "entities"))), lambda x: x.isNotNull())
    every = every.withColumn("missing", missing)
    whole = every.where(F.size("missing") == 0)
    each = whole.select("img_id", "width", "height", F.posexplode(F.split(F.coalesce("lines", F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("at", "line")).where(F.trim("line") != "")
    cut = F.split("line", ",", 9)
    each = each.withColumns({"cut": cut}).withColumn("points", F.transform(F.slice("cut", 1, 8), lambda x: F.trim(x).try_cast("double")))
    fault = F.when(F.size("cut") < 9, "INVALID_BOX_LINE").when(F.exists("points", lambda x: x.isNull()), "INVALID_BOX_COORDINATE").otherwise(part_fault(F.col("points"), F.col("width"), F.col("height")))
    each = each.withColumn("fault", fault)
    text = F.get("cut", F.lit(8))
    v = F.try_parse_json("object")
    value = lambda f: F.try_variant_get(v, f"$.{f}", "variant")
    strange = F.array(*(value(f) for f in FIELDS.values()))
    object_fault = F.when(v.isNull(), "INVALID_JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "INVALID_JSON_ROOT").when(F.exists(strange, lambda x: x.isNotNull() & (F.schema_of_variant(x) != "STRING")), "NONSTRING_ENTITY_VALUE")
    first = each.groupBy("img_id").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("at"))).alias("line_fault"), F.bool_or(F.trim(text) == "***").alias("unsure"))
    judged = whole.join(first, "img_id", "left").withColumn("code", F.coalesce("line_fault", object_fault))
    none = F.array().cast("array<string>")
    refused = every.where(F.size("missing") > 0).select("img_id", F.lit("MISSING_PAIRED_FILE").alias("code"), "missing").unionByName(judged.where("code is not null").select("img_id", "code", none.alias("missing")))
    good = judged.where("code is null")
    kept = F.struct(*(F.struct(value(f).isNotNull().alias("there"), F.try_variant_get(v, f"$.{f}", "string").alias("value")).alias(f) for f in FIELDS.values()))
    opened = good.select("img_id", "unsure", kept.alias("k"), F.map_keys(F.from_json("object", "map<string,string>")).alias("keys"))
    status = lambda f: F.when(~F.col(f"k.{f}.there"), "source_missing").when(F.col(f"k.{f}.value") == "", "annotated_empty").otherwise("annotated")
    fields = opened.select("img_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), status(f).alias("status"), F.nullif(F.col(f"k.{f}.value"), F.lit("")).alias("raw_value")) for f in FIELDS.values()))))
    unknown = F.size(F.array_except("keys", F.array(*map(F.lit, FIELDS.values())))) > 0
    said = [F.when(unknown, "UNKNOWN_ENTITY_KEYS"), F.when(F.col("unsure"), "UNCERTAIN_OCR_MARKER")]
    for f in FIELDS.values():
        said.append(F.when(status(f) == "source_missing", f"SOURCE_MISSING_{f.upper()}").when(status(f) == "annotated_empty", f"ANNOTATED_EMPTY_{f.upper()}"))
    flags = opened.select("img_id", F.array_sort(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("flags"))
    axis = lambda k: F.filter("points", lambda _, i: i % 2 == k)
    box = F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1)))
    regions = each.join(good.select("img_id"), "img_id").select("img_id", F.format_string("r%04d", F.col("at") + 1).alias("region_id"), text.alias("text"), "points", box.alias("bbox"), F.when(F.trim(text) == "***", "uncertain_marker").otherwise("unlabeled").alias("status"))
    return regions, fields, flags, refused


def decode_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the labelling table as regions ``img_id, pos, label, text, line_item_id, points, source``, and refusals ``img_id, code``.

    Other spellings of labels are put right; of several parts the largest counts; ``source`` is the polygon's record as JSON text.
    """
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    label = lambda x: F.coalesce(_lookup(ALIASES)[x], x)
    read = rows.select("img_id", _items_once("anno_polygons").alias("p"), X.split_compound(cell("anno_texts")).alias("texts"), F.transform(X.split_compound(cell("anno_labels")), label).alias("labels"), F.trim(cell("anno_line_item_ids")).alias("ids"))
    n = F.size("p.items")
    parsed = F.try_variant_get(F.try_parse_json("ids"), "$", "array<variant>")
    right = lambda v: (F.schema_of_variant(v) == "VOID") | ((F.schema_of_variant(v) == "BIGINT") & (F.try_variant_get(v, "$", "bigint") >= 1))
    listed = F.coalesce((F.size(parsed) == n) & F.forall(parsed, right), F.lit(False))
    fault = F.when(F.col("p.error").isNotNull(), F.col("p.error")).when((n != F.size("texts")) | (n != F.size("labels")), COUNTS).when((F.col("ids") != "") & ~listed, "INVALID_LINE_ITEM_IDS")
    ids = F.when(F.col("ids") == "", F.transform("texts", lambda _: F.lit(None).cast("bigint"))).otherwise(F.transform(parsed, lambda v: F.try_variant_get(v, "$", "bigint")))
    checked = materialize(read.withColumns({"fault": fault, "ids": F.when(fault.isNull(), ids)}), "annotation-rows")
    each = checked.where("fault is null").select("img_id", F.posexplode(F.arrays_zip(F.col("p.items").alias("item"), "texts", "labels", "ids")).alias("pos", "x"))
    each = each.select("img_id", "pos", F.col("x.labels").alias("label"), F.col("x.texts").alias("text"), F.col("x.ids").alias("line_item_id"), F.col("x.item").alias("source"), F.try_parse_json("x.item").alias("v"))
    seg = F.try_variant_get("v", "$.segmentation", "array<variant>")
    nested = F.schema_of_variant(F.get(seg, F.lit(0))).startswith("ARRAY")
    parts = F.when(nested, F.transform(seg, _numbers)).otherwise(F.array(_numbers(F.try_variant_get("v", "$.segmentation", "variant"))))
    usable = F.filter(parts, lambda p: p.isNotNull() & (F.size(p) >= 6) & (F.size(p) % 2 == 0) & ~F.exists(p, lambda v: v.isNull()))
    each = each.withColumn("usable", usable)
    areas = F.transform("usable", lambda p: G.polygon_area(G.points(p)))
    points = F.get("usable", (F.array_position(areas, F.array_max(areas)) - 1).cast("int"))
    wanted = _lookup(CATEGORIES)[F.col("label")]
    given = F.coalesce(F.try_variant_get("v", "$.category_id", "int"), wanted)
    item = F.col("label").isin(ITEM_LABELS)
    fault = (
        F.when(~F.schema_of_variant("v").startswith("OBJECT"), BAD_RECORD)
        .when(wanted.isNull() | (given != wanted), CATEGORY)
        .when(item & F.col("line_item_id").isNull(), "LINE_ITEM_ID_MISSING")
        .when(~item & F.col("line_item_id").isNotNull(), "LINE_ITEM_ID_UNEXPECTED")
        .when(F.coalesce(F.size("usable") < 1, F.lit(True)), NO_PARTS)
        .when(F.coalesce(F.size(F.try_variant_get("v", "$.bbox", "array<double>")) != 4, F.lit(True)), "INVALID_BBOX")
    )
    each = materialize(each.withColumns({"fault": fault, "points": points}).drop("v", "usable"), "annotation-regions")
    first = each.where("fault is not null").groupBy("img_id").agg(F.min_by("fault", "pos").alias("code"))
    refused = checked.where("fault is not null").select("img_id", F.col("fault").alias("code")).unionByName(first)
    return each.join(refused, "img_id", "left_anti").select("img_id", "pos", "label", "text", "line_item_id", "points", "source"), refused


def encode_regions(regions: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions as rows of the labelling table (``img_id`` and the cells), and refusals ``img_id, code``.

    A region whose points are those of its ``source`` (to 0.01) keeps that record as it is; else one is made of the points,
    numbers to two decimals.
    """
    r = regions.join(images.select("img_id", "width", "height"), "img_id")
    label, text = F.upper(F.trim(F.coalesce("label", F.lit("")))), F.trim(F.coalesce("text", F.lit("")))
    r = r.withColumns({"label": label, "text": text}).withColumn("category", _lookup(CATEGORIES)[F.col("label")])
    axis = lambda k: F.filter("points", lambda _, i: i % 2 == k)
    r = r.withColumns({"x0": F.array_min(axis(0)), "y0": F.array_min(axis(1)), "x1": F.array_max(axis(0)), "y1": F.array_max(axis(1))})
    item = F.col("label").isin(ITEM_LABELS)
    fault = (
        F.when(F.col("category").isNull(), "INVALID_CATEGORY")
        .when(F.col("text") == "", "EMPTY_TEXT")
        .when(item & ~F.coalesce(F.col("line_item_id") >= 1, F.lit(False)), "LINE_ITEM_ID_MISSING")
        .when(F.coalesce((F.size("points") < 8) | (F.size("points") % 2 == 1), F.lit(True)), NO_PARTS)
        .when((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > F.col("width")) | (F.col("y1") > F.col("height")), OUTSIDE)
        .when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), NO_AREA)
    )
    r = r.withColumn("fault", fault)
    refused = r.where("fault is not null").groupBy("img_id").agg(F.min_by("fault", "pos").alias("code"))
    v = F.try_parse_json("source")
    of = lambda c: F.coalesce(F.try_variant_get(v, f"$.{c}", "int"), F.col(c))
    seg = F.try_variant_get(v, "$.segmentation", "array<array<double>>")
    areas = F.transform(seg, lambda p: G.polygon_area(G.points(p)))
    was = F.get(seg, (F.array_position(areas, F.array_max(areas)) - 1).cast("int"))
    near = (F.size(was) == F.size("points")) & F.forall(F.zip_with(was, F.col("points"), lambda a, b: F.abs(a - b) <= 0.01), lambda x: x)
    kept = F.coalesce((F.try_variant_get(v, "$.category_id", "int") == F.col("category")) & (of("width") == F.col("width")) & (of("height") == F.col("height")) & near, F.lit(False))
    numbers = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, plain_number), ", "), F.lit("]"))
    box = F.array(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    made = F.concat(
        F.lit('{"category_id": '), F.col("category").cast("string"), F.lit(', "segmentation": ['), numbers(F.col("points")), F.lit('], "area": '), plain_number(G.polygon_area(G.points(F.col("points")))),
        F.lit(', "bbox": '), numbers(box), F.lit(', "width": '), F.col("width").cast("string"), F.lit(', "height": '), F.col("height").cast("string"), F.lit("}"))
    r = r.join(refused, "img_id", "left_anti").withColumns({"record": F.when(kept, F.col("source")).otherwise(made), "line": F.when(item, F.col("line_item_id").cast("string")).otherwise("null")})
    x = r.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("pos", "record", "text", "label", "line"))).alias("x"))
    column = lambda c: F.transform("x", lambda e: e[c])
    rows = x.select(
        "img_id",
        _as_literal(column("record")).alias("anno_polygons"),
        F.array_join(column("text"), "|||").alias("anno_texts"),
        F.array_join(column("label"), "|||").alias("anno_labels"),
        F.size("x").cast("string").alias("anno_num"),
        F.concat(F.lit("["), F.array_join(column("line"), ","), F.lit("]")).alias("anno_line_item_ids"),
    )
    return rows, refused
