"""Each code of refusal, conversion of accepted rows, and rows that come back as they were."""

import json

from quillspark.operators import annotations as A

ROWS = "img_id string, anno_polygons string, anno_texts string, anno_labels string, anno_num string, extra int"
TABLE = "img_id string, anno_polygons string, anno_texts string, anno_labels string, anno_line_item_ids string"


def polygon(category, *parts, width=100, height=50, **more):
    return {"category_id": category, "segmentation": [list(p) for p in parts], "width": width, "height": height} | more


SQUARE, OTHER = (1, 1, 20, 1, 20.5, 9, 1, 9), (30, 5, 60, 5, 60, 20, 30, 20)


def row(name, polygons, texts, labels, num=None):
    return (name, polygons if isinstance(polygons, str) or polygons is None else repr(polygons), "|||".join(texts), "|||".join(labels), str(len(texts)) if num is None else num, 1)


def test_the_first_failing_check_is_named(spark):
    ok = polygon(15, SQUARE)
    cases = {
        "INVALID_LITERAL": row("literal", "[{'a': ", ["x"], ["SELLER"]),
        "INVALID_LITERAL_TYPE": row("type", "{'a': 1}", ["x"], ["SELLER"], "many"),
        "INVALID_ANNO_NUM": row("num", [ok], ["x", "y"], ["SELLER"], "many"),
        "ANNOTATION_LENGTH_MISMATCH": row("count", [ok], ["x"], ["SELLER"], "2"),
        "EMPTY_DOCUMENT_ANNOTATION": row("empty", None, [], [], "0"),
        "UNKNOWN_SOURCE_LABEL": row("label", [ok, 3], ["x", "y"], ["PRICE", "SELLER"]),
        "INVALID_POLYGON_RECORD": row("record", [ok, 3], ["x", "y"], ["SELLER", "SELLER"]),
        "CATEGORY_LABEL_MISMATCH": row("category", [polygon("15", SQUARE)], ["x"], ["SELLER"]),
        "MISSING_SEGMENTATION": row("segments", [polygon(15)], ["x"], ["SELLER"]),
        "INVALID_SEGMENTATION_PART": row("part", [polygon(15, SQUARE) | {"segmentation": [5]}], ["x"], ["SELLER"]),
        "INVALID_POLYGON": row("points", [polygon(15, SQUARE, (1, 2, 3, 4))], ["x"], ["SELLER"]),
        "NONFINITE_COORDINATE": row("finite", "[{'category_id': 15, 'segmentation': [[1, 1, 1e999, 1, 2, 2]], 'width': 100, 'height': 50}]", ["x"], ["SELLER"]),
        "POLYGON_OUT_OF_IMAGE": row("out", [polygon(15, (0, 0, 101, 0, 5, 5))], ["x"], ["SELLER"]),
        "DEGENERATE_POLYGON": row("area", [polygon(15, (0, 0, 5, 5, 9, 9))], ["x"], ["SELLER"]),
        "ANNOTATION_IMAGE_SIZE_MISMATCH": row("size", [ok, polygon(16, SQUARE, width=99)], ["x", "y"], ["SELLER", "ADDRESS"]),
        "IMAGE_DECODE_ERROR": row("no image", [ok], ["x"], ["SELLER"]),
    }
    rows = spark.createDataFrame(list(cases.values()), ROWS)
    images = spark.createDataFrame([(r[0], 100, 50) for r in cases.values() if r[0] != "no image"], "img_id string, width int, height int")
    regions, fields, refused = A.convert_rows(rows, images)
    assert {r["img_id"]: r["code"] for r in refused.collect()} == {r[0]: code for code, r in cases.items()}
    assert regions.count() == 0 and fields.count() == 0


def test_accepted_rows_keep_all_parts_and_join_texts_in_order(spark):
    polygons = [polygon(16, SQUARE), polygon(15, SQUARE, OTHER), polygon(16, OTHER)]
    rows = spark.createDataFrame([row("a", polygons, ["12 Lê Lợi", "Shop", "Hà Nội"], ["ADDRESS", "SELLER", "ADDRESS"])], ROWS)
    regions, fields, refused = A.convert_rows(rows, spark.createDataFrame([("a", 100, 50)], "img_id string, width int, height int"))
    assert refused.count() == 0
    got = {r["region_id"]: r for r in regions.collect()}
    assert got["r0001"]["parts"] == [list(map(float, SQUARE)), list(map(float, OTHER))] and got["r0001"]["bbox"] == [1.0, 1.0, 60.0, 20.0] and got["r0001"]["field"] == "company"
    by = {r["field"]: (r["status"], r["raw_value"], r["region_ids"]) for r in fields.collect()}
    assert by == {"company": ("annotated", "Shop", ["r0001"]), "address": ("annotated", "12 Lê Lợi\nHà Nội", ["r0000", "r0002"]), "date": ("unlabeled", None, []), "total": ("unlabeled", None, [])}


def test_rows_come_back_as_they_were(spark):
    full = lambda c, *parts, **more: polygon(c, *parts, area=1, bbox=[1, 1, 2, 2], **more)
    table = [
        ("a", repr([full(15, SQUARE), full(19, OTHER, SQUARE, note="don't \"quote\"")]), "Shop|||sữa", "SELLER|||ITEM_NAME", "[null,2]"),
        ("b", repr([full(18, SQUARE)]), "9", "TOTAL_TOTAL_COST", "[null]"),
        ("none", repr([full(15, SQUARE)]), "x|||y", "SELLER", "[null]"),
        ("ids", repr([full(15, SQUARE)]), "x", "SELLER", "[0]"),
        ("item", repr([full(15, SQUARE)]), "x", "SELLER", "[3]"),
        ("lacks", repr([full(20, SQUARE)]), "x", "QUANTITY", ""),
        ("box", repr([polygon(15, SQUARE)]), "x", "SELLER", ""),
    ]
    regions, refused = A.decode_rows(spark.createDataFrame(table, TABLE))
    assert {r["img_id"]: r["code"] for r in refused.collect()} == {"none": "ANNOTATION_LENGTH_MISMATCH", "ids": "INVALID_LINE_ITEM_IDS", "item": "LINE_ITEM_ID_UNEXPECTED", "lacks": "LINE_ITEM_ID_MISSING", "box": "INVALID_BBOX"}
    images = spark.createDataFrame([(x, 100, 50) for x in "ab"], "img_id string, width int, height int")
    rows, bad = A.encode_regions(regions, images)
    got = {r["img_id"]: r for r in rows.collect()}
    assert bad.count() == 0 and set(got) == {"a", "b"}
    for name, polygons, texts, labels, ids in table[:2]:
        r = got[name]
        assert (r["anno_polygons"], r["anno_texts"], r["anno_labels"], r["anno_line_item_ids"]) == (polygons, texts, labels.replace("TOTAL_TOTAL", "TOTAL"), ids)
    again, _ = A.decode_rows(rows)
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(again) == plain(regions)


def test_changed_regions_get_a_record_of_their_own(spark):
    source = json.dumps(polygon(15, SQUARE))
    points = [1.0, 1.0, 20.0, 1.0, 20.254, 9.0, 1.0, 9.0]
    cases = [
        ("a", 0, " seller ", "x", None, points, source), ("b", 0, "NOPE", "x", None, points, None), ("c", 0, "SELLER", " ", None, points, None),
        ("d", 0, "QUANTITY", "1", None, points, None), ("e", 0, "SELLER", "x", None, points[:6], None), ("f", 0, "SELLER", "x", None, [-1.0, *points[1:]], None),
        ("g", 0, "SELLER", "x", None, [1.0] * 8, None),
    ]
    regions = spark.createDataFrame(cases, "img_id string, pos int, label string, text string, line_item_id long, points array<double>, source string")
    rows, refused = A.encode_regions(regions, spark.createDataFrame([(x, 100, 50) for x in "abcdefg"], "img_id string, width int, height int"))
    assert {r["img_id"]: r["code"] for r in refused.collect()} == {"b": "INVALID_CATEGORY", "c": "EMPTY_TEXT", "d": "LINE_ITEM_ID_MISSING", "e": "MISSING_SEGMENTATION", "f": "POLYGON_OUT_OF_IMAGE", "g": "DEGENERATE_POLYGON"}
    (r,) = rows.collect()
    assert r["anno_polygons"] == "[{'category_id': 15, 'segmentation': [[1, 1, 20, 1, 20.25, 9, 1, 9]], 'area': 153.02, 'bbox': [1, 1, 19.25, 8], 'width': 100, 'height': 50}]" and r["anno_labels"] == "SELLER"


def test_documents_of_three_files(spark):
    line = "1,1,20,1,20.5,9,1,9,Total, 5"
    entity = json.dumps({"company": "Shop", "address": "", "date": "01/02/2020", "total": "5"})
    cases = {
        "good": (f"{line}\n\n 2,2,20,2,20,9,2,9,*** \n", json.dumps({"company": "Shop", "address": "", "date": "x", "more": 1}), None),
        "none": ("", entity, None),
        "line": ("1,1,20,1,20.5,9,1,9", entity, "INVALID_BOX_LINE"),
        "number": (f"{line}\n1,1,2O,1,20.5,9,1,9,x\n1,2", entity, "INVALID_BOX_COORDINATE"),
        "finite": ("1,1,nan,1,20.5,9,1,9,x", entity, "NONFINITE_COORDINATE"),
        "out": ("1,1,200,1,20.5,9,1,9,x", entity, "POLYGON_OUT_OF_IMAGE"),
        "json": (line, "{", "INVALID_JSON"),
        "root": (line, "[1]", "INVALID_JSON_ROOT"),
        "value": (line, json.dumps({"company": 5}), "NONSTRING_ENTITY_VALUE"),
    }
    images = spark.createDataFrame([(k, 100, 50) for k in cases] + [("alone", 1, 1)], "img_id string, width int, height int")
    boxes = spark.createDataFrame([(k, v[0]) for k, v in cases.items()] + [("lost", line)], "img_id string, text string")
    entities = spark.createDataFrame([(k, v[1]) for k, v in cases.items()], "img_id string, text string")
    regions, fields, flags, refused = A.convert_pairs(images, boxes, entities)
    assert {r["img_id"]: (r["code"], r["missing"]) for r in refused.collect()} == {k: (v[2], []) for k, v in cases.items() if v[2]} | {"alone": ("MISSING_PAIRED_FILE", ["box", "entities"]), "lost": ("MISSING_PAIRED_FILE", ["image", "entities"])}
    assert {r["img_id"]: r["flags"] for r in flags.collect()} == {"good": ["ANNOTATED_EMPTY_ADDRESS", "SOURCE_MISSING_TOTAL", "UNCERTAIN_OCR_MARKER", "UNKNOWN_ENTITY_KEYS"], "none": ["ANNOTATED_EMPTY_ADDRESS"]}
    assert {r["field"]: (r["status"], r["raw_value"]) for r in fields.where("img_id = 'good'").collect()} == {"company": ("annotated", "Shop"), "address": ("annotated_empty", None), "date": ("annotated", "x"), "total": ("source_missing", None)}
    assert [(r["region_id"], r["text"], r["status"], r["bbox"]) for r in regions.orderBy("region_id").collect()] == [("r0001", "Total, 5", "unlabeled", [1.0, 1.0, 20.5, 9.0]), ("r0003", "*** ", "uncertain_marker", [2.0, 2.0, 20.0, 9.0])]
