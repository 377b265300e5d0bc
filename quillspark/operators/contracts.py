"""Contracts between tables: strict joins, inventories, key sets, exclusions, and the statistics reported on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted


def strict_join(left: DataFrame, right: DataFrame, keys: list[str], sizes: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The inner join, and the rows of ``left`` at fault with ``error``: ``MISSING`` partner, or arrays of unequal ``LENGTH``."""
    both = left.join(right.withColumn("__hit", F.lit(True)), keys, "left")
    uneven = F.size(sizes[0]) != F.size(sizes[1]) if sizes else F.lit(False)
    error = F.when(F.col("__hit").isNull(), "MISSING").when(uneven, "LENGTH")
    tagged = both.withColumn("error", error)
    return tagged.where("error is null").drop("__hit", "error"), tagged.where("error is not null").select(*left.columns, "error")


def inventory_mismatches(found: DataFrame, listed: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """``keys, faults`` of every key that is missing, unlisted, or differs in an attribute (null equals null)."""
    a = found.select(*keys, F.struct(*attributes).alias("f"))
    b = listed.select(*keys, F.struct(*attributes).alias("l"))
    both = a.join(b, keys, "full_outer")
    differs = [F.when(F.col("f").isNotNull() & F.col("l").isNotNull() & ~F.col(f"f.{c}").eqNullSafe(F.col(f"l.{c}")), F.lit(c)) for c in attributes]
    faults = F.array_compact(F.array(F.when(F.col("f").isNull(), "missing"), F.when(F.col("l").isNull(), "unlisted"), *differs))
    return both.select(*keys, faults.alias("faults")).where("size(faults) > 0")


def drop_touching(members: DataFrame, group: str, split: str, protected: str, dropped: str) -> DataFrame:
    """``members`` without the rows of split ``dropped`` whose group has a row in ``protected``."""
    touching = members.where(F.col(split) == protected).select(group).distinct()
    hit = members.where(F.col(split) == dropped).join(touching, group, "left_anti")
    return members.where(~F.col(split).eqNullSafe(F.lit(dropped))).unionByName(hit)


def overlap_join(words: DataFrame, spans: DataFrame, doc: str, start: str, end: str, least: float | None = None) -> DataFrame:
    """Words and spans ``[start, end)`` of one document that overlap; with ``least``, by that share of the word at least."""
    w = words.withColumnsRenamed({start: "w_start", end: "w_end"})
    s = spans.withColumnsRenamed({start: "s_start", end: "s_end"})
    common = F.least("w_end", "s_end") - F.greatest("w_start", "s_start")
    test = common > 0 if least is None else (common > 0) & (common >= least * (F.col("w_end") - F.col("w_start")))
    return w.join(s, doc).withColumn("common", common).where(test)


def key_set_faults(rows: DataFrame, doc: str, field: str, expected: list[str]) -> DataFrame:
    """``doc, missing, unknown, repeated`` of documents whose fields are not exactly ``expected``."""
    want = F.array(*(F.lit(x) for x in expected))
    per = rows.groupBy(doc).agg(F.array_sort(F.collect_set(field)).alias("have"), F.count(field).alias("n"))
    out = per.select(doc, F.array_except(want, "have").alias("missing"), F.array_except("have", want).alias("unknown"), (F.col("n") - F.size("have")).alias("repeated"))
    return out.where("size(missing) > 0 or size(unknown) > 0 or repeated > 0")


def with_all_fields(rows: DataFrame, doc: str, field: str, expected: list[str], status: str, default: str = "unlabeled") -> DataFrame:
    """``rows`` and, for each expected field a document lacks, a row with ``default`` and nulls."""
    docs = rows.select(doc).distinct().withColumn(field, F.explode(F.array(*(F.lit(x) for x in expected))))
    # Slots are many times the documents they come from, which the planner's sizes do not show: never a broadcast.
    return docs.join(rows.hint("merge"), [doc, field], "left").withColumn(status, F.coalesce(status, F.lit(default)))


def key_sets(rows: DataFrame, split: str, key: str) -> DataFrame:
    """The distinct keys of each split in order, and how many."""
    return rows.groupBy(split).agg(F.array_sort(F.collect_set(key)).alias("keys")).withColumn("n", F.size("keys").cast("long"))


def excluded_keys_found(accepted: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that must not be in ``accepted`` and are."""
    return excluded.select(*keys).distinct().join(accepted, keys, "left_semi")


def same_sets(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, repeats and order aside."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def recall_by_label(regions: DataFrame, label: str, found: Column, merged: Column, inside: Column) -> DataFrame:
    """One row: recall per label folded to its mean and least, and over all regions the merged and crop-inside rates."""
    per = regions.groupBy(label).agg(F.avg(found.cast("double")).alias("recall"), F.count("*").alias("n"), F.sum(merged.cast("long")).alias("merged"), F.sum(inside.cast("long")).alias("inside"))
    return per.agg(F.min("recall").alias("min_recall"), F.avg("recall").alias("mean_recall"), (F.sum("merged") / F.sum("n")).alias("merged_rate"), (F.sum("inside") / F.sum("n")).alias("inside_rate"))


def alignment_summary(regions: DataFrame, label: str, matched: str, cer: str, exact: Column) -> DataFrame:
    """Per label: regions, match rate, and over the matched mean, median error rate and exact share, to four places."""
    hit = F.col(matched)
    r4 = lambda c: F.bround(c, 4)
    return regions.groupBy(label).agg(
        F.count("*").alias("regions"),
        r4(F.avg(hit.cast("double"))).alias("match_rate"),
        r4(F.avg(F.when(hit, F.col(cer)))).alias("mean_cer"),
        r4(F.median(F.when(hit, F.col(cer)))).alias("median_cer"),
        r4(F.avg(F.when(hit, exact.cast("double")))).alias("exact_rate"),
    )


def order_agreement(members: DataFrame, doc: str, label: str, source: str, reading: list[str]) -> DataFrame:
    """Per label: fields with two members or more, and the share whose reading order is the source's, to four places."""
    each = members.groupBy(doc, label).agg(F.array_sort(F.collect_list(source)).alias("a"), F.transform(F.array_sort(F.collect_list(F.struct(*reading, source))), lambda x: x[source]).alias("b"))
    same = (F.col("a") == F.col("b")).cast("double")
    return each.where("size(a) > 1").groupBy(label).agg(F.count("*").alias("fields"), F.bround(F.avg(same), 4).alias("same_order"))


def confidence(words: DataFrame, doc: str, entity: str, score: str) -> DataFrame:
    """Per document: the least entity score over its least word scores, and the mean over labelled words (0 if none)."""
    per = words.groupBy(doc, entity).agg(F.min(score).alias("low"), F.sum(score).alias("total"), F.count(score).alias("n"))
    labelled = F.col(entity).isNotNull()
    return per.groupBy(doc).agg(F.min(F.when(labelled, F.col("low"))).alias("field_confidence"), F.coalesce(F.sum(F.when(labelled, F.col("total"))) / F.sum(F.when(labelled, F.col("n"))), F.lit(0.0)).alias("overall"))


def most_confident(rows: DataFrame, keys: list[str], value: str, score: str, rank: str) -> DataFrame:
    """Per key the value with the highest score (null as 0); of equal ones the first by ``rank``."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.coalesce(score, F.lit(0.0)), -F.col(rank))).alias(value))


def long_metrics(rows: DataFrame, scope: str, metrics: list[str]) -> DataFrame:
    """``scope, metric, value``: wide metrics as rows, with numbers to twelve significant digits as text and nulls empty."""
    wide = rows.select(scope, *(F.col(m).cast("double").alias(m) for m in metrics))
    text = lambda c: F.when(c.isNull(), "").otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.12f", c), "0+$", ""), "[.]$", ""))
    return wide.unpivot([scope], metrics, "metric", "value").withColumn("value", text(F.col("value")))


def slot_coverage(rows: DataFrame, dims: list[str], status: str) -> DataFrame:
    """Per group: slots, those that can be evaluated (annotated or absent), and their share."""
    able = F.col(status).isin("annotated", "absent")
    return rows.groupBy(*dims).agg(F.count("*").alias("slots"), F.count_if(able).alias("evaluable"), F.avg(able.cast("double")).alias("coverage"))


def out_of_vocabulary(texts: DataFrame, text: str, vocabulary: DataFrame, char: str) -> DataFrame:
    """Characters of the texts that the vocabulary lacks, with how often they occur."""
    each = texts.select(F.explode(F.split(text, "")).alias(char)).where(F.col(char) != "").groupBy(char).agg(F.count("*").alias("n"))
    return each.join(vocabulary, char, "left_anti")


def plausible_text(text: Column, quad: Column, per_height: float = 5.0) -> Column:
    """Whether a quad ``x0 y0 ... x3 y3`` can hold the text: its characters, blanks aside, within ``per_height`` times long by short side, plus one."""
    side = lambda i, j: F.sqrt(F.pow(quad[2 * i] - quad[2 * j], F.lit(2)) + F.pow(quad[2 * i + 1] - quad[2 * j + 1], F.lit(2)))
    width, height = (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2
    return F.char_length(F.replace(text, F.lit(" "))) <= per_height * F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1.0)) + 1


def filter_boxes(boxes: DataFrame, doc: str, score: str, box: tuple[str, str, str, str], min_score: float, min_height: float, min_boxes: int) -> DataFrame:
    """Boxes of enough score, height and some width, of documents that keep ``min_boxes`` of them."""
    x0, y0, x1, y1 = box
    good = boxes.where((F.col(score) >= min_score) & (F.col(y1) - F.col(y0) >= min_height) & (F.col(x1) > F.col(x0)))
    return good.join(good.groupBy(doc).count().where(F.col("count") >= min_boxes).select(doc), doc)


def crop_rectangles(boxes: DataFrame, doc: str, box: tuple[str, str, str, str], width: float, height: float, link: float = 6.0, margin: float = 1.0, page_margin: float = 0.01, most: float = 0.9) -> DataFrame:
    """``doc, x0, y0, x1, y1`` around the largest cluster of a document's boxes; none where it is nearly the whole page.

    Boxes closer than ``link`` median heights are of one cluster; the largest has most area (of equal
    ones, that with the first box).  A fold over one document's boxes.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        rects = [r[1:5] for r in rows]
        heights = sorted(r[3] - r[1] for r in rects)
        n = len(heights)
        tall = (heights[(n - 1) // 2] + heights[n // 2]) / 2
        near = lambda a, b: max(a[0], b[0]) - min(a[2], b[2]) <= link * tall and max(a[1], b[1]) - min(a[3], b[3]) <= link * tall
        clusters: list[list[int]] = []
        for i, r in enumerate(rects):
            met = [c for c in clusters if any(near(r, rects[j]) for j in c)]
            clusters = [c for c in clusters if c not in met] + [sorted([i, *(j for c in met for j in c)])]
        main = [rects[i] for i in max(sorted(clusters), key=lambda c: sum((rects[i][2] - rects[i][0]) * (rects[i][3] - rects[i][1]) for i in c))]
        pad = max(margin * tall, page_margin * max(width, height))
        a, b = max(0, int(min(r[0] for r in main) - pad)), max(0, int(min(r[1] for r in main) - pad))
        c, d = min(int(width), int(max(r[2] for r in main) + pad + 1)), min(int(height), int(max(r[3] for r in main) + pad + 1))
        return [] if (c - a) * (d - b) >= most * width * height else [(rows[0][0], a, b, c, d)]

    kind = dict(boxes.dtypes)[doc]
    return fold_sorted(boxes.select(doc, *box), [doc], list(box), fold, f"{doc} {kind}, x0 int, y0 int, x1 int, y1 int")


def evidence_boxes(words: DataFrame, doc: str, line: str, box: tuple[str, str, str, str], scale_x: Column, scale_y: Column) -> DataFrame:
    """One rectangle per line around its words' boxes, scaled to pixels and rounded half to even."""
    x0, y0, x1, y1 = box
    scaled = lambda f, c, s: F.bround(f(F.col(c) * s), 0).cast("long").alias(c)
    return words.groupBy(doc, line).agg(scaled(F.min, x0, scale_x), scaled(F.min, y0, scale_y), scaled(F.max, x1, scale_x), scaled(F.max, y1, scale_y))


def comparison_key(field: Column, value: Column, text_fields: list[str], match: Callable[[Column], Column], raw: Column) -> Column:
    """What values are compared by: texts, and all raw values, by their match key; others as they are."""
    return F.when(raw | field.isin(*text_fields), match(value)).otherwise(value)


def caption_length(tokens: Column, most: int = 3) -> Column:
    """How many of the first ``most`` tokens, digit-free up to one that ends with a colon, are a caption; 0 where nothing follows."""
    heads = F.slice(tokens, 1, most)
    colon = F.array_position(F.transform(heads, lambda t: t.endswith(":")), True).cast("int")
    digit = F.exists(F.slice(heads, F.lit(1), F.greatest(colon, F.lit(0))), lambda t: t.rlike("[0-9]"))
    return F.when((colon > 0) & ~digit & (F.size(tokens) > colon), colon).otherwise(0)


def caption_split(text: Column) -> Column:
    """Words, with a blank put after a colon that a letter precedes and text follows."""
    return F.filter(F.split(F.regexp_replace(text, "(?<=\\p{L}:)(?=\\S)", " "), "\\s+"), lambda w: w != "")


def ids_from_paths(paths: DataFrame, path: str, accepted: DataFrame, key: str) -> DataFrame:
    """Accepted ids that the last parts of paths name, as they are or without their ending."""
    name = F.regexp_extract(path, "([^/]*)/?$", 1)
    each = paths.select(F.explode(F.array_distinct(F.array(name, F.regexp_replace(name, "(?<=.)[.][^.]*$", "")))).alias(key))
    return each.distinct().join(accepted.select(key).distinct(), key)


def positive_list(cell: Column, length: Column) -> Column:
    """A JSON list of integers above 0 of the given length, else null."""
    xs = F.from_json(cell, "array<bigint>")
    return F.when((F.size(xs) == length) & ~F.exists(xs, lambda x: x.isNull() | (x <= 0)), xs)


def plain_number(value: Column) -> Column:
    """A number to two decimals as text, whole ones without a point."""
    r = F.bround(value, 2)
    return F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", r), "0$", ""))


def first_tag_per_word(tokens: DataFrame, keys: list[str], position: str, tag: str, ids: DataFrame) -> DataFrame:
    """Each word's first token's tag, as its number in ``ids`` (``tag, tag_id``)."""
    return tokens.groupBy(*keys).agg(F.min_by(tag, position).alias(tag)).join(ids, tag).select(*keys, "tag_id")


def token_window_stats(tokens: DataFrame, doc: str, tokens_col: str, windows: DataFrame) -> DataFrame:
    """One row: documents, words, tokens, the longest word, and windows in all and at most per document."""
    a = tokens.agg(F.count_distinct(doc).alias("documents"), F.count("*").alias("words"), F.sum(tokens_col).alias("tokens"), F.max(tokens_col).alias("longest"))
    b = windows.groupBy(doc).agg(F.count("*").alias("n")).agg(F.sum("n").alias("windows"), F.max("n").alias("most_windows"))
    return a.unionByName(b, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in (*a.columns, *b.columns)))


def state_of_images(images: DataFrame, key: str, completed: DataFrame, flagged: DataFrame, rotations: DataFrame, missing: DataFrame) -> DataFrame:
    """The image list with what the sidecar tables say: flags, rotation (0 to 359) and the fields marked as missing."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    lists = missing.groupBy(key).agg(F.array_sort(F.collect_set("field")).alias("missing"))
    out = images.join(flag(completed, "completed"), key, "left").join(flag(flagged, "flagged"), key, "left").join(rotations, key, "left").join(lists, key, "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"completed": F.coalesce("completed", F.lit(False)), "flagged": F.coalesce("flagged", F.lit(False)), "rotation": F.coalesce(F.pmod("rotation", F.lit(360)), F.lit(0)), "missing": F.coalesce("missing", none)})


def replace_missing(state: DataFrame, updates: DataFrame, key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Sidecar entries ``key, fields`` after updates: each replaces its entry, an empty one deletes it; and the refused updates."""
    tagged = updates.withColumn("__ok", F.coalesce(valid, F.lit(False)))
    good = tagged.where("__ok").drop("__ok").withColumn("fields", F.array_sort(F.array_distinct("fields")))
    kept = state.join(good.select(key), key, "left_anti").unionByName(good).where("size(fields) > 0")
    return kept, tagged.where("not __ok").drop("__ok")


def artifact_faults(rows: DataFrame, keys: list[str], raw: str, source: DataFrame, status: str, value: str, warnings: str, known: list[str]) -> DataFrame:
    """``fault, n`` of a normalised table: repeated keys, raw values changed, warnings outside the closed set, values that contradict their status."""
    repeated = rows.groupBy(*keys).count().where("count > 1").select(F.lit("REPEATED_KEY").alias("fault"))
    both = rows.join(source.select(*keys, F.col(raw).alias("__raw")), keys, "left")
    closed = F.array(*(F.lit(w) for w in known))
    tests = [(~F.col(raw).eqNullSafe(F.col("__raw")), "RAW_CHANGED"), (F.size(F.array_except(warnings, closed)) > 0, "UNKNOWN_WARNING"), ((F.col(status) == "ok") != F.col(value).isNotNull(), "STATUS_VALUE")]
    faults = both.select(F.explode(F.array_compact(F.array(*(F.when(t, n) for t, n in tests)))).alias("fault"))
    return repeated.unionByName(faults).groupBy("fault").agg(F.count("*").alias("n"))


def subtoken_faults(tokens: DataFrame, keys: list[str], position: str, label: str) -> DataFrame:
    """Words whose first sub-token has no label, or whose later ones have: counts of both."""
    per = tokens.groupBy(*keys).agg(F.min_by(label, position).alias("first"), F.count_if(F.col(label) != "IGNORE").alias("labelled"))
    bare = F.col("first") == "IGNORE"
    return per.agg(F.count("*").alias("words"), F.count_if(bare).alias("first_unlabelled"), F.count_if(F.col("labelled") > F.when(bare, 0).otherwise(1)).alias("later_labelled"))


def coordinate_error(a: Column, b: Column) -> Column:
    """The largest absolute difference of two lists of coordinates; null where their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0)))


def inside_image(flat: Column, width: Column, height: Column, tolerance: float = 1e-6) -> Column:
    """Whether all points ``x0 y0 x1 y1 ...`` lie in the image, to within ``tolerance``."""
    return F.forall(F.transform(flat, lambda v, i: (v >= -tolerance) & (v <= F.when(i % 2 == 0, width).otherwise(height) + tolerance)), lambda ok: ok)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """The common area of two boxes ``x0 y0 x1 y1`` as a share of the smaller one."""
    side = lambda i: F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0.0))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    small = F.least(area(a), area(b))
    return F.when(small > 0, side(0) * side(1) / small).otherwise(0.0)


def load_split(rows: DataFrame, rotations: DataFrame, missing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Annotation rows with their rotation, which every row must have, and their missing fields, which few have; and the rows without a rotation."""
    good, bad = strict_join(rows, rotations, [key])
    lists = missing.groupBy(key).agg(F.array_sort(F.collect_set("field")).alias("missing"))
    return good.join(lists, key, "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>"))), bad


def export_package(records: DataFrame, kind: str, expected: dict[str, int], copies: DataFrame, key: str, digest: str) -> DataFrame:
    """``check, ok``: each kind has as many records as expected, no other kind is there, and every copy has its record's digest."""
    counts = records.groupBy(kind).agg(F.count("*").alias("n"))
    per = counts.agg(*(F.coalesce(F.max(F.when(F.col(kind) == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in expected), F.count_if(~F.col(kind).isin(*expected)).alias("other"))
    tests = [F.struct(F.lit(f"{k}_count").alias("check"), (F.col(f"n_{k}") == n).alias("ok")) for k, n in expected.items()]
    named = per.select(F.explode(F.array(*tests, F.struct(F.lit("known_kinds").alias("check"), (F.col("other") == 0).alias("ok")))).alias("c")).select("c.*")
    same = records.select(key, F.col(digest).alias("__want")).join(copies.select(key, F.col(digest).alias("__have")), key, "left")
    return named.unionByName(same.agg(F.lit("digests").alias("check"), F.coalesce(F.every(F.col("__want").eqNullSafe(F.col("__have"))), F.lit(True)).alias("ok")))


def item_label_fault(label: Column, item_id: Column, category: Column, item_labels: list[str], categories: dict[str, int]) -> Column:
    """The first fault of an annotated region: an item id without an item label or the other way round, or another category than the label's."""
    is_item = label.isin(*item_labels)
    code = F.coalesce(*(F.when(label == k, F.lit(v)) for k, v in categories.items()))
    return F.when(code.isNull(), "UNKNOWN_LABEL").when(is_item & item_id.isNull(), "ITEM_ID_MISSING").when(~is_item & item_id.isNotNull(), "ITEM_ID_UNEXPECTED").when(~category.eqNullSafe(code), "CATEGORY_MISMATCH")


def subset_or_all(rows: DataFrame, key: str, wanted: list[str] | None) -> DataFrame:
    """The rows of the wanted keys, or all where none are named."""
    return rows.where(F.col(key).isin(*wanted)) if wanted else rows


def rescaled_lines(lines: DataFrame, doc: str, order: str, columns: dict[str, Column]) -> DataFrame:
    """Cached lines in reading order, each coordinate times its factor."""
    return lines.withColumns({c: F.col(c) * f for c, f in columns.items()}).withColumn("position", F.row_number().over(Window.partitionBy(doc).orderBy(order)))


def low_match(aligned: DataFrame, doc: str, matched: str, least: float = 0.9) -> DataFrame:
    """Documents that match less than ``least`` of their regions, with the rate."""
    return aligned.groupBy(doc).agg(F.avg(F.col(matched).cast("double")).alias("rate")).where(F.col("rate") < least)


def same_points(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether two lists of coordinates are of one length and nowhere further apart than ``tolerance``."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))), lambda ok: ok)


#: For each of the eight image orientations, the matrix (row by row) that turns a stored point into a
#: shown one; ``w`` and ``h`` stand for the stored width and height less one.
ORIENTATIONS = {
    1: ((1, 0, "0"), (0, 1, "0")),
    2: ((-1, 0, "w"), (0, 1, "0")),
    3: ((-1, 0, "w"), (0, -1, "h")),
    4: ((1, 0, "0"), (0, -1, "h")),
    5: ((0, 1, "0"), (1, 0, "0")),
    6: ((0, -1, "h"), (1, 0, "0")),
    7: ((0, -1, "h"), (-1, 0, "w")),
    8: ((0, 1, "0"), (-1, 0, "w")),
}


def orientation_matrix(orientation: Column, width: Column, height: Column) -> Column:
    """The nine numbers of an orientation's matrix; null for an unknown one."""
    shift = {"0": F.lit(0.0), "w": (width - 1).cast("double"), "h": (height - 1).cast("double")}
    rows = {k: F.array(*(F.lit(float(x)) if isinstance(x, int) else shift[x] for row in m for x in row), F.lit(0.0), F.lit(0.0), F.lit(1.0)) for k, m in ORIENTATIONS.items()}
    return F.coalesce(*(F.when(orientation == k, m) for k, m in rows.items()))
