"""Documents as rows: conversion, validation, tagging by rules, alignment of words to regions, post-processing."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as X
from ..functions.fields import amount_field, quantity_field
from .lineitems import infer_quantity
from .tagging import best_overlap, collect_warnings, header_hits

MONEY = "^-?[0-9]{1,3}([.,][0-9]{3})*([.,][0-9]{2})$"
#: Fixed value: a date with one separator throughout.
DATE = r"\d{1,2}\s*([./-])\s*\d{1,2}\s*\1\s*(?:\d{4}|\d{2})(?!\d)"
#: Fixed values of the rules over folded rows.  Words of a total, the strongest first, and words that rule a row out.
TOTAL_WORDS = (
    "tong so tien thanh toan", "tong so thanh toan", "tong thanh toan", "phai thanh toan", "phai t.toan", "can thanh toan", "khach phai tra",
    "thanh toan", "tong tien thanh toan", "tong cong", "tong tien", "cong tien hang", "tong", "total",
)
NOT_TOTAL = ("phuong thuc", "hinh thuc", "so luong", "khach dua", "khach tra", "tien mat", "tra lai", "tien thua", "giam", "chiet khau", "vat", "thue", "tich diem")
#: Words that end the items, names of item columns, and words of rows that are no items.
ITEMS_END = "tong|cong tien|thanh toan|total"
COLUMN_NAMES = ("ten hang", "dvt", "stt", "mat hang", "san pham", "don gia", "so luong", "thanh tien", "t.tien", "sl", "dg", "gia", "mon")
NOT_ITEM = ("gia goc", "vat", "giam gia", "chiet khau", "khuyen mai", "km", "thue")
#: Signs of an address, and of rows in the header that name no seller.
ADDRESS = (
    r"(^|\W)(dc|d/c|dia chi|duong|phuong|quan|huyen|xa|thon|ngo|ngach|kiot|cho|khu|to dan pho|tp|thanh pho|tinh"
    r"|p\.|q\.|tt\.|p\d|q\d|so \d+)(\W|$)|^\W*\d+[a-z]?(/\d+)*\s+[a-z]|\s\d{1,4}[a-z]?\s+[a-z]{2,}\s+[a-z]{2,}"
)
NOT_SELLER = (
    r"(hoa don|phieu|bien nhan|receipt|invoice|thu ngan|nhan vien|ma so thue|mst|hotline|dien thoai|website|www|wifi"
    r"|so hd|ma hd|ban hang|ngay|gio|khach hang|hot ?line|cskh|so the|quay|don gia|thanh tien|ten hang|so luong|(^|\W)(dt|tel|fax|sdt|sl|dvt)(\W|$))"
)
#: How many rows of the header may name the seller.
SELLER_ROWS = 4


def explode_cells(df: DataFrame, keys: list[str], cells: dict[str, Column]) -> DataFrame:
    """Parallel compound cells as one row per region; ``error`` where the counts disagree."""
    names = list(cells)
    made = df.select(*keys, *(c.alias(n) for n, c in cells.items()))
    same = F.size(F.array_distinct(F.array(*(F.size(n) for n in names)))) == 1
    good = made.where(same).select(*keys, F.posexplode(F.arrays_zip(*names)).alias("pos", "x")).select(*keys, "pos", *(F.col(f"x.{n}").alias(n) for n in names), F.lit(None).cast("string").alias("error"))
    bad = made.where(~same).select(*keys, F.lit(None).cast("int").alias("pos"), *(F.lit(None).cast(t.split("<", 1)[1][:-1]).alias(n) for n, t in made.dtypes if n in names), F.lit("COUNT_MISMATCH").alias("error"))
    return good.unionByName(bad)


def polygon_error(flat: Column, width: Column, height: Column) -> Column:
    """The first fault of a polygon ``x0 y0 x1 y1 ...``, null if it has none."""
    n = F.size(flat)
    xs = F.filter(flat, lambda _, i: i % 2 == 0)
    ys = F.filter(flat, lambda _, i: i % 2 == 1)
    return (
        F.when(flat.isNull() | (n < 6) | (n % 2 == 1), "TOO_FEW_POINTS")
        .when(F.exists(flat, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "NOT_FINITE")
        .when((F.array_min(xs) < 0) | (F.array_min(ys) < 0) | (F.array_max(xs) > width) | (F.array_max(ys) > height), "OUT_OF_IMAGE")
        .when(F.abs(polygon_area(xs, ys)) < 1e-9, "ZERO_AREA")
    )


def polygon_area(xs: Column, ys: Column) -> Column:
    """The signed area inside the points, by the trapezoids below its edges."""
    after = lambda c: F.concat(F.slice(c, F.lit(2), F.size(c)), F.slice(c, F.lit(1), F.lit(1)))
    each = F.zip_with(F.zip_with(xs, after(xs), lambda a, b: b - a), F.zip_with(ys, after(ys), lambda a, b: a + b), lambda w, h: w * h / 2)
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)


def decode_literal_list(cell: Column, element: str) -> Column:
    """A list in Python notation: single quotes and ``None`` (outside quotes) read as JSON does double ones and ``null``."""
    outside = F.regexp_replace(cell, "\\bNone\\b(?=(?:[^'\"]|'(?:[^'\\\\]|\\\\.)*+'|\"(?:[^\"\\\\]|\\\\.)*+\")*+$)", "null")
    return F.from_json(outside, f"array<{element}>", {"allowSingleQuotes": "true"})


def canonical_lines(lines: DataFrame, text: str, score: str) -> tuple[DataFrame, DataFrame]:
    """Engine output: scores within 1e-5 of the unit interval are clamped; others, and texts with U+FFFD, are refused; empty texts go."""
    eps = 1e-5
    error = F.when(F.col(text).contains("�"), "REPLACEMENT_CHARACTER").when((F.col(score) < -eps) | (F.col(score) > 1 + eps) | F.isnan(score), "SCORE_RANGE")
    tagged = lines.withColumn("error", error)
    good = tagged.where("error is null").where(F.trim(text) != "").withColumn(score, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))).drop("error")
    return good, tagged.where("error is not null")


def tag_rows(rows: DataFrame, doc: str, row: str, text: str, height: str | None = None) -> DataFrame:
    """``rows`` with ``label``: time, total, seller, address, item or none, by rules over whole rows.

    The time is the first row with a date.  Of the rows with a total word and none that excludes them,
    those count that hold an amount or whose next row does: the strongest word, then the first row,
    gives the total, on the row of its amount.  The header is what stands above the row of column names
    (if that is not below the first amount), else above the first amount and not below the time; without
    any of these there is none.  Addresses are header rows with a sign of one; the seller is the tallest
    (the upper of equals, all equal without ``height``) of the first four other header rows that have
    three letters and as many digits as other characters at most.  Items are rows below the header that
    end in an amount, above the first row that names a total.  A null text is an empty one.
    """
    folded = F.coalesce(X.fold(F.col(text)), F.lit(""))
    # One pattern for all words that rule a row out, none of which lies in a total word; and the total words only where it fails.
    one_of = lambda words: "|".join(f"\\Q{w}\\E" for w in words)
    between = lambda words: f"(^|[^a-z0-9])({one_of(words)})([^a-z0-9]|$)"
    strength = F.when(~F.col("__text").rlike(one_of(NOT_TOTAL)), F.coalesce(*(F.when(F.col("__text").contains(w), F.lit(i)) for i, w in enumerate(TOTAL_WORDS))))
    money = lambda w: w.rlike(MONEY)
    letters, numbers = F.length(F.regexp_replace("__text", "[^a-z]", "")), F.length(F.regexp_replace("__text", "[^0-9]", ""))
    marks = {
        "__date": F.coalesce(F.col(text).rlike(DATE), F.lit(False)),
        "__amount": F.exists("__words", money),
        "__ends": money(F.element_at("__words", -1)),
        "__named": F.when(F.col("__text").rlike(between(COLUMN_NAMES)), header_hits(F.col("__text"), list(COLUMN_NAMES)) >= 2).otherwise(False),
        "__stop": F.col("__text").rlike(ITEMS_END),
        "__place": F.col("__text").rlike(ADDRESS) & ~F.col("__text").rlike(NOT_SELLER),
        "__strength": strength,
    }
    r, every, down = F.col(row), Window.partitionBy(doc), Window.partitionBy(doc).orderBy(row)
    marked = rows.withColumn("__text", folded).withColumn("__words", F.split(F.trim("__text"), " +")).withColumns(marks)
    amount_at = F.when(F.col("__amount"), r).when(F.lead("__amount").over(down), F.lead(row).over(down))
    found = marked.withColumn("__at", F.when(F.col("__strength").isNotNull(), amount_at))
    facts = found.withColumns({
        "__time": F.min(F.when(F.col("__date"), r)).over(every),
        "__total": F.min(F.when(F.col("__at").isNotNull(), F.struct("__strength", r.alias("r"), "__at"))).over(every)["__at"],
        "__money": F.min(F.when(F.col("__amount"), r)).over(every),
        "__table": F.min(F.when(F.col("__named"), r)).over(every),
    })
    named = F.col("__table").isNotNull() & (F.col("__money").isNull() | (F.col("__table") <= F.col("__money")))
    above = (F.col("__money").isNull() | (r < F.col("__money"))) & (F.col("__time").isNull() | (r <= F.col("__time"))) & (F.col("__money").isNotNull() | F.col("__time").isNotNull())
    after = F.when(F.col("__stop") & (F.col("__table").isNull() | (r > F.col("__table"))), r)
    free = (F.col("__total").isNull() | (r != F.col("__total"))) & ~F.col("__date")
    zoned = facts.withColumns({"__head": F.when(named, r < F.col("__table")).otherwise(above), "__items_end": F.least(F.min(after).over(every), "__total")})
    placed = zoned.withColumn("__address", F.col("__head") & free & F.col("__place"))
    able = F.col("__head") & free & ~F.col("__address") & ~F.col("__text").rlike(NOT_SELLER) & (letters >= 3) & (numbers * 2 <= F.length("__text"))
    counted = placed.withColumn("__able", able).withColumn("__nth", F.sum(F.col("__able").cast("int")).over(down))
    tall = F.struct((-F.col(height) if height else F.lit(0)).alias("h"), r.alias("r"))
    label = (
        F.when(r == F.col("__total"), "TOTAL_COST")
        .when(r == F.col("__time"), "TIMESTAMP")
        .when(F.col("__address"), "ADDRESS")
        .when(r == F.col("__seller"), "SELLER")
        .when(~F.col("__head") & F.col("__ends") & ~F.col("__text").rlike(between(NOT_ITEM)) & (~named | (r > F.col("__table"))) & (F.col("__items_end").isNull() | (r < F.col("__items_end"))), "ITEM")
    )
    seller = F.min(F.when(F.col("__able") & (F.col("__nth") <= SELLER_ROWS), tall)).over(every)["r"]
    return counted.withColumn("__seller", seller).withColumn("label", label).select(*rows.columns, "label")


def align_words(words: DataFrame, regions: DataFrame, doc: str) -> DataFrame:
    """``doc, word, tag``: a region's words, in order, get ``B-`` then ``I-`` of its label; words half covered
    (0.2 to 0.5) are ``IGNORE``, the rest ``O``."""
    found = best_overlap(words, regions, doc, 0.2)
    labelled = words.select(doc, "word").join(found, [doc, "word"], "left").join(regions.select(doc, "region", "label"), [doc, "region"], "left")
    inside = labelled.withColumn("sure", F.coalesce(F.col("cover") >= 0.5, F.lit(False)))
    first = F.row_number().over(Window.partitionBy(doc, "region", "sure").orderBy("word"))
    tag = F.when(F.col("sure"), F.concat(F.when(first == 1, "B-").otherwise("I-"), F.col("label"))).when(F.col("cover").isNotNull(), "IGNORE").otherwise("O")
    return inside.select(doc, "word", tag.alias("tag"))


def first_subtoken_labels(words: DataFrame, keys: list[str], pieces: Column, tag: Column) -> DataFrame:
    """Sub-tokens of words with labels: the first carries the word's tag, the others ``IGNORE``."""
    each = words.select(*keys, tag.alias("tag"), F.posexplode(pieces).alias("sub", "piece"))
    return each.select(*keys, "sub", "piece", F.when(F.col("sub") == 0, F.col("tag")).otherwise("IGNORE").alias("label"))


def postprocess(items: DataFrame, doc: str, item: str, quantity: str, price: str, total: str) -> DataFrame:
    """Per document a message of normalised items: amounts as plain strings, quantities inferred where missing, warnings."""
    money = lambda c: amount_field(F.col(c), F.lit("vi-VN"))["value"]
    dec = lambda c: F.coalesce(F.col(c).try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    # Each step is a projection of its own, so that what several later ones need is compiled and worked out once.
    read = items.select(doc, F.col(item).alias("__item"), quantity_field(F.col(quantity))["value"].alias("__q"), money(price).alias("__p"), money(total).alias("__t"))
    guessed = read.withColumn("__g", infer_quantity(F.col("__q").try_cast("decimal(18,3)"), dec("__p"), dec("__t")).cast("string")).withColumn("__g", N.strip_zeros(F.col("__g")))
    row = F.struct(F.col("__item").alias("item"), F.col("__g").alias("quantity"), F.col("__p").alias("price"), F.col("__t").alias("total"), (F.col("__q").isNull() & F.col("__g").isNotNull()).alias("inferred"))
    per = guessed.groupBy(doc).agg(F.sort_array(F.collect_list(row)).alias("items"))
    count = lambda test: F.size(F.filter("items", test)).cast("long")
    facts = per.withColumns({"inferred": count(lambda x: x["inferred"]), "unknown": count(lambda x: x["quantity"].isNull())})
    return facts.withColumn("warnings", collect_warnings({"quantity_inferred": F.col("inferred") > 0, "quantity_missing": F.col("unknown") > 0}))
