"""Queries over receipts made from orders and their lines: conversion, tagging, alignment, post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..functions import text as X
from ..operators import documents
from ..operators.folds import fold_sorted
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


def _receipts(spark, sf_dir):
    """Rows of text with heights per order: a heading, names, address, date, lines, discount, total (on its row or the next)."""
    n = lambda c: F.format_string("%,.2f", c)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d"), "o_custkey", "o_orderdate", "o_totalprice")
    cust, price = F.col("o_custkey").cast("string"), n(F.col("o_totalprice"))
    at = lambda row, height, *text: F.struct(F.lit(row).alias("row"), F.lit(height).alias("height"), F.concat(*(F.lit(t) if isinstance(t, str) else t for t in text)).alias("text"))
    odd = F.col("d") % 2 == 1
    head = [at(1, 40, "Phiếu bán hàng ", cust), at(2, 10, "Welcome all"), at(3, 30, "Store ", cust), at(4, 50, cust, " Đường Dài"), at(5, 10, "Ngày ", F.date_format("o_orderdate", "dd/MM/yyyy"))]
    tail = [at(50, 10, "Giảm giá 100.00"), at(51, 10, "Tổng cộng", F.when(odd, F.concat(F.lit(" "), price)).otherwise("")), at(52, 10, F.when(odd, "Tiền mặt ").otherwise(""), price), at(53, 10, "Tiền thừa 0.00")]
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("k")).agg(F.min("l_extendedprice").alias("v")).select("d", (F.col("k") + 10).alias("row"), F.lit(10).alias("height"), F.concat(F.lit("Thing x "), n(F.col("v"))).alias("text"))
    ends = o.select("d", F.inline(F.array(*head, *tail)))
    return ends.unionByName(items)


@query("""with i as (select distinct l_orderkey as d, l_linenumber as k from lineitem),
x as (select o_orderkey as d, unnest([1, 2, 3, 4, 5, 50, 51, 52, 53]) as r from orders union all select d, k + 10 from i)
select case when r = 3 then 'SELLER' when r = 4 then 'ADDRESS' when r = 5 then 'TIMESTAMP' when r = case when d % 2 = 1 then 51 else 52 end then 'TOTAL_COST' when r between 11 and 20 then 'ITEM' end as label, count(*) as n from x group by 1""")
def rule_tagging(spark, sf_dir):
    """Rows of receipts by the rule tagger; the receipts' construction says what each row is."""
    return documents.tag_rows(_receipts(spark, sf_dir), "d", "row", "text", "height").groupBy("label").agg(F.count("*").alias("n"))


_BOXES = """w as (select l_orderkey as d, l_linenumber as word, cast(min(l_partkey) % 200 as double) as x0 from lineitem group by 1, 2),
r as (select d, n as region, case n when 0 then 'NAME' when 1 then 'PRICE' else 'TOTAL' end as label, n * 70.0 as x0, n * 70.0 + 60.0 as x1 from (select distinct l_orderkey as d from lineitem), range(0, 3) t(n))"""


@query(f"""with {_BOXES}, j as (select w.d, word, region, label, greatest(0, least(w.x0 + 30, r.x1) - greatest(w.x0, r.x0)) / 30.0 as cover from w join r on w.d = r.d),
b as (select *, row_number() over (partition by d, word order by cover desc, region) as k from j where cover >= 0.2),
a as (select w.d, w.word, b.region, b.label, b.cover, coalesce(b.cover >= 0.5, false) as sure from w left join b on w.d = b.d and w.word = b.word and b.k = 1),
t as (select *, row_number() over (partition by d, region, sure order by word) as n from a)
select d, word, case when sure then case when n = 1 then 'B-' else 'I-' end || label when cover is not null then 'IGNORE' else 'O' end as tag from t""")
def word_alignment(spark, sf_dir):
    """Words of a page against three regions: tags by cover and order."""
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("word")).agg((F.min("l_partkey") % 200).cast("double").alias("x0")).withColumns({"y0": F.lit(20.0), "x1": F.col("x0") + 30, "y1": F.lit(30.0)})
    n = F.explode(F.sequence(F.lit(0), F.lit(2)))
    r = w.select("d").distinct().select("d", n.alias("region")).withColumns({"label": F.element_at(F.array(F.lit("NAME"), F.lit("PRICE"), F.lit("TOTAL")), F.col("region") + 1), "x0": F.col("region") * 70.0, "y0": F.lit(10.0), "x1": F.col("region") * 70.0 + 60.0, "y1": F.lit(40.0)})
    return documents.align_words(w, r, "d")


@query("""with c as (select p_partkey, case when p_partkey % 5 = 0 then 2 else 3 end as values from part)
select p_partkey, case when values = 3 then cast(k as int) else -1 end as pos, case when values = 3 then 'L' || k end as label, case when values = 3 then p_name || k end as value, case when values = 2 then 'COUNT_MISMATCH' end as error
from c join part using (p_partkey), range(0, 3) t(k) where values = 3 or k = 0""")
def compound_rows(spark, sf_dir):
    """Parallel cells, delimited by bars, as rows; rows whose counts disagree are refused."""
    name = F.col("p_name")
    labels = F.lit("L0|||L1|||L2")
    values = F.when(F.col("p_partkey") % 5 == 0, F.concat_ws("|||", name, name)).otherwise(F.concat_ws("|||", *(F.concat(name, F.lit(str(i))) for i in range(3))))
    rows = documents.explode_cells(table(spark, sf_dir, "part"), ["p_partkey"], {"label": X.split_compound(labels), "value": X.split_compound(values)})
    return rows.withColumn("pos", F.coalesce("pos", F.lit(-1)))


@query("""with p as (select case p_partkey % 5 when 0 then 'TOO_FEW_POINTS' when 1 then 'NOT_FINITE' when 2 then 'ZERO_AREA' when 3 then case when p_size > 40 then 'OUT_OF_IMAGE' end end as error from part) select error, count(*) as n from p group by 1""")
def polygon_checks(spark, sf_dir):
    """Polygons with each kind of fault: the first is named."""
    s, k = F.col("p_size").cast("double"), F.col("p_partkey") % 5
    z = F.lit(0.0)
    flat = F.when(k == 0, F.array(z, z, s, s)).when(k == 1, F.array(z, z, s, F.lit(float("nan")), s, s)).when(k == 2, F.array(z, z, z, s / 10, z, s / 20)).when(k == 3, F.array(z, z, s, z, s, F.lit(1.0))).otherwise(F.array(z, z, F.lit(5.0), z, F.lit(5.0), F.lit(5.0)))
    p = table(spark, sf_dir, "part").select(documents.polygon_error(flat, F.lit(40.0), F.lit(40.0)).alias("error"))
    return p.groupBy("error").agg(F.count("*").alias("n"))


@query("""select p_partkey, p_brand as first, case when p_size % 2 = 0 then p_type end as second, 2 as parts from part""")
def literal_lists(spark, sf_dir):
    """Lists in Python notation, some with ``None``."""
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    cell = F.concat(F.lit("["), q(F.col("p_brand")), F.lit(", "), F.when(F.col("p_size") % 2 == 0, q(F.col("p_type"))).otherwise("None"), F.lit("]"))
    p = table(spark, sf_dir, "part").select("p_partkey", documents.decode_literal_list(cell, "string").alias("l"))
    return p.select("p_partkey", F.col("l")[0].alias("first"), F.col("l")[1].alias("second"), F.size("l").alias("parts"))


@query("""with e as (select event_id, case event_id % 6 when 0 then 1.000004 when 1 then -0.000004 when 2 then 1.5 when 3 then 0.25 else 0.5 end as score, case event_id % 6 when 4 then '' when 5 then 'x' || chr(65533) else 'ok' end as text from events)
select case when contains(text, chr(65533)) then 'REPLACEMENT_CHARACTER' when score > 1.00001 then 'SCORE_RANGE' else 'accepted' end as outcome, count(*) as n, sum(case when contains(text, chr(65533)) or score > 1.00001 then 0.0 else greatest(0.0, least(1.0, cast(score as double))) end) as total from e where text <> '' group by 1""")
def engine_lines(spark, sf_dir):
    """Engine output made from events: clamped, refused or dropped."""
    k = F.col("event_id") % 6
    score = F.when(k == 0, 1.000004).when(k == 1, -0.000004).when(k == 2, 1.5).when(k == 3, 0.25).otherwise(0.5)
    text = F.when(k == 4, "").when(k == 5, "x�").otherwise("ok")
    good, bad = documents.canonical_lines(table(spark, sf_dir, "events").select("event_id", score.alias("score"), text.alias("text")), "text", "score")
    every = good.select(F.lit("accepted").alias("outcome"), "score").unionByName(bad.select(F.col("error").alias("outcome"), F.lit(0.0).alias("score")))
    return every.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("""with w as (select p_partkey, string_split(p_type, ' ') as pieces, case when p_size % 2 = 0 then 'B-TYPE' else 'O' end as tag from part)
select p_partkey, cast(i - 1 as int) as sub, pieces[i] as piece, case when i = 1 then tag else 'IGNORE' end as label from w, unnest(range(1, len(pieces) + 1)) t(i)""")
def subtoken_labels(spark, sf_dir):
    """Words of a type name as sub-tokens: only the first carries the tag."""
    w = table(spark, sf_dir, "part")
    return documents.first_subtoken_labels(w, ["p_partkey"], F.split("p_type", " "), F.when(F.col("p_size") % 2 == 0, "B-TYPE").otherwise("O"))


@query("""with l as (select l_orderkey as d, l_linenumber as k, cast(min(l_quantity) as bigint) as q, cast(min(l_partkey) % 900 + 10 as bigint) as p from lineitem group by 1, 2)
select d, count(*) as items, cast(sum(q) as double) as quantity, count(*) filter (k % 3 = 0) as inferred, case when count(*) filter (k % 3 = 0) > 0 then 'quantity_inferred' else '' end as warnings from l group by 1""")
def postprocess_items(spark, sf_dir):
    """Lines as text: a third of the quantities are empty and worked out again."""
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("k")).agg(F.min("l_quantity").cast("bigint").alias("q"), (F.min("l_partkey") % 900 + 10).cast("bigint").alias("p"))
    texts = li.select("d", "k", F.when(F.col("k") % 3 != 0, F.col("q").cast("string")).otherwise("").alias("quantity"), F.format_string("%d,00", "p").alias("price"), F.format_string("%,.2f", (F.col("q") * F.col("p")).cast("double")).alias("total"))
    done = documents.postprocess(texts, "d", "k", "quantity", "price", "total")
    total = F.aggregate("items", F.lit(0.0), lambda s, x: s + x["quantity"].cast("double"))
    return done.select("d", F.size("items").cast("bigint").alias("items"), total.alias("quantity"), "inferred", F.array_join("warnings", ",").alias("warnings"))


@query("""with c as (select l_orderkey as d, count(*) filter (l_discount > 0.07) + count(*) filter (l_tax > 0.07) as e from lineitem group by 1) select cast(least(e, 4) as bigint) as errors, count(*) as documents from c group by 1""")
def error_histogram(spark, sf_dir):
    """Documents by number of wrong cells, four and more together."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count_if(F.col("l_discount") > 0.07) + F.count_if(F.col("l_tax") > 0.07)).alias("e"))
    return c.groupBy(F.least("e", F.lit(4)).cast("bigint").alias("errors")).agg(F.count("*").alias("documents"))


@query("""with g as (select unnest([640, 1280, 2000]) as side), p as (select p_size * 60 as w, p_size * 40 + p_partkey % 7 as h from part)
select side, count(*) as n, count(*) filter (greatest(w, h) > side) as shrunk, cast(sum(case when greatest(w, h) > side then (w * side // greatest(w, h)) * (h * side // greatest(w, h)) else w * h end) as bigint) as pixels from p, g group by 1""")
def resize_candidates(spark, sf_dir):
    """Page sizes made from parts under three limits: how many shrink, and the pixels left."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") * 60).cast("bigint").alias("w"), (F.col("p_size") * 40 + F.col("p_partkey") % 7).alias("h"))
    each = p.select("w", "h", F.explode(F.array(*(F.lit(x) for x in (640, 1280, 2000)))).alias("side")).withColumn("m", F.greatest("w", "h"))
    left = F.when(F.col("m") > F.col("side"), F.expr("div(w * side, m) * div(h * side, m)")).otherwise(F.col("w") * F.col("h"))
    return each.groupBy("side").agg(F.count("*").alias("n"), F.count_if(F.col("m") > F.col("side")).alias("shrunk"), F.sum(left).alias("pixels"))


@query()
def substring_match(spark, sf_dir):
    """Part names, with a letter dropped, looked for in name and type: least edits and where; no SQL: dynamic programming."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("substr(p_name, 2)").alias("needle"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("hay"))
    return fold_sorted(p, ["p_partkey"], ["needle"], lambda rows: [(k, *X.substring_distance(n, h)) for k, n, h in rows], "p_partkey bigint, edits int, start int, end int")


@query("""with o as (select o_orderkey as k, o_orderdate as d, o_totalprice as t from orders),
f as (select 'company' as field, case when k % 10 = 0 then 'missing' else 'ok' end as status, case when k % 10 = 0 then 'EMPTY_VALUE' else '' end as warnings from o
union all select 'date', case k % 4 when 0 then 'ok' when 1 then 'invalid' when 2 then case when day(d) <= 12 and day(d) <> month(d) then 'ambiguous' else 'ok' end else 'missing' end,
  case k % 4 when 1 then 'TWO_DIGIT_YEAR_UNSUPPORTED' when 2 then case when day(d) <= 12 and day(d) <> month(d) then 'AMBIGUOUS_DATE' else '' end when 3 then 'MISSING_VALUE' else '' end from o
union all select 'total', case k % 3 when 1 then 'ambiguous' else 'ok' end, case k % 3 when 1 then 'AMBIGUOUS_AMOUNT' when 2 then 'CURRENCY_FRACTION_UNEXPECTED' else '' end from o)
select field, status, warnings, count(*) as n from f group by 1, 2, 3""")
def field_normalize_audit(spark, sf_dir):
    """Fields of receipts made from orders through the contract normalisers: status and warnings by field."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    n = F.format_string("%,.2f", "o_totalprice")
    company = F.struct(F.lit("company").alias("field"), F.when(k % 10 == 0, " \t ").otherwise(F.concat(F.lit(" Shop  "), k.cast("string"))).alias("raw"), F.lit("vi-VN").alias("locale"))
    raw = F.when(k % 4 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 1, F.date_format(d, "dd/MM/yy")).when(k % 4 == 2, F.date_format(d, "dd-MM-yyyy"))
    date = F.struct(F.lit("date").alias("field"), raw.alias("raw"), F.when(k % 4 != 2, "vi-VN").alias("locale"))
    amount = F.when(k % 3 == 0, n).when(k % 3 == 1, F.concat(n, F.lit("; "), n)).otherwise(F.concat(n, F.lit(" VND")))
    total = F.struct(F.lit("total").alias("field"), amount.alias("raw"), F.lit("en-US").alias("locale"))
    f = table(spark, sf_dir, "orders").select(F.explode(F.array(company, date, total)).alias("x")).select("x.*")
    done = f.select("field", fields.normalize_field(F.col("field"), F.col("raw"), F.col("locale")).alias("r"))
    return done.groupBy("field", F.col("r.status").alias("status"), F.array_join("r.warnings", ",").alias("warnings")).agg(F.count("*").alias("n"))


@query("""select strftime(o_orderdate, '%Y-%m-%d') || 'T' || case o_orderkey % 3 when 0 then '08:05:00' when 1 then '20:05:09' else '00:00:00' end as stamp, case when o_orderkey % 3 = 2 then 'TIME_NOT_FOUND' else '' end as warnings, count(*) as n from orders group by 1, 2""")
def receipt_timestamps(spark, sf_dir):
    """Order dates with clocks before, after and missing."""
    k, d = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "dd/MM/yyyy")
    raw = F.when(k == 0, F.concat(F.lit("08:05 - "), d)).when(k == 1, F.concat(d, F.lit(" (08:05:09 CH)"))).otherwise(d)
    r = table(spark, sf_dir, "orders").select(fields.timestamp_field(raw).alias("r"))
    return r.groupBy(F.col("r.value").alias("stamp"), F.array_join("r.warnings", ",").alias("warnings")).agg(F.count("*").alias("n"))
