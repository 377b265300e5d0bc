"""Further bindings of operators to the driver's tables: rules, routing, ranks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import geometry as G
from ..functions import text as X
from ..operators import splits, tagging
from ..sources import records
from .bindings import _SPLIT, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""with t as (select case p_partkey % 5 when 0 then cast(p_partkey + 10000000 as varchar) when 1 then printf('%,d', 1000 + p_partkey) when 2 then printf('%.2f', p_retailprice) when 3 then '##-' || substr(p_name, 1, 1) else p_name end as tok from part)
select case when regexp_matches(tok, '^[0-9]{8,14}$') then 'barcode' when regexp_matches(tok, '^-?[0-9]{1,3}([.,][0-9]{3})+([.,][0-9]{1,2})?$') then 'money' when regexp_matches(tok, '^-?[0-9]+([.,][0-9]+)?$') then 'number'
when length(regexp_replace(tok, '[^0-9A-Za-z]', '', 'g')) * 2 < length(tok) then 'junk' else 'word' end as kind, count(*) as n from t group by 1""")
def token_kinds(spark, sf_dir):
    """Numbers and names from parts as receipt tokens."""
    k = F.col("p_partkey") % 5
    tok = F.when(k == 0, (F.col("p_partkey") + 10000000).cast("string")).when(k == 1, F.format_string("%,d", F.col("p_partkey") + 1000)).when(k == 2, F.format_string("%.2f", "p_retailprice")).when(k == 3, F.concat(F.lit("##-"), F.substring("p_name", 1, 1))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(tagging.token_kind(tok).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""select cast((case when regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') then 1 else 0 end) + (case when regexp_matches(lower(text), '(^|[^a-z0-9])der([^a-z0-9]|$)') then 1 else 0 end) + (case when regexp_matches(lower(text), '(^|[^a-z0-9])que([^a-z0-9]|$)') then 1 else 0 end) as int) as hits, count(*) as n from documents group by 1""")
def keyword_hits(spark, sf_dir):
    """Documents by how many of three keywords they hold between word edges."""
    return table(spark, sf_dir, "documents").select(tagging.header_hits(F.col("text"), ["the", "der", "que"]).alias("hits")).groupBy("hits").agg(F.count("*").alias("n"))


_PAGE = """w as (select l_orderkey as d, l_linenumber as word, cast(min(l_partkey) % 300 as double) as x0, cast(l_linenumber * 20 as double) as y0 from lineitem group by 1, 2),
r as (select l_orderkey as d, n as region, n * 60.0 as x0, 15.0 as y0, n * 60.0 + 70.0 as x1, 150.0 as y1 from (select distinct l_orderkey from lineitem), range(0, 5) t(n))"""


@query(f"""with {_PAGE}, j as (select w.d, word, region, greatest(0, least(w.x0 + 30, r.x1) - greatest(w.x0, r.x0)) * greatest(0, least(w.y0 + 10, r.y1) - greatest(w.y0, r.y0)) / (30.0 * 10.0) as cover from w join r on w.d = r.d),
b as (select *, row_number() over (partition by d, word order by cover desc, region) as k from j where cover >= 0.5) select d, word, cast(region as bigint) as region, cover from b where k = 1""")
def best_overlap(spark, sf_dir):
    """Boxes of order lines against five overlapping regions of a page: the region that covers most."""
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("word")).agg((F.min("l_partkey") % 300).cast("double").alias("x0")).withColumn("y0", (F.col("word") * 20).cast("double")).withColumns({"x1": F.col("x0") + 30, "y1": F.col("y0") + 10})
    n = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))
    r = w.select("d").distinct().select("d", n.alias("region")).withColumns({"x0": F.col("region") * 60.0, "y0": F.lit(15.0), "x1": F.col("region") * 60.0 + 70.0, "y1": F.lit(150.0)})
    return tagging.best_overlap(w, r, "d", 0.5)


@query("""with o as (select l_orderkey, bool_or(l_discount > 0.08) as flagged, bool_or(l_tax > 0.06) as wrong from lineitem group by 1)
select case when flagged and wrong then 'caught' when flagged then 'needless' when wrong then 'missed' else 'clean' end as route, count(*) as n from o group by 1""")
def review_routing(spark, sf_dir):
    """High discounts flag an order, high taxes stand for errors."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_discount") > 0.08).alias("f"), F.bool_or(F.col("l_tax") > 0.06).alias("w"))
    return o.select(tagging.route_for_review(F.col("f"), F.col("w")).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query("""with e as (select l_orderkey, l_linenumber, bool_or(l_partkey % 3 = 0) as q, bool_or(l_partkey % 3 <> 2) as p, bool_or(l_suppkey % 4 > 0) as t from lineitem group by 1, 2)
select case when q then 'detected' when p and t then 'inferable' else 'not_recoverable' end as status, count(*) as n from e group by 1""")
def quantity_recoverability(spark, sf_dir):
    """Labels of order lines seen or not by key: is the quantity there, or to be worked out?"""
    kinds = F.array(F.when(F.col("l_partkey") % 3 == 0, "QUANTITY"), F.when(F.col("l_partkey") % 3 != 2, "UNIT_PRICE"), F.when(F.col("l_suppkey") % 4 > 0, "LINE_TOTAL"), F.lit("NAME"))
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(kinds).alias("label"))
    return tagging.recoverability(e, ["l_orderkey", "l_linenumber"], "label")


@query("""with d as (select user_id, list(event_type order by ts, event_id) as v from events group by user_id, cast(ts as date)), x as (select user_id, v, len(list_filter(v, lambda e: e = 'click')) as n from d)
select case when n = 0 then 'none' when n = len(v) then 'all' when v[1] = 'click' and n = 1 then 'first_only' when v[-1] = 'click' and n = 1 then 'last_only' else 'mixed' end as choice, count(*) as n from x group by 1""")
def label_choice(spark, sf_dir):
    """Which of a user's events of a day, in order, are clicks."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("v"))
    return e.select(tagging.choice_among(F.col("v"), F.lit("click")).alias("choice")).groupBy("choice").agg(F.count("*").alias("n"))


@query("""with k as (select url, sha256(html) as h, page_id from pages), n as (select case when page_id % 4 = 3 then url || '#' else url end as url, case when page_id % 4 = 1 then sha256(url) else h end as h, page_id from k where page_id % 2 = 1),
j as (select n.page_id, bool_or(k.url is not null) as name_known, bool_or(k.h = n.h) as same from n left join k on n.url = k.url group by 1), d as (select distinct h from k)
select case when name_known and coalesce(same, false) then 'existing' when name_known then 'conflict' when d.h is not null then 'duplicate' else 'new' end as status, count(*) as n from n join j using (page_id) left join d on n.h = d.h group by 1""")
def upload_status(spark, sf_dir):
    """Pages offered again under the same or another name, with the same or another content."""
    known = table(spark, sf_dir, "pages").select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("h"))
    r = F.col("page_id") % 4
    new = known.where("page_id % 2 = 1").select("page_id", F.when(r == 3, F.concat("url", F.lit("#"))).otherwise(F.col("url")).alias("url"), F.when(r == 1, F.sha2(F.col("url").cast("binary"), 256)).otherwise(F.col("h")).alias("h"))
    by_name = known.groupBy("url").agg(F.collect_set("h").alias("hs"))
    by_hash = known.select("h").distinct().withColumn("hash_known", F.lit(True))
    j = new.join(by_name, "url", "left").join(by_hash, "h", "left")
    status = tagging.upload_status(F.col("hs").isNotNull(), F.coalesce(F.array_contains("hs", F.col("h")), F.lit(False)), F.coalesce("hash_known", F.lit(False)))
    return j.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""with c as (select case when p_size % 2 = 0 then 'V6' else '' end || case when p_size % 3 = 0 then 'L' else 'C' end || cast(p_size * 32 as varchar) || case when p_size % 5 = 0 then '_b0.6' else '' end || case when p_size % 7 = 0 then '_s1' else '' end as name, p_size from part)
select name, p_size % 2 = 0 as v6, case when p_size % 3 = 0 then 'L' else 'C' end as mode, p_size * 32 as side, case when p_size % 5 = 0 then '0.6' end as box, p_size % 7 = 0 as single, count(*) as n from c group by all""")
def config_names(spark, sf_dir):
    """Configuration names in the small grammar, taken apart."""
    s = F.col("p_size")
    name = F.concat(F.when(s % 2 == 0, "V6").otherwise(""), F.when(s % 3 == 0, "L").otherwise("C"), (s * 32).cast("string"), F.when(s % 5 == 0, "_b0.6").otherwise(""), F.when(s % 7 == 0, "_s1").otherwise(""))
    c = table(spark, sf_dir, "part").select(name.alias("name")).withColumn("c", tagging.parse_config_name(F.col("name")))
    return c.groupBy("name", "c.v6", "c.mode", "c.side", "c.box", "c.single").agg(F.count("*").alias("n"))


@query("""select c_custkey, sha256('{"version":"v2","id":' || c_custkey || ',"items":[' || coalesce(string_agg('{"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' order by o_orderkey), '') || '],"warnings":[' ||
case when count(o_orderkey) = 0 then '"no_items"' || case when c_acctbal < 0 then ',' else '' end else '' end || case when c_acctbal < 0 then '"negative_balance"' else '' end || ']}') as digest
from customer left join orders on c_custkey = o_custkey group by c_custkey, c_acctbal""")
def result_contract(spark, sf_dir):
    """Customers with their orders as result messages; digests of the JSON."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status")))).alias("items"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<order:bigint,status:string>>")))
    warn = tagging.collect_warnings({"no_items": F.size("items") == 0, "negative_balance": F.col("c_acctbal") < 0})
    return c.select("c_custkey", F.sha2(tagging.contract(F.col("c_custkey"), F.col("items"), warn).cast("binary"), 256).alias("digest"))


@query("""select event_type, ts, event_id, value from (select *, row_number() over (partition by event_type order by value desc, ts, event_id) as r from events) where r <= 3""")
def top_values(spark, sf_dir):
    """The three highest events of each type, by a total order (a top-k report)."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return tagging.rank_rows(e, ["event_type"], [F.col("value").desc(), F.col("ts"), F.col("event_id")], "r").where("r <= 3").drop("r")


@query(f"""with s as (select c_custkey, c_nationkey, c_mktsegment, {_SPLIT.format(k='c_custkey')} as split from customer), t as (select distinct c_mktsegment || c_nationkey as seller from s where split = 'train')
select split, count(*) as documents, count(distinct c_nationkey) as nations, count(*) filter (c_mktsegment || c_nationkey not in (select seller from t)) as unseen from s group by 1""")
def split_report(spark, sf_dir):
    """Per split: customers, nations, and those whose segment and nation never occur in training."""
    s = table(spark, sf_dir, "customer").select(splits.hash_split(42, "c_custkey", {"train": 8, "val": 1, "test": 1}).alias("split"), "c_nationkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("seller"))
    seen = s.groupBy("seller").agg(F.bool_or(F.col("split") == "train").alias("seen"))
    return s.join(seen, "seller").groupBy("split").agg(F.count("*").alias("documents"), F.count_distinct("c_nationkey").alias("nations"), F.count_if(~F.col("seen")).alias("unseen"))


@query("""select p_brand, count(*) as n, count(*) filter (contains(lower(p_name), 'e')) as hits from part where p_size between 10 and 30 group by 1""")
def search_filter(spark, sf_dir):
    """A case-insensitive search with a status filter over a list."""
    p = table(spark, sf_dir, "part").where("p_size between 10 and 30")
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.lower("p_name").contains("e")).alias("hits"))


@query("""select case when conv_id % 3 = 0 then 'PRODUCT_NAME:' || turn when conv_id % 3 = 1 then 'STORE' else 'STORE:' || turn end as key,
case when conv_id % 3 = 0 then turn > 0 else conv_id % 3 = 1 end as valid, count(*) as n from conversations group by 1, 2""")
def missing_field_keys(spark, sf_dir):
    """Keys of missing fields: item labels need a positive number, document labels none."""
    k = F.col("conv_id") % 3
    key = F.when(k == 0, F.concat(F.lit("PRODUCT_NAME:"), F.col("turn").cast("string"))).when(k == 1, "STORE").otherwise(F.concat(F.lit("STORE:"), F.col("turn").cast("string")))
    c = table(spark, sf_dir, "conversations").select(key.alias("key"))
    return c.select("key", X.valid_missing_key(F.col("key"), ["PRODUCT_NAME"], ["STORE"]).alias("valid")).groupBy("key", "valid").agg(F.count("*").alias("n"))


@query("""select l_returnflag, count(*) as n, cast(sum(cast(l_linenumber as bigint)) as bigint) as digest from (select distinct on (l_returnflag, l_linenumber) l_returnflag, l_linenumber from lineitem) group by 1""")
def distinct_inventory(spark, sf_dir):
    """Distinct line numbers per flag, counted and summed."""
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber").distinct()
    return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_linenumber").cast("bigint")).alias("digest"))


@query("""select case when p_size % 2 = 0 then 'D' || p_size || ' l' || p_size || ' Oil' else 'no digits lO' end as raw, case when p_size % 2 = 0 then '0' || p_size || ' 1' || p_size || ' Oil' else 'no digits lO' end as fixed, count(*) as n from part group by 1, 2""")
def numeric_ocr_fixes(spark, sf_dir):
    """Letters read for digits are mended only in tokens that hold a digit."""
    s = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("D"), s, F.lit(" l"), s, F.lit(" Oil"))).otherwise("no digits lO")
    return table(spark, sf_dir, "part").select(raw.alias("raw")).select("raw", fields.mended(F.col("raw")).alias("fixed")).groupBy("raw", "fixed").agg(F.count("*").alias("n"))


@query("""with e as (select event_id, cast(event_id * 37 % 360 as double) as gold, cast((event_id * 37 + event_id % 5) % 360 as double) as pred from events),
x as (select least((pred - gold + 360) % 360, 360 - (pred - gold + 360) % 360) as err, cast(round_even(gold / 90, 0) as int) % 4 * 90 as class from e)
select class, count(*) as n, avg(err) as mae, median(err) as median, count(*) filter (err <= 1) as within_1, count(*) filter (err <= 2) as within_2 from x group by 1""")
def orientation_stats(spark, sf_dir):
    """Angles made from event ids, read with an error of up to four degrees: statistics by right angle."""
    g = (F.col("event_id") * 37 % 360).cast("double")
    p = ((F.col("event_id") * 37 + F.col("event_id") % 5) % 360).cast("double")
    x = table(spark, sf_dir, "events").select(G.circular_error(p, g).alias("err"), G.right_angle(g).alias("class"))
    return x.groupBy("class").agg(F.count("*").alias("n"), F.avg("err").alias("mae"), F.median("err").alias("median"), F.count_if(F.col("err") <= 1).alias("within_1"), F.count_if(F.col("err") <= 2).alias("within_2"))


@query("""select l_returnflag as "key", count(*) as records, cast(sum(cast('0x' || substr(sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_returnflag":"' || l_returnflag || '"}'), 1, 12) as bigint)) as bigint) as digest from lineitem group by 1""")
def canonical_digest(spark, sf_dir):
    """Lines as canonical JSON, with an order-free digest per flag."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return records.lines_digest(li, "l_returnflag").withColumnRenamed("l_returnflag", "key")


@query("""select a.split as split_a, b.split as split_b, count(distinct a.k) as shared from (select distinct o_custkey as k, {0} as split from orders) a join (select distinct o_custkey as k, {0} as split from orders) b on a.k = b.k and a.split < b.split group by 1, 2""".format(_SPLIT.format(k="o_orderkey")))
def split_intersections(spark, sf_dir):
    """Customers that each pair of splits shares."""
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), splits.hash_split(42, "o_orderkey", {"train": 8, "val": 1, "test": 1}).alias("split")).groupBy("k").agg(F.array_sort(F.collect_set("split")).alias("s"))
    pair = lambda i, j: F.when(F.size("s") > j, F.struct(F.get("s", F.lit(i)).alias("split_a"), F.get("s", F.lit(j)).alias("split_b")))
    each = s.select(F.explode(F.array(pair(0, 1), pair(0, 2), pair(1, 2))).alias("p")).where("p is not null")
    return each.groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("shared"))


@query("""select lang, source, count(*) as documents, cast(sum(n_chars) as bigint) as chars, max(n_chars) as longest, grouping(lang, source) as level from documents group by grouping sets ((lang), (source), ())""")
def document_summary(spark, sf_dir):
    """Histograms by language and by source and the total, in one pass."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "n_chars")
    return d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.grouping_id("lang", "source").alias("level"))


@query("""select conv_id, role, min(turn) as first_turn, max(turn) as last_turn, count(*) as n from (select *, turn - row_number() over (partition by conv_id, role order by turn) as g from conversations) group by conv_id, role, g""")
def role_runs(spark, sf_dir):
    """Runs of one role in a conversation, by gaps and islands."""
    g = F.col("turn") - F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    c: DataFrame = table(spark, sf_dir, "conversations").withColumn("g", g)
    return c.groupBy("conv_id", "role", "g").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n")).drop("g")
