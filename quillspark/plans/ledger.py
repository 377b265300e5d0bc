"""Queries over contracts, inventories, statistics of alignment and detection, and workspace tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import contracts as C
from ..operators import linkage, sequence, splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FIELDS = ["company", "address", "date", "total"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and line number."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("k"))
    return li.agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("long").alias("q"))


_LINES = "x as (select l_orderkey as o, cast(l_linenumber as bigint) as k, min(l_partkey) as p, min(l_suppkey) as s, cast(min(l_quantity) as bigint) as q from lineitem group by 1, 2)"


# -- strict joins, inventories, exclusions --------------------------------------------------------


@query(f"""with {_LINES}, a as (select o, count(*) as n from x group by 1), b as (select o, count(*) as n from x where not (o % 5 = 0 and k = 1) and o % 7 <> 0 group by 1)
select case when b.o is null then 'MISSING' when a.n <> b.n then 'LENGTH' else 'joined' end as outcome, count(*) as n from a left join b on a.o = b.o group by 1""")
def strict_join(spark, sf_dir):
    """Lists of lines against lists that lack documents and members: a missed partner and unequal lengths are faults."""
    x = lines(spark, sf_dir)
    a = x.groupBy("o").agg(F.collect_list("k").alias("left"))
    b = x.where("not (o % 5 = 0 and k = 1) and o % 7 != 0").groupBy("o").agg(F.collect_list("k").alias("right"))
    good, bad = C.strict_join(a, b, ["o"], ("left", "right"))
    return good.select(F.lit("joined").alias("outcome")).unionByName(bad.select(F.col("error").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""with {_LINES}, f as (select * from x where o % 11 <> 0), l as (select o, k, case when p % 6 = 0 then p + 1 else p end as p, case when s % 4 = 0 then null else s end as s from x where k <> 4),
b as (select f.o as fo, l.o as lo, f.p as fp, l.p as lp, f.s as fs, l.s as ls from f full join l on f.o = l.o and f.k = l.k),
t as (select case when fo is null then 'missing' when lo is null then 'unlisted' else concat_ws('+', case when fp is distinct from lp then 'p' end, case when fs is distinct from ls then 's' end) end as faults from b)
select faults, count(*) as n from t where faults <> '' group by 1""")
def inventory_mismatches(spark, sf_dir):
    """Lines found against lines listed by order and number, with attributes that differ on some."""
    x = lines(spark, sf_dir)
    listed = x.where("k != 4").select("o", "k", F.when(F.col("p") % 6 == 0, F.col("p") + 1).otherwise(F.col("p")).alias("p"), F.when(F.col("s") % 4 != 0, F.col("s")).alias("s"))
    m = C.inventory_mismatches(x.where("o % 11 != 0").select("o", "k", "p", "s"), listed, ["o", "k"], ["p", "s"])
    return m.groupBy(F.array_join("faults", "+").alias("faults")).agg(F.count("*").alias("n"))


_SPLIT = "case when c_custkey % 10 < 7 then 'train' when c_custkey % 10 < 8 then 'val' else 'test' end"


@query(f"""with m as (select c_custkey, c_custkey % 97 as g, {_SPLIT} as split from customer), t as (select distinct g from m where split = 'test')
select split, count(*) as n, cast(sum(c_custkey) as bigint) as total from m where split <> 'train' or g not in (select g from t) group by 1""")
def drop_touching_groups(spark, sf_dir):
    """Customers in groups by a remainder: train members of a group that touches test go."""
    k = F.col("c_custkey") % 10
    m = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 97).alias("g"), F.when(k < 7, "train").when(k < 8, "val").otherwise("test").alias("split"))
    return C.drop_touching(m, "g", "split", "test", "train").groupBy("split").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


@query("""select c_custkey from customer where c_custkey % 13 = 0 and c_mktsegment <> 'BUILDING'""")
def excluded_in_accepted(spark, sf_dir):
    """Quarantined customers that are among the accepted ones after all."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return C.excluded_keys_found(c.where("c_mktsegment != 'BUILDING'"), c.where("c_custkey % 13 = 0"), ["c_custkey"])


@query("""select n_regionkey as split, array_to_string(list_sort(list(distinct n_nationkey)), ',') as keys, count(distinct n_nationkey) as n from nation group by 1""")
def split_key_sets(spark, sf_dir):
    """Nations per region as key sets."""
    found = C.key_sets(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("split"), "n_nationkey"), "split", "n_nationkey")
    return found.withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ","))


@query("""with s as (select l_orderkey as o, count(distinct l_returnflag) as a, count(distinct l_linestatus) as b, string_agg(distinct l_returnflag, '' order by l_returnflag) as x, string_agg(distinct case when l_orderkey % 3 = 0 then l_returnflag else l_linestatus end, '' order by case when l_orderkey % 3 = 0 then l_returnflag else l_linestatus end) as y from lineitem group by 1)
select x = y as same, count(*) as n from s group by 1""")
def equal_sets(spark, sf_dir):
    """Flags of an order against its flags or statuses, as sets."""
    li = table(spark, sf_dir, "lineitem")
    other = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))
    per = li.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("x"), F.collect_list(other).alias("y"))
    return per.groupBy(C.same_sets(F.col("x"), F.col("y")).alias("same")).agg(F.count("*").alias("n"))


_SLOTS = """s as (select p_partkey as d, unnest(['company', 'address', 'date', 'total', 'extra']) as field from part),
r as (select d, field from s where not (d % 6 = 0 and field = 'date') and (field <> 'extra' or d % 9 = 0) union all select d, 'total' from s where d % 14 = 0 and field = 'total')"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("d"), F.explode(F.array(*map(F.lit, [*FIELDS, "extra"]))).alias("field"))
    return s.where("not (d % 6 = 0 and field = 'date') and (field != 'extra' or d % 9 = 0)").unionByName(s.where("d % 14 = 0 and field = 'total'"))


@query(f"""with {_SLOTS}, p as (select d, count(distinct field) filter (field = 'date') as dated, count(distinct field) filter (field = 'extra') as extra, count(*) - count(distinct field) as repeated from r group by 1)
select d, case when dated = 0 then 'date' else '' end as missing, case when extra = 1 then 'extra' else '' end as unknown, repeated from p where dated = 0 or extra = 1 or repeated > 0""")
def field_key_contract(spark, sf_dir):
    """Documents that lack a contract field, have an unknown one, or one twice."""
    f = C.key_set_faults(slots(spark, sf_dir), "d", "field", FIELDS)
    return f.select("d", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"), F.col("repeated").cast("long").alias("repeated"))


@query("""with e as (select p_partkey as d, unnest(['company', 'address', 'date', 'total']) as field from part)
select field, case when d % 6 = 0 and field = 'date' then 'unlabeled' when d % 4 = 0 then 'absent' else 'annotated' end as status, count(*) as n from e group by 1, 2""")
def default_fields(spark, sf_dir):
    """A slot for every contract field of every document, unlabelled where the source has none."""
    r = slots(spark, sf_dir).where("field != 'extra'").distinct().withColumn("status", F.when(F.col("d") % 4 == 0, "absent").otherwise("annotated"))
    return C.with_all_fields(r, "d", "field", FIELDS, "status").groupBy("field", "status").agg(F.count("*").alias("n"))


@query("""with p as (select p_partkey, p_partkey % 8 as k from part), f as (select 'REPEATED_KEY' as fault from p where k = 0 union all select 'RAW_CHANGED' from p where k = 1 union all select 'UNKNOWN_WARNING' from p where k = 2 union all select 'STATUS_VALUE' from p where k = 3)
select fault, count(*) as n from f group by 1""")
def artifact_faults(spark, sf_dir):
    """A normalised table with repeated keys, changed raw values, warnings and values against the contract."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 8
    src = p.select("p_partkey", F.col("p_name").alias("raw"))
    rows = p.select("p_partkey", F.when(k == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("raw"), F.lit("ok").alias("status"), F.when(k != 3, F.col("p_name")).alias("value"), F.when(k == 2, F.array(F.lit("NEW"))).otherwise(F.array(F.lit("EMPTY_VALUE"))).alias("warnings"))
    rows = rows.unionByName(rows.where("p_partkey % 8 = 0"))
    return C.artifact_faults(rows, ["p_partkey"], "raw", src, "status", "value", "warnings", ["EMPTY_VALUE", "MISSING_VALUE"])


# -- statistics -----------------------------------------------------------------------------------


@query("""with r as (select l_returnflag, l_linestatus, l_discount < 0.08 as found, l_tax > 0.07 as merged, l_quantity > 5 as inside from lineitem),
p as (select l_returnflag, avg(found::int) as recall, count(*) as n, sum(merged::int) as m, sum(inside::int) as i from r group by 1)
select min(recall) as min_recall, avg(recall) as mean_recall, sum(m) / sum(n) as merged_rate, sum(i) / sum(n) as inside_rate from p""")
def detector_recall(spark, sf_dir):
    """Lines as regions with flags as labels: found, merged and inside a crop."""
    r = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", "l_tax", "l_quantity")
    return C.recall_by_label(r, "l_returnflag", F.col("l_discount") < 0.08, F.col("l_tax") > 0.07, F.col("l_quantity") > 5)


@query("""with r as (select lang, n_chars % 5 <> 0 as m, (n_chars % 16) / 16.0 as cer from documents)
select lang, count(*) as regions, round_even(avg(m::int), 4) as match_rate, round_even(avg(cer) filter (m), 4) as mean_cer, round_even(median(cer) filter (m), 4) as median_cer, round_even(avg((cer = 0)::int) filter (m), 4) as exact_rate from r group by 1""")
def alignment_summary(spark, sf_dir):
    """Documents as regions with languages as labels and error rates from their lengths."""
    d = table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") % 5 != 0).alias("matched"), ((F.col("n_chars") % 16) / F.lit(16.0)).alias("cer"))
    return C.alignment_summary(d, "lang", "matched", "cer", F.col("cer") == 0)


@query(f"""with {_LINES}, m as (select o, s % 3 as label, k, (k * 7 + p) % 10 as y from x), g as (select o, label, list(k order by k) as a, list(k order by y, k) as b from m group by 1, 2)
select label, count(*) as fields, round_even(avg((a = b)::int), 4) as same_order from g where len(a) > 1 group by 1""")
def order_agreement(spark, sf_dir):
    """Boxes of a field in the source's order and by place."""
    m = lines(spark, sf_dir).select("o", (F.col("s") % 3).alias("label"), "k", ((F.col("k") * 7 + F.col("p")) % 10).alias("y"))
    return C.order_agreement(m, "o", "label", "k", ["y"])


@query(f"""with {_LINES}, w as (select o, case when k % 3 > 0 then k % 3 end as e, (p % 64) / 64.0 as score from x where o % 4 = 1 or k % 3 > 0 or k = 3)
select o, min(score) filter (e is not null) as field_confidence, coalesce(avg(score) filter (e is not null), 0.0) as overall from w group by 1""")
def confidences(spark, sf_dir):
    """Words of an order with entities and scores: the least and the mean, 0 without entities."""
    w = lines(spark, sf_dir).where("o % 4 = 1 or k % 3 > 0 or k = 3").select("o", F.when(F.col("k") % 3 > 0, F.col("k") % 3).alias("e"), ((F.col("p") % 64) / F.lit(64.0)).alias("score"))
    return C.confidence(w, "o", "e", "score")


@query(f"""with {_LINES} select o, arg_max(p, (coalesce(case when s % 5 > 0 then (q % 8) / 8.0 end, 0.0), -k)) as p from x group by 1""")
def most_confident(spark, sf_dir):
    """The part with the highest score of each order, unscored ones as 0, the first of equal ones."""
    x = lines(spark, sf_dir).select("o", "p", "k", F.when(F.col("s") % 5 > 0, (F.col("q") % 8) / F.lit(8.0)).alias("score"))
    return C.most_confident(x, ["o"], "p", "score", "k")


@query("""with m as (select l_returnflag as scope, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, case when l_returnflag = 'N' then null else count(*) filter (l_tax > 0.04) / 8.0 end as part from lineitem group by 1),
u as (select scope, 'n' as metric, cast(n as double) as v from m union all select scope, 'quantity', quantity from m union all select scope, 'part', part from m)
select scope, metric, coalesce(regexp_replace(regexp_replace(printf('%.12f', v), '0+$', ''), '[.]$', ''), '') as value from u""")
def long_metrics(spark, sf_dir):
    """Metrics per flag as a long table of scope, metric and text, nulls empty."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("scope")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), (F.count_if(F.col("l_tax") > 0.04) / 8.0).alias("part"))
    return C.long_metrics(m.withColumn("part", F.when(F.col("scope") != "N", F.col("part"))), "scope", ["n", "quantity", "part"])


@query("""with s as (select lang, source, case doc_id % 4 when 0 then 'annotated' when 1 then 'absent' when 2 then 'uncertain' else 'unlabeled' end as status from documents)
select lang, source, count(*) as slots, count(*) filter (status in ('annotated', 'absent')) as evaluable, avg((status in ('annotated', 'absent'))::int) as coverage from s group by 1, 2""")
def slot_coverage(spark, sf_dir):
    """Documents as slots with a made-up status, by language and source."""
    k = F.col("doc_id") % 4
    s = table(spark, sf_dir, "documents").select("lang", "source", F.when(k == 0, "annotated").when(k == 1, "absent").when(k == 2, "uncertain").otherwise("unlabeled").alias("status"))
    return C.slot_coverage(s, ["lang", "source"], "status")


@query("""select count(distinct conv_id) as documents, count(*) as words, cast(sum(length(text)) as bigint) as tokens, max(length(text)) as longest, cast((select count(*) from (select distinct conv_id, turn // 4 from conversations)) as bigint) as windows,
(select max(n) from (select conv_id, count(distinct turn // 4) as n from conversations group by 1)) as most_windows from conversations""")
def token_window_stats(spark, sf_dir):
    """Turns as words and windows of four turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.char_length("text").cast("long").alias("tokens"), F.floor(F.col("turn") / 4).alias("w"))
    return C.token_window_stats(c, "conv_id", "tokens", c.select("conv_id", "w").distinct())


# -- text and boxes -------------------------------------------------------------------------------


@query("""with c as (select unnest(string_split(item, '')) as ch from (select replace(p_name || p_type || p_brand, '#', 'é') as item from part))
select ch, count(*) as n from c where ch <> '' and not regexp_matches(ch, '[a-z ]') group by 1""")
def out_of_vocabulary(spark, sf_dir):
    """Characters of part names, types and brands beyond small letters and the blank."""
    p = table(spark, sf_dir, "part").select(F.replace(F.concat("p_name", "p_type", "p_brand"), F.lit("#"), F.lit("é")).alias("t"))
    vocabulary = spark.createDataFrame([(ch,) for ch in "abcdefghijklmnopqrstuvwxyz "], "ch string")
    return C.out_of_vocabulary(p, "t", vocabulary, "ch")


@query("""with p as (select p_partkey, p_name as t, cast(p_size as double) as w, cast(p_partkey % 9 as double) as h from part)
select length(replace(t, ' ', '')) <= 5 * greatest(w, h) / greatest(least(w, h), 1.0) + 1 as plausible, count(*) as n from p group by 1""")
def plausible_texts(spark, sf_dir):
    """Names in boxes made from sizes: those that hold so many characters."""
    w, h, z = F.col("p_size").cast("double"), (F.col("p_partkey") % 9).cast("double"), F.lit(0.0)
    p = table(spark, sf_dir, "part").select(C.plausible_text(F.col("p_name"), F.array(z, z, w, z, w, h, z, h)).alias("plausible"))
    return p.groupBy("plausible").agg(F.count("*").alias("n"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir)
    x0, y0 = (F.col("p") % 400).cast("double"), (F.col("k") * 40 + F.col("s") % 9).cast("double")
    return x.select("o", "k", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("q")).alias("x1"), (y0 + F.col("p") % 16).alias("y1"), ((F.col("s") % 10) / F.lit(10.0)).alias("score"))


@query(f"""with {_LINES}, b as (select o, k, q, p % 16 as h, (s % 10) / 10.0 as score from x), g as (select * from b where score >= 0.3 and h >= 4 and q > 0)
select o, count(*) as n from g group by 1 having count(*) >= 2""")
def box_filters(spark, sf_dir):
    """Boxes of enough score and height, in orders that keep two."""
    return C.filter_boxes(_boxes(spark, sf_dir), "o", "score", ("x0", "y0", "x1", "y1"), 0.3, 4.0, 2).groupBy("o").agg(F.count("*").alias("n"))


@query()
def crop_rectangles(spark, sf_dir):
    """Rectangles around the largest cluster of an order's boxes; no SQL: a fold per order."""
    b = C.filter_boxes(_boxes(spark, sf_dir), "o", "score", ("x0", "y0", "x1", "y1"), 0.3, 4.0, 2)
    return C.crop_rectangles(b, "o", ("x0", "y0", "x1", "y1"), 500.0, 400.0)


@query(f"""with {_LINES}, b as (select o, k % 2 as line, cast(p % 400 as double) as x0, cast(k * 40 + s % 9 as double) as y0, q, p % 16 as h from x)
select o, line, cast(round_even(min(x0 * 1.5), 0) as bigint) as x0, cast(round_even(min(y0 * 0.75), 0) as bigint) as y0, cast(round_even(max((x0 + q) * 1.5), 0) as bigint) as x1, cast(round_even(max((y0 + h) * 0.75), 0) as bigint) as y1 from b group by 1, 2""")
def evidence_boxes(spark, sf_dir):
    """One rectangle per line of an order around its boxes, in pixels."""
    b = _boxes(spark, sf_dir).withColumn("line", F.col("k") % 2)
    return C.evidence_boxes(b, "o", "line", ("x0", "y0", "x1", "y1"), F.lit(1.5), F.lit(0.75))


@query(f"""with {_LINES}, w as (select o, k, p % 100 as a, p % 100 + 10 as b from x), r as (select o, k, s % 100 as a, s % 100 + 15 as b from x)
select w.o, w.k, count(*) as spans, cast(sum(least(w.b, r.b) - greatest(w.a, r.a)) as bigint) as common from w join r on w.o = r.o where least(w.b, r.b) - greatest(w.a, r.a) >= 5 group by 1, 2""")
def span_overlap(spark, sf_dir):
    """Words of ten characters and spans of one order that hold half of them or more."""
    x = lines(spark, sf_dir)
    w = x.select("o", "k", (F.col("p") % 100).alias("a"), (F.col("p") % 100 + 10).alias("b"))
    r = x.select("o", (F.col("s") % 100).alias("a"), (F.col("s") % 100 + 15).alias("b"))
    return C.overlap_join(w, r, "o", "a", "b", 0.5).groupBy("o", "k").agg(F.count("*").alias("spans"), F.sum("common").alias("common"))


@query("""with p as (select case p_partkey % 3 when 0 then 'name' when 1 then 'total' else 'raw' end as field, upper(p_name) || ' : ' || p_type as v from part)
select field, case when field = 'total' then v else regexp_replace(lower(v), ' *([.,+:/()-]) *', '\\1', 'g') end as key, count(*) as n from p group by 1, 2""")
def comparison_keys(spark, sf_dir):
    """Texts and raw values by their match key, others as they are."""
    k = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").select(F.when(k == 0, "name").when(k == 1, "total").otherwise("raw").alias("field"), F.concat(F.upper("p_name"), F.lit(" : "), F.col("p_type")).alias("v"))
    return p.select("field", C.comparison_key(F.col("field"), F.col("v"), ["name"], X.match_key, F.col("field") == "raw").alias("key")).groupBy("field", "key").agg(F.count("*").alias("n"))


@query("""with t as (select p_partkey % 5 as k, p_size as s, p_brand as b from part)
select case k when 0 then 'Total: 12' when 1 then 'Date of sale: ' || s when 2 then 'No 5: x' when 3 then 'End:' else 'a b c d: e' end as t, case k when 0 then 1 when 1 then 3 else 0 end as caption, count(*) as n from t group by 1, 2""")
def caption_lengths(spark, sf_dir):
    """Captions of up to three tokens, free of digits, before a colon that something follows."""
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, "Total: 12").when(k == 1, F.concat(F.lit("Date of sale: "), "p_size")).when(k == 2, "No 5: x").when(k == 3, "End:").otherwise("a b c d: e")
    p = table(spark, sf_dir, "part").select(t.alias("t"))
    return p.select("t", C.caption_length(F.split("t", " ")).alias("caption")).groupBy("t", "caption").agg(F.count("*").alias("n"))


@query("""select p_partkey, replace(p_type || ': ' || p_size || ':' || p_brand, ' ', '|') as words from part""")
def caption_words(spark, sf_dir):
    """A caption glued to its value is cut after the colon; a colon after a digit is not."""
    glued = F.concat("p_type", F.lit(":"), "p_size", F.lit(":"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.caption_split(glued), "|").alias("words"))


@query(f"""with {_LINES}, b as (select [p % 50.0, k * 10.0, p % 50.0 + 20, k * 10.0 + 12] as a, [s % 50.0, k * 10.0 + 5, s % 50.0 + 10, k * 10.0 + 11] as b from x)
select round_even(greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) / least((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2])), 6) as share, count(*) as n from b group by 1""")
def overlap_of_smaller(spark, sf_dir):
    """Two boxes of a line: common area over the smaller."""
    f = lambda c: c.cast("double")
    p, s, k = f(F.col("p") % 50), f(F.col("s") % 50), f(F.col("k") * 10)
    share = C.overlap_of_smaller(F.array(p, k, p + 20, k + 12), F.array(s, k + 5, s + 10, k + 11))
    return lines(spark, sf_dir).groupBy(F.bround(share, 6).alias("share")).agg(F.count("*").alias("n"))


@query("""select case when p_partkey % 7 = 0 then null else cast(p_partkey % 5 as double) / 4 end as error, p_size <= 45 as inside, count(*) as n from part group by 1, 2""")
def coordinate_audit(spark, sf_dir):
    """Coordinates moved by a known step: the largest error, null for unequal lengths, and whether all are in the image."""
    s, d = F.col("p_size").cast("double"), (F.col("p_partkey") % 5).cast("double") / 4
    a = F.array(s, F.lit(2.0), F.lit(3.0), F.lit(4.0))
    b = F.when(F.col("p_partkey") % 7 == 0, F.array(s)).otherwise(F.array(s, F.lit(2.0) + d, F.lit(3.0), F.lit(4.0) - d / 2))
    e = table(spark, sf_dir, "part").select(C.coordinate_error(a, b).alias("error"), C.inside_image(a, F.lit(45.0), F.lit(45.0)).alias("inside"))
    return e.groupBy("error", "inside").agg(F.count("*").alias("n"))


# -- workspace tables -----------------------------------------------------------------------------


_SIDE = "p_partkey % 3 = 0 as completed, p_partkey % 11 = 0 as flagged, case when p_partkey % 5 > 0 then (p_partkey % 5) * 90 % 360 else 0 end as rotation"


@query(f"""select p_partkey, {_SIDE}, case when p_partkey % 4 = 0 then 'DATE,ITEM:' || p_size else '' end as missing from part""")
def workspace_images(spark, sf_dir):
    """Parts as images with sidecar tables for completion, flags, rotation and missing fields."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    key = p.select("p_partkey")
    turn = p.where("p_partkey % 5 > 0").select("p_partkey", (((F.col("p_partkey") % 5) * 90 - 360).cast("long")).alias("rotation"))
    gone = p.where("p_partkey % 4 = 0").select("p_partkey", F.explode(F.array(F.concat(F.lit("ITEM:"), "p_size"), F.lit("DATE"), F.lit("DATE"))).alias("field"))
    state = C.state_of_images(key, "p_partkey", key.where("p_partkey % 3 = 0"), key.where("p_partkey % 11 = 0"), turn, gone)
    return state.withColumn("missing", F.array_join("missing", ","))


@query("""select k, fields, count(*) as n from (select p_partkey % 6 as k, case when p_partkey % 6 = 0 then 'A,B' when p_partkey % 6 in (1, 2) then 'old' end as fields from part where p_partkey % 6 < 4) where fields is not null group by 1, 2""")
def missing_field_updates(spark, sf_dir):
    """Entries replaced, deleted by an empty update, and left alone where an update is refused."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 6).alias("k"))
    state = p.where("k < 4").select("p_partkey", F.array(F.lit("old")).alias("fields"))
    new = F.when(F.col("k") == 0, F.array(F.lit("B"), F.lit("A"), F.lit("B"))).when(F.col("k") == 1, F.array(F.lit("?"))).otherwise(F.array().cast("array<string>"))
    updates = p.where("k in (0, 1, 3)").select("p_partkey", new.alias("fields"))
    kept, _ = C.replace_missing(state, updates, "p_partkey", ~F.array_contains("fields", "?"))
    return kept.groupBy((F.col("p_partkey") % 6).alias("k"), F.array_join("fields", ",").alias("fields")).agg(F.count("*").alias("n"))


@query("""select p_partkey from part where p_partkey % 4 <> 3 and p_partkey % 9 <> 0""")
def ids_of_paths(spark, sf_dir):
    """Paths that name accepted parts, with an ending or without."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    name = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 4
    paths = p.where("p_partkey % 4 != 3").select(F.when(k == 0, F.concat(F.lit("a/b.c/"), name, F.lit(".jpg"))).when(k == 1, name).otherwise(F.concat(F.lit("x/"), name, F.lit("/"))).alias("path"))
    accepted = p.where("p_partkey % 9 != 0").select(name.alias("id"))
    return C.ids_from_paths(paths, "path", accepted, "id").select(F.col("id").cast("long").alias("p_partkey"))


@query("""select case p_partkey % 4 when 0 then '[1,2]' when 1 then '[0,2]' when 2 then '[3]' else 'x' end as cell, case when p_partkey % 4 = 0 then '1+2' end as ids, count(*) as n from part group by 1, 2""")
def positive_lists(spark, sf_dir):
    """Cells that should hold two whole numbers above 0."""
    k = F.col("p_partkey") % 4
    p = table(spark, sf_dir, "part").select(F.when(k == 0, "[1,2]").when(k == 1, "[0,2]").when(k == 2, "[3]").otherwise("x").alias("cell"))
    ids = C.positive_list(F.col("cell"), F.lit(2))
    return p.select("cell", F.when(ids.isNotNull(), F.array_join(ids.cast("array<string>"), "+")).alias("ids")).groupBy("cell", "ids").agg(F.count("*").alias("n"))


@query("""select p_partkey, case when p_partkey % 4 = 0 then cast(p_partkey // 4 as varchar) when p_partkey % 4 = 2 then cast(p_partkey // 4 as varchar) || '.5' else printf('%.2f', p_partkey / 4.0) end as number from part""")
def plain_numbers(spark, sf_dir):
    """Quarters as text: whole without a point, else as many decimals as count."""
    return table(spark, sf_dir, "part").select("p_partkey", C.plain_number(F.col("p_partkey") / F.lit(4.0)).alias("number"))


@query("""with t as (select p_partkey as w, p_size as s from part) select count(*) as words, count(*) filter (w % 7 = 0) as first_unlabelled, count(*) filter (w % 5 = 0) as later_labelled from t""")
def subtoken_faults(spark, sf_dir):
    """Words of three sub-tokens, some without a label at the first or with one at the last."""
    w = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(w.alias("w"), F.posexplode(F.array(F.when(w % 7 == 0, "IGNORE").otherwise("B"), F.lit("IGNORE"), F.when(w % 5 == 0, "I").otherwise("IGNORE"))).alias("pos", "label"))
    return C.subtoken_faults(t, ["w"], "pos", "label")


@query("""select p_partkey, case when p_size % 2 = 0 then 1 else 2 end as tag_id from part""")
def first_tags(spark, sf_dir):
    """The first sub-token's tag of a word as its number."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(F.when(F.col("p_size") % 2 == 0, "B-X").otherwise("O"), F.lit("I-X"))).alias("pos", "tag"))
    return C.first_tag_per_word(t, ["p_partkey"], "pos", "tag", spark.createDataFrame([("B-X", 1), ("O", 2), ("I-X", 3)], "tag string, tag_id int"))


@query()
def token_budget_windows(spark, sf_dir):
    """Words of part types as tokens in windows of eight with an overlap of three; no SQL: sequential."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.char_length("p_type").cast("long").alias("tokens"))
    return sequence.plan_windows(p, "p_brand", "p_partkey", "tokens", 60, 20)


# -- loading, exports and geometry ----------------------------------------------------------------


@query("""with p as (select p_partkey as k from part) select case when k % 10 = 3 then 'MISSING' else 'loaded' end as outcome, case when k % 10 <> 3 then cast(k % 4 * 90 as bigint) end as rotation, case when k % 10 <> 3 and k % 6 = 0 then 'DATE,TOTAL' else '' end as missing, count(*) as n from p group by 1, 2, 3""")
def load_split(spark, sf_dir):
    """Parts as annotation rows through CSV sidecars: rotations must be there, missing fields need not."""
    from ..sources import records
    from ..storage import scratch

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("img"))
    turns, path = p.select("img", ((F.col("img").cast("long") % 4) * 90).cast("string").alias("rotation")), scratch(spark, "rotations")
    records.write_csv(turns.where("img % 10 != 3"), path)
    gone = p.where("img % 6 = 0").select("img", F.explode(F.array(F.lit("TOTAL"), F.lit("DATE"))).alias("field"))
    good, bad = C.load_split(p, records.read_csv(spark, path, ["img", "rotation"]), gone, "img")
    rows = good.select(F.lit("loaded").alias("outcome"), F.col("rotation").cast("long").alias("rotation"), F.array_join("missing", ",").alias("missing"))
    rows = rows.unionByName(bad.select(F.col("error").alias("outcome"), F.lit(None).cast("long").alias("rotation"), F.lit("").alias("missing")))
    return rows.groupBy("outcome", "rotation", "missing").agg(F.count("*").alias("n"))


@query("""select unnest(['AFRICA_count', 'ASIA_count', 'known_kinds', 'digests']) as "check", unnest([true, (select count(*) from nation where n_regionkey = 2) = 4, false, false]) as ok""")
def export_package(spark, sf_dir):
    """Nations as quarantined records: five of one kind, not four of another, other kinds, and a copy that differs."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("kind"))
    n = table(spark, sf_dir, "nation").join(r, "n_regionkey").select("n_nationkey", "kind", F.sha2(F.col("n_name").cast("binary"), 256).alias("digest"))
    kinds = {x["kind"]: x["n"] for x in n.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # one row per region
    copies = n.withColumn("digest", F.when(F.col("n_nationkey") != 3, F.col("digest")))
    return C.export_package(n, "kind", {"AFRICA": kinds["AFRICA"], "ASIA": 4}, copies, "n_nationkey", "digest")


@query("""select case when p_partkey % 5 = 0 then 'UNKNOWN_LABEL' when p_partkey % 5 = 1 and p_size % 2 = 0 then 'ITEM_ID_MISSING' when p_partkey % 5 = 2 and p_size % 2 = 1 then 'ITEM_ID_UNEXPECTED' when p_partkey % 7 = 0 then 'CATEGORY_MISMATCH' end as fault, count(*) as n from part group by 1""")
def item_label_faults(spark, sf_dir):
    """Regions with and without item ids, by label and category."""
    k = F.col("p_partkey") % 5
    label = F.when(k == 0, "OTHER").when(k == 1, "ITEM_NAME").otherwise("SELLER")
    item = F.when(((k == 1) | (k == 2)) & (F.col("p_size") % 2 == 1), F.col("p_size"))
    category = F.when(F.col("p_partkey") % 7 == 0, 99).when(k == 1, 20).otherwise(15)
    fault = C.item_label_fault(label, item, category, ["ITEM_NAME"], {"ITEM_NAME": 20, "SELLER": 15})
    return table(spark, sf_dir, "part").groupBy(fault.alias("fault")).agg(F.count("*").alias("n"))


@query("""select n_nationkey, n_name from nation where n_name in ('CHINA', 'BRAZIL') union all select n_nationkey + 100, n_name from nation""")
def subset_or_all(spark, sf_dir):
    """Named nations, and all where none are named."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return C.subset_or_all(n, "n_name", ["CHINA", "BRAZIL"]).unionByName(C.subset_or_all(n, "n_name", None).withColumn("n_nationkey", F.col("n_nationkey") + 100))


@query(f"""with {_LINES} select o, k, cast(q * 1.5 as double) as x0, cast(k * 5 as double) as y0, cast(row_number() over (partition by o order by k desc) as int) as position from x""")
def rescaled_lines(spark, sf_dir):
    """Cached lines with an order of their own, at the expected size of the page."""
    x = lines(spark, sf_dir).select("o", "k", (-F.col("k")).alias("rank"), F.col("q").cast("double").alias("x0"), (F.col("k") * 10).cast("double").alias("y0"))
    return C.rescaled_lines(x, "o", "rank", {"x0": F.lit(1.5), "y0": F.lit(0.5)}).drop("rank")


@query(f"""with {_LINES} select o, avg((p % 8 <> 0)::int) as rate from x group by 1 having avg((p % 8 <> 0)::int) < 0.9""")
def low_match(spark, sf_dir):
    """Orders that match less than nine tenths of their lines."""
    return C.low_match(lines(spark, sf_dir).select("o", (F.col("p") % 8 != 0).alias("m")), "o", "m")


@query("""select p_partkey % 4 in (0, 1) as same, count(*) as n from part group by 1""")
def same_points(spark, sf_dir):
    """Polygons moved by nothing, by little, by much, and with a point less."""
    s, k = F.col("p_size").cast("double"), F.col("p_partkey") % 4
    a = F.array(s, F.lit(1.0), F.lit(2.0), s)
    b = F.when(k == 3, F.array(s, F.lit(1.0))).otherwise(F.array(s, F.lit(1.0) + F.when(k == 1, 0.005).when(k == 2, 0.5).otherwise(0.0), F.lit(2.0), s))
    return table(spark, sf_dir, "part").groupBy(C.same_points(a, b).alias("same")).agg(F.count("*").alias("n"))


@query("""with p as (select p_partkey % 9 as e, cast(p_size + 60 as double) as w, cast(p_size + 80 as double) as h, 3.0 as x, 5.0 as y from part)
select cast(e as bigint) as e, case e when 1 then x when 2 then w - 1 - x when 3 then w - 1 - x when 4 then x when 5 then y when 6 then h - 1 - y when 7 then h - 1 - y when 8 then y end as sx,
case e when 1 then y when 2 then y when 3 then h - 1 - y when 4 then h - 1 - y when 5 then x when 6 then x when 7 then w - 1 - x when 8 then w - 1 - x end as sy, count(*) as n from p group by 1, 2, 3""")
def orientations(spark, sf_dir):
    """A stored point as it is shown, by each of the eight orientations; an unknown one has no matrix."""
    w, h = F.col("p_size") + 60, F.col("p_size") + 80
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 9).alias("e"), C.orientation_matrix(F.col("p_partkey") % 9, w, h).alias("m"))
    at = lambda r: F.col("m")[3 * r] * 3.0 + F.col("m")[3 * r + 1] * 5.0 + F.col("m")[3 * r + 2]
    return p.select("e", at(0).alias("sx"), at(1).alias("sy")).groupBy("e", "sx", "sy").agg(F.count("*").alias("n"))


# -- receipts that are one, and splits that keep them together ------------------------------------

_KEYED = """r as (select o_orderkey as d, strftime(o_orderdate, '%Y%m') || '01' || case when o_orderkey % 3 = 0 then '' else '1000' end as t, cast(cast(floor(o_totalprice / 1000) as bigint) % 20 as varchar) as a,
case when o_orderkey % 9 = 0 then null else regexp_replace(o_orderpriority, '[^A-Z0-9]+', ' ', 'g') end as name, case when o_custkey % 4 = 0 then 'CUA HANG D ' || (o_custkey % 12) when o_custkey % 4 = 1 then '<NO_SELLER>' else 'RARE ' || o_custkey end as seller from orders),
k as (select d, seller, case when length(t) >= 10 then t || '|' || a when name is not null then t || '|' || a || '|' || name || '|ZZ 1' end as key from r)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receipts: some without a clock, some without items, sellers that are frequent, rare or unnamed."""
    o = table(spark, sf_dir, "orders")
    time = F.concat(F.date_format("o_orderdate", "yyyy-MM-01"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(" 10:00"))
    names = F.when(F.col("o_orderkey") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(linkage.name_key(F.lit("zz-1")), linkage.name_key(F.lower("o_orderpriority"))))
    seller = F.when(F.col("o_custkey") % 4 == 0, F.format_string("Cửa hàng Đ. %d", F.col("o_custkey") % 12)).when(F.col("o_custkey") % 4 == 1, "--").otherwise(F.format_string("rare: %d", "o_custkey"))
    total = (F.floor(F.col("o_totalprice") / 1000) % 20).cast("string")
    return o.select(F.col("o_orderkey").alias("d"), linkage.receipt_key(time, F.concat(total, F.lit(" VND")), names).alias("key"), linkage.seller_key(seller).alias("seller"))


@query(f"with {_KEYED} select key, count(*) as n, min(d) as first from k group by 1")
def receipt_keys(spark, sf_dir):
    """Orders by their receipt key; null holds those whose key lacks a part."""
    return _keyed(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"), F.min("d").alias("first"))


@query(f"""with {_KEYED}, g as (select d, coalesce(min(d) over (partition by key), d) as m, key, case when count(*) over (partition by seller) >= 20 then seller else '<OTHER>' end as bucket from k),
p as (select case when key is null then d else m end as group_id, bucket, d from g), c as (select group_id, bucket, count(*) as n, min(d) as m from p group by 1, 2),
s as (select group_id, bucket, row_number() over (partition by group_id order by n desc, m) as rank, sum(n) over (partition by group_id) as size from c)
select group_id, bucket as stratum, cast(size as bigint) as size from s where rank = 1""")
def receipt_strata(spark, sf_dir):
    """Groups of one receipt with the seller bucket that most of their members have."""
    return linkage.seller_strata(_keyed(spark, sf_dir), "d", "key", "seller").groupBy("group_id", "stratum").agg(F.count("*").alias("size"))


@query()
def receipt_split(spark, sf_dir):
    """Groups of one receipt dealt to splits inside each seller stratum; no SQL: a fold per stratum."""
    return splits.greedy_by_stratum(receipt_strata(spark, sf_dir), "stratum", "group_id", "size", {"train": 0.8, "val": 0.1, "test": 0.1})
