"""Queries that apply the operators to the driver's tables.

The tables hold no receipts; each docstring says which column plays which role.  The SQL beside each
query is for DuckDB over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import fields
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import graph, lineitems, linkage, sequence, splits
from ..storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function by its name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- evaluation -----------------------------------------------------------------------------------

_SLOTS = """slots as (
  select d.doc_id, 'quality' as field, case when l.quality is null then 'unlabeled' else 'annotated' end as status,
    cast(l.quality as varchar) as gt, case when d.n_chars >= 300 then '1' else '0' end as pred
  from documents d left join labels l on d.doc_id = l.doc_id
  union all
  select d.doc_id, 'toxic', case when l.toxic is null then 'source_missing' when l.toxic = 0 then 'absent' else 'annotated' end,
    case when l.toxic = 1 then 'toxic' end, case when d.n_chars % 5 = 0 then 'toxic' end
  from documents d left join labels l on d.doc_id = l.doc_id)"""


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.struct(F.lit("quality").alias("field"), F.when(F.col("quality").isNull(), "unlabeled").otherwise("annotated").alias("status"), F.col("quality").cast("string").alias("gt"), F.when(F.col("n_chars") >= 300, "1").otherwise("0").alias("pred"))
    t = F.struct(F.lit("toxic").alias("field"), F.when(F.col("toxic").isNull(), "source_missing").when(F.col("toxic") == 0, "absent").otherwise("annotated").alias("status"), F.when(F.col("toxic") == 1, "toxic").alias("gt"), F.when(F.col("n_chars") % 5 == 0, "toxic").alias("pred"))
    return d.select(F.col("doc_id").alias("document_id"), F.explode(F.array(q, t)).alias("s")).select("document_id", "s.*")


@query(f"""with {_SLOTS}, m as (select *, status in ('annotated','annotated_empty','absent') as ev, gt is not distinct from pred as hit from slots),
c as (select field, grouping(field) as total, count(*) filter (ev) as evaluable, count(*) filter (not ev) as masked,
  count(*) filter (ev and hit) as correct, count(*) filter (ev and hit and gt is not null) as tp,
  count(*) filter (ev and not hit and pred is not null) as fp, count(*) filter (ev and not hit and gt is not null) as fn,
  count(*) filter (ev and gt is not null) as support from m group by rollup(field)),
r as (select *, case when evaluable > 0 then case when tp + fp > 0 then tp / (tp + fp) when tp + fn > 0 then 0.0 end end as "precision",
  case when evaluable > 0 and tp + fn > 0 then tp / (tp + fn) end as recall from c),
f as (select *, case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) when "precision" + recall = 0 then 0.0 end as f1 from r)
select coalesce(field, 'ALL') as field, evaluable, masked, correct, tp, fp, fn, support, "precision", recall, f1,
  case when total = 1 then (select avg(f1) from f where total = 0) end as macro_f1 from f""")
def field_eval_rollup(spark, sf_dir):
    """Labels are the ground truth, rules on the text length the predictions; documents without a label are masked."""
    return E.evaluate_fields(_slots(spark, sf_dir))


@query(f"""with {_SLOTS}, p as (select doc_id, bool_and(gt is not distinct from pred) as ok from slots
where status in ('annotated','annotated_empty','absent') group by 1) select count(*) as documents, count(*) filter (ok) as exact from p""")
def document_exact(spark, sf_dir):
    """Documents with every evaluable slot right; the slots of ``field_eval_rollup``."""
    return E.document_exact_match(_slots(spark, sf_dir))


_TAGS = """tags as (select conv_id, turn, case when turn % 7 = 6 then 'IGNORE' when length(text) % 5 = 0 then 'O'
  when length(text) % 3 = 0 then 'B-' || role else 'I-' || role end as gold,
  case when turn % 4 = 3 then 'O' when length(text) % 3 = 0 then 'B-' || role else 'I-' || role end as pred from conversations)"""


def _tags(spark, sf_dir):
    n, turn, role = F.char_length("text"), F.col("turn"), F.col("role")
    b, i = F.concat(F.lit("B-"), role), F.concat(F.lit("I-"), role)
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(turn % 7 == 6, "IGNORE").when(n % 5 == 0, "O").when(n % 3 == 0, b).otherwise(i).alias("gold"),
        F.when(turn % 4 == 3, "O").when(n % 3 == 0, b).otherwise(i).alias("pred"),
    )


def _span_sql(tag: str) -> str:
    return f"""s_{tag} as (select conv_id, label, min(turn) as s, max(turn) + 1 as e from (
    select *, sum(case when label is not null and not coalesce(starts_with(t, 'I-') and b <> 'O' and substr(b, 3) = label, false) then 1 else 0 end)
      over (partition by conv_id order by turn) as n from (
      select conv_id, turn, case when {tag} = 'IGNORE' then 'O' else {tag} end as t, case when {tag} not in ('IGNORE','O') then substr({tag}, 3) end as label,
        lag(case when {tag} = 'IGNORE' then 'O' else {tag} end) over (partition by conv_id order by turn) as b from tags)) where label is not null group by conv_id, n, label)"""


@query(f"""with {_TAGS}, {_span_sql('gold')}, {_span_sql('pred')},
g as (select conv_id, label, s, e, count(*) as g from s_gold group by all), p as (select conv_id, label, s, e, count(*) as p from s_pred group by all),
b as (select coalesce(g.label, p.label) as label, coalesce(g, 0) as g, coalesce(p, 0) as p from g full join p on g.conv_id = p.conv_id and g.label = p.label and g.s = p.s and g.e = p.e),
c as (select label, grouping(label) as t, cast(sum(least(g, p)) as bigint) as tp, cast(sum(p) as bigint) as predicted, cast(sum(g) as bigint) as support from b group by rollup(label)),
r as (select *, case when predicted > 0 then tp / predicted else 0.0 end as pr, case when support > 0 then tp / support else 0.0 end as rc from c)
select coalesce(label, 'ALL') as label, tp, predicted, support, pr as "precision", rc as recall, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end as f1 from r""")
def entity_span_eval(spark, sf_dir):
    """Roles of conversation turns, with lengths deciding the tag's kind, are two taggings; spans are compared exactly."""
    tags = _tags(spark, sf_dir)
    return E.evaluate_spans(E.bio_spans(tags, ["conv_id"], "turn", "gold"), E.bio_spans(tags, ["conv_id"], "turn", "pred"), ["conv_id"])


@query(f"""with {_TAGS}, x as (select conv_id, gold, last_value(case when gold <> 'IGNORE' then gold end ignore nulls) over
(partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as b from tags)
select conv_id, not bool_or(starts_with(gold, 'I-') and coalesce(substr(b, 3), '') <> substr(gold, 3)) as valid from x group by 1""")
def bio_validity(spark, sf_dir):
    """The taggings of ``entity_span_eval``: is every inside tag after one of its label?"""
    return E.bio_invalid(_tags(spark, sf_dir), ["conv_id"], "turn", "gold")


@query(f"""with {_TAGS}, x as (select conv_id, turn, gold, turn // 3 as region, last_value(case when gold <> 'IGNORE' then turn // 3 end ignore nulls) over
(partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as b from tags)
select case when starts_with(gold, 'I-') and b is distinct from region then 'B-' || substr(gold, 3) else gold end as tag, count(*) as n from x group by 1""")
def bio_repair(spark, sf_dir):
    """Regions are runs of three turns; inside tags that begin a region become begin tags."""
    tags = _tags(spark, sf_dir).withColumn("region", F.floor(F.col("turn") / 3))
    return sequence.repair_bio(tags, "conv_id", "turn", "gold", "region").groupBy(F.col("gold").alias("tag")).agg(F.count("*").alias("n"))


@query("""with b as (select p_brand as label, p_name as ref, case when p_partkey % 3 = 0 then replace(p_name, 'a', 'o') when p_partkey % 3 = 1 then p_name || 'x' else p_name end as hyp from part),
c as (select label, grouping(label) as t, count(*) as pairs, cast(sum(levenshtein(ref, hyp)) as bigint) as edits, cast(sum(length(ref)) as bigint) as chars, count(*) filter (ref = hyp) as exact from b group by rollup(label))
select coalesce(label, 'ALL') as label, pairs, edits, chars, exact, case when chars > 0 then edits / chars end as cer from c""")
def corpus_cer(spark, sf_dir):
    """Part names are references, names with letters changed or added the readings, brands the labels (ASCII)."""
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    hyp = F.when(k == 0, F.replace(n, F.lit("a"), F.lit("o"))).when(k == 1, F.concat(n, F.lit("x"))).otherwise(n)
    return E.corpus_cer(table(spark, sf_dir, "part").select("p_brand", n.alias("ref"), hyp.alias("hyp")), "p_brand", "ref", "hyp")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(n) as n, min(value) as least, max(value) as most, min(value) filter (i >= round_even((n - 1) * 0.5, 0)) as median, min(value) filter (i >= round_even((n - 1) * 0.95, 0)) as p95 from r group by 1""")
def latency_stats(spark, sf_dir):
    """Event values are latencies by type; percentiles are nearest ranks with halves to even."""
    return E.nearest_rank_stats(table(spark, sf_dir, "events"), "event_type", "value", {"median": 0.5, "p95": 0.95})


@query("""with v as (select l_linenumber as key, l_discount as v, cast(sum(cast(l_quantity as bigint)) as bigint) as w, count(*) as n from lineitem group by 1, 2),
r as (select *, sum(w) over (partition by key order by v) as upto, sum(w) over (partition by key) as total from v)
select key as l_linenumber, cast(sum(n) as bigint) as "rows", min(v) filter (upto * 2 >= total) as weighted_median from r group by 1""")
def weighted_median(spark, sf_dir):
    """Discounts weighted by quantity, per line number."""
    items = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_discount", F.col("l_quantity").cast("long").alias("w"))
    return E.weighted_median(items, "l_linenumber", "l_discount", "w", 3)


@query("""with c as (select l_suppkey, l_returnflag, count(*) as n, min((l_shipdate, l_orderkey, l_linenumber)) as f from lineitem group by 1, 2),
r as (select *, row_number() over (partition by l_suppkey order by n desc, f) as r from c) select l_suppkey, l_returnflag as mode, n from r where r = 1""")
def mode_first_seen(spark, sf_dir):
    """The most frequent return flag per supplier; ties by the earliest shipped."""
    return E.mode_first_seen(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("""with g as (select unnest([100, 300, 1000, 3000]) as threshold), s as (select threshold, count(*) as n, count(*) filter ((d.n_chars >= threshold) = (l.quality = 1)) as correct
from documents d join labels l on d.doc_id = l.doc_id cross join g group by 1) select threshold, n, correct, row_number() over (order by correct desc, threshold) = 1 as best from s""")
def param_sweep(spark, sf_dir):
    """A grid of length thresholds against the quality labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    grid = spark.createDataFrame([(t,) for t in (100, 300, 1000, 3000)], "threshold int")
    return E.parameter_sweep(d, grid, (F.col("n_chars") >= F.col("threshold")) == (F.col("quality") == 1), ["threshold"])


@query("""with x as (select l_orderkey as d, l_returnflag as g, l_returnflag || l_linestatus as p, count(*) as n from lineitem group by 1, 2, 3),
b as (select sum(n * (n - 1) // 2) as shared from x), g as (select sum(n * (n - 1) // 2) as gold from (select d, g, sum(n) as n from x group by 1, 2)),
p as (select sum(n * (n - 1) // 2) as predicted from (select d, p, sum(n) as n from x group by 1, 2)),
r as (select cast(shared as bigint) as shared, cast(gold as bigint) as gold, cast(predicted as bigint) as predicted from b, g, p)
select *, shared / predicted as "precision", shared / gold as recall, 2 * (shared / predicted) * (shared / gold) / (shared / predicted + shared / gold) as f1 from r""")
def pair_f1(spark, sf_dir):
    """Lines of an order grouped by flag (gold) and by flag and status (predicted)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").withColumn("member", F.monotonically_increasing_id())
    both = li.select(F.col("l_orderkey").alias("d"), F.col("l_returnflag").alias("g"), F.concat("l_returnflag", "l_linestatus").alias("p"), "member")
    pairs = lambda *keys: both.groupBy("d", *keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("div(n * (n - 1), 2)")), F.lit(0)).alias("x"))
    return E.pair_scores(pairs("g", "p"), pairs("g"), pairs("p"))


@query("""with c as (select l.l_returnflag as a, l.l_linestatus as b, o.o_orderstatus as s from lineitem l join orders o on l.l_orderkey = o.o_orderkey)
select feature, n from (select 'flag:' || a as feature, count(*) as n from c group by 1 union all select 'status:' || b, count(*) from c group by 1
union all select 'order:' || s, count(*) from c group by 1 union all select 'documents', count(*) from c)""")
def feature_counts(spark, sf_dir):
    """One count per feature of a joined line: flags, statuses and the total."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    features = F.array(F.lit("documents"), F.concat(F.lit("flag:"), "l_returnflag"), F.concat(F.lit("status:"), "l_linestatus"), F.concat(F.lit("order:"), "o_orderstatus"))
    return c.groupBy("l_returnflag", "l_linestatus", "o_orderstatus").agg(F.count("*").alias("k")).select(F.explode(features).alias("feature"), "k").groupBy("feature").agg(F.sum("k").alias("n"))


# -- linkage and splits ---------------------------------------------------------------------------


@query("""select sha256(text) as "key", count(*) as size, min(doc_id) as first, 'documents_' || substr(sha256(array_to_string(list_sort(list(cast(doc_id as varchar))), chr(10))), 1, 16) as group_id
from documents group by 1 having count(*) > 1""")
def exact_dup_groups(spark, sf_dir):
    """Documents with equal texts, and the stable id of each group."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    groups = linkage.exact_groups(d, F.col("key"), "doc_id")
    members = d.join(groups, "key").groupBy("key").agg(F.collect_list(F.col("doc_id").cast("string")).alias("m"))
    return groups.join(members, "key").select("key", "size", "first", linkage.stable_group_id("documents", F.col("m")).alias("group_id"))


def _prints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    # Written once: pairs read it from both sides.
    return materialize(linkage.simhash60(docs, "id", "text", "fp").groupBy("fp").agg(F.min("id").alias("id")), "prints")


_FP = """w as (select distinct doc_id as id, unnest(regexp_split_to_array(text, '[ \\n]+')) as w from documents),
h as (select id, cast('0x' || substr(sha256(w), 1, 15) as bigint) as h from w where w <> ''),
each as (select id, cast(sum(case when 2 * v > n then 1::bigint << b else 0 end) as bigint) as fp from (
  select id, b, count(*) as n, sum((h >> b) & 1) as v from h, range(60) r(b) group by 1, 2) group by 1),
zero as (select doc_id as id, 0::bigint as fp from documents where doc_id not in (select id from each)),
fp as (select fp, min(id) as id from (select id, fp from each union all select id, fp from zero) group by 1)"""


@query(f"with {_FP} select id, fp from fp")
def simhash60(spark, sf_dir):
    """The distinct 60-bit fingerprints of the words of documents, and the first document of each."""
    return _prints(spark, sf_dir).select("id", "fp")


@query(f"with {_FP} select a.id as a, b.id as b, cast(bit_count(xor(a.fp, b.fp)) as int) as distance, case when a.id % 7 = 0 then 'reviewed' when bit_count(xor(a.fp, b.fp)) = 0 then 'confirmed' when bit_count(xor(a.fp, b.fp)) <= 2 then 'likely' else 'possible' end as status from fp a join fp b on a.id < b.id where bit_count(xor(a.fp, b.fp)) <= 4")
def near_pairs(spark, sf_dir):
    """Documents within 4 bits, by slices, equal ones counted once; a made-up review overrides the rule for every seventh."""
    p = linkage.hamming_pairs(_prints(spark, sf_dir), "id", "fp", 4)
    return p.withColumn("status", linkage.near_status(F.col("distance"), F.when(F.col("a") % 7 == 0, "reviewed")))


@query(f"""with recursive {_FP}, e as materialized (select a.id as a, b.id as b from fp a join fp b on a.id < b.id where bit_count(xor(a.fp, b.fp)) <= 4),
s as materialized (select a, b from e union select b, a from e), r(node, root) as (select a, a from s union select r.node, s.b from r join s on r.root = s.a)
select node, min(root) as root from r group by 1""")
def components(spark, sf_dir):
    """Groups of near documents: every one that has a link within 4 bits, with the smallest it reaches."""
    return graph.connected_components(linkage.hamming_pairs(_prints(spark, sf_dir), "id", "fp", 4).select("a", "b"))


@query(f"""with recursive {_FP}, t as (select doc_id, sha256(text) as h from documents), m as (select h, min(doc_id) as b from t group by 1),
e as materialized (select a.id as a, b.id as b, 'near' as reason from fp a join fp b on a.id < b.id where bit_count(xor(a.fp, b.fp)) <= 2 union all select doc_id, b, 'exact' from t join m using (h) where doc_id <> b),
s as materialized (select a, b from e union select b, a from e), r(node, root) as (select a, a from s union select r.node, s.b from r join s on r.root = s.a),
g as (select doc_id, coalesce(min(root), doc_id) as root from t left join r on r.node = doc_id group by doc_id), why as (select root, string_agg(distinct reason, ',' order by reason) as reasons from e join g on g.doc_id = e.a group by 1)
select doc_id, g.root as group_id, count(*) over (partition by g.root) as size, coalesce(reasons, '') as reasons from g left join why on why.root = g.root""")
def duplicate_groups(spark, sf_dir):
    """Every document with its duplicate group, by equal texts and links within 2 bits, and why."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    near = linkage.hamming_pairs(_prints(spark, sf_dir), "id", "fp", 2)
    found = linkage.duplicate_groups(d, "doc_id", "h", near, graph.connected_components)
    return found.withColumn("reasons", F.array_join("reasons", ","))


_SPLIT = "case when cast('0x' || substr(sha256('42:' || cast({k} as varchar)), 1, 8) as bigint) % 10 < 8 then 'train' when cast('0x' || substr(sha256('42:' || cast({k} as varchar)), 1, 8) as bigint) % 10 < 9 then 'val' else 'test' end"


@query(f"""with s as (select o_custkey as key, {_SPLIT.format(k='o_orderkey')} as split from orders) select key, count(distinct split) as splits, count(*) as "rows" from s group by 1 having count(distinct split) > 1""")
def split_leakage(spark, sf_dir):
    """Orders are dealt to splits by hash; customers whose orders cross splits leak."""
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), splits.hash_split(42, "o_orderkey", {"train": 8, "val": 1, "test": 1}).alias("split"))
    return linkage.leakage(s, "key", "split")


@query(f"""with s as (select c_custkey, c_mktsegment, {_SPLIT.format(k='c_custkey')} as split from customer) select split, c_mktsegment, count(*) as n, cast(sum(count(*)) over (partition by split) as bigint) as split_size from s group by 1, 2""")
def hash_split_report(spark, sf_dir):
    """Customers per split and segment under a seeded hash."""
    s = table(spark, sf_dir, "customer").select("c_mktsegment", splits.hash_split(42, "c_custkey", {"train": 8, "val": 1, "test": 1}).alias("split"))
    return s.groupBy("split", "c_mktsegment").agg(F.count("*").alias("n")).withColumn("split_size", F.sum("n").over(Window.partitionBy("split")))


@query("""with c as (select c_mktsegment, count(*) as "rows" from customer group by 1), t as (select *, sum("rows") over () as total from c),
q as (select c_mktsegment, "rows", 97 * "rows" // total as f, 97 * "rows" % total as rest from t),
r as (select *, row_number() over (order by rest desc, c_mktsegment desc) as k, 97 - sum(f) over () as l from q)
select c_mktsegment, "rows", cast(f + case when k <= l then 1 else 0 end as bigint) as quota from r""")
def stratified_quota(spark, sf_dir):
    """97 places among market segments by largest remainder."""
    return splits.largest_remainder(table(spark, sf_dir, "customer"), "c_mktsegment", 97)


@query("""with c as (select c_mktsegment, count(*) as n from customer group by 1), t as (select *, sum(n) over () as total from c),
q as (select c_mktsegment, 97 * n // total as f, 97 * n % total as rest from t),
r as (select *, row_number() over (order by rest desc, c_mktsegment desc) as k, 97 - sum(f) over () as l from q),
o as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by sha256('42:' || cast(c_custkey as varchar)), c_custkey) as rank from customer)
select c_custkey, o.c_mktsegment from o join r on o.c_mktsegment = r.c_mktsegment where rank <= f + case when k <= l then 1 else 0 end""")
def stratified_sample(spark, sf_dir):
    """The customers that fill those places, in seeded order (a sampling operator)."""
    return splits.stratified_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 97)


@query("""with o as (select p_partkey, row_number() over (order by p_partkey) - 1 as i from part) select p_partkey from o where i % 5 = 2""")
def stride_shard(spark, sf_dir):
    """Every fifth part, from the third."""
    return splits.stride_shard(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], 2, 5)


@query()
def greedy_split(spark, sf_dir):
    """Nations are strata, customers groups weighed by their orders; no SQL: a sequential fold."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("size"))
    g = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey")
    return splits.greedy_by_stratum(g, "c_nationkey", "c_custkey", "size", {"train": 0.8, "val": 0.1, "test": 0.1})


@query()
def greedy_objective_split(spark, sf_dir):
    """Nations are groups; customers and orders the features to balance; no SQL: a sequential fold."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    g = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("documents"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"))
    return splits.greedy_objective(g, "c_nationkey", ["documents", "orders"], {"train": 0.8, "val": 0.1, "test": 0.1})


@query("""with k as (select strftime(o_orderdate, '%Y%m') || '|' || cast(floor(o_totalprice / 1000) as bigint) as key from orders) select key, count(*) as n from k group by 1 having count(*) > 1""")
def record_linkage_key(spark, sf_dir):
    """Month and total in thousands, as digits, link orders that may be one receipt."""
    k = linkage.record_key(F.date_format("o_orderdate", "yyyy-MM"), F.format_string("%,d", F.floor(F.col("o_totalprice") / 1000)))
    return table(spark, sf_dir, "orders").select(k.alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


# -- text and values ------------------------------------------------------------------------------


@query("""with a as (select l_orderkey, l_linenumber, l_extendedprice as v, case l_linenumber % 3 when 0 then printf('%.2f', l_extendedprice)
  when 1 then printf('%,.2f', l_extendedprice) else replace(replace(replace(printf('%,.2f', l_extendedprice), ',', '#'), '.', ','), '#', '.') end as raw from lineitem)
select raw, 'ok' as status, regexp_replace(printf('%.2f', v), '[.]0+$', '') as value, count(*) as n from a group by all""")
def amount_normalize(spark, sf_dir):
    """Prices written plain, with English and with continental marks, read back."""
    p, k = F.format_string("%.2f", "l_extendedprice"), F.col("l_linenumber") % 3
    en = F.format_string("%,.2f", "l_extendedprice")
    raw = F.when(k == 0, p).when(k == 1, en).otherwise(F.translate(en, ",.", ".,"))
    a = table(spark, sf_dir, "lineitem").select(raw.alias("raw")).withColumn("r", fields.amount_field(F.col("raw"), F.lit("vi-VN")))
    return a.groupBy("raw", F.col("r.status").alias("status"), F.col("r.value").alias("value")).agg(F.count("*").alias("n"))


@query("""with q as (select case when l_orderkey % 11 = 0 then '' when l_orderkey % 11 = 1 then 'x' || cast(l_linenumber as varchar) else printf('%.3f', l_quantity) end as raw from lineitem)
select case when raw = '' then 'missing' when starts_with(raw, 'x') then 'invalid' else 'ok' end as status, case when raw <> '' and not starts_with(raw, 'x') then regexp_replace(regexp_replace(raw, '0+$', ''), '[.]$', '') end as value, count(*) as n from q group by 1, 2""")
def quantity_normalize(spark, sf_dir):
    """Quantities with three decimals, some empty or malformed."""
    raw = F.when(F.col("l_orderkey") % 11 == 0, "").when(F.col("l_orderkey") % 11 == 1, F.concat(F.lit("x"), F.col("l_linenumber").cast("string"))).otherwise(F.format_string("%.3f", "l_quantity"))
    q = table(spark, sf_dir, "lineitem").select(fields.quantity_field(raw).alias("r"))
    return q.groupBy(F.col("r.status").alias("status"), F.col("r.value").alias("value")).agg(F.count("*").alias("n"))


@query("""with d as (select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then 'on ' || strftime(o_orderdate, '%Y-%m-%d') when 2 then strftime(o_orderdate, '%d/%m/%y')
  when 3 then strftime(o_orderdate, '%d-%m-%Y') || ' or 1999-12-31' else strftime(o_orderdate, '%d.%m.%Y') end as raw, o_orderkey % 5 as k, strftime(o_orderdate, '%Y-%m-%d') as iso from orders)
select case k when 2 then 'invalid' when 3 then 'ambiguous' else 'ok' end as status, case when k in (0, 1, 4) then iso end as value, count(*) as n from d group by 1, 2""")
def date_normalize(spark, sf_dir):
    """Order dates written five ways: two-digit years are invalid, two dates ambiguous."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    f = lambda p: F.date_format(d, p)
    raw = F.when(k == 0, f("dd/MM/yyyy")).when(k == 1, F.concat(F.lit("on "), f("yyyy-MM-dd"))).when(k == 2, f("dd/MM/yy")).when(k == 3, F.concat(f("dd-MM-yyyy"), F.lit(" or 1999-12-31"))).otherwise(f("dd.MM.yyyy"))
    r = table(spark, sf_dir, "orders").select(fields.date_field(raw, F.lit("vi-VN")).alias("r"))
    return r.groupBy(F.col("r.status").alias("status"), F.col("r.value").alias("value")).agg(F.count("*").alias("n"))


@query("""select status, value, count(*) as n from (select case when event_id % 4 = 3 then 'missing' else 'ok' end as status,
 case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 1 then strftime(ts, '%Y-%m-%dT00:00:00') when 2 then strftime(ts, '%Y-%m-%dT%H:%M:00') end as value from events) group by 1, 2""")
def timestamp_normalize(spark, sf_dir):
    """Event times written with seconds, without a clock, with minutes, and empty."""
    k = F.col("event_id") % 4
    f = lambda p: F.date_format("ts", p)
    raw = F.when(k == 0, f("dd/MM/yyyy HH:mm:ss")).when(k == 1, f("yyyy-MM-dd")).when(k == 2, f("dd-MM-yyyy HH:mm")).otherwise("")
    r = table(spark, sf_dir, "events").select(fields.timestamp_field(raw).alias("r"))
    return r.groupBy(F.col("r.status").alias("status"), F.col("r.value").alias("value")).agg(F.count("*").alias("n"))


@query("""select doc_id, sha256(coalesce(nullif(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), ''), '')) as canonical,
sha256(coalesce(regexp_replace(lower(nullif(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), '')), ' *([.,+:/()-]) *', '\\1', 'g'), '')) as match_key,
sha256(regexp_replace(text, '[^0-9]', '', 'g')) as digits from documents""")
def text_normalize(spark, sf_dir):
    """Digests of whole texts in canonical form, as matching keys, and their digits."""
    h = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", h(X.canonical_raw(t)).alias("canonical"), h(X.match_key(t)).alias("match_key"), h(X.digits(t)).alias("digits"))


@query("""select doc_id, sha256(replace(strip_accents(replace(replace(lower(text), 'đ', 'd'), 'ß', '§')), '§', 'ß')) as folded from documents""")
def text_fold(spark, sf_dir):
    """Whole texts without marks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.fold(F.col("text")).cast("binary"), 256).alias("folded"))


@query("""select regexp_extract(url, '[^/]*$') as name, count(*) as n from (select regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), '^[.]+', '') as url from pages) group by 1""")
def safe_filenames(spark, sf_dir):
    """Page addresses as file names."""
    return table(spark, sf_dir, "pages").select(X.safe_filename(F.col("url")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("""with s as (select p_partkey, case when p_size % 4 = 0 then '' when p_size % 4 = 1 then p_brand else p_brand || '|||' || p_type end as cell from part)
select case when cell = '' then 0 else len(string_split(cell, '|||')) end as parts, count(*) as n from s group by 1""")
def compound_cells(spark, sf_dir):
    """Brand and type as cells delimited by bars; an empty cell is an empty list."""
    k = F.col("p_size") % 4
    cell = F.when(k == 0, "").when(k == 1, F.col("p_brand")).otherwise(F.concat_ws("|||", "p_brand", "p_type"))
    return table(spark, sf_dir, "part").select(F.size(X.split_compound(cell)).cast("bigint").alias("parts")).groupBy("parts").agg(F.count("*").alias("n"))


# -- line items -----------------------------------------------------------------------------------


@query("""with l as (select cast(l_quantity as decimal(18,3)) as q, case when l_orderkey % 3 = 0 then null else cast(l_quantity as decimal(18,3)) end as given from lineitem)
select case when given is null then 'inferred' else 'given' end as kind, cast(sum(q) as double) as quantity, count(*) as n from l group by 1""")
def quantity_infer(spark, sf_dir):
    """A third of the quantities are hidden and worked out again from unit and extended price."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity is not null")
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,4)")
    given = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity").cast("decimal(18,3)"))
    q = li.select(F.when(given.isNull(), "inferred").otherwise("given").alias("kind"), lineitems.infer_quantity(given, price, F.col("l_extendedprice").cast("decimal(18,4)")).alias("q"))
    return q.groupBy("kind").agg(F.sum("q").cast("double").alias("quantity"), F.count("*").alias("n"))


_LINES = "g as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, min(l_quantity) as l_quantity from lineitem group by 1, 2, 3, 4)"


@query("""with g as (select l_orderkey as o, l_linenumber as k, min(l_returnflag) as flag, min(l_linestatus) as status, cast(min(l_quantity) as bigint) as quantity from lineitem group by 1, 2),
p as (select o, k, case when o % 5 = 0 then 'X' else flag end as flag, status, case when k = 2 then null else quantity end as quantity from g where o % 7 <> 0),
b as (select g.flag as gf, p.flag as pf, g.status as gs, p.status as ps, g.quantity as gq, p.quantity as pq from g full join p on g.o = p.o and g.k = p.k)
select cell, count(*) as compared, count(*) filter (a is distinct from b) as wrong from (select 'flag' as cell, gf as a, pf as b from b union all select 'status', gs, ps from b union all select 'quantity', cast(gq as varchar), cast(pq as varchar) from b) where a is not null or b is not null group by 1""")
def cell_errors(spark, sf_dir):
    """Lines against a version with flags changed, quantities dropped and orders missing."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k")).agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_quantity").cast("bigint").alias("quantity"))
    p = g.where("o % 7 != 0").select("o", "k", F.when(F.col("o") % 5 == 0, "X").otherwise(F.col("flag")).alias("flag"), "status", F.when(F.col("k") != 2, F.col("quantity")).alias("quantity"))
    return lineitems.cell_errors(g, p, ["o", "k"], ["flag", "status", "quantity"])


@query()
def greedy_match(spark, sf_dir):
    """Lines of an order against shuffled, partly wrong ones; no SQL: a sequential fold."""
    g = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    p = g.select("l_orderkey", (8 - F.col("l_linenumber")).alias("l_linenumber"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_returnflag")).alias("l_returnflag"), "l_partkey")
    return lineitems.greedy_match(g, p, "l_orderkey", "l_linenumber", ["l_returnflag", "l_partkey"])


@query()
def lineitem_grouping(spark, sf_dir):
    """Entities of an order: names, totals, prices and some quantities at places made from line numbers; no SQL: dynamic programming."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    y = F.col("l_linenumber") * 20.0 + F.col("l_partkey") % 5
    kinds = F.posexplode(F.array(F.lit("LINE_TOTAL"), F.lit("UNIT_PRICE"), F.when(F.col("l_partkey") % 3 > 0, "QUANTITY"), F.lit("ITEM_NAME")))
    e = li.select("l_orderkey", kinds.alias("k", "label"), y.alias("y0"), "l_partkey").where("label is not null")
    boxes = e.select("l_orderkey", (F.col("l_partkey") * 4 + F.col("k")).alias("ref"), "label", F.concat(F.lit("Part "), "l_partkey").alias("text"), (400.0 - F.col("k") * 100).alias("x0"), "y0", (460.0 - F.col("k") * 100).alias("x1"), (F.col("y0") + 12.0).alias("y1"))
    return lineitems.group_line_items(boxes, "l_orderkey", "ref", "label", "text", ("x0", "y0", "x1", "y1"))


@query("""with x as (select l_orderkey as o, l_linenumber as k, cast(min(l_quantity) as bigint) as q, cast(min(l_partkey) % 90 + 1 as bigint) as p from lineitem group by 1, 2)
select o, k, q * p as total, q as quantity, p as price from x""")
def number_roles(spark, sf_dir):
    """Rows of quantity, price and their product, in that order: the product is found to be the total."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k")).agg(F.min("l_quantity").cast("bigint").alias("q"), (F.min("l_partkey") % 90 + 1).cast("bigint").alias("p"))
    n = x.select("o", "k", F.posexplode(F.array("q", "p", F.col("q") * F.col("p"))).alias("x", "v")).withColumn("money", F.col("x") > 0)
    return lineitems.number_roles(n, ["o", "k"], "x", "v", "money", 0.0)


# -- order and windows ----------------------------------------------------------------------------


@query("""select conv_id, string_agg(role || ':' || text, ' ' order by turn, role || ':' || text) filter (text <> '') as joined, count(*) as turns from conversations group by 1""")
def ordered_concat(spark, sf_dir):
    """Turns of a conversation in order."""
    c = table(spark, sf_dir, "conversations").withColumn("line", F.when(F.col("text") != "", F.concat_ws(":", "role", "text")))
    return c.groupBy("conv_id").agg(sequence.ordered_text("line", ["turn"]).alias("joined"), F.count("*").alias("turns"))


@query("""with e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_type from events),
w as (select *, pos // 6 as win, least(pos % 6, 9 - pos % 6) as margin from e union all select *, pos // 6 - 1, least(pos % 6 + 6, 3 - pos % 6) from e where pos % 6 < 4 and pos >= 6),
r as (select *, row_number() over (partition by user_id, pos order by margin desc, win) as r from w) select user_id, pos, cast(win as bigint) as win, cast(margin as bigint) as margin, event_type from r where r = 1""")
def window_merge(spark, sf_dir):
    """A user's events in windows of ten that overlap by four; the window deepest inside wins."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(order) - 1).cast("bigint").alias("pos"))
    at, win = F.col("pos") % 6, F.expr("div(pos, 6)")
    one = F.struct(win.alias("win"), F.least(at, 9 - at).alias("margin"))
    two = F.when((at < 4) & (F.col("pos") >= 6), F.struct((win - 1).alias("win"), F.least(at + 6, 3 - at).alias("margin")))
    w = e.select("user_id", "pos", "event_type", F.explode(F.array(one, two)).alias("w")).where("w is not null").select("user_id", "pos", "event_type", "w.win", "w.margin")
    return sequence.merge_windows(w, ["user_id", "pos"], "margin", "win")


@query("""select conv_id, turn, cast(coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as start from conversations""")
def running_offsets(spark, sf_dir):
    """Where each turn's text begins in its conversation."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sequence.running_offset(F.char_length("text"), ["conv_id"], ["turn"]).cast("bigint").alias("start"))


@query("""with e as (select event_id, user_id, ts from events where event_type = 'error'), p as (select user_id, ts, min(event_id) as event_id from events where event_type = 'purchase' group by 1, 2),
j as (select e.event_id, e.user_id, p.event_id as nearest, abs(epoch_us(p.ts) - epoch_us(e.ts)) as d, p.ts >= e.ts as later from e left join p on e.user_id = p.user_id),
r as (select *, row_number() over (partition by event_id order by d, later desc) as r from j) select event_id, user_id, coalesce(nearest, -1) as nearest, coalesce(d, -1) as distance_us from r where r = 1""")
def nearest_event(spark, sf_dir):
    """For each error the user's nearest purchase in time, the later of two equally near."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return sequence.nearest_later_first(left, right, "user_id", "ts", "event_id").select("event_id", "user_id", F.coalesce("nearest", F.lit(-1)).alias("nearest"), F.coalesce("distance_us", F.lit(-1)).alias("distance_us"))


@query()
def row_banding(spark, sf_dir):
    """Boxes made from line items of an order, banded into rows; no SQL: a running mean decides."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_partkey") % 400).cast("double").alias("x0"), (F.col("l_linenumber") * 14.0 + F.col("l_suppkey") % 9).alias("y0"))
    return sequence.band_rows(li.withColumns({"x1": F.col("x0") + 40.0, "y1": F.col("y0") + 12.0}), "l_orderkey", "x0", "y0", "x1", "y1")


@query()
def union_banding(spark, sf_dir):
    """The same boxes by the other rule, bands that grow to the union; no SQL: a running state decides."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_partkey") % 400).cast("double").alias("x0"), (F.col("l_linenumber") * 14.0 + F.col("l_suppkey") % 9).alias("y0"))
    return sequence.union_bands(li.withColumn("y1", F.col("y0") + 12.0), "l_orderkey", "x0", "y0", "y1")


@query()
def token_windows(spark, sf_dir):
    """Turns are words, their lengths tokens: windows of a budget with overlap; no SQL: sequential."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("bigint").alias("tokens"))
    return sequence.plan_windows(c, "conv_id", "turn", "tokens", 600, 100)


# -- checks, sets and snapshots -------------------------------------------------------------------


@query("""with g as (select distinct l_orderkey from lineitem), x as (select l_orderkey, n from g, range(1, 5) r(n)) select l_orderkey, cast(n as int) as missing from x
where not exists (select 1 from lineitem l where l.l_orderkey = x.l_orderkey and l.l_linenumber = x.n)""")
def completeness_gap(spark, sf_dir):
    """Orders should have lines 1 to 4; which are missing."""
    seen = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"))
    wanted = F.array(*(F.lit(i) for i in range(1, 5)))
    return seen.select("l_orderkey", F.explode(F.array_except(wanted, "have")).alias("missing"))


@query("""select 'order_without_customer' as name, count(*) as violations from orders where o_custkey not in (select c_custkey from customer) union all
select 'line_without_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all
select 'customer_without_nation', count(*) from customer where c_nationkey not in (select n_nationkey from nation) union all
select 'duplicate_order', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1) union all
select 'bad_discount', count(*) from lineitem where not l_discount between 0 and 1""")
def coverage_checks(spark, sf_dir):
    """Keys that point nowhere, keys twice, values out of range: a count of violations each."""
    t = lambda n: table(spark, sf_dir, n)
    o, c, li, n = t("orders"), t("customer"), t("lineitem"), t("nation")
    count = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")
    parts = [
        count("order_without_customer", o.where("o_custkey is not null").join(c, o.o_custkey == c.c_custkey, "left_anti")),
        count("line_without_order", li.where("l_orderkey is not null").join(o, li.l_orderkey == o.o_orderkey, "left_anti")),
        count("customer_without_nation", c.where("c_nationkey is not null").join(n, c.c_nationkey == n.n_nationkey, "left_anti")),
        count("duplicate_order", o.groupBy("o_orderkey").count().where("count > 1")),
        count("bad_discount", li.where("not l_discount between 0 and 1")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey as k from orders), c as (select distinct user_id as k from events)
select a.k is not null as in_customer, b.k is not null as in_orders, c.k is not null as in_events, count(*) as n from a full join b on a.k = b.k full join c on coalesce(a.k, b.k) = c.k group by 1, 2, 3""")
def presence_join(spark, sf_dir):
    """Which of three key sets hold each key."""
    t = lambda n, c, f: table(spark, sf_dir, n).select(F.col(c).alias("k"), *(F.lit(f == x).alias(x) for x in ("in_customer", "in_orders", "in_events")))
    both = t("customer", "c_custkey", "in_customer").unionByName(t("orders", "o_custkey", "in_orders")).unionByName(t("events", "user_id", "in_events"))
    per = both.where("k is not null").groupBy("k").agg(*(F.bool_or(x).alias(x) for x in ("in_customer", "in_orders", "in_events")))
    return per.groupBy("in_customer", "in_orders", "in_events").agg(F.count("*").alias("n"))


@query("""with u as (select c_custkey, c_name, c_nationkey, c_acctbal + 1 as c_acctbal, c_mktsegment from customer where c_custkey % 10 = 3 union all select c_custkey + 1000000000, c_name, c_nationkey, 0, c_mktsegment from customer where c_custkey % 100 = 5)
select * from u union all select * from customer where c_custkey not in (select c_custkey from u)""")
def upsert_snapshot(spark, sf_dir):
    """Customers with some rows replaced and some added."""
    from ..sources.snapshots import upsert

    c = table(spark, sf_dir, "customer")
    u = c.where("c_custkey % 10 = 3").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where("c_custkey % 100 = 5").withColumns({"c_custkey": F.col("c_custkey") + 1000000000, "c_acctbal": F.lit(0.0)}))
    return upsert(c, u, ["c_custkey"])


@query("""with g as (select l_returnflag as k, count(*) as n from lineitem where l_linenumber <= 3 group by 1), p as (select l_returnflag as k, count(*) as n from lineitem where l_linenumber >= 3 group by 1)
select k, least(coalesce(g.n, 0), coalesce(p.n, 0)) as shared from g full join p using (k)""")
def multiset_overlap(spark, sf_dir):
    """Flags of early and of late lines: the smaller count of each."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count_if(F.col("l_linenumber") <= 3).alias("g"), F.count_if(F.col("l_linenumber") >= 3).alias("p"))
    return li.where("g > 0 or p > 0").select("k", F.least("g", "p").alias("shared"))


@query("""select c_mktsegment, count(*) filter (bin = 'low') as low, count(*) filter (bin = 'medium') as medium, count(*) filter (bin = 'high') as high from
(select c_mktsegment, case when c_acctbal / 10000 < 0.5 then 'low' when c_acctbal / 10000 < 0.75 then 'medium' else 'high' end as bin from customer) group by 1""")
def quality_bins(spark, sf_dir):
    """Balances as shares of 10000, binned."""
    b = table(spark, sf_dir, "customer").select("c_mktsegment", splits.quality_bin(F.col("c_acctbal") / 10000).alias("bin"))
    return b.groupBy("c_mktsegment").agg(*(F.count_if(F.col("bin") == k).alias(k) for k in ("low", "medium", "high")))


# -- geometry -------------------------------------------------------------------------------------


@query("""with a as (select event_id, cast(event_id * 7 % 720 as double) - 360 as angle from events)
select case when ((angle % 360) + 360) % 360 = 0 then 'none' when least(((angle % 360) + 360) % 360, 360 - ((angle % 360) + 360) % 360) <= 10 then 'small' else 'large' end as class,
count(*) as n, max(least(((angle % 360) + 360) % 360, 360 - ((angle % 360) + 360) % 360)) as worst from a group by 1""")
def rotation_classes(spark, sf_dir):
    """Angles made from event ids: class and error around the circle."""
    a = table(spark, sf_dir, "events").select((F.col("event_id") * 7 % 720).cast("double").alias("a0")).withColumn("angle", F.col("a0") - 360)
    return a.groupBy(splits.rotation_class(F.col("angle")).alias("class")).agg(F.count("*").alias("n"), F.max(G.circular_error(F.col("angle"), F.lit(0.0))).alias("worst"))


@query("""with b as (select p_partkey as id, cast(p_size as double) as w, cast(p_partkey % 17 + 1 as double) as h from part)
select id, w * h as area, case when least(w, 10.0) - greatest(0, 5.0) > 0 and least(h, 10.0) - 5.0 > 0 then (least(w, 10.0) - 5.0) * (least(h, 10.0) - 5.0) else 0.0 end as shared from b""")
def polygon_areas(spark, sf_dir):
    """Boxes from part sizes as closed polygons: shoelace area, and overlap with a fixed box."""
    w, h, z = F.col("w"), F.col("h"), F.lit(0.0)
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") % 17 + 1).cast("double").alias("h"))
    pts = b.withColumn("flat", F.array(z, z, w, z, w, h, z, h, z, z)).withColumn("pts", G.points(F.col("flat"))).withColumn("box", G.bounding_box(F.col("pts")))
    box = tuple(F.col(f"box.{k}") for k in ("x0", "y0", "x1", "y1"))
    return pts.select("id", G.polygon_area(F.col("pts")).alias("area"), G.overlap_area(box, tuple(F.lit(x) for x in (5.0, 5.0, 10.0, 10.0))).alias("shared"))


@query("""select vec_id, cast(list_sum(list_transform(range(1, 61), lambda i: case when embedding[i] > list_avg(list_transform(embedding[1:60], lambda x: cast(x as double))) then 1::bigint << (60 - i) else 0::bigint end)) as bigint) as bits from embeddings""")
def average_hash(spark, sf_dir):
    """A bit per value of the first 60 of a vector above their mean."""
    v = F.transform(F.slice("embedding", 1, 60), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").withColumn("v", v).select("vec_id", G.average_hash(F.col("v")).alias("bits"))


@query("""select page_id, true as round_trip from pages""")
def affine_round_trip(spark, sf_dir):
    """Maps made from page ids, inverted and composed: points come back to within a millionth."""
    k = F.col("page_id").cast("double")
    m = F.array(1 + k % 7, k % 3, k, k % 5, 20 + k % 11, -k, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    p = table(spark, sf_dir, "pages").select("page_id", m.alias("m")).withColumn("i", G.inverse(F.col("m")))
    q = p.withColumn("q", G.apply(F.col("m"), F.lit(3.0), F.lit(4.0))).withColumn("b", G.apply(F.col("i"), F.col("q.x"), F.col("q.y")))
    return q.select("page_id", ((F.abs(F.col("b.x") - 3) < 1e-6) & (F.abs(F.col("b.y") - 4) < 1e-6)).alias("round_trip"))
