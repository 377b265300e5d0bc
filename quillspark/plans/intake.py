"""Queries over sources, sinks, snapshots and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import records, snapshots
from ..storage import scratch
from ..streaming import requests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("select p_partkey, p_name, nullif(p_brand, 'Brand#1') as p_brand from part")
def json_lines_round_trip(spark, sf_dir):
    """Parts written as canonical JSON lines and read back strictly."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.nullif("p_brand", F.lit("Brand#1")).alias("p_brand"))
    path = scratch(spark, "parts-json")
    records.write_json_lines(p, path, ["p_partkey"])
    return records.read_json_lines(spark, path, p.schema)


@query("""select case when p_partkey % 5 = 0 then 'INVALID_JSON' when p_partkey % 5 = 1 then 'INVALID_JSON_ROOT' else 'accepted' end as reason, count(*) as n from part group by 1""")
def json_lines_tagged(spark, sf_dir):
    """Lines cut short or with another root go to quarantine with a reason."""
    k = F.col("p_partkey") % 5
    p = table(spark, sf_dir, "part")
    line = F.when(k == 0, '{"a": ').when(k == 1, "[1, 2]").otherwise(F.to_json(F.struct("p_partkey", "p_name")))
    path = scratch(spark, "lines")
    p.select(line.alias("value")).write.text(path)
    good, bad = records.read_json_lines_tagged(spark, path, "p_partkey bigint, p_name string")
    return good.select(F.lit("accepted").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""select cast(p_partkey as varchar) as p_partkey, p_name || ', "x"' || chr(10) || p_type as cell from part""")
def csv_round_trip(spark, sf_dir):
    """Cells with commas, quotes and line ends, through CSV."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), F.concat("p_name", F.lit(', "x"\n'), "p_type").alias("cell"))
    path = scratch(spark, "parts-csv")
    records.write_csv(p, path)
    return records.read_csv(spark, path, ["p_partkey", "cell"])


@query("""with r as (select case when not coalesce(n_chars >= 50, false) then 'too_short' end as a, case when not coalesce(lang in ('en','fr','de','es') , false) then 'language' end as b,
case when not coalesce(doc_id % 10 <> 3, false) then 'withdrawn' end as c from documents)
select coalesce(a || case when b is not null or c is not null then ',' else '' end, '') || coalesce(b || case when c is not null then ',' else '' end, '') || coalesce(c, '') as reasons, count(*) as n from r group by 1""")
def quarantine_reasons(spark, sf_dir):
    """Documents checked against three rules; all failing rules are listed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    good, bad = records.quarantine(d, {"too_short": F.col("n_chars") >= 50, "language": F.col("lang").isin("en", "fr", "de", "es"), "withdrawn": F.col("doc_id") % 10 != 3})
    every = good.withColumn("reasons", F.array().cast("array<string>")).unionByName(bad)
    return every.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("""select p_partkey, case when p_partkey % 6 = 0 then 'BAD_BOX_LINE' end as error, case when p_partkey % 6 <> 0 then p_name || ',' || p_type end as text, case when p_partkey % 6 <> 0 then cast(p_size as double) end as x1 from part""")
def box_lines(spark, sf_dir):
    """Eight numbers and a text with commas; some lines lack a number."""
    n = F.col("p_size").cast("string")
    line = F.when(F.col("p_partkey") % 6 == 0, F.concat_ws(",", n, n, "p_name")).otherwise(F.concat_ws(",", *[n] * 8, "p_name", "p_type"))
    p = table(spark, sf_dir, "part").select("p_partkey", records.parse_box_line(line).alias("r"))
    return p.select("p_partkey", "r.error", "r.text", F.col("r.numbers")[0].alias("x1"))


@query("""select user_id, max_by(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by 1""")
def last_per_key(spark, sf_dir):
    """Events are an append-only log: the last of each user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return snapshots.last_per_key(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("""select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def still_to_do(spark, sf_dir):
    """Customers without an urgent order yet."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return snapshots.still_to_do(table(spark, sf_dir, "customer").select("c_custkey"), urgent.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""select p_brand, p_partkey % 4 = 0 as hit, count(*) as n, cast(sum(length(p_name)) as bigint) as total from part group by 1, 2""")
def through_cache(spark, sf_dir):
    """Name lengths, a quarter of them from a cache addressed by content."""
    p = table(spark, sf_dir, "part").withColumn("key", snapshots.cache_key(F.lit("v1").alias("version"), F.col("p_partkey"), F.col("p_name")))
    size = F.char_length("p_name").cast("bigint").alias("value")
    cache = p.where("p_partkey % 4 = 0").select("key", size)
    out = snapshots.through_cache(p.select("key", "p_brand", "p_name"), cache, "key", "value", lambda df: df.select("*", size))
    return out.groupBy("p_brand", "hit").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""select case page_id % 5 when 0 then 'jpeg' when 1 then 'png' when 2 then 'webp' when 3 then 'pdf' end as kind, count(*) as n from pages group by 1""")
def image_kinds(spark, sf_dir):
    """File heads made from page ids, told apart by their first bytes."""
    k = F.col("page_id") % 5
    head = F.when(k == 0, F.unhex(F.lit("FFD8FFE0"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(k == 2, F.unhex(F.lit("524946460000000057454250"))).when(k == 3, F.unhex(F.hex(F.lit(" %PDF-1.7")))).otherwise(F.unhex(F.lit("00")))
    return table(spark, sf_dir, "pages").select(X.image_kind(head).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""with r as (select event_id, case when event_id % 9 = 0 then 'INVALID_JSON' when event_id % 9 = 1 then 'MISSING_ID' when event_id % 9 = 2 then 'MISSING_URL' end as error from events)
select coalesce(error, case when event_id % 9 = 3 then 'TRANSIENT_DOWNLOAD' when event_id % 9 = 4 then 'UNSUPPORTED' else 'ok' end) as outcome,
coalesce(error is null and event_id % 9 = 3, false) as retryable, count(*) as n from r group by 1, 2""")
def stream_requests(spark, sf_dir):
    """Events replayed as request files: results, error results and dead letters."""
    k, i = F.col("event_id") % 9, F.col("event_id").cast("string")
    body = lambda a, b: F.to_json(F.struct(a.alias("id"), b.alias("url")))
    line = F.when(k == 0, '{"id": ').when(k == 1, body(F.lit(""), F.lit("u"))).when(k == 2, body(i, F.lit(None).cast("string"))).otherwise(body(i, F.concat(F.lit("https://example.org/"), k.cast("string"))))
    src, out = scratch(spark, "requests"), scratch(spark, "answers")
    table(spark, sf_dir, "events").select(line.alias("value")).repartition(3).write.text(src)

    def process(df: DataFrame) -> DataFrame:
        return df.withColumns({"body": F.col("url"), "failure": F.when(F.col("url").endswith("/3"), "TRANSIENT_DOWNLOAD").when(F.col("url").endswith("/4"), "UNSUPPORTED")})

    results, dead = requests.run_requests(spark, src, out, scratch(spark, "stream"), process, 2)
    every = results.select(F.when(F.col("status") == "ok", "ok").otherwise(F.col("code")).alias("outcome"), "retryable").unionByName(dead.select(F.col("error").alias("outcome"), F.lit(False).alias("retryable")))
    return every.groupBy("outcome", "retryable").agg(F.count("*").alias("n"))


@query("""with c as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as b from conversations)
select conv_id, count(*) as turns, count(*) filter (b = role) as repeats, count(distinct turn) = count(*) as unique_turns from c group by 1""")
def conversation_contract(spark, sf_dir):
    """Conversations as documents with invariants: turns unique, roles that repeat counted."""
    c = table(spark, sf_dir, "conversations").withColumn("b", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("b") == F.col("role")).alias("repeats"), (F.count_distinct("turn") == F.count("*")).alias("unique_turns"))
