"""Source divergence audit: how the words of each source differ from other sources and from their language.

A chain of ordinary relations: the regexp matches of every text (what lies
between the runs of other characters) are exploded and counted by language,
source and term; groups are crossed with the kept vocabulary of their language, so that terms a group
lacks count zero; smoothed shares are compared by a self-join on language and term, summed, and ranked by
windows.  Shares are whole numbers of a thousand millionth; decimals hold what 64 bits cannot.

Where rows meet by language alone (a few keys hold everything) the key is salted: terms are spread over
``SALTS`` values, and groups, of which there are few, are repeated once for each.

Edge cases: null text, lang or source are empty strings; a text without terms still makes its group occur; a
language with no kept term compares its sources with value 0 and has no term rows; repeated rows count
again; ties are ranked by the bytes of the item; an empty table gives no rows; other columns are ignored.
A text is matched whole in one row, so a very long one takes memory in proportion to its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, div, materialize, table, whole_text

#: Terms are the maximal matches of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: what lies between the runs of all other characters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, UNIT, TOP, SALTS = 3, 1_000_000_000, 200, 32


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNIT * (n + 1) / (total + kept))``, exact whatever the counts."""
    return div(F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), (total + kept).cast("decimal(19,0)")) + 1


def relative_square(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; shares are at most ``UNIT`` + 1, so 64 bits hold the square."""
    return div((p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: occurrences, and documents that hold the term.

    A text's terms are exploded with its distinct terms behind them, so one pass counts both.
    """
    found = docs.select("lang", "source", F.split(ascii_lower(F.col("text")), BETWEEN).alias("terms"))
    rows = found.select("lang", "source", F.size("terms").alias("size"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    once = F.col("at") >= F.col("size")
    return rows.where("term <> ''").groupBy("lang", "source", "term").agg(F.count_if(~once).alias("n"), F.count_if(once).alias("df"))


def by_language(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Every term of a language with every group of it."""
    salted = terms.withColumn("salt", F.pmod(F.xxhash64("tid"), F.lit(SALTS)).cast("int"))
    repeated = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, ["lang", "salt"]).drop("salt")


def densified(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups ``gid, lang, source``, kept terms ``tid, lang, term``, and ``gid, tid, n, p, q`` of every group with every term of its language.

    ``p`` is the group's share, ``q`` its language's.  Terms and groups meet by number: rows of the large tables are a few
    integers, not texts.
    """
    numbered = lambda df, name: df.withColumn(name, F.monotonically_increasing_id())
    counts = materialize(term_counts(docs), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least_documents)
    kept = materialize(numbered(kept.select("lang", "term", "lang_n"), "tid"), "divergence-kept")
    sources = materialize(numbered(docs.select("lang", "source").distinct(), "gid"), "divergence-groups")
    found = counts.join(kept.select("lang", "term", "tid"), ["lang", "term"]).join(sources, ["lang", "source"])
    found = materialize(found.select("gid", "tid", "n"), "divergence-found")
    discard(counts)
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("gid").agg(F.sum("n").alias("total"))
    groups = sources.join(totals, "gid", "left").join(langs, "lang")
    crossed = by_language(kept.select("lang", "tid", "lang_n"), groups).join(found, ["gid", "tid"], "left")
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))
    shares = crossed.select("gid", "tid", n.alias("n"), share(n, total, F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    return sources, kept, materialize(shares, "divergence-shares")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and the terms used more than in the language.

    ``docs`` has ``text``, ``lang`` and ``source``; nulls are empty strings.
    """
    docs = docs.select(whole_text().alias("text"), whole_text("lang").alias("lang"), whole_text("source").alias("source"))
    groups, kept, shares = densified(docs, least_documents)
    # A term's number stands for its language and its text.  Each couple of sources meets once for both directions.
    own, other = shares.select("tid", "gid", "p"), shares.select("tid", F.col("gid").alias("other"), F.col("p").alias("q"))
    met = own.join(other, "tid").where("gid < other")
    p, q = F.col("p"), F.col("q")
    both = met.groupBy("gid", "other").agg(F.sum(relative_square(p, q)).alias("there"), F.sum(relative_square(q, p)).alias("back"))
    turned = F.inline(F.array(
        F.struct("gid", "other", F.col("there").alias("value")),
        F.struct(F.col("other").alias("gid"), F.col("gid").alias("other"), F.col("back").alias("value")),
    ))
    couples = groups.join(groups.select("lang", F.col("gid").alias("other"), F.col("source").alias("item")), "lang").where("gid <> other")
    pairs = couples.join(both.select(turned), ["gid", "other"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    more = shares.where((F.col("n") > 0) & (p > q)).select("gid", "tid", relative_square(p, q).alias("value"))
    terms = more.join(kept.select("tid", F.col("term").alias("item")), "tid").join(groups, "gid")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources compared in pairs, and each source's leading terms, in every language of all documents."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT id, lang, source, unnest(terms) AS term FROM texts),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM kept GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM texts),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + kept) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + kept) AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 200
"""
