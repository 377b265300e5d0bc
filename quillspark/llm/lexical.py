"""Ranked lexical search over an impact-ordered index, score at a time.

``build_index`` tokenises every document once and keeps, for the terms asked for, postings grouped by
exact impact: a row holds a term, an impact and the documents of a block that have it, largest impacts
first.  An impact is what one occurrence count in one document is worth before the term's weight; it
depends on the document and the corpus alone.

``search`` then reads groups from the largest contribution (weight times impact) downwards.  It first
descends to where each item has ``PROBE`` postings, completes the scores of the best documents so far and
takes the k-th as a bound.  From that bound follows the level below which all that is left of every term
cannot, together, reach the k-th score: the second descent stops there and no earlier, so no document
that it has not met can be among the first k.  Documents met whose sum, with what the terms not met
could still add, reaches the bound are candidates; their scores are completed from the forward rows and
ranked.  Nothing is estimated: the result is that of scoring every document.

Items come in blocks of bounded size; a block's terms and weights are broadcast.  Postings stay in blocks
of documents, so a term that every document holds is many rows and no task's burden, and sums by item and
document are made within a block before they are shuffled.

Edge cases: null and empty texts and items have no terms and no rows; rows that share a document id, or
have none, are documents of their own (ids that are null rank last among equal scores); an item id that
occurs twice is ranked twice; a term in nearly all documents may weigh 0 and then scores nothing; an
empty table gives no rows; other columns are ignored; long texts are read in pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, div, give_back, materialize, table, whole_text

K = 20
#: Postings per item that the first descent reads, and documents per item that it completes.
PROBE, PROBE_DOCUMENTS = 64 * K, 4 * K
BLOCK_BYTES = 1 << 20
BLOCK_POSTINGS = 1 << 20
PIECE_BYTES = 1 << 20
#: Impacts are below 2^20; statistics of postings are kept by their upper bits.
LEVEL = 1 << 14
UNIT = 1_000_000_000
#: Letters and digits of ASCII, lower-cased, and all other bytes beyond ASCII are kept; the rest separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8), in lists of bounded size."""
    start, folded = 0, data.translate(FOLD)
    while len(folded) - start > PIECE_BYTES:
        end = folded.find(b" ", start + PIECE_BYTES)
        if end < 0:
            break
        yield folded[start:end].split()
        start = end
    yield (folded[start:] if start else folded).split()


def impact(tf: Column, m: Column) -> Column:
    return div(F.lit(UNIT) * tf, F.lit(1000) * tf + F.lit(12) * m)


@dataclass
class Index:
    """``rows``: ``row, doc_id, m, terms, tfs`` of each document; ``postings``: ``term, impact, rows``; ``levels``: their numbers."""

    rows: DataFrame
    postings: DataFrame
    levels: DataFrame
    documents: int

    def discard(self) -> None:
        for df in (self.rows, self.postings, self.levels):
            discard(df)


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs``: the number of terms of each document, and its counts of those of ``vocabulary``."""
    size = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            n, found, place = [], [], []
            for k, data in enumerate(b.column("text").to_pylist()):
                total = 0
                for words in term_pieces(data):
                    ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    ids = ids[ids >= 0]
                    total += len(words)
                    found.append(ids)
                    place.append(np.full(len(ids), k * size, np.int64))
                n.append(total)
            keys, tfs = np.unique(np.concatenate(place) + np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
            offsets = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * size), pa.int32())
            terms = pa.ListArray.from_arrays(offsets, pa.array(keys % size, pa.int32()))
            counts = pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), terms, counts], ["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return texts.mapInArrow(give_back(run), "doc_id long, n long, terms array<int>, tfs array<long>")


def group_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``row, m, terms, tfs`` as groups ``term, impact, rows``, by blocks of documents, largest impacts first."""

    def grouped(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        term, worth, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((row, term, -worth))
        term, worth, row = term[order], worth[order], row[order]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (worth[1:] != worth[:-1])]) if len(term) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(term)), pa.int32()), pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(term[first], pa.int32()), pa.array(worth[first], pa.int64()), lists], ["term", "impact", "rows"])

    parts, size = [], 0
    for b in batches:
        lengths = np.asarray(b.column("terms").value_lengths())
        term = np.asarray(b.column("terms").flatten(), dtype=np.int64)
        tf = np.asarray(b.column("tfs").flatten(), dtype=np.int64)
        m = np.repeat(np.asarray(b.column("m"), dtype=np.int64), lengths)
        parts.append((term, UNIT * tf // (1000 * tf + 12 * m), np.repeat(np.asarray(b.column("row"), dtype=np.int64), lengths)))
        size += len(term)
        if size >= BLOCK_POSTINGS:
            yield grouped(parts)
            parts, size = [], 0
    if size:
        yield grouped(parts)


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> Index:
    """The index of ``docs`` (``doc_id``, ``text``) for the terms of ``vocabulary``; every document counts in the statistics."""
    counted = materialize(forward(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "lexical-counts")
    documents, terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = F.lit(25 * documents).cast("decimal(21,0)") * F.col("n").cast("decimal(16,0)")
    m = F.lit(75) + div(share, F.lit(max(1, terms)).cast("decimal(19,0)"))
    rows = counted.where(F.size("terms") > 0).select("row", "doc_id", m.alias("m"), "terms", "tfs")
    rows._scratch = counted._scratch
    postings = materialize(rows.select("row", "m", "terms", "tfs").mapInArrow(group_postings, "term int, impact long, rows array<long>"), "lexical-postings")
    level = div(F.col("impact"), F.lit(LEVEL)).alias("level")
    levels = postings.groupBy("term", level).agg(F.sum(F.size("rows")).alias("n"), F.max("impact").alias("top"))
    return Index(rows, postings, materialize(levels, "lexical-levels"), documents)


def accumulated(index: Index, floors: DataFrame) -> DataFrame:
    """``item, row, part, left``: sums of the contributions at or above the ``floor`` of each item.

    ``floors`` has ``item, term, weight, floor, rest``; ``left`` sums ``rest``, what each term met could have had below the floor.
    """
    worth = F.col("weight") * F.col("impact")
    met = index.postings.join(F.broadcast(floors.withColumnRenamed("term", "t")), (F.col("term") == F.col("t")) & (worth >= F.col("floor")))
    spread = met.select("item", F.explode("rows").alias("row"), worth.alias("worth"), "rest")
    return spread.groupBy("item", "row").agg(F.sum("worth").alias("part"), F.sum("rest").alias("left"))


def completed(index: Index, found: DataFrame, weights: DataFrame) -> DataFrame:
    """``item, row, doc_id, score`` of pairs ``item, row``, from every term that the item and the document share."""
    rows = found.select("item", "row").join(index.rows, "row")
    terms = rows.select("item", "row", "doc_id", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("item", "row", "doc_id", "m", "x.terms", "x.tfs")
    known = F.broadcast(weights.select("item", F.col("term").alias("terms"), "weight"))
    return terms.join(known, ["item", "terms"]).groupBy("item", "row", "doc_id").agg(F.sum(F.col("weight") * impact(F.col("tfs"), F.col("m"))).alias("score"))


def first_of(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(index: Index, terms: DataFrame, k: int = K) -> DataFrame:
    """``item, rank, doc_id, score`` of the k best documents for each item; ``terms`` has ``item, term, repeats``, of bounded size."""
    df = index.levels.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.lit(index.documents) + 2) / (2 * F.col("df") + 1)))
    known = terms.join(df, "term").withColumn("weight", F.col("repeats") * weight).where("weight > 0")
    weights = materialize(known.select("item", "term", "weight", (F.col("weight") * F.col("top")).alias("top")), "lexical-weights")

    # The first descent: to the highest level that leaves each item PROBE postings.
    down = Window.partitionBy("item").orderBy(F.desc("least"))
    steps = weights.join(index.levels.select("term", "level", "n"), "term").withColumn("least", F.col("weight") * F.col("level") * LEVEL)
    probe = steps.withColumn("so_far", F.sum("n").over(down)).groupBy("item").agg(F.coalesce(F.max(F.when(F.col("so_far") >= PROBE, F.col("least"))), F.lit(0)).alias("floor"))
    met = accumulated(index, weights.join(probe, "item").withColumn("rest", F.lit(0).cast("long")))
    best = first_of(met, PROBE_DOCUMENTS, F.desc("part"), F.col("row"))
    bounds = first_of(completed(index, best, weights), k, F.desc("score"), F.col("row")).where(F.col("rank") == k).select("item", F.col("score").alias("bound"))

    # The level at which what is left of all terms together stays below the k-th score.
    up = Window.partitionBy("item").orderBy("top", "term")
    filled = weights.join(bounds, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    filled = filled.withColumn("under", F.sum("top").over(up) - F.col("top")).withColumn("open", F.count("*").over(up.rowsBetween(0, Window.unboundedFollowing)))
    filled = filled.withColumn("level", div(F.greatest(F.col("bound") - 1 - F.col("under"), F.lit(0)), F.col("open")))
    levels = filled.where(F.col("level") < F.col("top")).groupBy("item").agg(F.min_by("level", F.struct("top", "term")).alias("level"), F.first("bound").alias("bound"))
    floors = weights.join(levels, "item").withColumn("floor", F.col("level") + 1).withColumn("rest", F.least("top", "level"))
    floors = materialize(floors, "lexical-floors")

    # The second descent, and what could still reach the bound.
    rest = floors.groupBy("item").agg(F.sum("rest").alias("rest"), F.first("bound").alias("bound"))
    able = accumulated(index, floors).join(F.broadcast(rest), "item").where(F.col("part") + F.col("rest") - F.col("left") >= F.col("bound"))
    scores = completed(index, able, weights).where("score > 0")
    found = materialize(first_of(scores, k, F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row")).select("item", "rank", "doc_id", "score"), "lexical-found")
    for x in (weights, floors):
        discard(x)
    return found


def item_blocks(items: DataFrame, id_col: str, block_bytes: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """Ids and terms of the items, streamed to the driver in blocks of bounded size."""
    part, size = [], 0
    for key, data in items.select(F.col(id_col).cast("long"), whole_text().cast("binary")).toLocalIterator():
        if terms := Counter(x for words in term_pieces(bytes(data)) for x in words):
            part.append((key, terms))
            size += len(data)
        if size >= block_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``<id_col>, rank, doc_id, score``: the k best of ``docs`` for each of ``items`` (``id_col``, ``text``)."""
    spark, out = docs.sparkSession, None
    for block in item_blocks(items, id_col, block_bytes):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in block))))}
        index = build_index(docs, vocabulary)
        rows = [(i, vocabulary[t], n) for i, (_, terms) in enumerate(block) for t, n in terms.items()]
        names, kinds = ["item", "term", "repeats"], [pa.int32(), pa.int32(), pa.int64()]
        terms = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names))
        keys = spark.createDataFrame(pa.table([pa.array(range(len(block)), pa.int32()), pa.array([key for key, _ in block], pa.int64())], ["item", id_col]))
        found = search(index, terms, k).join(F.broadcast(keys), "item").select(id_col, "rank", "doc_id", "score")
        index.discard()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"{id_col} long, rank int, doc_id long, score long")


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
words AS (
  SELECT id, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
sizes AS (SELECT id, doc_id, count(*) AS n FROM words GROUP BY ALL),
facts AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
counts AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT item_id, term, repeats * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY ALL)
  JOIN (SELECT term, count(*) AS df FROM counts GROUP BY ALL) USING (term) CROSS JOIN facts),
scores AS (
  SELECT item_id, doc_id, id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // facts.terms))))::BIGINT AS score
  FROM weights JOIN counts USING (term) JOIN sizes USING (id) CROSS JOIN facts GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
