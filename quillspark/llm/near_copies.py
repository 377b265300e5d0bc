"""One document of each near-duplicate group: SimHash links, and MinHash candidates with the exact Jaccard index.

Texts with equal sets of five-word shingles (lower case) are one node.  Nodes whose SimHash fingerprints
of five-word shingles lie within 3 bits are linked by the covering-code anchors of ``simhash``.  Three
bits reach only copies that are almost equal (at a Jaccard index of 0.8 about 10 of 64 bits differ, for
which no covering code is small enough), so links by ``BANDS`` MinHash bands of ``ROWS`` rows come to
them: at 0.8 two sets share a band in 99.94 % of cases.  Bands with the same members are compared once,
by the exact Jaccard index, in blocks of bounded size of which only links that join sets not yet joined
come out.  Components of both kinds of links are the groups.

Edge cases: a null text is an empty one; fewer than five words are one shingle, which equals another
or has nothing in common with it; texts without words are copies of each other; of equal smallest ids
the row stored first stays; a null ``doc_id`` stays only where its group has no other; an empty table
gives no rows; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import discard, give_back, join_hot, materialize, whole_text
from .paragraphs import JACCARD, SHINGLE, WordHashes, _verify, grams, mixed_up
from .simhash import fingerprint, fingerprint_classes
from .substrings import _bitmap, _inside, _signed

BANDS, ROWS = 14, 4
BLOCK = 512
_FACTORS = mixed_up(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 11) | np.uint64(1)


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def sketch(text: str, known: WordHashes) -> tuple[int, np.ndarray]:
    """The digest of a text's shingle set and its band keys (none below five words)."""
    ids = np.array([known[x] for x in text.lower().split()], dtype=np.uint64)
    short = len(ids) < SHINGLE
    found = np.unique(grams(ids, len(ids) if short else SHINGLE)) if len(ids) else ids
    digest = np.full(1, len(ids) if short else SHINGLE, np.uint64)
    digest = mixed_up(digest ^ np.bitwise_xor.reduce(mixed_up(found, 3)), len(found) & 0xFFFF)
    if short:
        return int(digest[0]), np.zeros(0, np.uint64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(found), 4096):
        np.minimum(least, (found[None, s : s + 4096] * _FACTORS[:, None]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed_up(key ^ least[k::ROWS], 7)
    return int(digest[0]), key


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()  # ends with the task: the stages after this one need the memory
    for b in batches:
        digests, keys, prints = [], [], []
        for t in b.column("text").to_pylist():
            d, k = sketch(t, known)
            digests.append(d)
            keys.append(k.view(np.int64))
            prints.append(fingerprint(t, SHINGLE))
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), _signed(np.array(digests, np.uint64)), pa.array(keys, pa.list_(pa.int64())), _signed(np.array(prints, np.uint64))], ["rid", "doc_id", "digest", "keys", "fp"])


def near_print_links(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of the ``digest`` of ``nodes`` that join those whose fingerprints ``fp`` have one SimHash class."""
    classes = fingerprint_classes(nodes.select("fp", "digest"), "digest")
    return join_hot(nodes.select("digest", "fp"), classes, "fp", "n").select(F.col("digest").alias("a"), F.col("component").alias("b")).where("a != b")


def near_copy_links(texts: DataFrame, nodes: DataFrame, threshold: float = JACCARD, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` of ``digest`` whose components are those of all found pairs; ``nodes`` has ``digest, rid, keys``, ``texts`` ``rid, text``."""
    spark = nodes.sparkSession
    bands = nodes.select("digest", "rid", F.explode("keys").alias("key"))
    groups = bands.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("members")).where("n > 1")
    chosen = groups.groupBy("n", "members").agg(F.min("key").alias("key")).drop("members")
    crowded = materialize(bands.join(chosen, "key"), "crowded")
    wanted = spark.sparkContext.broadcast(_bitmap(crowded.select(F.xxhash64("rid").alias("key")).distinct()))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(_inside(wanted.value, np.asarray(b.column("key")).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([plain(t) for t in b.column("text").to_pylist()], pa.string())], ["rid", "text"])

    found = texts.select("rid", F.xxhash64("rid").alias("key"), "text").mapInArrow(held, "rid long, text string")
    split = crowded.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = split.join(found, "rid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "digest", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(_verify(threshold), "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest ``doc_id`` (of equal ones, the first stored)."""
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), docs["doc_id"].cast("long").alias("doc_id"))
    numbered = materialize(row.withColumn("rid", F.monotonically_increasing_id()), "rows")
    texts = numbered.select("rid", "doc_id", whole_text("__row.text").alias("text"))
    sketches = materialize(texts.mapInArrow(give_back(_sketches), "rid long, doc_id long, digest long, keys array<long>, fp long"), "sketches")
    # Ranks stand for ids: the first row of each shingle set, then of each component, by (doc_id, rid).
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
    first = materialize(sketches.groupBy("digest").agg(least, F.first("keys").alias("keys"), F.min("fp").alias("fp")), "firsts")
    discard(sketches)
    nodes = first.select("digest", "least.rid", "keys", "fp")
    roots = connected_components(near_copy_links(texts, nodes).unionByName(near_print_links(nodes))).withColumnRenamed("node", "digest")
    kept = first.join(roots, "digest", "left").groupBy(F.coalesce("root", "digest").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.rid").alias("rid"))
    return numbered.join(kept, "rid", "left_semi").select("__row.*")
