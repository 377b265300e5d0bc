"""Repeated paragraphs and passages by MinHash banding.

Units are lines of a shingle (``SHINGLE`` words) or more, and passages of ``PASSAGE_WORDS`` words that
begin at anchors chosen by content (the smallest hash of three words among ``ANCHOR_WINDOW``), so any
common stretch of ``ANCHOR_WINDOW + PASSAGE_WORDS - 1`` words (38) holds a common passage wherever its
lines break, and of a longer one all but less than ``ANCHOR_WINDOW`` words at either end is marked.  The texts are cut into units once; a table of them without their words is all the rest
works on.

A line's five-word shingles give MinHash bands, ``BANDS`` of ``ROWS`` (at a Jaccard index of 0.8 two
lines share one in 99.4 % of cases).  Lines of up to three shingles reach 0.8 only if their sets are
equal, so one band finds them all.  Passages are compared whole: a changed word in the middle of one
takes it below 0.8.

Units with equal words (64-bit digest) are one node.  The distinct lines of a band are compared by
exact Jaccard index, in blocks of bounded size; of bands with the same members one is, and of the links
found only those that join sets not yet joined are kept.  Components of the linked units are the
classes; of a class, the unit that comes first by ``(doc_id, start_word)`` stays and the others are
marked for removal, also where they repeat inside one document.

Filters travel as bitmaps of fixed size; once full they let everything pass, which costs time but never
a result.

Edge cases: words are what white space separates, in lower case; a null or empty text has no units;
equal rows of one ``doc_id`` are one document; rows with a null ``doc_id`` are left out, for a removal
has to name its document; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as xxh64

from ..operators.graph import connected_components
from .common import discard, give_back, join_hot, materialize, table, whole_text
from .substrings import _bitmap, _inside, _signed, window_min

SHINGLE, JACCARD, BANDS, ROWS = 5, 0.8, 5, 2
PASSAGE_WORDS, ANCHOR_WORDS, ANCHOR_WINDOW = 26, 3, 13
BLOCK = 1024
#: Texts are cut into units in chunks of about so many bytes.
CHUNK_BYTES = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0xD1342543DE82EF95


def mixed_up(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A permutation of 64-bit values, one for each seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x165667B19E3779F9) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ ids[k : len(h) + k]) * _A
        h ^= h >> np.uint64(29)
    return h


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        out = xxh64(word.encode("utf-8", "surrogatepass"), 5)
        if len(self) < 500_000:
            self[word] = out
        return out


_FACTORS = mixed_up(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 13) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def up(b: int) -> np.ndarray:
        out = np.full((1 << bits) + 1, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


class Words:
    """The words of some texts in order: ``ids`` (a hash each), and of every line its text, first word and size."""

    def __init__(self, texts: pa.Array):
        lines = pc.split_pattern(pc.utf8_lower(texts), "\n")
        self.line_text = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lines)))
        parts = pc.utf8_split_whitespace(lines.flatten())
        line = np.repeat(np.arange(len(parts)), np.asarray(pc.list_value_length(parts)))
        flat = parts.flatten()
        real = np.asarray(pc.binary_length(flat)) > 0
        self.tokens = flat.filter(pa.array(real))
        self.size = np.bincount(line[real], minlength=len(parts))
        self.begin = np.cumsum(self.size) - self.size
        of_text = np.bincount(self.line_text, weights=self.size, minlength=len(texts)).astype(np.int64)
        self.text_end = np.cumsum(of_text)
        self.text_begin = self.text_end - of_text
        coded = self.tokens.dictionary_encode()
        known = np.array([xxh64(w, 5) for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.uint64)
        self.ids = known[np.asarray(coded.indices)] if len(coded) else known
        powers, self.inverse = _powers(max(20, len(self.ids).bit_length()))
        self.sums = np.zeros(len(self.ids) + 1, np.uint64)
        np.cumsum(self.ids * powers[: len(self.ids)], out=self.sums[1:])

    def digest(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of the ``n`` words from ``s`` on, in order."""
        return mixed_up((self.sums[s + n] - self.sums[s]) * self.inverse[s] ^ n.astype(np.uint64), 3)

    def lines(self) -> tuple[np.ndarray, ...]:
        """Text, first word, words and digest of every line that is a unit."""
        own = np.flatnonzero(self.size >= SHINGLE)
        s, n = self.begin[own], self.size[own]
        return self.line_text[own], s, n, self.digest(s, n)

    def band_keys(self, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the lines one after another, and how many each has: one up to three shingles, else all bands."""
        if not len(s):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        tail = np.concatenate([grams(self.ids, SHINGLE), np.full(SHINGLE, np.iinfo(np.uint64).max, np.uint64)])
        cuts = np.stack([s, s + n - SHINGLE + 1], 1).ravel()
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(s), 1))
        for j, factor in enumerate(_FACTORS):
            key[:, j // ROWS] = mixed_up(key[:, j // ROWS] ^ np.minimum.reduceat(tail * factor, cuts)[::2], 7)
        many = np.where(n - SHINGLE + 1 <= 3, 1, BANDS)
        return key[np.arange(BANDS)[None, :] < many[:, None]], many

    def passages(self) -> tuple[np.ndarray, ...]:
        """Text, first word, words and digest of every passage."""
        w, none = ANCHOR_WINDOW, np.zeros(0, np.int64)
        h = mixed_up(grams(self.ids, ANCHOR_WORDS), 99)
        if len(h) < max(w, PASSAGE_WORDS):
            return none, none, none, none.astype(np.uint64)
        mask = np.uint64((1 << 22) - 1)  # places within a chunk; equal up to them, the last of a window counts
        v = (h & ~mask) | (mask - (np.arange(len(h), dtype=np.uint64) & mask))
        least = window_min(v, w)
        text = np.repeat(np.arange(len(self.text_end)), self.text_end - self.text_begin)[: len(h)]
        first = np.arange(len(least))
        inside = first + w + ANCHOR_WORDS - 1 <= self.text_end[text[: len(least)]]
        back = (mask - (least & mask)).astype(np.int64)
        at = np.unique((first + ((back - first) & int(mask)))[inside])
        at = at[at + PASSAGE_WORDS <= self.text_end[text[at]]]
        n = np.full(len(at), PASSAGE_WORDS)
        return text[at], at, n, self.digest(at, n)


def chunks(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """The words of a batch's texts, some texts at a time, with the number of the first."""
    size = np.cumsum(np.asarray(pc.binary_length(texts)))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES)))
        yield at, Words(texts.slice(at, to - at))
        at = to


UNIT = "doc_id long, start_word int, n_words int, digest long, keys array<long>"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc = np.asarray(b.column("doc_id"))
        for at, words in chunks(b.column("text")):
            lines, passages = words.lines(), words.passages()
            key, many = words.band_keys(lines[1], lines[2])
            text, s, n, digest = (np.concatenate(x) for x in zip(lines, passages, strict=True))
            offsets = np.concatenate([[0], np.cumsum(many), np.full(len(passages[0]), len(key))]).astype(np.int32)
            cols = [pa.array(doc[at + text]), pa.array((s - words.text_begin[text]).astype(np.int32)), pa.array(n.astype(np.int32)), _signed(digest), pa.ListArray.from_arrays(pa.array(offsets), _signed(key))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start_word", "n_words", "digest", "keys"])


def _only(column: str, names: list[str], bitmap):
    """Rows whose ``column`` is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = _inside(bitmap.value, np.asarray(b.column(column)).view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names], names).filter(pa.array(keep))

    return run


def _pairs(bitmap):
    """``(key, digest)`` for the keys in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("keys")
            key = np.asarray(lists.flatten()).view(np.uint64)
            keep = _inside(bitmap.value, key)
            digest = np.repeat(np.asarray(b.column("digest")), np.asarray(pc.list_value_length(lists)))
            yield pa.RecordBatch.from_arrays([_signed(key[keep]), pa.array(digest[keep])], ["key", "digest"])

    return run


def _line_texts(holders, wanted):
    """``(digest, text)`` of the wanted lines in the texts of documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # what this task has sent
        for b in batches:
            b = b.filter(pa.array(_inside(holders.value, np.asarray(b.column("holder")).view(np.uint64))))
            for _, words in chunks(b.column("text")):
                _, s, n, digest = words.lines()
                out = {}
                for k in np.flatnonzero(_inside(wanted.value, digest)).tolist():
                    if (d := int(digest[k])) not in told and d not in out:
                        out[d] = " ".join(words.tokens.slice(int(s[k]), int(n[k])).to_pylist())
                if len(told) < 1_000_000:
                    told.update(out)
                yield pa.RecordBatch.from_arrays([_signed(np.array(list(out), np.uint64)), pa.array(list(out.values()), pa.string())], ["digest", "text"])

    return run


def shingle_set(text: str, known: dict[str, int]) -> np.ndarray:
    """A unit's shingles as numbers, equal only for equal shingles."""
    w = text.split(" ")
    return np.unique(np.array([known.setdefault(" ".join(w[i : i + SHINGLE]), len(known)) for i in range(len(w) - SHINGLE + 1)], np.int64))


def few_links(texts: list[str], ids: list[int], left: list[int], right: list[int], threshold: float) -> list[tuple[int, int]]:
    """As :func:`near_links`, for a handful of texts, where plain sets are quicker than arrays."""
    sets = []
    for t in texts:
        w = t.split(" ")
        sets.append({" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})
    root, out = list(range(len(ids))), []
    for i in left:
        for j in right:
            if root[i] != root[j]:
                common = len(sets[i] & sets[j])
                if common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                    a, b = root[i], root[j]
                    root = [a if r == b else r for r in root]
                    out.append((ids[i], ids[j]))
    return out


def near_links(sets: list[np.ndarray], ids: list[int], left: list[int], right: list[int], threshold: float) -> list[tuple[int, int]]:
    """A forest of the links between ``left`` and ``right`` whose exact Jaccard index reaches ``threshold``."""
    parent = {i: i for i in ids}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    flat, sizes = np.concatenate([sets[j] for j in right]), np.array([len(sets[j]) for j in right])
    owner, out = np.repeat(np.arange(len(right)), sizes), []
    for i in left:
        open_ = [k for k, j in enumerate(right) if find(ids[j]) != find(ids[i])]
        if not open_:
            continue
        common = np.bincount(owner[np.isin(flat, sets[i])], minlength=len(right))
        for k in open_:
            j = right[k]
            if common[k] >= threshold * (len(sets[i]) + sizes[k] - common[k]) - 1e-9:
                p, q = find(ids[i]), find(ids[j])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((ids[i], ids[j]))
    return out


def _verify(threshold: float):
    """From rows sorted by block, the links inside each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []

        def settle(rows: list[tuple]) -> None:
            if len(rows) > 1:
                ids = [r[4] for r in rows]
                left = [k for k, r in enumerate(rows) if r[3] == r[1]]
                right = [k for k, r in enumerate(rows) if r[3] == r[2]]
                if len(rows) <= 12:
                    out.extend(few_links([r[5] for r in rows], ids, left, right, threshold))
                else:
                    known: dict[str, int] = {}
                    out.extend(near_links([shingle_set(r[5], known) for r in rows], ids, left, right, threshold))

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "b1", "b2", "own", "digest", "text")), strict=True):
                if rows and rows[-1][:3] != row[:3]:
                    settle(rows)
                    rows = []
                rows.append(row)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
                out.clear()
        if rows:
            settle(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def line_links(rows: DataFrame, units: DataFrame, threshold: float = JACCARD, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` of line digests whose components are those of all pairs that share a band and reach ``threshold``."""
    spark = rows.sparkSession
    lines = units.where("size(keys) > 0")
    mixed = lines.select("digest", F.explode("keys").alias("key")).groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi")
    found = lines.select("keys", "digest").mapInArrow(give_back(_pairs(spark.sparkContext.broadcast(_bitmap(mixed)))), "key long, digest long")
    pairs = materialize(found.distinct(), "bands")
    groups = pairs.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.bit_xor(F.xxhash64("digest")).alias("members")).where("n > 1")
    chosen = groups.groupBy("n", "lo", "hi", "members").agg(F.min("key").alias("key")).select("key", "n")
    crowded = materialize(pairs.join(chosen, "key"), "crowded")
    # The words come from the document with the smallest id that holds a line.
    wanted = spark.sparkContext.broadcast(_bitmap(crowded.select(F.col("digest").alias("key"))))
    holders = lines.select("digest", "doc_id").mapInArrow(give_back(_only("digest", ["digest", "doc_id"], wanted)), "digest long, doc_id long").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    held = spark.sparkContext.broadcast(_bitmap(holders.select(F.xxhash64("doc_id").alias("key"))))
    told = rows.select(F.xxhash64("doc_id").alias("holder"), "text").mapInArrow(give_back(_line_texts(held, wanted)), "digest long, text string")
    texts = told.groupBy("digest").agg(F.max("text").alias("text"))
    split = crowded.join(texts, "digest").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = split.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "digest", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = materialize(dealt.repartition(tasks, "key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(give_back(_verify(threshold)), "a long, b long"), "links")
    discard(pairs)
    discard(crowded)
    return links


def repeated_units(docs: DataFrame, threshold: float = JACCARD, block: int = BLOCK) -> DataFrame:
    """``doc_id, start_word, n_words, component_id, keep_doc_id, removed`` of every unit in a class of two or more."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    units = materialize(rows.mapInArrow(give_back(_units), UNIT), "units")
    repeated = materialize(units.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "repeated")
    links = line_links(rows, units, threshold, block)
    roots = connected_components(links).withColumnRenamed("node", "digest")
    classes = materialize(repeated.join(roots, "digest", "full").select("digest", F.coalesce("root", "digest").alias("component_id")), "classes")
    inside = spark.sparkContext.broadcast(_bitmap(classes.select(F.col("digest").alias("key"))))
    names = ["doc_id", "start_word", "n_words", "digest"]
    held = units.select(*names).mapInArrow(give_back(_only("digest", names, inside)), "doc_id long, start_word int, n_words int, digest long")
    placed = materialize(held.join(classes, "digest").select("doc_id", "start_word", "n_words", "component_id").distinct(), "placed")
    for done in (units, repeated, links, classes):
        discard(done)
    kept = materialize(placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "start_word")).alias("keep"), F.count("*").alias("n")).where("n > 1"), "kept")
    out = join_hot(placed, kept, "component_id", "n")
    return out.select("doc_id", F.col("start_word").cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), "component_id", F.col("keep.doc_id").alias("keep_doc_id"), (F.struct("doc_id", "start_word") != F.col("keep")).alias("removed"))


def stretches(units: DataFrame) -> DataFrame:
    """Units put together: per document, kept document and decision the maximal stretches of words they cover."""
    lists = units.groupBy("doc_id", "keep_doc_id", "removed").agg(F.count("*").alias("n_units"), F.array_sort(F.collect_set(F.struct(F.col("start_word").alias("s"), (F.col("start_word") + F.col("n_words")).alias("e")))).alias("all"))
    merged = F.expr("""aggregate(all, cast(array() as array<struct<s:bigint,e:bigint>>), (acc, x) ->
        case when size(acc) > 0 and element_at(acc, -1).e >= x.s
        then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).s as s, greatest(element_at(acc, -1).e, x.e) as e)))
        else concat(acc, array(x)) end)""")
    return lists.withColumn("stretches", merged).drop("all")


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``documents`` repeats: per document and kept document the stretches, kept or removed."""
    found = stretches(repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text")))
    words = F.aggregate("stretches", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    spans = F.array_join(F.transform("stretches", lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    return found.select("doc_id", "keep_doc_id", "removed", "n_units", words.alias("n_words"), spans.alias("word_spans"))
