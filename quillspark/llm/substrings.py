"""Exact removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Suffixes are
only sorted where that can be: every string of that length has one anchor, the smallest (rightmost of
equal) hash among its ``GRAM``-byte grams, which depends on the string alone, so equal strings have
equal anchors at equal places.  The starts that share an anchor form a run, and the run's bytes are
its span.

1.  Anchors and a hash of their spans are counted: an anchor seen once is unique; an anchor whose
    spans are all equal repeats throughout.
2.  The distinct spans of the other anchors are put together, in chunks of bounded size, and their
    suffixes are sorted in two stages: those smaller than their successor are sorted directly, the
    rest are induced by a scan over the buckets.  Adjacent common prefixes of ``LENGTH`` bytes mark
    repeated starts.  Anchors with more than ``HOT`` distinct spans are settled by counting the
    hashes (128 bits) of their strings instead, aggregated before the shuffle.
3.  The marked runs go back to the texts.

Filters on anchors travel as bitmaps of fixed size; once full they let everything pass, which costs
time but never a result.

Edge cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows with equal texts
lose everything if long enough; a null ``doc_id`` is kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, whole_text

LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1
#: Texts are hashed in chunks that fit a core's cache; a task holds about a dozen numbers per byte of one chunk.
CHUNK, HOT, SORT_BYTES = 1 << 17, 4096, 1 << 18
PLACE_BITS = 18
FILTER_BITS = 26
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, and powers of an odd base and of its inverse modulo 2^64."""
    n = 1 << PLACE_BITS
    inverse = pow(_BASE, -1, 1 << 64)

    def up(b: int) -> np.ndarray:
        out = np.ones(n + 1, np.uint64)
        out[1:] = np.uint64(b)
        return np.multiply.accumulate(out)

    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64), up(_BASE), up(inverse)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at every place of ``data``."""
    values, powers, inverses = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverses[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` consecutive values."""
    n = len(v)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([v, pad]).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def runs(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: ``(key, anchor, first start, last start, text number)``.

    ``ends`` are where the texts joined in ``data`` end; no string crosses them.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none, none
    h = gram_hashes(np.frombuffer(data, np.uint8))
    mask = np.uint64((1 << PLACE_BITS) - 1)
    v = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
    anchor = (mask - (window_min(v, WINDOW) & mask)).astype(np.int64)
    sizes = np.diff(np.concatenate([[0], ends]))
    text = np.repeat(np.arange(len(ends)), sizes)[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[text])
    if not len(start):
        return none.astype(np.uint64), none, none, none, none
    a, t = anchor[start], text[start]
    cut = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (t[1:] != t[:-1])) + 1])
    last = np.concatenate([cut[1:], [len(start)]]) - 1
    return h[a[cut]], a[cut], start[cut], start[last], t[cut]


def joined_texts(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Texts put together up to ``size`` bytes: number of the first, bytes, ends.  A longer text is cut into
    pieces that overlap by ``LENGTH - 1``: see :func:`pieces`."""
    first, part, total = 0, [], 0
    for i, t in enumerate(texts):
        if part and total + len(t) > size:
            yield first, b"".join(part), np.cumsum([len(x) for x in part])
            first, part, total = i, [], 0
        part.append(t)
        total += len(t)
    if part:
        yield first, b"".join(part), np.cumsum([len(x) for x in part])


def pieces(text: bytes, size: int = CHUNK) -> list[tuple[int, bytes]]:
    """A text as ``(offset, bytes)`` pieces of bounded size that together hold each of its strings once.

    Runs may be cut at the seams, which changes spans and not strings.
    """
    if len(text) <= size:
        return [(0, text)]
    return [(at, text[at : at + size + LENGTH - 1]) for at in range(0, max(1, len(text) - LENGTH + 1), size)]


def _all_runs(texts: list[bytes]) -> Iterator[tuple]:
    """Per chunk: bytes, and arrays key, anchor, first, last, number of the text, offset to add for its places."""
    owner, offset, parts = [], [], []
    for i, t in enumerate(texts):
        for at, piece in pieces(t):
            if len(piece) >= LENGTH:
                owner.append(i)
                offset.append(at)
                parts.append(piece)
    own, off = np.array(owner, np.int64), np.array(offset, np.int64)
    for first, data, ends in joined_texts(parts):
        key, anchor, p0, p1, t = runs(data, ends)
        begin = np.concatenate([[0], ends[:-1]])
        yield data, key, anchor, p0, p1, own[first + t], off[first + t] - begin[t]


def _span_hashes(data: bytes, anchor: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> np.ndarray:
    import xxhash

    view, h = memoryview(data), xxhash.xxh3_64_intdigest
    return np.array([h(view[s : e + LENGTH], a - s) for a, s, e in zip(anchor.tolist(), p0.tolist(), p1.tolist(), strict=True)], dtype=np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _encoded(b: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data, key, anchor, p0, p1, _, _ in _all_runs(_encoded(b)):
            yield pa.RecordBatch.from_arrays([_signed(key), _signed(_span_hashes(data, anchor, p0, p1))], ["key", "span"])


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The keys' top bits as a bitmap of fixed size."""
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    rows = keys.select(place.alias("p")).groupBy(F.shiftright("p", 15).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _inside(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def two_stage_suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of ``text`` (values above 0, 0 ends a string) in the order of their first ``depth`` values.

    Only suffixes smaller than their successor are compared; the rest are induced in one scan.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    # smaller[i]: suffix i < suffix i + 1, decided at the next place where neighbours differ.
    differ = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.searchsorted(differ, np.arange(n - 1))
    at = np.where(nxt < len(differ), differ[np.minimum(nxt, max(0, len(differ) - 1))] if len(differ) else 0, n - 1)
    smaller = np.zeros(n, bool)
    inside = at < n - 1
    smaller[:-1] = inside & (text[np.minimum(at, n - 2)] < text[np.minimum(at, n - 2) + 1])
    direct = _sorted_directly(text, np.flatnonzero(smaller), depth)
    # Buckets by first value: induced suffixes lead, sorted ones end each.
    count = np.bincount(text, minlength=int(text.max()) + 1)
    begin = np.cumsum(count) - count
    own = np.bincount(text[direct], minlength=len(count))
    order = np.full(n, -1, np.int64)
    firsts = np.repeat(np.cumsum(count) - own, own) + np.arange(len(direct)) - np.repeat(np.cumsum(own) - own, own)
    order[firsts] = direct
    # The last suffix, followed by nothing, is the smallest of its bucket.
    put = begin.copy()
    order[put[text[-1]]] = n - 1
    put[text[-1]] += 1
    induced, ends = ~smaller, begin + count
    for c in np.flatnonzero(count).tolist():
        # A bucket is scanned in waves: what a wave adds to the bucket itself is the next one; the
        # directly sorted suffixes at its end are the last.
        at, sorted_from = int(begin[c]), int(ends[c] - own[c])
        while at < ends[c]:
            to = int(put[c]) if at < sorted_from else int(ends[c])
            before = order[at:to] - 1
            before = before[before >= 0]
            before = before[induced[before]]
            if len(before):
                into = text[before]
                by = np.argsort(into, kind="stable")
                before, into = before[by], into[by]
                heads = np.concatenate([[0], np.flatnonzero(into[1:] != into[:-1]) + 1])
                sizes = np.diff(np.concatenate([heads, [len(into)]]))
                order[np.repeat(put[into[heads]] - heads, sizes) + np.arange(len(into))] = before
                put[into[heads]] += sizes
            at = to
    return order


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """Six 10-bit values at every place as one number, zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(depth + 6, text.dtype)]).astype(np.int64)
    out = np.zeros(len(text) + depth, np.int64)
    for k in range(6):
        out = out << 10 | padded[k : k + len(out)]
    return out


def _sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the ``depth`` values there: of ties, those that the next six values tell apart are sorted by them."""
    if not len(at):
        return at
    words = _words(text, depth)
    order = at[np.argsort(words[at], kind="stable")]
    w = words[order]
    head = np.concatenate([[True], w[1:] != w[:-1]])  # of each group of ties
    tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    for step in range(6, depth, 6):
        if not len(tied):
            break
        begins = head[tied]
        group = np.cumsum(begins) - 1
        w = words[order[tied] + step]
        apart = np.zeros(int(group[-1]) + 1, bool)
        apart[group[1:][(w[1:] != w[:-1]) & ~begins[1:]]] = True
        mixed = apart[group]
        if not mixed.any():
            continue
        at_, g, w = tied[mixed], group[mixed], w[mixed]
        new = np.lexsort((w, g))
        order[at_] = order[at_][new]
        w = w[new]
        head[at_[1:]] |= (w[1:] != w[:-1]) & (g[1:] == g[:-1])
        last = np.concatenate([head[tied][1:], [True]])
        tied = tied[~(head[tied] & last)]
    return order


def repeated_starts(spans: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each span, its starts whose ``length`` bytes start anywhere else in ``spans``."""
    sizes = np.array([len(s) + 1 for s in spans])
    text = np.frombuffer(b"".join(s + b"\0" for s in spans), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    text[ends - 1] = 0
    order = two_stage_suffix_array(text, length)
    room = np.repeat(ends, sizes) - 1 - np.arange(len(text))
    words = _words(text, length)
    a, b = order[:-1], order[1:]
    same = (room[a] >= length) & (room[b] >= length)
    # The adjacent common prefix, as far as it matters.
    for step in [*range(0, length - 5, 6), length - 6]:
        near = np.flatnonzero(same)
        same[near] = words[a[near] + step] == words[b[near] + step]
    hit = np.zeros(len(text), bool)
    hit[a[same]] = True
    hit[b[same]] = True
    begin = ends - sizes
    return [np.flatnonzero(hit[s:e]) for s, e in zip(begin, ends, strict=True)]


def stretches(at: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive numbers as ``(first, last)``."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist(), strict=True))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From distinct spans sorted by key: repeated starts of each span, relative to it."""

    def settled(part: list[tuple]) -> pa.RecordBatch:
        out = [(k, s, lo, hi) for (k, s, _, _), hit in zip(part, repeated_starts([x[3] for x in part]), strict=True) for lo, hi in stretches(hit)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["key", "span", "lo", "hi"])

    part, size = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("key", "span", "n", "bytes")), strict=True):
            if size >= SORT_BYTES and part[-1][0] != row[0]:
                yield settled(part)
                part, size = [], 0
            part.append(row)
            size += len(row[3])
    if part:
        yield settled(part)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of every span as ``(key, h1, h2, span, place)``."""
    import xxhash

    for b in batches:
        for key, span, data in zip(*(b.column(c).to_pylist() for c in ("key", "span", "bytes")), strict=True):
            view = memoryview(data)
            h = [xxhash.xxh3_128_intdigest(view[i : i + LENGTH]) for i in range(len(data) - LENGTH + 1)]
            both = np.array([[x >> 64, x & (1 << 64) - 1] for x in h], dtype=np.uint64).view(np.int64).reshape(-1, 2)
            n = len(both)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(n, span)), pa.array(np.arange(n))], ["key", "h1", "h2", "span", "place"])


def repeated_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``text_id, start, end``: byte ranges of each distinct text (by MD5) that repeated strings cover."""
    spark = docs.sparkSession
    texts = docs.select(whole_text().alias("text"))
    counted = texts.mapInArrow(_anchors, "key long, span long").groupBy("key").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    known = materialize(counted.where("n > 1").select("key", F.expr("lo != hi").alias("mixed")), "anchors")
    repeated, mixed = (spark.sparkContext.broadcast(_bitmap(x)) for x in (known, known.where("mixed")))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = _encoded(b)
            names = [hashlib.md5(t).digest() for t in raw]
            for data, key, anchor, p0, p1, own, shift in _all_runs(raw):
                keep = _inside(repeated.value, key)
                key, anchor, p0, p1, own, shift = (x[keep] for x in (key, anchor, p0, p1, own, shift))
                held = _inside(mixed.value, key).tolist()
                bodies = [data[s : e + LENGTH] if m else None for s, e, m in zip(p0.tolist(), p1.tolist(), held, strict=True)]
                cols = [_signed(key), _signed(_span_hashes(data, anchor, p0, p1)), pa.array([names[i] for i in own.tolist()], pa.binary()), pa.array(p0 + shift), pa.array(p1 + shift), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "span", "text_id", "first", "last", "bytes"])

    found = materialize(texts.mapInArrow(occurrences, "key long, span long, text_id binary, first long, last long, bytes binary").join(known, "key"), "occurrences")
    whole = found.where("not mixed").select("text_id", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    spans = materialize(found.where("mixed").groupBy("key", "span").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes")), "spans")
    many = spans.groupBy("key").count().where(F.col("count") > hot).select("key")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = spans.join(many, "key", "left_anti").repartition(tasks, "key").sortWithinPartitions("key")
    sorted_out = few.select("key", "span", "n", "bytes").mapInArrow(_settle, "key long, span long, lo long, hi long")
    # Strings of spans that occur once, in anchors with too many spans for one task.
    strings = spans.join(many, "key", "left_semi").select("key", "span", "bytes").mapInArrow(_strings, "key long, h1 long, h2 long, span long, place long")
    twice = strings.groupBy("key", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    counted_out = strings.join(twice, ["key", "h1", "h2"]).select("key", "span", F.col("place").alias("lo"), F.col("place").alias("hi"))
    # A span that occurs twice repeats throughout.
    both = spans.where("n > 1").select("key", "span", F.lit(0).cast("long").alias("lo"), (F.octet_length("bytes") - LENGTH).cast("long").alias("hi"))
    marks = sorted_out.unionByName(counted_out).unionByName(both)
    partly = found.where("mixed").select("key", "span", "text_id", "first").join(marks, ["key", "span"]).select("text_id", (F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi") + LENGTH).alias("end"))
    return whole.unionByName(partly).distinct()


def without_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per row of ``docs``: what is removed and a digest of what is kept."""
    lists = ranges.groupBy("text_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("text_id", F.unhex(F.md5(F.col("text").cast("binary"))))
    both = rows.join(lists, "text_id", "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, raw, cuts in zip(b.column("doc_id").to_pylist(), _encoded(b), b.column("ranges").to_pylist(), strict=True):
                kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
                end = -1
                for c in sorted((c["start"], c["end"]) for c in cuts or []):
                    if c[0] > end:
                        kept.update(raw[at : c[0]])
                        spans += 1
                        removed += c[1] - c[0]
                        at = end = c[1]
                    elif c[1] > end:
                        removed += c[1] - end
                        at = end = c[1]
                kept.update(raw[at:])
                out.append((i, len(raw), removed, spans, kept.hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes, runs and the digest of what is left of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_ranges(docs, materialize(repeated_ranges(docs), "ranges"))
