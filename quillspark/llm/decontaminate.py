"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every pair of neighbouring words of a test item is a seed; a document holds it where the two words
stand next to each other or with one word between.  An alignment of half the perfect score holds at
least ``seeds_needed`` of them (see there), so a document with as many around one place gives a
passage, which is aligned with the item by local alignment over words, and no other can score enough.
Items of fewer than ``LONG_ITEM`` words, where two words would do, need three words in a row.

The benchmark is a stated query set: its index goes to every task, in blocks of items of at most
``BLOCK_BYTES`` of text each, so its size is bounded whatever the benchmark; the documents are only
scanned and never shuffled.

Edge cases: a null or empty text or item matches nothing; items shorter than three words are one
seed of their own length; repeated items each report; a null ``doc_id`` is kept; empty tables give no rows;
other columns are ignored by the query and kept by the filter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table, whole_text

SEED_WORDS, SHORT_SEED, LONG_ITEM, MIN_SCORE = 2, 3, 7, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 16 << 20
WORD = re.compile(r"[^\W_]+")
FILTER_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit value per run of ``n`` word numbers."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : len(ids) - n + 1 + k].astype(np.uint64)) * _ODD
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Index:
    """Items of one block as word numbers, and the n-grams looked for: sorted hashes with places."""

    ids: list[int]
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    grams: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length and whether the items are long: hash (sorted), item, position

    def filters(self) -> dict[tuple[int, bool], np.ndarray]:
        out = {}
        for key, (h, _, _) in self.grams.items():
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            out[key] = bits
        return out


def seeds_needed(size: int, min_score: float = MIN_SCORE) -> int:
    """How many of the item's ``size - 1`` seeds an alignment of ``min_score`` holds at least.

    Between two matched words that are no seed either an item word is passed over (one edit at least;
    ``skipped`` times, and the item has room for so many only) or two words are inserted (two edits).
    """
    if size < LONG_ITEM:
        return 1
    held = 0
    while held < size - 1:
        skipped = (size - held - 1) // 2
        if MATCH * (held + 1) + (MATCH + GAP) * skipped >= min_score * MATCH * size:
            break
        held += 1
    return max(1, held)


def build_index(rows: list[tuple[int, str]]) -> Index:
    """All seeds of the items."""
    vocabulary: dict[str, int] = {}
    ids, items = [], []
    for i, text in rows:
        w = words_of(text or "")
        if w:
            ids.append(i)
            items.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], dtype=np.int64))
    found: dict[tuple[int, bool], list] = {}
    for k, item in enumerate(items):
        long = len(item) >= LONG_ITEM
        size = SEED_WORDS if long else min(SHORT_SEED, len(item))
        h = gram_hashes(item, size)
        found.setdefault((size, long), []).append((h, np.full(len(h), k), np.arange(len(h))))
    grams = {}
    for key, parts in found.items():
        h, k, p = (np.concatenate([x[j] for x in parts]) for j in range(3))
        order = np.argsort(h, kind="stable")
        grams[key] = (h[order], k[order], p[order])
    return Index(ids, items, vocabulary, grams)


def hits(index: Index, filters: dict, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(item, place in the item, place in the text)`` for the seeds that a text holds."""
    known = ids > 0
    for (n, long), (h, item, place) in index.grams.items():
        for step in (1, 2) if long else (1,):
            span = (n - 1) * step
            if len(ids) <= span:
                continue
            whole = known[: len(ids) - span].copy()
            for k in range(1, n):
                whole &= known[k * step : len(ids) - span + k * step]
            at = np.flatnonzero(whole)
            g = np.zeros(len(at), np.uint64)
            for k in range(n):
                g = (g ^ ids[at + k * step].astype(np.uint64)) * _ODD
                g ^= g >> np.uint64(29)
            keep = filters[n, long][(g & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
            at, g = at[keep], g[keep]
            if not len(at):
                continue
            first = np.searchsorted(h, g)
            many = np.searchsorted(h, g, side="right") - first
            rank = np.repeat(first - np.concatenate([[0], many.cumsum()[:-1]]), many) + np.arange(many.sum())
            if len(rank):
                yield item[rank], place[rank], np.repeat(at, many)


def number(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    get = vocabulary.get
    return np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the place in ``passage`` where it ends."""
    j = np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for w in item:
        t = np.maximum(row + GAP, 0)
        np.maximum(t[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH), out=t[1:])
        row = np.maximum(np.maximum.accumulate(t - GAP * j) + GAP * j, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def scanner(index: Index, min_score: float = MIN_SCORE) -> Callable[[str], list[tuple[int, float, int, int]]]:
    """A function from a text to ``(item_id, score, first word, words)``, the best passage of each item."""
    filters, memo = index.filters(), {}
    sizes = np.array([len(x) for x in index.items], dtype=np.int64)
    needed = np.array([seeds_needed(len(x), min_score) for x in index.items], dtype=np.int64)

    def aligned(k: int, passage: np.ndarray) -> tuple[int, int]:
        key = (k, passage.tobytes())
        if key not in memo:
            if len(memo) > 5_000:
                memo.clear()
            memo[key] = align(index.items[k], passage)
        return memo[key]

    def scan(text: str) -> list[tuple[int, float, int, int]]:
        ids = number(text, index.vocabulary)
        parts = list(hits(index, filters, ids))
        if not parts:
            return []
        item, place, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        enough = np.bincount(item, minlength=len(needed)) >= needed
        keep = enough[item]
        start = at[keep] - place[keep]
        order = np.lexsort((start, item[keep]))
        item, place, start = item[keep][order], place[keep][order], start[order]
        # An alignment has no more edits than the item has words: its seeds start within as many words of each other.
        apart = np.flatnonzero((item[1:] != item[:-1]) | (start[1:] - start[:-1] > sizes[item[1:]])) + 1
        cuts, best = [0, *apart.tolist(), len(item)] if len(item) else [], {}
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            k = int(item[s])
            size = int(sizes[k])
            if len(np.unique(place[s:e])) < needed[k]:
                continue
            a, b = max(0, int(start[s]) - size), min(len(ids), int(start[e - 1]) + 2 * size)
            score, end = aligned(k, ids[a:b])
            if score >= min_score * MATCH * size and score > best.get(k, (0,))[0]:
                best[k] = (score, a, a + end)
        out = []
        for k, (score, a, end) in best.items():
            # Read backwards from its end, the alignment ends where it begins.
            n = align(index.items[k][::-1], ids[a:end][::-1])[1]
            out.append((index.ids[k], score / (MATCH * int(sizes[k])), end - n, n))
        return sorted(out, key=lambda x: (x[0] is None, x[0], -x[1]))

    return scan


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size, streamed to the driver one partition at a time."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), whole_text()).toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def seeded_indexes(benchmark: DataFrame) -> Iterator[Index]:
    for rows in item_blocks(benchmark):
        index = build_index(rows)
        if index.items:
            yield index


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, item_id, score, first_word, n_words`` of every document and item that align."""
    schema = "doc_id long, item_id long, score double, first_word long, n_words long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found: DataFrame | None = None
    for index in seeded_indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            scan = scanner(index, min_score)
            for b in batches:
                out = [(i, *x) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for x in scan(t)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "first_word", "n_words"])

        part = rows.mapInArrow(give_back(run), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows that align with a test item; columns as they were."""
    for index in seeded_indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            scan = scanner(index, min_score)
            for b in batches:
                yield b.filter(pa.array([not scan(t or "") for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(give_back(run), docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the item and the alignment score."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
