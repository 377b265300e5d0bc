"""Best-fit packing of token sequences by hierarchical residuals.

Every partition packs its own pieces best-fit, longest first.  Bins filled to ``FULL`` or more, or that
no piece could still enter, are emitted; the others go up a tree as items of their own (their contents
stay together) and are packed again among at most half as many groups, until one group is left.  A
group takes ``ITEMS_PER_TASK`` items on average; where more bins are left, the emptiest go up and the
others are emitted as they are.  (Of bins at most half full a group leaves one, so all of these go up.)
An item carries at most ``capacity`` members, so memory does not follow the size of the table.

Edge cases: a null or empty text is the single end id; repeated rows are separate pieces; a null
``doc_id`` is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, whole_text

CAPACITY, END_ID = 4096, 1
DEFAULT_TOKENIZER = "word_bpe_49k.json"
ITEMS_PER_TASK = 20_000
#: Bins filled to this share are not packed again.
FULL = 0.99
CACHED_WORDS = 700_000
MEMBERS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts of these characters alone are split here as the vocabulary's own splitter would: none of them
#: changes under composition, and Python and the normaliser lower them alike.
PLAIN = re.compile(r"[\t\n\r\x20-~À-ÖØ-öø-ÿ]*")
LETTERS = "a-zß-öø-ÿ"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")


class WordIds:
    """Ids of texts as little-endian bytes, by way of their words.

    The normaliser and splitter never join what white space separates, so a text's ids are its
    words' ids in order.  New words of a text are encoded in one call; about ``CACHED_WORDS`` words are
    kept, those met again longest.  Texts for other vocabularies than the default are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.by_words = os.path.basename(path) == DEFAULT_TOKENIZER  # what PLAIN and PIECE are written for

    def __call__(self, text: str) -> bytes:
        if not self.by_words:
            ids = self.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if PLAIN.fullmatch(text) and "<|" not in text:
            words = PIECE.findall(text.lower())
        else:
            words = [w for line in text.split("\n") for w in line.split(" ") if w]
        new = list(set(words).difference(self.known))
        if new and self.older:
            self.known.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in self.older]
        if new:
            found = self.encode(new, is_pretokenized=True, add_special_tokens=False)
            ids: list[list[int]] = [[] for _ in new]
            for i, k in zip(found.ids, found.word_ids, strict=True):
                ids[k].append(i)
            self.known.update((w, struct.pack(f"<{len(x)}I", *x)) for w, x in zip(new, ids, strict=True))
        out = b"".join(map(self.known.__getitem__, words))
        if len(self.known) > CACHED_WORDS // 2:
            self.known, self.older = {}, self.known
        return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One cache per worker process: workers outlive their tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)`` of a document's packed ids."""
    step = 4 * capacity
    for k, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens of every document."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(path), struct.pack("<I", end_id)
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows += [(i, *x) for x in cut_pieces(encode(text) + end, capacity)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit, longest first: bins as lists of positions in ``lengths``."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms that have an open bin
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            k = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(k)
    return bins


def _pack_partition(capacity: int, closed_at: int):
    """Packs a partition's items; ``done`` marks bins filled beyond ``closed_at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        fills: list[int] = []
        members: list[list] = []
        for b in batches:
            schema = b.schema
            fills += b.column("fill").to_pylist()
            members += b.column("members").to_pylist()
        if not fills:
            return
        kind = schema.field("members").type
        out = [(sum(fills[i] for i in x), [m for i in x for m in members[i]]) for x in best_fit(fills, capacity)]
        for at in range(0, len(out), 2000):
            part = out[at : at + 2000]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.int64()), pa.array([m for _, m in part], kind), pa.array([f > closed_at for f, _ in part])], ["fill", "members", "done"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset``: as few sequences of at most ``capacity`` as the rounds find."""
    items = pieces.select(F.col("length").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).cast(MEMBERS).alias("members"))
    facts = pieces.agg(F.count("*"), F.min("length")).first()
    closed_at = min(capacity - (facts[1] or 0), int(FULL * capacity) - 1)
    tasks = max(1, -(-facts[0] // items_per_task))
    emitted: list[DataFrame] = []
    schema = f"fill long, members {MEMBERS}, done boolean"
    while True:
        # Dealt by row number, so that equal rows part; the tables are written, so the numbers stay.
        dealt = items.withColumn("__row", F.monotonically_increasing_id()).repartition(tasks, F.xxhash64("__row", F.lit(len(emitted)))).select("fill", "members")
        packed = materialize(dealt.mapInArrow(_pack_partition(capacity, closed_at), schema), "pack")
        # At most one row per possible fill.
        fills = sorted((r["fill"], r["count"]) for r in packed.where("not done").groupBy("fill").count().collect())
        left = sum(n for _, n in fills)
        groups = max(1, min(tasks // 2, -(-left // items_per_task)))
        limit, taken = -1, 0
        for fill, n in fills:
            if taken + n > groups * items_per_task:
                break
            limit, taken = fill, taken + n
        if tasks == 1 or taken < 2:
            emitted.append(packed.select("members"))
            break
        up = ~F.col("done") & (F.col("fill") <= limit)
        emitted.append(packed.where(~up).select("members"))
        items, tasks = packed.where(up).select("fill", "members"), groups
    bins = emitted[0]
    for x in emitted[1:]:
        bins = bins.unionByName(x)
    # A sequence is named by a unique number per row of a written table: stable, since files are fixed.
    named = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return named.mapInArrow(_place, f"{PIECES}, sequence_id long, offset long")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences as rows of their members, each with the tokens before it."""
    for b in batches:
        lists = b.column("members")
        sizes = np.asarray(pc.list_value_length(lists).fill_null(0))
        flat = lists.flatten()
        length = np.asarray(flat.field("length"), dtype=np.int64)
        total = np.cumsum(length) - length
        first = np.cumsum(sizes) - sizes
        offset = total - np.repeat(total[first[sizes > 0]], sizes[sizes > 0]) if len(length) else length
        names = [f.name for f in flat.type]
        cols = [flat.field(n) for n in names] + [pa.array(np.repeat(np.asarray(b.column("sequence_id")), sizes)), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 4096 tokens, packed into sequences."""
    return pack(materialize(tokenized_pieces(table(spark, sf_dir, "documents")), "pieces"))
