"""Token ids of whole documents in files: canonical length-limited Huffman codes, independent blocks, checkpoints.

Global counts of ids give one code for the corpus, of at most ``MAX_BITS`` bits (package-merge).  It is
canonical: the lengths alone, in ``codebook.bin``, define it.  Documents are tokenised
once, dealt by ranges of ``doc_id``, encoded, and written in ascending order.

A file (little-endian) is a head ``QTID, version, documents, blocks, payload bytes``; per document its id, whether
it has one, and its number of ids; per block the bit at which it starts (a checkpoint); then the bits.  A
document starts at a byte and has a block for every ``BLOCK_IDS`` ids.  Blocks do not depend on one
another, so a reader may start at any checkpoint; ours decodes many at once, one table look-up per block
and step.  Only files in the written manifest are read: leftovers of lost or repeated tasks are not.

Edge cases: a null or empty text is the single end id; a null ``doc_id`` comes first and stays null; rows that
share an id follow one another in the order of a hash of their ids and are rows of their own; an empty table gives
no rows; other columns are ignored.  A text is tokenised in pieces, but its codes are held at once.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, scratch, table, whole_text

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
MAX_BITS, BLOCK_IDS, ROLL_BYTES, DECODED_IDS = 16, 1024, 32 << 20, 4 << 20
MAGIC, VERSION = b"QTID", 1
HEAD, BOOK = struct.Struct("<4sIQQQ"), struct.Struct("<4sIII")
CACHED_WORDS, FLUSH_CHARS = 1_200_000, 4 << 20

# -- ids ------------------------------------------------------------------------------------------

#: Texts of these characters alone are split here as the vocabulary's own splitter would split them.
PLAIN = re.compile(r"[\t\n\r\x20-~À-ÖØ-öø-ÿ]*")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Letters and digits come first: no other alternative can begin where they do.
WORD = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: No token reaches across such a blank: it begins the next one.
SEAM = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
PIECE_CHARS = 1 << 14


def byte_letters() -> dict[int, str]:
    """The letters by which the vocabulary writes bytes: printable ones stand for themselves, the others for those from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class ByteIds:
    """Ids of texts, by way of distinct words.

    The words of several texts are dictionary-encoded together; the library encodes each distinct word that is not
    known yet, and the ids are put together by number.  About ``CACHED_WORDS`` words are kept, those met again longest.
    Pieces with other characters, or with the text of a special token, are encoded whole by the library, and so
    is every piece where the vocabulary is not the default one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model, self.letters = tokenizer.encode, tokenizer.model, byte_letters()
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.by_words = os.path.basename(path) == TOKENIZER

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def pieces(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > PIECE_CHARS and (seam := SEAM.search(text, start + PIECE_CHARS)):
            yield text[start : seam.start()]
            start = seam.start()
        yield text[start:] if start else text

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        known = self.known
        if self.older:
            known.update((w, self.older[w]) for w in words if w not in known and w in self.older)
        if new := [w for w in words if w not in known]:
            # The library's merges alone, for what its splitter has nothing left to split.
            found = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))] for w in new]
            ids = np.array([i for x in found for i in x], self.kind).tobytes()
            cuts = np.cumsum([0, *map(len, found)]) * self.kind.itemsize
            known.update((w, ids[i:j]) for w, i, j in zip(new, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        out = list(map(known.__getitem__, words))
        if len(known) > CACHED_WORDS // 2:
            self.known, self.older = {}, known
        return out

    def joined(self, words: list[str], ends: list[int], odd: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces, each of which is the words up to its end; what begins with NUL is a place in ``odd``."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        plain = [w for w in distinct if w[0] != "\0"]
        found = iter(self.of_words(plain))
        parts = [odd[int(w[1:])] if w[0] == "\0" else next(found) for w in distinct] if odd else list(found)
        flat, n = np.frombuffer(b"".join(parts), self.kind), np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        first, n = (np.cumsum(n) - n)[at], n[at]
        stop = np.cumsum(n)
        ids = flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(first - (stop - n), n)]
        bounds = np.append(0, stop)[np.array([0, *ends])].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.frombuffer(self.whole(t), self.kind) for t in texts]
        pieces: list[list[np.ndarray]] = [[] for _ in texts]
        words, ends, owners, odd, size = [], [], [], [], 0

        def flush() -> None:
            for k, ids in zip(owners, self.joined(words, ends, odd), strict=True):
                pieces[k].append(ids)
            for x in (words, ends, owners, odd):
                x.clear()

        for k, text in enumerate(texts):
            for piece in self.pieces(text):
                if PLAIN.fullmatch(piece) and "<|" not in piece:
                    words += WORD.findall(piece)
                else:
                    words.append(f"\0{len(odd)}")
                    odd.append(self.whole(piece))
                ends.append(len(words))
                owners.append(k)
                size += len(piece)
                if size >= FLUSH_CHARS:
                    flush()
                    size = 0
        flush()
        return [np.concatenate(x) if len(x) > 1 else x[0] for x in pieces]


@lru_cache(maxsize=1)
def byte_ids(path: str) -> ByteIds:
    """One cache per worker process: workers outlive their tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteIds(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, wide, ids`` of every document, the end id last; ids as little-endian integers of 16 bits or, where ``wide``, 32."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_ids(path)
        end = np.array([end_id], encode.kind).tobytes()
        for b in batches:
            data = [ids.tobytes() + end for ids in encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([encode.kind.itemsize == 4] * len(data), pa.bool_()), pa.array(data, pa.binary())], ["doc_id", "wide", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(give_back(run), "doc_id long, wide boolean, ids binary")


def unpacked(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4" if w else "<u2").astype(np.int64) for x, w in zip(b.column("ids").to_pylist(), b.column("wide").to_pylist(), strict=True)]


def id_counts(ids: DataFrame) -> DataFrame:
    """``id, n`` over all documents; a task's counts are added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in unpacked(b):
                n = np.bincount(x, minlength=len(total))
                n[: len(total)] += total
                total = n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    return ids.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# -- the code -------------------------------------------------------------------------------------


def limited_lengths(weights: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits, for ``weights`` in ascending order (package-merge).

    Every level merges the leaves with the pairs of the level below; the cheapest ``2n - 2`` items of the top
    level hold a leaf once for each bit of its code.
    """
    n = len(weights)
    if n > 1 << most:
        raise ValueError(f"{n} symbols have no code of {most} bits")
    if n < 2:
        return np.ones(n, np.int64)
    merged, leaves = weights.astype(object) if weights.sum() >= 1 << 57 else weights, [np.ones(n, bool)]
    for _ in range(most - 1):
        even = len(merged) // 2 * 2
        both = np.concatenate([weights, merged[0:even:2] + merged[1:even:2]])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        leaves.append(order < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(leaves):
        whole = int(np.count_nonzero(leaf[:take]))
        lengths[:whole] += 1
        take = 2 * (min(take, len(leaf)) - whole)
    return lengths


class Code:
    """A canonical code from lengths: shorter codes first, equal lengths by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths.max()) if len(ids) else 1
        spans = np.int64(1) << (self.bits - self.lengths)
        self.codes = (np.cumsum(spans) - spans) >> (self.bits - self.lengths)
        self.spans = spans

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray, most: int = MAX_BITS) -> Code:
        order = np.lexsort((ids, counts))
        most = max(most, int(max(1, len(ids) - 1)).bit_length())
        return cls(ids[order], limited_lengths(counts[order], most))

    def to_bytes(self) -> bytes:
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        lengths = np.zeros(size, np.uint8)
        lengths[self.ids] = self.lengths
        return BOOK.pack(MAGIC, VERSION, self.bits, size) + lengths.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Code:
        magic, version, _, size = BOOK.unpack_from(data)
        if magic != MAGIC or version != VERSION or len(data) != BOOK.size + size:
            raise ValueError("not a code book")
        lengths = np.frombuffer(data, np.uint8, size, BOOK.size)
        ids = np.flatnonzero(lengths)
        return cls(ids, lengths[ids])

    def encoder(self):
        """From the ids of documents to their bits, each document's from a byte on, and the first bit of each block after the first."""
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        code, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        code[self.ids], length[self.ids] = self.codes, self.lengths
        across = (self.bits + 14) // 8

        def encode(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
            n = length[ids]
            ends = np.cumsum(n)
            at = ends - n
            byte, bit = at >> 3, at & 7
            # A code from any bit on lies in so many bytes; bits of different codes never meet, so sums are unions.
            put = code[ids] << (8 * across - n - bit)
            total = int(ends[-1] + 7) >> 3 if len(ids) else 0
            out = np.zeros(total + across, np.float64)
            for k in range(across):
                part = np.bincount(byte, weights=(put >> (8 * (across - 1 - k))) & 255, minlength=total)
                out[k : k + len(part)] += part
            return out[:total].astype(np.uint8).tobytes(), at[BLOCK_IDS::BLOCK_IDS]

        return encode

    def decode(self, payload: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of blocks, one behind the other; ``payload`` has four spare bytes at its end.

        All blocks advance together: a step reads the next bits of each, looks up what they stand for, and moves on.
        """
        symbol = np.zeros(1 << self.bits, np.int64)
        width = np.zeros(1 << self.bits, np.int64)
        filled = int(self.spans.sum())
        symbol[:filled], width[:filled] = np.repeat(self.ids, self.spans), np.repeat(self.lengths, self.spans)
        order = np.argsort(-sizes, kind="stable")
        place = (np.cumsum(sizes) - sizes)[order]
        at, left = starts[order].astype(np.int64), sizes[order]
        out = np.empty(int(sizes.sum()), np.int64)
        mask, down = (1 << self.bits) - 1, 32 - self.bits
        open_blocks = len(order) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), side="right")
        for k, n in enumerate(open_blocks.tolist()):
            byte = at[:n] >> 3
            window = (payload[byte].astype(np.int64) << 24) | (payload[byte + 1].astype(np.int64) << 16) | (payload[byte + 2].astype(np.int64) << 8) | payload[byte + 3]
            window = (window >> (down - (at[:n] & 7))) & mask
            out[place[:n] + k] = symbol[window]
            at[:n] += width[window]
        return out


# -- files ----------------------------------------------------------------------------------------


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri}" if uri.startswith("/") else "file://" + uri.removeprefix("file:"))


def file_bytes(docs: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """A file of documents ``(id, number of ids, bits, block offsets)``."""
    sizes = np.array([len(x[2]) for x in docs], np.int64)
    first = 8 * (np.cumsum(sizes) - sizes)
    points = [np.concatenate([[s], s + np.frombuffer(x[3], "<i8")]) for s, x in zip(first, docs, strict=True)]
    points = np.concatenate(points).astype("<u8")
    ids = np.array([x[0] or 0 for x in docs], "<i8")
    known = np.array([x[0] is not None for x in docs], np.uint8)
    head = HEAD.pack(MAGIC, VERSION, len(docs), len(points), int(sizes.sum()))
    return b"".join([head, ids.tobytes(), known.tobytes(), np.array([x[1] for x in docs], "<i8").tobytes(), points.tobytes(), *(x[2] for x in docs)])


def file_documents(data: bytes, code: Code) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file, in order: id and token ids.  Raises where the parts do not fit."""
    magic, version, docs, blocks, size = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or len(data) != HEAD.size + 17 * docs + 8 * blocks + size:
        raise ValueError("not a file of token ids, or a part of one")
    view = memoryview(data)[HEAD.size :]
    ids, known = np.frombuffer(view, "<i8", docs), np.frombuffer(view, np.uint8, docs, 8 * docs)
    counts = np.frombuffer(view, "<i8", docs, 9 * docs)
    points = np.frombuffer(view, "<u8", blocks, 17 * docs).astype(np.int64)
    payload = np.concatenate([np.frombuffer(view, np.uint8, size, 17 * docs + 8 * blocks), np.zeros(4, np.uint8)])
    per_doc = -(-counts // BLOCK_IDS)
    if per_doc.sum() != blocks:
        raise ValueError("a file of token ids with blocks missing")
    last = np.cumsum(per_doc)
    lengths = np.full(blocks, BLOCK_IDS, np.int64)
    lengths[last[per_doc > 0] - 1] = (counts - BLOCK_IDS * (per_doc - 1))[per_doc > 0]
    ends = np.cumsum(counts)
    start = 0
    while start < docs:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + DECODED_IDS, side="right")))
        a, b = (int(last[start - 1]) if start else 0), int(last[end - 1])
        found = code.decode(payload, points[a:b], lengths[a:b])
        for k in range(start, end):
            yield (int(ids[k]) if known[k] else None), found[int(ends[k] - counts[k]) - before : int(ends[k]) - before]
        start = end


def write_ids(ids: DataFrame, out: str, max_bits: int = MAX_BITS, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``ids`` (of :func:`token_ids`, a written table) below ``out``; returns the manifest ``path, part, seq, documents, ids, start``.

    ``start`` is the number of ids in all files before.
    """
    spark = ids.sparkSession
    # As many rows as the vocabulary has ids.
    counts = id_counts(ids).toArrow()
    code = Code.of_counts(np.asarray(counts["id"], dtype=np.int64), np.asarray(counts["n"], dtype=np.int64), max_bits)
    store, base = _open(out)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/codebook.bin", compression=None) as sink:
        sink.write(code.to_bytes())

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(out)
        part, held, size, done = TaskContext.get().partitionId(), [], 0, []
        encode = code.encoder()

        def close() -> None:
            name = f"{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{base}/{name}", compression=None) as sink:
                sink.write(file_bytes(held))
            done.append((name, part, len(done), len(held), sum(x[1] for x in held)))

        for b in batches:
            for doc_id, found in zip(b.column("doc_id").to_pylist(), unpacked(b), strict=True):
                bits, points = encode(found)
                held.append((doc_id, len(found), bits, points.astype("<i8").tobytes()))
                size += len(bits) + 32
                if size >= roll_bytes:
                    close()
                    held, size = [], 0
        if held:
            close()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], ["path", "part", "seq", "documents", "ids"])

    total = int(np.dot(np.asarray(counts["n"], dtype=np.float64)[np.argsort(np.asarray(counts["id"]))], code.lengths[np.argsort(code.ids)])) // 8
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // roll_bytes + 1)
    # Dealt before they are encoded: finding the ranges reads the table twice, but encodes nothing.
    order = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    dealt = ids.withColumn("tie", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    manifest = materialize(dealt.select("doc_id", "wide", "ids").mapInArrow(give_back(written), "path string, part int, seq int, documents long, ids long"), "ids-manifest")
    # One row a file; files before this one: those of smaller parts, then of smaller numbers.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "ids-starts")
    discard(manifest)
    return starts


def read_ids(manifest: DataFrame, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (32-bit, little-endian) of the documents in the files that ``manifest`` names."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(out)
        code = None
        for b in batches:
            for name, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                if code is None:
                    with store.open_input_stream(f"{base}/codebook.bin", compression=None) as stream:
                        code = Code.from_bytes(stream.read())
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    data = stream.read()
                rows, size = [], 0
                for doc_id, found in file_documents(data, code):
                    rows.append((doc_id, start, len(found), found.astype("<u4").tobytes()))
                    start += len(found)
                    size += 4 * len(found)
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    spread = max(1, min(4096, manifest.count()))
    return manifest.select("path", "start").repartition(spread, "path").mapInArrow(give_back(run), "doc_id long, start long, n_tokens long, ids binary")


def op12_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents, then reads the files back: where each document stands, and a digest of its ids."""
    out = scratch(spark, "token-ids")
    ids = materialize(token_ids(table(spark, sf_dir, "documents")), "ids")
    manifest = write_ids(ids, out)
    discard(ids)
    return read_ids(manifest, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
