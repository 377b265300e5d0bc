"""SimHash near-duplicates with covering-code anchors.

Anchors are the words of a code on the 64 fingerprint bits: two binary Golay codes [23,12] side by
side, and the one-word code on the 18 bits left.  Golay codes are perfect, so every fingerprint has
exactly one anchor within the covering radius (3 + 3 + 18): its home.  Two fingerprints that differ
in at most ``t`` bits then share the home of either, because the other lies within the radius plus
``t`` of it.  Each distinct fingerprint is therefore replicated to every anchor within radius plus
threshold, where a block's distance counts only beyond that block's radius (what the triangle
inequality needs), and compared there with the fingerprints at home.

A Bloom filter of the occupied places (a home with its 18 other bits; ``BITS_EACH`` bits for each
fingerprint, 64 MB at most) removes replicas nobody could meet: a replica whose blocks lie ``e`` beyond
their radius can only meet homes that differ in at most ``t - e`` of the other bits, and all of these
are looked up.  As it fills beyond that it removes less; it never removes a link.
Anchors with many fingerprints are dealt out as blocks of bounded size, and of the links in a block
only those that join sets not yet joined leave it, so a ball of near copies gives a forest of links,
not all its pairs.

Edge cases: a null text is an empty one; texts without words have fingerprint zero and link like any
other; repeated rows share a component; a null ``doc_id`` is kept but never names a component unless
all its members are null (then null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import discard, join_hot, materialize, table, whole_text

WORDS, SEED, THRESHOLD = 3, 42, 3
GOLAY = 0b101011100011  # the generator polynomial of the binary Golay code [23,12]
RADIUS = 3
BLOCK = 2048
LEFT_BITS = 18
LEAST_BITS, MOST_BITS, BITS_EACH, PROBES = 20, 29, 16, 4
FINGERPRINTS_PER_TASK = 50_000


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    hashes = [h(b" ".join(w[i : i + words]), seed) for i in range(max(1, len(w) - words + 1))]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, list, np.ndarray]:
    """Tables of the code: parity by message, coset leader by syndrome, leader weight by syndrome,
    ``near[w][e]`` (rows: leaders of weight w; values: messages of codewords at distance 3 + e,
    within 3 for e = 0), and a leader's row by syndrome."""
    message = np.arange(4096, dtype=np.int64)
    parity = message << 11
    for bit in range(22, 10, -1):
        parity ^= np.where(parity >> bit & 1, GOLAY << (bit - 11), 0)
    words = message << 11 | parity
    leader = np.full(2048, -1, dtype=np.int64)
    one = [1 << i for i in range(23)]
    for e in [0, *one, *(a | b for a in one for b in one if a < b), *(a | b | c for a in one for b in one for c in one if a < b < c)]:
        leader[(e & 2047) ^ parity[e >> 11]] = e
    weight = np.bitwise_count(leader).astype(np.int64)
    near, row = [], np.zeros(2048, dtype=np.int64)
    for w in range(RADIUS + 1):
        own = np.flatnonzero(weight == w)
        row[own] = np.arange(len(own))
        far = np.maximum(np.bitwise_count(leader[own][:, None] ^ words[None, :]).astype(np.int64) - RADIUS, 0)
        near.append([np.stack([np.flatnonzero(d == e) for d in far]) for e in range(THRESHOLD + 1)])
    return parity, leader, weight, near, row


def _blocks(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Home message and syndrome of each of the two Golay blocks."""
    parity, leader, *_ = golay()
    out = []
    for shift in (0, 23):
        v = (fp >> np.uint64(shift)).astype(np.int64) & 0x7FFFFF
        syndrome = (v & 2047) ^ parity[v >> 11]
        out.append(((v ^ leader[syndrome]) >> 11, syndrome))
    return out


def home_anchor(fp: np.ndarray) -> np.ndarray:
    (a, _), (b, _) = _blocks(fp)
    return a << 12 | b


def places(anchor: np.ndarray, left: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The ``PROBES`` bit numbers, in a filter of 2 to the ``bits`` bits, of an anchor with the 18 bits left."""
    x = (anchor.astype(np.uint64) << np.uint64(LEFT_BITS)) | left.astype(np.uint64)
    for seed in range(PROBES):
        x = (x ^ (x >> np.uint64(23)) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        yield (x >> np.uint64(64 - bits)).astype(np.int64)


def left_bits(fp: np.ndarray) -> np.ndarray:
    return (fp >> np.uint64(46)).astype(np.int64)


@lru_cache(maxsize=4)
def flips(most: int) -> np.ndarray:
    """All patterns of at most ``most`` of the 18 bits left."""
    one = [1 << i for i in range(LEFT_BITS)]
    out = {0}
    for _ in range(most):
        out |= {a ^ b for a in out for b in one}
    return np.array(sorted(x for x in out if x.bit_count() <= most), dtype=np.int64)


def may_meet(occupied: np.ndarray, anchor: np.ndarray, left: np.ndarray, beyond: np.ndarray, threshold: int) -> np.ndarray:
    """Which replicas could meet a home, by the filter."""
    keep, bits = np.zeros(len(anchor), bool), (8 * len(occupied)).bit_length() - 1
    for e in range(threshold + 1):
        own = np.flatnonzero(beyond == e)
        near = flips(threshold - e)
        who = np.repeat(own, len(near))
        look = (left[own][:, None] ^ near[None, :]).ravel()
        for k in range(PROBES):
            if not len(who):
                break
            bit = next(x for j, x in enumerate(places(anchor[who], look, bits)) if j == k)
            hit = (occupied[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            who, look = who[hit], look[hit]
        keep[who] = True
    return keep


def replicas(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(position in fp, anchor, distance beyond the radius)`` for every anchor within covering radius plus ``threshold``."""
    _, _, weight, near, row = golay()
    (a, sa), (b, sb) = _blocks(fp)
    at, anchors, beyond = [], [], []
    for wa in range(RADIUS + 1):
        for wb in range(RADIUS + 1):
            own = np.flatnonzero((weight[sa] == wa) & (weight[sb] == wb))
            if not len(own):
                continue
            for ea in range(threshold + 1):
                left = a[own][:, None] ^ near[wa][ea][row[sa[own]]]
                for eb in range(threshold + 1 - ea):
                    right = b[own][:, None] ^ near[wb][eb][row[sb[own]]]
                    both = (left[:, :, None] << 12 | right[:, None, :]).reshape(len(own), -1)
                    at.append(np.repeat(own, both.shape[1]))
                    anchors.append(both.ravel())
                    beyond.append(np.full(both.size, ea + eb))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(at or none), np.concatenate(anchors or none), np.concatenate(beyond or none)


def forest(home: np.ndarray, others: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links between ``home`` and ``others`` at ``threshold`` or fewer bits, as a spanning forest of them."""
    ids, place = np.unique(np.concatenate([home, others]), return_inverse=True)
    parent, out, at, step = np.arange(len(ids)), [], 0, 1
    left, right = place[: len(home)], place[len(home) :]
    while at < len(home):
        i, j = np.nonzero(np.bitwise_count(home[at : at + step, None] ^ others[None, :]) <= threshold)
        x, y = left[at + i], right[j]
        new = parent[x] != parent[y]
        for p, q in zip(x[new].tolist(), y[new].tolist(), strict=True):
            u, v = p, q
            while parent[u] != u:
                u = parent[u]
            while parent[v] != v:
                v = parent[v]
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((int(ids[p]), int(ids[q])))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        at, step = at + step, min(256, 2 * step)
    return out


def _links(threshold: int):
    """From rows sorted by block: the forests of all blocks.  Holds one block (and a batch) at a time."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rest: list[tuple] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("anchor", "hb", "rb")], 1)
            fp, home = np.asarray(b.column("fp")).view(np.uint64), np.asarray(b.column("home").cast(pa.int8())).astype(bool)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(key[s])
                if now != last and rest:
                    yield np.concatenate([x for x, _ in rest]), np.concatenate([x for _, x in rest])
                    rest = []
                last = now
                rest.append((fp[s:e], home[s:e]))
        if rest:
            yield np.concatenate([x for x, _ in rest]), np.concatenate([x for _, x in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for fp, home in blocks(batches):
            if home.any() and not home.all():
                out += forest(fp[home], fp[~home], threshold)
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def with_fingerprint(docs: DataFrame, id_cols: list[str], text: Column | None = None, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``id_cols`` and the fingerprint ``fp`` as a signed long."""
    rows = docs.select(*id_cols, (whole_text() if text is None else text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words, seed) for t in b.column("__text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in id_cols), pa.array(fp)], [*id_cols, "fp"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "__text") + ", fp long")


def fingerprint_links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of the distinct ``fp`` within ``threshold`` bits."""
    spark = prints.sparkSession
    tasks, count = int(spark.conf.get("spark.sql.shuffle.partitions")), prints.count()
    size = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * count).bit_length()))
    spread = prints.select("fp").repartition(max(tasks, -(-count // FINGERPRINTS_PER_TASK)), "fp")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column("fp")).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*places(home_anchor(fp), left_bits(fp), size)]))], ["bit"])

    # 16384 rows of 4 KB at most, whatever the input.
    bits = prints.select("fp").mapInArrow(homes, "bit long").groupBy(F.shiftright("bit", 15).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    occupied = np.zeros((1 << size) // 8, dtype=np.uint8)
    for r in bits.toLocalIterator():
        occupied[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = spark.sparkContext.broadcast(occupied)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for b in batches:
            fps = np.asarray(b.column("fp")).view(np.uint64)
            for s in range(0, len(fps), 1000):
                fp = fps[s : s + 1000]
                at, anchor, beyond = replicas(fp, threshold)
                keep = may_meet(filled, anchor, left_bits(fp)[at], beyond, threshold)
                at, anchor = at[keep], anchor[keep]
                home = np.concatenate([np.zeros(len(at), bool), np.ones(len(fp), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([anchor, home_anchor(fp)]).astype(np.int32)), pa.array(np.concatenate([fp[at], fp]).view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    rows = materialize(spread.mapInArrow(replicate, "anchor int, fp long, home boolean"), "replicas")
    sizes = rows.groupBy("anchor").agg(F.count_if("home").alias("h"), F.count("*").alias("n")).where("n > 2")
    # An anchor with one home and its own replica (n = 2) has nothing to compare.
    sized = rows.join(sizes, "anchor").withColumns({"H": F.ceil(F.col("h") / BLOCK).cast("int"), "R": F.ceil((F.col("n") - F.col("h")) / BLOCK).cast("int")})
    own = lambda n: F.array(F.pmod(F.xxhash64("fp"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)))
    dealt = sized.select("anchor", "fp", "home", F.explode(F.when(F.col("home"), own("H")).otherwise(every("H"))).alias("hb"), "R").select("anchor", "fp", "home", "hb", F.explode(F.when(F.col("home"), every("R")).otherwise(own("R"))).alias("rb"))
    sorted_rows = dealt.repartition(tasks, "anchor", "hb", "rb").sortWithinPartitions("anchor", "hb", "rb")
    links = materialize(sorted_rows.mapInArrow(_links(threshold), "a long, b long"), "links")
    discard(rows)
    return links


def fingerprint_classes(prints: DataFrame, id_col: str, threshold: int = THRESHOLD) -> DataFrame:
    """``fp, component, n`` for every distinct ``fp`` of ``prints``: the smallest ``id_col`` reachable, and the rows of ``fp``."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "prints")
    links = fingerprint_links(distinct, threshold)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    rooted = materialize(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("prints")), "least")
    out = materialize(join_hot(rooted, least, "root", "prints").select("fp", "component", "n"), "classes")
    for done in (distinct, links, rooted, least):
        discard(done)
    return out


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents")
    prints = materialize(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "fingerprints")
    found = join_hot(prints, fingerprint_classes(prints, "doc_id"), "fp", "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
