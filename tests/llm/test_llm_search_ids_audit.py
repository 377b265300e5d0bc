"""Operators 11 to 13 against brute force, over planted, odd and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import divergence, huffman, lexical

BENCH = "item_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, size=300):
    return " ".join(f"w{min(rng.randrange(size), rng.randrange(size))}" for _ in range(n))


# -- 11 -------------------------------------------------------------------------------------------


def ranked(docs, items, k=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: Counter(term.findall((t or "").translate(LOW)))
    texts = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in texts:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in split(text).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_is_exhaustive_scoring(folder, spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(lexical, "PROBE", 5)  # so that the first descent proves little
    monkeypatch.setattr(lexical, "PROBE_DOCUMENTS", 3)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 400)
    docs = [(i, prose(rng, rng.choice([1, 5, 40, 200]))) for i in range(250)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(3, docs[9][1]), (None, docs[9][1]), (None, "w1 W2"), (500, None), (501, " . ")]
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 3, 12, 40])] + [(7, docs[7][1]), (8, None), (9, "absent"), (None, "W1 w1 w299"), (7, "w5")]
    d = folder(docs, benchmark=(items, BENCH))
    got = sorted((tuple(r) for r in lexical.op11_impact_search(spark, d).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranked(docs, items)


def test_search_in_blocks_of_items(folder, spark):
    rng = random.Random(5)
    docs, items = [(i, prose(rng, 30)) for i in range(60)], [(i, prose(rng, 6)) for i in range(5)]
    d = folder(docs, benchmark=(items, BENCH))
    got = lexical.ranked_search(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"), k=4, block_bytes=20)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 4)


def test_search_over_odd_rows(folder, spark, odd):
    items = [(1, "one two x line"), (2, "word"), (3, "é नमस्ते")]
    d = folder(odd, benchmark=(items, BENCH))
    got = sorted((tuple(r) for r in lexical.op11_impact_search(spark, d).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranked(odd, items)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_BYTES", 10)
    text = "Alpha beta-GAMMA é1 delta " * 50 + "x" * 100
    pieces = list(lexical.term_pieces(text.encode()))
    assert len(pieces) > 20 and [w.decode() for p in pieces for w in p] == re.findall(r"[0-9a-zé]+", text.lower())


# -- 12 -------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=60), st.integers(6, 12))
def test_codes_are_prefix_free_limited_and_as_short_as_the_limit_allows(counts, most):
    code = huffman.Code.of_counts(np.arange(len(counts)), np.array(counts), most)
    by_id = dict(zip(code.ids.tolist(), zip(code.lengths.tolist(), code.codes.tolist(), strict=True), strict=True))
    assert sorted(by_id) == list(range(len(counts))) and max(n for n, _ in by_id.values()) <= most
    bits = sorted(f"{c:0{n}b}" for n, c in by_id.values())
    assert all(not b.startswith(a) for a, b in zip(bits, bits[1:], strict=False))
    if len(counts) > 1:
        assert sum(2.0**-n for n, _ in by_id.values()) == 1
        # Without a limit that binds, plain Huffman coding is the measure.
        import heapq

        heap, cost = sorted(counts), 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        ours = sum(n * counts[i] for i, (n, _) in by_id.items())
        assert ours >= cost
        if most >= len(counts) - 1:
            assert ours == cost


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=50), min_size=1, max_size=8), st.integers(1, 9))
def test_files_give_back_what_was_written(docs, block):
    was, huffman.BLOCK_IDS = huffman.BLOCK_IDS, block
    try:
        counts = np.bincount([i for d in docs for i in d])
        ids = np.flatnonzero(counts)
        code = huffman.Code.of_counts(ids, counts[ids])
        assert huffman.Code.from_bytes(code.to_bytes()).codes.tolist() == code.codes.tolist()
        encode = code.encoder()
        rows = [(None if k % 3 == 2 else k, len(d), *encode(np.array(d))) for k, d in enumerate(docs)]
        data = huffman.file_bytes([(i, n, bits, points.astype("<i8").tobytes()) for i, n, bits, points in rows])
        got = list(huffman.file_documents(data, code))
        assert [(i, x.tolist()) for i, x in got] == [(r[0], d) for r, d in zip(rows, docs, strict=True)]
        with pytest.raises(ValueError):
            list(huffman.file_documents(data[:-1] if rows[-1][2] else data + b"x", code))
    finally:
        huffman.BLOCK_IDS = was


def expected_ids(docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(huffman.tokenizer_path()).encode
    return [(i, [*encode(t or "", add_special_tokens=False).ids, 2]) for i, t in docs]


def test_ids_are_the_librarys(folder, spark, odd):
    hard = ["don't  stop\n\n  now 12345 a1b2 ÀÉ×÷ ", "<|endoftext|> in a text", "tabs\t\tand\r\nlines   ", "‘quotes’ — and नमस्ते ½", "a " * 30000 + "😀 tail", "x" * 40000]
    docs = odd + [(100 + i, t) for i, t in enumerate(hard)] + [(50, "late"), (50, "late"), (50, "early")]
    got = huffman.op12_huffman_ids(spark, folder(docs)).collect()
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in expected_ids(docs))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_files_roll_and_keep_the_order(folder, spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.choice([1, 30, 3000]))) for i in rng.sample(range(10**6), 120)]
    d, out = folder(docs), f"{tmp_path}/ids"
    ids = huffman.materialize(huffman.token_ids(spark.read.parquet(f"{d}/documents.parquet")), "ids")
    manifest = huffman.write_ids(ids, out, roll_bytes=2000)
    assert manifest.count() > 20 and manifest.groupBy("part").count().agg({"count": "max"}).first()[0] > 1
    got = huffman.read_ids(manifest, out).orderBy("start").collect()
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == sorted(expected_ids(docs))


# -- 13 -------------------------------------------------------------------------------------------


def audited(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, df = defaultdict(Counter), Counter()
    for text, lang, source in rows:
        words = term.findall((text or "").translate(LOW))
        counts[lang or "", source or ""].update(words)
        df.update({(lang or "", w) for w in words})
    share = lambda n, total, v: 1 + 1000000000 * (n + 1) // (total + v)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [w for (x, w), n in df.items() if x == lang and n >= 3]
        sources = [g[1] for g in counts if g[0] == lang]
        total = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        p = {s: {w: share(counts[lang, s][w], total[s], len(kept)) for w in kept} for s in sources}
        q = {w: share(sum(counts[lang, s][w] for s in sources), sum(total.values()), len(kept)) for w in kept}
        for s in sources:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w, -v, r) for r, (v, _, w) in enumerate(sorted(terms)[:200], 1)]
    return sorted(out)


def write_sources(spark, rows, path):
    schema = "text string, lang string, source string, term string, n long, salt int"
    spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_audit_is_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(prose(rng, 60, 400).replace("w", rng.choice(["w", "W", "é", "É"])).translate(str.maketrans("0123456789", "abcdefghij")), rng.choice(["en", "de"]), rng.choice("abcde")) for _ in range(120)]
    rows += [("Same word", "fr", "a"), ("other", "fr", "b"), (None, "en", "empty"), ("", None, None), ("x y", None, "z"), (rows[0][0],) * 1 + rows[0][1:], rows[0]]
    rows += [("one one", "es", "only")] * 3 + [("rare", "it", "a"), ("words", "it", "b"), (None, None, "z")]
    got = divergence.op13_source_divergence(spark, write_sources(spark, rows, tmp_path))
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == audited(rows)


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame(pa.table({"n": pa.array([5 * 10**13, 0]), "t": pa.array([10**15, 10**15]), "v": pa.array([10**6, 10**6])}))
    got = [r[0] for r in df.select(divergence.share(df.n, df.t, df.v)).collect()]
    assert got == [1 + 10**9 * (n + 1) // (10**15 + 10**6) for n in (5 * 10**13, 0)]


def test_texts_of_several_megabytes(spark, folder):
    rng = random.Random(6)
    docs = [(1, prose(rng, 600_000, 3000)), (2, "short w1 w2"), (3, None)]
    items = [(1, "w1 w2 w2999"), (2, "short")]
    d = folder(docs, benchmark=(items, BENCH))
    got = sorted((tuple(r) for r in lexical.op11_impact_search(spark, d).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranked(docs, items)
    ids = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in huffman.op12_huffman_ids(spark, d).collect()}
    assert ids == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in expected_ids(docs)}
    got = divergence.audit(spark.read.parquet(f"{d}/documents.parquet"), least_documents=1).select("lang", "source", "part", "item", "value", "rank")
    assert got.count() == 0  # one source: nothing to compare with, and no share above the language's
