"""Each operator against a brute-force version, over odd rows and empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import decontaminate, minhash, packing, paragraphs, pii, quality, secrets, simhash, substrings, warc
from quillspark.llm.catalog import QUERIES

LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"
PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(folder, spark, name):
    d = folder([], labels=([], LABELS), benchmark=([], BENCH), pages=([], PAGES))
    assert QUERIES[name](spark, d).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_paragraph_minhash", "op2_warc_roundtrip", "op8_decontaminate", "op9_best_fit_packing", "op11_impact_search", "op13_source_divergence"}))
def test_odd_rows_all_come_back(folder, spark, odd, name):
    d = folder(odd, labels=([(3, 1, 0), (3, 0, 0), (4, None, None), (99, 1, 1)], LABELS), benchmark=([(1, None), (2, "")], BENCH))
    got = Counter(r["doc_id"] for r in QUERIES[name](spark, d).collect())
    assert got == Counter(i for i, _ in odd)


def words(rng, n, known=None):
    return " ".join(rng.choice(known or ["alder", "birch", "cedar", "date", "elm", "fir", "gum", "hazel", "ivy", "juniper"]) for _ in range(n))


# -- 1 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [38, 51, 120])
def test_common_passages_are_found_wherever_they_stand(folder, spark, n):
    rng = random.Random(n)
    vocabulary = [f"w{rng.getrandbits(40):x}" for _ in range(5000)]
    passage = words(rng, n, vocabulary)
    docs = [(i, words(rng, 80, vocabulary)) for i in range(8)]
    docs += [(100 + i, f"{words(rng, 7 + i, vocabulary)} {passage} {words(rng, 9, vocabulary)}") for i in range(3)]
    got = paragraphs.op1_paragraph_minhash(spark, folder(docs)).collect()
    assert {r["doc_id"] for r in got} == {100, 101, 102}
    assert {r["keep_doc_id"] for r in got} == {100} and {r["doc_id"] for r in got if not r["removed"]} == {100}
    for r in got:  # one stretch, less than a window short at either end
        first = 7 + r["doc_id"] - 100
        (s, e), = [tuple(map(int, x.split(":"))) for x in r["word_spans"].split(",")]
        assert first <= s < first + paragraphs.ANCHOR_WINDOW and first + n - paragraphs.ANCHOR_WINDOW < e <= first + n


def test_edited_lines_are_one_class(folder, spark):
    rng = random.Random(3)
    vocabulary = [f"w{rng.getrandbits(40):x}" for _ in range(5000)]
    line = words(rng, 60, vocabulary).split()
    edited = line[:30] + ["changed"] + line[31:]
    docs = [(1, " ".join(line)), (2, "first\n" + " ".join(edited)), (3, words(rng, 60, vocabulary))]
    d = folder(docs)
    got = paragraphs.repeated_units(spark.read.parquet(f"{d}/documents.parquet")).where("n_words = 60").collect()
    assert {r["doc_id"] for r in got} == {1, 2} and len({r["component_id"] for r in got}) == 1
    spans = {(r["doc_id"], r["removed"]): r["word_spans"] for r in paragraphs.op1_paragraph_minhash(spark, d).collect()}
    assert spans == {(1, False): "0:60", (2, True): "1:61"}


def test_links_in_blocks_join_what_all_pairs_join():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 20)) for _ in range(60)]
    got = paragraphs.near_links(sets, list(range(60)), list(range(60)), list(range(60)), 0.5)

    def roots(links):
        p = list(range(60))
        for a, b in links * 60:
            p[a] = p[b] = min(p[a], p[b])
        return p

    every = [(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))]
    assert roots(got) == roots(every) and len(got) < 60


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_nearly_all_like_lines_are_in_one_class(folder, spark):
    rng = random.Random(23)
    vocabulary = [f"w{rng.getrandbits(40):x}" for _ in range(5000)]
    lines = []
    for _ in range(150):
        line = words(rng, rng.randint(5, 90), vocabulary).split()
        lines.append(" ".join(line))
        for _ in range(2):
            copy = list(line)
            for _ in range(rng.randint(0, 1 + len(line) // 60)):
                copy[rng.choice([0, -1, rng.randrange(len(copy))])] = rng.choice(vocabulary)
            lines.append(" ".join(copy))
    docs = [(i, f"{words(rng, 3, vocabulary)}\n{x}\n{words(rng, 4, vocabulary)}") for i, x in enumerate(lines)]
    d = folder(docs)
    got = paragraphs.repeated_units(spark.read.parquet(f"{d}/documents.parquet")).where("start_word = 3").collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["component_id"])
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if i // 3 == j // 3 and jaccard(lines[i], lines[j]) >= 0.8]
    equal = [(i, j) for i, j in pairs if jaccard(lines[i], lines[j]) == 1]
    joined = lambda i, j: bool(of.get(i, set()) & of.get(j, set()))
    assert all(joined(i, j) for i, j in equal) and len(pairs) - len(equal) > 150
    assert sum(joined(i, j) for i, j in pairs) >= 0.97 * len(pairs)
    # Lines of one class are like each other, or like others that are: none of different origin here.
    for i in of:
        for j in of:
            assert not joined(i, j) or i // 3 == j // 3


def test_repeats_inside_one_document_and_odd_rows(folder, spark, odd):
    rows = [*odd, (70, "one line of six plain words\nother\none line of six plain words"), (71, "x " * 3)]
    got = {(r["doc_id"], r["removed"]): r["word_spans"] for r in paragraphs.op1_paragraph_minhash(spark, folder(rows)).collect()}
    assert got[70, False] == "0:6" and got[70, True] == "7:13"
    assert got[6, False] == "0:10" and got[7, True] == "0:10"
    assert {i for i, _ in got} == {6, 7, 9, 70}


# -- 2 --------------------------------------------------------------------------------------------


def test_archives_say_what_was_written(folder, spark):
    pages = [(5, "http://a/é", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "u", None), (7, "v", ""), (1, "w", "é" * 1000), (3, None, "<p>same</p>"), (None, "n", "x"), (None, None, "<p>same</p>")]
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.op2_warc_roundtrip(spark, folder(pages=(pages, PAGES))).collect())
    least: dict = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = least.get(h or "")
        again = first is not None and i != first and sum((x or "") == (h or "") for _, _, x in pages) > 1
        want.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=lambda x: x)


def test_reader_refuses_what_is_damaged():
    raw = zlib.decompress(warc.record(1, "u", b"payload", None), 31)
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n", b"paYload\r\n"))
    with pytest.raises(warc.Truncated):
        warc.parse(raw[:-6])


# -- 3 --------------------------------------------------------------------------------------------


def test_base_rules_and_random_strings():
    path = secrets.ranks_path()
    text = "Api_Key: 'abcdefghijkl' AKIAABCDEFGHIJKLMN deadbeefdeadbeef x Zq8vK2mN4pX7wR1tY6uB3cJ9 some_long_identifier_name_here " + "a" * 40
    base, spans = secrets.scan(text, path)
    assert [k for _, _, k in base] == ["assign", "access", "hex", "hex"]
    assert [text[s:e] for s, e, k in spans if k == "random"] == ["Zq8vK2mN4pX7wR1tY6uB3cJ9"]
    assert set(base) <= set(spans)


def test_columns_are_those_of_the_plain_rules(folder, spark):
    import tiktoken  # noqa: F401 (the scan needs it)

    rng = random.Random(31)
    parts = ["password", "Token", "api_key", "apikey", " = ", ": '", '"', "=", " ", "\n", "AKIA", "ABCDEFGH12345678", "deadbeef0123", "0123456789abcdef", "Zq8vK2mN4pX7wR1t", "plain words", "é𝒳", "some_name", "x" * 30, "qzjxkvbwpmtgfhrnqzjxkvbw"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = {r["doc_id"]: r for r in secrets.op3_secret_scan(spark, folder(list(enumerate(texts)))).collect()}
    rules = {"assign": r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    encode = secrets.encoder(secrets.ranks_path()).encode_ordinary
    for i, t in enumerate(texts):
        base = [(m.start(), list(rules).index(k), m.end(), k) for k, p in rules.items() for m in re.finditer(p, t, re.I | re.A if k == "assign" else 0) if {"assign": k == "assign" and len(m[2]) >= 12, "access": len(m[0]) >= 18, "hex": len(m[0]) >= 16}[k]]
        assert [got[i][f"n_{k}"] for k in rules] == [sum(x[3] == k for x in base) for k in rules]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(base)).encode()).hexdigest()
        free = [not any(s <= k < e for s, _, e, _ in base) for k in range(len(t))]
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", t):
            for run in re.finditer("1+", "".join("01"[free[k]] for k in range(*m.span()))):
                s, e = m.start() + run.start(), m.start() + run.end()
                if e - s >= 12 and not secrets.DIGEST.fullmatch(t[s:e]) and not secrets.is_identifier(t[s:e]) and e - s < 2.3 * len(encode(t[s:e])):
                    more.append((s, 3, e, "random"))
        assert got[i]["spans"] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(base + more))


def test_what_is_left_beside_a_base_span_is_measured():
    path = secrets.ranks_path()
    text = "deadbeefdeadbeefZq8vK2mN4pX7wR1tY6 qzjxkvbwpmtgfhrnqzjxkvbw"
    assert [text[s:e] for s, e, k in secrets.scan(text, path)[1] if k == "random"] == ["Zq8vK2mN4pX7wR1tY6", "qzjxkvbwpmtgfhrnqzjxkvbw"]


def test_kelvin_sign_is_no_letter_of_a_rule():
    assert secrets.base_spans("toKen = abcdefghijklmnop") == []


# -- 4 --------------------------------------------------------------------------------------------


def test_quality_of_held_out_rows(folder, spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        t = words(rng, rng.randint(5, 120))
        docs.append((i, t if good else t.upper() + "!!"))
        labels.append((i, int(good), 0))
    got = quality.op4_quality_rules(spark, folder(docs, labels=(labels, LABELS))).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_compiled_score_is_the_fitted_one(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] < 0.6)).astype(float)
    model = quality.fit_rules(x, y)
    raw = np.full(len(x), model.intercept)
    for rule in model.rules:
        raw += rule.weight * np.logical_and.reduce([(x[:, f] <= t) == below for f, below, t in rule.terms])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *(f"q_{n}" for n in quality.FEATURES)])
    got = [r["s"] for r in df.select("i", model.score().alias("s")).orderBy("i").collect()]
    assert len(model.rules) > 1 and np.allclose(got, 1 / (1 + np.exp(-raw)))
    assert ((np.array(got) > 0.5) == (y > 0)).mean() > 0.95


def test_repeated_ids_are_learnt_from_once(spark):
    docs = spark.createDataFrame([(i % 7, "word " * (i % 5)) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)], LABELS)
    seen = []
    keep, quality.fit_rules = quality.fit_rules, lambda x, y: seen.append((len(x), len(y)))
    try:
        quality.fit_quality(docs, labels)
    finally:
        quality.fit_rules = keep
    assert seen == [(sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(7)),) * 2]


# -- 5 --------------------------------------------------------------------------------------------


def test_fingerprints_and_components(folder, spark):
    import xxhash

    rng = random.Random(5)
    base = [words(rng, 200) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace("elm", "oak", 1)) for i, t in enumerate(base)] + [(300, None), (301, " "), (50, base[0])]
    got = simhash.op5_simhash_anchors(spark, folder(docs)).collect()
    fp = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        fp[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == fp
    root = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"]: r["component_id"] for r in got} == root


def test_every_near_pair_shares_an_anchor():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in x], dtype=np.uint64)
    home = simhash.home_anchor(x)
    at, anchor, _ = simhash.replicas(x ^ flips)
    near = defaultdict(set)
    for i, a in zip(at.tolist(), anchor.tolist(), strict=True):
        near[i].add(a)
    assert all(home[i] in near[i] for i in range(len(x)))


# -- 6 --------------------------------------------------------------------------------------------


def test_likeness_follows_the_jaccard_index(folder, spark):
    rng = random.Random(7)
    vocabulary = [f"w{rng.getrandbits(30):x}" for _ in range(3000)]
    docs = [(i, words(rng, rng.randint(1, 300), vocabulary)) for i in range(40)] + [(40, None), (41, "")]
    got = {r["doc_id"]: r for r in minhash.op6_one_permutation_minhash(spark, folder(docs)).collect()}
    text = {i: t or "" for i, t in docs}
    order = sorted(text, reverse=True)
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    for k, i in enumerate(order):
        t, nxt = text[i], text[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b = shingles(t), shingles(edited)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i]["near_edited"] - len(a & b) / len(a | b)) < 0.2
    assert got[40]["fingerprint"] == got[41]["fingerprint"]


# -- 7 --------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum((c if k % 2 == 0 else 2 * c - 9 * (c > 4)) for k, c in enumerate(map(int, reversed(d)))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_base_spans_are_those_of_the_plain_patterns(folder, spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("0123456789+-. ()@a.éb𝒳") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += ["a@b.com@d.org x@y.z_foo@bar.com", "4111 1111 1111 1111 and +1 (136) 555-7479", "1.2.3.4.5.6.7.8 256.1.1.1"]
    got = {r["doc_id"]: r for r in pii.op7_pii_weak(spark, folder(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if valid(k, m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert set(spans) <= set(got[i]["spans"].split(",")) | {""}


def test_long_runs_of_any_pattern(folder, spark):
    n = 100_000
    texts = ["a@b" + ".c" * n, "a" * n + "@", "@" * n, "1." * n, "1" * n, "1 " * n, "4-" * n, "+1" + "(" * n, "+" * n, "+1" * n, "123-" * n, "(123) " * n, "1.2.3.4 " * 2000]
    got = {r["doc_id"]: r for r in pii.op7_pii_weak(spark, folder(list(enumerate(texts)))).collect()}
    assert got[0]["n_email"] == 1 and got[0]["spans"] == f"email:0:{3 + 2 * n}"
    assert got[12]["n_ip"] == 2000


def test_further_kinds_follow_their_context(folder, spark):
    texts = [f"call ({200 + i}) 555-{1000 + i} now" for i in range(60)] + [f"phone: {300 + i}-555-{2000 + i}." for i in range(60)] + [f"order {100 + i % 80} 1{i % 90:02d} {3000 + i}x" for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii.op7_pii_weak(spark, folder(list(enumerate(texts)))).collect()}
    assert sum("local:" in got[i] for i in range(120)) >= 114
    assert not any("local:" in got[i] for i in range(120, 180))


def test_estimate_trusts_labelers_that_agree():
    rows = [("local", (1, 0, 1, 1, 0), 90), ("local", (-1, 0, 0, -1, 0), 60), ("local", (1, 0, -1, 1, 0), 3)]
    trust, post = pii.estimate(rows)
    assert trust[0] > 0.9 and post[0] > 0.9 and post[1] < 0.1


# -- 8 --------------------------------------------------------------------------------------------


def test_copied_and_edited_items_are_found_and_others_left(folder, spark):
    rng = random.Random(9)
    vocabulary = [f"w{rng.getrandbits(30):x}" for _ in range(3000)]
    items = [(i, words(rng, 40, vocabulary)) for i in range(20)] + [(50, "short item"), (51, None), (52, "")]
    edited = items[3][1].split()
    for k in range(4, 40, 8):
        edited[k] = "changed"
    docs = [(0, words(rng, 300, vocabulary)), (1, f"{words(rng, 50, vocabulary)} {items[2][1].upper()}, {words(rng, 50, vocabulary)}"), (2, f"x {' '.join(edited)} y"), (3, "a short item here"), (None, items[5][1])]
    d = folder(docs, benchmark=(items, BENCH))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op8_decontaminate(spark, d).collect()}
    assert got == {(1, 2), (2, 3), (3, 50), (None, 5)}


def test_whatever_aligns_by_half_is_seeded(folder, spark):
    rng = random.Random(15)
    vocabulary = [f"w{rng.getrandbits(30):x}" for _ in range(3000)]
    items = [(i, words(rng, 16 + 2 * i, vocabulary)) for i in range(20)]
    docs = []
    for i, text in items:
        for every in (3, 4, 5, 6):
            for first in range(every):
                w = text.split()
                for k in range(first, len(w), every):
                    w[k] = "changed"
                docs.append((len(docs), f"{words(rng, 20, vocabulary)} {' '.join(w)} {words(rng, 20, vocabulary)}"))
        docs.append((len(docs), " inserted ".join(text.split())))
        w = text.split()
        docs.append((len(docs), " ".join(w[: len(w) // 2] + ["inserted"] * (len(w) // 2) + w[len(w) // 2 :])))
        for share in (0.2, 0.35, 0.5):
            docs.append((len(docs), " ".join(rng.choice([x, "", f"{x} more", "other"]) if rng.random() < share else x for x in w)))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.op8_decontaminate(spark, folder(docs, benchmark=(items, BENCH))).collect()}
    known: dict = {}
    number = lambda t: np.array([known.setdefault(w, len(known) + 1) for w in t.split()])
    want = {}
    for i, text in docs:
        for j, item in items:
            score = decontaminate.align(number(item), number(text))[0] / (2 * len(item.split()))
            if score >= 0.5:
                want[i, j] = score
    assert {k: r["score"] for k, r in got.items()} == want and len(want) > 300
    text = dict(docs)
    for (i, j), r in got.items():
        passage = " ".join(text[i].split()[r["first_word"] : r["first_word"] + r["n_words"]])
        item = dict(items)[j]
        assert decontaminate.align(number(item), number(passage))[0] / (2 * len(item.split())) == r["score"]


def test_alignment_is_that_of_the_plain_recurrence():
    rng = random.Random(10)
    for _ in range(50):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, h))


# -- 9 --------------------------------------------------------------------------------------------


def test_sequences_hold_every_piece_once(folder, spark, odd):
    got = packing.op9_best_fit_packing(spark, folder(odd)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, text in odd:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], dtype="<u4").tobytes()
            want[(i, k // 4096, k, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 4096


def test_rounds_up_the_tree_fill_the_sequences(spark):
    rng = random.Random(11)
    rows = [(i, 0, 0, rng.randint(1, 1500), i) for i in range(6000)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), items_per_task=200)
    assert got.count() == 6000
    least = -(-sum(r[3] for r in rows) // 4096)
    assert got.select("sequence_id").distinct().count() <= 1.01 * least + 1


def test_bins_that_cannot_merge_end_the_tree(spark):
    rows = [(i, 0, 0, 2500, i) for i in range(3000)] + [(9000 + i, 0, 0, 1, i) for i in range(5)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), items_per_task=100)
    assert got.count() == 3005 and got.select("sequence_id").distinct().count() == 3000


def test_other_vocabularies_are_encoded_whole():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a b": 5, "[U]": 0, "a": 1, "b": 2}, "[U]"))
    t.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        f.write(t.to_str())
        f.flush()
        assert packing.WordIds(f.name)("a b,a") == np.array([5, 1], "<u4").tobytes()


# -- 10 -------------------------------------------------------------------------------------------


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[k : k + 200] for r in raw for k in range(len(r) - 199))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if n[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_repeated_bytes_go(folder, spark, hot):
    rng = random.Random(12)
    common = words(rng, 60)
    texts = [words(rng, 90, [f"w{rng.getrandbits(30):x}" for _ in range(500)]) for _ in range(12)]
    texts = [f"{t[:150]}{common[: 190 + 7 * i]}{t[150:]}" for i, t in enumerate(texts)] + [common, common, "é" * 300, "ab" * 400, None, "", "é" * 99]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substrings.without_ranges(docs, substrings.repeated_ranges(docs, hot=hot)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts)


def test_suffixes_are_in_order():
    rng = random.Random(13)
    for k in range(40):
        n = rng.randint(1, 200)
        t = np.array([rng.randint(0, 3) for _ in range(n - 1)] + [0]) if k % 3 else np.array(([1, 2, 1, 1] * n)[: n - 1] + [0])
        assert substrings.two_stage_suffix_array(t, n + 6).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_long_texts_are_cut_without_losing_strings():
    data = bytes(random.Random(14).randrange(256) for _ in range(5000))
    parts = substrings.pieces(data, 700)
    starts = [at + k for at, p in parts for k in range(len(p) - 199)]
    assert sorted(starts) == list(range(4801)) and all(data[at : at + len(p)] == p for at, p in parts)
