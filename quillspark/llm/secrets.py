"""Secret scan by token efficiency.

A random string has no long pieces in a byte-pair vocabulary, so it costs many tokens for its
length.  Strings of the secret alphabet whose characters-per-token ratio is low are reported, after
digests of known lengths and ordinary identifiers are excluded; of a string that a base span covers in
part, what is left is measured.  Three base rules (assignments,
access ids, hexadecimal runs) report beside them and are never withdrawn.

Edge cases: a null text is scanned as an empty one; a null ``doc_id`` is kept; repeated rows each
give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

#: Kinds in the order in which ties at one start are listed.
KINDS = ("assign", "access", "hex", "random")

# The base rules.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18

#: Candidates for the token-efficiency test.
CANDIDATE_MIN, WORD_MAX = 12, 24
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_MIN)
#: Hexadecimal digests of usual widths (128 to 512 bits) and UUIDs are known digests, not secrets.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})")
#: One part of an identifier: a word, an acronym, a short number, or camel case.
PART = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,6}|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[0-9]{0,4}")
SEPARATORS = re.compile(r"[+/_=-]+")

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
DEFAULT_RATIO = 2.3
DOC_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def ranks_path(name: str = DEFAULT_RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tiktoken encoding of a rank file, once per worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    """Parts joined by separators, none longer than a word (``WORD_MAX``), or one long number."""
    return run.isdigit() or all(len(x) < WORD_MAX and PART.fullmatch(x) for x in SEPARATORS.split(run))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the three base rules, in code points."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def outside(s: int, e: int, taken: list[tuple[int, int, str]], at: int) -> tuple[list[tuple[int, int]], int]:
    """What of ``s`` to ``e`` the spans of ``taken`` (in order of starts, from number ``at`` on) leave, and the number to go on from."""
    left = []
    while at < len(taken) and taken[at][1] <= s:
        at += 1
    for a, b, _ in taken[at:]:
        if a >= e:
            break
        if a > s:
            left.append((s, a))
        s = max(s, b)
    if s < e:
        left.append((s, e))
    return left, at


def random_spans(text: str, taken: list[tuple[int, int, str]], path: str, ratio: float) -> list[tuple[int, int, str]]:
    """Candidates, or what ``taken`` leaves of them, that cost more than one token per ``ratio`` characters."""
    out, at = [], 0
    # Spans inside others would hide later ends from the sweep.
    cover: list[tuple[int, int, str]] = []
    for x in sorted(taken):
        if not cover or x[1] > cover[-1][1]:
            cover.append(x)
    for m in CANDIDATE.finditer(text):
        left, at = outside(*m.span(), cover, at)
        for s, e in left:
            run = text[s:e]
            if e - s < CANDIDATE_MIN or DIGEST.fullmatch(run) or is_identifier(run):
                continue
            if e - s < ratio * len(encoder(path).encode_ordinary(run)):
                out.append((s, e, "random"))
    return out


def scan(text: str, path: str, ratio: float = DEFAULT_RATIO) -> tuple[list, list]:
    """The base spans and all spans of a text, each by start, then kind as listed."""
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + random_spans(text, base, path, ratio), key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ratio: float = DEFAULT_RATIO) -> DataFrame:
    """Per row: id, the text's base and all spans as arrays of ``kind, start, end``."""
    path = tokenizer or ranks_path()
    span = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t, path, ratio) for t in b.column("text").to_pylist()]
            dicts = lambda xs: [{"kind": k, "start": s, "end": e} for s, e, k in xs]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([dicts(x) for x, _ in found], kind), pa.array([dicts(x) for _, x in found], kind)], ["id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"id long, base {span}, spans {span}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, tokenizer: str | None = None, ratio: float = DEFAULT_RATIO, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` in ``text`` and ``n_chars`` counted anew; other columns stay.

    Overlapping spans become one mask.  A null text stays null.
    """
    path = tokenizer or ranks_path()

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for s, e, _ in scan(text, path, ratio)[1]:
            if s >= at:
                parts += [text[at:s], mask]
            at = max(at, e)
        return "".join([*parts, text[at:]]) if parts else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [clean(t) for t in b.column("text").to_pylist()]
            cols = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[n].cast(b.schema.field(n).type) if n in cols else b.column(n) for n in b.schema.names], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules, their digest and all spans of every document."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    text = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), count("random").alias("n_random"))
