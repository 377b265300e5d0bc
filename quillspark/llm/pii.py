"""Personal data by weak supervision, with DataFrame expressions only.

Candidate spans come from regular expressions.  Labelers vote on each (for, against, abstain): its
pattern, a gazetteer of endings, prefixes and ranges, words in front of it, its edges, and whether
it looks made up.  Expectation-maximisation over the table of vote patterns, which has a bounded
number of rows whatever the input, estimates how reliable each labeler is and the posterior of each
pattern; a logistic span classifier is trained on those posteriors, from the votes and from features of
the span and its neighbours that no labeler sees, and compiled into an expression.
Spans of the four base kinds always stay; the classifier decides on the two further kinds.

Offsets are worked out from the pieces between matches, in code points.  The patterns are written so
that a search begins only where a run begins, which keeps them linear in long runs; groups that
repeat without bound are possessive, for Java's matcher recurses in others.

Edge cases: a null text is an empty one; a null ``doc_id`` is kept; repeated rows each give a row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

BASE = ("email", "ip", "card", "phone")
FURTHER = ("local", "national")

# What the contract calls the base patterns, with starts restricted to where a
# leftmost, non-overlapping search would begin a match anyway.
LOCAL_PART = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL_PART})|\G){LOCAL_PART}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local": r"(?<![0-9+])(?<![0-9][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this cannot match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "local": None, "national": "-"}

PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
DIGITS = "regexp_replace(m, '[^0-9]', '')"
LUHN = f"""aggregate(sequence(1, char_length({DIGITS})), 0, (s, i) -> s + case
    when i % 2 = 1 then int(substr(reverse({DIGITS}), i, 1))
    when int(substr(reverse({DIGITS}), i, 1)) > 4 then 2 * int(substr(reverse({DIGITS}), i, 1)) - 9
    else 2 * int(substr(reverse({DIGITS}), i, 1)) end) % 10 = 0"""
CHECKS = {
    "email": "true",
    "ip": rf"m rlike '^{PART}(?:\\.{PART}){{3}}$'",
    "card": LUHN,
    "phone": f"char_length({DIGITS}) between 9 and 15",
    "local": "true",
    "national": "true",
}

# Gazetteers and context words.
ENDINGS = "com|org|net|edu|gov|info|biz|io|de|fr|es|it|nl|uk|eu|us|ca|au|jp|cn|in|br|ru|pl|ch|at|be|se|no|dk|fi"
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[0-9]|37[0-9]|38[0-9]|42[013]|97[0-9]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38"
RESERVED = r"0*(?:0|10|127|22[4-9]|2[34][0-9]|25[0-5])\\.|192\\.168\\.|169\\.254\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\."
FOR = "call|phone|tel|telephone|mobile|fax|contact|mail|email|e-mail|write|card|visa|mastercard|ip|address|host|ssn|social security|appelez|telefon|telefono"
AGAINST = "version|isbn|issn|order|part|serial|ticket|invoice|model|build|page|no\\\\.|nr\\\\."

#: Each labeler's vote (1, -1, 0) on a candidate x, in SQL.
LABELERS = {
    "pattern": r"""case when x.kind in ('email','ip','card','phone') then 1
        when x.kind = 'local' then if(regexp_replace(x.m, '[^0-9]', '') rlike '^[2-9][0-9]{2}[2-9]', 1, -1)
        else if(x.m rlike '^(?:000|666|9)|-00-|-0000$', -1, 1) end""",
    "gazetteer": rf"""case x.kind when 'email' then if(lower(x.m) rlike '\\.(?:{ENDINGS})$', 1, -1)
        when 'ip' then if(x.m rlike '^(?:{RESERVED})', -1, 1)
        when 'card' then if(x.m rlike '^(?:{ISSUERS})', 1, -1)
        when 'phone' then if(x.m rlike '^\\+(?:{COUNTRY_CODES})', 1, -1) else 0 end""",
    "context": rf"""case when lower(x.before) rlike '(?:^|[^a-z])(?:{FOR})[^a-z0-9]{{0,6}}$' then 1
        when lower(x.before) rlike '(?:^|[^a-z])(?:{AGAINST})[^a-z0-9]{{0,6}}$' then -1 else 0 end""",
    "edges": r"if(x.before rlike '[A-Za-z0-9]$' or x.after rlike '^[A-Za-z0-9]', -1, 1)",
    "made_up": r"if(regexp_replace(x.m, '[^0-9]', '') rlike '^([0-9])\\1+$|^0?123456789', -1, 0)",
}

#: What else the classifier sees of a candidate x, each true or false: its shape and its neighbours.
FEATURES = {
    "separated": r"x.m rlike '[\\x20().-]'",
    "long": "char_length(x.m) > 14",
    "mixed": r"x.m rlike '[A-Za-z]' and x.m rlike '[0-9]'",
    "labelled": r"x.before rlike '[:=][\\x20]?$'",
    "bracketed": r"x.before rlike '[(<\\[]$'",
    "line_start": r"x.before rlike '(?:^|\\n)$'",
    "word_before": r"x.before rlike '[A-Za-z][\\x20]$'",
    "clause_end": r"x.after rlike '^[.,;!?]?$'",
}


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: str) -> str:
    """SQL for the array of ``kind, start, end, m, before, after`` of one kind over ``text``."""
    p = _literal(PATTERNS[kind])
    need = f"contains(text, '{NEEDS[kind]}')" if NEEDS[kind] else "text rlike '[0-9]{2}'"
    none = "cast(array() as array<struct<kind:string,start:int,end:int,m:string,before:string,after:string>>)"
    length = "(s, v) -> s + char_length(v)"
    start = f"aggregate(slice(gaps, 1, i + 1), 0, {length}) + aggregate(slice(ms, 1, i), 0, {length})"
    at = f"transform(ms, (m, i) -> struct(m, {start} as s))"
    full = f"transform(filter({at}, c -> exists(array(c.m), m -> {CHECKS[kind]})), c -> struct('{kind}' as kind, c.s as start, c.s + char_length(c.m) as end, c.m as m, substr(text, greatest(1, c.s - 23), least(24, c.s)) as before, substr(text, c.s + char_length(c.m) + 1, 1) as after))"
    # One-element arrays stand for local names.
    named = f"element_at(transform(array(struct(split(text, {p}, -1) as gaps, regexp_extract_all(text, {p}, 0) as ms)), g -> {full.replace('gaps', 'g.gaps').replace('(ms,', '(g.ms,')}), 1)"
    return f"case when {need} and text rlike {p} then {named} else {none} end"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, its ``base`` spans (kinds as listed, then by start) and ``further`` candidates outside them."""
    found = docs.select(F.col(id_col), whole_text(text_col).alias("text")).selectExpr(f"`{id_col}`", *(f"{_spans(k)} as `{k}`" for k in PATTERNS))
    base = f"concat({', '.join(f'`{k}`' for k in BASE)})"
    return found.selectExpr(f"`{id_col}`", f"{base} as base", f"filter(concat(local, national), x -> not exists({base}, b -> b.start < x.end and x.start < b.end)) as further")


def vote_table(found: DataFrame) -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
    """``(kind, votes, features, candidates)``: at most kinds times 3 to the number of labelers times 2 to that of features rows."""
    asked = [f"{v} as v_{k}" for k, v in LABELERS.items()] + [f"int({v}) as f_{k}" for k, v in FEATURES.items()]
    each = found.selectExpr("explode(concat(base, further)) as x").selectExpr("x.kind as kind", *asked)
    votes, features = [f"v_{k}" for k in LABELERS], [f"f_{k}" for k in FEATURES]
    rows = each.groupBy("kind", *votes, *features).agg(F.count("*").alias("n")).collect()
    return sorted((r["kind"], tuple(r[n] for n in votes), tuple(r[n] for n in features), r["n"]) for r in rows)


def by_votes(rows: list[tuple]) -> dict[tuple[str, tuple[int, ...]], int]:
    """Candidates of each kind and pattern of votes."""
    out: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, votes, _, n in rows:
        out[kind, votes] = out.get((kind, votes), 0) + n
    return out


def estimate(rows: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> tuple[list[float], list[float]]:
    """Labelers' reliabilities and each row's posterior, by expectation-maximisation."""
    trust = [0.8] * len(LABELERS)
    prior = {k: 0.7 for k, _, _ in rows}
    post = [0.5] * len(rows)
    for _ in range(rounds):
        for i, (kind, votes, _) in enumerate(rows):
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(v * math.log(t / (1 - t)) for v, t in zip(votes, trust, strict=True))
            post[i] = 1 / (1 + math.exp(-odds))
        for j in range(len(trust)):
            right = sum(n * (p if v[j] > 0 else 1 - p) for (_, v, n), p in zip(rows, post, strict=True) if v[j])
            cast = sum(n for _, v, n in rows if v[j])
            trust[j] = min(0.98, max(0.55, (right + 8) / (cast + 10)))
        for kind in prior:
            own = [(n, p) for (k, _, n), p in zip(rows, post, strict=True) if k == kind]
            prior[kind] = min(0.99, max(0.05, (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2)))
    return trust, post


def train(rows: list[tuple], post: list[float], rounds: int = 300) -> tuple[dict[str, float], np.ndarray]:
    """A logistic classifier of spans on kind, votes and features, fitted to the posteriors: bias by kind, weights."""
    kinds = (*BASE, *FURTHER)
    if not rows:
        return dict.fromkeys(kinds, 0.0), np.zeros(len(LABELERS) + len(FEATURES))
    x = np.array([[*(float(k == kind) for k in kinds), *votes, *features] for kind, votes, features, _ in rows], dtype=float)
    n, p = np.log1p([r[3] for r in rows]), np.array(post)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-(x @ w)))
        w -= 2.0 * (x.T @ ((q - p) * n) / n.sum() / 2 + 0.0005 * w)
    return dict(zip(kinds, w.tolist(), strict=False)), w[len(kinds) :]


def classified(found: DataFrame, bias: dict[str, float], weight: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """``found`` with ``spans``: base spans and the further candidates that the classifier accepts."""
    cut = math.log(threshold / (1 - threshold))
    by_kind = " ".join(f"when '{k}' then {b!r}D" for k, b in bias.items())
    inputs = [*LABELERS.values(), *(f"int({v})" for v in FEATURES.values())]
    score = " + ".join([f"(case x.kind {by_kind} else 0D end)", *(f"{w!r}D * ({v})" for w, v in zip(weight.tolist(), inputs, strict=True))])
    return found.withColumn("spans", F.expr(f"concat(base, filter(further, x -> {score} >= {cut!r}D))"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: id, base and all spans with ``kind, start, end, m`` and surroundings."""
    found = candidates(docs)
    rows = vote_table(found)
    patterns = by_votes(rows)
    _, post = estimate([(k, v, n) for (k, v), n in patterns.items()])
    of = dict(zip(patterns, post, strict=True))
    return classified(found, *train(rows, [of[k, v] for k, v, _, _ in rows]))


def op7_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, their digest and all spans of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda c: f"array_join(transform({c}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint) as n_{k}" for k in BASE]
    return found.selectExpr("doc_id", *counts, f"sha2(cast({text('base')} as binary), 256) as base_sha256", f"{text('spans')} as spans")
