"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees propose rules (the path to each of their nodes); a lasso-penalised logistic
regression keeps a few and weighs them; the kept rules are compiled into Spark column expressions,
so scoring the corpus is a plain projection without Python.

The fit learns from at most ``MAX_FIT_ROWS`` labelled rows (those first in the order of a hash of
the id), never from held-out rows.  Label, language, source and id are no inputs of the score.

Edge cases: a null text is scored as an empty one; a null ``doc_id`` counts as held out; repeated
rows each get a score; labels that repeat an id count once (the smallest), null labels not at all, and
of labelled documents that share an id the one with the least statistics is learnt from;
if one of the classes has no labelled row the score is the smoothed base rate; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, PENALTY = 40, 3, 32, 0.0008


def text_statistics(text: Column) -> dict[str, Column]:
    """The statistics rules are made of, as expressions over two prepared columns ``text`` and ``words``."""
    n, words = F.greatest(F.char_length(text), F.lit(1)), F.col("words")
    k = F.greatest(F.size(words), F.lit(1))
    without = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    return {
        "log_chars": F.log1p(F.char_length(text)),
        "chars_per_word": F.char_length(text) / k,
        "upper": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}+", ""))) / n,
        "letters": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{L}+", ""))) / n,
        "digits": without("0123456789") / n,
        "symbols": without("#$%&*@^~<>{}[]\\/=+_") / n,
        "bangs": without("!?") / n,
        "pipes": without("|") / n,
        "stops": without(".,;:") / n,
        "lines": without("\n") / k,
        "distinct": F.size(F.array_distinct(words)) / k,
        "repeats": F.size(F.filter(words, lambda w, i: (i > 0) & (w == words[F.greatest(i - 1, F.lit(0))]))) / k,
        "short": F.size(F.filter(words, lambda w: F.char_length(w) <= 3)) / k,
        "longest": F.coalesce(F.array_max(F.transform(words, lambda w: F.char_length(w))), F.lit(0)).cast("double"),
    }


FEATURES = list(dict.fromkeys(["log_chars", "chars_per_word", "upper", "letters", "digits", "symbols", "bangs", "pipes", "stops", "lines", "distinct", "repeats", "short", "longest"]))


def with_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and one double column ``q_<name>`` per statistic."""
    base = docs.select(*keep, whole_text(text_col).alias("__text"))
    split = base.withColumn("words", F.filter(F.split("__text", r"\s+"), lambda w: w != ""))
    stats = text_statistics(F.col("__text"))
    # The row number keeps a filter on the score above this projection: pushed below, it would
    # work every statistic out again for each rule that uses it.
    return split.select(*keep, *(stats[n].cast("double").alias(f"q_{n}") for n in FEATURES), F.monotonically_increasing_id().alias("q_row"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, is_at_most, threshold)`` with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float

    def column(self) -> Column:
        tests = [F.col(f"q_{FEATURES[f]}") <= t if below else F.col(f"q_{FEATURES[f]}") > t for f, below, t in self.terms]
        return F.when(reduce(lambda a, b: a & b, tests), F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, (r.column() for r in self.rules), F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set, out: np.ndarray) -> None:
    """One regression tree on ``grad`` over the binned features ``x``; adds the path of each node."""
    out[rows] = grad[rows].mean()
    if depth == 0 or len(rows) < 40:
        return
    best = (1e-9, -1, -1)
    total, size = grad[rows].sum(), len(rows)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        s = np.cumsum(np.bincount(x[rows, f], weights=grad[rows], minlength=len(edges) + 1))[:-1]
        c = np.cumsum(np.bincount(x[rows, f], minlength=len(edges) + 1))[:-1]
        ok = (c >= 15) & (size - c >= 15)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(size - c, 1) - total**2 / size, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
    _, f, k = best
    if f < 0:
        return
    left = x[rows, f] <= k
    for below, part in ((True, rows[left]), (False, rows[~left])):
        step = (*path, (f, below, float(cuts[f][k])))
        rules.add(step)
        _grow(x, cuts, grad, part, depth - 1, step, rules, out)


def propose(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[tuple]:
    """Paths of boosted trees, each grown on a random half of the rows."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
    rng, rules, raw = np.random.default_rng(seed), set(), np.zeros(len(y))
    for _ in range(trees):
        grad = y - 1 / (1 + np.exp(-raw))
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        # Every row passes the tree grown on the half, so that the next tree corrects all.
        step, grown = np.zeros(len(y)), set()
        _grow(binned, cuts, grad, rows, depth, (), grown, step)
        rest = np.setdiff1d(np.arange(len(y)), rows)
        leaves = sorted(grown, key=len)
        for path in leaves:
            own = np.ones(len(y), bool)
            for f, below, t in path:
                own &= (x[:, f] <= t) == below
            inside = own[rows]
            if inside.any():
                step[rest[own[rest]]] = step[rows[inside]].mean()
        raw += 0.8 * np.clip(4 * step, -2, 2)
        rules |= grown
    return sorted(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps."""
    n, d = z.shape
    step = 4.0 / max(1e-9, float(np.linalg.norm(z, 2) ** 2 / n + 1))
    w, b, v, c, t = np.zeros(d), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(d), 0.0, 1.0
    c = b
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(z @ v + c))) - y
        u = v - step * (z.T @ g) / n
        new_w, new_b = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0), c - step * g.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """The ensemble for statistics ``x`` and labels ``y`` (0 or 1)."""
    good, n = float(y.sum()), len(y)
    base = RuleEnsemble(float(np.log((good + 1) / (n - good + 1))), ())
    if good in (0, n):
        return base
    paths = propose(x, y)
    if not paths:
        return base
    z = np.ones((n, len(paths)))
    for j, path in enumerate(paths):
        for f, below, t in path:
            z[:, j] *= (x[:, f] <= t) == below
    b, w = lasso_logistic(z, y, PENALTY)
    return RuleEnsemble(b, tuple(Rule(p, float(k)) for p, k in zip(paths, w, strict=True) if abs(k) > 1e-3))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled rows that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y")).where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows small rows: a proven bound for the broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One row of each id, the least, so that repeated ids do not add to what the driver gets.
    each = with_statistics(texts, keep=("doc_id", "y")).groupBy("doc_id").agg(F.min(F.struct("y", *(f"q_{n}" for n in FEATURES))).alias("r"))
    rows = each.select("doc_id", "r.*").collect()
    rows.sort(key=tuple)
    data = np.array([[*r][1:] for r in rows], dtype=float).reshape(len(rows), len(FEATURES) + 1)
    return fit_rules(data[:, 1:], (data[:, 0] > 0).astype(float))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_quality(docs: DataFrame, model: RuleEnsemble, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and ``score`` (0 to 1) per row."""
    return with_statistics(docs, keep=keep).select(*keep, model.score().alias("score"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, ("doc_id",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``; columns as they were."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), F.col("text").alias("__from"))
    scored = with_statistics(rows, "__from", ("__row",))
    return scored.where((model.score() >= threshold) & (F.col("q_row") >= 0)).select("__row.*")
