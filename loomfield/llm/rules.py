"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of the whole text are Spark column expressions. All are ratios or
   means, so that a document's length alone doesn't decide.
2. Over a bounded sample of labelled rows (``SAMPLE`` rows, ids not held out),
   small trees are boosted; every path from a root to a node below it is a
   conjunctive rule (statistic <= or > a threshold).
3. A logistic model with lasso penalty is fitted to the rules' 0/1 values;
   most weights are exactly 0.
4. The rules that remain are compiled into one Spark column expression, so all
   documents are scored in the JVM without Python.

Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null text is empty; all its statistics are 0 and it gets the
score that the rules give them. Without labelled rows of both classes the score
is the label share (0.5 without labels). Null ids are not held out. Repeated
rows are scored as rows; of several texts with one sampled id the one with the
smallest hash is fitted. Very long texts are scored whole, in their row. Empty
tables give empty results; other columns, also such with the names used here,
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of
from .labelled import held_out, sample_documents, sample_labels

SAMPLE, TREES, DEPTH, LASSO, THRESHOLD = 12_000, 40, 3, 2e-3, 0.3
FEATURES = [
    "mean_word", "upper", "digit", "symbol", "punctuation", "space", "exclaim", "bar",
    "mean_line", "repeated_lines", "adjacent_words", "urls", "non_ascii",
]


def statistics(text: Column) -> Column:
    """struct of FEATURES (doubles) of a text."""

    def count(t, pattern):
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    def of(t):
        n = F.greatest(F.length(t), F.lit(1)).cast("double")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)
        words = F.filter(F.split(t, r"\s+"), lambda w: w != "")

        def sized(ls, ws):
            nl, nw = F.greatest(F.size(ls), F.lit(1)).cast("double"), F.greatest(F.size(ws), F.lit(1)).cast("double")
            same = F.size(F.filter(F.zip_with(ws, F.slice(ws, F.lit(2), F.size(ws)), lambda a, b: a == b), lambda e: F.coalesce(e, F.lit(False))))
            values = {
                "mean_word": n / nw,
                "upper": count(t, "[A-Z]") / n, "digit": count(t, "[0-9]") / n, "symbol": count(t, r"[#$%&*+<=>@\\^_`{|}~]") / n,
                "punctuation": count(t, "[.,;:?]") / n, "space": count(t, r"\s") / n, "exclaim": count(t, "!") / n, "bar": count(t, r"\|") / n,
                "mean_line": n / nl, "repeated_lines": 1.0 - F.size(F.array_distinct(ls)) / nl, "adjacent_words": same / nw,
                "urls": count(t, "https?://") / nw, "non_ascii": count(t, r"[^\x00-\x7f]") / n,
            }
            return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])

        return let(lines, lambda ls: let(words, lambda ws: sized(ls, ws)))

    return let(text, of)


@dataclass
class Rule:
    """All conditions (feature index, is_above, threshold) hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.conditions:
            out &= (x[:, f] > t) if above else (x[:, f] <= t)
        return out


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        """The score as a Spark column over the struct of statistics."""
        z = F.lit(float(self.bias))
        for r, w in zip(self.rules, self.weights, strict=True):
            test = None
            for f, above, t in r.conditions:
                one = (stats[FEATURES[f]] > F.lit(float(t))) if above else (stats[FEATURES[f]] <= F.lit(float(t)))
                test = one if test is None else test & one
            z = z + F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(bins, edges, grad, hess, rows, depth, path, out, usable):
    """One regression tree on binned features: appends a rule for every node below the root, returns row values."""
    value = -grad[rows].sum() / (hess[rows].sum() + 1.0)
    result = np.zeros(len(grad))
    result[rows] = value
    if depth == 0 or len(rows) < 20:
        return result
    best = (1e-6, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    for f, e in enumerate(edges):
        if not len(e) or f not in usable:
            continue
        b = bins[rows, f]
        gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
        hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(nl < 5) | (len(rows) - nl < 5)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], (f, k))
    if best[1] is None:
        return result
    f, k = best[1]
    low = bins[rows, f] <= k
    for side, above in ((rows[low], False), (rows[~low], True)):
        own = (*path, (f, above, float(edges[f][k])))
        out.add(own)
        result[side] = _grow(bins, edges, grad, hess, side, depth - 1, own, out, usable)[side]
    return result


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleModel:
    """Boost small trees for rules, then weigh the rules by lasso logistic regression (proximal gradient)."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return RuleModel([], [], float(np.log(p / (1 - p))))
    edges = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1]))
        edges.append((q[:-1] + q[1:]) / 2 if len(q) > 1 else q)
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rng = np.random.default_rng(seed)
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: set = set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        paths: set = set()
        usable = set(rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2].tolist())  # trees of different statistics give different rules
        _grow(bins, edges, p - y, p * (1 - p), rows, depth, (), paths, usable)
        # the tree's values for all rows, from its leaves
        leaves = [q for q in paths if not any(len(r) > len(q) and r[: len(q)] == q for r in paths)]
        for q in leaves:
            inside = Rule(q).holds(x)
            z += 0.3 * inside * (-(p - y)[inside].sum() / ((p * (1 - p))[inside].sum() + 1.0))
        found |= paths
    # equal conjunctions in another order are one rule
    rules = [Rule(q) for q in sorted({tuple(sorted(set(p))) for p in found})]
    if not rules:
        return RuleModel([], [], float(z[0]))
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    _, first = np.unique(a, axis=1, return_index=True)  # rules that hold for the same rows
    rules, a = [rules[i] for i in sorted(first)], a[:, sorted(first)]
    mean = a.mean(axis=0)
    w, b, v, t = np.zeros(len(rules)), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(rules)), 1.0
    step = 4.0 / max(1.0, np.linalg.norm(a - mean, 2) ** 2 / len(y))
    for _ in range(400):
        p = 1 / (1 + np.exp(-(a @ v - mean @ v + b)))
        new = v - step * ((a - mean).T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        b -= 4.0 * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[i] for i in keep], [float(w[i]) for i in keep], float(b - mean @ w))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> RuleModel:
    chosen = sample_labels(labels, label, rows).collect()  # at most `rows` ids
    got = sample_documents(docs, chosen, [statistics(text_of()).alias("s")]).select("doc_id", "y", "s.*").orderBy("doc_id").collect()  # a row an id
    x = np.asarray([[float(v) for v in r[2:]] for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.asarray([r[1] for r in got], float))


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, threshold: float = THRESHOLD, model: RuleModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = model or train(docs, labels, rows=rows)
    scored = docs.select("doc_id", let(statistics(text_of()), model.column).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: RuleModel | None = None) -> DataFrame:
    """The documents whose score is at least ``threshold``, with all their columns; no shuffle."""
    model = model or train(docs, labels)
    return docs.where(let(statistics(text_of()), model.column) >= threshold)
