"""Quality classifier: a sparse ensemble of rules.

Small trees are grown on document statistics; every path from a root to a node
is a conjunctive rule (threshold tests). A logistic model with an L1 penalty
weighs the rules, most weights become zero, and the rest is compiled into one
Spark column expression: scoring is a projection, with no Python and no shuffle.

Training uses a bounded sample of labelled rows (``sample_rows``, taken by a hash
of the id, so it is the same at every run); the trees and weights are fitted on
the driver from that sample's statistics. Only rows outside the held-out fold
are learnt from, and labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts have all statistics zero and get a score
like any other; null ids are never labelled and not held out; repeated labels
each count; without labels of both classes the score is the smoothed prior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgrid.llm.common import WHITESPACE_RUN, broadcast_if_small, text_or_empty

SAMPLE_ROWS = 20_000


def _removed(pattern: str) -> Column:
    return F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))


def _per(count: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(count.cast("double"), of.cast("double")), F.lit(0.0))


def statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with one double per statistic, and their names. Words and lines are stored columns first."""
    words = F.filter(F.split("_t", WHITESPACE_RUN, -1), lambda w: w != "")
    docs = docs.withColumn("_t", text_or_empty(text)).withColumn("_w", words).withColumn("_lines", F.split("_t", "\n", -1))
    chars, n = F.length("_t"), F.size("_w")
    found = {
        "s_words": n.cast("double"),
        "s_word_chars": _per(F.length(F.array_join("_w", "")), n),
        "s_distinct": _per(F.size(F.array_distinct("_w")), n),
        "s_symbols": _per(_removed(r"[#*$%&|<>]"), n),
        "s_bangs": _per(_removed("!"), n),
        "s_upper": _per(_removed("[A-Z]"), chars),
        "s_digits": _per(_removed("[0-9]"), chars),
        "s_points": _per(_removed("[.,;:?]"), n),
        "s_lines": _per(F.size("_lines"), n),
        "s_dup_lines": _per(F.size("_lines") - F.size(F.array_distinct("_lines")), F.size("_lines")),
    }
    return docs.withColumns(found).drop("_t", "_w", "_lines"), list(found)


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


Test = tuple[int, bool, float]  # statistic, at most (else above), threshold


@dataclass(frozen=True)
class Ensemble:
    names: list[str]
    rules: list[tuple[Test, ...]]
    weights: np.ndarray
    bias: float

    def column(self) -> Column:
        """The score as a column expression over the statistics."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            if w:
                met = F.lit(True)
                for k, below, at in rule:
                    c = F.col(self.names[k])
                    met = met & ((c <= at) if below else (c > at))
                total = total + F.when(met, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + rule_matrix(x, self.rules) @ self.weights)))


def _split(x: np.ndarray, y: np.ndarray, g: np.random.Generator) -> Test | None:
    """The best Gini split among quantiles of a random half of the statistics."""
    best, found = 1e-9, None
    for k in sorted(g.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]):
        for at in np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 25))):
            m = x[:, k] <= at
            n = m.sum()
            if 0 < n < len(y):
                p, q = y[m].mean(), y[~m].mean()
                gain = y.mean() * (1 - y.mean()) - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
                if gain > best:
                    best, found = gain, (int(k), True, float(at))
    return found


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, seed: int = 7, least: int = 10) -> list[tuple[Test, ...]]:
    """Distinct paths of small trees, each grown on a class-balanced resample."""
    g, rules = np.random.default_rng(seed), {}
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    size = max(least * 4, min(2000, len(y)) // 2)
    for _ in range(trees):
        rows = np.concatenate([g.choice(c, size) for c in classes])
        level = [((), x[rows], y[rows])]
        for _ in range(depth):
            grown = []
            for path, xs, ys in level:
                if len(ys) < 2 * least or ys.min() == ys.max() or not (test := _split(xs, ys, g)):
                    continue
                m = xs[:, test[0]] <= test[2]
                for below, keep in ((True, m), (False, ~m)):
                    rule = (*path, (test[0], below, test[2]))
                    rules[rule] = None
                    grown.append((rule, xs[keep], ys[keep]))
            level = grown
    return list(rules)


def rule_matrix(x: np.ndarray, rules: list[tuple[Test, ...]]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, below, at in rule:
            out[:, j] *= (x[:, k] <= at) if below else (x[:, k] > at)
    return out


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float = 2e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient; classes weigh the same, the bias is free."""
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    step = 4.0 / max(np.linalg.norm(np.c_[z, np.ones(len(z))] * np.sqrt(each)[:, None], 2) ** 2, 1e-9)
    w = v = np.zeros(z.shape[1] + 1)
    t = 1.0
    for _ in range(rounds):
        error = each * (1 / (1 + np.exp(-(z @ v[:-1] + v[-1]))) - y)
        new = v - step * np.r_[z.T @ error, error.sum()]
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Learn from at most ``sample_rows`` labelled rows outside the held-out fold."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample_rows)
    sample, names = statistics(docs.select("doc_id", "text").join(broadcast_if_small(known), F.col("doc_id") == F.col("_id")))
    rows = np.array([list(r) for r in sample.select(*names, "_y").orderBy("_id", "_y", *names).limit(sample_rows).collect()], dtype=float).reshape(-1, len(names) + 1)
    x, y = rows[:, :-1], rows[:, -1]
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(names, [], np.zeros(0), float(np.log(p / (1 - p))))
    rules = grow_rules(x, y)
    weights, bias = fit_lasso(rule_matrix(x, rules), y)
    kept = [j for j in range(len(rules)) if weights[j]]
    return Ensemble(names, [rules[j] for j in kept], weights[kept], bias)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit(docs, labels, sample_rows)
    scored, _ = statistics(docs.select("doc_id", "text"))
    scored = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
