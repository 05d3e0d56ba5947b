"""Quality classifier: a sparse ensemble of rules.

Small trees are grown on samples of the labelled rows; every path from a root to a node is
a rule, a conjunction of thresholds on text statistics.  Lasso logistic regression keeps
few rules and weighs them, and the kept rules are compiled into one Spark column expression,
so scoring runs without a model object.

Trees and weights are fitted on about ``FIT_ROWS`` labelled rows, those lowest in the hash of
id and statistics; statistics are computed and scores given for every row.

Defined results: null and empty texts are scored like any other (all statistics 0); rows
whose label is null, or whose id is null, are not learned from; without labels of both kinds
every score is the share of good labels (1.0 without labels).
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.language_id import held_out
from tapeloom.llm.text_stats import text_statistics
from tapeloom.session import settle

FIT_ROWS = 20_000
TREES = 30
DEPTH = 3
LEAST_LEAF = 10
PENALTY = 0.002
STEPS = 300
THRESHOLD = 0.3
SEED = 7


def features() -> dict[str, Column]:
    """Statistics the rules compare with thresholds, defined once for fitting and scoring."""

    def per(count: str, of: str) -> Column:
        return F.col(count) / F.greatest(F.col(of), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "line_copies": per("n_dup_lines", "n_lines"),
        "repetition": per("n_repeat_words", "n_words"),
        "variety": per("n_distinct_words", "n_words"),
        "capitals": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"),
        "stops": per("n_stops", "n_words"),
        "shouts": per("n_shouts", "n_words"),
        "line_words": per("n_words", "n_lines"),
    }


Condition = tuple[int, bool, float]  # feature, whether above, threshold


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """Probability of good as a column over the feature columns ``f0``, ``f1``, ..."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for feature, above, threshold in rule:
                value = F.col(f"f{feature}")
                holds = holds & ((value > threshold) if above else (value <= threshold))
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], path: tuple[Condition, ...], depth: int) -> list[tuple[Condition, ...]]:
    """Paths to all nodes below this one; splits lower the Gini impurity most."""
    if depth == 0 or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return []
    best = None
    for feature, thresholds in enumerate(cuts):
        above = x[:, feature][:, None] > thresholds
        n = above.sum(0)
        fits = (n >= LEAST_LEAF) & (len(y) - n >= LEAST_LEAF)
        if not fits.any():
            continue
        good = (above * y[:, None]).sum(0)
        rest, rest_n = y.sum() - good, len(y) - n
        gain = np.where(fits, good**2 / np.maximum(n, 1) + rest**2 / np.maximum(rest_n, 1), -1.0)
        k = int(np.argmax(gain))
        if best is None or gain[k] > best[0]:
            best = (gain[k], feature, float(thresholds[k]))
    if best is None:
        return []
    _, feature, threshold = best
    above = x[:, feature] > threshold
    out = []
    for side in (True, False):
        rows = above == side
        own = path + ((feature, side, threshold),)
        out += [own, *grow(x[rows], y[rows], cuts, own, depth - 1)]
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of L1-penalised logistic regression by accelerated proximal steps."""
    n, m = z.shape
    weights = previous = np.zeros(m)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    bias = before = base
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1.0)
    for step in range(1, steps + 1):
        pace = (step - 1) / (step + 2)
        ahead, bias_ahead = weights + pace * (weights - previous), bias + pace * (bias - before)
        off = 1 / (1 + np.exp(-(z @ ahead + bias_ahead))) - y
        previous, before = weights, bias
        moved = ahead - rate * (z.T @ off) / n
        weights = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        bias = bias_ahead - rate * off.mean()
    return weights, bias


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, above, threshold in rule:
        out &= (x[:, feature] > threshold) if above else (x[:, feature] <= threshold)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules of trees on half of the rows each, then sparse weights on all rows."""
    if len(y) == 0 or y.min() == y.max():
        return Ensemble((), (), 40.0 if len(y) == 0 or y[0] > 0 else -40.0)
    random = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
    found: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        rows = random.random(len(y)) < 0.5
        usable = [c if random.random() < 0.6 else c[:0] for c in cuts]
        found.update(dict.fromkeys(grow(x[rows], y[rows], usable, (), DEPTH)))
    rules = list(found)
    if not rules:
        return Ensemble((), (), float(np.log(y.mean() / (1 - y.mean()))))
    z = np.stack([holds(x, r) for r in rules], axis=1).astype(float)
    weights, bias = lasso(z, y)
    kept = np.nonzero(np.abs(weights) > 1e-6)[0]
    return Ensemble(tuple(rules[i] for i in kept), tuple(float(weights[i]) for i in kept), float(bias))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted per row of ``docs``."""
    out = held_out(F.col("doc_id"), 5, 0)
    counted = docs.select("doc_id", text_statistics(F.col("text")).alias("_s")).select("doc_id", "_s.*")
    named = [value.alias(f"f{i}") for i, value in enumerate(features().values())]
    stats = settle(counted.select("doc_id", out.alias("held_out"), *named))
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    rows = stats.where(~F.col("held_out")).join(known, F.col("doc_id") == F.col("_id"))
    names = [f"f{i}" for i in range(len(named))]
    # Rows below a bound of the hash, so that about FIT_ROWS rows reach the driver from all tasks together.
    share = FIT_ROWS / max(1, known.count())
    drawn = F.pmod(F.xxhash64("doc_id", *names), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = sorted(tuple(r) for r in rows.where(drawn).select("_y", *names).collect())
    values = np.array(sample, float).reshape(-1, len(names) + 1)
    model = fit(values[:, 1:], values[:, 0])
    score = model.score()
    return stats.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
