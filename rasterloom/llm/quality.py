"""Quality classifier: a sparse ensemble of rules, compiled into column expressions.

Every text becomes a few statistics, all of them column expressions over the whole text. Small
decision trees over these are grown on labelled documents, each on its own part of the rows and
of the statistics; every path from a root to a node is a rule, a conjunction of comparisons. A
lasso logistic regression weighs the rules and sets most weights to zero. What is left is
compiled to one sum of CASE expressions, so that scoring is a projection without any Python.

The fit reads a bounded sample: at most `sample` labelled documents, those of smallest
xxhash64(doc_id), of which only the statistics reach the driver.

Defined results: null and empty texts have statistics 0 (and 1 for the share of distinct words)
and are scored like any other; without labelled documents every score is 0.5; repeated rows
repeat their score; rows with a null id are scored but never learned from; other columns are
ignored."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = "#$%&*|@<>{}[]^~=+_/"
STATISTICS = ("log_words", "word_length", "distinct", "symbols", "upper", "digits", "marks", "exclaims", "lines")


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    words = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", F.split(F.col("text"), r"[ \n\t]+"))
    chars, n = F.greatest(F.length("text"), F.lit(1)).cast("double"), F.size("w").cast("double")

    def share(letters: str) -> Column:
        return (F.length("text") - F.length(F.translate("text", letters, ""))) / chars

    return words.select(
        "doc_id", F.log1p(n).alias("log_words"), (F.length("text") / n).alias("word_length"), (F.size(F.array_distinct("w")) / n).alias("distinct"),
        share(_SYMBOLS).alias("symbols"), share(_UPPER).alias("upper"), share("0123456789").alias("digits"), share(".,;:?").alias("marks"), share("!").alias("exclaims"), share("\n").alias("lines"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, at in self.terms:
            out &= (x[:, k] > at) if above else (x[:, k] <= at)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, at in self.terms:
            out = out & ((F.col(STATISTICS[k]) > at) if above else (F.col(STATISTICS[k]) <= at))
        return out


def _grow(x: np.ndarray, y: np.ndarray, columns: np.ndarray, depth: int, path: tuple, least: int, out: set[Rule]) -> None:
    """Split greedily by Gini impurity and add the rule of every node below."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return
    best = (1e-9, 0, 0.0)
    whole = len(y) * y.mean() * (1 - y.mean())
    for k in columns:
        for at in np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 33))):
            left = x[:, k] <= at
            n = int(left.sum())
            if least <= n <= len(y) - least:
                p, q = y[left].mean(), y[~left].mean()
                gain = whole - n * p * (1 - p) - (len(y) - n) * q * (1 - q)
                if gain > best[0]:
                    best = (gain, int(k), float(at))
    if best[0] <= 1e-9:
        return
    _, k, at = best
    for above in (False, True):
        side = (x[:, k] > at) == above
        longer = (*path, (k, above, at))
        out.add(Rule(longer))
        _grow(x[side], y[side], columns, depth - 1, longer, least, out)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 5) -> list[Rule]:
    rng = np.random.default_rng(seed)
    out: set[Rule] = set()
    for _ in range(trees):
        rows = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        columns = np.sort(rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False))
        _grow(x[rows], y[rows], columns, depth, (), max(3, len(rows) // 400), out)
    return sorted(out, key=lambda r: (len(r.terms), r.terms))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps."""
    n, k = x.shape
    beta, bias = np.zeros(k), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    ahead, ahead_bias, t = beta.copy(), bias, 1.0
    rate = 4 * n / (np.linalg.norm(x, ord=2) ** 2 + n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -30, 30)))
        new = ahead - rate * (x.T @ (p - y) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias = ahead_bias - rate * float((p - y).mean())
        t, was = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, ahead_bias = new + (was - 1) / t * (new - beta), new_bias + (was - 1) / t * (new_bias - bias)
        beta, bias = new, new_bias
    return beta, bias


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score over the statistics' columns, 0 to 1."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, sample: int = 8000) -> RuleEnsemble:
    """Learn from labelled documents whose crc32(doc_id as text) mod `modulus` is not `remainder`."""
    known = labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id"), modulus, remainder)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    stats = with_statistics(docs.join(F.broadcast(known), "doc_id").select("doc_id", "text"))  # `sample` short rows
    rows = sorted(stats.join(F.broadcast(known), "doc_id").select("doc_id", "quality", *STATISTICS).collect())
    if not rows:
        return RuleEnsemble([], [], 0.0)
    x, y = np.array([r[2:] for r in rows], dtype=float), np.array([float(r[1]) for r in rows])
    rules = grow_rules(x, y)
    if not rules:
        return RuleEnsemble([], [], math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    weights, bias = lasso_logistic(np.stack([r.holds(x) for r in rules], axis=1).astype(float), y)
    used = np.flatnonzero(np.abs(weights) > 1e-4)
    return RuleEnsemble([rules[i] for i in used], [float(weights[i]) for i in used], float(bias))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, sample: int = 8000, accept: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= accept)."""
    model = fit(docs, labels, modulus, remainder, sample)
    scored = with_statistics(docs).select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
