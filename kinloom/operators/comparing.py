"""Comparators (field pairs -> score column in [0, 1]) and classifiers (scores -> score and class)."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from kinloom.functions import phonetic, registry, similarity


# --- comparators: missing values score 0.0 -------------------------------------------------------------------------------
def compare_string(a: Column, b: Column, metric: str = "jaro_winkler") -> Column:
    return F.coalesce(similarity.scorer(metric)(a, b), F.lit(0.0))


def compare_exact(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.0)


def compare_numeric(a: Column, b: Column, max_diff: float = 10.0) -> Column:
    x, y = a.try_cast("double"), b.try_cast("double")
    if max_diff <= 0:
        return F.when(x == y, 1.0).otherwise(0.0)
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.abs(x - y) / max_diff), F.lit(0.0))


def compare_date(a: Column, b: Column) -> Column:
    """1 if equal; otherwise .4 for the year, .3 for the month, .3 for the day, if both have three parts."""
    x, y = F.split(a.cast("string"), "-"), F.split(b.cast("string"), "-")
    part = lambda i, w: F.when(x[i] == y[i], w).otherwise(0.0)
    whole = F.when((F.size(x) == 3) & (F.size(y) == 3), part(0, 0.4) + part(1, 0.3) + part(2, 0.3)).otherwise(0.0)
    return F.when(a == b, 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(whole)


def compare_phonetic(a: Column, b: Column, algorithm: str = "soundex") -> Column:
    return F.when(phonetic.encode(a, algorithm) == phonetic.encode(b, algorithm), 1.0).otherwise(0.0)


def compare_custom(a: Column, b: Column, name: str) -> Column:
    return F.coalesce(registry.comparator(name)(a.cast("string"), b.cast("string")), F.lit(0.0))


# --- classifiers: array of scores -> struct<score, match_class> ----------------------------------------------------------
Classifier = Callable[[Column], Column]


def _mean(scores: Column, n: int) -> Column:
    """Element by element rather than by a higher-order function: the optimizer then sees through the array."""
    total = F.lit(0.0)
    for i in range(n):
        total = total + scores[i]
    return total / n


def _dot(scores: Column, weights: Sequence[float]) -> Column:
    """Weights beyond the scores, and scores beyond the weights, do not count."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.coalesce(F.get(scores, F.lit(i)) * F.lit(float(w)), F.lit(0.0))
    return total


def _labelled(score: Column, match: Column, possible: Column | None = None) -> Column:
    label = F.when(match, "match")
    if possible is not None:
        label = label.when(possible, "possible")
    return F.struct(score.alias("score"), label.otherwise("non_match").alias("match_class"))


def threshold(t: float, n: int) -> Classifier:
    return lambda s: _labelled(_mean(s, n), _mean(s, n) >= t)


def threshold_bands(upper: float, lower: float, n: int) -> Classifier:
    return lambda s: _labelled(_mean(s, n), _mean(s, n) >= upper, _mean(s, n) >= lower)


def weighted(weights: Sequence[float], t: float) -> Classifier:
    return lambda s: _labelled(_dot(s, weights), _dot(s, weights) >= t)


def weighted_bands(weights: Sequence[float], upper: float, lower: float) -> Classifier:
    return lambda s: _labelled(_dot(s, weights), _dot(s, weights) >= upper, _dot(s, weights) >= lower)


def _log_ratio(p: float, q: float) -> float:
    return math.log(p / q) if p > 0 and q > 0 else 0.0


def fellegi_sunter(m: Sequence[float], u: Sequence[float], upper: float, lower: float, n: int) -> Classifier:
    """Sum of log likelihood ratios; a field agrees at a score of 0.5 or more; missing m and u are 0.9 and 0.1."""
    m = [*m, *[0.9] * n][:n]
    u = [*u, *[0.1] * n][:n]

    def classify(s: Column) -> Column:
        total = F.lit(0.0)
        for i in range(n):
            total = total + F.when(s[i] >= 0.5, _log_ratio(m[i], u[i])).otherwise(_log_ratio(1 - m[i], 1 - u[i]))
        return _labelled(total, total >= upper, total > lower)

    return classify


@dataclass
class LogisticModel:
    weights: list[float]
    bias: float
    threshold: float = 0.5

    def __call__(self, s: Column) -> Column:
        p = 1 / (1 + F.exp(-(_dot(s, self.weights) + self.bias)))
        return _labelled(p, p >= self.threshold)


@dataclass
class DecisionTree:
    """A tree of {"feature", "threshold", "left", "right"} and leaves {"p"}; at or below the threshold goes left."""

    root: dict
    threshold: float = 0.5

    def to_json(self) -> str:
        return json.dumps({"root": self.root, "threshold": self.threshold})

    @classmethod
    def from_json(cls, text: str) -> "DecisionTree":
        d = json.loads(text)
        return cls(d["root"], d["threshold"])

    def probability(self, s: Column) -> Column:
        def walk(node: dict) -> Column:
            if "p" in node:
                return F.lit(float(node["p"]))
            return F.when(s[node["feature"]] <= node["threshold"], walk(node["left"])).otherwise(walk(node["right"]))

        return walk(self.root)

    def __call__(self, s: Column) -> Column:
        p = self.probability(s)
        return _labelled(p, p >= self.threshold)


#: Relative cost of a comparator and how selective it is, used to evaluate cheap and telling ones first (fixed values).
COSTS = {"exact": (1, 5.0), "numeric": (2, 3.0), "date": (5, 4.0), "phonetic": (20, 2.0), "string": (60, 1.5), "custom": (100, 1.0)}
