"""Training of classifiers: EM for the probabilistic model, logistic regression, a decision tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.operators.comparing import DecisionTree, LogisticModel
from kinloom.session import materialise

#: Distinct labelled vectors that the driver takes; with more, all of them stay on the executors.
MAX_LABELLED = 1_000_000
#: Gradient descent ends when no parameter moves by more (fixed value).
CONVERGED = 1e-6


@dataclass
class EmResult:
    m_probabilities: list[float]
    u_probabilities: list[float]
    p_match: float
    iterations: int
    converged: bool


def agreement_patterns(vectors: DataFrame, n: int, scores: str = "scores") -> tuple[np.ndarray, np.ndarray]:
    """(patterns of 0/1, counts): the candidates collapse to at most 2^n agreement patterns in one aggregation."""
    bits = [(F.col(scores)[i] >= 0.5).cast("int").alias(f"b{i}") for i in range(n)]
    rows = vectors.select(*bits).na.fill(0).groupBy(*[f"b{i}" for i in range(n)]).count().collect()  # at most 2^n rows
    rows = sorted(tuple(r) for r in rows)
    return np.array([r[:n] for r in rows], dtype=float).reshape(len(rows), n), np.array([r[n] for r in rows], dtype=float)


def estimate_fellegi_sunter(vectors: DataFrame, n: int, scores: str = "scores", max_iterations: int = 100, convergence_threshold: float = 1e-6, initial_p_match: float = 0.1) -> EmResult:
    """Expectation maximisation over agreement patterns; the same numbers as over the single vectors.

    No vectors give empty probabilities after zero iterations.
    """
    x, count = agreement_patterns(vectors, n, scores)
    m, u, p = np.full(n, 0.9), np.full(n, 0.1), initial_p_match
    if not len(x):
        return EmResult([], [], p, 0, True)
    lo, hi = 1e-6, 1 - 1e-6
    for step in range(1, max_iterations + 1):
        like = p * np.prod(np.where(x > 0, m, 1 - m), axis=1)
        unlike = (1 - p) * np.prod(np.where(x > 0, u, 1 - u), axis=1)
        g = np.divide(like, like + unlike, out=np.full(len(x), 0.5), where=like + unlike > 0)
        matched, unmatched = (g * count).sum(), ((1 - g) * count).sum()
        new_m = np.clip((g * count) @ x / matched, lo, hi) if matched > 0 else m
        new_u = np.clip(((1 - g) * count) @ x / unmatched, lo, hi) if unmatched > 0 else u
        new_p = float(matched / count.sum())
        change = max(np.abs(new_m - m).max(initial=0), np.abs(new_u - u).max(initial=0), abs(new_p - p))
        m, u, p = new_m, new_u, new_p
        if change < convergence_threshold:
            return EmResult(m.tolist(), u.tolist(), p, step, True)
    return EmResult(m.tolist(), u.tolist(), p, max_iterations, False)


def _labelled(df: DataFrame, scores: str, label: str) -> tuple[DataFrame, int]:
    """(x, y, n: distinct labelled vectors with their number of rows; how many there are). Equal rows count by weight."""
    rows = df.select(F.col(scores).cast("array<double>").alias("x"), F.col(label).cast("boolean").alias("y")).filter("x is not null and y is not null")
    rows = materialise(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "labelled")
    distinct = rows.count()
    if not distinct:
        raise ValueError("training needs labelled vectors")
    return rows, distinct


def _arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, n = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(i) for i in range(3)))
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(x), -1), y.to_numpy(zero_copy_only=False).astype(float), n.to_numpy(zero_copy_only=False).astype(float)


def _local(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, n = _arrays(rows.toArrow())
    order = np.lexsort((y, *x.T[::-1]))  # the order of a frame is not defined
    return x[order], y[order], n[order]


def _gradient(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Sums over rows: of the error by each feature, of the error."""
    error = (1 / (1 + np.exp(-(x @ w + b))) - y) * n
    return np.append(x.T @ error, error.sum())


def _spread_gradient(rows: DataFrame) -> tuple[int, float, Callable[[np.ndarray, float], np.ndarray], Callable[[], object]]:
    """(features, rows, the gradient as one pass over blocks that stay with the executors, what lets go of the blocks)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y, n = _arrays(batch)
                yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([x, y, n]).tobytes()], pa.binary())], names=["block"])

    width = len(rows.first()["x"])
    blocks = rows.mapInArrow(pack, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)

    def passed(w: np.ndarray, b: float) -> np.ndarray:
        def part(of: Iterator[bytes]) -> Iterator[np.ndarray]:
            total = np.zeros(width + 1)
            for block in of:
                a = np.frombuffer(block).reshape(-1, width + 2)
                total += _gradient(a[:, :width], a[:, width], a[:, width + 1], w, b)
            yield total

        return np.sum(blocks.mapPartitions(part).collect(), axis=0)  # one small array per partition

    return width, float(rows.agg(F.sum("n")).first()[0]), passed, blocks.unpersist


def train_logistic_regression(df: DataFrame, scores: str = "scores", label: str = "label", learning_rate: float = 0.1, max_iterations: int = 1000, regularization: float = 0.01, threshold: float = 0.5) -> LogisticModel:
    """Batch gradient descent from zero; the bias is not regularised. Every step sees all rows: on the driver up to
    MAX_LABELLED distinct vectors, beyond them in a pass over the executors."""
    rows, distinct = _labelled(df, scores, label)
    done: Callable[[], object] = lambda: None
    if distinct <= MAX_LABELLED:
        x, y, n = _local(rows)
        width, total, gradient = x.shape[1], n.sum(), lambda w, b: _gradient(x, y, n, w, b)
    else:
        width, total, gradient, done = _spread_gradient(rows)
    w, b = np.zeros(width), 0.0
    for _ in range(max_iterations):
        g = gradient(w, b) / total
        step, step_b = learning_rate * (g[:-1] + regularization * w), learning_rate * g[-1]
        w, b = w - step, b - step_b
        if max(np.abs(step).max(initial=0), abs(step_b)) < CONVERGED:
            break
    done()
    return LogisticModel(w.tolist(), float(b), threshold)


def _gini(p):
    return 2 * p * (1 - p)


def _local_tree(rows: DataFrame, max_depth: int, min_samples_leaf: int, min_samples_split: int) -> dict:
    x, y, weight = _local(rows)

    def grow(rows: np.ndarray, depth: int) -> dict:
        total, hits = int(weight[rows].sum()), (y[rows] * weight[rows]).sum()
        p = float(hits / total)
        if depth >= max_depth or total < min_samples_split or p in (0.0, 1.0):
            return {"p": p, "n": total}
        best, found = float(_gini(np.array(p))) - 1e-12, None
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, t = x[order, f], (y[order] * weight[order]).cumsum()
            n = weight[order].cumsum()
            cut = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= min_samples_leaf) & (total - n[:-1] >= min_samples_leaf))
            if not len(cut):
                continue
            left, right = t[cut] / n[cut], (t[-1] - t[cut]) / (total - n[cut])
            impurity = (n[cut] * _gini(left) + (total - n[cut]) * _gini(right)) / total
            i = int(impurity.argmin())
            if impurity[i] < best - 1e-12:
                best, found = float(impurity[i]), (f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if found is None:
            return {"p": p, "n": total}
        f, at = found
        goes_left = x[rows, f] <= at
        return {"feature": f, "threshold": at, "left": grow(rows[goes_left], depth + 1), "right": grow(rows[~goes_left], depth + 1)}

    return grow(np.arange(len(x)), 0)


def _spread_tree(rows: DataFrame, max_depth: int, min_samples_leaf: int, min_samples_split: int) -> dict:
    """The same tree level by level: the counts of every value of every feature in every open node, cut where they say. Only
    one row per node, and one per node and feature, comes to the driver."""

    def place(node: dict, name: int) -> Column:
        if "feature" not in node:
            return F.lit(name if node.get("open") else None).cast("int")
        x = F.col("x")[node["feature"]]  # a missing value is no number and goes right
        return F.when((x <= node["threshold"]) & ~F.isnan(x), place(node["left"], 2 * name)).otherwise(place(node["right"], 2 * name + 1))

    root: dict = {"open": True}
    opened = {1: root}
    for depth in range(max_depth + 1):
        here = rows.select(place(root, 1).alias("node"), "x", F.col("n").cast("double").alias("n"), F.when(F.col("y"), F.col("n")).otherwise(0).cast("double").alias("t")).filter("node is not null")
        totals = {r["node"]: (r["n"], r["t"]) for r in here.groupBy("node").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()}
        for name, node in list(opened.items()):
            n, t = totals[name]
            node |= {"p": t / n, "n": int(n)}
            if depth >= max_depth or n < min_samples_split or node["p"] in (0.0, 1.0):
                del node["open"], opened[name]
        if not opened:
            break
        sizes = here.groupBy("node").agg(F.sum("n").alias("nn"), F.sum("t").alias("tt"))
        values = here.filter(F.col("node").isin(list(opened))).select("node", "n", "t", F.posexplode("x").alias("f", "v"))
        values = values.withColumn("v", F.coalesce("v", F.lit(float("nan")))).groupBy("node", "f", "v").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        by = Window.partitionBy("node", "f").orderBy("v")
        cuts = values.select("node", "f", "v", F.lead("v").over(by).alias("next"), F.sum("n").over(by).alias("n"), F.sum("t").over(by).alias("t")).filter(F.col("next").isNotNull() & ~F.isnan("next"))
        n, t, nn, tt = (F.col(c) for c in ("n", "t", "nn", "tt"))
        cuts = cuts.join(F.broadcast(sizes), "node").filter((n >= min_samples_leaf) & (nn - n >= min_samples_leaf))
        impurity = (n * _gini(t / n) + (nn - n) * _gini((tt - t) / (nn - n))) / nn
        best = cuts.groupBy("node", "f").agg(F.min(F.struct(impurity.alias("impurity"), F.col("v"), F.col("next"))).alias("b")).select("node", "f", "b.*").collect()
        split: dict[int, tuple[float, int, float]] = {}
        for r in sorted(best, key=lambda r: (r["node"], r["f"])):
            least = split[r["node"]][0] if r["node"] in split else _gini(opened[r["node"]]["p"]) - 1e-12
            if r["impurity"] < least - 1e-12:
                split[r["node"]] = (r["impurity"], r["f"], (r["v"] + r["next"]) / 2)
        below = {}
        for name, node in opened.items():
            del node["open"]
            if name in split:
                node.clear()
                node |= {"feature": split[name][1], "threshold": split[name][2], "left": {"open": True}, "right": {"open": True}}
                below |= {2 * name: node["left"], 2 * name + 1: node["right"]}
        opened = below
        if not opened:
            break
    return root


def train_decision_tree(df: DataFrame, scores: str = "scores", label: str = "label", max_depth: int = 5, min_samples_leaf: int = 5, min_samples_split: int = 10, match_threshold: float = 0.5) -> DecisionTree:
    """CART by Gini impurity with thresholds midway between values; of equally good splits the first feature and threshold win.
    All rows count: on the driver up to MAX_LABELLED distinct vectors, beyond them level by level on the executors."""
    rows, distinct = _labelled(df, scores, label)
    grown = (_local_tree if distinct <= MAX_LABELLED else _spread_tree)(rows, max_depth, min_samples_leaf, min_samples_split)
    return DecisionTree(grown, match_threshold)


def predict(df: DataFrame, model: LogisticModel | DecisionTree, scores: str = "scores") -> DataFrame:
    """Adds score and match_class."""
    return df.withColumn("_c", model(F.col(scores))).select(*df.columns, "_c.score", "_c.match_class")
