"""Quality of matches against known ones, thresholds, and active learning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window, functions as F

from kinloom.functions import similarity
from kinloom.operators.skew import range_parts


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    # least and greatest skip nulls, so both ends are checked first
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).distinct()


def confusion_matrix(predicted: DataFrame, truth: DataFrame, total_pairs: int | None = None, a: str = "left_id", b: str = "right_id") -> DataFrame:
    """One row: tp, fp, fn, tn (null without ``total_pairs``), precision, recall, f1. Pairs have no direction; nothing predicted gives 0."""
    both = _pairs(predicted, a, b).withColumn("x", F.lit(1)).join(_pairs(truth, a, b).withColumn("y", F.lit(1)), ["p", "q"], "full")
    counts = both.agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("x").isNotNull() & F.col("y").isNotNull()), ("fp", F.col("y").isNull()), ("fn", F.col("x").isNull()))])
    tn = F.lit(None).cast("long") if total_pairs is None else F.lit(total_pairs) - F.col("tp") - F.col("fp") - F.col("fn")
    return _rates(counts.withColumn("tn", tn))


def _rates(df: DataFrame) -> DataFrame:
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def precision(predicted: DataFrame, truth: DataFrame) -> float:
    return confusion_matrix(predicted, truth).first()["precision"]


def recall(predicted: DataFrame, truth: DataFrame) -> float:
    return confusion_matrix(predicted, truth).first()["recall"]


def f1_score(predicted: DataFrame, truth: DataFrame) -> float:
    return confusion_matrix(predicted, truth).first()["f1"]


def pairs_from_results(results: DataFrame, match_class: str | None = "match") -> DataFrame:
    out = results if match_class is None else results.filter(F.col("match_class") == match_class)
    return out.select("left_id", "right_id")


def scored_pairs_from_results(results: DataFrame) -> DataFrame:
    return results.select("left_id", "right_id", "score")


def _by_threshold(scored: DataFrame, truth: DataFrame, a: str, b: str, score: str) -> tuple[DataFrame, int]:
    """(threshold, tp, fp) for each distinct score, counting pairs at that score or more; and the number of true pairs.

    A pair scored several times counts at its highest score. Scores are compressed to distinct values before the running
    sum, whose windows are range partitions with the totals of the partitions above added.
    """
    best = scored.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"), F.col(score).cast("double").alias("s")).filter("s is not null and not isnan(s)").groupBy("p", "q").agg(F.max("s").alias("s"))
    true = _pairs(truth, a, b).withColumn("y", F.lit(1))
    cells, above = range_parts(best.join(true, ["p", "q"], "left").groupBy("s").agg(F.count("y").alias("t"), F.count(F.lit(1)).alias("n")), F.desc("s"))
    sums = cells.groupBy("__p").agg(F.sum("t").alias("st"), F.sum("n").alias("sn"))  # one row per partition
    offsets = sums.select("__p", F.coalesce(F.sum("st").over(above), F.lit(0)).alias("ot"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("on"))
    inside = Window.partitionBy("__p").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.join(F.broadcast(offsets), "__p").select(F.col("s").alias("threshold"), (F.col("ot") + F.sum("t").over(inside)).alias("tp"), (F.col("on") + F.sum("n").over(inside)).alias("n"))
    return rows.select("threshold", "tp", (F.col("n") - F.col("tp")).alias("fp")), true.count()


def roc_curve(scored: DataFrame, truth: DataFrame, all_pairs_count: int | None = None, a: str = "left_id", b: str = "right_id", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for the distinct scores and one value below the smallest; fpr is 0 without ``all_pairs_count``."""
    rows, positives = _by_threshold(scored, truth, a, b, score)
    below = rows.agg((F.min("threshold") - 1.0).alias("threshold"), F.max("tp").alias("tp"), F.max("fp").alias("fp")).filter("threshold is not null")
    negatives = 0 if all_pairs_count is None else all_pairs_count - positives
    rate = lambda c, n: (F.col(c) / n if n > 0 else F.lit(0.0))
    return rows.unionByName(below).select("threshold", rate("fp", negatives).alias("fpr"), rate("tp", positives).alias("tpr"))


def auc(curve: DataFrame) -> DataFrame:
    """One row (auc): trapezoids under the curve in the order (fpr, tpr), inside range partitions and between their ends."""
    points, above = range_parts(curve.groupBy("fpr").agg(F.min("tpr").alias("lo"), F.max("tpr").alias("hi")), "fpr")
    ends = points.groupBy("__p").agg(F.max(F.struct("fpr", "hi")).alias("end"))  # one row per partition
    before = ends.select("__p", F.max("end").over(above).alias("before"))
    inside = Window.partitionBy("__p").orderBy("fpr")
    area = points.join(F.broadcast(before), "__p").withColumn("x", F.coalesce(F.lag("fpr").over(inside), F.col("before.fpr"))).withColumn("y", F.coalesce(F.lag("hi").over(inside), F.col("before.hi")))
    return area.agg(F.coalesce(F.sum((F.col("fpr") - F.col("x")) * (F.col("y") + F.col("lo")) / 2), F.lit(0.0)).alias("auc"))


CRITERIA = ("f1", "precision", "recall")


def _criterion(name: str) -> str:
    if name not in CRITERIA:
        raise ValueError(f"unknown criterion {name!r}: {', '.join(CRITERIA)}")
    return name


def optimal_threshold(scored: DataFrame, truth: DataFrame, criterion: str = "f1", a: str = "left_id", b: str = "right_id", score: str = "score") -> DataFrame:
    """One row (threshold, f1, precision, recall): the best distinct score, the lowest of equally good ones; all 0 without pairs."""
    rows, positives = _by_threshold(scored, truth, a, b, score)
    rated = _rates(rows.withColumn("fn", F.lit(positives) - F.col("tp")))
    best = rated.agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct(F.col(_criterion(criterion)), -F.col("threshold"))).alias("b"))
    return best.select(*[F.coalesce(F.col(f"b.{c}"), F.lit(0.0)).alias(c) for c in ("threshold", "f1", "precision", "recall")])


def threshold_grid(df: DataFrame, score: str = "score", label: str = "label", n_thresholds: int = 100) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) at n + 1 equally spaced thresholds from the lowest to the highest score.

    One pass: a row adds to the highest grid step it reaches, and steps are summed from the top.
    """
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("boolean").alias("y")).filter("s is not null and y is not null")
    lo, hi = rows.agg(F.min("s"), F.max("s")).first()
    if lo is None:
        raise ValueError("no scores")
    if lo == hi:
        return df.sparkSession.createDataFrame([(lo, 0, 0, 0, 0.0, 0.0, 0.0)], "threshold double, tp long, fp long, fn long, precision double, recall double, f1 double")
    step = (hi - lo) / n_thresholds
    at = lambda i: F.lit(lo) + i * F.lit(step)  # noqa: E731 - the same expression for rows and grid
    guess = F.floor((F.col("s") - lo) / step)
    i = F.when(F.col("s") >= at(guess + 1), guess + 1).when(F.col("s") < at(guess), guess - 1).otherwise(guess)
    cells = rows.withColumn("i", F.least(i, F.lit(n_thresholds))).groupBy("i").agg(F.count_if("y").alias("t"), F.count_if(~F.col("y")).alias("f"))
    grid = df.sparkSession.range(n_thresholds + 1).join(cells, F.col("id") == F.col("i"), "left").na.fill(0, ["t", "f"])
    down = Window.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)  # n + 1 rows
    sums = grid.select(at(F.col("id")).alias("threshold"), F.sum("t").over(down).alias("tp"), F.sum("f").over(down).alias("fp"))
    whole = F.max("tp").over(Window.partitionBy())
    return _rates(sums.withColumn("fn", whole - F.col("tp")))


@dataclass
class ThresholdResult:
    threshold: float
    f1: float
    precision: float
    recall: float
    all_results: DataFrame


def optimize_threshold(df: DataFrame, score: str = "score", label: str = "label", criterion: str = "f1", n_thresholds: int = 100) -> ThresholdResult:
    grid = threshold_grid(df, score, label, n_thresholds)
    best: Row = grid.orderBy(F.desc(_criterion(criterion)), "threshold").first()
    return ThresholdResult(best["threshold"], best["f1"], best["precision"], best["recall"], grid)


class ActiveLearner:
    """Pairs nearest to the threshold are asked about; labels move the threshold between the classes."""

    def __init__(self, metric: str = "jaro_winkler", threshold: float = 0.85) -> None:
        self.metric, self.threshold = metric, threshold
        self.scored: DataFrame | None = None

    def score_pairs(self, records: DataFrame, index: str, value: str, candidates: DataFrame | None = None) -> DataFrame:
        """(left, right, left_value, right_value, score) of ``candidates`` (left_id, right_id), or of all pairs of a small table."""
        side = lambda n: records.select(F.col(index).alias(n), F.col(value).alias(f"{n}_value"))
        if candidates is None:
            pairs = side("left").join(side("right"), F.col("left") < F.col("right"))
        else:
            pairs = candidates.select(F.col("left_id").alias("left"), F.col("right_id").alias("right")).join(side("left"), "left").join(side("right"), "right")
        self.scored = pairs.withColumn("score", similarity.metric(self.metric)(F.col("left_value"), F.col("right_value"))).filter("score is not null").select("left", "right", "left_value", "right_value", "score")
        return self.scored

    def _known(self) -> DataFrame:
        if self.scored is None:
            raise ValueError("score pairs first")
        return self.scored

    def uncertain_pairs(self, n: int = 10) -> DataFrame:
        return self._known().orderBy(F.abs(F.col("score") - self.threshold), "left", "right").limit(n)

    def update_from_labels(self, labels: DataFrame) -> float:
        """labels: left, right, label (match or non_match)."""
        known = labels.select("left", "right", "label").join(self._known(), ["left", "right"])
        low, high = known.agg(F.min(F.when(F.col("label") == "match", F.col("score"))), F.max(F.when(F.col("label") != "match", F.col("score")))).first()
        if low is not None and high is not None:
            self.threshold = (low + high) / 2
        elif low is not None:
            self.threshold = low - 0.01
        elif high is not None:
            self.threshold = high + 0.01
        return self.threshold

    def classify(self) -> DataFrame:
        return self._known().withColumn("label", F.when(F.col("score") >= self.threshold, "match").otherwise("non_match"))
