"""The operators for short Python lists instead of tables: one small job each, results as Python values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.functions import phonetic, text
from kinloom.operators import matching
from kinloom.operators.matching import Scorer


def _frame(spark: SparkSession, values: Sequence[str | None], name: str = "value") -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"i long, {name} string")


def match_best(spark: SparkSession, query: str, candidates: Sequence[str], scorer: Scorer = "jaro_winkler", threshold: float | None = None, ties: str = "first") -> tuple[str, float, int] | None:
    """(value, score, index) of the best candidate, of equal ones the first or the last; None if none reaches the threshold."""
    got = matching.match_best(_frame(spark, candidates), "value", "i", query, scorer, threshold, ties).first()
    return None if got is None else (got.value, got.score, got.i)


def match_batch(spark: SparkSession, query: str, candidates: Sequence[str], scorer: Scorer = "jaro_winkler", threshold: float | None = None, limit: int | None = None) -> list[tuple[str, float, int]]:
    return [(r.value, r.score, r.i) for r in matching.match_batch(_frame(spark, candidates), "value", "i", query, scorer, threshold, limit).collect()]


def pairwise_similarity(spark: SparkSession, a: Sequence[str], b: Sequence[str], scorer: Scorer = "jaro_winkler") -> list[float]:
    """Scores of the pairs of two lists of one length; another length is a ValueError."""
    if len(a) != len(b):
        raise ValueError(f"lists must have equal length: {len(a)} and {len(b)}")
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "i long, a string, b string")
    return [r.score for r in matching.pairwise_similarity(rows, "a", "b", scorer).orderBy("i").collect()]


def _mapped(spark: SparkSession, values: Sequence[str | None], f) -> list[str | None]:
    return [r.out for r in _frame(spark, values).select("i", f(F.col("value")).alias("out")).orderBy("i").collect()]


def phonetic_batch(spark: SparkSession, values: Sequence[str | None], algorithm: str = "soundex") -> list[str | None]:
    return _mapped(spark, values, lambda c: phonetic.encode(c, algorithm))


def preprocess_batch(spark: SparkSession, values: Sequence[str | None], operations: list[str]) -> list[str | None]:
    return _mapped(spark, values, lambda c: text.preprocess(c, operations))


def deduplicate(spark: SparkSession, values: Sequence[str | None], threshold: float = 0.85, scorer: Scorer = "jaro_winkler") -> list[list[int]]:
    """Groups of two or more places whose values are linked, each in order."""
    groups: dict[int, list[int]] = {}
    for r in matching.deduplicate(_frame(spark, values), "i", "value", scorer, threshold).orderBy("cluster_id", "record_id").collect():
        groups.setdefault(r.cluster_id, []).append(r.record_id)
    return list(groups.values())


cdist = matching.cdist_local
