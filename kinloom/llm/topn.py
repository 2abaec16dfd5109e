"""The N best items of every group: score histograms first, exact ranks only for what can still be among the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.operators.skew import MAX_HOT_KEYS, hot_keys

BINS = 256


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 5, max_hot: int = MAX_HOT_KEYS, spread: int = 64) -> DataFrame:
    """The ``n`` highest-scoring distinct items of every group.

    Output: group, item, score, rank. An item that occurs several times in a group counts once, with its highest score;
    higher scores come first, equal scores by the smaller item. Rows whose group, item or score is null, or whose score
    is NaN, do not count; a group with fewer than ``n`` items gives all; an empty table gives an empty result; other
    columns, whatever their names, are ignored.

    Groups that hold ``total / max_hot`` rows or more (``max_hot`` of them at most, so they may be broadcast) get a
    histogram of their scores. Every bin carries, besides its range, a bitmap of hashed items; the number of bits set in
    the union of the bins from the top down never exceeds the number of distinct items there, so the first bin at which
    it reaches ``n`` is a safe lower bound: at least ``n`` distinct items lie in or above it. Rows below are dropped where
    they lie, before any shuffle. The survivors are ranked exactly in ``spread`` parts per group (a part is a hash of
    the item, so repeated items meet) and the parts' best once more, so a flood of equal top scores meets no single task.
    All other groups are small by construction and are ranked after one shuffle by group.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s")).filter("g is not null and i is not null and s is not null and not isnan(s)")
    counted = rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    total = rows.count()
    hot = F.broadcast(hot_keys(counted, "rows", total, max_hot, at_least=8 * n).select("g", "lo", "hi"))
    words = max(1, -(-n // 12))
    spot = F.pmod(F.xxhash64("i"), F.lit(64 * words))
    binned = rows.join(hot, "g").withColumn("bin", _bin(F.col("s"), F.col("lo"), F.col("hi")))
    histogram = binned.select("g", "bin", *[F.when(F.floor(spot / 64) == w, F.expr(f"shiftleft(1L, cast(pmod(xxhash64(i), {64 * words}) % 64 as int))")).otherwise(F.lit(0).cast("long")).alias(f"m{w}") for w in range(words)])
    histogram = histogram.groupBy("g", "bin").agg(*[F.expr(f"bit_or(m{w})").alias(f"m{w}") for w in range(words)])
    down = Window.partitionBy("g").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    seen = sum((F.bit_count(F.expr(f"bit_or(m{w})").over(down)) for w in range(words)), F.lit(0))
    floors = histogram.select("g", "bin", seen.alias("seen")).filter(F.col("seen") >= n).groupBy("g").agg(F.max("bin").alias("floor"))
    floors = F.broadcast(hot.join(floors, "g", "left").select("g", "lo", "hi", F.coalesce("floor", F.lit(0)).alias("floor")))
    survivors = rows.join(floors, "g").filter(_bin(F.col("s"), F.col("lo"), F.col("hi")) >= F.col("floor")).select("g", "i", "s").withColumn("part", F.pmod(F.xxhash64("i"), F.lit(spread)))
    parts = _best(survivors, ["g", "part"], n).select("g", "i", "s")
    best_hot = _best(parts, ["g"], n)
    best_cold = _best(rows.join(hot.select("g"), "g", "left_anti"), ["g"], n)
    best = best_hot.unionByName(best_cold)
    return best.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("rank"))


def _bin(s: Column, lo: Column, hi: Column) -> Column:
    """Monotone bin number of a score inside its group's range; infinite ranges are folded by arctangent first."""
    wide = F.abs(hi - lo) == F.lit(float("inf"))
    x, a, b = (F.when(wide | F.isnan(hi - lo), F.atan(c)).otherwise(c) for c in (s, lo, hi))
    return F.when(b <= a, F.lit(0)).otherwise(F.floor((x - a) / (b - a) * (BINS - 1))).cast("int")


def _best(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Exact ranks within ``keys`` after one shuffle on them: repeated items and ranks are settled in the same partition."""
    once = rows.repartition(*keys).groupBy(*keys, "i").agg(F.max("s").alias("s"))
    order = Window.partitionBy(*keys).orderBy(F.desc("s"), F.asc("i"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("g", "i", "s", "rank")
