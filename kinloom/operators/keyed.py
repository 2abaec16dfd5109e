"""Per-key results when a few keys hold most of the rows, by value-frequency compression.

Rows are first grouped by (key, value), where map-side combining collapses repeated values, and only the weighted
values are grouped by key. What reaches a key's reducer is bounded by its distinct values, not by its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.operators.skew import range_parts


def weighted_values(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """(key, value, weight): how often each non-null value occurs under each non-null key."""
    value = F.col(value) if isinstance(value, str) else value
    return df.select(F.col(key).alias("key"), value.alias("value")).filter("key is not null and value is not null").groupBy("key", "value").agg(F.count(F.lit(1)).alias("weight"))


def value_profile(df: DataFrame, key: str, value: str | Column, percentiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Exact row count, distinct count, mode and discrete percentiles of ``value`` for every ``key``.

    Output: key, n, n_distinct, mode, mode_n, p<percent> for each percentile (the smallest value whose cumulative weight
    reaches that share of n). Ties of the mode go to the smallest value. Null keys and null values do not count; a key
    with only null values has no row; an empty table gives an empty result.

    The weighted values lie in range partitions of (key, value), so a key with very many distinct values, whatever they
    begin with, is cumulated in parallel: a part starts from the totals of the key's parts before it, one row each.
    """
    cells, _ = range_parts(weighted_values(df, key, value), "key", "value")
    # A range partition holds a run of values of a key: its totals are the offsets of the parts behind it.
    sums = cells.groupBy("key", "__p").agg(F.sum("weight").alias("part_n"), F.count(F.lit(1)).alias("part_distinct"), F.max("weight").alias("part_top"))
    before = Window.partitionBy("key").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")  # at most one row per partition
    offsets = sums.select(
        "key",
        "__p",
        F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("offset"),
        F.sum("part_n").over(whole).alias("n"),
        F.sum("part_distinct").over(whole).alias("n_distinct"),
        F.max("part_top").over(whole).alias("mode_n"),
    )
    inside = Window.partitionBy("__p", "key").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.join(offsets, ["key", "__p"]).withColumn("upto", F.col("offset") + F.sum("weight").over(inside))
    picks = [F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p), F.col("value"))).alias(f"p{p * 100:g}".replace(".", "_")) for p in percentiles]
    return placed.groupBy("key").agg(
        F.first("n").alias("n"),
        F.first("n_distinct").alias("n_distinct"),
        F.min(F.when(F.col("weight") == F.col("mode_n"), F.col("value"))).alias("mode"),
        F.first("mode_n").alias("mode_n"),
        *picks,
    )


def direct_predecessors(df: DataFrame, key: str, time: str, row_id: str, value: str, within_seconds: int = 3600) -> DataFrame:
    """Row ids whose direct predecessor under the same key, in the order (time, id), has the same value and is near in time.

    Rows of a key are ordered by ``time``, then ``row_id`` (code points). A row is returned if the row just before it has
    the same stored non-null ``value`` and lies at most ``within_seconds`` earlier. Null keys, times and ids are left out;
    ids must be unique; an empty table gives an empty result.

    No key is ever sorted as a whole:

    1. rows are compressed to cells (key, time) that carry their number and their first and last row in id order;
       map-side combining makes a hot key as cheap as its distinct times;
    2. cells are compressed once more to slices (key, window of ``within_seconds``) that carry their last cell. The
       predecessor of a slice's first cell can matter only if it lies in the slice just before, so ordering happens
       inside a slice and the last cell of the slice before it is handed over by an equi-join;
    3. only cells with several rows are opened again: their rows are ordered by id in the same two-level way, with a
       prefix of the id as the slice, so that even one time that holds a third of all rows is split.
    """
    rows = df.select(F.col(key).alias("k"), F.col(time).alias("t"), F.col(row_id).alias("id"), F.col(value).alias("v")).filter("k is not null and t is not null and id is not null")
    end = F.struct(F.col("id").alias("id"), F.col("v").alias("v"))
    cells = rows.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("head"), F.max(end).alias("tail"))
    micros = F.unix_micros(F.col("t").cast("timestamp"))
    cells = cells.withColumn("us", micros).withColumn("slice", F.floor(F.col("us") / F.lit(within_seconds * 1_000_000)))
    ends = cells.groupBy("k", "slice").agg(F.max(F.struct("us", "tail")).alias("last"))
    handed = ends.select("k", (F.col("slice") + 1).alias("slice"), F.col("last.us").alias("before_us"), F.col("last.tail").alias("before"))
    in_slice = Window.partitionBy("k", "slice").orderBy("us")
    heads = (
        cells.join(handed, ["k", "slice"], "left")
        .withColumn("prev_us", F.coalesce(F.lag("us").over(in_slice), F.col("before_us")))
        .withColumn("prev_v", F.when(F.lag("us").over(in_slice).isNotNull(), F.lag("tail.v").over(in_slice)).otherwise(F.col("before.v")))
        .filter((F.col("us") - F.col("prev_us") <= within_seconds * 1_000_000) & (F.col("prev_v") == F.col("head.v")))
        .select(F.col("head.id").alias("id"))
    )
    # Rows that share their time with others: predecessor inside the cell, by id.
    shared = cells.filter("n > 1").select(
        "k",
        "t",
        (_common_prefix(F.col("head.id"), F.col("tail.id")) + 3).alias("width"),
    )
    opened = rows.join(shared, ["k", "t"]).withColumn("slice", F.expr("substring(id, 1, width)"))
    inner_ends = opened.groupBy("k", "t", "slice").agg(F.min(end).alias("head"), F.max(end).alias("tail"))
    by_slice = Window.partitionBy("k", "t").orderBy("slice")
    inner_heads = inner_ends.withColumn("prev_v", F.lag("tail.v").over(by_slice)).filter(F.col("prev_v") == F.col("head.v")).select(F.col("head.id").alias("id"))
    by_id = Window.partitionBy("k", "t", "slice").orderBy("id")
    inner = opened.withColumn("prev_v", F.lag("v").over(by_id)).filter(F.col("prev_v") == F.col("v")).select("id")
    return heads.unionByName(inner_heads).unionByName(inner).select(F.col("id").alias(row_id))


def _common_prefix(a: Column, b: Column) -> Column:
    both = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.size(same)
