"""Joins and aggregations that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.session import materialise

#: At most this many keys can each hold total / MAX_HOT_KEYS rows or more: the bound on every broadcast made here.
MAX_HOT_KEYS = 20_000


def hot_keys(counted: DataFrame, count: str, total: int, max_keys: int = MAX_HOT_KEYS, at_least: int = 2) -> DataFrame:
    """Rows of ``counted`` (one row per key, with its row count) whose key holds at least ``total / max_keys`` rows.

    There can be no more than ``max_keys`` of them, whatever the data, so the result may be broadcast.
    """
    return counted.filter(F.col(count) >= F.lit(max(float(at_least), total / max_keys)))


def join_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], count: str, total: int, max_keys: int = MAX_HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (one row per key, ``count`` = rows of that key) without a hot reducer.

    Keys with ``total / max_keys`` rows or more (``max_keys`` of them at most) are joined by broadcast, where the rows
    already lie; all others are small groups by construction and are joined by shuffle. Null keys never join.
    """
    hot = hot_keys(lookup, count, total, max_keys)
    cold = lookup.join(F.broadcast(hot.select(*on)), on, "left_anti")
    by_broadcast = rows.join(F.broadcast(hot), on)
    by_shuffle = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.hint("merge"), on)
    return by_broadcast.unionByName(by_shuffle)


def salt(column: Column, buckets: int) -> Column:
    """A stable small integer from a column's value, for spreading a hot key over ``buckets`` reducers."""
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def range_parts(df: DataFrame, *order: Column | str) -> tuple[DataFrame, Window]:
    """(rows with __p, window over the parts before): rows in range partitions of ``order``, numbered by ``__p``.

    Windows inside a part never hold more than a partition, however many rows there are in all; what a part needs from
    those before it is one row per part.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "range-parts")
    return parts, Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
