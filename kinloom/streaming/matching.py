"""Matching on streams: stateless scoring, bounded batches, deduplication within a watermark, stateful clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinloom.functions import similarity
from kinloom.operators.clustering import IncrementalCluster


def match_stream(stream: DataFrame, value: str, query: str, scorer="jaro_winkler", threshold: float | None = None) -> DataFrame:
    """A stream (or table) with a score against one query; rows below the threshold or with a null value are dropped."""
    out = stream.withColumn("score", similarity.scorer(scorer)(F.col(value), F.lit(query))).filter("score is not null")
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def indexed(df: DataFrame, name: str = "index") -> DataFrame:
    """Adds the number of a row in the order of the table, from 0: rows are numbered inside partitions, and the sizes of the
    partitions before (one row each) are added. The table must give the same partitions when it is read twice."""
    schema = T.StructType([*df.schema.fields, T.StructField("__p", T.IntegerType()), T.StructField(name, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=[*b.schema.names, "__p", name])
            at += n

    rows = df.mapInArrow(number, schema)
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return rows.join(F.broadcast(before), "__p").withColumn(name, F.col(name) + F.col("__b")).drop("__p", "__b")


def match_iter(df: DataFrame, value: str, query: str, scorer="jaro_winkler", threshold: float | None = None) -> Iterator:
    """Rows one partition at a time, in the order of the table, with their ``index`` in it."""
    return match_stream(indexed(df), value, query, scorer, threshold).toLocalIterator(prefetchPartitions=True)


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream; ``max_files_per_trigger`` bounds a batch, which is how a slow consumer holds back the source."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        # a stream watches folders; a single file is the only one of its folder that is let through
        return reader.option("pathGlobFilter", where.getName()).load(where.getParent().toString())
    return reader.load(path)


def dedup_within_watermark(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; a repetition within ``delay`` is dropped and the state is bounded by it."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_matches(stream: DataFrame, value: str, time: str, query: str, window: str = "1 hour", delay: str = "10 minutes", scorer="jaro_winkler", threshold: float = 0.85) -> DataFrame:
    """(window, matches, best) per tumbling window of event time; late rows beyond the watermark are dropped."""
    hits = match_stream(stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay), value, query, scorer, threshold)
    return hits.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("matches"), F.max("score").alias("best"))


def incremental_clusters(stream: DataFrame, block: str, order: str, value: str, metric: str = "jaro_winkler", threshold: float = 0.85, timeout_ms: int | None = None) -> DataFrame:
    """(block, value, cluster, is_new, similarity): incremental clustering per block; the state is the representatives,
    kept for ever or dropped after ``timeout_ms`` without a row for the block (for queries that run on, not to an end)."""

    def assign(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = IncrementalCluster(metric, threshold)
        if state.exists:
            found.representatives = list(state.get[0])
            found.clusters = [[] for _ in found.representatives]
        frames = list(batches)
        rows = frames[0] if len(frames) == 1 else pd.concat(frames)
        if not (rows[order].is_monotonic_increasing and rows[order].is_unique):
            rows = rows.sort_values([order, value], kind="stable")
        values = [v for v in rows[value] if v is not None]
        got = [found.add_record(v) for v in values]
        state.update((found.representatives,))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"block": [str(key[0])] * len(got), "value": values, "cluster": [g[0] for g in got], "is_new": [g[1] for g in got], "similarity": [g[2] for g in got]})

    return stream.filter(F.col(block).isNotNull()).groupBy(block).applyInPandasWithState(assign, "block string, value string, cluster int, is_new boolean, similarity double", "representatives array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now to Parquet with exactly-once checkpoints and stop."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch of scored rows to ``handle(df, batch_id)``."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
