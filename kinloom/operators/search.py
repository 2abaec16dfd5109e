"""Search tables: what in-memory indexes answer for one query, as DataFrames that answer many queries in one join.

Every index is built from (id, value), can be written and read as Parquet, and supports insert and remove by plain
DataFrame operations. Searches are exact scans or joins; only MinHash is approximate by design.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinloom.functions import similarity
from kinloom.functions.tokenizers import ngram_tokenize, whitespace_tokenize
from kinloom.operators import blocking
from kinloom.operators.matching import within_edits, within_one_edit


class _Table:
    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def __len__(self) -> int:
        return self.rows.count()

    def contains(self, value: str) -> bool:
        return bool(self.rows.filter(F.col("value") == value).limit(1).count())

    __contains__ = contains

    def remove(self, row_id) -> bool:
        """Drop the rows of an id; whether there were any."""
        there = bool(self.rows.filter(F.col("id") == row_id).limit(1).count())
        self.rows = self.rows.filter((F.col("id") != row_id) | F.col("id").isNull())
        return there

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    def memory_usage(self) -> int:
        """Estimated bytes from the optimizer's statistics."""
        return int(self.rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())

    def memory_usage_human(self) -> str:
        n, units = float(self.memory_usage()), ["B", "KB", "MB", "GB", "TB"]
        while n >= 1024 and len(units) > 1:
            n, units = n / 1024, units[1:]
        return f"{n:.1f} {units[0]}"


def _base(df: DataFrame, row_id: str, value: str) -> DataFrame:
    return df.select(F.col(row_id).alias("id"), F.col(value).alias("value")).filter("value is not null")


class NearestIndex(_Table):
    """Range and nearest-neighbour search under any metric: edit distances (whole numbers) or 1 - similarity.

    Levenshtein searches prune by length and stop early inside the built-in; others scan. Ties go by id.
    """

    DISTANCES = {"levenshtein": similarity.levenshtein, "damerau_levenshtein": similarity.damerau_levenshtein}

    def __init__(self, rows: DataFrame, metric: str = "levenshtein") -> None:
        super().__init__(rows)
        if metric != "hamming" and metric not in self.DISTANCES:
            similarity.metric(metric)
        self.metric = metric

    @classmethod
    def build(cls, df: DataFrame, row_id: str = "id", value: str = "value", metric: str = "levenshtein") -> "NearestIndex":
        return cls(_base(df, row_id, value), metric)

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: str = "levenshtein") -> "NearestIndex":
        return cls(spark.read.parquet(path), metric)

    def insert(self, df: DataFrame, row_id: str = "id", value: str = "value") -> None:
        self.rows = self.rows.unionByName(_base(df, row_id, value))

    def rebuild(self) -> None:
        """Nothing to balance; kept so that callers of tree indexes need no change."""

    def _distance(self, q: Column) -> Column:
        v = F.col("value")
        if self.metric == "hamming":
            return F.when(F.length(v) == F.length(q), similarity.hamming(F.when(F.length(v) == F.length(q), v), q))
        if self.metric in self.DISTANCES:
            return self.DISTANCES[self.metric](v, q)
        return 1.0 - similarity.metric(self.metric)(v, q)

    def find_within(self, query: str, max_distance: float) -> DataFrame:
        """(id, value, distance) at ``max_distance`` or less, nearest first."""
        if self.metric == "levenshtein":
            met = self.rows.filter(F.abs(F.length("value") - len(query)) <= int(max_distance)).withColumn("distance", F.levenshtein("value", F.lit(query), int(max_distance))).filter("distance >= 0")
        else:
            met = self.rows.withColumn("distance", self._distance(F.lit(query))).filter(F.col("distance") <= max_distance + 1e-12)
        return met.select("id", "value", "distance").orderBy("distance", "id")

    def find_within_all(self, queries: DataFrame, max_distance: float, query: str = "query") -> DataFrame:
        """(query, id, value, distance) for a table of queries. Edit distances find candidates by q-grams, or for one edit by values
        without a letter, distinct values against distinct queries; other metrics are read as a stated query set against all rows."""
        q = queries.select(F.col(query).alias("query")).filter("query is not null").distinct()
        rows = self.rows
        if self.metric in self.DISTANCES:
            touched = 2 if self.metric == "levenshtein" else 3
            values = rows.select("value").distinct()
            if int(max_distance) <= 1:
                met = within_one_edit(q, values, "query", "value")
            else:
                met = within_edits(q, values, "query", "value", (), lambda _: F.lit(int(max_distance)), touched)
            d = F.levenshtein("value", "query", int(max_distance)) if touched == 2 else self._distance(F.col("query"))
            near = met.withColumn("distance", d).filter((F.col("distance") >= 0) & (F.col("distance") <= int(max_distance)))
            return rows.join(near.distinct(), "value").select("query", "id", "value", "distance")
        met = rows.join(q, F.lit(True)).withColumn("distance", self._distance(F.col("query")))
        return met.filter(F.col("distance") <= max_distance + 1e-12).select("query", "id", "value", "distance")

    def find_nearest(self, query: str, k: int = 1) -> DataFrame:
        return self.rows.withColumn("distance", self._distance(F.lit(query))).filter("distance is not null").orderBy("distance", "id").limit(k)


class PostingsIndex(_Table):
    """Values by shared items: n-grams (case-sensitive) or lower-case words. A search counts, over the items of the query,
    the postings they meet: products of multiplicities."""

    def __init__(self, rows: DataFrame, kind: str) -> None:
        super().__init__(rows)
        self.kind = kind

    @staticmethod
    def _items(c: Column, kind: str) -> Column:
        name, _, n = kind.partition(":")
        if name == "whitespace" and not n:
            return F.transform(whitespace_tokenize(c), F.lower)
        if name == "ngram" and n.isdigit() and int(n) > 0:
            return ngram_tokenize(c, int(n))
        raise ValueError(f"unknown kind of postings {kind!r}: whitespace or ngram:<n>")

    @classmethod
    def build(cls, df: DataFrame, row_id: str = "id", value: str = "value", kind: str = "ngram:2") -> "PostingsIndex":
        return cls(_base(df, row_id, value).withColumn("items", cls._items(F.col("value"), kind)), kind)

    @classmethod
    def load(cls, spark: SparkSession, path: str, kind: str) -> "PostingsIndex":
        return cls(spark.read.parquet(path), kind)

    def insert(self, df: DataFrame, row_id: str = "id", value: str = "value") -> None:
        self.rows = self.rows.unionByName(self.build(df, row_id, value, self.kind).rows)

    def postings(self) -> DataFrame:
        return self.rows.select("id", F.explode("items").alias("item")).groupBy("item", "id").agg(F.count(F.lit(1)).alias("n"))

    def vocab_size(self) -> int:
        return self.rows.select(F.explode("items").alias("i")).distinct().count()

    def write_postings(self, path: str) -> None:
        """One row per (item, id), sorted by item within files so that a search for a few items prunes row groups."""
        self.postings().repartitionByRange("item").sortWithinPartitions("item").write.mode("overwrite").parquet(path)

    @staticmethod
    def search_postings(postings: DataFrame, kind: str, queries: DataFrame, threshold: int = 1, query: str = "query") -> DataFrame:
        """(query, id, shared) from a postings table, for a table of queries."""
        q = queries.select(F.col(query).alias("query")).filter("query is not null").distinct()
        items = q.select("query", F.explode(PostingsIndex._items(F.col("query"), kind)).alias("item")).groupBy("query", "item").agg(F.count(F.lit(1)).alias("m"))
        met = items.join(postings, "item").groupBy("query", "id").agg(F.sum(F.col("m") * F.col("n")).alias("shared"))
        return met.filter(F.col("shared") >= threshold)

    def search_all(self, queries: DataFrame, threshold: int = 1, query: str = "query") -> DataFrame:
        return self.search_postings(self.postings(), self.kind, queries, threshold, query)

    def search(self, query: str, threshold: int = 1) -> DataFrame:
        """(id, value, shared) of values that share ``threshold`` or more, most first, ties by id."""
        one = self.rows.sparkSession.createDataFrame([(query,)], "query string")
        return self.search_all(one, threshold).join(self.rows.select("id", "value"), "id").select("id", "value", "shared").orderBy(F.desc("shared"), "id")

    def search_top_k(self, query: str, k: int) -> DataFrame:
        return self.search(query, 1).limit(k)


class MinHashIndex(_Table):
    """Signatures and bands of values; a query meets values with an equal band and keeps those of an estimated Jaccard
    similarity (share of equal signature places) at a threshold. One shuffle on the bands serves all queries."""

    def __init__(self, rows: DataFrame, num_hashes: int = 100, num_bands: int = 20, shingle: int = 3) -> None:
        super().__init__(rows)
        self.num_hashes, self.num_bands, self.shingle = num_hashes, num_bands, shingle

    @classmethod
    def build(cls, df: DataFrame, row_id: str = "id", value: str = "value", num_hashes: int = 100, num_bands: int = 20, shingle: int = 3) -> "MinHashIndex":
        return cls(_base(df, row_id, value).withColumn("signature", blocking.minhash_signature(F.col("value"), num_hashes, shingle)), num_hashes, num_bands, shingle)

    @classmethod
    def load(cls, spark: SparkSession, path: str, num_hashes: int = 100, num_bands: int = 20, shingle: int = 3) -> "MinHashIndex":
        return cls(spark.read.parquet(path), num_hashes, num_bands, shingle)

    def insert(self, df: DataFrame, row_id: str = "id", value: str = "value") -> None:
        self.rows = self.rows.unionByName(self.build(df, row_id, value, self.num_hashes, self.num_bands, self.shingle).rows)

    def query_all(self, queries: DataFrame, threshold: float = 0.5, query: str = "query") -> DataFrame:
        """(query, id, similarity)."""
        q = queries.select(F.col(query).alias("query")).filter("query is not null").distinct().withColumn("qs", blocking.minhash_signature(F.col("query"), self.num_hashes, self.shingle))
        q, full = q.filter("size(qs) > 0"), self.rows.filter("size(signature) > 0")
        cut = lambda c: F.explode(blocking.bands(c, self.num_hashes, self.num_bands))
        met = q.select("query", cut(F.col("qs")).alias("band")).join(full.select("id", cut(F.col("signature")).alias("band")), "band").select("query", "id").distinct()
        equal = F.size(F.filter(F.zip_with("qs", "signature", lambda x, y: x == y), lambda e: e)) / self.num_hashes
        return met.join(q, "query").join(self.rows.select("id", "signature"), "id").withColumn("similarity", equal).filter(F.col("similarity") >= threshold).select("query", "id", "similarity")

    def query(self, value: str, threshold: float = 0.5) -> DataFrame:
        one = self.rows.sparkSession.createDataFrame([(value,)], "query string")
        return self.query_all(one, threshold).drop("query").orderBy(F.desc("similarity"), "id")


class BloomFilter:
    """Approximate membership: k positions of m bits per value. The set positions are a DataFrame of 64-bit words built by
    one aggregation, so the filter is as large as its parameters say, never as its input."""

    def __init__(self, spark: SparkSession, expected: int = 1000, false_positive_rate: float = 0.01) -> None:
        if expected < 1 or not 0 < false_positive_rate < 1:
            raise ValueError("expected must be 1 or more and the rate between 0 and 1")
        self.spark = spark
        self.bits = max(64, math.ceil(-expected * math.log(false_positive_rate) / math.log(2) ** 2))
        self.hashes = max(1, math.ceil(self.bits / expected * math.log(2)))
        self.inserted = 0
        self.words = spark.createDataFrame([], "word long, mask long")

    def positions(self, c: Column) -> Column:
        h1, h2 = (F.pmod(h, F.lit(self.bits)) for h in (F.xxhash64(c), F.xxhash64(F.lit(1), c)))
        return F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda i: (h1 + i * h2) % F.lit(self.bits))

    def insert(self, df: DataFrame, value: str) -> None:
        from kinloom.session import materialise

        rows = df.select(F.col(value).alias("v")).filter("v is not null")
        spots = rows.select(F.explode(self.positions(F.col("v"))).alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("mask"))
        self.words = materialise(self.words.unionByName(spots).groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")), "bloom")
        self.inserted += rows.count()

    def contains(self, df: DataFrame, value: str, name: str = "maybe") -> DataFrame:
        """Adds a boolean column; false is certain, true may be wrong at the estimated rate; null values are not members."""
        asked = df.select(F.col(value).alias("__bloom")).filter("__bloom is not null").distinct()
        spots = asked.select("__bloom", F.explode(F.array_distinct(self.positions(F.col("__bloom")))).alias("p"))
        hit = spots.join(self.words, F.shiftright("p", 6) == F.col("word"), "left")
        known = hit.groupBy("__bloom").agg(F.bool_and(F.coalesce(F.expr("(mask & shiftleft(1L, cast(p & 63 as int))) <> 0"), F.lit(False))).alias(name))
        return df.join(known, df[value] == known["__bloom"], "left").drop("__bloom").na.fill({name: False})

    def estimated_fp_rate(self) -> float:
        return (1 - math.exp(-self.hashes * self.inserted / self.bits)) ** self.hashes

    def memory_usage(self) -> int:
        return self.bits // 8

    def __len__(self) -> int:
        return self.inserted
