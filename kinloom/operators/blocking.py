"""Candidate generation: each blocker is a key projection and an equi-join that gives (left_id, right_id).

Deduplication (``right`` is None) gives each unordered pair once, smaller id left; linking gives (left, right) pairs.
Records whose key is null never pair. Keys are computed once per record, before the join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.functions import phonetic, registry, similarity
from kinloom.functions.tokenizers import let, ngram_tokenize
from kinloom.session import materialise

#: A record of a block with more members than this meets them in slices, so that no reducer holds a whole hot block.
SLICE = 500


def _side(df: DataFrame, id_col: str, keys: Column, name: str, *more: Column) -> DataFrame:
    return df.select(F.col(id_col).alias(name), keys.alias("key"), *more).filter("key is not null")


def _sliced(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b joined on key. Keys with many rows of ``b`` are cut into slices by a hash of right_id, and the rows of ``a`` are
    replicated to the slices of their key, so the work on one hot key is spread over many tasks."""
    sizes = b.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SLICE).select("key", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    # Only keys with more than SLICE rows are listed: at most rows / SLICE of them; the shuffle join lets AQE broadcast them if small.
    a = a.join(sizes, "key", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices") - 1, F.lit(0))))).drop("slices")
    b = b.join(sizes, "key", "left").withColumn("slice", F.pmod(F.xxhash64("right_id"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    # A given number of partitions: by the size of their few input rows they would be merged, though their output is large.
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(n, "key", "slice").join(b.repartition(n, "key", "slice"), ["key", "slice"])


def _meet(left: DataFrame, right: DataFrame | None, id_col: str, key: Callable[[DataFrame], Column], exploded: bool = False, carry: Sequence[str] = (), band: tuple[str, float] | None = None) -> DataFrame:
    """Pairs with an equal key; see _sliced for hot keys. Columns in ``carry`` come along as left__ and right__ columns, which
    saves looking them up by id afterwards. ``band`` names a number without NaN and how far it may differ at most: pairs
    that differ by two such bands or more need not meet."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        k = F.explode(F.array_distinct(key(df))) if exploded else key(df)
        more = [F.col(f"`{c}`").alias(f"{name}__{c}") for c in carry]
        if band is None:
            return _side(df, id_col, k, f"{name}_id", *more)
        x = df[band[0]].try_cast("double")
        at = F.when(x.isNotNull(), F.floor(F.least(F.greatest(x / F.lit(band[1] * (1 + 1e-6)), F.lit(-1e9)), F.lit(1e9))))
        # Each pair meets once: the left side names its band and both neighbours, the right side its own.
        near = F.explode(F.array(at - 1, at, at + 1)) if name == "left" else at
        rows = df.select(F.col(id_col).alias(f"{name}_id"), k.alias("k"), near.alias("band"), *more).filter("k is not null and band is not null")
        return rows.select(f"{name}_id", F.struct("k", "band").alias("key"), *[f"`{name}__{c}`" for c in carry])

    pairs = _sliced(keyed(left, "left"), keyed(left if right is None else right, "right"))
    if right is None:
        pairs = pairs.filter("left_id < right_id")
    pairs = pairs.select("left_id", "right_id", *[f"`{side}__{c}`" for side in ("left", "right") for c in carry])
    return pairs.distinct() if exploded else pairs


def exact(left: DataFrame, right: DataFrame | None, field: str, id_col: str = "id", carry: Sequence[str] = (), band: tuple[str, float] | None = None) -> DataFrame:
    return _meet(left, right, id_col, lambda d: d[field], carry=carry, band=band)


def phonetic_code(left: DataFrame, right: DataFrame | None, field: str, algorithm: str = "soundex", id_col: str = "id", carry: Sequence[str] = (), band: tuple[str, float] | None = None) -> DataFrame:
    return _meet(left, right, id_col, lambda d: phonetic.encode(d[field], algorithm), carry=carry, band=band)


def numeric(left: DataFrame, right: DataFrame | None, field: str, bucket_size: float = 5.0, id_col: str = "id") -> DataFrame:
    """Same or adjacent bucket of floor(value / size): the left side names its bucket, the right side that and both neighbours."""
    bucket = lambda d: F.floor(d[field].cast("double") / bucket_size)
    a = _side(left, id_col, bucket(left), "left_id")
    r = left if right is None else right
    b = _side(r, id_col, F.explode(F.when(bucket(r).isNotNull(), F.array(bucket(r) - 1, bucket(r), bucket(r) + 1))), "right_id")
    pairs = _sliced(a, b)
    return (pairs.filter("left_id < right_id") if right is None else pairs).select("left_id", "right_id")


def date(left: DataFrame, right: DataFrame | None, field: str, resolution: str = "year", id_col: str = "id", carry: Sequence[str] = (), band: tuple[str, float] | None = None) -> DataFrame:
    """Equal first one, two or three parts of a date text."""
    parts = {"year": 1, "month": 2, "day": 3}
    if resolution not in parts:
        raise ValueError(f"unknown date resolution {resolution!r}: year, month or day")
    return _meet(left, right, id_col, lambda d: F.substring_index(d[field].cast("string"), "-", parts[resolution]), carry=carry, band=band)


def qgram(left: DataFrame, right: DataFrame | None, field: str, q: int = 3, threshold: int = 1, id_col: str = "id") -> DataFrame:
    """Pairs whose lower-case q-grams co-occur at least ``threshold`` times, counting products of multiplicities; a shorter string is its own gram."""

    def grams(d: DataFrame, name: str) -> DataFrame:
        low = F.lower(d[field])
        g = F.when(F.length(low) < q, F.array(low)).otherwise(ngram_tokenize(low, q))
        return _side(d, id_col, F.explode(g), name).groupBy(name, "key").agg(F.count(F.lit(1)).alias(f"n_{name}"))

    a, b = grams(left, "left_id"), grams(left if right is None else right, "right_id")
    pairs = _sliced(a, b)
    if right is None:
        pairs = pairs.filter("left_id < right_id")
    pairs = pairs.groupBy("left_id", "right_id").agg(F.sum(F.col("n_left_id") * F.col("n_right_id")).alias("n"))
    return pairs.filter(F.col("n") >= threshold).select("left_id", "right_id")


def minhash_signature(c: Column, num_hashes: int = 100, shingle: int = 3) -> Column:
    """array<long>: for each of num_hashes seeds the smallest hash over the lower-case character shingles; empty for empty text."""
    low = F.lower(c)
    shingles = F.when(F.length(low) < shingle, F.filter(F.array(low), lambda x: x != "")).otherwise(F.array_distinct(ngram_tokenize(low, shingle)))
    hashed = F.transform(shingles, lambda x: F.xxhash64(x))  # a text is hashed once per shingle, a long once per seed
    some = let(hashed, lambda s: F.transform(F.sequence(F.lit(1), F.lit(num_hashes)), lambda i: F.array_min(F.transform(s, lambda x: F.xxhash64(x, i)))))
    return F.when(F.length(low) > 0, some).when(c.isNotNull(), F.array().cast("array<bigint>"))


def bands(signature: Column, num_hashes: int, num_bands: int) -> Column:
    """array<long>: one hash per band of the signature; rows that do not divide evenly make one more band."""
    rows = max(1, num_hashes // num_bands)
    count = -(-num_hashes // rows)
    cut = let(signature, lambda s: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.xxhash64(i, F.slice(s, i * rows + 1, F.lit(rows)))))
    return cut


def lsh(left: DataFrame, right: DataFrame | None, field: str, num_hashes: int = 100, num_bands: int = 20, id_col: str = "id") -> DataFrame:
    """Pairs with any equal band of their MinHash signatures; empty texts have none."""

    def cut(df: DataFrame) -> DataFrame:
        full = df.filter(F.length(F.col(field)) > 0)
        return materialise(full.select(F.col(id_col).alias(id_col), bands(minhash_signature(F.col(field), num_hashes), num_hashes, num_bands).alias("bands")), "bands")

    return _meet(cut(left), None if right is None else cut(right), id_col, lambda d: d["bands"], exploded=True)


def ranked(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``rank``, the row number in a global order, without a single-partition window: range partitions are numbered
    inside, and the sizes of the partitions before are added (one row per partition)."""
    parts = df.select("*", F.struct(*order).alias("__o")).repartitionByRange("__o").withColumn("__p", F.spark_partition_id())
    parts = materialise(parts, "ranked")
    inside = Window.partitionBy("__p").orderBy("__o")
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return parts.join(F.broadcast(before), "__p").withColumn("rank", F.row_number().over(inside) + F.col("__b")).drop("__o", "__p", "__b")


def sorted_neighborhood(left: DataFrame, right: DataFrame | None, field: str, window: int = 3, id_col: str = "id") -> DataFrame:
    """Each record pairs with the next window - 1 in the order of the lower-case field; ties by side (left first), then id."""
    if window < 2:
        raise ValueError("the window must be 2 or more")
    rows = left.select(F.col(id_col).alias("id"), F.lower(field).alias("f"), F.lit(0).alias("side"))
    if right is not None:
        rows = rows.unionByName(right.select(F.col(id_col).alias("id"), F.lower(field).alias("f"), F.lit(1).alias("side")))
    placed = ranked(rows.filter("f is not null"), [F.col("f"), F.col("side"), F.col("id")])
    a = placed.select(F.col("id").alias("a"), F.col("side").alias("sa"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(window - 1)), lambda k: k + F.col("rank"))).alias("rank"))
    pairs = a.join(placed.select(F.col("id").alias("b"), F.col("side").alias("sb"), "rank"), "rank")
    if right is None:
        return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))
    return pairs.filter("sa <> sb").select(F.when(F.col("sa") == 0, F.col("a")).otherwise(F.col("b")).alias("left_id"), F.when(F.col("sa") == 0, F.col("b")).otherwise(F.col("a")).alias("right_id"))


def trie(left: DataFrame, right: DataFrame | None, field: str, min_prefix_len: int = 2, max_frequency: int = 100, id_col: str = "id") -> DataFrame:
    """Pairs with a common prefix of ``min_prefix_len`` or more that at most ``max_frequency`` records (of both sides) share.

    If a prefix is rare enough, so are its extensions: the shortest rare prefix of a record already holds every partner
    of its longer ones, so each record has exactly one key. It is looked for in windows of lengths that double: a record whose
    prefix at the end of a window is still frequent has none inside, so its prefixes there are not written out; and
    records that have found theirs share no longer prefix with those that have not.
    """
    rows = left.select(F.col(id_col).alias("id"), F.col(field).alias("f"), F.lit(0).alias("side"))
    if right is not None:
        rows = rows.unionByName(right.select(F.col(id_col).alias("id"), F.col(field).alias("f"), F.lit(1).alias("side")))
    active = materialise(rows.filter(F.length("f") >= min_prefix_len), "trie")
    found, start, width = [], min_prefix_len, 8
    while not active.isEmpty():
        end = start + width - 1
        rare_at = lambda keys: keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_frequency).select("key")
        ends = active.filter(F.length("f") >= end).select("id", "side", "f", F.substring("f", F.lit(1), F.lit(end)).alias("key"))
        open_ = active.filter(F.length("f") < end).unionByName(ends.join(rare_at(ends), "key").select("id", "f", "side"))
        # Counts of a length need all records that reach it: those whose end is frequent lend one row per length they share with others.
        inside = F.transform(F.sequence(F.lit(start), F.least(F.length("f"), F.lit(end))), lambda k: F.substring("f", F.lit(1), k))
        prefixes = open_.select("id", "side", F.posexplode(inside).alias("at", "key"))
        frequent = ends.join(rare_at(ends), "key", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        lent = frequent.select("n", F.explode(F.transform(F.sequence(F.lit(start), F.lit(end)), lambda k: F.substring("key", F.lit(1), k))).alias("key"))
        counts = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).unionByName(lent.select("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
        first = prefixes.join(counts.filter(F.col("n") <= max_frequency), "key").groupBy("id", "side").agg(F.min(F.struct("at", "key")).alias("k")).select("id", "side", F.col("k.key").alias("key"))
        found.append(materialise(first, "trie-keys"))
        active = materialise(active.filter(F.length("f") > end).join(found[-1], ["id", "side"], "left_anti"), "trie")
        start, width = end + 1, 2 * width
    if not found:
        return rows.select(F.col("id").alias("left_id"), F.col("id").alias("right_id")).limit(0)
    first = reduce(DataFrame.unionByName, found)
    # Prefixes of one length that contain each other are equal, so equal shortest rare prefixes are equal keys.
    a, b = first.select(F.col("id").alias("left_id"), "key", F.col("side").alias("sa")), first.select(F.col("id").alias("right_id"), "key", F.col("side").alias("sb"))
    pairs = a.join(b, "key").filter("left_id < right_id" if right is None else "sa = 0 and sb = 1")
    return pairs.select("left_id", "right_id")


def canopy(left: DataFrame, right: DataFrame | None, field: str, t_tight: float = 0.9, t_loose: float = 0.5, metric: str = "jaro_winkler", id_col: str = "id", coarse: str | None = None) -> DataFrame:
    """Canopies. Linking compares all pairs against ``t_loose``. Deduplication is greedy in id order: the first free record
    becomes a centre and gathers later free records at ``t_loose`` or more; those at ``t_tight`` or more are no longer free;
    all members of a canopy pair.

    The greedy order is sequential. Equal values behave alike, so it runs over distinct values, each standing at the
    place of its smallest id; ``coarse`` names a column within whose groups it runs independently (in parallel). Without it
    the distinct values of the field form one group.
    """
    score = similarity.scorer(metric)
    if right is not None:
        a, b = left.select(F.col(id_col).alias("left_id"), F.col(field).alias("va")), right.select(F.col(id_col).alias("right_id"), F.col(field).alias("vb"))
        values = a.select("va").filter("va is not null").distinct().join(b.select("vb").filter("vb is not null").distinct(), F.lit(True))
        near = values.withColumn("s", score(F.col("va"), F.col("vb"))).filter(F.col("s") >= t_loose).select("va", "vb")
        return a.join(near, "va").join(b, "vb").select("left_id", "right_id")
    from kinloom.functions import kernels

    kernel = similarity._BATCHED.get(metric)
    if kernel is None:
        raise ValueError(f"canopy deduplication needs one of {sorted(similarity._BATCHED)}")
    group = F.col(coarse) if coarse else F.lit(0)
    rows = left.select(F.col(id_col).alias("id"), F.col(field).alias("v"), group.alias("g")).filter("v is not null")
    values = rows.groupBy("g", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", kind="stable").reset_index(drop=True)
        free = [True] * len(pdf)
        v, out = pdf["v"], []
        for i in range(len(pdf)):
            if not free[i]:
                continue
            rest = [j for j in range(i, len(pdf)) if free[j]]
            s = kernels.pairwise(kernel, pd.Series([v[i]] * len(rest)), v.iloc[rest].reset_index(drop=True))
            members = [j for j, x in zip(rest, s) if x >= t_loose or j == i]
            out += [(v[i], v[j]) for j in members]
            for j, x in zip(rest, s):
                if x >= t_tight or j == i:
                    free[j] = False
        return pd.DataFrame([(pdf["g"][0], c, m) for c, m in out], columns=["g", "centre", "v"])

    kinds = dict(rows.dtypes)
    canopies = values.groupBy("g").applyInPandas(greedy, f"g {kinds['g']}, centre string, v string")
    member = rows.join(canopies, ["g", "v"])
    a, b = member.select("g", "centre", F.col("id").alias("left_id")), member.select("g", "centre", F.col("id").alias("right_id"))
    return a.join(b, ["g", "centre"]).filter("left_id < right_id").select("left_id", "right_id").distinct()


def custom(left: DataFrame, right: DataFrame | None, name: str) -> DataFrame:
    b = registry.blocker(name)
    return (b.block_dedup(left) if right is None else b.block_link(left, right)).select("left_id", "right_id")


def union(candidates: Sequence[DataFrame]) -> DataFrame:
    return candidates[0] if len(candidates) == 1 else reduce(DataFrame.unionByName, candidates).distinct()


def intersection(candidates: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, candidates)


BLOCKERS: dict[str, Callable[..., DataFrame]] = {
    "exact": exact,
    "phonetic": phonetic_code,
    "sorted_neighborhood": sorted_neighborhood,
    "qgram": qgram,
    "lsh": lsh,
    "canopy": canopy,
    "numeric": numeric,
    "date": date,
    "trie": trie,
}
