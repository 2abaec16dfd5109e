"""Queries against candidates: best match, ranked matches, all-pairs scores, fuzzy joins, tf-idf."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinloom.functions import similarity
from kinloom.functions.similarity import CompositeScorer, Metric
from kinloom.functions.tokenizers import matching_tokens, ngram_tokenize

Scorer = str | CompositeScorer | Metric


def _scored(candidates: DataFrame, value: str, query: str | Column, scorer: Scorer, threshold: float | None) -> DataFrame:
    q = F.lit(query) if isinstance(query, str) else query
    out = candidates.withColumn("score", similarity.scorer(scorer)(q, F.col(value))).filter("score is not null")
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def match_batch(candidates: DataFrame, value: str, index: str, query: str, scorer: Scorer = "jaro_winkler", threshold: float | None = None, limit: int | None = None) -> DataFrame:
    """Candidates with their score, best first, equal scores by index; null candidates do not match."""
    out = _scored(candidates, value, query, scorer, threshold).orderBy(F.desc("score"), F.asc(index))
    return out if limit is None else out.limit(limit)


def match_best(candidates: DataFrame, value: str, index: str, query: str, scorer: Scorer = "jaro_winkler", threshold: float | None = None, ties: str = "first") -> DataFrame:
    """At most one row: the best candidate, of equal ones the one with the smallest index (``ties="first"``) or the largest ("last")."""
    if ties not in ("first", "last"):
        raise ValueError(f"ties must be first or last, not {ties!r}")
    order = F.asc(index) if ties == "first" else F.desc(index)
    return _scored(candidates, value, query, scorer, threshold).orderBy(F.desc("score"), order).limit(1)


def pairwise_similarity(df: DataFrame, a: str, b: str, scorer: Scorer = "jaro_winkler", name: str = "score") -> DataFrame:
    return df.withColumn(name, similarity.scorer(scorer)(F.col(a), F.col(b)))


def cdist(left: DataFrame, right: DataFrame, left_id: str, left_value: str, right_id: str, right_value: str, scorer: Scorer = "jaro_winkler") -> DataFrame:
    """(row, col, score) of all pairs: the product is the definition of this operator, so it suits small sides only. Each
    distinct pair of values is scored once."""
    a, b = left.select(F.col(left_id).alias("row"), F.col(left_value).alias("va")), right.select(F.col(right_id).alias("col"), F.col(right_value).alias("vb"))
    values = a.select("va").distinct().join(b.select("vb").distinct(), F.lit(True)).withColumn("score", similarity.scorer(scorer)(F.col("va"), F.col("vb")))
    return a.join(values, "va").join(b, "vb").select("row", "col", "score")


def cdist_local(spark: SparkSession, a: Sequence[str], b: Sequence[str], scorer: Scorer = "jaro_winkler") -> np.ndarray:
    """The matrix of scores of two short lists."""
    left, right = (spark.createDataFrame(list(enumerate(x)), "i long, v string") for x in (a, b))
    out = np.zeros((len(a), len(b)))
    for r in cdist(left, right, "i", "v", "i", "v", scorer).collect():
        out[r.row, r.col] = r.score
    return out


def column_match_best(c: Column, candidates: Sequence[str], scorer: Scorer = "jaro_winkler", threshold: float | None = None) -> Column:
    """struct<value, score, index> of the best of a few given candidates for every row; of equal ones the first."""
    f = similarity.scorer(scorer)
    options = F.array(*[F.struct(f(c, F.lit(v)).alias("score"), F.lit(-i).alias("order"), F.lit(v).alias("value"), F.lit(i).alias("index")) for i, v in enumerate(candidates)])
    best = F.array_max(F.filter(options, lambda o: o["score"].isNotNull()))
    found = F.struct(best["value"].alias("value"), best["score"].alias("score"), best["index"].alias("index"))
    return F.when(best.isNotNull() & (F.lit(threshold is None) | (best["score"] >= (threshold or 0.0))), found)


#: Rows up to which a side may be sent to every task.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame) -> bool:
    """Whether a table has at most BROADCAST_ROWS rows; counting stops there."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _by_letters(left: DataFrame, right: DataFrame, a: str, b: str, keys: Sequence[str], limit: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of rows equal in ``keys`` whose values have letters, in any order, that ``limit(a, b)`` edits can make equal: an
    edit adds at most one letter and takes at most one. Sets of letters meet each other, spread over tasks, before values do."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lettered = lambda df, c, name: df.withColumn(name, F.array_join(F.array_sort(F.split(F.col(c), "")), ""))

    def bags(df: DataFrame, name: str) -> DataFrame:
        # Of a letter that occurs twice, the occurrences are told apart.
        letters = F.split(F.col(name), "")
        return df.select(*keys, name).distinct().withColumn(f"{name}s", F.transform(letters, lambda x, i: F.concat(x, (i + 1 - F.array_position(letters, x)).cast("string"))))

    la, lb = lettered(left, a, "__ba"), lettered(right, b, "__bb")
    spread = bags(la, "__ba").repartition(n, "__ba")
    met = spread.join(bags(lb, "__bb"), list(keys)) if keys else spread.join(bags(lb, "__bb"), F.lit(True))
    x, y = F.col("__ba"), F.col("__bb")
    near = met.filter(F.abs(F.length(x) - F.length(y)) <= limit(x, y)).filter(F.greatest(F.length(x), F.length(y)) - F.size(F.array_intersect("__bas", "__bbs")) <= limit(x, y))
    return la.join(near.select(*keys, "__ba", "__bb"), [*keys, "__ba"]).join(lb, [*keys, "__bb"]).drop("__ba", "__bb")


def within_edits(left: DataFrame, right: DataFrame, a: str, b: str, keys: Sequence[str], edits: Callable[[Column], Column], touched: int = 2, limit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """All pairs of rows that are equal in ``keys`` and whose values ``a`` and ``b`` may be within ``edits(value)`` edits of each
    other, for both values, or within ``limit(a, b)`` edits; a superset of the pairs that are. Both follow from lengths alone.

    An edit touches at most ``touched`` bigrams (two; three if neighbours may change places). Of the rarest touched x edits + 1
    bigrams of two such values at least one is common, if they have so many; values too short for that meet each
    other by their letters, and longer ones under any bigram. So pairs meet over an equi-join and none is lost.
    """
    limit = limit or (lambda x, y: F.least(edits(x), edits(y)))
    short = lambda c: F.length(c) - 1 < touched * edits(F.col(c)) + 1

    def rare(df: DataFrame, c: str) -> DataFrame:
        rows = df.filter(~short(c)).select(*df.columns, F.posexplode(ngram_tokenize(F.col(c), 2)).alias("__at", "__g"))
        ranked = rows.join(counts, "__g").withColumn("__r", F.row_number().over(Window.partitionBy(c, *keys).orderBy("__n", "__g", "__at")))
        return ranked.filter(F.col("__r") <= touched * edits(F.col(c)) + 1).select(*df.columns, F.xxhash64("__g").alias("__m")).distinct()

    grams = lambda df, c: df.select(F.explode(ngram_tokenize(F.col(c), 2)).alias("__g"))
    counts = grams(left, a).unionByName(grams(right, b)).groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    every = lambda df, c: df.filter(short(c)).select(*df.columns, F.explode(ngram_tokenize(F.col(c), 2)).alias("__g")).withColumn("__g", F.xxhash64("__g")).withColumnRenamed("__g", "__m").distinct()
    on, long_a, long_b = ["__m", *keys], rare(left, a), rare(right, b)
    met = long_a.join(long_b.unionByName(every(right, b)), on).unionByName(every(left, a).join(long_b, on))
    met = met.filter(F.abs(F.length(a) - F.length(b)) <= limit(F.col(a), F.col(b))).drop("__m").distinct()
    return met.unionByName(_by_letters(left.filter(short(a)).distinct(), right.filter(short(b)).distinct(), a, b, keys, limit))


def within_one_edit(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs of rows whose values ``a`` and ``b`` may be within one edit or exchange of neighbours; a superset of the pairs that are.

    Such values are equal, or equal once a letter is struck out of one or both. So a value meets others under itself and under
    itself without each of its letters: as many keys as it has letters, however common its bigrams are.
    """

    def keyed(df: DataFrame, c: str) -> DataFrame:
        v = F.col(c)
        struck = F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: F.xxhash64(F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v)))))
        return df.select(*df.columns, F.explode(F.array_distinct(F.concat(F.array(F.xxhash64(v)), struck))).alias("__m"))

    met = keyed(left, a).join(keyed(right, b), "__m").filter(F.abs(F.length(a) - F.length(b)) <= 1)
    return met.drop("__m")


def near_values(left: DataFrame, right: DataFrame, a: str, b: str, keys: Sequence[str], scorer: Scorer, threshold: float) -> DataFrame:
    """All pairs of rows that are equal in ``keys`` and whose values ``a`` and ``b`` can reach ``threshold``.

    For Levenshtein similarity t, a value of n letters is within n (1 - t) / t edits of any partner: see within_edits. Other
    metrics have no such bound: there all values that are equal in ``keys`` meet.
    """
    if scorer != "levenshtein" or not 0.5 < threshold <= 1:
        # Spread by value: merged by the size of their few input rows, tasks would hold too much of the output.
        spread = left.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), a)
        return spread.join(F.broadcast(right) if bounded(right) else right, list(keys)) if keys else spread.join(right, F.lit(True))
    slack = (1 - threshold) / threshold
    most = lambda x, y: (1 - threshold) * F.greatest(F.length(x), F.length(y)) + 1e-9
    return within_edits(left, right, a, b, keys, lambda c: F.floor(F.length(c) * slack + 1e-9), limit=most)


def fuzzy_join(left: DataFrame, right: DataFrame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, scorer: Scorer = "jaro_winkler", threshold: float = 0.85, how: str = "inner", limit: int = 1, block: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Left columns, right columns with suffix _right, and _score: for each left row its ``limit`` best right rows at ``threshold`` or more.

    Equal scores go by the right value, then the right row's hash. ``how="left"`` keeps unmatched left rows with nulls.
    Only distinct values meet, and each distinct pair is scored once; ``block`` names (left, right) columns that must be
    equal. Levenshtein scores have candidates by q-grams (see near_values); for other metrics without ``block`` all
    distinct values meet.
    """
    lo, ro = left_on or on, right_on or on
    if lo is None or ro is None or (on is not None and (left_on or right_on)):
        raise ValueError("give either on, or both left_on and right_on")
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    for df, name in ((left, lo), (right, ro)):
        if name not in df.columns:
            raise ValueError(f"no column {name!r}")
    rows = left.withColumn("__l", F.struct(*[F.col(f"`{c}`") for c in left.columns]))
    keys = [f"__k{i}" for i in range(len(block))]
    lv = left.select(F.col(lo).alias("__a"), *[F.col(x).alias(k) for k, (x, _) in zip(keys, block)]).filter("__a is not null").distinct()
    rv = right.select(F.col(ro).alias("__b"), *[F.col(y).alias(k) for k, (_, y) in zip(keys, block)]).filter("__b is not null").distinct()
    pairs = near_values(lv, rv, "__a", "__b", keys, scorer, threshold)
    pairs = pairs.withColumn("_score", similarity.scorer(scorer)(F.col("__a"), F.col("__b"))).filter(F.col("_score") >= threshold)
    # Enough values for `limit` rows: every kept value has at least one right row.
    best = Window.partitionBy("__a", *keys).orderBy(F.desc("_score"), "__b")
    pairs = pairs.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= limit).drop("__n")
    named = right.select(*[F.col(f"`{c}`").alias(f"{c}_right") for c in right.columns], F.col(ro).alias("__b"), *[F.col(y).alias(k) for k, (_, y) in zip(keys, block)])
    per_value = Window.partitionBy("__b", *keys).orderBy(*[F.col(f"`{c}_right`").cast("string") for c in right.columns])
    named = named.withColumn("__r", F.row_number().over(per_value)).filter(F.col("__r") <= limit)
    found = pairs.join(named, ["__b", *keys])
    per_left = Window.partitionBy("__a", *keys).orderBy(F.desc("_score"), "__b", "__r")
    found = found.withColumn("__n", F.row_number().over(per_left)).filter(F.col("__n") <= limit).drop("__b", "__r", "__n")
    joined = rows.select("__l", F.col(lo).alias("__a"), *[F.col(x).alias(k) for k, (x, _) in zip(keys, block)]).join(found, ["__a", *keys], how)
    return joined.select(*[F.col("__l")[c].alias(c) for c in left.columns], *[F.col(f"`{c}_right`") for c in right.columns], "_score")


def fuzzy_merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str, scorer: Scorer = "jaro_winkler", threshold: float = 0.8, block: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Every left row that has a partner with its best one: left columns, right columns with suffix _right, and _score."""
    return fuzzy_join(left, right, left_on=left_on, right_on=right_on, scorer=scorer, threshold=threshold, how="inner", limit=1, block=block)


def deduplicate(df: DataFrame, index: str, value: str, scorer: Scorer = "jaro_winkler", threshold: float = 0.85) -> DataFrame:
    """(cluster_id, record_id): groups of two or more rows whose values are linked by scores at ``threshold`` or more."""
    from kinloom.operators.clustering import connected_components

    values = df.select(F.col(value).alias("v")).filter("v is not null").distinct()
    near = near_values(values.withColumnRenamed("v", "a"), values.withColumnRenamed("v", "b"), "a", "b", (), scorer, threshold).filter("a < b")
    near = near.withColumn("s", similarity.scorer(scorer)(F.col("a"), F.col("b"))).filter(F.col("s") >= threshold)
    first = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.min(index).alias("first"))
    across = near.join(first.withColumnRenamed("v", "a").withColumnRenamed("first", "p"), "a").join(first.withColumnRenamed("v", "b").withColumnRenamed("first", "q"), "b").select("p", "q")
    same = df.select(F.col(index).alias("q"), F.col(value).alias("v")).join(first, "v").select(F.col("first").alias("p"), "q").filter("p <> q")
    return connected_components(across.unionByName(same), "p", "q")


class TfIdf:
    """Cosine of tf-idf vectors; idf = ln(documents / documents with the token), without smoothing.

    The idf table stays a DataFrame: tokens of both sides are looked up by joins, so its size is no limit.
    """

    def __init__(self, idf: DataFrame, n_docs: int) -> None:
        self.idf, self.n_docs = idf, n_docs

    @classmethod
    def fit(cls, corpus: DataFrame, text: str) -> "TfIdf":
        n = corpus.count()
        df = corpus.select(F.explode(F.array_distinct(F.transform(matching_tokens(F.col(text)), F.lower))).alias("token")).groupBy("token").count()
        return cls(df.select("token", F.log(F.lit(float(max(n, 1))) / F.col("count")).alias("idf")), n)

    def vectors(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, token, w); unseen tokens weigh 0 and are left out."""
        toks = F.transform(matching_tokens(F.col(text)), F.lower)
        rows = df.select(F.col(key).alias("key"), toks.alias("t")).select("key", F.size("t").alias("n"), F.explode("t").alias("token"))
        tf = rows.groupBy("key", "token").agg((F.count(F.lit(1)) / F.first("n")).alias("tf"))
        return tf.join(self.idf, "token").select("key", "token", (F.col("tf") * F.col("idf")).alias("w")).filter("w <> 0")

    def scores(self, left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str, threshold: float | None = None) -> DataFrame:
        """(left_id, right_id, score) of all pairs with a common weighted token; every other pair has score 0."""
        unit = lambda v: v.join(v.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "key").select("key", "token", (F.col("w") / F.col("norm")).alias("w"))
        a = unit(self.vectors(left, left_key, left_text)).select(F.col("key").alias("left_id"), "token", F.col("w").alias("wa"))
        b = unit(self.vectors(right, right_key, right_text)).select(F.col("key").alias("right_id"), "token", F.col("w").alias("wb"))
        out = a.join(b, "token").groupBy("left_id", "right_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))
        return out if threshold is None else out.filter(F.col("score") >= threshold)

    def match_batch(self, query: str, candidates: DataFrame, key: str, text: str, threshold: float | None = None) -> DataFrame:
        """Candidates by falling score, ties by key; candidates without a common token score 0."""
        one = candidates.sparkSession.createDataFrame([(0, query)], "q int, text string")
        found = self.scores(one, candidates, "q", "text", key, text).select(F.col("right_id").alias(key), "score")
        out = candidates.join(found, key, "left").na.fill({"score": 0.0})
        return (out if threshold is None else out.filter(F.col("score") >= threshold)).orderBy(F.desc("score"), key)
