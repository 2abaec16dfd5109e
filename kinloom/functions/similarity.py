"""String similarity and distance as Spark columns. Null on either side gives null.

Metrics made of built-ins and higher-order functions stay in the JVM; dynamic programs run as Arrow UDFs on whole batches.
``metric(name)`` looks metrics up by name and applies the limit on string length; direct functions do not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from kinloom.functions import kernels, phonetic, phonetic_rules as rules, registry
from kinloom.functions.tokenizers import let, matching_tokens, ngram_tokenize, whitespace_tokenize

Metric = Callable[[Column, Column], Column]
_LIMIT = 10_000


def set_max_string_length(n: int) -> None:
    """Longer strings score 0.0 in lookups by name; 0 switches the limit off. Captured when a plan is built."""
    global _LIMIT
    _LIMIT = int(n)


def get_max_string_length() -> int:
    return _LIMIT


def _kernel(kernel, dtype: T.DataType = T.DoubleType(), **fixed) -> Metric:
    """An Arrow UDF around a batch kernel. Declared non-deterministic so that a filter on its result doesn't run it twice."""
    kind = pa.int32() if isinstance(dtype, T.IntegerType) else pa.float64()

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return kernels.pairwise_arrow(lambda *x: kernel(*x, **fixed), a, b, kind)

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, dtype).asNondeterministic()


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


# --- edit distances ------------------------------------------------------------------------------------------------------
def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return _both(a, b, F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest))


def levenshtein_threshold(a: Column, b: Column, max_distance: int) -> Column:
    """The distance, or null above ``max_distance``; the built-in stops early."""
    return F.nullif(F.levenshtein(a, b, max_distance), F.lit(-1))


damerau_levenshtein = _kernel(kernels.osa, T.IntegerType())
damerau_levenshtein_similarity = _kernel(kernels.osa_similarity)


def damerau_levenshtein_threshold(a: Column, b: Column, max_distance: int) -> Column:
    """Restricted Damerau-Levenshtein distance, or null above ``max_distance``; the lengths decide first."""
    near = F.abs(F.length(a) - F.length(b)) <= max_distance
    d = damerau_levenshtein(F.when(near, a), F.when(near, b))
    return F.when(d <= max_distance, d)


def hamming(a: Column, b: Column) -> Column:
    """Differing places; unequal lengths raise when the row is evaluated."""
    return F.when(F.length(a) == F.length(b), _differences(a, b)).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("hamming needs strings of equal length")).cast("int"))


def _differences(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def hamming_similarity(a: Column, b: Column) -> Column:
    """0.0 for unequal lengths."""
    n = F.length(a)
    return _both(a, b, F.when(n != F.length(b), 0.0).when(n == 0, 1.0).otherwise(1.0 - _differences(a, b) / n))


def weighted_levenshtein(a: Column, b: Column, insert_cost: float = 1.0, delete_cost: float = 1.0, substitute_cost: float = 1.0, transpose_cost: float = 1.0) -> Column:
    return _kernel(kernels.edit, insert=insert_cost, delete=delete_cost, substitute=substitute_cost, transpose=transpose_cost)(a, b)


def weighted_levenshtein_similarity(a: Column, b: Column, insert_cost: float = 1.0, delete_cost: float = 1.0, substitute_cost: float = 1.0, transpose_cost: float = 1.0) -> Column:
    return _kernel(kernels.weighted_similarity, insert=insert_cost, delete=delete_cost, substitute=substitute_cost, transpose=transpose_cost)(a, b)


# --- matching characters -------------------------------------------------------------------------------------------------
jaro = _kernel(kernels.jaro)


def jaro_winkler(a: Column, b: Column, prefix_weight: float = 0.1) -> Column:
    """The prefix counts whatever the Jaro score is."""
    return _kernel(kernels.jaro_winkler, weight=prefix_weight)(a, b)


lcs_length = _kernel(kernels.lcs_length, T.IntegerType())
lcs_similarity = _kernel(kernels.lcs_similarity)
longest_common_substring_length = _kernel(kernels.substring_length, T.IntegerType())
longest_common_substring_similarity = _kernel(kernels.substring_similarity)


def smith_waterman(a: Column, b: Column, match_score: float = 2.0, mismatch_penalty: float = -1.0, gap_penalty: float = -1.0) -> Column:
    return _kernel(kernels.smith_waterman, match=match_score, mismatch=mismatch_penalty, gap=gap_penalty)(a, b)


smith_waterman_similarity = _kernel(kernels.smith_waterman_similarity)
needleman_wunsch = _kernel(kernels.needleman_wunsch_similarity)
gotoh = _kernel(kernels.gotoh_similarity)


def _per_pair(f, a: pd.Series, b: pd.Series) -> list:
    """For what has no batch form: evaluated once per distinct pair of a batch."""
    seen: dict = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in seen:
            seen[x, y] = f(x, y)
        out.append(seen[x, y])
    return out


@F.pandas_udf(T.DoubleType())
def ratcliff_obershelp(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_per_pair(kernels.ratcliff_obershelp, a, b), dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("ops", T.ArrayType(T.StringType())), T.StructField("distance", T.IntegerType()), T.StructField("visual", T.StringType())]))
def levenshtein_align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = _per_pair(kernels.align, a, b)
    return pd.DataFrame([(None, None, None) if r is None else r for r in rows], columns=["ops", "distance", "visual"]).astype({"distance": "Int32"})


# --- n-grams and tokens --------------------------------------------------------------------------------------------------
def _counts(items: Column) -> Column:
    """map of item -> occurrences; items of one pair are few, so the quadratic count stays cheap."""
    return let(items, lambda all_: let(F.array_distinct(all_), lambda once: F.map_from_arrays(once, F.transform(once, lambda x: F.size(F.filter(all_, lambda y: y == x))))))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x)


def _with(x: Column, y: Column, use: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(x.alias("x"), y.alias("y")), lambda s: use(s["x"], s["y"]))


def cosine(a: Column, b: Column, n: int = 2) -> Column:
    """Cosine of n-gram counts; 1.0 if neither string has an n-gram, 0.0 if one has none."""

    def value(x: Column, y: Column) -> Column:
        dot = _sum(F.transform(F.map_keys(x), lambda k: (F.element_at(x, k) * F.coalesce(F.try_element_at(y, k), F.lit(0))).cast("double")))
        norm = lambda m: F.sqrt(_sum(F.transform(F.map_values(m), lambda v: (v * v).cast("double"))))
        return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(dot / (norm(x) * norm(y)))

    return _both(a, b, _with(_counts(ngram_tokenize(a, n)), _counts(ngram_tokenize(b, n)), value))


def _jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets, case-sensitive; CJK characters are tokens."""
    return _both(a, b, _with(matching_tokens(a), matching_tokens(b), _jaccard))


def sorensen_dice(a: Column, b: Column) -> Column:
    """Of bigrams with repeats; 1.0 if neither string has a bigram."""

    def value(x: Column, y: Column) -> Column:
        shared = _sum(F.transform(F.map_keys(x), lambda k: F.least(F.element_at(x, k), F.coalesce(F.try_element_at(y, k), F.lit(0))).cast("double")))
        total = F.greatest(F.length(a) - 1, F.lit(0)) + F.greatest(F.length(b) - 1, F.lit(0))
        return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)

    return _both(a, b, _with(_counts(ngram_tokenize(a, 2)), _counts(ngram_tokenize(b, 2)), value))


def ngram_similarity(a: Column, b: Column, n: int = 2) -> Column:
    """Jaccard of n-gram sets; 1.0 if neither string has an n-gram."""
    return _both(a, b, _with(ngram_tokenize(a, n), ngram_tokenize(b, n), _jaccard))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _with(F.array_join(F.array_sort(matching_tokens(a)), " "), F.array_join(F.array_sort(matching_tokens(b)), " "), levenshtein_similarity)


def token_set_ratio(a: Column, b: Column) -> Column:
    def value(x: Column, y: Column) -> Column:
        both = F.array_intersect(x, y)
        joined = lambda rest: F.array_join(F.concat(both, rest), " ")
        parts = F.struct(F.array_join(both, " ").alias("i"), joined(F.array_except(x, y)).alias("p"), joined(F.array_except(y, x)).alias("q"))
        best = let(parts, lambda s: F.greatest(levenshtein_similarity(s["i"], s["p"]), levenshtein_similarity(s["i"], s["q"]), levenshtein_similarity(s["p"], s["q"])))
        return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(best)

    return _both(a, b, _with(F.array_sort(F.array_distinct(matching_tokens(a))), F.array_sort(F.array_distinct(matching_tokens(b))), value))


def partial_ratio(a: Column, b: Column) -> Column:
    """Best similarity of the shorter string with a window of its length in the longer one."""
    a_first = F.length(a) <= F.length(b)

    def value(short: Column, long: Column) -> Column:
        k = F.length(short)
        best = F.array_max(F.transform(F.sequence(F.lit(1), F.length(long) - k + 1), lambda i: 1.0 - F.levenshtein(short, F.substring(long, i, k)) / k))
        return F.when(F.length(long) == 0, 1.0).when(k == 0, 0.0).otherwise(best)

    return _both(a, b, _with(F.when(a_first, a).otherwise(b), F.when(a_first, b).otherwise(a), value))


_BATCHED = {
    "jaro": kernels.jaro, "jaro_winkler": kernels.jaro_winkler, "damerau_levenshtein": kernels.osa_similarity, "lcs": kernels.lcs_similarity,
    "longest_common_substring": kernels.substring_similarity, "smith_waterman": kernels.smith_waterman_similarity, "needleman_wunsch": kernels.needleman_wunsch_similarity, "gotoh": kernels.gotoh_similarity,
}


def monge_elkan(a: Column, b: Column, inner_metric: str = "jaro_winkler") -> Column:
    """Mean over the tokens of ``a`` of their best similarity with a token of ``b``; not symmetric.

    Any metric may be the inner one. One of the JVM is nested in higher-order functions; the others score the token pairs
    of a batch in one go.
    """
    x, y = whitespace_tokenize(a), whitespace_tokenize(b)
    if inner_metric in _BATCHED or inner_metric in ("ratcliff_obershelp", "weighted_levenshtein", "monge_elkan", "phonetic_hybrid"):
        value = _token_means(inner_metric)(x, y)
    elif inner_metric in METRICS:
        inner = METRICS[inner_metric]
        value = _with(x, y, lambda p, q: _sum(F.transform(p, lambda s: F.greatest(F.lit(0.0), F.array_max(F.transform(q, lambda t: inner(s, t)))))) / F.size(p))
    else:
        raise ValueError(f"unknown inner metric {inner_metric!r}; known: {', '.join(METRICS)}")
    return _both(a, b, F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(value))


def _pair_scores(metric_name: str, left: pd.Series, right: pd.Series) -> list[float]:
    """Scores of many token pairs at once, for metrics that no JVM expression states."""
    if metric_name == "ratcliff_obershelp":
        return _per_pair(kernels.ratcliff_obershelp, left, right)
    if metric_name == "phonetic_hybrid":
        code = {t: rules.soundex(t) for t in pd.unique(pd.concat([left, right]))}
        edit = kernels.pairwise(kernels.jaro_winkler, left, right)
        return [0.3 * (code[p] == code[q]) + 0.7 * e for p, q, e in zip(left, right, edit)]
    # A single token is its own list: Monge-Elkan of two tokens is their Jaro-Winkler similarity.
    fixed = {"weighted_levenshtein": kernels.osa_similarity, "monge_elkan": kernels.jaro_winkler}
    return kernels.pairwise(fixed.get(metric_name) or _BATCHED[metric_name], left, right).tolist()


def _token_means(inner: str):
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = [], []
        for s, t in zip(x, y):
            if s is not None and t is not None:
                for p in s:
                    left += [p] * len(t)
                    right += list(t)
        scores = iter(_pair_scores(inner, pd.Series(left, dtype=object), pd.Series(right, dtype=object)))
        out = []
        for s, t in zip(x, y):
            if s is None or t is None or not len(s) or not len(t):
                out.append(None)
            else:
                out.append(sum(max(0.0, max(next(scores) for _ in t)) for _ in s) / len(s))
        return pd.Series(out, dtype="float64")

    return run


def phonetic_hybrid(a: Column, b: Column, phonetic_algorithm: str = "soundex", edit_metric: str = "jaro_winkler", phonetic_weight: float = 0.3) -> Column:
    same = (phonetic.encode(a, phonetic_algorithm) == phonetic.encode(b, phonetic_algorithm)).cast("double")
    return F.lit(phonetic_weight) * same + F.lit(1.0 - phonetic_weight) * metric(edit_metric)(a, b)


def dissimilarity(name: str) -> Metric:
    return lambda a, b: 1.0 - metric(name)(a, b)


#: Built-in metrics by name, all similarities in [0, 1].
METRICS: dict[str, Metric] = {
    "levenshtein": levenshtein_similarity,
    "damerau_levenshtein": damerau_levenshtein_similarity,
    "hamming": hamming_similarity,
    "jaro": jaro,
    "jaro_winkler": jaro_winkler,
    "cosine": cosine,
    "jaccard": jaccard,
    "sorensen_dice": sorensen_dice,
    "weighted_levenshtein": weighted_levenshtein_similarity,
    "token_sort": token_sort_ratio,
    "token_set": token_set_ratio,
    "partial_ratio": partial_ratio,
    "lcs": lcs_similarity,
    "longest_common_substring": longest_common_substring_similarity,
    "ngram_similarity": ngram_similarity,
    "smith_waterman": smith_waterman_similarity,
    "phonetic_hybrid": phonetic_hybrid,
    "ratcliff_obershelp": ratcliff_obershelp,
    "needleman_wunsch": needleman_wunsch,
    "gotoh": gotoh,
    "monge_elkan": monge_elkan,
}
#: Metrics that need a Python worker; the others are JVM expressions.
IN_PYTHON = frozenset({"damerau_levenshtein", "jaro", "jaro_winkler", "weighted_levenshtein", "lcs", "longest_common_substring", "smith_waterman", "phonetic_hybrid", "ratcliff_obershelp", "needleman_wunsch", "gotoh", "monge_elkan"})


def metric(name: str) -> Metric:
    """A built-in or registered metric by name; strings over the length limit score 0.0."""
    f = METRICS[name] if name in METRICS else registry.metric(name) if name in registry.registered("metric") else None
    if f is None:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    limit = _LIMIT
    if not limit:
        return f

    def guarded(a: Column, b: Column) -> Column:
        fits = F.greatest(F.length(a), F.length(b)) <= limit
        return F.when(_both(a, b, ~fits), 0.0).otherwise(f(F.when(fits, a), F.when(fits, b)))

    return guarded


def explain(a: Column, b: Column, algorithms: Sequence[str] | None = None) -> Column:
    """map of metric name -> score."""
    return F.create_map(*[x for name in (algorithms or METRICS) for x in (F.lit(name), metric(name)(a, b))])


class CompositeScorer:
    """Weighted mean of metrics; weights are scaled to sum to 1, only their sum must be positive."""

    PRESETS = {
        "name_matching": [("jaro_winkler", 0.5), ("token_sort", 0.3), ("phonetic_hybrid", 0.2)],
        "address_matching": [("token_set", 0.5), ("jaccard", 0.3), ("levenshtein", 0.2)],
        "general_purpose": [("jaro_winkler", 0.4), ("cosine", 0.4), ("token_sort", 0.2)],
    }

    def __init__(self, components: Sequence[tuple[str, float]]) -> None:
        if not components:
            raise ValueError("a composite scorer needs at least one component")
        total = sum(w for _, w in components)
        if total <= 0:
            raise ValueError("the weights must sum to a positive value")
        self.components = [(n, w / total) for n, w in components]
        for n, _ in components:
            metric(n)

    @classmethod
    def preset(cls, name: str) -> "CompositeScorer":
        if name not in cls.PRESETS:
            raise ValueError(f"unknown preset {name!r}: {', '.join(cls.PRESETS)}")
        return cls(cls.PRESETS[name])

    def __call__(self, a: Column, b: Column) -> Column:
        out = F.lit(0.0)
        for n, w in self.components:
            out = out + metric(n)(a, b) * F.lit(w)
        return out

    similarity = __call__


def name_matching() -> CompositeScorer:
    return CompositeScorer.preset("name_matching")


def address_matching() -> CompositeScorer:
    return CompositeScorer.preset("address_matching")


def general_purpose() -> CompositeScorer:
    return CompositeScorer.preset("general_purpose")


def scorer(s: str | CompositeScorer | Metric) -> Metric:
    return metric(s) if isinstance(s, str) else s
