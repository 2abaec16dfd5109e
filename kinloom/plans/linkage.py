"""The linkage plan: preprocess, block, compare, classify, cluster, as one lazy DataFrame plan built from a small config.

    pairs = (Linkage().preprocess("name", ["fold_case"]).block_exact("city").compare_string("name")
             .classify_threshold(0.85).dedup(df))

Nulls stay nulls: a missing field never blocks and scores 0.0. Scores and weights are in the order of the compare calls.
"""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from kinloom.functions import phonetic, registry, similarity, text
from kinloom.operators import blocking, clustering, comparing, training
from kinloom.session import materialise

MODES = ("union", "intersection")
#: Records that have the same fields this many times on average are judged by value; ids of a value come in chunks of this size.
REPEATED, CHUNK = 4, 1000


class Linkage:
    """Builder and plan in one. Every block_*, compare_*, classify_* and cluster_* call returns the plan itself."""

    def __init__(self, id_col: str = "id") -> None:
        self.id_col = id_col
        self.operations: dict[str, list[str]] = {}
        self.blockers: list[dict[str, Any]] = []
        self.mode = "union"
        self.comparators: list[dict[str, Any]] = []
        self.classifier: dict[str, Any] | None = None
        self.clusterer: dict[str, Any] = {"kind": "none"}
        self._profiling = False
        self._stats: dict[str, int] = {}
        self._model: Callable[[Column], Column] | None = None

    # --- configuration ---------------------------------------------------------------------------------------------------
    def preprocess(self, field: str, operations: Sequence[str]) -> "Linkage":
        """An ordered chain of text operations on one field; a later call for the field replaces it."""
        for name in operations:
            text.operation(name)
        self.operations[field] = list(operations)
        return self

    def preprocess_lowercase(self, fields: Sequence[str]) -> "Linkage":
        warnings.warn("use preprocess(field, ['fold_case'])", DeprecationWarning, stacklevel=2)
        for f in fields:
            self.preprocess(f, ["fold_case"])
        return self

    def _block(self, kind: str, field: str | None, **options) -> "Linkage":
        self.blockers.append({"kind": kind, "field": field, **options})
        return self

    def block_exact(self, field: str) -> "Linkage":
        return self._block("exact", field)

    def block_phonetic(self, field: str, algorithm: str = "soundex") -> "Linkage":
        phonetic.encode(F.lit("x"), algorithm)
        return self._block("phonetic", field, algorithm=algorithm)

    def block_sorted_neighborhood(self, field: str, window: int = 3) -> "Linkage":
        return self._block("sorted_neighborhood", field, window=window)

    def block_qgram(self, field: str, q: int = 3, threshold: int = 1) -> "Linkage":
        return self._block("qgram", field, q=q, threshold=threshold)

    def block_lsh(self, field: str, num_hashes: int = 100, num_bands: int = 20) -> "Linkage":
        return self._block("lsh", field, num_hashes=num_hashes, num_bands=num_bands)

    def block_canopy(self, field: str, t_tight: float = 0.9, t_loose: float = 0.5, metric: str = "jaro_winkler", coarse: str | None = None) -> "Linkage":
        return self._block("canopy", field, t_tight=t_tight, t_loose=t_loose, metric=metric, coarse=coarse)

    def block_numeric(self, field: str, bucket_size: float = 5.0) -> "Linkage":
        return self._block("numeric", field, bucket_size=bucket_size)

    def block_date(self, field: str, resolution: str = "year") -> "Linkage":
        return self._block("date", field, resolution=resolution)

    def block_trie(self, field: str, min_prefix_len: int = 2, max_frequency: int = 100) -> "Linkage":
        return self._block("trie", field, min_prefix_len=min_prefix_len, max_frequency=max_frequency)

    def block_custom(self, name: str) -> "Linkage":
        registry.blocker(name)
        return self._block("custom", None, name=name)

    def combine(self, mode: str) -> "Linkage":
        """How several blockers combine: the union (default) or the intersection of their pairs."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.mode = mode
        return self

    def _compare(self, kind: str, field: str, **options) -> "Linkage":
        self.comparators.append({"kind": kind, "field": field, **options})
        return self

    def compare_string(self, field: str, metric: str = "jaro_winkler") -> "Linkage":
        similarity.metric(metric)
        return self._compare("string", field, metric=metric)

    def compare_exact(self, field: str) -> "Linkage":
        return self._compare("exact", field)

    def compare_numeric(self, field: str, max_diff: float = 10.0) -> "Linkage":
        return self._compare("numeric", field, max_diff=max_diff)

    def compare_date(self, field: str) -> "Linkage":
        return self._compare("date", field)

    def compare_phonetic(self, field: str, algorithm: str = "soundex") -> "Linkage":
        phonetic.encode(F.lit("x"), algorithm)
        return self._compare("phonetic", field, algorithm=algorithm)

    def compare_custom(self, field: str, name: str) -> "Linkage":
        registry.comparator(name)
        return self._compare("custom", field, name=name)

    def _classify(self, kind: str, **options) -> "Linkage":
        self.classifier = {"kind": kind, **options}
        self._model = None
        return self

    def classify_threshold(self, threshold: float) -> "Linkage":
        return self._classify("threshold", threshold=threshold)

    def classify_threshold_bands(self, upper: float, lower: float) -> "Linkage":
        return self._classify("threshold_bands", upper=upper, lower=lower)

    def classify_weighted(self, weights: Sequence[float], threshold: float) -> "Linkage":
        return self._classify("weighted", weights=list(weights), threshold=threshold)

    def classify_weighted_bands(self, weights: Sequence[float], upper: float, lower: float) -> "Linkage":
        return self._classify("weighted_bands", weights=list(weights), upper=upper, lower=lower)

    def classify_fellegi_sunter(self, m_probabilities: Sequence[float], u_probabilities: Sequence[float], upper: float, lower: float) -> "Linkage":
        return self._classify("fellegi_sunter", m=list(m_probabilities), u=list(u_probabilities), upper=upper, lower=lower)

    def classify_fellegi_sunter_auto(self, max_iterations: int = 100, convergence_threshold: float = 1e-6, initial_p_match: float = 0.1) -> "Linkage":
        """m and u by EM on this plan's own candidates; thresholds are 4 and -4."""
        return self._classify("fellegi_sunter_auto", max_iterations=max_iterations, convergence_threshold=convergence_threshold, initial_p_match=initial_p_match)

    def classify_logistic(self, model: comparing.LogisticModel) -> "Linkage":
        return self._classify("logistic", weights=model.weights, bias=model.bias, threshold=model.threshold)

    def classify_tree(self, model: comparing.DecisionTree) -> "Linkage":
        return self._classify("tree", tree=model.to_json())

    def classify_custom(self, name: str) -> "Linkage":
        registry.classifier(name)
        return self._classify("custom", name=name)

    def cluster_connected_components(self) -> "Linkage":
        self.clusterer = {"kind": "connected_components"}
        return self

    def cluster_hierarchical(self, linkage: str = "single", threshold: float = 0.5) -> "Linkage":
        if linkage not in ("single", "complete", "average"):
            raise ValueError(f"unknown linkage {linkage!r}")
        self.clusterer = {"kind": "hierarchical", "linkage": linkage, "threshold": threshold}
        return self

    def with_profiling(self) -> "Linkage":
        self._profiling = True
        return self

    def profiling_stats(self) -> dict[str, int]:
        """Nanoseconds per stage and row counts of the last profiled run."""
        return dict(self._stats)

    @classmethod
    def builder(cls, id_col: str = "id") -> "Linkage":
        return cls(id_col)

    def build(self) -> "Linkage":
        """The plan itself, if it is complete; else a ValueError."""
        if not self.blockers:
            raise ValueError("a plan needs a blocker")
        if not self.comparators:
            raise ValueError("a plan needs a comparator")
        if self.classifier is None:
            raise ValueError("a plan needs a classifier")
        return self

    # --- JSON --------------------------------------------------------------------------------------------------------------
    def to_json(self) -> str:
        parts = [*self.blockers, *self.comparators, self.classifier or {}]
        if any(p.get("kind") == "custom" for p in parts):
            raise ValueError("plans with custom parts cannot be written")
        return json.dumps({"id_col": self.id_col, "preprocess": self.operations, "blockers": self.blockers, "mode": self.mode, "comparators": self.comparators, "classifier": self.classifier, "cluster": self.clusterer}, indent=2)

    @classmethod
    def from_json(cls, source: str) -> "Linkage":
        d = json.loads(source)
        plan = cls(d["id_col"])
        for field, ops in d["preprocess"].items():
            plan.preprocess(field, ops)
        plan.blockers, plan.mode, plan.comparators, plan.classifier, plan.clusterer = d["blockers"], d["mode"], d["comparators"], d["classifier"], d["cluster"]
        return plan

    def to_file(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @classmethod
    def from_file(cls, path: str) -> "Linkage":
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    # --- execution ---------------------------------------------------------------------------------------------------------
    def _prepared(self, df: DataFrame) -> DataFrame:
        """Id and the fields the plan names, preprocessed; numeric and date fields are left as they are."""
        as_is = {p["field"] for p in [*self.blockers, *self.comparators] if p["kind"] in ("numeric", "date")}
        fields = list(dict.fromkeys(f for p in [*self.blockers, *self.comparators] for f in (p["field"], p.get("coarse")) if f))
        if any(b["kind"] == "custom" for b in self.blockers):
            fields = [c for c in df.columns if c != self.id_col]
        cols = []
        for f in fields:
            c = F.col(f"`{f}`")
            if f not in as_is:
                c = c.cast("string")
                if f in self.operations:
                    c = text.preprocess(c, self.operations[f])
            cols.append(c.alias(f))
        return df.select(F.col(f"`{self.id_col}`").alias(self.id_col), *cols).filter(F.col(self.id_col).isNotNull())

    def candidates(self, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        """(left_id, right_id) of prepared records."""
        made = []
        for b in self.blockers:
            options = {k: v for k, v in b.items() if k not in ("kind", "field")}
            if b["kind"] == "custom":
                made.append(blocking.custom(left, right, options["name"]))
            else:
                made.append(blocking.BLOCKERS[b["kind"]](left, right, b["field"], id_col=self.id_col, **options))
        if self.mode == "intersection" and len(made) > 1:
            return blocking.intersection(made)
        return blocking.union(made)

    def _comparison(self, c: dict[str, Any], a: Column, b: Column) -> Column:
        kind = c["kind"]
        if kind == "string":
            return comparing.compare_string(a, b, c["metric"])
        if kind == "exact":
            return comparing.compare_exact(a, b)
        if kind == "numeric":
            return comparing.compare_numeric(a, b, c["max_diff"])
        if kind == "date":
            return comparing.compare_date(a, b)
        if kind == "phonetic":
            # codes are computed once per record, see _coded
            return F.when(a == b, 1.0).otherwise(0.0)
        return comparing.compare_custom(a, b, c["name"])

    def _coded(self, df: DataFrame) -> DataFrame:
        for i, c in enumerate(self.comparators):
            if c["kind"] == "phonetic":
                df = df.withColumn(f"__code{i}", phonetic.encode(F.col(f"`{c['field']}`").cast("string"), c["algorithm"]))
        return df

    def vectors(self, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        """(left_id, right_id, scores) of the candidates of prepared records.

        Cheap and telling comparators run in a first projection. If the classifier is a threshold on the mean or on a sum
        with non-negative weights, pairs that cannot reach it any more are dropped before the costly comparators run.
        """
        used = list(dict.fromkeys(c["field"] for c in self.comparators))
        codes = [f"__code{i}" for i, c in enumerate(self.comparators) if c["kind"] == "phonetic"]

        def side(df: DataFrame, name: str) -> DataFrame:
            return self._coded(df).select(F.col(self.id_col).alias(f"{name}_id"), *[F.col(f"`{c}`").alias(f"{name}__{c}") for c in [*used, *codes]])

        only = self.blockers[0] if len(self.blockers) == 1 and "candidates" not in self.__dict__ else {}
        if only.get("kind") in ("exact", "phonetic", "date"):
            # The join of the one blocker brings the fields along: pairs need not look their records up again.
            options = {k: v for k, v in only.items() if k not in ("kind", "field")}
            rows = blocking.BLOCKERS[only["kind"]](self._coded(left), None if right is None else self._coded(right), only["field"], id_col=self.id_col, carry=[*used, *codes], band=self._band(left, right), **options)
        else:
            pairs = self.candidates(left, right)
            rows = pairs.join(side(left, "left"), "left_id").join(side(left if right is None else right, "right"), "right_id")
        n = len(self.comparators)
        order = sorted(range(n), key=lambda i: comparing.COSTS[self.comparators[i]["kind"]][0] / comparing.COSTS[self.comparators[i]["kind"]][1])
        costly = [i for i in order if self.comparators[i]["kind"] == "custom" or (self.comparators[i]["kind"] == "string" and self.comparators[i]["metric"] in similarity.IN_PYTHON | set(registry.registered("metric")))]
        texts = [i for i in order if i not in costly and self.comparators[i]["kind"] == "string"]
        cheap = [i for i in order if i not in costly and i not in texts]

        def score(i: int) -> Column:
            c = self.comparators[i]
            key = f"__code{i}" if c["kind"] == "phonetic" else c["field"]
            return self._comparison(c, F.col(f"`left__{key}`"), F.col(f"`right__{key}`"))

        done: list[int] = []
        for now in filter(None, (cheap, texts, costly)):
            bound = self._best_case(done, [i for i in order if i not in done]) if done else None
            rows = (rows if bound is None else rows.filter(bound)).withColumns({f"__s{i}": score(i) for i in now})
            done += now
        return rows.select("left_id", "right_id", F.array(*[F.col(f"__s{i}") for i in range(n)]).alias("scores"))

    def _needed(self) -> tuple[list[float], float] | None:
        """(weights, sum that a pair must reach) of classifiers by a sum with non-negative weights."""
        k, n = self.classifier or {}, len(self.comparators)
        if k.get("kind") in ("threshold", "threshold_bands"):
            return [1.0 / n] * n, k["threshold"] if k["kind"] == "threshold" else min(k["upper"], k["lower"])
        if k.get("kind") in ("weighted", "weighted_bands") and all(w >= 0 for w in k["weights"]):
            return [*k["weights"], *[0.0] * n][:n], k["threshold"] if k["kind"] == "weighted" else min(k["upper"], k["lower"])
        return None

    def _best_case(self, cheap: list[int], costly: list[int]) -> Column | None:
        needed = self._needed()
        if needed is None:
            return None
        weights, t = needed
        reached = F.lit(sum(weights[i] for i in costly))
        for i in cheap:
            reached = reached + F.col(f"__s{i}") * weights[i]
        return reached >= t - 1e-9

    def _band(self, left: DataFrame, right: DataFrame | None) -> tuple[str, float] | None:
        """(field, how far it may differ) of the number without which a pair cannot reach the threshold, if there is one."""
        needed, made = self._needed(), set(registry.registered("metric"))
        if needed is None or any(c["kind"] == "custom" or c.get("metric") in made for c in self.comparators):
            return None  # parts of others may score above 1
        weights, t = needed
        found = []
        for i, c in enumerate(self.comparators):
            if c["kind"] == "numeric" and c["max_diff"] > 0 and weights[i] > 0:
                least = (t - 1e-9 - sum(weights) + weights[i]) / weights[i]
                if least > 1e-6:
                    found.append((c["field"], max(c["max_diff"] * (1 - least), c["max_diff"] * 1e-6)))
        for field, reach in found:
            number = lambda d: d[field].try_cast("double")  # noqa: E731, B023
            if all(dict(d.dtypes)[field] in ("tinyint", "smallint", "int", "bigint") or d.filter(F.isnan(number(d))).isEmpty() for d in (left, right) if d is not None):
                return field, reach
        return None

    def _classification(self, vectors: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
        k, n = self.classifier, len(self.comparators)
        kind = k["kind"]
        if kind == "threshold":
            return vectors, comparing.threshold(k["threshold"], n)
        if kind == "threshold_bands":
            return vectors, comparing.threshold_bands(k["upper"], k["lower"], n)
        if kind == "weighted":
            return vectors, comparing.weighted(k["weights"], k["threshold"])
        if kind == "weighted_bands":
            return vectors, comparing.weighted_bands(k["weights"], k["upper"], k["lower"])
        if kind == "fellegi_sunter":
            return vectors, comparing.fellegi_sunter(k["m"], k["u"], k["upper"], k["lower"], n)
        if kind == "fellegi_sunter_auto":
            vectors = materialise(vectors, "vectors")  # used by the estimate and by the classification
            options = {x: k[x] for x in ("max_iterations", "convergence_threshold", "initial_p_match")}
            em = training.estimate_fellegi_sunter(vectors, n, **options)
            return vectors, comparing.fellegi_sunter(em.m_probabilities, em.u_probabilities, 4.0, -4.0, n)
        if kind == "logistic":
            return vectors, comparing.LogisticModel(k["weights"], k["bias"], k["threshold"])
        if kind == "tree":
            return vectors, comparing.DecisionTree.from_json(k["tree"])
        return vectors, registry.classifier(k["name"])

    def _repeated(self, df: DataFrame) -> bool:
        """Whether the compared fields of records are the same again and again, so that values are worth judging instead of records."""
        fields = [F.col(f"`{c}`") for c in df.columns if c != self.id_col]
        rows, values = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*fields))).first()
        return rows >= REPEATED * values

    def _by_value(self, left: DataFrame, right: DataFrame | None) -> DataFrame:
        """The pairs of records with equal fields are judged once. Ids come in chunks, so that one row of a task never makes
        more than CHUNK x CHUNK pairs and hot values are spread."""

        def grouped(df: DataFrame) -> tuple[DataFrame, DataFrame]:
            fields = [c for c in df.columns if c != self.id_col]
            values = df.groupBy(*[f"`{c}`" for c in fields]).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("__chunks"))
            values = materialise(values.withColumn("__value", F.monotonically_increasing_id()), "values")
            named = values.select("__value", "__chunks", *[F.col(f"`{c}`").alias(f"__f{i}") for i, c in enumerate(fields)])
            same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"__f{i}")) for i, c in enumerate(fields)])
            members = df.join(named, same).withColumn("__chunk", F.pmod(F.xxhash64(self.id_col), F.col("__chunks")).cast("int"))
            ids = members.groupBy("__value", "__chunk").agg(F.collect_list(F.col(f"`{self.id_col}`")).alias("__ids"))
            return values.select(F.col("__value").alias(self.id_col), *[F.col(f"`{c}`") for c in fields]), materialise(ids, "ids")

        a, ids = grouped(left)
        b, other = (a, ids) if right is None else grouped(right)
        near = self._judged(a, b)
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Few rows that make many pairs: a given number of partitions, with one row after the other to each.
        side = lambda df, name: df.select(F.col("__value").alias(f"{name}_id"), F.col("__chunk").alias(f"__{name}"), F.col("__ids").alias(f"__{name}_ids"))
        met = near.join(side(ids, "left"), "left_id").join(side(other, "right"), "right_id").repartition(n, "left_id", "right_id", "__left", "__right")
        kept = [F.col(c) for c in ("score", "match_class", "scores")]
        out = met.select(F.explode("__left_ids").alias("left_id"), "__right_ids", *kept).select("left_id", F.explode("__right_ids").alias("right_id"), *kept)
        return out.filter("left_id < right_id") if right is None else out

    def _run(self, left: DataFrame, right: DataFrame | None) -> DataFrame:
        self.build()
        keyed = len(self.blockers) == 1 and self.blockers[0]["kind"] in ("exact", "phonetic", "date") and "candidates" not in self.__dict__
        if keyed and self.classifier["kind"] != "fellegi_sunter_auto" and all(self._repeated(d) for d in (left, right) if d is not None):
            return self._by_value(left, right)
        return self._judged(left, right)

    def _judged(self, left: DataFrame, right: DataFrame | None) -> DataFrame:
        vectors, classify = self._classification(self.vectors(left, right))
        out = vectors.withColumn("__c", classify(F.col("scores"))).select("left_id", "right_id", F.col("__c.score").alias("score"), F.col("__c.match_class").alias("match_class"), "scores")
        return out.filter(F.col("match_class").isin("match", "possible"))

    def _profiled(self, left: DataFrame, right: DataFrame | None) -> DataFrame:
        def timed(name: str, make: Callable[[], DataFrame]) -> DataFrame:
            began = time.perf_counter_ns()
            df = materialise(make(), name)
            self._stats[f"{name}_ns"] = time.perf_counter_ns() - began
            self._stats[f"{name}_rows"] = df.count()
            return df

        self._stats = {}
        began = time.perf_counter_ns()
        left = timed("preprocess", lambda: self._prepared(left))
        right = None if right is None else self._prepared(right)
        pairs = timed("blocking", lambda: self.candidates(left, right))
        self.candidates = lambda *_: pairs  # type: ignore[method-assign] - this run reuses the stage it has just timed
        try:
            out = timed("comparison", lambda: self._run(left, right))
        finally:
            del self.candidates
        self._stats["total_ns"] = time.perf_counter_ns() - began
        return out

    def dedup(self, df: DataFrame) -> DataFrame:
        """(left_id, right_id, score, match_class, scores) of the matching and possibly matching pairs of one table."""
        return self._profiled(df, None) if self._profiling else self._run(self._prepared(df), None)

    def link(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """The same for pairs across two tables."""
        return self._profiled(left, right) if self._profiling else self._run(self._prepared(left), self._prepared(right))

    def dedup_cluster(self, df: DataFrame) -> DataFrame:
        """(cluster_id, record_id). Possible matches are clustered too; without a clusterer each pair is a cluster."""
        pairs = self.dedup(df)
        kind = self.clusterer["kind"]
        if kind == "connected_components":
            return clustering.connected_components(pairs)
        if kind == "hierarchical":
            return clustering.hierarchical(pairs, self.clusterer["linkage"], self.clusterer["threshold"])
        placed = blocking.ranked(pairs.select("left_id", "right_id"), [F.col("left_id"), F.col("right_id")])
        return placed.select((F.col("rank") - 1).cast("long").alias("cluster_id"), F.explode(F.array("left_id", "right_id")).alias("record_id"))
