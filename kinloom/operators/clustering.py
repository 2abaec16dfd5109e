"""Clusters from matched pairs: components, hierarchical, density-based, incremental; and measures of their quality."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kinloom.functions import similarity
from kinloom.operators.components import connected
from kinloom.session import materialise


def components(edges: DataFrame, a: str = "left_id", b: str = "right_id") -> DataFrame:
    """(record_id, component): every record with a link and the smallest id it is connected with.

    See :func:`kinloom.operators.components.connected`. Null ends and self-links are ignored; an empty table gives an
    empty result.
    """
    return connected(edges, a, b).withColumnRenamed("group_id", "component")


def numbered(members: DataFrame, group: str) -> DataFrame:
    """(cluster_id, record_id): groups of two or more, numbered from 0 in the order of their group key."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    from kinloom.operators.blocking import ranked

    ids = ranked(sizes.select(group), [F.col(group)]).select(group, (F.col("rank") - 1).cast("long").alias("cluster_id"))
    return members.join(ids, group).select("cluster_id", "record_id")


def connected_components(edges: DataFrame, a: str = "left_id", b: str = "right_id") -> DataFrame:
    """(cluster_id, record_id) of records linked directly or through others."""
    return numbered(components(edges, a, b), "component")


def _per_component(edges: DataFrame, solve, a: str, b: str, sim: str) -> DataFrame:
    """Run ``solve(pdf with a, b, sim) -> list of (record_id, label)`` in every connected component on its own.

    Order-dependent algorithms never look across components, so this is exact. One component is one task: these
    algorithms are for components of a size a task can hold.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(sim).cast("double").alias("s")).filter("a is not null and b is not null and s is not null and a <> b")
    kind = dict(pairs.dtypes)["a"]
    home = components(pairs, "a", "b")
    tagged = pairs.join(home.withColumnRenamed("record_id", "a"), "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = solve(pdf.sort_values(["a", "b", "s"], kind="stable"))
        return pd.DataFrame([(pdf["component"].iloc[0], r, x) for r, x in rows], columns=["component", "record_id", "label"])

    return tagged.groupBy("component").applyInPandas(run, f"component {kind}, record_id {kind}, label int")


def hierarchical(edges: DataFrame, linkage: str = "single", threshold: float = 0.5, a: str = "left_id", b: str = "right_id", sim: str = "score") -> DataFrame:
    """(cluster_id, record_id): pairs are taken by rising distance 1 - sim up to ``threshold``; two clusters merge if the
    smallest (single), largest (complete) or mean (average) of the known distances between them is within it.

    Single linkage is the components of the close pairs. Ties go by ids.
    """
    if linkage not in ("single", "complete", "average"):
        raise ValueError(f"unknown linkage {linkage!r}: single, complete or average")
    if linkage == "single":
        return connected_components(edges.filter(1.0 - F.col(sim) <= threshold), a, b)

    def solve(pdf: pd.DataFrame) -> list[tuple]:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {x: i for i, x in enumerate(names)}
        # known distances between clusters as (max, sum, count), merged with the clusters: no rescans of the edges
        between: list[dict[int, tuple[float, float, int]]] = [{} for _ in names]

        def join(p, q):
            return (max(p[0], q[0]), p[1] + q[1], p[2] + q[2])

        order = []
        for x, y, s in zip(pdf["a"], pdf["b"], pdf["s"]):
            i, j, d = at[x], at[y], 1.0 - s
            order.append((d, i, j))
            for p, q in ((i, j), (j, i)):
                between[p][q] = join(between[p][q], (d, d, 1)) if q in between[p] else (d, d, 1)
        cluster = list(range(len(names)))
        members = [[i] for i in range(len(names))]
        for d, i, j in sorted(order, key=lambda e: e[0]):
            if d > threshold:
                break
            p, q = cluster[i], cluster[j]
            if p == q:
                continue
            top, total, n = between[p][q]
            if (top if linkage == "complete" else total / n) > threshold:
                continue
            for r, v in between[q].items():
                if r != p:
                    between[p][r] = between[r][p] = join(between[p][r], v) if r in between[p] else v
                between[r].pop(q, None)
            for x in members[q]:
                cluster[x] = p
            members[p] += members[q]
            members[q] = []
        return [(names[x], k) for k, group in enumerate(members) if len(group) > 1 for x in group]

    found = _per_component(edges, solve, a, b, sim)
    return numbered(found.select(F.struct("component", "label").alias("g"), "record_id"), "g")


def dbscan(nodes: DataFrame, edges: DataFrame, min_similarity: float, min_samples: int, node: str = "id", a: str = "left_id", b: str = "right_id", sim: str = "score") -> DataFrame:
    """(record_id, label): -1 is noise. A record with ``min_samples`` neighbours (itself not counted) is a core; linked
    cores form a cluster; another record next to a core joins the cluster with the smallest core. Clusters are numbered
    from 0 by their smallest core.
    """
    near = edges.filter(F.col(sim) >= min_similarity).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y")))
    core = materialise(both.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_samples).select("x"), "cores")
    linked = near.join(core, "x", "left_semi").join(core.withColumnRenamed("x", "y"), "y", "left_semi")
    grouped = components(linked, "x", "y").withColumnRenamed("record_id", "x").withColumnRenamed("component", "c")
    alone = core.join(grouped, "x", "left_anti").select("x", F.col("x").alias("c"))
    cores = grouped.join(core, "x", "left_semi").select("x", "c").unionByName(alone)
    border = both.join(cores, "x").select(F.col("y").alias("x"), "c").join(core, "x", "left_anti").groupBy("x").agg(F.min("c").alias("c"))
    placed = cores.unionByName(border)
    from kinloom.operators.blocking import ranked

    labels = ranked(cores.select("c").distinct(), [F.col("c")]).select("c", (F.col("rank") - 1).cast("int").alias("label"))
    return nodes.select(F.col(node).alias("record_id")).join(placed.join(labels, "c").select(F.col("x").alias("record_id"), "label"), "record_id", "left").na.fill({"label": -1})


def optics(nodes: DataFrame, edges: DataFrame, min_samples: int, extract_threshold: float, node: str = "id", a: str = "left_id", b: str = "right_id", sim: str = "score") -> DataFrame:
    """(record_id, label): clusters cut from the reachability ordering at distance 1 - extract_threshold; -1 is noise.

    The ordering starts at the smallest unprocessed id and always continues with the closest reachable record.
    """
    cut = 1.0 - extract_threshold

    def solve(pdf: pd.DataFrame) -> list[tuple]:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {x: i for i, x in enumerate(names)}
        near: list[list[tuple[float, int]]] = [[] for _ in names]
        for x, y, s in zip(pdf["a"], pdf["b"], pdf["s"]):
            near[at[x]].append((1.0 - s, at[y]))
            near[at[y]].append((1.0 - s, at[x]))
        core = [sorted(d for d, _ in n)[min_samples - 1] if len(n) >= min_samples else None for n in near]
        reach = [np.inf] * len(names)
        done = [False] * len(names)
        label, current, out = -1, [], []

        def visit(i: int, distance: float) -> None:
            nonlocal label
            done[i] = True
            if distance <= cut:
                out.append((names[i], max(label, 0)))
            elif core[i] is not None and core[i] <= cut:
                label += 1
                out.append((names[i], label))
            if core[i] is not None:
                for d, j in near[i]:
                    r = max(core[i], d)
                    if not done[j] and r < reach[j]:
                        reach[j] = r
                        heapq.heappush(current, (r, j))

        for start in range(len(names)):
            if done[start]:
                continue
            current.clear()
            visit(start, np.inf)
            while current:
                _, j = heapq.heappop(current)
                if not done[j]:
                    visit(j, reach[j])
        return out

    found = _per_component(edges, solve, a, b, sim)
    groups = found.select(F.struct("component", "label").alias("g"), "record_id")
    from kinloom.operators.blocking import ranked

    ids = ranked(groups.select("g").distinct(), [F.col("g")]).select("g", (F.col("rank") - 1).cast("int").alias("label"))
    return nodes.select(F.col(node).alias("record_id")).join(groups.join(ids, "g").select("record_id", "label"), "record_id", "left").na.fill({"label": -1})


#: Similarities that a worker remembers, for values that come again and again; beyond so many it starts anew.
REMEMBERED = 16_384
_SIMILAR: dict[tuple[str, str, str], float] = {}


class IncrementalCluster:
    """Ordered assignment: a value joins the cluster whose representative (its first member) is most similar, if at
    ``threshold`` or more, and else opens one. Of equally similar clusters the oldest wins. A value that comes again is
    compared only with representatives that are new to it."""

    def __init__(self, metric: str = "jaro_winkler", threshold: float = 0.85) -> None:
        kernel = similarity._BATCHED.get(metric)
        if kernel is None:
            raise ValueError(f"incremental clustering needs one of {sorted(similarity._BATCHED)}")
        self.metric, self.kernel, self.threshold = metric, kernel, threshold
        self.representatives: list[str] = []
        self.clusters: list[list[int]] = []
        self.record_count = 0
        self._seen: dict[str, tuple[int, float, int]] = {}

    @property
    def cluster_count(self) -> int:
        return len(self.clusters)

    def _similarities(self, value: str, others: list[str]) -> list[float]:
        from kinloom.functions.kernels import pairwise

        if len(others) > REMEMBERED // 4:
            return pairwise(self.kernel, pd.Series([value] * len(others)), pd.Series(others)).tolist()
        known = [_SIMILAR.get((self.metric, value, o)) for o in others]
        if None in known:
            known = pairwise(self.kernel, pd.Series([value] * len(others)), pd.Series(others)).tolist()
            if len(_SIMILAR) > REMEMBERED:
                _SIMILAR.clear()
            _SIMILAR.update(((self.metric, value, o), s) for o, s in zip(others, known))
        return known

    def add_record(self, value: str) -> tuple[int, bool, float]:
        """(cluster, whether it is new, similarity)."""
        index, self.record_count = self.record_count, self.record_count + 1
        best, top, known = self._seen.get(value, (-1, 0.0, 0))
        if known < len(self.representatives):
            scores = self._similarities(value, self.representatives[known:])
            highest = max(scores)
            if highest > top:
                best, top = known + scores.index(highest), float(highest)
        self._seen[value] = best, top, len(self.representatives)
        if best >= 0 and top >= self.threshold:
            self.clusters[best].append(index)
            return best, False, top
        self.representatives.append(value)
        self.clusters.append([index])
        return len(self.clusters) - 1, True, 1.0

    def get_clusters(self) -> list[list[int]]:
        return [list(c) for c in self.clusters]


def incremental(df: DataFrame, value: str, order: str, block: str, metric: str = "jaro_winkler", threshold: float = 0.85) -> DataFrame:
    """(block, order, cluster, is_new, similarity): incremental clustering in the order of ``order``, independently within each block."""
    rows = df.select(F.col(block).alias("block"), F.col(order).alias("o"), F.col(value).alias("v")).filter("v is not null")
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = IncrementalCluster(metric, threshold)
        pdf = pdf.sort_values("o", kind="stable")
        got = [state.add_record(v) for v in pdf["v"]]
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "o": pdf["o"].to_numpy(), "cluster": [g[0] for g in got], "is_new": [g[1] for g in got], "similarity": [g[2] for g in got]})

    return rows.groupBy("block").applyInPandas(run, f"block {kinds['block']}, o {kinds['o']}, cluster int, is_new boolean, similarity double").withColumnRenamed("o", order)


def _known(edges: DataFrame, labels: DataFrame, a: str, b: str, sim: str, node: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(members without noise: n, l; known distances in both directions with the clusters of their ends)."""
    members = labels.select(F.col(node).alias("n"), F.col(label).alias("l")).filter("l >= 0")
    d = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), (1.0 - F.col(sim)).alias("d")).filter("x <> y").groupBy("x", "y").agg(F.max("d").alias("d"))
    m = lambda n: members.select(F.col("n").alias(n), F.col("l").alias(f"l{n}"))
    return members, d.join(m("x"), "x").join(m("y"), "y")


def silhouette_score(edges: DataFrame, labels: DataFrame, a: str = "left_id", b: str = "right_id", sim: str = "score", node: str = "record_id", label: str = "label") -> DataFrame:
    """One row (silhouette). Pairs without a similarity are at distance 1; noise and singletons do not count; fewer than two clusters give 0.

    Unknown pairs enter through counts: the mean to a cluster is (sum of known + missing x 1) / size, so no all-pairs
    table arises. A record's nearest other cluster is its best known one, or one it knows nothing of (mean 1).
    """
    members, known = _known(edges, labels, a, b, sim, node, label)
    sizes = members.groupBy("l").agg(F.count(F.lit(1)).alias("size"))
    k = sizes.count()
    if k < 2:
        return edges.sparkSession.range(1).select(F.lit(0.0).alias("silhouette"))
    both = known.select(F.col("x").alias("n"), F.col("ly").alias("to"), "d").unionByName(known.select(F.col("y").alias("n"), F.col("lx").alias("to"), "d"))
    sums = both.groupBy("n", "to").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("c")).join(sizes.select(F.col("l").alias("to"), "size"), "to").join(members, "n")
    own = sums.filter("to = l").select("n", ((F.col("s") + F.col("size") - 1 - F.col("c")) / (F.col("size") - 1)).alias("a"))
    others = sums.filter("to <> l").groupBy("n").agg(F.min((F.col("s") + F.col("size") - F.col("c")) / F.col("size")).alias("b"), F.count(F.lit(1)).alias("met"))
    rows = members.join(sizes, "l").filter("size > 1").join(own, "n", "left").join(others, "n", "left")
    near = F.when(F.coalesce("met", F.lit(0)) < k - 1, F.least(F.coalesce("b", F.lit(1.0)), F.lit(1.0))).otherwise(F.col("b"))
    rows = rows.select(F.coalesce("a", F.lit(1.0)).alias("a"), near.alias("b"))
    top = F.greatest("a", "b")
    return rows.agg(F.coalesce(F.avg(F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)), F.lit(0.0)).alias("silhouette"))


def davies_bouldin_index(edges: DataFrame, labels: DataFrame, a: str = "left_id", b: str = "right_id", sim: str = "score", node: str = "record_id", label: str = "label") -> DataFrame:
    """One row (davies_bouldin): mean over clusters of their worst (scatter + scatter) / separation; fewer than two clusters give 0.

    Scatter is the mean distance within, separation the mean distance between; unknown distances are 1 and enter through
    counts. Of clusters a cluster has no known distance to (separation 1) only the one with the largest scatter matters,
    so the table of cluster pairs holds known pairs plus one row per cluster.
    """
    members, known = _known(edges, labels, a, b, sim, node, label)
    sizes = members.groupBy("l").agg(F.count(F.lit(1)).alias("size"))
    k = sizes.count()
    if k < 2:
        return edges.sparkSession.range(1).select(F.lit(0.0).alias("davies_bouldin"))
    inner = known.filter("lx = ly").groupBy(F.col("lx").alias("l")).agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("c"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    scatter = materialise(sizes.join(inner, "l", "left").na.fill({"s": 0.0, "c": 0}).select("l", "size", F.when(F.col("size") > 1, (F.col("s") + pairs - F.col("c")) / pairs).otherwise(0.0).alias("scatter")), "scatter")
    outer = known.filter("lx <> ly").select(F.least("lx", "ly").alias("p"), F.greatest("lx", "ly").alias("q"), "d").groupBy("p", "q").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("c"))
    sc = lambda n: scatter.select(F.col("l").alias(n), F.col("size").alias(f"size_{n}"), F.col("scatter").alias(f"sc_{n}"))
    met = outer.join(sc("p"), "p").join(sc("q"), "q")
    apart = (F.col("s") + F.col("size_p") * F.col("size_q") - F.col("c")) / (F.col("size_p") * F.col("size_q"))
    ratio = F.when(apart > 0, (F.col("sc_p") + F.col("sc_q")) / apart).otherwise(0.0)
    met = materialise(met.select("p", "q", ratio.alias("r")), "ratios")
    both = met.select("p", "q", "r").unionByName(met.select(F.col("q").alias("p"), F.col("p").alias("q"), "r"))
    worst = both.groupBy("p").agg(F.max("r").alias("r"))
    # The widest stranger of a cluster: clusters are ranked by scatter, and of the ranks it has met (its own included) the
    # first gap is the one it looks for. One window over a cluster's known partners, one equi-join.
    from kinloom.operators.blocking import ranked

    ranks = materialise(ranked(scatter.select(F.col("l").alias("o"), F.col("scatter").alias("so")), [(-F.col("so")).alias("narrow"), F.col("o")]), "scatter-ranks")
    seen = both.select("p", F.col("q").alias("o")).unionByName(scatter.select(F.col("l").alias("p"), F.col("l").alias("o"))).join(ranks.select("o", "rank"), "o")
    place = F.row_number().over(Window.partitionBy("p").orderBy("rank"))
    gaps = seen.select("p", "rank", place.alias("place")).groupBy("p").agg(F.coalesce(F.min(F.when(F.col("rank") != F.col("place"), F.col("place"))), F.count(F.lit(1)) + 1).alias("rank"))
    alone = gaps.join(ranks.select("rank", "so"), "rank").join(scatter.select(F.col("l").alias("p"), "scatter"), "p").select("p", (F.col("scatter") + F.col("so")).alias("r2"))
    every = scatter.select(F.col("l").alias("p")).join(worst.select("p", "r"), "p", "left").join(alone, "p", "left")
    return every.agg(F.avg(F.greatest(F.coalesce("r", F.lit(0.0)), F.coalesce("r2", F.lit(0.0)))).alias("davies_bouldin"))
