"""Connected components by union-find inside partitions and a hierarchy of spanning forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from kinloom.operators.skew import join_lookup
from kinloom.session import materialise

#: Edges that one partition may hold; above it another level of the hierarchy is made instead of a larger task.
EDGES_PER_PARTITION = 400_000
#: Every level drops a third of a chain's nodes or more on average, so this is never reached; if it is, it is an error.
MAX_LEVELS = 200


def _forest(batches: Iterator[pa.RecordBatch], flush_at: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Union-find over blocks of at most ``flush_at`` edges (plus one batch); yields (node, root, rank, low)."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= flush_at:
            yield _solve(held, level, last)
            held, rows = [], 0
    if rows:
        yield _solve(held, level, last)


def _solve(held: list[pa.RecordBatch], level: int, last: bool) -> pa.RecordBatch:
    """The spanning forest of a block as stars, with the smallest record id known of each tree (low).

    The root of a tree is its node of the lowest rank: on level 0 its smallest id, above that a hash drawn anew each
    level. On the last level the root is replaced by the smallest id itself.
    """
    table = pa.Table.from_batches(held)
    a, b, la, lb = (pa.concat_arrays(table.column(i).chunks) for i in range(4))
    ends = pc.unique(pa.chunked_array([a, b]))
    ends = ends.take(pc.array_sort_indices(ends))  # UTF-8 bytes sort as code points
    rank = np.arange(len(ends), dtype=np.uint64)
    if level:
        values = ends.to_numpy(zero_copy_only=False)
        if values.dtype.kind in "iu":
            values = values.astype(np.int64) ^ np.int64(level * 0x9E3779B97F4A7C15 % 2**63)
        rank = pd.util.hash_array(values, hash_key=f"level{level:011d}")
        order = np.argsort(rank, kind="stable")
        ends, rank = ends.take(pa.array(order)), rank[order]
    left = pc.index_in(a, ends).to_numpy(zero_copy_only=False)
    right = pc.index_in(b, ends).to_numpy(zero_copy_only=False)
    parent = list(range(len(ends)))
    for x, y in zip(left.tolist(), right.tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    roots = np.asarray(parent)
    while True:  # parents only ever point down, so a few doublings flatten every path
        up = roots[roots]
        if (up == roots).all():
            break
        roots = up
    tree = pa.table({"root": np.concatenate([roots[left], roots[right]]), "low": pa.concat_arrays([la, lb])}).group_by("root").aggregate([("low", "min")])
    place = np.empty(len(ends), dtype=np.int64)
    place[tree.column("root").to_numpy()] = np.arange(tree.num_rows)
    low = pa.concat_arrays(tree.column("low_min").chunks).take(pa.array(place[roots]))
    named = low if last else ends.take(pa.array(roots))
    return pa.record_batch([ends, named, pa.array((rank[roots] >> np.uint64(1)).astype(np.int64)) if level else pa.array(np.zeros(len(ends), dtype=np.int64)), low], names=["node", "root", "rank", "low"])


def connected(pairs: DataFrame, left: str, right: str, edges_per_partition: int = EDGES_PER_PARTITION) -> DataFrame:
    """(record_id, group_id): every record that has a link, with the smallest record id of its group.

    Pairs with a null end or two equal ends are no links; repeated rows and both directions are harmless; ids compare as
    their type does (strings by code point); an empty table gives an empty result.

    Each level runs union-find inside every partition of the edges and keeps only its spanning forest, flattened to
    stars (node, root). A node met in several partitions has several roots: linking those roots gives the next level's
    edges, a smaller graph of roots only. Above the first level roots are chosen by a hash drawn anew each level and edges
    are dealt anew, by a hash of the whole edge and the level: whatever the order of the ids, a chain loses a third of its
    nodes a level, and a hub with a third of all links is spread like any other node. Partitions hold at most
    ``edges_per_partition`` edges. Stars and edges carry the smallest record id known of their tree; when all edges of
    a level fit one partition it is known for every group, and on the way back every level's roots are replaced by it
    through one equi-join.
    """
    edges = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null and a <> b").withColumns({"la": F.col("a"), "lb": F.col("b")})
    kind = dict(edges.dtypes)["a"]
    schema = f"node {kind}, root {kind}, rank bigint, low {kind}"
    levels: list[DataFrame] = []
    wanted, above = 0, None
    for level in range(MAX_LEVELS):
        # One star per node: its root of the lowest rank; every further root is an edge of the next level.
        last = wanted == 1
        block = 2**62 if last else edges_per_partition  # the last level is one task of at most edges_per_partition edges
        forest = edges.mapInArrow(lambda batches, block=block, level=level, last=last: _forest(batches, block, level, last), schema)
        if last:
            above = materialise(forest, "forest").select("node", F.col("root").alias("group_id"))
            break
        # A node has as many rows as blocks it was met in, never as many as it has links.
        met = Window.partitionBy("node")
        first = met.orderBy("rank", "root")
        rows = forest.select("node", "root", F.first("root").over(first).alias("head"), F.row_number().over(first).alias("n"), F.min("low").over(met).alias("low"))
        rows = materialise(rows, "stars")
        stars = rows.filter("n = 1").select("node", "root", "low")
        levels.append(stars)
        links = rows.filter("root <> head").select(F.col("head").alias("a"), F.col("root").alias("b")).distinct()
        if level:  # a root is a node of all its trees, so its star knows the smallest id of each
            low = lambda n: stars.select(F.col("node").alias(n), F.col("low").alias(f"l{n}"))
            links = links.join(low("a"), "a").join(low("b"), "b").select("a", "b", "la", "lb")
        else:
            links = links.withColumns({"la": F.col("a"), "lb": F.col("b")})
        links = materialise(links, "links")
        count = links.count()
        if not count:
            break
        wanted = max(1, -(-count // edges_per_partition))
        edges = links.coalesce(1) if wanted == 1 else links.repartition(wanted, F.xxhash64(F.lit(level), "a", "b"))
    else:
        raise RuntimeError(f"components did not settle in {MAX_LEVELS} levels")
    for place, stars in enumerate(reversed(levels)):
        named = _named(stars, above)
        # Each level but the first is written: the next one reads it more than once, and a plan of all levels would grow without bound.
        above = named if place == len(levels) - 1 else materialise(named, "groups")
    return above.select(F.col("node").alias("record_id"), "group_id")


def _named(stars: DataFrame, above: DataFrame | None) -> DataFrame:
    """(node, group_id): stars by the group of their root. A root that was not linked further is final and known by its low id.

    Stars with a hub as root are joined by a broadcast of bounded size, all others by shuffle.
    """
    roots = stars.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"))
    if above is not None:
        roots = roots.join(above.select(F.col("node").alias("root"), "group_id"), "root", "left")
    else:
        roots = roots.withColumn("group_id", F.lit(None).cast(dict(stars.dtypes)["root"]))
    lookup = roots.select("root", "n", F.coalesce("group_id", "low").alias("group_id"))
    return join_lookup(stars.select("node", "root"), lookup, ["root"], "n", stars.count()).select("node", "group_id")
