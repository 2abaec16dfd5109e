"""Groups of records linked directly or through others, from the pairs of a matching or deduplication run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinloom.operators.components import EDGES_PER_PARTITION, connected


def connected_groups(pairs: DataFrame, left: str, right: str, edges_per_partition: int = EDGES_PER_PARTITION) -> DataFrame:
    """(record_id, group_id): every record that has a link, with the smallest record id of its group.

    Union-find inside edge partitions, spanning forests only, merged in a hierarchy of partitions of at most
    ``edges_per_partition`` edges until the components are global: see :func:`kinloom.operators.components.connected`,
    whose plan the core shares. Pairs with a null end or two equal ends are no links; repeated rows and both directions
    are harmless; ids compare by code point; an empty table gives an empty result; other columns are ignored.
    """
    return connected(pairs.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")), "a", "b", edges_per_partition)
