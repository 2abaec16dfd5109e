"""Forms that leave the event loop free: jobs are submitted from a thread and awaited."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame

from kinloom import lists
from kinloom.plans.linkage import Linkage
from kinloom.streaming import matching as streams


def _threaded(f):
    async def run(*args: Any, **named: Any) -> Any:
        return await asyncio.to_thread(f, *args, **named)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


cdist = _threaded(lists.cdist)
match_best = _threaded(lists.match_best)
match_batch = _threaded(lists.match_batch)
pairwise_similarity = _threaded(lists.pairwise_similarity)
phonetic_batch = _threaded(lists.phonetic_batch)
preprocess_batch = _threaded(lists.preprocess_batch)


async def collected(df: DataFrame) -> list:
    """The rows of a small result."""
    return await asyncio.to_thread(df.collect)


class AsyncLinkage:
    """A plan whose runs are awaited: planning, which may start jobs of its own, happens in a thread too."""

    def __init__(self, plan: Linkage) -> None:
        self.plan = plan

    async def dedup(self, df: DataFrame) -> DataFrame:
        return await asyncio.to_thread(self.plan.dedup, df)

    async def link(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return await asyncio.to_thread(self.plan.link, left, right)

    async def dedup_cluster(self, df: DataFrame) -> DataFrame:
        return await asyncio.to_thread(self.plan.dedup_cluster, df)


async def match_stream(df: DataFrame, value: str, query: str, scorer="jaro_winkler", threshold: float | None = None, buffer_size: int = 64) -> AsyncIterator:
    """Rows of match_iter with their global index; at most ``buffer_size`` of them wait for the consumer."""
    rows: Iterator = await asyncio.to_thread(streams.match_iter, df, value, query, scorer, threshold)
    while True:
        some = await asyncio.to_thread(lambda: list(islice(rows, buffer_size)))
        if not some:
            return
        for r in some:
            yield r
