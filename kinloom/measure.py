"""How fast metrics and plans run on a user's own data."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from kinloom.functions import similarity


def _timed(df: DataFrame) -> int:
    began = time.perf_counter_ns()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter_ns() - began


def benchmark_metrics(pairs: DataFrame, a: str, b: str, metrics: Sequence[str] | None = None, n: int = 3) -> dict[str, Any]:
    """Every metric over all pairs, ``n`` times after one warm-up: results (metric, total_ns, per_pair_ns, pairs_per_sec), fastest first.

    An unknown metric is a ValueError; no pairs give no results.
    """
    chosen = {name: similarity.metric(name) for name in (metrics or similarity.METRICS)}
    rows = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    n_pairs = rows.count()
    results = []
    for name, f in chosen.items() if n_pairs else ():
        run = rows.select(f(F.col("a"), F.col("b")).alias("s"))
        _timed(run)
        total = sum(_timed(run) for _ in range(n))
        each = total / max(1, n * n_pairs)
        results.append({"metric": name, "total_ns": total, "per_pair_ns": round(each, 1), "pairs_per_sec": round(1e9 / each)})
    return {"results": sorted(results, key=lambda r: r["per_pair_ns"]), "n_iterations": n, "n_pairs": n_pairs}


def benchmark_pipeline(plan, records: DataFrame, n: int = 3) -> dict[str, Any]:
    """A plan's deduplication of ``records``, ``n`` times after one warm-up."""
    matches = plan.dedup(records).count()
    total = sum(_timed(plan.dedup(records)) for _ in range(n))
    each = total / max(1, n)
    return {"total_ns": total, "per_run_ns": round(each), "runs_per_sec": round(1e9 / each, 4) if each else float("inf"), "n_iterations": n, "n_records": records.count(), "n_matches": matches}
