"""Mixing sources to target shares of a total size in tokens, by allocation and Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kinloom.session import materialise


def source_budget(sized: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """One row for each source of ``targets``: its tokens, the total T over all sources with a target, and what it can reach.

    ``sized`` has one row per document with its source and n_tokens; rows without a target do not count. Output: source,
    target_share, max_repeats, tokens, docs, total, wanted (share x total), reachable (max_repeats x tokens), falls_short.
    A target source without documents has 0 tokens. Targets are one small row per source; documents are reduced by
    map-side aggregation, so one source may hold any part of them.
    """
    per_source = sized.groupBy(source).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    joined = targets.select(source, "target_share", "max_repeats").join(per_source, source, "left").na.fill({"tokens": 0, "docs": 0})
    total = joined.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    out = joined.join(F.broadcast(total), F.lit(True))
    wanted, reachable = F.col("target_share") * F.col("total"), F.col("max_repeats") * F.col("tokens")
    return out.withColumn("wanted", wanted).withColumn("reachable", reachable.cast("double")).withColumn("falls_short", F.coalesce(reachable < wanted, F.lit(False)))


def _per_unit(sized: DataFrame, budget: DataFrame, source: str) -> DataFrame:
    """(source, rate): expected copies of a document are least(max_repeats, rate x odds), so that a source gives what is wanted.

    Documents are compressed to their distinct odds first. From the largest odds down, ``rate`` is what the rest must have
    if all larger ones are at max_repeats; it holds for the first value that it does not push above max_repeats itself.
    A source that falls short has no rate.
    """
    cells = sized.groupBy(source, "odds").agg(F.sum("n_tokens").alias("t")).join(F.broadcast(budget.filter("not falls_short").select(source, "wanted", "max_repeats")), source)
    down = Window.partitionBy(source).orderBy(F.desc("odds"))
    above = F.coalesce(F.sum("t").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("t") * F.col("odds")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rates = cells.withColumn("rate", (F.col("wanted") - F.col("max_repeats") * above) / rest).filter(F.col("rate") * F.col("odds") <= F.col("max_repeats") * (1 + 1e-12))
    return rates.groupBy(source).agg(F.max_by("rate", "odds").alias("rate"))


def mixture(sized: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = 17, slices: int = 512, odds: str = "n_tokens") -> tuple[DataFrame, DataFrame]:
    """(documents with copies, report): a mixture in which each source gives its target share of T tokens.

    Expected copies of a document grow with its ``odds`` (a positive column, by default its size), up to max_repeats. Their
    whole part is allocated with certainty; the rest is a Pareto order sample of unequal probabilities: every document
    draws a uniform number from a hash of its id and the seed, and documents are taken in the order of random odds over
    inclusion odds until the remaining tokens are used, a fixed size. No document is used more than ``max_repeats`` times;
    a source that cannot reach its share gives max_repeats copies of all its documents and is reported as short.

    Documents: doc_id, source, n_tokens, copies (> 0). Report: source, target_share, wanted, reached, actual_share,
    falls_short. The order is cumulated in two levels (slice of the rank variable, then document), so a source with a
    third of all documents is spread over ``slices`` tasks. Documents of no tokens need no copies and are left out, those
    of null or non-positive odds count as the smallest odds there can be and are never taken.
    """
    budget = materialise(source_budget(sized, targets, source), "budget")  # one row per source of the targets
    weighed = sized.filter("n_tokens > 0").select(doc_id, source, "n_tokens", F.greatest(F.coalesce(F.col(odds).cast("double"), F.lit(0.0)), F.lit(1e-300)).alias("odds"))
    plan = budget.filter("tokens > 0").select(source, "max_repeats").join(_per_unit(weighed, budget, source), source, "left")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 40)).cast("double") + 0.5) / F.lit(float(1 << 40))
    docs = weighed.join(F.broadcast(plan), source).withColumn("expected", F.least(F.col("max_repeats").cast("double"), F.coalesce(F.col("rate") * F.col("odds"), F.col("max_repeats").cast("double"))))
    docs = docs.withColumn("whole", F.floor("expected")).withColumn("part", F.col("expected") - F.col("whole")).withColumn("u", u)
    p = F.least(F.col("part"), F.lit(1 - 1e-12))
    rank = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))  # the Pareto rank variable
    docs = docs.withColumn("q", F.when(p > 1e-15, rank)).withColumn("slice", F.coalesce(F.floor(F.col("q") / (1 + F.col("q")) * slices), F.lit(slices)))
    docs = materialise(docs.select(doc_id, source, "n_tokens", "whole", "part", "q", "slice"), "mixture")
    slice_sums = docs.groupBy(source, "slice").agg(F.sum(F.when(F.col("q").isNotNull(), F.col("n_tokens")).otherwise(0)).alias("slice_n"), F.sum(F.col("n_tokens") * F.col("part")).alias("slice_rest"))
    before = Window.partitionBy(source).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(source)  # at most slices + 1 rows per source
    offsets = slice_sums.select(source, "slice", F.coalesce(F.sum("slice_n").over(before), F.lit(0)).alias("offset"), F.sum("slice_rest").over(whole).alias("rest"))
    inside = Window.partitionBy(source, "slice").orderBy("q", doc_id).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("offset") + F.sum("n_tokens").over(inside)
    # A document is taken if more than half of it still fits: the error of a source is at most half a document.
    taken = F.col("q").isNotNull() & (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"))
    chosen = docs.join(F.broadcast(offsets), [source, "slice"]).withColumn("upto", upto).withColumn("copies", (F.col("whole") + F.when(taken, 1).otherwise(0)).cast("long"))
    chosen = chosen.filter("copies > 0").select(doc_id, source, "n_tokens", "copies")
    reached = chosen.groupBy(source).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached"))
    report = budget.join(reached, source, "left").na.fill({"reached": 0})
    all_reached = F.sum("reached").over(Window.partitionBy())  # over one row per target source
    report = report.select(source, "target_share", "wanted", "reached", F.try_divide(F.col("reached").cast("double"), all_reached).alias("actual_share"), "falls_short")
    return chosen, report
