"""Records that differ only in the formatting and arrangement of some fields: one canonical form, one hash, one count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinloom.operators.skew import join_lookup
from kinloom.session import materialise

#: Everything that is no letter, decimal digit or combining mark.
IGNORED = r"[^\p{L}\p{Nd}\p{M}]"


def canonical_text(c: Column) -> Column:
    """Letter case and every character but letters, digits and combining marks removed; sharp s is written SS in capitals."""
    return F.regexp_replace(F.replace(F.lower(F.upper(c)), F.lit("ß"), F.lit("ss")), IGNORED, "")


def canonical_parts(first: Column, second: Column) -> Column:
    """The sorted pair of canonical name parts.

    If one column is null and the other contains a comma, the texts before and after the first comma are the parts;
    otherwise a null counts as an empty part.
    """
    single = F.when(first.isNull(), second).when(second.isNull(), first)
    split = single.isNotNull() & F.contains(single, F.lit(","))
    at = F.locate(",", single)
    a = F.when(split, F.substring(single, F.lit(1), at - 1)).otherwise(F.coalesce(first, F.lit("")))
    b = F.when(split, F.substring(single, at + 1, F.length(single))).otherwise(F.coalesce(second, F.lit("")))
    return F.array_sort(F.array(canonical_text(a), canonical_text(b)))


def _framed(c: Column) -> Column:
    """A text that no other value shares and that concatenates without ambiguity; null is distinct from every text."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("n"))


def canonical_key(first: str, second: str, exact: Sequence[str]) -> Column:
    parts = canonical_parts(F.col(first), F.col(second))
    return F.concat(_framed(parts[0]), _framed(parts[1]), *[_framed(F.col(c)) for c in exact])


def _keyed(df: DataFrame, row_id: str, first: str, second: str, exact: Sequence[str], *keep: str) -> DataFrame:
    """id, h1, h2, h3 and ``keep``: the canonical text as a hash of 128 bits (h1, h2) and a check of 64 more (h3)."""
    key = canonical_key(first, second, exact)
    rows = df.select(F.col(row_id).alias("id"), *[F.col(c) for c in keep], key.alias("canon")).filter("id is not null")
    return rows.select("id", *keep, F.xxhash64("canon").alias("h1"), F.xxhash64(F.lit("second half"), F.col("canon")).alias("h2"), F.xxhash64(F.lit("check"), F.col("canon")).alias("h3"))


KEY = ["h1", "h2", "h3"]


def format_groups(df: DataFrame, row_id: str, first: str, second: str, exact: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(keyed rows: id, h1, h2, h3; groups: h1, h2, h3, copies, rep) of records equal but for formatting.

    ``rep`` is the row with the smallest id of its group (id, first, second and the exact columns).
    """
    keyed = materialise(_keyed(df, row_id, first, second, exact, first, second, *exact), "format-keys")  # canonical texts once
    rep = F.min(F.struct("id", first, second, *exact))
    groups = keyed.groupBy(*KEY).agg(rep.alias("rep"), F.count(F.lit(1)).alias("copies"))
    return keyed.select("id", *KEY), materialise(groups, "format-groups")


def collapse_copies(df: DataFrame, row_id: str, first: str, second: str, exact: Sequence[str]) -> DataFrame:
    """(keep_id, copies): one row for each record, with the number of rows it stands for.

    Grouped by a 128-bit hash of the canonical text; two texts that share it are told apart by the check, a third hash.
    Map-side combining reduces a flood of copies to one row per task. Null equals only null in ``exact``; rows with a null
    id are left out; an empty table gives no rows.
    """
    return _keyed(df, row_id, first, second, exact).groupBy(*KEY).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).select("keep_id", "copies")


def copy_members(df: DataFrame, row_id: str, first: str, second: str, exact: Sequence[str]) -> DataFrame:
    """(keep_id, copy_id): every member of a group of copies but the one with the smallest id.

    Keys are computed once and written. Counting works on hashes only, which keeps the aggregation in a hash table; ids are
    looked at in groups of two or more rows only. Groups that hold a large share of the rows are joined by a broadcast of
    bounded size, all others by shuffle. Null, empty and clashing cases are those of collapse_copies.
    """
    keyed = materialise(_keyed(df, row_id, first, second, exact), "format-keys")
    total = keyed.count()
    several = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    members = materialise(join_lookup(keyed, several, KEY, "copies", total).select("id", *KEY), "format-members")
    kept = members.groupBy(*KEY).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return join_lookup(members, kept, KEY, "copies", total).filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
