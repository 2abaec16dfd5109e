"""Queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.llm import components, copies, linkage, mixture, subjects, tokens, topn, variants
from kinloom.session import materialise

EXACT = ("dob", "city", "postcode")


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n_per_group(_read(spark, sf, "match_results"), "left_id", "right_id", "score", 5).select("left_id", "right_id")


def p1_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n_per_group(_read(spark, sf, "match_results"), "left_id", "right_id", "score", 5)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.copy_members(_read(spark, sf, "people"), "id", "first_name", "last_name", EXACT)


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    return copies.collapse_copies(_read(spark, sf, "people"), "id", "first_name", "last_name", EXACT)


def p4_matches(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.link(_read(spark, sf, "records_left"), _read(spark, sf, "records_right"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_matches(spark, sf).select("left_id", "right_id")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "dup_pairs").filter(F.col("match_class").isin("match", "possible"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return components.connected_groups(_links(spark, sf), "left_id", "right_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return variants.variant_pairs(_read(spark, sf, "people"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_texts(_read(spark, sf, "documents"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, n_tokens of every document whose source has a target."""
    targets = _read(spark, sf, "mix_targets")
    documents = _read(spark, sf, "documents").select("doc_id", "source", "text").join(F.broadcast(targets.select("source")), "source")
    packed = documents.select(F.struct("doc_id", "source").alias("key"), "text")
    return tokens.count_tokens(packed, "key").select("key.doc_id", "key.source", "n_tokens")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_report(spark, sf).filter("falls_short").select("source")


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    sized = materialise(_sized(spark, sf), "sized")
    return mixture.mixture(sized, _read(spark, sf, "mix_targets"))[0]


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    sized = materialise(_sized(spark, sf), "sized")
    return mixture.mixture(sized, _read(spark, sf, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subject_areas(_read(spark, sf, "documents"), _read(spark, sf, "doc_labels"), _read(spark, sf, "subjects"))


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """subject, docs, n_chars: the corpus by subject area."""
    found = p9_found(spark, sf)
    sizes = _read(spark, sf, "documents").select("doc_id", "n_chars")
    return found.join(sizes, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_ranked, p2_found, p2_records, p4_found, p4_matches, p5_found, p6_found, p7_ids, p8_found, p8_mixture, p8_report, p9_found, p9_composition)
    return {f.__name__: f for f in own}


_BEST = """
SELECT left_id, right_id, score, CAST(row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS INTEGER) AS rank
FROM (SELECT left_id, right_id, max(score) AS score FROM match_results
      WHERE left_id IS NOT NULL AND right_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
QUALIFY rank <= 5"""

_CANON = r"""
SELECT id, dob, city, postcode, least(x, y) AS x, greatest(x, y) AS y FROM (
  SELECT id, dob, city, postcode,
         regexp_replace(replace(lower(upper(a)), 'ß', 'ss'), '[^\p{L}\p{Nd}\p{M}]', '', 'g') AS x, regexp_replace(replace(lower(upper(b)), 'ß', 'ss'), '[^\p{L}\p{Nd}\p{M}]', '', 'g') AS y
  FROM (SELECT id, dob, city, postcode,
               CASE WHEN one IS NOT NULL AND contains(one, ',') THEN substr(one, 1, instr(one, ',') - 1) ELSE coalesce(first_name, '') END AS a,
               CASE WHEN one IS NOT NULL AND contains(one, ',') THEN substr(one, instr(one, ',') + 1) ELSE coalesce(last_name, '') END AS b
        FROM (SELECT *, CASE WHEN first_name IS NULL THEN last_name WHEN last_name IS NULL THEN first_name END AS one FROM people)))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT left_id, right_id FROM ({_BEST})",
        "p1_ranked": _BEST,
        "p2_found": f"SELECT keep_id, id AS copy_id FROM (SELECT id, min(id) OVER (PARTITION BY dob, city, postcode, x, y) AS keep_id FROM ({_CANON})) WHERE id <> keep_id",
        "p2_records": f"SELECT min(id) AS keep_id, count(*) AS copies FROM ({_CANON}) GROUP BY dob, city, postcode, x, y",
        "p5_found": """
WITH RECURSIVE links AS (
  SELECT DISTINCT left_id AS a, right_id AS b FROM dup_pairs
  WHERE match_class IN ('match', 'possible') AND left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
best(record_id, group_id) USING KEY (record_id) AS (
  SELECT a, min(least(a, b)) FROM both_ways GROUP BY a
  UNION
  SELECT e.b, min(r.group_id) FROM best AS r JOIN both_ways AS e ON e.a = r.record_id JOIN recurring.best AS old ON old.record_id = e.b
  WHERE r.group_id < old.group_id GROUP BY e.b)
SELECT record_id, group_id FROM best""",
    }
