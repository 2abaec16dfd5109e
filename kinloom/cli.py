"""Command line: dedupe, link, match, explain. Run with ``python -m kinloom.cli`` or spark-submit."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, functions as F

from kinloom import __version__
from kinloom.functions import similarity
from kinloom.operators import matching
from kinloom.plans.linkage import Linkage
from kinloom.sources import io
from kinloom.streaming.matching import indexed


def _plan(args: argparse.Namespace) -> Linkage:
    """The fixed recipe: folded and trimmed field, neighbourhood of 5, one string comparator, one threshold."""
    return (
        Linkage(args.id).preprocess(args.field, ["fold_case", "normalize_whitespace"]).block_sorted_neighborhood(args.field, 5)
        .compare_string(args.field, args.metric).classify_threshold(args.threshold)
    )


def _show(df, out: str | None, fmt: str = "csv") -> None:
    if out:
        (io.write_single_json if fmt == "json" else io.write_single_csv)(df, out)
    elif fmt == "json":
        for r in df.toLocalIterator():
            print(json.dumps(r.asDict(recursive=True), ensure_ascii=False))
    else:
        print(",".join(df.columns))
        for r in df.toLocalIterator():
            print(",".join("" if v is None else str(v) for v in r))


def cmd_dedupe(spark: SparkSession, args: argparse.Namespace) -> None:
    found = _plan(args).dedup(io.read_csv(spark, args.input))
    _show(found.select("left_id", "right_id", "score", "match_class").orderBy("left_id", "right_id"), args.output, args.format)


def cmd_link(spark: SparkSession, args: argparse.Namespace) -> None:
    found = _plan(args).link(io.read_csv(spark, args.left), io.read_csv(spark, args.right))
    _show(found.select("left_id", "right_id", "score", "match_class").orderBy("left_id", "right_id"), args.output, args.format)


def cmd_match(spark: SparkSession, args: argparse.Namespace) -> None:
    lines = indexed(io.read_lines(spark, args.candidates))
    _show(matching.match_batch(lines, "value", "index", args.query, args.metric, args.threshold, args.limit).select("value", "score", "index"), None, args.format)


def cmd_explain(spark: SparkSession, args: argparse.Namespace) -> None:
    one = spark.createDataFrame([(args.a, args.b)], "a string, b string")
    scores = one.select(similarity.explain(F.col("a"), F.col("b"), args.metrics or None).alias("m")).first()[0]
    for name, score in sorted(scores.items()):
        print(f"{name},{score:.4f}")


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinloom")
    p.add_argument("--version", action="version", version=f"kinloom {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    for name, inputs, run in (("dedupe", ["input"], cmd_dedupe), ("link", ["left", "right"], cmd_link)):
        c = sub.add_parser(name)
        for i in inputs:
            c.add_argument(i)
        c.add_argument("--field", required=True)
        c.add_argument("--id", default="id")
        c.add_argument("--metric", default="jaro_winkler")
        c.add_argument("--threshold", type=float, default=0.85)
        c.add_argument("--output")
        c.add_argument("--format", choices=["csv", "json"], default="csv")
        c.set_defaults(run=run)
    c = sub.add_parser("match")
    c.add_argument("query")
    c.add_argument("candidates")
    c.add_argument("--metric", default="jaro_winkler")
    c.add_argument("--threshold", type=float)
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--format", choices=["csv", "json"], default="csv")
    c.set_defaults(run=cmd_match)
    c = sub.add_parser("explain")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("--metrics", nargs="*")
    c.set_defaults(run=cmd_explain)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("kinloom").getOrCreate()
    try:
        args.run(spark, args)
    finally:
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
