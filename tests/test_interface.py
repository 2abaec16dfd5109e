"""Entry points around the operators: lists, asynchronous forms, measuring, sources, command line."""

import asyncio
import json

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom import asynchronous, cli, lists, measure
from kinloom.functions import text
from kinloom.operators import matching
from kinloom.plans.linkage import Linkage
from kinloom.sources import io
from kinloom.streaming import matching as streams

NAMES = ["John Smith", "Jane Doe", "Bob Jones", "John Smith"]


def test_lists(spark):
    assert lists.match_best(spark, "John Smith", NAMES) == ("John Smith", 1.0, 0)
    assert lists.match_best(spark, "John Smith", NAMES, ties="last") == ("John Smith", 1.0, 3)
    assert lists.match_best(spark, "zzz", NAMES, threshold=0.9) is None and lists.match_best(spark, "x", []) is None
    assert [r[2] for r in lists.match_batch(spark, "John Smith", NAMES, threshold=0.9)] == [0, 3]
    assert lists.pairwise_similarity(spark, ["abc", None], ["abc", "x"], "levenshtein") == [1.0, None]
    with pytest.raises(ValueError):
        lists.pairwise_similarity(spark, ["a"], [])
    assert lists.phonetic_batch(spark, ["Robert", None, ""]) == ["R163", None, "0000"]
    assert lists.preprocess_batch(spark, [" A  b", None], ["fold_case", "normalize_whitespace"]) == ["a b", None]
    assert lists.deduplicate(spark, ["abcdefgh", "abcdefgx", "zz", None, "abcdefgh"], 0.85, "levenshtein") == [[0, 1, 4]]
    with pytest.raises(ValueError):
        matching.match_best(spark.range(1), "id", "id", "x", ties="middle")


def test_asynchronous(spark):
    plan = Linkage().block_exact("b").compare_string("n", "levenshtein").classify_threshold(0.8)
    df = spark.createDataFrame([(1, "smith", "x"), (2, "smyth", "x"), (3, "jones", "x")], "id long, n string, b string")

    async def all_of_it():
        best, pairs = await asyncio.gather(asynchronous.match_best(spark, "Jane", NAMES), asynchronous.AsyncLinkage(plan).dedup(df))
        stream = [r async for r in asynchronous.match_stream(df.repartition(1).sortWithinPartitions("id"), "n", "smith", "levenshtein", 0.7, buffer_size=1)]
        return best, await asynchronous.collected(pairs), stream

    best, pairs, stream = asyncio.run(all_of_it())
    assert best[0] == "Jane Doe" and [(r.left_id, r.right_id) for r in pairs] == [(1, 2)]
    assert [(r.n, r["index"]) for r in stream] == [("smith", 0), ("smyth", 1)]


def test_indexed(spark):
    df = spark.range(100).repartitionByRange(5, "id").sortWithinPartitions("id")
    assert streams.indexed(df).filter(F.col("id") != F.col("index")).count() == 0
    assert streams.indexed(df.limit(0)).count() == 0


def test_measure(spark):
    pairs = spark.createDataFrame([("kitten", "sitting"), ("", ""), (None, "x")], "a string, b string")
    got = measure.benchmark_metrics(pairs, "a", "b", ["levenshtein", "jaro"], 1)
    assert got["n_pairs"] == 3 and {r["metric"] for r in got["results"]} == {"levenshtein", "jaro"} and all(r["pairs_per_sec"] > 0 for r in got["results"])
    assert measure.benchmark_metrics(pairs.limit(0), "a", "b")["results"] == []
    with pytest.raises(ValueError):
        measure.benchmark_metrics(pairs, "a", "b", ["nothing"])
    people = spark.createDataFrame([(1, "smith", "x"), (2, "smyth", "x")], "id long, n string, b string")
    got = measure.benchmark_pipeline(Linkage().block_exact("b").compare_string("n").classify_threshold(0.8), people, 1)
    assert got["n_matches"] == 1 and got["n_records"] == 2


def test_near_values_loses_nothing(spark):
    values = ["", "a", "ab", "abc", "abd", "abcdefghij", "abcdefghix", "bacdefghij", "zzzzzzzz", "zzzzzzzy", "aaaaaaaaaa", "aaaaaaaaa", "smith jones", "smyth jones", "smith jonas x"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for t in (0.6, 0.75, 0.9, 1.0):
        met = matching.near_values(df.toDF("a"), df.toDF("b"), "a", "b", (), "levenshtein", t)
        from kinloom.functions import similarity as sim

        found = {tuple(r) for r in met.filter(sim.levenshtein_similarity(F.col("a"), F.col("b")) >= t).select("a", "b").collect()}
        every = df.toDF("a").crossJoin(df.toDF("b"))
        assert found == {tuple(r) for r in every.filter(sim.levenshtein_similarity(F.col("a"), F.col("b")) >= t).collect()}, t


def test_fuzzy_merge(spark):
    left = spark.createDataFrame([("Jon",), ("ZZZZZ",), (None,)], "name string")
    right = spark.createDataFrame([("John", 1), ("Jonathan", 2)], "name string, k int")
    assert [tuple(r)[:3] for r in matching.fuzzy_merge(left, right, "name", "name").collect()] == [("Jon", "John", 1)]


def test_sources(spark):
    frame = pd.DataFrame({"name": ["a", None], "age": [1.5, float("nan")], "n": [1, 2], "mixed": ["x", 3]})
    got = io.to_frame(spark, frame)
    assert got.dtypes == [("id", "string"), ("name", "string"), ("age", "double"), ("n", "bigint"), ("mixed", "string")]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("0", "a", 1.5, 1, "x"), ("1", None, None, 2, "3")]
    assert io.to_frame(spark, pa.table({"id": [7], "t": ["x"]})).collect() == [(7, "x")]
    assert io.to_frame(spark, [{"id": "a", "x": 1}, {"id": "b"}]).count() == 2
    assert io.to_frame(spark, pd.DataFrame({"id": [], "x": []})).count() == 0
    with pytest.raises(TypeError):
        io.to_frame(spark, 5)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.csv").write_text("id,name\n1,John Smith\n2,Jon Smith\n3,Alice Zephyr\n")
    (tmp_path / "c.txt").write_text("Jane Doe\n\nJohn Smith\n")
    out = tmp_path / "out.json"
    cli.main(["dedupe", str(tmp_path / "p.csv"), "--field", "name", "--output", str(out), "--format", "json"], spark)
    assert [(r["left_id"], r["right_id"]) for r in json.loads(out.read_text())] == [("1", "2")]
    cli.main(["match", "John Smith", str(tmp_path / "c.txt"), "--limit", "1"], spark)
    assert capsys.readouterr().out.splitlines()[-1] == "John Smith,1.0,1"
    with pytest.raises(SystemExit):
        cli.main(["--version"], spark)
    assert "kinloom" in capsys.readouterr().out


def test_script_names(spark):
    with pytest.raises(ValueError):
        text.transliterate(F.lit("x"), "runes")
