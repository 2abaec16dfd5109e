"""Core operators on the small fixtures of the domain: people, edges, scored labels."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinloom import cli
from kinloom.operators import blocking, clustering, comparing, evaluation, keyed, matching, search, skew, training
from kinloom.plans.linkage import Linkage
from kinloom.sources import io


def pairs(df):
    return sorted((r[0], r[1]) for r in df.select("left_id", "right_id").collect())


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("1", "John", "Smith"), ("2", "Jon", "Smyth"), ("3", "Jane", "Doe"), ("4", None, None)], "id string, first_name string, last_name string")


def test_dedup_and_clusters(spark, people):
    plan = Linkage().block_phonetic("last_name").compare_string("first_name").compare_string("last_name").classify_threshold(0.8)
    out = plan.dedup(people)
    assert pairs(out) == [("1", "2")] and out.columns == ["left_id", "right_id", "score", "match_class", "scores"]
    plan.cluster_connected_components()
    assert sorted(map(tuple, plan.dedup_cluster(people).collect())) == [(0, "1"), (0, "2")]
    again = Linkage.from_json(plan.to_json())
    assert again.to_json() == plan.to_json() and pairs(again.dedup(people)) == [("1", "2")]
    assert plan.dedup(people.limit(0)).count() == 0


def test_link_and_early_rejection(spark):
    left = spark.createDataFrame([("a1", "John Smith", "x"), ("a2", "Jane Doe", "y")], "id string, name string, k string")
    right = spark.createDataFrame([("b1", "Jon Smith", "x"), ("b2", "Bob Jones", "z")], "id string, name string, k string")
    plan = Linkage().block_sorted_neighborhood("name", 5).compare_exact("k").compare_string("name").classify_threshold(0.85)
    assert pairs(plan.link(left, right)) == [("a1", "b1")]
    weighted = Linkage().block_sorted_neighborhood("name", 5).compare_exact("k").compare_string("name").classify_weighted([1.0, -1.0], 0.0)
    assert weighted._best_case([0], [1]) is None  # negative weights: no bound


def test_plan_errors():
    with pytest.raises(ValueError):
        Linkage().compare_exact("x").classify_threshold(0.5).build()
    for bad in (lambda: Linkage().compare_string("x", "nope"), lambda: Linkage().block_phonetic("x", "nope"), lambda: Linkage().preprocess("x", ["nope"]), lambda: Linkage().cluster_hierarchical("nope"), lambda: Linkage().combine("nope"), lambda: Linkage().block_custom("nope")):
        with pytest.raises(ValueError):
            bad()


def test_profiling_and_custom_blocker(spark, people):
    from kinloom.functions import registry

    class All:
        def block_dedup(self, df):
            a, b = df.select(F.col("id").alias("left_id")), df.select(F.col("id").alias("right_id"))
            return a.join(b, F.col("left_id") < F.col("right_id"))

        def block_link(self, left, right):
            return left.select(F.col("id").alias("left_id")).join(right.select(F.col("id").alias("right_id")), F.lit(True))

    registry.register_blocker("all", All())
    plan = Linkage().block_custom("all").compare_string("last_name").classify_threshold(0.8).with_profiling()
    assert pairs(plan.dedup(people)) == [("1", "2")]
    assert plan.profiling_stats()["blocking_rows"] == 6
    with pytest.raises(ValueError):
        plan.to_json()
    registry.unregister_blocker("all")


def test_blockers_against_models(spark):
    values = ["smith", "smyth", "Smithe", "jones", None, "", "jo", "smith", "jonas", "aaaa"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    there = [(i, v) for i, v in enumerate(values) if v is not None]

    def expect(ok):
        return sorted((i, j) for i, a in there for j, b in there if i < j and ok(a, b))

    assert pairs(blocking.exact(df, None, "v")) == expect(lambda a, b: a == b)

    def grams(s):
        s = s.lower()
        return [s] if len(s) < 3 else [s[i : i + 3] for i in range(len(s) - 2)]

    assert pairs(blocking.qgram(df, None, "v", 3, 2)) == expect(lambda a, b: sum(grams(b).count(g) for g in grams(a)) >= 2)
    prefix = lambda a, b: any(a[:k] == b[:k] and sum(v.startswith(a[:k]) for _, v in there) <= 3 for k in range(2, min(len(a), len(b)) + 1))
    assert pairs(blocking.trie(df, None, "v", 2, 3)) == expect(prefix)
    order = sorted(there, key=lambda x: (x[1].lower(), x[0]))
    near = sorted(tuple(sorted((order[i][0], order[j][0]))) for i in range(len(order)) for j in (i + 1, i + 2) if j < len(order))
    assert pairs(blocking.sorted_neighborhood(df, None, "v", 3)) == near
    assert set(expect(lambda a, b: a == b and a)) <= set(pairs(blocking.lsh(df, None, "v", 60, 20)))
    numbers = spark.createDataFrame([(1, 1.0), (2, 7.0), (3, 14.0), (4, None), (5, -1.0)], "id int, n double")
    assert pairs(blocking.numeric(numbers, None, "n", 5.0)) == [(1, 2), (1, 5), (2, 3)]
    blocking.SLICE, kept = 1, blocking.SLICE  # every block is cut: the same pairs
    try:
        assert pairs(blocking.exact(df, None, "v")) == expect(lambda a, b: a == b)
    finally:
        blocking.SLICE = kept
    assert pairs(blocking.canopy(df.filter("v in ('smith', 'smyth', 'jones')"), None, "v", 0.95, 0.8)) == [(0, 1), (0, 7), (1, 7)]


def test_comparators(spark):
    rows = spark.createDataFrame([("2020-01-02", "2020-02-02", 10.0, 14.0), (None, "2020-01-01", None, 1.0), ("x", "2020-01-01", 1.0, 1.0)], "a string, b string, x double, y double").coalesce(1)
    got = rows.select(comparing.compare_date(F.col("a"), F.col("b")).alias("d"), comparing.compare_numeric(F.col("x"), F.col("y"), 10).alias("n"), comparing.compare_exact(F.col("a"), F.col("b")).alias("e"), comparing.compare_phonetic(F.lit("Robert"), F.lit("Rupert")).alias("p")).collect()
    assert [round(r.d, 6) for r in got] == [0.7, 0.0, 0.0] and [r.n for r in got] == [0.6, 0.0, 1.0] and {r.e for r in got} == {0.0} and got[0].p == 1.0


def test_classifiers_and_training(spark):
    rows = [([0.9, 0.95], True), ([0.85, 0.9], True), ([0.1, 0.15], False), ([0.2, 0.1], False), ([0.8, 0.85], True), ([0.15, 0.2], False)]
    df = spark.createDataFrame(rows, "scores array<double>, label boolean").coalesce(1)
    lr = training.train_logistic_regression(df)
    tree = training.train_decision_tree(df, min_samples_leaf=1, min_samples_split=2)
    assert comparing.DecisionTree.from_json(tree.to_json()) == tree
    for model in (lr, tree):
        assert all((r.match_class == "match") == r.label for r in training.predict(df, model).collect())
    em = training.estimate_fellegi_sunter(df, 2)
    assert em.converged and abs(em.p_match - 0.5) < 0.01 and em.m_probabilities[0] > 0.99
    assert training.estimate_fellegi_sunter(df.limit(0), 2).iterations == 0
    fs = comparing.fellegi_sunter([0.9], [0.1], 3.0, -1.0, 2)
    got = {tuple(r.scores): r.c.match_class for r in df.select("scores", fs(F.col("scores")).alias("c")).collect()}
    assert got[(0.9, 0.95)] == "match" and got[(0.1, 0.15)] == "non_match"
    with pytest.raises(ValueError):
        training.train_logistic_regression(df.limit(0))


EDGES = [(0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.85), (3, 4, 0.9), (4, 5, 0.9), (3, 5, 0.85)]


def graph(spark, edges, n):
    return spark.range(n).select(F.col("id").cast("int")), spark.createDataFrame(edges, "left_id int, right_id int, score double")


def test_density(spark):
    nodes, edges = graph(spark, EDGES, 7)
    want = [0, 0, 0, 1, 1, 1, -1]
    assert [r.label for r in clustering.dbscan(nodes, edges, 0.8, 2).orderBy("record_id").collect()] == want
    assert [r.label for r in clustering.optics(nodes, edges, 2, 0.8).orderBy("record_id").collect()] == want
    for linkage in ("single", "complete", "average"):
        got = sorted(map(tuple, clustering.hierarchical(edges, linkage, 0.2).collect()))
        assert got == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5)], linkage


def test_quality(spark):
    e = [(0, 1, 0.95), (2, 3, 0.95), (0, 2, 0.1), (0, 3, 0.1), (1, 2, 0.1), (1, 3, 0.1)]
    _, edges = graph(spark, e, 4)
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "record_id int, label int")
    assert abs(clustering.silhouette_score(edges, labels).first()[0] - (0.9 - 0.05) / 0.9) < 1e-9
    assert abs(clustering.davies_bouldin_index(edges, labels).first()[0] - 0.1 / 0.9) < 1e-9
    one = labels.withColumn("label", F.lit(0))
    assert clustering.silhouette_score(edges, one).first()[0] == 0.0 == clustering.davies_bouldin_index(edges, one).first()[0]


def test_components_and_incremental(spark):
    edges = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y"), (None, "z"), ("q", "q"), ("y", "x")], "left_id string, right_id string")
    assert sorted(map(tuple, clustering.components(edges).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    chain = spark.range(40).select(F.format_string("%03d", "id").alias("left_id"), F.format_string("%03d", F.col("id") + 1).alias("right_id"))
    assert clustering.components(chain).groupBy("component").count().collect()[0]["count"] == 41
    state = clustering.IncrementalCluster(threshold=0.85)
    assert [state.add_record(v)[0] for v in ("John Smith", "John Smith", "Alice Johnson", "Jon Smith")] == [0, 0, 1, 0]
    assert state.cluster_count == 2 and state.record_count == 4


def test_evaluation(spark):
    p, t = (spark.createDataFrame(x, "left_id string, right_id string") for x in ([("1", "2"), ("3", "4"), ("2", "1"), (None, "4")], [("2", "1"), ("5", "6")]))
    r = evaluation.confusion_matrix(p, t, 10).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.f1) == (1, 1, 1, 7, 0.5)
    assert evaluation.precision(p.limit(0), t) == 0.0
    scored = spark.createDataFrame([("1", "2", 0.9), ("3", "4", 0.4), ("5", "6", 0.4)], "left_id string, right_id string, score double")
    best = evaluation.optimal_threshold(scored, t).first()
    assert best.threshold == 0.4 and abs(best.f1 - 0.8) < 1e-9
    assert evaluation.auc(evaluation.roc_curve(scored, t, 10)).first()[0] > 0
    labelled = spark.createDataFrame([(s, s > 0.5) for s in (0.9, 0.8, 0.7, 0.3, 0.2, 0.1)], "score double, label boolean")
    got = evaluation.optimize_threshold(labelled, n_thresholds=10)
    assert got.f1 == 1.0 and got.all_results.count() == 11
    learner = evaluation.ActiveLearner("jaro_winkler", 0.85)
    learner.score_pairs(spark.createDataFrame([(0, "John"), (1, "Jon"), (2, "Zed")], "i int, v string"), "i", "v")
    assert learner.uncertain_pairs(1).first()["left"] == 0
    assert learner.update_from_labels(spark.createDataFrame([(0, 1, "match"), (0, 2, "non_match")], "left int, right int, label string")) < 0.85
    with pytest.raises(ValueError):
        evaluation.optimize_threshold(labelled, criterion="nope")


def test_matching(spark):
    c = spark.createDataFrame([(0, "John Smith"), (1, "Jane Doe"), (2, "John Smith"), (3, None)], "i int, v string")
    got = matching.match_batch(c, "v", "i", "John Smith", threshold=0.5).collect()
    assert [r.i for r in got][:2] == [0, 2]
    assert matching.match_best(c, "v", "i", "John Smith").first().i == 0
    left = spark.createDataFrame([(1, "Jon"), (2, "ZZZZZ"), (3, None)], "k int, name string")
    right = spark.createDataFrame([("John", 1), ("Jonathan", 2), ("Jonas", 3)], "name string, k int")
    out = matching.fuzzy_join(left, right, on="name", threshold=0.7, how="left", limit=2)
    assert out.columns == ["k", "name", "name_right", "k_right", "_score"]
    assert sorted((r.k, r.name_right or "") for r in out.collect()) == [(1, "John"), (1, "Jonas"), (2, ""), (3, "")]
    assert matching.fuzzy_join(left, right, on="name", threshold=0.999).count() == 0
    for bad in ({"on": None}, {"on": "name", "how": "outer"}, {"on": "name", "limit": 0}, {"on": "nope"}):
        with pytest.raises(ValueError):
            matching.fuzzy_join(left, right, **bad)
    assert matching.cdist_local(spark, ["a", "b"], ["a"], "levenshtein").tolist() == [[1.0], [0.0]]
    model = matching.TfIdf.fit(c.filter("v is not null"), "v")
    assert [r.i for r in model.match_batch("smith", c, "i", "v").collect()][:2] == [0, 2]
    assert sorted(map(tuple, matching.deduplicate(c, "i", "v", threshold=0.95).collect())) == [(0, 0), (0, 2)]


def test_search(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(["hello", "help", "world", "held", "helm", None])), "id int, value string")
    near = search.NearestIndex.build(rows)
    assert [r.id for r in near.find_within("helo", 1).collect()] == [0, 1, 3, 4] and [r.id for r in near.find_nearest("hello", 1).collect()] == [0]
    assert "help" in near and near.remove(1) and "help" not in near and not near.remove(99)
    near.insert(spark.createDataFrame([(7, "halo")], "id int, value string"))
    near.save(str(tmp_path / "near"))
    assert len(search.NearestIndex.load(spark, str(tmp_path / "near"))) == 5
    grams = search.PostingsIndex.build(rows, kind="ngram:2")
    assert [r.id for r in grams.search_top_k("held", 2).collect()] == [3, 0] and grams.vocab_size() > 5
    low = search.MinHashIndex.build(rows)
    assert [r.id for r in low.query("hello", 0.9).collect()] == [0]
    bloom = search.BloomFilter(spark, 100, 0.01)
    bloom.insert(rows, "value")
    asked = bloom.contains(spark.createDataFrame([("hello",), ("nothere",), (None,)], "v string"), "v")
    assert {r.v: r.maybe for r in asked.collect()} == {"hello": True, "nothere": False, None: False}


def test_sources_and_cli(spark, tmp_path, capsys):
    frame = io.to_frame(spark, pd.DataFrame({"name": ["John Smith", None]}))
    assert [tuple(r) for r in frame.collect()] == [("0", "John Smith"), ("1", None)]
    with pytest.raises(TypeError):
        io.to_frame(spark, 3)
    path = tmp_path / "in.csv"
    path.write_text("id,name\n1,John Smith\n2,Jon Smith\n3,Zed\n")
    assert cli.main(["dedupe", str(path), "--field", "name", "--output", str(tmp_path / "out.csv")], spark) == 0
    assert (tmp_path / "out.csv").read_text().splitlines()[1].startswith("1,2,")
    (tmp_path / "lines.txt").write_text("John Smith\n\n  Bob \n")
    cli.main(["match", "Jon Smith", str(tmp_path / "lines.txt")], spark)
    cli.main(["explain", "ab", "ab", "--metrics", "levenshtein"], spark)
    printed = capsys.readouterr().out
    assert "John Smith," in printed and "levenshtein,1.0000" in printed
    m = spark.createDataFrame([("1", "2", 0.9, "match", [0.9])], "left_id string, right_id string, score double, match_class string, scores array<double>")
    io.write_single_json(m, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())[0]["scores"] == [0.9]


def test_keyed(spark):
    rows = [("r1", "K", "a", 0), ("r2", "K", "a", 0), ("r3", "K", "b", 10), ("r4", "K", "b", 3610), ("r5", "K", "b", 7300), ("r10", "K", "a", 0), ("r6", None, "b", 7300), ("r7", "L", None, 1), ("r8", "L", None, 2), ("r9", "K", "b", None)]
    df = spark.createDataFrame(rows, "id string, k string, v string, s int").withColumn("t", F.timestamp_seconds("s")).withColumn("slice", F.lit(1))
    got = sorted(r.id for r in keyed.direct_predecessors(df, "k", "t", "id", "v").collect())
    assert got == ["r10", "r2", "r4"]
    hot = spark.range(3000).select(F.format_string("r%04d", "id").alias("id"), F.lit("K").alias("k"), (F.col("id") % 2).cast("string").alias("v"), F.lit(0).cast("timestamp").alias("t"))
    assert keyed.direct_predecessors(hot, "k", "t", "id", "v").count() == 0
    assert keyed.direct_predecessors(hot.withColumn("v", F.lit("x")), "k", "t", "id", "v").count() == 2999
    assert keyed.direct_predecessors(df.limit(0), "k", "t", "id", "v").count() == 0
    p = {r.key: r for r in keyed.value_profile(df, "k", "v", (0.5,)).collect()}
    assert (p["K"].n, p["K"].n_distinct, p["K"].mode, p["K"].mode_n, p["K"].p50) == (7, 2, "b", 4, "b") and "L" not in p
    numbers = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") - 500).alias("v"))
    assert keyed.value_profile(numbers, "k", "v", (0.5,)).first().p50 == -1


def test_join_lookup(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(90)] + [(f"k{i}", i) for i in range(10)] + [(None, 1)], "k string, i int")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    for bound in (1, 3, 1000):
        assert skew.join_lookup(rows, sizes, ["k"], "n", 101, bound).count() == 100


def test_block_join_has_no_product(spark, people):
    plan = blocking.exact(people, None, "last_name")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("least,most", [(2, 5), (1, 3), (3, 12)])
def test_trie_against_all_prefixes(spark, least, most):
    import random
    from collections import Counter, defaultdict

    rng = random.Random(3)
    long = "ab" * 19
    values = ["".join(rng.choice("ab") for _ in range(rng.randrange(26))) for _ in range(300)] + [long] * 9 + [None, "", "a"] + [long + c for c in "xyz"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    count = Counter(v[:k] for v in values if v for k in range(least, len(v) + 1))
    groups = defaultdict(list)
    for i, v in enumerate(values):
        for k in range(least, len(v or "") + 1):
            if count[v[:k]] <= most:
                groups[v[:k]].append(i)
    want = {(x, y) for g in groups.values() for y in g for x in g if x < y}
    assert {tuple(r) for r in blocking.trie(df, None, "v", least, most).collect()} == want
    assert blocking.trie(df.limit(0), None, "v").count() == 0


def _many_vectors(spark):
    import random

    rng = random.Random(5)
    rows = [([round(rng.random(), 2), round(rng.random(), 2), None if i % 50 == 7 else rng.choice([0.1, 0.5])], rng.random() < 0.5) for i in range(400)]
    rows = [(s, s[0] + s[1] > 1 if i % 10 else y) for i, (s, y) in enumerate(rows)]
    return spark.createDataFrame(rows * 3 + rows[:100], "scores array<double>, label boolean")


def test_logistic_training_on_more_vectors_than_the_driver_takes(spark, monkeypatch):
    df = _many_vectors(spark).select(F.slice("scores", 1, 2).alias("scores"), "label")
    here = training.train_logistic_regression(df, max_iterations=30)
    monkeypatch.setattr(training, "MAX_LABELLED", 100)
    spread = training.train_logistic_regression(df, max_iterations=30)
    assert [*spread.weights, spread.bias] == pytest.approx([*here.weights, here.bias], abs=1e-12) and max(here.weights) > 0.1


def test_tree_training_on_more_vectors_than_the_driver_takes(spark, monkeypatch):
    df = _many_vectors(spark)
    here = training.train_decision_tree(df, max_depth=4)
    monkeypatch.setattr(training, "MAX_LABELLED", 100)
    spread = training.train_decision_tree(df, max_depth=4)

    def flat(node):
        return [round(node["p"], 12), node["n"]] if "p" in node else [node["feature"], round(node["threshold"], 12), *flat(node["left"]), *flat(node["right"])]

    assert flat(spread.root) == flat(here.root) and len(flat(here.root)) > 8


@pytest.mark.parametrize("metric", ["levenshtein", "damerau_levenshtein"])
def test_one_edit_among_values_of_common_bigrams(spark, metric):
    values = ["", "a", "b", "ab", "ba", "añb", "🙂a", None, *(f"Customer#{i:09d}" for i in range(0, 3000, 7)), "Customer#000000770", "Customer#00000007"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, value string")
    asked = df.filter("value is null or id % 5 <> 1").select(F.col("value").alias("query"))
    met = matching.within_one_edit(asked.distinct().filter("query is not null"), df.select("value").filter("value is not null").distinct(), "query", "value")
    assert met.count() < 40 * len(values)  # the product is over 100 000
    d = F.levenshtein("query", "value") if metric == "levenshtein" else search.NearestIndex.DISTANCES[metric](F.col("query"), F.col("value"))
    want = df.crossJoin(asked.distinct()).withColumn("distance", d).filter("distance <= 1").select("query", "id", "value", "distance")
    got = search.NearestIndex.build(df, metric=metric).find_within_all(asked, 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_incremental_clusters_compare_a_repeated_value_once(monkeypatch):
    import random

    from kinloom.functions import kernels, similarity

    rng = random.Random(7)
    values = [rng.choice(["anna", "anne", "hanna", "bob", "bobby", "rob", "", "zoe"]) + rng.choice(["", "x"]) for _ in range(600)]
    calls, plain = [], kernels.pairwise
    kernel = similarity._BATCHED["jaro_winkler"]
    reps, want = [], []
    for v in values:
        scores = [float(plain(kernel, pd.Series([v]), pd.Series([r]))[0]) for r in reps]
        i = max(range(len(reps)), key=lambda k: (scores[k], -k), default=-1)
        if i >= 0 and scores[i] > 0 and scores[i] >= 0.85:
            want.append((i, False, scores[i]))
        else:
            reps.append(v)
            want.append((len(reps) - 1, True, 1.0))
    monkeypatch.setattr(kernels, "pairwise", lambda *a: calls.append(1) or plain(*a))
    state = clustering.IncrementalCluster("jaro_winkler", 0.85)
    assert [state.add_record(v) for v in values] == want
    assert len(calls) < 150 and sorted(i for c in state.get_clusters() for i in c) == list(range(600))


@pytest.mark.parametrize("odd", [[], [float("nan")]])
def test_numbers_that_are_too_far_apart_do_not_meet(spark, odd):
    import random

    rng = random.Random(9)
    x = [rng.choice([rng.uniform(-300, 300), float(rng.randrange(-30, 30) * 10)]) for _ in range(150)] + [None, float("inf"), float("-inf"), 1e300, *odd]
    df = spark.createDataFrame([(i, "n", rng.choice(["ann", "anne", "bob"]), v) for i, v in enumerate(x)], "id long, k string, name string, x double")
    plan = Linkage().block_exact("k").compare_numeric("x", 50.0).compare_string("name", "levenshtein").compare_exact("k").classify_threshold_bands(0.9, 0.8)
    every = Linkage().block_exact("k").compare_numeric("x", 50.0).compare_string("name", "levenshtein").compare_exact("k").classify_threshold_bands(0.9, 0.8)
    every._band = lambda *_: None
    for run in (lambda p: p.dedup(df), lambda p: p.link(df, df.filter("id % 3 = 0"))):
        rows = lambda p: sorted((r.left_id, r.right_id, str(r.score), r.match_class) for r in run(p).collect())  # noqa: E731, B023
        assert rows(plan) == rows(every) and len(rows(plan)) > 100
    if not odd:
        assert plan._band(df, None) == ("x", pytest.approx(30.0, rel=1e-6))
        small = df.filter("id < 150")
        assert plan.vectors(plan._prepared(small)).count() < 0.5 * 150 * 149 / 2


def test_records_with_equal_fields_are_judged_once(spark, monkeypatch):
    import random

    from kinloom.plans import linkage

    monkeypatch.setattr(linkage, "CHUNK", 7)
    rng = random.Random(11)
    rows = [(f"r{i}", rng.choice(["k", "l", None]), rng.choice(["Ann", "anne", "bob", None]), rng.choice([1.0, 2.0, None])) for i in range(240)]
    df = spark.createDataFrame(rows, "id string, k string, name string, x double")
    plan, every = (Linkage().preprocess("name", ["fold_case"]).block_exact("k").compare_string("name", "levenshtein").compare_numeric("x", 5.0).classify_threshold(0.7) for _ in range(2))
    every._repeated = lambda _: False
    for run in (lambda p: p.dedup(df), lambda p: p.link(df, df.filter("id < 'r2'"))):
        got, want = (sorted((r.left_id, r.right_id, r.score, r.match_class, *r.scores) for r in run(p).collect()) for p in (plan, every))  # noqa: B023
        assert got == want and len(got) > 500
    judged = []
    monkeypatch.setattr(Linkage, "_judged", lambda self, a, b, plain=Linkage._judged: judged.append(a.count()) or plain(self, a, b))
    plan.dedup(df)
    assert judged == [df.select("k", F.lower("name"), "x").distinct().count()]


def test_short_values_meet_by_their_letters(spark):
    import random

    rng = random.Random(13)
    made = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(120)] + ["🙂a", "aa🙂", "Customer#000000001", "Supplier#000000012", "x" * 40, "x" * 38 + "yz", *(f"name of row {i:02d}" for i in range(60))]
    left, right = (spark.createDataFrame([(i, v) for i, v in enumerate(made) if i % 2 == k], f"{n}i long, {n} string") for k, n in ((0, "p"), (1, "q")))
    for t in (0.6, 0.8):
        near = matching.near_values(left, right, "p", "q", (), "levenshtein", t)
        score = 1 - F.levenshtein("p", "q") / F.greatest(F.length("p"), F.length("q"), F.lit(1))
        rows = lambda df: sorted(tuple(r) for r in df.filter(score >= t).select("pi", "qi").collect())  # noqa: E731, B023
        assert rows(near) == rows(left.crossJoin(right)) and len(rows(near)) > 20
    alike, other = (spark.createDataFrame([(f"{c * 9}{i:04d}",) for i in range(40)], f"{n} string") for n, c in (("p", "k"), ("q", "m")))
    assert matching.near_values(alike, other, "p", "q", (), "levenshtein", 0.6).count() == 0


def test_plan_from_json_judges_equal_records_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, "k", f"name {i % 3}") for i in range(60)], "id long, k string, name string")
    plan = Linkage().block_exact("k").compare_string("name", "levenshtein").classify_threshold(0.9)
    judged = []
    monkeypatch.setattr(Linkage, "_judged", lambda self, a, b, plain=Linkage._judged: judged.append(a.count()) or plain(self, a, b))
    got = Linkage.from_json(plan.to_json()).dedup(df)
    assert pairs(got) == [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 == j % 3] and judged == [3]
