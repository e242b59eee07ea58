"""Contributions of trees against the mean over all subsets; the vector index against a plain scan."""

from __future__ import annotations

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import boosting, explain, forecast, vectors


def expected(node, row, known):
    """What a tree predicts if only the known features are there: elsewhere both ways, by weight."""
    if len(node) == 2:
        return node[0]
    feature, threshold, left, right, weight = node
    if feature in known:
        return expected(left if row[feature] <= threshold else right, row, known)
    return sum(expected(c, row, known) * (c[-1] / weight if weight else 0.5) for c in (left, right))


def random_tree(rng, depth, features):
    if depth == 0 or rng.random() < 0.15:
        return float(rng.normal()), float(rng.integers(1, 9))
    left, right = random_tree(rng, depth - 1, features), random_tree(rng, depth - 1, features)
    return int(rng.integers(features)), float(rng.integers(0, 4)), left, right, left[-1] + right[-1]


@pytest.mark.parametrize("features", [1, 2, 3, 5, 8])
def test_contributions_are_the_mean_over_all_subsets(features):
    rng = np.random.default_rng(features)
    for depth in (0, 1, 2, 4):
        trees = [(float(rng.uniform(0.1, 1)), random_tree(rng, depth, features)) for _ in range(3)]
        rows = rng.integers(0, 5, (4, features)).astype(float)  # ties with thresholds
        ensemble = [(w, explain.leaves_of(t)) for w, t in trees]
        got = explain.contributions(ensemble, rows)
        for row, mine in zip(rows, got, strict=True):
            for j in range(features):
                others = [f for f in range(features) if f != j]
                want = 0.0
                for size in range(features):
                    for s in itertools.combinations(others, size):
                        share = math.factorial(size) * math.factorial(features - 1 - size) / math.factorial(features)
                        want += share * sum(w * (expected(t, row, {*s, j}) - expected(t, row, set(s))) for w, t in trees)
                assert mine[j] == pytest.approx(want, abs=1e-9)
            assert mine.sum() + explain.base_of(ensemble) == pytest.approx(sum(w * expected(t, row, set(range(features))) for w, t in trees))
        used = {f for _, leaves in ensemble for leaf in leaves for f in leaf.features.tolist()}
        assert all((got[:, f] == 0).all() for f in range(features) if f not in used)


def test_contributions_of_fitted_models(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b) if i % 9 else None, float(c), float(2 * a - (b > 0) * c + rng.normal() / 9)) for i, (a, b, c) in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, label double")
    features = ["a", "b", "c"]
    boosted = forecast.regressor(features, trees=6, depth=3, rate=0.3).fit(df)
    models = [boosted]
    for last in (RandomForestRegressor(labelCol="label", numTrees=4, maxDepth=4, seed=1), DecisionTreeRegressor(labelCol="label", maxDepth=3)):
        models.append(Pipeline(stages=[*boosted.stages[:-1], last]).fit(df))
    for model in models:
        found = explain.contributed(model, df, features, ["key"]).groupBy("key").agg(F.count("*").alias("n"), (F.first("base") + F.sum("score")).alias("total"))
        both = model.transform(df).join(found, "key").select("prediction", "total", "n").collect()
        assert len(both) == 300 and all(r.n == 3 and r.total == pytest.approx(r.prediction, abs=1e-9) for r in both)
    one = explain.contributed(boosted, df.limit(0), features, ["key"])
    assert one.columns == ["key", "base", "feature", "score"] and one.count() == 0
    drivers = forecast.drivers_of(boosted, df.limit(2), features, ["key"])
    assert {r.method for r in drivers.collect()} == {"shap_contrib"} and drivers.count() == 6


def test_the_value_above_all_thresholds_goes_right_when_it_is_no_number():
    tree = explain.leaves_of((0, 1.0, (2.0, 3.0), (5.0, 1.0), 4.0))
    got = explain.contributions([(1.0, tree)], np.array([[np.nan], [0.0], [1.0], [9.0]]))
    assert (got[:, 0] + explain.base_of([(1.0, tree)])).tolist() == pytest.approx([5.0, 2.0, 2.0, 5.0])


def points(spark, n=1500, size=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, size))
    rows = [(i, (centres[i % 20] + rng.normal(size=size) / 2).astype(np.float32).tolist(), "x", 1) for i in range(n)]
    rows += [(n + i, rows[5][1], "y", 2) for i in range(500)]  # a vector of many points
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, cell int"), rows


def scan(rows, query, k, metric):
    q = np.array(query, np.float64)
    out = []
    for i, v, *_ in rows:
        v = np.array(v, np.float64)
        out.append((i, float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)) if metric == "cosine" else -float(np.linalg.norm(v - q))))
    return sorted(out, key=lambda x: (-round(x[1], 6), x[0]))[:k]


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_index(spark, tmp_path, metric):
    df, rows = points(spark)
    odd = spark.createDataFrame([(9001, None, "x", 1), (9002, [float("nan")] * 16, "x", 1), (None, [1.0] * 16, "x", 1)], df.schema)
    index = vectors.VectorIndex.build(df.unionByName(odd), str(tmp_path / "index"), metric=metric)
    queries = df.where("vec_id % 100 = 0")
    exact = index.search(queries, k=10)
    got = exact.collect()
    for q in (0, 100, 1400):
        want = [s for _, s in scan(rows, rows[q][1], 10, metric)]
        assert [r.score for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == pytest.approx(want, abs=1e-5)
    about = index.search(queries, k=10, probes=12, rescored=40)
    assert vectors.recall(about, exact) >= 0.9
    assert vectors.recall(index.search(queries, k=10, probes=12, rescored=40, block_bytes=600), exact) >= 0.9
    probes = index.probes_for(queries, 0.9)
    assert 1 <= probes <= len(index.model.centres) and vectors.recall(index.search(queries, k=10, probes=probes), exact) >= 0.9
    own = index.search(queries, k=5, skip_own=True).collect()
    assert all(r.id != r.query_id for r in own) and len(own) == 5 * queries.count()

    index.upsert(spark.createDataFrame([(3, rows[0][1]), (5000, rows[0][1])], "vec_id long, embedding array<float>"))
    index.delete("id = 0")
    again = vectors.VectorIndex(spark, str(tmp_path / "index"))
    best = again.search(df.where("vec_id = 0"), k=2).collect()
    assert [(r.id, r["rank"]) for r in sorted(best, key=lambda r: r["rank"])] == [(3, 1), (5000, 2)]
    assert again.table.read().count() == len(rows)
    with pytest.raises(ValueError):
        again.upsert(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"))
    with pytest.raises(ValueError):
        vectors.VectorIndex.build(df.limit(0), str(tmp_path / "none"))


def test_a_search_reads_its_cells_only(spark, tmp_path):
    df, _ = points(spark)
    index = vectors.VectorIndex.build(df, str(tmp_path / "index"), cells=30)
    plan = index.search(df.where("vec_id = 7"), probes=2, rescored=20)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan


def test_a_search_task_holds_a_tile_whatever_the_queries(spark, tmp_path, monkeypatch):
    """All pairs of a batch at once were 2,500 x 2,500 x 24 bytes, several times over; the answers are the scan's."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(2500, 16)).astype(np.float32)
    rows[100:160] = rows[7]  # equal scores go by id
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<float>")
    index, tasks = vectors.VectorIndex.build(df, str(tmp_path / "index"), cells=4), []
    plain = type(df).mapInArrow
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, run, schema: tasks.append((self, run)) or plain(self, run, schema))
        index.search(df, 10, skip_own=True)
    (read, run), = tasks
    batches = read.toArrow().combine_chunks().to_batches()
    tracemalloc.start()
    (found,) = run(iter(batches))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    unit = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    scores = np.stack([(unit * u).sum(1) for u in unit])
    np.fill_diagonal(scores, -2)
    want = np.argsort(-scores, axis=1, kind="stable")[:, :10]
    assert np.array_equal(found.column("id").to_numpy()[np.argsort(found.column("query_id").to_numpy(), kind="stable")].reshape(2500, 10), want)


def test_a_search_by_codes_holds_a_tile_whatever_the_queries(spark, tmp_path, monkeypatch):
    """Codes of all pairs of a cell at once were 1,200 x 3,000 x 8 bytes, several times over; found is nearly all that a scan finds."""
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<float>")
    index, tasks = vectors.VectorIndex.build(df, str(tmp_path / "index"), cells=1), []
    plain = type(df).mapInArrow
    asked = df.where("vec_id < 1200")
    with monkeypatch.context() as m:
        m.setattr(vectors, "TILE", 1 << 16)
        m.setattr(type(df), "mapInArrow", lambda self, run, schema: tasks.append((self, run)) or plain(self, run, schema))
        found = index.search(asked, 10, rescored=60, skip_own=True)
        (read, run), = tasks
        batches = read.toArrow().combine_chunks().to_batches()
        tracemalloc.start()
        list(run(iter(batches)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert most < 20 << 20
    assert vectors.recall(found, index.search(asked, 10, skip_own=True)) >= 0.9


def boosted_plainly(x, y, w, cuts, s):
    """The same boosting in numpy, without row sampling."""
    n = x.shape[1]
    bins = np.column_stack([[sum(c < v for c in cuts[i]) for v in x[:, i]] for i in range(n)])
    margin = np.full(len(y), np.median(y) if s.absolute else (w * y).sum() / w.sum())
    for t in range(s.trees):
        columns = boosting.chosen_columns(n, t, s)
        g, h = w * (np.sign(margin - y) if s.absolute else margin - y), w
        groups, leaves = [(np.arange(len(y)), 0)], []
        while groups:
            rows, depth = groups.pop()
            width = max(len(cuts[c]) for c in columns) + 1
            hist = [np.array([np.bincount(bins[rows, c], v[rows], minlength=width) for c in columns]) for v in (g, h)]
            best = boosting.best_split(*hist, s) if depth < s.depth else None
            if best is None:
                leaves.append(rows)
                continue
            _, column, bin_ = best
            left = bins[rows, columns[column]] <= bin_
            groups += [(rows[left], depth + 1), (rows[~left], depth + 1)]
        step = np.zeros(len(y))
        for rows in leaves:
            step[rows] = s.rate * np.sort((y - margin)[rows])[(len(rows) - 1) // 2] if s.absolute else -s.rate * boosting.shrunk(g[rows].sum(), s.alpha) / (h[rows].sum() + s.lam)
        margin = margin + step
    return margin


@pytest.mark.parametrize("absolute", [False, True])
def test_boosting_equals_a_plain_version(spark, absolute):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(201, 4))
    x[:, 2] = rng.integers(0, 3, 201)
    y, w = x[:, 0] * 2 - (x[:, 1] > 0) + rng.normal(size=201) / 5, rng.uniform(0.2, 2, 201)
    df = spark.createDataFrame([(i, *map(float, r), float(b), float(c)) for i, (r, b, c) in enumerate(zip(x, y, w, strict=True))], "key long, a double, b double, c double, d double, label double, w double").repartition(3)
    s = boosting.Settings(trees=9, depth=3, rate=0.3, sample=1.0, columns=0.7, bins=16, absolute=absolute)
    features = ["a", "b", "c", "d"]
    model = boosting.fit(df, features, s, weight="w")
    got = {r.key: r.prediction for r in model.transform(df).collect()}
    cuts = boosting.cut_points(df.select(F.array(*features).alias("x")), 4, 16)
    want = boosted_plainly(x, y, w, cuts, s)
    assert [got[i] for i in range(201)] == pytest.approx(want.tolist(), abs=1e-6)
    assert np.abs(y - want).mean() < np.abs(y - y.mean()).mean() / 2 and int(np.argmax(model.importances)) == 0
    found = explain.contributed(model, df, features, ["key"]).groupBy("key").agg((F.first("base") + F.sum("score")).alias("total"))
    assert all(r.total == pytest.approx(got[r.key], abs=1e-9) for r in found.collect())


def test_boosting_of_nothing_and_of_parts(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, None), (None, 5.0, None)], "a double, label double, x string")
    small = boosting.Settings(trees=3, sample=0.5)
    assert boosting.fit(df.limit(0), ["a"], small).transform(df).select("prediction").collect() == [(0.0,), (0.0,)]
    model = boosting.fit(df, ["a"], small)
    model.save(str(tmp_path / "model"))
    again = boosting.Boosted.load(str(tmp_path / "model"))
    assert again.transform(df).collect() == model.transform(df).collect() and again.transform(df).columns == ["a", "label", "x", "prediction"]
    bundle = forecast.Bundle(model, ["a"])
    bundle.save(str(tmp_path / "bundle"))
    assert forecast.Bundle.load(str(tmp_path / "bundle")).model.transform(df).collect() == model.transform(df).collect()
