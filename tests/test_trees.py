"""Histogram trees against a plain version, cut back, and over rows that stay where they are."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from panelforge.functions.permute import bijection, numbered, shuffled
from panelforge.operators import models, targets, trees
from panelforge.operators.linear import moments, monthly_moments

NAMES = ["a", "b", "c"]


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = x[:, 0] * (x[:, 1] > 0) + 0.1 * rng.normal(size=n)
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "PERMNO long, a double, b double, c double, t double").repartition(3), x, y


def plain_boosting(x, y, spec):
    """Level by level with a loop over nodes, features and cuts; x holds bins."""
    pred, out = np.full(len(y), y.mean()), []
    for _ in range(spec.trees):
        left, rows, level, leaves, values = y - pred, {0: np.arange(len(y))}, [0], 1, np.zeros(len(y))
        depth = 0
        while level and (spec.depth is None or depth < spec.depth) and leaves < spec.leaves:
            found = []
            for node in level:
                r = rows[node]
                g, best = left[r].sum(), (1e-12, None)
                for f in range(x.shape[1]):
                    for cut in np.unique(x[r, f]):
                        low = x[r, f] <= cut
                        if min(low.sum(), (~low).sum()) >= spec.min_leaf:
                            a, b = left[r][low].sum(), left[r][~low].sum()
                            gain = round(a * a / (low.sum() + spec.l2) + b * b / ((~low).sum() + spec.l2) - g * g / (len(r) + spec.l2), 12)
                            if gain > best[0]:
                                best = (gain, (f, cut))
                if best[1]:
                    found.append((-best[0], node, best[1]))
            level = []
            for _, node, (f, cut) in sorted(found):
                if leaves >= spec.leaves:
                    break
                r = rows.pop(node)
                for low in (True, False):
                    child = 2 * node + 2 - low
                    rows[child] = r[(x[r, f] <= cut) == low]
                    level.append(child)
                leaves += 1
            depth += 1
        for r in rows.values():
            values[r] = left[r].sum() / (len(r) + spec.l2)
        pred = pred + spec.rate * values
        out.append(pred)
    return out[-1]


@pytest.mark.parametrize(("depth", "l2", "leaves"), [(3, 0.0, 31), (None, 1.0, 31), (None, 0.0, 5), (2, 5.0, 31)])
def test_boosting_equals_a_plain_version(spark, depth, l2, leaves):
    df, x, y = table(spark)
    spec = trees.TreeSpec(True, depth, 6, 10, 0.3, l2, leaves)
    (model,) = trees.fit_trees(df, NAMES, "t", [spec], ["PERMNO"])
    want = plain_boosting(trees.binned(list(x.T), model.edges), y, spec)
    assert np.allclose(model.predict(x), want, atol=1e-9) and np.var(y - model.predict(x)) < 0.6 * np.var(y)


def test_a_forest_cut_back_is_the_forest_of_that_depth(spark):
    df, x, y = table(spark)
    spec = trees.TreeSpec(False, 8, 7, 5, columns="sqrt")
    deep, cut = trees.fit_trees(df, NAMES, "t", [spec, replace(spec, depth=3)], ["PERMNO"])
    (own,) = trees.fit_trees(df, NAMES, "t", [replace(spec, depth=3)], ["PERMNO"])
    assert deep.trees is cut.trees and max(len(t.feature) for t in own.trees) <= 15 < max(len(t.feature) for t in deep.trees)
    assert np.allclose(cut.predict(x), own.predict(x), atol=1e-12) and not np.allclose(cut.predict(x), deep.predict(x))
    assert np.corrcoef(deep.predict(x), y)[0, 1] > 0.8


def test_rows_that_stay_where_they_are_give_the_same_trees(spark, monkeypatch):
    df, x, _ = table(spark)
    specs = [trees.TreeSpec(True, 3, 4, 10, 0.3, 1.0, 31), trees.TreeSpec(True, None, 3, 10, 0.1, 0.0, 6), trees.TreeSpec(False, 4, 5, 10, columns=0.5)]
    here = trees.fit_trees(df, NAMES, "t", specs, ["PERMNO"])
    monkeypatch.setattr(trees, "LOCAL_BYTES", 0)
    monkeypatch.setattr(trees, "WRITE_ROUNDS", 2)
    monkeypatch.setattr(trees, "SIDE_BY_SIDE", 3)
    there = trees.fit_trees(df, NAMES, "t", specs, ["PERMNO"])
    for a, b in zip(here, there, strict=True):
        assert np.allclose(a.predict(x), b.predict(x), atol=1e-9)
    assert trees.fit_trees(df.limit(0), NAMES, "t", specs, ["PERMNO"]) is None


def test_monthly_moments_add_up(spark, day):
    rng = np.random.default_rng(4)
    months = [day(f"2001-{m:02d}-28") for m in range(1, 7)]
    names = [f"f{i}" for i in range(50)]
    rows = [(p, m, *map(float, rng.normal(size=51) + 1000)) for m in months for p in range(70)]
    df = spark.createDataFrame(rows, "PERMNO long, MthCalDt date, " + ", ".join(f"{c} double" for c in [*names, "t"]))
    monthly = monthly_moments(df, [*names, "t"])
    some, want = monthly.between(months[1], months[3]), moments(df.where(f"MthCalDt between '{months[1]}' and '{months[3]}'"), [*names, "t"])
    assert some.n == want.n == 210 and np.allclose(some.mean, want.mean) and np.allclose(some.cross, want.cross, atol=1e-6)
    got = {r.MthCalDt: np.array(r.coefficients) for r in models.monthly_regressions(df, names, "t").collect()}
    assert len(got) == 6
    for m in months:
        mine = np.array([r[2:] for r in rows if r[1] == m])
        x = np.column_stack([np.ones(70), mine[:, :50]])
        assert np.allclose(got[m], np.linalg.lstsq(x, mine[:, 50], rcond=None)[0], atol=1e-6)
    assert models.monthly_regressions(df.where("PERMNO < 54"), names, "t").count() == 0


def test_permutations(spark):
    for n in (1, 2, 3, 64, 1000):
        got = bijection(np.arange(n), n, 5)
        assert sorted(got) == list(range(n)) and (n < 64 or (got != bijection(np.arange(n), n, 6)).any())
    rows = spark.createDataFrame([(i % 3, i) for i in range(500)], "g int, v int").repartition(4)
    out, sizes = numbered(rows, "g")
    from pyspark.sql import functions as F

    got = out.withColumn("p", shuffled(F.col("g"), F.col("number"), F.lit(2), sizes, 1)).toPandas()
    for g, part in got.groupby("g"):
        assert sorted(part.number) == sorted(part.p) == list(range(sizes[g])) and (part.number != part.p).any()


def test_all_runners_end_and_importance_finds_the_feature(spark, day):
    """The whole run over made months: every default estimator builds, fits and predicts, on every fold."""
    rng = np.random.default_rng(5)
    months = [day(f"{2000 + i // 12}-{i % 12 + 1:02d}-28") for i in range(40)]
    rows = [(p, m, *map(float, x), float(2 * x[0] + 0.5 * rng.normal())) for m in months for p in range(30) for x in [rng.normal(size=3)]]
    df = spark.createDataFrame(rows, "PERMNO long, MthCalDt date, mom_12_1 double, b double, c double, t double")
    config = targets.ModelConfig(min_train=24)
    folds = targets.walk_forward_folds(months, config)
    names = ["mom_12_1", "b", "c"]
    few = {"random_forest": {"trees": (6,), "max_depth": (3, 5), "min_samples_leaf": (50,), "max_features": ("sqrt", 0.5)}, "hist_gradient_boosting": {"rounds": (8,), "max_depth": (3, None), "learning_rate": (0.1,), "l2_regularization": (0.0, 1.0)}}
    small = tuple(replace(e, grid=few.get(e.name, e.grid)) for e in models.ESTIMATORS)
    got = models.walk_forward(df, names, "t", folds, models.runners(small), config).toPandas()
    assert set(got.model) == set(models.runners()) and got.groupby("model").fold_id.nunique().eq(len(folds)).all()
    for name, g in got.groupby("model"):
        assert len(g) == len(got) // 8 and (name == "equal_weight" or np.corrcoef(g.y_true, g.y_pred)[0, 1] > 0.7)
    for e in (models.RIDGE, small[-1]):
        gains = models.permutation_importance(e, df, names, "t", folds, config).toPandas()
        assert len(gains) == 3 * len(folds)
        mean = gains.groupby("feature").importance_mean.mean()
        assert mean["mom_12_1"] > 3 and abs(mean["b"]) < 0.5 and abs(mean["c"]) < 0.5


def test_smaller_sides_and_packed_sums_give_the_trees_of_plain_sums():
    """Against level_sums, which adds up every node's rows anew; only the smaller side's rows are summed where all features are open."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 40, (3000, 6)).astype(np.uint8)
    y = (x[:, 0] > 20) * 1.0 + (x[:, 1] / 40) * (x[:, 2] > 5) + 0.1 * rng.normal(size=3000)
    w = trees.drawn(np.arange(3000), 1, 2)
    summed = []
    real = trees._node_sums
    for spec, weights in ((trees.TreeSpec(True, None, 1, 20, 0.1, 1.0, 31), None), (trees.TreeSpec(False, 6, 1, 20), w), (trees.TreeSpec(False, 6, 1, 20, columns=0.5), w)):
        growth, node = trees.Growth(spec, 0, 6), np.zeros(3000, np.int32)
        g = trees._exact(y - y.mean())
        while growth.open:
            columns = growth.columns()
            growth.split(trees.best_splits(trees.level_sums(x, node, growth.open, columns, g, weights, 40), spec, columns))
            t = growth.tree()
            node = t.walk(x)
        want = growth.tree()
        summed.clear()
        trees._node_sums = lambda x, rows, *more: summed.append(x.shape[1] if rows is None else len(rows)) or real(x, rows, *more)  # noqa: B023
        try:
            got, rows_of = trees.grown(np.ascontiguousarray(x.T), g, weights, spec, 0, 40)
        finally:
            trees._node_sums = real
        assert (got.feature == want.feature).all() and (got.cut == want.cut).all() and np.allclose(got.value, want.value, atol=1e-9) and len(want.feature) > 20
        for leaf, rows in rows_of.items():
            assert (want.walk(x)[rows] == leaf).all()
        if spec.columns is None:
            assert max(summed[1:]) <= summed[0] / 2
    step = trees._exact(y)
    assert np.abs(step - y).max() < 1e-11 and step.sum() == step[::-1].sum() == step[np.argsort(y)].sum()


def test_only_trees_that_split_by_a_feature_are_walked_again(spark, monkeypatch):
    df, x, _ = table(spark)
    boosted, forest = trees.fit_trees(df, NAMES, "t", [trees.TreeSpec(True, 2, 6, 10, 0.3, 1.0, 31), trees.TreeSpec(False, 2, 9, 5, columns="sqrt")], ["PERMNO"])
    other, walks, real = x[::-1].copy(), [], trees.Tree.walk
    monkeypatch.setattr(trees.Tree, "walk", lambda self, *more: walks.append(1) or real(self, *more))
    for model in (boosted, forest):
        walks.clear()
        got = list(model.moved(x, other))
        assert len(walks) == len(model.trees) + sum(len(set(t.feature) - {-1}) for t in model.trees) < 4 * len(model.trees)
        for j, p in enumerate(got):
            moved = x.copy()
            moved[:, j] = other[:, j]
            assert np.allclose(p, model.predict(moved), atol=1e-12)


def _same(a, b):
    return len(a) == len(b) and all(np.array_equal(getattr(s, c), getattr(t, c)) for s, t in zip(a, b, strict=True) for c in ("feature", "cut", "left", "right", "value"))


def test_candidates_of_a_grid_share_nodes_and_trees(monkeypatch):
    rng = np.random.default_rng(5)
    x, ids = rng.integers(0, 40, (4000, 12)).astype(np.uint8), rng.integers(0, 2**62, 4000)
    y = rng.normal(size=4000) * 0.1 + (x[:, 0] > 20) * (x[:, 1] < 9)
    summed, real = [], trees._node_sums
    monkeypatch.setattr(trees, "_node_sums", lambda *a: summed.append(1) or real(*a))
    forests = [trees.TreeSpec(False, 6, 4, least, columns=0.5) for least in (20, 50, 200)]
    assert trees._together(forests) == [[0, 1, 2]]
    apart = [trees.fit_local(x, y, ids, [s], y.mean(), range(4))[0] for s in forests]
    alone, summed[:] = len(summed), []
    together = trees.fit_local(x, y, ids, forests, y.mean(), range(4))
    assert all(map(_same, apart, together)) and not _same(together[0], together[2])
    assert len(summed) < 0.75 * alone
    boosted = [trees.TreeSpec(True, d, 12, 200, 0.3, 0.0, leaves=8) for d in (2, 3, None)]
    assert trees._together(boosted) == [[0], [1, 2]]
    apart = [trees.fit_local(x, y, ids, [s], y.mean(), range(12))[0] for s in boosted]
    together = trees.fit_local(x, y, ids, boosted, y.mean(), range(12))  # they part where a tree is deeper than allowed
    assert all(map(_same, apart, together)) and together[1][0] is together[2][0] and not _same(apart[1], apart[2])


def test_models_that_share_trees_are_walked_once(spark, monkeypatch):
    df, x, _ = table(spark)
    specs = [trees.TreeSpec(False, d, 4, 5) for d in (2, 4, 8)] + [trees.TreeSpec(True, d, 4, 5, 0.3, leaves=4) for d in (2, None)]
    found = trees.fit_trees(df, NAMES, "t", specs, ["PERMNO"])
    one = [m.predict(x) for m in found]
    walked, real = [], trees.Tree.walks
    monkeypatch.setattr(trees.Tree, "walks", lambda self, *a: walked.append(1) or real(self, *a))
    assert all((a == b).all() for a, b in zip(one, trees.predictions(found, x), strict=True))
    assert len(walked) == len({id(t) for m in found for t in m.trees}) < sum(len(m.trees) for m in found)
    assert not (one[0] == one[2]).all()


def test_both_kinds_of_trees_read_one_training_set(spark, monkeypatch):
    df, _, _ = table(spark)
    made, real = [], models.training_set
    monkeypatch.setattr(models, "training_set", lambda *a: made.append(1) or real(*a))
    fold = targets.Fold(0, *[dt.date(2000, 1, 31)] * 7)
    training = models.Training(df.selectExpr("*", "date '2000-01-31' as MthCalDt"), NAMES, "t", [fold])
    forest = training.fitted(models.RANDOM_FOREST, [{"max_depth": 3, "min_samples_leaf": 20, "max_features": 0.5, "trees": 3}], fold, "train")
    boosted = training.fitted(models.GRADIENT_BOOSTING, [{"max_depth": 3, "learning_rate": 0.1, "rounds": 3}], fold, "train")
    assert len(made) == 1 and forest[0].edges is boosted[0].edges


@pytest.mark.parametrize("features", [5, 8, 11])
def test_a_round_of_boosting_sums_no_row_of_the_root(monkeypatch, features):
    """The root's sums follow from the leaves of the tree before; trees are those of residuals that are summed anew. Odd numbers of features, many rows (in pairs of bins) and few."""
    rng = np.random.default_rng(6)
    x, ids = rng.integers(0, 60, (5000, features)).astype(np.uint8), np.arange(5000)
    y = (x[:, 0] > 20) * 1.0 + (x[:, 1] / 40) * (x[:, 2] > 5) + 0.1 * rng.normal(size=5000)
    specs = [trees.TreeSpec(True, d, 12, 20, 0.3, 1.0, leaves=8) for d in (3, None)]
    want, left = [], y - y.mean()
    for k in range(12):
        tree, rows_of = trees.grown(np.ascontiguousarray(x.T), trees._exact(left), None, specs[1], k, 60)
        want.append(tree)
        for node, rows in rows_of.items():
            left[rows] -= 0.3 * tree.value[node]
    summed, real = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda cells, *more, **named: summed.append(len(cells)) or real(cells, *more, **named))
    for paired in (1, 1 << 30):
        monkeypatch.setattr(trees, "PAIRED_ROWS", paired, raising=False)
        summed.clear()
        got = trees.fit_local(x, y, ids, specs, y.mean(), range(12))
        assert sum(summed) < 2 * 12 * 5000 * features  # the root alone took 12 * 5000 * features, and as many again its smaller sides, for each depth
        for a, b in zip(got[1], want, strict=True):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-9)
        assert all(t.levels() <= 3 for t in got[0])
    steps = trees._Residuals(x, y - y.mean(), 60)
    for k in range(3):
        tree, place, places, counts = steps.grown(specs[1], k)
        assert (np.array(places)[place] == tree.walk(x)).all()
        steps.less(0.3 * tree.value[places], place, counts)
        assert (steps.sums == steps._sums(None, [steps.left])[0]).all()  # exact, so nothing adds up over rounds


def test_edges_are_exact_quantiles_however_rows_lie(spark):
    df, x, _ = table(spark, 3000)
    assert all((a == b).all() for a, b in zip(trees._edges(df, NAMES, 3000), trees._edges(df, NAMES, trees.LOCAL_BYTES), strict=True))  # the latter by Spark's own, exact for so few rows
    rng = np.random.default_rng(9)
    many = spark.createDataFrame(pd.DataFrame(rng.normal(size=(60_000, 2)), columns=["a", "b"]).assign(t=1.0, k=range(60_000)))
    want = [np.unique(np.quantile(c, np.arange(1, 255) / 255, method="inverted_cdf")) for c in many.select("a", "b").toPandas().to_numpy().T]
    for rows in (many.repartition(7), many.coalesce(1).orderBy("a")):
        got = trees.training_set(rows, ["a", "b"], "t", ["k"])
        assert all((a == b).all() for a, b in zip(got.edges, want, strict=True))


def test_windows_read_the_complete_rows_that_were_written_once(spark):
    df, _, _ = table(spark)
    panel = df.selectExpr("*", "date '2000-01-31' as MthCalDt").selectExpr("PERMNO", "MthCalDt", "if(PERMNO % 4 = 0, null, a) as a", "b", "c", "if(PERMNO % 5 = 0, null, t) as t")
    training = models.Training(panel, NAMES, "t", [targets.Fold(0, *[dt.date(2000, 1, 31)] * 7)])
    files = {f for d in (training.window(training.folds[0], "train"), training.complete_rows("test")) for f in d.inputFiles()}
    assert files and all("/complete-rows-" in f for f in files) and training.window(training.folds[0], "inner_train").inputFiles()[0] in files
    assert training.complete_rows("test").count() == 300 and training.complete_rows("test").where("t is null").count() == 60
    assert training.window(training.folds[0], "train").count() == 240 == panel.na.drop().count()
