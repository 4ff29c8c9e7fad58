"""The registered model queries take every fold, all model features and all estimators, over model-ready features."""

from __future__ import annotations

import os

import pytest

from panelforge.operators import features, models
from panelforge.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not there")
NAMES = list(features.MODEL_NAMES)


@pytest.fixture(scope="module")
def training(spark):
    table, folds = Q._model_table(spark, SF)
    return table.cache(), folds


@pytest.fixture
def kept(monkeypatch, training):
    monkeypatch.setattr(Q, "_model_table", lambda spark, sf_dir: training)
    return training


def test_tuning_covers_all_folds_and_candidates(spark, kept):
    table, folds = kept
    got = Q.QUERIES["m10_m16_tune_ridge"](spark, SF).collect()
    assert sorted((r.fold_id, r.alpha) for r in got) == [(f.fold_id, a) for f in folds for a in models.RIDGE.grid["alpha"]]
    assert len(NAMES) == 50 and set(NAMES) <= set(table.columns)
    low, high = table.selectExpr("min(mom_12_1)", "max(mom_12_1)").first()
    assert -1 < low < 0 < high <= 1  # rank-scaled


def test_the_whole_run_ends(spark, kept):
    _, folds = kept
    got = Q.QUERIES["m18_walk_forward"](spark, SF).toPandas()
    assert set(got.model) == set(models.runners()) == {"equal_weight", "momentum_sort", "fama_macbeth"} | {e.name for e in models.ESTIMATORS}
    assert got[got.model == "equal_weight"].fold_id.nunique() == len(folds) == 4
    for name in ("m13_walk_forward_forest", "m14_walk_forward_boosting"):
        alone = Q.QUERIES[name](spark, SF).toPandas().sort_values(["fold_id", "MthCalDt", "PERMNO"])
        same = got[got.model == alone.model.iloc[0]].sort_values(["fold_id", "MthCalDt", "PERMNO"])
        assert len(same) and (alone.y_pred.round(9).fillna(0).to_numpy() == same.y_pred.round(9).fillna(0).to_numpy()).all()


@pytest.mark.parametrize("name", ["m21_m22_permutation_importance", "m21_m22_permutation_importance_boosting"])
def test_importance_by_category(spark, kept, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    kinds = {f.category for f in features.REGISTRY if f.name in NAMES}
    assert set(got.category) == kinds
