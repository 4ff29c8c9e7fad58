"""Baselines, penalized linear models, histogram trees, tuning, walk-forward runs and permutation importance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import product
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.permute import numbered, shuffled
from panelforge.operators.features import REGISTRY
from panelforge.operators.ic import pooled_ics_by
from panelforge.operators.linear import LinearModel, Moments, MonthlyMoments, elastic_net, least_squares, moments, monthly_moments, ridge
from panelforge.operators.targets import Fold, ModelConfig, between, complete_cases, fold_rows, folds_table
from panelforge.operators.trees import TrainingSet, TreeModel, TreeSpec, fit_binned, predictions, training_set
from panelforge.sources.shared import materialize

KEYS = ("PERMNO", "MthCalDt")
FOLDS_SIDE_BY_SIDE = 4
#: Models of a walk-forward run at a time: the last fits of one leave cores to the next.
MODELS_SIDE_BY_SIDE = 2
#: Two candidates with one order of the rows have ICs that differ by the order of summation alone.
SAME_IC = 1e-12
Model = LinearModel | TreeModel


@dataclass(frozen=True)
class Estimator:
    """name; grid: parameter -> values; and one of: build(parameters, seed) -> trees; solve(moments, parameters) -> a linear model."""

    name: str
    grid: dict[str, tuple]
    build: Callable[[dict, int], TreeSpec] | None = None
    solve: Callable[[Moments, dict], LinearModel] | None = None

    def candidates(self) -> list[dict]:
        return [dict(zip(self.grid, values, strict=True)) for values in product(*self.grid.values())]


def _forest(p: dict, seed: int) -> TreeSpec:
    return TreeSpec(False, p["max_depth"], p.get("trees", 300), p["min_samples_leaf"], columns=p["max_features"], seed=seed)


def _boosting(p: dict, seed: int) -> TreeSpec:
    """100 rounds, 31 leaves, 20 rows in a leaf."""
    return TreeSpec(True, p["max_depth"], p.get("rounds", 100), p.get("min_samples_leaf", 20), p["learning_rate"], p.get("l2_regularization", 0.0), leaves=31, seed=seed)


#: The parameter grids.
RIDGE = Estimator("ridge", {"alpha": (0.1, 1.0, 10.0, 100.0)}, solve=lambda m, p: ridge(m, p["alpha"]))
LASSO = Estimator("lasso", {"alpha": (0.0001, 0.001, 0.01, 0.1)}, solve=lambda m, p: elastic_net(m, p["alpha"], 1.0))
ELASTIC_NET = Estimator("elastic_net", {"alpha": (0.001, 0.01, 0.1), "l1_ratio": (0.1, 0.5, 0.9)}, solve=lambda m, p: elastic_net(m, p["alpha"], p["l1_ratio"]))
RANDOM_FOREST = Estimator("random_forest", {"max_depth": (3, 5, 8), "min_samples_leaf": (50, 200, 1000), "max_features": ("sqrt", 0.5)}, _forest)
GRADIENT_BOOSTING = Estimator("hist_gradient_boosting", {"max_depth": (3, 5, None), "learning_rate": (0.01, 0.05, 0.1), "l2_regularization": (0.0, 1.0)}, _boosting)
ESTIMATORS = (RIDGE, LASSO, ELASTIC_NET, RANDOM_FOREST, GRADIENT_BOOSTING)


class Training:
    """A panel's features, target and folds, with what all folds share."""

    def __init__(self, panel: DataFrame, features: list[str], target: str, folds: list[Fold], config: ModelConfig | None = None):
        self.panel, self.features, self.target, self.folds, self.config = panel, features, target, folds, config or ModelConfig()
        self.table = folds_table(panel.sparkSession, folds) if folds else None
        self._lock, self._locks, self._made = Lock(), {}, {}

    @property
    def needed(self) -> list[str]:
        return [*self.features, self.target]

    def rows(self, part: str) -> DataFrame:
        """The rows of a part (train, inner_train, inner_val, test) of all folds, with fold_id."""
        return fold_rows(self.panel, self.table, part)

    @property
    def complete(self) -> DataFrame:
        """The panel's rows with all features, written once: they are few, and all windows of all folds and models read only them."""
        columns = [c for c in dict.fromkeys((*KEYS, *self.needed)) if c in self.panel.columns]
        return self._one("complete", lambda: materialize(complete_cases(self.panel.select(*columns), self.features), "complete-rows"))

    def complete_rows(self, part: str) -> DataFrame:
        """As of rows, those with all features."""
        return fold_rows(self.complete, self.table, part)

    def window(self, fold: Fold, part: str) -> DataFrame:
        """The complete rows of a training window of one fold: train or inner_train."""
        return between(self.complete, fold.train_start, fold.train_end if part == "train" else fold.inner_train_end).na.drop(subset=[self.target])

    def _one(self, key: object, make: Callable[[], object]) -> object:
        """What make gives, made once however many folds and models ask for it side by side."""
        with self._lock:
            mine = self._locks.setdefault(key, Lock())
        with mine:
            if key not in self._made:
                self._made[key] = make()
            return self._made[key]

    @property
    def monthly(self) -> MonthlyMoments | None:
        """Cross products by month, one pass over the complete rows for all windows of all folds."""
        return self._one("monthly", lambda: monthly_moments(self.complete.na.drop(subset=[self.target]), self.needed))

    def moments(self, fold: Fold, part: str) -> Moments | None:
        return self.monthly and self.monthly.between(fold.train_start, fold.train_end if part == "train" else fold.inner_train_end)

    def binned(self, fold: Fold, part: str) -> TrainingSet | None:
        """A training window in bins, for all kinds of trees."""
        return self._one((fold.fold_id, part), lambda: _binned(self.window(fold, part), self.features, self.target))

    def fitted(self, estimator: Estimator, candidates: list[dict], fold: Fold, part: str) -> list[Model | None]:
        """A model for each candidate, of a training window."""
        return _fitted(estimator, candidates, lambda: self.moments(fold, part), lambda: self.binned(fold, part), self.config.seed)


#: A runner scores the test rows of all folds: training -> rows with fold_id and y_pred.
Runner = Callable[[Training], DataFrame]


def _binned(rows: DataFrame, features: list[str], target: str) -> TrainingSet | None:
    return training_set(rows, features, target, [k for k in KEYS if k in rows.columns] or features)


def _fitted(estimator: Estimator, candidates: list[dict], m: Callable[[], Moments | None], binned: Callable[[], TrainingSet | None], seed: int) -> list[Model | None]:
    """A model for each candidate: linear ones from moments, trees from bins."""
    data = m() if estimator.solve else binned()
    if data is None:
        return [None] * len(candidates)
    return [estimator.solve(data, p) for p in candidates] if estimator.solve else fit_binned(data, [estimator.build(p, seed) for p in candidates])


def fit(estimator: Estimator, params: dict, train: DataFrame, features: list[str], target: str, seed: int = 42) -> Model | None:
    """Fits on the complete cases; None without any."""
    rows = complete_cases(train, [*features, target])
    return _fitted(estimator, [params], lambda: moments(rows, [*features, target]), lambda: _binned(rows, features, target), seed)[0]


def predicted(models: dict[int, Model | None], features: list[str], fold: Column | None = None) -> Column:
    """The score by the model of the row's fold (default: 0), null where there is none."""

    @F.arrow_udf("double")
    def run(folds: pa.Array, *columns: pa.Array) -> pa.Array:
        x, at = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]), folds.to_numpy(zero_copy_only=False)
        out = np.full(len(x), np.nan)
        for f in np.unique(at):
            if models.get(int(f)) is not None:
                out[at == f] = models[int(f)].predict(x[at == f])
        return pa.array(out, from_pandas=True)

    return run(F.lit(0) if fold is None else fold, *(F.col(f).cast("double") for f in features))


def score(model: Model, df: DataFrame, features: list[str]) -> DataFrame:
    """df's rows with all features, with y_pred."""
    return complete_cases(df, features).withColumn("y_pred", predicted({0: model}, features))


def _scores(models: Sequence[Model | None], x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position, scores) of each model that is there; trees that models share are walked once."""
    linear = [(i, m.predict(x)) for i, m in enumerate(models) if isinstance(m, LinearModel)]
    trees = [i for i, m in enumerate(models) if isinstance(m, TreeModel)]
    yield from linear
    yield from zip(trees, predictions([models[i] for i in trees], x), strict=True)


def candidate_ics(rows: DataFrame, features: list[str], target: str, models: dict[int, list[Model | None]]) -> dict[int, list[float | None]]:
    """For each fold's candidates the IC pooled over the fold's complete rows (with fold_id), all in one plan."""
    width = max(map(len, models.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, t, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            x = np.column_stack(columns)
            for f in np.unique(at):
                mine = at == f
                for i, p in _scores(models.get(int(f), ()), x[mine]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), int(f) * width + i)), pa.array(t[mine]), pa.array(p)], names=["k", "t", "p"])

    wide = rows.select("fold_id", F.col(target).cast("double"), *(F.col(f).cast("double") for f in features))
    got = pooled_ics_by(wide.mapInArrow(run, "k long, t double, p double"), "t", "p", "k")
    return {f: [got.get(f * width + i) for i in range(len(m))] for f, m in models.items()}


def _best(ics: list[float | None]) -> int:
    """The first maximum, where what differs by rounding alone is equal; the first candidate without any IC."""
    best, at = None, 0
    for i, ic in enumerate(ics):
        if ic is not None and not math.isnan(ic) and (best is None or ic > best + SAME_IC):
            best, at = ic, i
    return at


def tune(estimator: Estimator, train: DataFrame, validation: DataFrame, features: list[str], target: str, seed: int = 42) -> tuple[dict, float | None, list[tuple[dict, float | None]]]:
    """Best parameters by the IC pooled over the validation rows, the first strict maximum; without any IC the first candidate."""
    candidates, needed = estimator.candidates(), [*features, target]
    rows = complete_cases(train, needed)
    models = _fitted(estimator, candidates, lambda: moments(rows, needed), lambda: _binned(rows, features, target), seed)
    ics = candidate_ics(complete_cases(validation, needed).withColumn("fold_id", F.lit(0)), features, target, {0: models})[0]
    at = _best(ics)
    return candidates[at], ics[at], list(zip(candidates, ics, strict=True))


def _each(folds: list[Fold], do: Callable[[Fold], object]) -> dict[int, object]:
    """do(fold) by fold, a few folds side by side: a fold's last fit alone would leave most of a cluster idle."""
    with ThreadPoolExecutor(FOLDS_SIDE_BY_SIDE) as pool:
        return dict(zip([f.fold_id for f in folds], pool.map(do, folds), strict=True))


def tuned(estimator: Estimator, training: Training) -> dict[int, list[tuple[dict, float | None]]]:
    """The trials of all candidates on every fold's inner split. Linear models of all folds come from one pass by months; the ICs are one plan."""
    candidates = estimator.candidates()
    models = _each(training.folds, lambda f: training.fitted(estimator, candidates, f, "inner_train"))
    ics = candidate_ics(training.complete_rows("inner_val").na.drop(subset=[training.target]), training.features, training.target, models)
    return {f: list(zip(candidates, ics[f], strict=True)) for f in models}


def refitted(estimator: Estimator, training: Training) -> dict[int, Model | None]:
    """Each fold's model: tuned on the inner split, fitted on the whole training window."""
    trials = tuned(estimator, training)

    def one(f: Fold) -> Model | None:
        params = trials[f.fold_id][_best([ic for _, ic in trials[f.fold_id]])][0]
        return training.fitted(estimator, [params], f, "train")[0]

    return _each(training.folds, one)


def equal_scores(rows: DataFrame) -> DataFrame:
    """A score of 0 for every row."""
    return rows.withColumn("y_pred", F.lit(0.0))


def momentum_scores(rows: DataFrame, feature: str) -> DataFrame:
    """The momentum feature itself, where it is there."""
    return rows.where(F.col(feature).isNotNull()).withColumn("y_pred", F.col(feature).cast("double"))


def equal_weight(training: Training) -> DataFrame:
    return equal_scores(training.rows("test"))


def momentum_sort(training: Training) -> DataFrame:
    return momentum_scores(training.rows("test"), training.config.momentum)


def regressions(monthly: MonthlyMoments | None, n_features: int) -> list[tuple[object, np.ndarray]]:
    """(month, constant and coefficients) of each month with features + 5 rows or more, from its own cross products."""
    found = [] if monthly is None else [(m, monthly.of([i])) for i, m in enumerate(monthly.months)]
    return [(m, least_squares(x)) for m, x in found if x and x.n >= n_features + 5]


def monthly_regressions(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(MthCalDt, coefficients): least squares of each month with features + 5 complete rows or more, the constant first. One pass keeps cross products by month."""
    needed = [*features, target]
    rows = regressions(monthly_moments(complete_cases(df, needed), needed), len(features))
    return df.sparkSession.createDataFrame([(m, [float(x) for x in b]) for m, b in rows], "MthCalDt date, coefficients array<double>")  # a row per month


def fama_macbeth(training: Training) -> DataFrame:
    """The mean of the training months' regressions scores a fold's test rows; null if no month could be fitted."""
    found, models = regressions(training.monthly, len(training.features)), {}
    for f in training.folds:
        mine = [b for m, b in found if f.train_start <= m <= f.train_end]
        mean = np.mean(mine, axis=0) if mine else None
        models[f.fold_id] = None if mean is None else LinearModel(mean[1:], float(mean[0]))
    return training.complete_rows("test").withColumn("y_pred", predicted(models, training.features, F.col("fold_id")))


def estimator_runner(estimator: Estimator) -> Runner:
    """Tunes on the inner splits, refits on the whole training windows."""

    def run(training: Training) -> DataFrame:
        models = refitted(estimator, training)
        return training.complete_rows("test").withColumn("y_pred", predicted(models, training.features, F.col("fold_id")))

    return run


def runners(estimators: tuple[Estimator, ...] = ESTIMATORS) -> dict[str, Runner]:
    return {"equal_weight": equal_weight, "momentum_sort": momentum_sort, "fama_macbeth": fama_macbeth} | {e.name: estimator_runner(e) for e in estimators}


def walk_forward(panel: DataFrame, features: list[str], target: str, folds: list[Fold], models: dict[str, Runner], config: ModelConfig | None = None) -> DataFrame:
    """(PERMNO, MthCalDt, model, fold_id, y_true, y_pred) of every fold and model. Each model's predictions are written when its folds are fitted."""
    if not folds:
        raise ValueError("there are no folds")
    training = Training(panel, features, target, folds, config)

    def written(name: str) -> DataFrame:
        got = models[name](training).select("PERMNO", "MthCalDt", F.lit(name).alias("model"), "fold_id", F.col(target).alias("y_true"), "y_pred")
        return materialize(got, f"predictions-{name}")

    with ThreadPoolExecutor(MODELS_SIDE_BY_SIDE) as pool:
        return reduce(DataFrame.unionByName, pool.map(written, models))


def _moved(model: Model, x: np.ndarray, other: np.ndarray) -> Iterator[np.ndarray]:
    """For each feature the predictions with its values taken from other."""
    if isinstance(model, TreeModel):
        yield from model.moved(x, other)
        return
    for j in range(x.shape[1]):
        moved = x.copy()
        moved[:, j] = other[:, j]
        yield model.predict(moved)


def permutation_importance(estimator: Estimator, panel: DataFrame, features: list[str], target: str, folds: list[Fold], config: ModelConfig | None = None, repeats: int = 5) -> DataFrame:
    """(fold_id, feature, importance_mean, importance_std): how much the squared error on a fold's inner validation rows grows when a feature is shuffled.

    Rows are numbered within their fold, and a keyed bijection of the numbers names each row's partner in each repeat: all features and
    repeats of all folds are one join. Squared errors are summed where the rows meet, (features + 1) numbers for each fold and repeat.
    """
    training = Training(panel, features, target, folds, config)
    models = {f: m for f, m in refitted(estimator, training).items() if m is not None}
    rows = training.complete_rows("inner_val").na.drop(subset=[training.target]).where(F.col("fold_id").isin(list(models)))
    rows = rows.select("fold_id", F.col(target).cast("double").alias("y"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
    rows, counts = numbered(rows, "fold_id")
    mixed = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("partner", shuffled(F.col("fold_id"), F.col("number"), F.col("k"), counts, training.config.seed))
    pairs = mixed.join(rows.select("fold_id", F.col("number").alias("partner"), F.col("x").alias("other")), ["fold_id", "partner"])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            fold, k, y = (c.to_numpy() for c in b.columns[:3])
            x, other = (np.asarray(c.flatten()).reshape(len(y), -1) for c in b.columns[3:])
            for f in np.unique(fold):
                model, at = models[int(f)], fold == f
                base = model.predict(x[at])
                out = np.ones((int(at.sum()), len(features) + 2))  # the last column counts
                out[:, 0] = (base - y[at]) ** 2
                for j, p in enumerate(_moved(model, x[at], other[at])):
                    out[:, j + 1] = (p - y[at]) ** 2
                for r in np.unique(k[at]):
                    mine = out[k[at] == r].sum(axis=0)
                    total[int(f), int(r)] = total[int(f), int(r)] + mine if (int(f), int(r)) in total else mine
        for (f, r), sums in total.items():
            n = len(features)
            cols = [pa.array(np.full(n, f, np.int32)), pa.array(np.full(n, r, np.int32)), pa.array(features), pa.array(sums[1:-1] - sums[0]), pa.array(np.full(n, int(sums[-1])))]
            yield pa.RecordBatch.from_arrays(cols, names=["fold_id", "k", "feature", "gain", "n"])

    sums = pairs.select("fold_id", "k", "y", "x", "other").mapInArrow(errors, "fold_id int, k int, feature string, gain double, n long")
    gains = sums.groupBy("fold_id", "k", "feature").agg((F.sum("gain") / F.sum("n")).alias("gain"))
    return gains.groupBy("fold_id", "feature").agg(F.avg("gain").alias("importance_mean"), F.stddev_pop("gain").alias("importance_std"))


def category_importance(importances: DataFrame) -> DataFrame:
    """(category, importance): mean over a category's features and folds, largest first."""
    kinds = importances.sparkSession.createDataFrame([(f.name, f.category) for f in REGISTRY], "feature string, category string")
    return importances.join(F.broadcast(kinds), "feature").groupBy("category").agg(F.avg("importance_mean").alias("importance")).orderBy(F.desc("importance"), "category")
