"""Boosted trees over flow features, hold-out evaluation and ablations.

Training follows the rule of Spark's own gradient-boosted trees: trees of bounded depth over binned features, whose splits
lessen the variance of the logistic loss's gradient. That rule differs from leaf-wise libraries, so figures match in kind and not in digits.

With up to ``CELL_FEATURES`` features all rows of one binned vector and label go the same way through every tree, so trees are grown
over counts of such cells: an aggregate of every row, bounded by bins and not by rows, which one task goes through for each fit. Wider sets have no such bound and
are trained by Spark, which sums histograms over all rows for each tree level; there rows stay where they are.
"""

from __future__ import annotations

import pickle
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators import metrics
from weir.operators.shaping import decide, numeric
from weir.operators.splits import stratified_split

#: Trees, learning rate, depth and least rows in a leaf.
SETTINGS = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "minInstancesPerNode": 50, "maxBins": 64, "seed": 42}
#: Features of a set whose cells (binned vectors) are counted; there are at most ``maxBins`` to that power.
CELL_FEATURES = 4


def fit(df: DataFrame, features: list[str], label: str, **settings):
    """A model with balanced class weights."""
    if len(features) <= CELL_FEATURES:
        return _cell_fits(df, features, label, [F.lit(True)], [(0, features)], SETTINGS | settings)[0]
    weights = metrics.class_weights(df, label).select(label, "weight")
    rows = _assembled(df.join(F.broadcast(weights), label), features)  # a row per class
    return GBTClassifier(labelCol=label, featuresCol="_x", weightCol="weight", **(SETTINGS | settings)).fit(rows)


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    clean = df.withColumns({f"_f_{c}": numeric(F.col(c)).cast("double") for c in features})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_x").transform(clean)


class Cells:
    """Trees in heap order over binned features: the feature (-1 in a leaf), the last bin that goes left, and the value of each node; ``rates`` weigh the trees, ``edges`` part a feature's bins."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, value: np.ndarray, rates: np.ndarray):
        self.edges, self.feature, self.cut, self.value, self.rates = edges, feature, cut, value, rates


def _probability(models: list[Cells], which: Column, columns: list[Column]) -> Column:
    """The probability of label 1 under the model of number ``which``."""
    parts = [(m.edges, m.feature, m.cut, m.value, m.rates) for m in models]

    def run(which: pa.Array, *values: pa.Array) -> pa.Array:
        which, values = np.asarray(which), [np.asarray(v) for v in values]
        out = np.zeros(len(which))
        for k in np.unique(which).tolist():
            edges, feature, cut, value, rates = parts[k]
            own = np.flatnonzero(which == k)
            bins = np.stack([np.searchsorted(e, v[own]) for e, v in zip(edges, values)], axis=1)
            bins, at = np.unique(bins, axis=0, return_inverse=True)
            margin, rows = np.zeros(len(bins)), np.arange(len(bins))
            for f, c, v, rate in zip(feature, cut, value, rates):
                node = np.zeros(len(bins), np.int64)
                for _ in range(len(f).bit_length() - 1):
                    by = f[node]
                    node = np.where(by < 0, node, 2 * node + 1 + (bins[rows, by] > c[node]))
                margin += rate * v[node]
            out[own] = (1 / (1 + np.exp(-2 * margin)))[at.ravel()]
        return pa.array(out)

    return F.arrow_udf(run, "double")(which, *columns)


def _features(features: list[str]) -> list[Column]:
    return [numeric(F.col(c)).cast("double").alias(f"f{k}") for k, c in enumerate(features)]


def _cell_fits(df: DataFrame, features: list[str], label: str, folds: list[Column], runs: list[tuple[int, list[str]]], settings: dict) -> list[Cells]:
    """A model for each of ``runs`` (a fold's number and some of ``features``), learned from the rows where the fold's condition holds; all go through the same few jobs."""
    names = [f"f{k}" for k in range(len(features))]
    rows = df.filter(F.col(label).isNotNull()).select(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(folds)])).alias("folds"), F.col(label).cast("int").alias("y"), *_features(features))
    counts = rows.groupBy("folds", "y", *names).agg(F.count("*").alias("n")).persist()
    try:
        trained = counts.select(F.explode("folds").alias("fold"), "y", *names, "n")
        edges = _edges(trained, names, len(folds), settings["maxBins"])
        of_fold = lambda k: reduce(lambda c, i: c.when(F.col("fold") == i, F.lit(edges[i][k].tolist()).cast("array<double>")), range(1, len(folds)), F.when(F.col("fold") == 0, F.lit(edges[0][k].tolist()).cast("array<double>")))
        binned = trained.select("fold", *[F.size(F.filter(of_fold(k), lambda x: x < F.col(c))).alias(c) for k, c in enumerate(names)], *[F.when(F.col("y") == y, F.col("n")).otherwise(0).alias(f"n{y}") for y in (0, 1)])
        sums = [F.sum(f"n{y}").alias(f"n{y}") for y in (0, 1)]
        binned = binned.groupBy("fold", *names).agg(*sums)
        # a run's features, and 0 for all others
        which = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(i).alias("i"), *[F.lit(int(c in own)).alias(k) for k, c in zip(names, features)]) for r, (i, own) in enumerate(runs)]))
        cells = binned.withColumn("_run", which).filter("_run.i = fold").select(F.col("_run.r").alias("run"), *[(F.col(k) * F.col(f"_run.{k}")).alias(k) for k in names], "n0", "n1")
        cells = cells.groupBy("run", *names).agg(*sums).repartition(len(runs), "run")
        grown = {r["run"]: pickle.loads(r["trees"]) for r in cells.mapInArrow(_grower(settings), "run int, trees binary").collect()}
    finally:
        counts.unpersist()
    if len(grown) < len(runs):
        raise ValueError("no rows to train on")
    return [Cells([edges[i][k] if c in own else np.zeros(0) for k, c in enumerate(features)], *grown[r]) for r, (i, own) in enumerate(runs)]


def _edges(trained: DataFrame, names: list[str], folds: int, bins: int) -> list[list[np.ndarray]]:
    """By fold and feature the last values of all bins but the highest: each value where there are few, else the exact quantiles."""
    m = len(names)
    values = trained.select("fold", "n", F.posexplode(F.array(*names)).alias("f", "value")).groupBy((F.col("fold") * m + F.col("f")).alias("g"), "value").agg(F.sum("n").alias("n")).persist()
    try:
        distinct = {r["g"]: r["m"] for r in values.groupBy("g").agg(F.count("*").alias("m")).collect()}
        few = [g for g, k in distinct.items() if k <= bins]
        found = values.filter(F.col("g").isin(few)).select("g", "value").collect()
        edges = {g: np.sort([r["value"] for r in found if r["g"] == g])[:-1] for g in few}
        many = values.filter(~F.col("g").isin(few))
        if len(few) < len(distinct):
            at = metrics.spread(trained, names)
            part = reduce(lambda c, k: c.when(F.col("g") % m == k, metrics.range_of(F.col("value"), at[names[k]])), range(1, m), F.when(F.col("g") % m == 0, metrics.range_of(F.col("value"), at[names[0]])))
            found = metrics.exact_quantiles(many, ["g"], "value", "n", [k / bins for k in range(1, bins)], part, few=True).collect()
            edges |= {g: np.unique([r["quantile"] for r in found if r["g"] == g]) for g in set(distinct) - set(few)}
    finally:
        values.unpersist()
    return [[edges.get(i * m + k, np.zeros(0)) for k in range(m)] for i in range(folds)]


def _grower(settings: dict):
    """Cells (run, a bin for each feature, n0, n1), each run's in one task, to each run's parts of ``Cells``, as Spark grows its trees: the first on the labels -1 and 1, each other on the gradient's opposite.

    A split has the least weighted variance, of equals the first feature's first; both sides hold enough rows.
    """
    depth, least, width, count = (settings[k] for k in ("maxDepth", "minInstancesPerNode", "maxBins", "maxIter"))
    rates = np.full(count, float(settings["stepSize"]))
    rates[:1] = 1.0

    def grow(bins: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort(bins)  # one order, whatever the partitions were
        bins, n0, n1 = bins[:, order], n0[order].astype(float), n1[order].astype(float)
        n, classes = n0 + n1, int(n0.any()) + int(n1.any())
        w0, w1 = (x * (n.sum() / (classes * max(x.sum(), 1))) for x in (n0, n1))
        weight, size = w0 + w1, 2 ** (depth + 1) - 1
        feature, cut, value = np.full((count, size), -1, np.int8), np.zeros((count, size), np.int32), np.zeros((count, size))
        margin, each = np.zeros(len(n)), np.arange(len(bins))[:, None]
        for k in range(count):
            pull = w1 * 4 / (1 + np.exp(2 * margin)) - w0 * 4 / (1 + np.exp(-2 * margin)) if k else w1 - w0
            node, live = np.zeros(len(n), np.int64), np.arange(len(n))
            for level in range(depth + 1):
                first, m = 2**level - 1, 2**level
                local = node[live] - first
                own = [x[live] for x in (weight, pull, n)]
                w, s, c = (np.bincount(local, x, m) for x in own)
                at = slice(first, first + m)
                value[k, at] = s / np.where(w > 0, w, 1)
                if level == depth or not len(live):
                    break
                key = ((each * m + local) * width + bins[:, live]).ravel()
                lw, ls, lc = (np.bincount(key, np.tile(x, len(bins)), len(bins) * m * width).reshape(-1, m, width).cumsum(axis=2).transpose(1, 0, 2).reshape(m, -1) for x in own)
                w, s, c = w[:, None], s[:, None], c[:, None]
                ok = (lc >= max(least, 1)) & (c - lc >= max(least, 1))
                gain = np.full(ok.shape, -1.0)
                np.divide(ls * ls, lw, out=gain, where=ok)
                right = np.zeros(ok.shape)
                np.divide((s - ls) ** 2, w - lw, out=right, where=ok)
                gain = np.where(ok, gain + right - s * s / np.where(w > 0, w, 1), -1.0)
                best = gain.argmax(axis=1)
                split = gain[np.arange(m), best] > 1e-12 * w[:, 0]
                split &= ok.any(axis=1)
                feature[k, at], cut[k, at] = np.where(split, best // width, -1), best % width
                go = split[local]
                live, local = live[go], local[go]
                node[live] = 2 * node[live] + 1 + (bins[feature[k, at][local], live] > cut[k, at][local])
            margin += rates[k] * value[k, node]
        return feature, cut, value, rates

    def run(batches):
        held = [[np.asarray(c) for c in b.columns] for b in batches]
        if held:
            which, *bins, n0, n1 = (np.concatenate(c) for c in zip(*held))
            bins = np.stack(bins).astype(np.int64)
            for r in np.unique(which).tolist():
                at = which == r
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([pickle.dumps(grow(bins[:, at], n0[at], n1[at]))], pa.binary())], ["run", "trees"])

    return run


def scored(model, df: DataFrame, features: list[str]) -> DataFrame:
    if isinstance(model, Cells):
        out = df.withColumn("score", _probability([model], F.lit(0), _features(features)))
    else:
        out = model.transform(_assembled(df, features)).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("predicted", decide(F.col("score"))).select(*df.columns, "score", "predicted")


def holdout_scores(df: DataFrame, features: list[str], label: str, row: str) -> DataFrame:
    """Scores of a stratified fifth under a model of the rest."""
    split = stratified_split(df, row, label)
    model = fit(split.filter("split = 'train'"), features, label)
    return scored(model, split.filter("split = 'test'").drop("split"), features).select(row, label, F.round("score", 6).alias("score"), "predicted")


def evaluate(model, df: DataFrame, features: list[str], label: str) -> DataFrame:
    return _measured(scored(model, df, features).select(F.lit(0).alias("_run"), label, "score", "predicted"), label).drop("_run")


def _measured(rows: DataFrame, label: str) -> DataFrame:
    """Metrics of each ``_run``, worked out at once."""
    rows = rows.persist()  # each metric reads all scores
    try:
        out = metrics.confusion(rows, ["_run"], label, "predicted").join(metrics.ranking(rows, ["_run"], label, "score").select("_run", "roc_auc", "pr_auc"), "_run")
        return rows.sparkSession.createDataFrame(out.collect(), out.schema)
    finally:
        rows.unpersist()


def leave_one_out(df: DataFrame, source: str, features: dict[str, list[str]], label: str, **settings) -> DataFrame:
    """Metrics for each held-out source and named feature set; folds whose training rows lack a class, and empty sets, are left out."""
    found = df.select(source, label).distinct().filter(F.col(source).isNotNull()).collect()  # sources are few
    held = [s for s in sorted({r[0] for r in found}) if len({r[1] for r in found if r[0] != s and r[1] is not None}) > 1]
    runs = [({"heldout_source": s, "feature_group": name}, k, columns) for k, s in enumerate(held) for name, columns in features.items() if columns]
    if not runs:
        raise ValueError("no fold has both classes")
    return _fits(df, [(F.col(source) != s, F.col(source) == s) for s in held], runs, label, settings)


def ablation(df: DataFrame, train: Column, configurations: dict[str, list[str]], label: str, **settings) -> DataFrame:
    """Metrics on the other rows for each named feature list."""
    return _fits(df, [(train, ~train)], [({"configuration": name}, 0, columns) for name, columns in configurations.items()], label, settings)


def _fits(df: DataFrame, folds: list[tuple[Column, Column]], runs: list[tuple[dict, int, list[str]]], label: str, settings: dict) -> DataFrame:
    """Metrics of runs (names, a fold, features); a fold says which rows are for training and which for testing. Runs over cells share their jobs; wider ones are fitted some at a time, as a fit's many short jobs leave cores idle."""
    wide = [r for r in runs if len(r[2]) > CELL_FEATURES]
    runs = [r for r in runs if len(r[2]) <= CELL_FEATURES]

    def alone(names: dict, fold: int, columns: list[str]) -> DataFrame:
        train, test = (df.filter(c) for c in folds[fold])
        return _named(evaluate(fit(train, columns, label, **settings), test, columns, label).withColumn("_run", F.lit(0)), [names])

    with ThreadPoolExecutor(6) as pool:
        out = list(pool.map(lambda r: alone(*r), wide))
    if runs:
        features = list(dict.fromkeys(c for r in runs for c in r[2]))
        # conditions become numbers, and rows the few columns that every job reads
        numbers = lambda conditions: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(conditions)]))
        rows = df.select(numbers(c for c, _ in folds).alias("_train"), numbers(folds[k][1] for _, k, _ in runs).alias("_test"), *dict.fromkeys([label, *features])).persist()
        try:
            models = _cell_fits(rows, features, label, [F.array_contains("_train", k) for k in range(len(folds))], [(k, own) for _, k, own in runs], SETTINGS | settings)
            test = rows.select(F.explode("_test").alias("_run"), label, *_features(features))
            test = test.withColumn("score", _probability(models, F.col("_run"), [F.col(f"f{k}") for k in range(len(features))])).withColumn("predicted", decide(F.col("score")))
            out.append(_named(_measured(test.select("_run", label, "score", "predicted"), label), [r[0] for r in runs]))
        finally:
            rows.unpersist()
    return reduce(DataFrame.unionByName, out)


def _named(metrics_: DataFrame, names: list[dict]) -> DataFrame:
    """``_run`` as its names."""
    columns = [F.element_at(F.array(*[F.lit(n[k]) for n in names]), F.col("_run") + 1).alias(k) for k in names[0]]
    return metrics_.select(*columns, *[c for c in metrics_.columns if c != "_run"])
