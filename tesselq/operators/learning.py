"""Classifiers whose fits are aggregations: ferns, stumps and trees by histograms, discriminants, folds. Models are small tables or Columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fern_index(features: list[Column], thresholds: list[float]) -> Column:
    """The number whose bits, from the first as the highest, say which features are below their thresholds."""
    out = F.lit(0)
    for f, t in zip(features, thresholds, strict=True):
        out = out * 2 + (f < t).cast("int")
    return out


def fern_tables(rows: DataFrame, ferns: dict[int, Column], label: str, classes: int, bins: int, prior: float = 1.0) -> DataFrame:
    """fern, leaf, label, logp: log share of a class at a leaf, each count of (leaf, class) raised by ``prior``, over the class's total."""
    at = F.array(*(F.struct(F.lit(k).alias("fern"), c.alias("leaf")) for k, c in ferns.items()))
    counts = rows.select(F.explode(at).alias("a"), F.col(label).alias("label")).groupBy("a.fern", "a.leaf", "label").agg(F.count("*").alias("n"))
    totals = F.sum("n").over(Window.partitionBy("fern", "label"))
    return counts.select("fern", "leaf", "label", F.log((F.col("n") + prior) / (totals + prior * bins)).alias("logp"))


def fern_predict(rows: DataFrame, key: str, ferns: dict[int, Column], tables: DataFrame, bins: int, prior: float = 1.0) -> DataFrame:
    """key, predicted: the class of the largest sum of log shares over the ferns (the smallest of equals); a leaf never seen with a class has the prior alone."""
    at = F.array(*(F.struct(F.lit(k).alias("fern"), c.alias("leaf")) for k, c in ferns.items()))
    spread = rows.select(key, F.explode(at).alias("a")).select(key, "a.fern", "a.leaf")
    classes = tables.select("fern", "label").distinct()
    totals = tables.groupBy("fern", "label").agg((F.sum(F.exp("logp")) - 1).alias("_seen"), F.count("*").alias("_leaves"))
    # What a leaf without rows has: prior / (total + prior * bins), from the mass that the leaves with rows leave over.
    empty = totals.select("fern", "label", F.log(F.greatest(-F.col("_seen"), F.lit(1e-12)) / F.greatest(bins - F.col("_leaves"), F.lit(1))).alias("_empty"))
    full = spread.join(F.broadcast(classes), "fern").join(F.broadcast(tables), ["fern", "leaf", "label"], "left").join(F.broadcast(empty), ["fern", "label"])
    sums = full.groupBy(key, "label").agg(F.sum(F.coalesce("logp", "_empty")).alias("s"))
    return sums.groupBy(key).agg(F.min_by("label", F.struct(-F.round("s", 9), F.col("label"))).alias("predicted"))


def leaf_means(rows: DataFrame, leaf: Column, target: str, shrink: float) -> DataFrame:
    """leaf, mean: targets of a leaf summed, by their number plus ``shrink``."""
    return rows.groupBy(leaf.alias("leaf")).agg((F.sum(target) / (F.count(target) + shrink)).alias("mean"))


def stump_errors(rows: DataFrame, features: list[str], label: str, weight: str, bins: int) -> DataFrame:
    """feature, bin, error: weight on the wrong side of "below bin is 0", or of the reverse, whichever is less, as a share; features are quantised to 0 ... bins - 1.

    Cumulative weights by class over a feature's bins; rows are added up by (feature, bin) first.
    """
    spread = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("bin")) for f in features))).alias("f"), label, weight)
    sums = spread.groupBy("f.feature", "f.bin").agg(F.sum(F.when(F.col(label) == 1, F.col(weight)).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0.0).otherwise(F.col(weight))).alias("n"))
    below = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    of = Window.partitionBy("feature")
    run = sums.withColumn("_p", F.coalesce(F.sum("p").over(below), F.lit(0.0))).withColumn("_n", F.coalesce(F.sum("n").over(below), F.lit(0.0))).withColumn("_tp", F.sum("p").over(of)).withColumn("_tn", F.sum("n").over(of))
    wrong = (F.col("_p") + F.col("_tn") - F.col("_n")) / (F.col("_tp") + F.col("_tn"))
    return run.select("feature", "bin", F.least(wrong, 1 - wrong).alias("error"))


def tree_column(tree: dict, features: dict[str, Column]) -> Column:
    """The value of a binary tree: {"feature", "below", "left", "right"} or {"value"}; below goes left, null goes right."""
    if "value" in tree:
        return F.lit(float(tree["value"]))
    return F.when(features[tree["feature"]] < tree["below"], tree_column(tree["left"], features)).otherwise(tree_column(tree["right"], features))


def boosted(trees: list[dict], features: dict[str, Column]) -> Column:
    """Sum of the trees' values; a forest is its mean."""
    return sum((tree_column(t, features) for t in trees), F.lit(0.0))


def project(v: Column, mean: list[float], axes: list[list[float]]) -> Column:
    """Coordinates of an array column along ``axes`` about ``mean``."""
    centred = F.zip_with(v, F.array(*map(F.lit, mean)), lambda a, b: a - b)
    dot = lambda axis: F.aggregate(F.zip_with(centred, F.array(*map(F.lit, axis)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.array(*map(dot, axes))


def scatter(rows: DataFrame, v: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and population covariance of an array column of ``size`` numbers, by one aggregation of size * (size + 1) / 2 sums."""
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    at = lambda i: F.col(v)[i].cast("double")
    n, *sums = rows.where(F.col(v).isNotNull()).agg(F.count("*"), *(F.sum(at(i)) for i in range(size)), *(F.sum(at(i) * at(j)) for i, j in pairs)).first()
    if not n:
        return 0, np.zeros(size), np.zeros((size, size))
    mean = np.asarray(sums[:size]) / n
    out = np.zeros((size, size))
    for (i, j), s in zip(pairs, sums[size:], strict=True):
        out[i, j] = out[j, i] = s / n - mean[i] * mean[j]
    return n, mean, out


def principal_axes(rows: DataFrame, v: str, size: int, k: int) -> tuple[list[float], list[list[float]], list[float]]:
    """Mean, the ``k`` axes of most variance (largest part positive), and the variances."""
    _, mean, cov = scatter(rows, v, size)
    values, vectors = np.linalg.eigh(cov)
    axes = vectors.T[::-1][:k]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return mean.tolist(), axes.tolist(), values[::-1][:k].tolist()


def discriminant(rows: DataFrame, v: str, label: str, size: int, ridge: float = 1e-6) -> dict[object, tuple[list[float], float]]:
    """Linear discriminants by class: weights and offset, from class means and the pooled covariance; labels are few."""
    shares = {r[label]: r["count"] for r in rows.groupBy(label).count().collect() if r[label] is not None}
    total = sum(shares.values())
    parts = {c: scatter(rows.where(F.col(label) == c), v, size) for c in shares}
    pooled = sum(n * cov for n, _, cov in parts.values()) / max(1, total) + ridge * np.eye(size)
    out = {}
    for c, (n, mean, _) in parts.items():
        w = np.linalg.solve(pooled, mean)
        out[c] = (w.tolist(), float(np.log(n / total) - w @ mean / 2))
    return out


def discriminate(v: Column, model: dict[object, tuple[list[float], float]]) -> Column:
    """The class of the largest discriminant."""
    score = lambda w, b: F.aggregate(F.zip_with(v, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(b), lambda s, x: s + x)
    return F.array_max(F.array(*(F.struct(score(w, b).alias("s"), F.lit(c).alias("c")) for c, (w, b) in sorted(model.items())))).c


def folds(rows: DataFrame, key: str, n: int, train: Callable[[DataFrame], object], apply: Callable[[DataFrame, object], DataFrame]) -> DataFrame:
    """``apply`` of each of ``n`` folds (by a hash of ``key``) with the model that ``train`` gives for the others, and the column ``fold``."""
    of = F.pmod(F.xxhash64(key), F.lit(n))
    out = None
    for k in range(n):
        part = apply(rows.where(of == k), train(rows.where(of != k))).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
