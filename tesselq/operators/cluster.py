"""Clustering and fits whose rounds are aggregations over the points; models are small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import sq_euclidean
from ..storage import dropped, stored
from .nearest import assign_to_centres
from .registration import linspace_grid
from .statistics import order_statistic


def mean_vectors(points: DataFrame, key: str) -> DataFrame:
    """``key``, v (mean of the arrays v, by place) and n."""
    parts = points.select(key, F.posexplode("v").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("v"), F.max("n").alias("n"))


def without_far(found: DataFrame, share: float) -> DataFrame:
    """``found`` (id, centre, dist) without the floor(rows * share) rows of greatest distance; rows as near as the nearest kept stay."""
    n = found.count()
    return found.where(F.col("dist") <= order_statistic(found, "dist", n - int(n * share))) if n else found


def kmeans_trimmed(points: DataFrame, k: int, outliers: float = 0.0, least: int = 1, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(assignments id, centre, dist; centres id, v, n by falling size) of points (id, v array<double>); centre -1 is an outlier.

    In each round the share ``outliers`` of the points, the farthest from their centres, count in no mean, and clusters
    under ``least`` points are given up. Starts as ``kmeans``; ends when the centres stay. If every cluster is given up, the point of least hash is the centre.
    """
    spark = points.sparkSession
    frame = lambda c: spark.createDataFrame(list(enumerate(c)), "id long, v array<double>")
    start = [list(map(float, r["v"])) for r in points.orderBy(F.xxhash64("id"), "id").limit(k).collect()]
    centres, sizes = start, []
    for _ in range(rounds if start else 0):
        found = stored(assign_to_centres(points, frame(centres)), "assigned")
        means = mean_vectors(without_far(found, outliers).join(points, "id"), "centre").where(F.col("n") >= least).orderBy(F.desc("n"), "centre").collect()
        now, sizes = ([list(r["v"]) for r in means] or start[:1]), [r["n"] for r in means] or [0]
        dropped(found)
        still = len(now) == len(centres) and np.allclose(np.sort(now, 0), np.sort(centres, 0), rtol=0, atol=1e-9)
        centres = now
        if still:
            break
    table = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(zip(centres, sizes, strict=True))], "id long, v array<double>, n long")
    if not centres:
        return points.select("id", F.lit(-1).cast("long").alias("centre"), F.lit(None).cast("double").alias("dist")), table
    found = stored(assign_to_centres(points, table.select("id", "v")), "assigned")
    near = without_far(found, outliers).select("id").withColumn("near", F.lit(True))
    centre = F.when(F.col("near"), F.col("centre")).otherwise(F.lit(-1).cast("long")).alias("centre")
    return found.join(near, "id", "left").select("id", centre, "dist"), table


def radial_width(centres: DataFrame, scale: float = 1.0) -> tuple[dict[int, float], float]:
    """(width by centre, common width) of centres (id, v), a model of few rows: the squared distance to the nearest other one times ``scale``,
    a hundredth of the mean at least; the common width is the mean."""
    rows = {r["id"]: np.asarray(r["v"], float) for r in centres.collect()}
    near = {a: scale * min((float(((v - w) ** 2).sum()) for b, w in rows.items() if b != a), default=1.0) for a, v in rows.items()}
    mean = float(np.mean(list(near.values()))) if near else 0.0
    return {k: max(v, mean / 100) for k, v in near.items()}, mean


def radial_features(points: DataFrame, centres: DataFrame, widths: dict[int, float], constant: bool = False, normalise: bool = False) -> DataFrame:
    """``points`` with ``features``: exp(-squared distance / (2 * width)) for each centre by rising id, a one last if ``constant``, adding up to one if ``normalise``."""
    model = sorted((r["id"], list(map(float, r["v"]))) for r in centres.collect())
    lits = F.array(*(F.struct(F.array(*map(F.lit, v)).alias("c"), F.lit(2 * widths[i]).alias("w")) for i, v in model))
    features = F.transform(lits, lambda m: F.exp(-sq_euclidean(F.col("v"), m.c) / m.w))
    if constant:
        features = F.concat(features, F.array(F.lit(1.0)))
    out = points.withColumn("features", features)
    if normalise:
        total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
        out = out.withColumn("features", F.transform("features", lambda x: x / total))
    return out


def kmeans(points: DataFrame, k: int, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(assignments id, centre, dist; centres id, v, n by falling size) of points (id, v array<double>).

    Starts from the k points of least hash, so it is the same at every run; ends when no centre moves. Centres
    are a model of k rows; an empty cluster keeps its last centre.
    """
    spark = points.sparkSession
    rows = points.orderBy(F.xxhash64("id"), "id").limit(k).collect()
    centres = [list(map(float, r["v"])) for r in rows]
    frame = lambda c: spark.createDataFrame(list(enumerate(c)), "id long, v array<double>")
    for _ in range(rounds):
        found = assign_to_centres(points, frame(centres)).join(points, "id")
        now = list(centres)
        for r in mean_vectors(found, "centre").collect():
            now[r["centre"]] = list(r["v"])
        moved = max((float(np.abs(np.subtract(a, b)).max()) for a, b in zip(now, centres, strict=True)), default=0.0)
        centres = now
        if moved < 1e-9:
            break
    sizes = {r["centre"]: r["n"] for r in assign_to_centres(points, frame(centres)).groupBy("centre").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(len(centres)), key=lambda i: (-sizes.get(i, 0), i))
    centres = [centres[i] for i in order]
    table = spark.createDataFrame([(i, centres[i], sizes.get(order[i], 0)) for i in range(len(centres))], "id long, v array<double>, n long")
    return assign_to_centres(points, table.select("id", "v")), table


class ColourMap:
    """Thin-plate spline from colours to colours: affine part, and minus the distance to each control point."""

    def __init__(self, low=(0.0, 0.0, 0.0), high=(255.0, 255.0, 255.0), side: int = 5) -> None:
        self.grid = np.asarray(linspace_grid(low, high, side))
        self.scale = float(np.linalg.norm(np.subtract(high, low)))

    def basis(self, x: np.ndarray) -> np.ndarray:
        d = np.sqrt(((x[:, None] - self.grid) ** 2).sum(2))
        return np.concatenate((np.ones((len(x), 1)), x / self.scale, -d / self.scale), 1)


def fit_colour_maps(pairs: DataFrame, colour_map: ColourMap, scales: tuple[float, ...] = (60.0, 30.0, 15.0), rounds: int = 4, ridge: float = 1e-3) -> dict:
    """Coefficients by view of ``pairs`` (view, target array<double>, palette array<double>): target colours to palette colours.

    Maximises the sum over the pairs of exp(-distance^2 / scale^2), from wide to narrow scales, so wrong pairs lose
    their weight. Each round solves weighted normal equations; their sums are taken in the tasks, and one small
    matrix for each view and task comes back.
    """
    n = 4 + len(colour_map.grid)
    coef: dict = {}

    def start() -> np.ndarray:
        c = np.zeros((n, 3))
        c[1:4] = np.eye(3) * colour_map.scale
        return c

    for scale in scales:
        for _ in range(rounds):
            known = dict(coef)

            def run(batches: Iterator[pa.RecordBatch], known=known, scale=scale) -> Iterator[pa.RecordBatch]:
                sums: dict = {}
                for b in batches:
                    views = np.asarray(b.column("view").to_pylist(), object)
                    x, y = (np.asarray(b.column(c).to_pylist(), float).reshape(-1, 3) for c in ("target", "palette"))
                    for v in set(views.tolist()):
                        at = np.flatnonzero(views == v)
                        for cut in np.array_split(at, max(1, len(at) // 4096)):
                            phi = colour_map.basis(x[cut])
                            r2 = ((phi @ known.get(v, start()) - y[cut]) ** 2).sum(1)
                            w = np.exp(-r2 / (scale * scale)) + 1e-9
                            part = np.concatenate((phi.T @ (phi * w[:, None]), phi.T @ (y[cut] * w[:, None])), 1)
                            sums[v] = sums.get(v, 0) + part
                for v, s in sums.items():
                    yield pa.RecordBatch.from_pydict({"view": pa.array([v], pa.string()), "s": pa.array([s.astype(float).tobytes()], pa.binary())})

            total: dict = {}
            for r in pairs.select(F.col("view").cast("string").alias("view"), "target", "palette").mapInArrow(run, "view string, s binary").toLocalIterator():
                total[r["view"]] = total.get(r["view"], 0) + np.frombuffer(r["s"]).reshape(n, n + 3)
            penalty = np.diag([1e-9] * 4 + [1.0] * (n - 4))
            for v, s in total.items():
                size = np.trace(s[:, :n]) / n
                coef[v] = np.linalg.solve(s[:, :n] + ridge * size * penalty + 1e-9 * size * np.eye(n), s[:, n:] + ridge * 0)
    return coef


def apply_colour_maps(pixels: DataFrame, coef: dict, colour_map: ColourMap) -> DataFrame:
    """``pixels`` (view, ..., target) with ``colour`` mapped by the view's coefficients, clipped to 0..255; null for an unknown view."""
    names = pixels.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, x in zip(map(str, b.column("view").to_pylist()), b.column("target").to_pylist(), strict=True):
                c = coef.get(v)
                out.append(None if c is None or x is None else np.clip(colour_map.basis(np.asarray([x], float)) @ c, 0, 255)[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*names, "colour"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return pixels.mapInArrow(run, StructType([*pixels.schema.fields, StructField("colour", ArrayType(DoubleType()))]))
