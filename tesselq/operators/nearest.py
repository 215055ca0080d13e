"""Nearest-neighbour joins by blocks of the reference side, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reference vectors in one broadcast, and queries whose distances to them are held at once.
BLOCK_ROWS, TILE_ROWS = 20_000, 128


def _distances(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    out = np.empty((len(q), len(r)))
    for i, x in enumerate(q):
        d = x - r
        if metric == "sqeuclidean":
            out[i] = (d * d).sum(1)
        elif metric == "l1":
            out[i] = np.abs(d).sum(1)
        elif metric == "emd":
            out[i] = np.abs(np.cumsum(d, 1)).sum(1)
        elif metric == "chisq":
            out[i] = (d * d / (x + r + 2.220446049250313e-16)).sum(1) / 2
        elif metric == "cosine":
            out[i] = 1 - (r @ x) / (np.sqrt((x * x).sum()) * np.sqrt((r * r).sum(1)))
        else:
            raise ValueError(metric)
    return out


def _least(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least finite numbers; of equals the first, and first ones first."""
    bound = np.partition(row, k - 1)[k - 1] if k < len(row) else np.inf
    at = np.flatnonzero((row <= bound) & np.isfinite(row))
    return at[np.argsort(row[at], kind="stable")][:k]


def nearest(queries: DataFrame, reference: DataFrame, k: int, metric: str = "sqeuclidean", payload: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest rows of ``reference`` (id, v array, payload) for each row of ``queries`` (id, v), ids differing.

    Columns: id, other, dist, rank (from 1; ties by smaller id), and ``payload`` of the other row. The reference goes out in blocks
    of ``block_rows`` vectors, each held against all queries; only k rows a query and block are kept. Null vectors take no part.
    """
    spark = queries.sparkSession
    reference = reference.where("v is not null")
    n = reference.count()
    blocks = max(1, -(-n // block_rows))
    kind = dict(reference.dtypes)[payload] if payload else None
    schema = "id long, other long, dist double" + (f", {payload} {kind}" if payload else "")
    found = None
    for b in range(blocks):
        rows = reference.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect() if blocks > 1 else reference.orderBy("id").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.asarray([r["id"] for r in rows]), np.asarray([r["v"] for r in rows], float), [r[payload] for r in rows] if payload else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors, extra = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, TILE_ROWS):
                    tile = batch.slice(at, TILE_ROWS)
                    own = tile.column("id").to_numpy(zero_copy_only=False)
                    d = _distances(np.asarray(tile.column("v").to_pylist(), float), vectors, metric)
                    d[own[:, None] == ids[None, :]] = np.inf
                    best = [_least(row, k) for row in d]
                    rows = np.repeat(np.arange(len(own)), [len(x) for x in best])
                    best = np.concatenate(best)
                    columns = {"id": pa.array(own[rows]), "other": pa.array(ids[best]), "dist": pa.array(d[rows, best])}
                    if payload:
                        columns[payload] = pa.array([extra[i] for i in best], pa.int32() if kind == "int" else None)
                    yield pa.RecordBatch.from_pydict(columns)

        part = queries.where("v is not null").select("id", "v").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy("id").orderBy("dist", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, label: str) -> DataFrame:
    """id and predicted: the label most frequent among a query's neighbours, the smallest of equals."""
    counts = neighbours.groupBy("id", label).agg(F.count("*").alias("n"))
    return counts.groupBy("id").agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("predicted"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def mutual(neighbours: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, each the other's first neighbour."""
    first = neighbours.where("rank = 1").select("id", "other")
    back = first.select(F.col("id").alias("other"), F.col("other").alias("id"))
    return first.join(back, ["id", "other"]).where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))


def assign_to_centres(points: DataFrame, centres: DataFrame) -> DataFrame:
    """id, centre, dist of the nearest centre (smallest id of equals); ``centres`` (id, v) are few: clusters, not points."""
    out = nearest(points.select((-F.col("id") - 1).alias("id"), "v"), centres, 1)
    return out.select((-F.col("id") - 1).alias("id"), F.col("other").alias("centre"), "dist")
