"""Overlap joins of boxes, suppression, and greedy assignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box, iou
from .statistics import roc


def overlaps(boxes: DataFrame, key: str, cell: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, id, other (id < other) and iou of the pairs of boxes (key, id, x, y, w, h) that overlap, with the columns ``carry`` of both (``a_`` and ``b_``).

    Boxes are dealt to the cells of a grid that they touch; a pair meets in the cell of its common corner only. ``cell`` is the
    side of a cell; left out, it is the largest side of any box, so that a box touches four cells at most.
    """
    if cell is None:
        cell = boxes.agg(F.max(F.greatest("w", "h"))).first()[0] or 1.0
    at = lambda c: F.floor(c / cell).cast("int")
    cells = boxes.where("w > 0 and h > 0").withColumn("_cx", F.explode(F.sequence(at(F.col("x")), at(F.col("x") + F.col("w"))))).withColumn("_cy", F.explode(F.sequence(at(F.col("y")), at(F.col("y") + F.col("h")))))
    a = cells.select(key, "_cx", "_cy", *(F.col(c).alias(f"a_{c}") for c in ("id", "x", "y", "w", "h", *carry)))
    b = cells.select(key, "_cx", "_cy", *(F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "w", "h", *carry)))
    pairs = a.join(b, [key, "_cx", "_cy"]).where(F.col("a_id") < F.col("b_id"))
    pairs = pairs.where((F.col("_cx") == at(F.greatest("a_x", "b_x"))) & (F.col("_cy") == at(F.greatest("a_y", "b_y"))))
    return pairs.select(key, F.col("a_id").alias("id"), F.col("b_id").alias("other"), iou(box("a_"), box("b_")).alias("iou"), *(f"{side}_{c}" for side in "ab" for c in carry)).where("iou > 0")


def suppress(boxes: DataFrame, key: str, threshold: float) -> DataFrame:
    """Boxes (key, id, x, y, w, h, score) without those that overlap a better one (smaller id of equals) by more than ``threshold``; suppressed boxes still suppress."""
    pairs = overlaps(boxes, key, carry=("score",)).where(F.col("iou") > threshold)
    losers = pairs.select(key, F.when(F.col("a_score") >= F.col("b_score"), F.col("other")).otherwise(F.col("id")).alias("id")).distinct()
    return boxes.join(losers, [key, "id"], "left_anti")


BOX = ("x", "y", "w", "h")


def by_group(rows: DataFrame, key: str, order: list, fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], columns: list[str], schema: str) -> DataFrame:
    """``fn`` of the ``columns`` of each group of ``key``, its rows in ``order``; a task holds one group (one image) at a time besides a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            keys = t.column(key).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            arrays = {c: t.column(c).to_numpy() for c in columns}
            out = [fn({c: v[i:j] for c, v in arrays.items()}) for i, j in zip(begins, [*begins[1:], len(keys)], strict=True)]
            yield pa.RecordBatch.from_pydict({c: np.concatenate([o[c] for o in out]) for c in out[0]})

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(key)[batch.num_rows - 1]
            cut = batch.num_rows - 1
            while cut and batch.column(key)[cut - 1].equals(last):
                cut -= 1
            if held and not held[-1].column(key)[held[-1].num_rows - 1].equals(batch.column(key)[0]):
                yield from whole(held)
                held = []
            if cut:
                yield from whole([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from whole(held)

    return rows.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _common(boxes: dict[str, np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
    """Area that box i has in common with each of ``others``."""
    x, y, w, h = (boxes[c] for c in BOX)
    iw = np.minimum(x[i] + w[i], x[others] + w[others]) - np.maximum(x[i], x[others])
    ih = np.minimum(y[i] + h[i], y[others] + h[others]) - np.maximum(y[i], y[others])
    return np.maximum(iw, 0) * np.maximum(ih, 0)


def _shares(boxes: dict[str, np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
    """Overlap by union of box i with each of ``others``; 0 where nothing is common."""
    common = _common(boxes, i, others)
    area = boxes["w"] * boxes["h"]
    of = area[i] + area[others] - common
    return np.divide(common, of, out=np.zeros(len(others)), where=(common > 0) & (of > 0))


def suppress_greedy(boxes: DataFrame, key: str, threshold: float) -> DataFrame:
    """Like ``suppress``, but a suppressed box suppresses none: boxes are taken by falling score within each key (one image)."""

    def run(group: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        left = np.arange(len(group["id"]))
        kept = []
        while len(left):
            kept.append(left[0])
            left = left[1:][_shares(group, left[0], left[1:]) <= threshold]
        return {c: v[kept] for c, v in group.items()}

    columns = [key, "id", *BOX, "score"]
    types = dict(boxes.dtypes)
    return by_group(boxes, key, [F.col("score").desc(), "id"], run, columns, ", ".join(f"{c} {types[c]}" for c in columns))


def suppress_cover(boxes: DataFrame, key: str, threshold: float) -> DataFrame:
    """Greedy weighted cover: the box whose neighbourhood (overlap above ``threshold``, itself included) holds most score is kept with that sum, its neighbourhood goes, and so on; ties by id."""

    def run(group: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(group["id"])
        near = np.stack([_shares(group, i, np.arange(n)) > threshold for i in range(n)]) | np.eye(n, dtype=bool)
        free, kept, sums = np.ones(n, bool), [], []
        score = group["score"].astype(float)
        while free.any():
            total = (near & free) @ score
            total[~free] = -np.inf
            best = int(np.argmax(total))
            kept.append(best)
            sums.append(total[best])
            free &= ~near[best]
        return {c: v[kept] for c, v in group.items()} | {"score": np.asarray(sums)}

    columns = [key, "id", *BOX, "score"]
    types = dict(boxes.dtypes) | {"score": "double"}
    return by_group(boxes, key, ["id"], run, columns, ", ".join(f"{c} {types[c]}" for c in columns))


def evaluate(detections: DataFrame, truth: DataFrame, key: str, threshold: float = 0.5, mul: bool = False) -> DataFrame:
    """Greedy matching by key: detections (key, id, x, y, w, h, score) by falling score, each to the truth (key, id, x, y, w, h, and ignore, 0 or 1, where there is one) it overlaps best.

    One row for each box of either side: key, id, is_truth, score, match. A truth takes one detection, or any number if it is
    to be ignored or with ``mul``. Overlap with an ignored truth is by the detection's own area, and counts only where no
    other truth is good enough. match of a detection: 1, 0 (none) or -1 (an ignored truth); of a truth: 1, 0 (missed) or -1 (ignored).
    """

    def run(group: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        is_truth = group["is_truth"].astype(bool)
        match = np.where(is_truth & (group["ignore"] > 0), -1, 0)
        regular, ignored = np.flatnonzero(is_truth & (match == 0)), np.flatnonzero(match < 0)
        taken = np.zeros(len(match), bool)
        area = group["w"] * group["h"]
        for d in np.flatnonzero(~is_truth):
            free = regular if mul else regular[~taken[regular]]
            over = _shares(group, d, free)
            if len(over) and over.max() >= threshold:
                best = free[int(np.argmax(over))]
                taken[best], match[best], match[d] = True, 1, 1
            elif len(ignored) and area[d] > 0 and (_common(group, d, ignored) / area[d]).max() >= threshold:
                match[d] = -1
        return {key: group[key], "id": group["id"], "is_truth": group["is_truth"], "score": group["score"], "match": match.astype(np.int32)}

    types = dict(detections.dtypes)
    own = [key, "id", *BOX]
    ignore = F.col("ignore").cast("int") if "ignore" in truth.columns else F.lit(0)
    both = detections.select(*own, F.col("score").cast("double"), F.lit(0).alias("ignore"), F.lit(0).alias("is_truth"))
    both = both.unionByName(truth.select(*own, F.lit(float("nan")).alias("score"), F.coalesce(ignore, F.lit(0)).alias("ignore"), F.lit(1).alias("is_truth")))
    return by_group(both, key, ["is_truth", F.col("score").desc(), "id"], run, [*own, "score", "ignore", "is_truth"], f"{key} {types[key]}, id {types['id']}, is_truth int, score double, match int")


def evaluation_roc(matches: DataFrame) -> DataFrame:
    """score, tp, fp, recall, precision for each distinct score of the detections of ``evaluate``; ignored boxes of either side don't count."""
    counted = matches.where("match <> -1")
    positives = counted.where("is_truth = 1").agg(F.count("*")).scalar()
    points = roc(counted.where("is_truth = 0"), "score", "match")
    return points.select("score", "tp", "fp", (F.col("tp") / positives).alias("recall"), "precision")


def suppress_near(points: DataFrame, key: str, at: str, value: str, radius: float) -> DataFrame:
    """Points (key, id, at, value) without those that have a greater value (smaller id of equals) within ``radius``; a bucketed anti join."""
    bucket = F.floor(F.col(at) / radius).cast("long")
    other = points.select(key, bucket.alias("_b"), F.col("id").alias("_id"), F.col(at).alias("_at"), F.col(value).alias("_v"))
    own = points.withColumn("_b", bucket)
    own = own.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_d")).withColumn("_b", F.col("_b") + F.col("_d"))
    beaten = own.join(other, [key, "_b"]).where((F.abs(F.col(at) - F.col("_at")) <= radius) & ((F.col("_v") > F.col(value)) | ((F.col("_v") == F.col(value)) & (F.col("_id") < F.col("id")))))
    return points.join(beaten.select(key, "id").distinct(), [key, "id"], "left_anti")
