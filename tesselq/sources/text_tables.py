"""Match tables, annotations and flow files as DataFrames, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the flow format: the tag of a file, and what stands for an unknown vector.
FLO_TAG, FLO_UNKNOWN = 202021.25, 1e10


def _numbers(spark: SparkSession, path: str, names: list[str], skip: str) -> DataFrame:
    """Lines of blank-separated numbers as columns ``names``; what follows is ignored, a line that lacks one is kept in ``malformed``."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(f"trim(value) <> '' and not (value rlike '{skip}')")
    values = [F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)]
    out = lines.select(F.col("_metadata.file_path").alias("file"), "value", *values)
    whole = " and ".join(f"{n} is not null" for n in names)
    return out.select("file", *names, F.when(F.expr(whole), None).otherwise(F.col("value")).alias("malformed"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """file, x1, y1, x2, y2, malformed."""
    return _numbers(spark, path, ["x1", "y1", "x2", "y2"], "^#")


def write_matches(matches: DataFrame, path: str) -> None:
    cells = [F.format_string("%.0f", F.bround(c, 0).cast("double")) for c in ("x1", "y1", "x2", "y2")]
    matches.select(F.concat_ws(" ", *cells).alias("value")).write.text(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """file, img, x, y, w, h, score, malformed."""
    return _numbers(spark, path, ["img", "x", "y", "w", "h", "score"], "^%").withColumn("img", F.col("img").cast("long"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Annotation lines ``label l t w h occluded bl bt bw bh ignore angle`` after a ``%`` header; missing tail columns are zero."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ["x", "y", "w", "h", "occluded", "bx", "by", "bw", "bh", "ignore", "angle"]
    lines = spark.read.text(path).where("trim(value) <> '' and not (value rlike '^%')")
    values = [F.coalesce(F.try_element_at(parts, F.lit(i + 2)).try_cast("double"), F.lit(0.0)).alias(n) for i, n in enumerate(names)]
    return lines.select(F.col("_metadata.file_path").alias("file"), parts[0].alias("label"), *values)


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, u, v for each pixel of the ``.flo`` files under ``path``; unknown vectors are null. A file with another tag gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if len(data) < 12 or struct.unpack_from("<f", data)[0] != FLO_TAG:
                    continue
                w, h = struct.unpack_from("<ii", data, 4)
                uv = np.frombuffer(data, "<f4", 2 * w * h, 12).reshape(-1, 2)
                known = (np.abs(uv) < 1e9).all(1)
                at = np.arange(w * h)
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(at)), "x": pa.array((at % w).astype(np.int32)), "y": pa.array((at // w).astype(np.int32)), "u": pa.array(uv[:, 0], mask=~known), "v": pa.array(uv[:, 1], mask=~known)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, x int, y int, u float, v float")


def flow_bytes(flow: DataFrame, keys: list[str]) -> DataFrame:
    """keys and content: the ``.flo`` bytes of each group of (x, y, u, v); nulls and missing pixels become unknown. One file is one row."""

    def run(key, pdf):
        w, h = int(pdf.x.max()) + 1, int(pdf.y.max()) + 1
        uv = np.full((h, w, 2), FLO_UNKNOWN, "<f4")
        uv[pdf.y, pdf.x, 0], uv[pdf.y, pdf.x, 1] = pdf.u.fillna(FLO_UNKNOWN), pdf.v.fillna(FLO_UNKNOWN)
        import pandas as pd

        return pd.DataFrame([[*key, struct.pack("<fii", FLO_TAG, w, h) + uv.tobytes()]], columns=[*keys, "content"])

    types = dict(flow.dtypes)
    return flow.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", content binary")


def write_boxes(boxes: DataFrame, path: str) -> None:
    """Annotation lines that ``read_boxes`` reads, in one folder of text files a key ``img``; geometry is rounded to whole numbers."""
    whole = [F.bround(F.coalesce(F.col(c), F.lit(0.0)), 0).cast("long").cast("string") for c in ("x", "y", "w", "h", "occluded", "bx", "by", "bw", "bh", "ignore", "angle")]
    boxes.select("img", F.concat_ws(" ", "label", *whole).alias("value")).write.partitionBy("img").text(path)


def files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """file, name (without folder and suffix) and length of the files under ``path`` whose names end in ``suffix``, at any depth."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")
    base = F.element_at(F.split("file", "/"), -1)
    return found.where(base.endswith(suffix)).select("file", F.expr(f"left(element_at(split(file, '/'), -1), length(element_at(split(file, '/'), -1)) - {len(suffix)})").alias("name"), "length")


def paired_files(spark: SparkSession, left: str, right: str, suffixes: tuple[str, str] = ("", "")) -> DataFrame:
    """name, a, b: files of two folders that have one name; a name that only one has is null on the other side."""
    a = files(spark, left, suffixes[0]).select("name", F.col("file").alias("a"))
    return a.join(files(spark, right, suffixes[1]).select("name", F.col("file").alias("b")), "name", "full")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """file, row (from 0, in the file's order) and values of text files of blank- or comma-separated numbers; a part that is no number is null.

    A file is read by one task, as its lines are numbered.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\\r?\\n").alias("lines"))
    rows = whole.select("file", F.posexplode(F.filter("lines", lambda x: F.trim(x) != "")).alias("row", "line"))
    return rows.select("file", "row", F.transform(F.split(F.trim("line"), r"[\s,]+"), lambda p: p.try_cast("double")).alias("values"))
