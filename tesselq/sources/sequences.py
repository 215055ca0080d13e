"""Sequence files (a header of 1024 bytes, then frames with time stamps) as rows of frames and back.

A file is one row of Spark's binary source, so it is read by one task and holds 2 GB at most; longer recordings
come as several files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .png import decode, encode

#: Fixed values of the format: tag, name, sizes of header, and codes of the frames' encodings.
TAG, NAME, HEADER = 0xFEED, "Norpix seq", 1024
RAW, JPEG, PNG = (100, 200), (102, 201), (1, 2)
FIELDS = ("width", "height", "bits", "bits_used", "bytes", "format", "frames", "zero", "frame_bytes")
HEAD_COLUMNS = "version int, width int, height int, bits int, format int, frames int, fps double, descr string"
FRAME_COLUMNS = "frame int, ts double, w int, h int, channels int, content binary, data array<float>"


def header(data: bytes) -> dict | None:
    """The header's fields; None for anything else than a sequence of 8 bits a channel."""
    if len(data) < HEADER or struct.unpack_from("<I", data)[0] != TAG or data[4:24].decode("utf-16-le", "replace") != NAME:
        return None
    version, size = struct.unpack_from("<iI", data, 28)
    head = dict(zip(FIELDS, struct.unpack_from("<9I", data, 548), strict=True))
    if size != HEADER or head["bits_used"] != 8 or head["zero"]:
        return None
    descr = data[36:548].decode("utf-16-le", "replace").split("\0", 1)[0]
    return head | {"version": version, "descr": descr, "fps": struct.unpack_from("<d", data, 584)[0]}


def places(data: bytes, head: dict) -> list[tuple[int, int]]:
    """(start, end) of each whole frame's bytes; its time stamp follows. Compressed frames are preceded by their size."""
    if head["format"] in RAW:
        step, size = head["frame_bytes"], head["bytes"]
        starts = range(HEADER, HEADER + step * head["frames"], step) if step else ()
        return [(s, s + size) for s in starts if s + size + 6 <= len(data)]
    out, at, gap = [], HEADER, 8
    while at + 4 <= len(data) and (not head["frames"] or len(out) < head["frames"]):
        size = struct.unpack_from("<I", data, at)[0]
        if size < 4 or at + size + 6 > len(data):
            break
        out.append((at + 4, at + size))
        # Some writers leave 8 bytes more after each frame; the first gap tells.
        if len(out) == 1 and data[at + size + gap : at + size + gap + 4] == bytes(4):
            gap += 8
        at += size + gap
    return out


def stamp(data: bytes, end: int) -> float:
    seconds, thousandths = struct.unpack_from("<IH", data, end)
    return seconds + thousandths / 1000


def rate(stamps: list[float], stored: float) -> float:
    """Frames a second by the first 100 time stamps, steps off the median by 5 ms or more left out; else as stored."""
    steps = np.diff(stamps[:100])
    steps = steps[np.abs(steps - np.median(steps)) < 0.005] if len(steps) else steps
    return float(1 / steps.mean()) if len(steps) and steps.mean() else stored


def pixels(content: bytes, head: dict) -> np.ndarray | None:
    """(h, w, channels), red first; None for an encoding without a decoder here (JPEG and colour mosaics)."""
    if head["format"] in PNG:
        return decode(content)
    channels = head["bits"] // 8
    if head["format"] not in RAW or len(content) != head["height"] * head["width"] * channels:
        return None
    image = np.frombuffer(content, np.uint8).reshape(head["height"], head["width"], channels)
    return image[:, :, ::-1] if channels == 3 else image


def _each(spark: SparkSession, path: str, fn, columns: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                head = header(data)
                if head is not None:
                    yield from fn(name, data, head)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, {columns}")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """file and the header's fields, frames as found and fps by time stamps; a file that is no sequence gives no row."""

    def fn(name, data, head):
        at = places(data, head)
        row = head | {"file": name, "frames": len(at), "fps": rate([stamp(data, e) for _, e in at[:100]], head["fps"])}
        names = ["file", "version", "width", "height", "bits", "format", "frames", "fps", "descr"]
        types = [pa.string(), *[pa.int32()] * 6, pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, types, strict=True)], names=names)

    return _each(spark, path, fn, HEAD_COLUMNS)


def read_frames(spark: SparkSession, path: str, decoded: bool = True) -> DataFrame:
    """file, frame (from 0), ts, w, h, channels, content (its bytes in the file), data (array<float>, row by row).

    ``data`` is null where ``decoded`` is false or there is no decoder; w, h and channels are the header's.
    """

    def fn(name, data, head):
        for i, (start, end) in enumerate(places(data, head)):
            image = pixels(data[start:end], head) if decoded else None
            flat = None if image is None else image.astype(np.float32).ravel()
            row = [(name, pa.string()), (i, pa.int32()), (stamp(data, end), pa.float64()), (head["width"], pa.int32()), (head["height"], pa.int32()),
                   (head["bits"] // 8, pa.int32()), (data[start:end], pa.binary()), (flat, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=["file", "frame", "ts", "w", "h", "channels", "content", "data"])

    return _each(spark, path, fn, FRAME_COLUMNS)


def write_header(head: dict) -> bytes:
    """The 1024 bytes of ``head``; fields it lacks are zero, the version 3."""
    head = {k: 0 for k in FIELDS} | {"version": 3, "descr": "", "fps": 0.0, "bits_used": 8} | head
    descr = head["descr"][:256].encode("utf-16-le")[:512].ljust(512, b"\0")
    start = struct.pack("<I", TAG) + NAME.encode("utf-16-le") + bytes(4) + struct.pack("<iI", head["version"], HEADER) + descr
    return (start + struct.pack("<9Id", *(head[k] for k in FIELDS), head["fps"])).ljust(HEADER, b"\0")


def sequence(frames: list[tuple[float, np.ndarray]], fps: float, compressed: bool = False, descr: str = "") -> bytes:
    """A sequence file of (time stamp, (h, w, channels) uint8 red first): raw frames, or PNG frames if ``compressed``."""
    h, w, c = frames[0][1].shape if frames else (0, 0, 1)
    size = h * w * c
    step = size + 6 + 512 - (size + 6) % 512
    form = (PNG[0] if c == 1 else PNG[1]) if compressed else (RAW[0] if c == 1 else RAW[1])
    out = [write_header({"width": w, "height": h, "bits": 8 * c, "bytes": size, "format": form, "frames": len(frames), "frame_bytes": step, "fps": fps, "descr": descr})]
    for ts, image in frames:
        when = struct.pack("<IH", int(ts), round((ts - int(ts)) * 1000) % 1000)
        if compressed:
            body = encode(image)
            out.append(struct.pack("<I", len(body) + 4) + body + when + bytes(10))
        else:
            raw = np.ascontiguousarray(image[:, :, ::-1] if c == 3 else image, np.uint8).tobytes()
            out.append((raw + when).ljust(step, b"\0"))
    return b"".join(out)


def sequence_bytes(frames: DataFrame, key: str, fps: float, compressed: bool = False) -> DataFrame:
    """``key`` and content: the sequence file of each key's rows (frame, ts, w, h, channels, data) by frame; values are rounded and cut to 0..255.

    A file is one row, built by one task. Rows without data are left out.
    """

    def run(k, pdf):
        import pandas as pd

        rows = pdf.sort_values("frame")
        images = [(t, np.rint(np.clip(np.asarray(d, float), 0, 255)).astype(np.uint8).reshape(h, w, c)) for t, w, h, c, d in zip(rows.ts, rows.w, rows.h, rows.channels, rows.data, strict=True)]
        return pd.DataFrame([[k[0], sequence(images, fps, compressed)]], columns=[key, "content"])

    kept = frames.where("data is not null").select(key, "frame", "ts", "w", "h", "channels", "data")
    return kept.groupBy(key).applyInPandas(run, f"`{key}` {dict(frames.dtypes)[key]}, content binary")


def with_header(content: bytes, **changes: object) -> bytes:
    """The file with fields of its header changed and its frames as they were."""
    head = header(content)
    if head is None:
        raise ValueError("not a sequence file")
    return write_header(head | changes) + content[HEADER:]


def crop_frames(frames: DataFrame, first: int, last: int) -> DataFrame:
    """Frames first to last of each file, numbered from 0."""
    return frames.where(F.col("frame").between(first, last)).withColumn("frame", F.col("frame") - first)


def dual(left: DataFrame, right: DataFrame) -> DataFrame:
    """frame, ts and data of both sides (a: left's, b: right's): frames that both sequences have."""
    a = left.select("frame", F.col("ts").alias("ts_a"), F.col("data").alias("a"))
    return a.join(right.select("frame", F.col("ts").alias("ts_b"), F.col("data").alias("b")), "frame")
