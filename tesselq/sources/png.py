"""PNG files of 8 or 16 bits, not interlaced, as image rows and back; and flows kept in them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type; 3 is a palette.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Fixed values of flows in 16-bit files: zero and steps a pixel.
FLOW_ZERO, FLOW_STEPS = 2**15, 64.0


def decode(data: bytes) -> np.ndarray | None:
    """(h, w, channels) of uint8 or uint16; None for anything else than a PNG of the kinds above."""
    if not data.startswith(SIGNATURE):
        return None
    at, body, palette, head = len(SIGNATURE), b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
    if head is None or head[2] not in (8, 16) or head[3] not in CHANNELS or head[6]:
        return None
    w, h, depth, colour = head[:4]
    step = CHANNELS[colour] * depth // 8
    try:
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    except (zlib.error, ValueError):
        return None
    out = np.zeros((h, w, step), np.uint8)
    above = np.zeros((w, step), np.uint8)
    for y in range(h):
        line, kind = rows[y, 1:].reshape(w, step), rows[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line, 0, dtype=np.uint8)
        elif kind == 2:
            out[y] = line + above
        else:
            left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
            up = above.astype(np.int32)
            for x in range(w):
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    a, b, c = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
                left = (line[x] + guess) & 255
                corner = up[x]
                out[y, x] = left
        above = out[y]
    if depth == 16:
        out = np.ascontiguousarray(out).view(">u2").astype(np.uint16)
    return palette[out[:, :, 0]] if colour == 3 and palette is not None else out


def encode(image: np.ndarray) -> bytes:
    """A PNG of (h, w, channels): 16 bits for uint16, else 8; every row unfiltered."""
    h, w, c = image.shape
    wide = image.dtype == np.uint16
    rows = np.ascontiguousarray(image, ">u2" if wide else np.uint8).view(np.uint8).reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 16 if wide else 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    body = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes())
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """file, w, h, channels, data (array<float>, row by row) of the files under ``path``; a file that can't be decoded has nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                image = decode(content)
                h, w, c = image.shape if image is not None else (None, None, None)
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([name]), "w": pa.array([w], pa.int32()), "h": pa.array([h], pa.int32()), "channels": pa.array([c], pa.int32()),
                    "data": pa.array([None if image is None else image.astype(np.float32).ravel()], pa.list_(pa.float32())),
                })

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, w int, h int, channels int, data array<float>")


def image_bytes(images: DataFrame) -> DataFrame:
    """id and content: the 8-bit PNG of each row (id, w, h, channels, data), values clipped to 0..255 and rounded; null data gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, c, data in zip(*(b.column(k).to_pylist() for k in ("w", "h", "channels", "data")), strict=True):
                out.append(None if data is None else encode(np.rint(np.clip(np.asarray(data), 0, 255)).astype(np.uint8).reshape(h, w, c)))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "content": pa.array(out, pa.binary())})

    return images.select("id", "w", "h", "channels", "data").mapInArrow(run, f"id {dict(images.dtypes)['id']}, content binary")


def read_flow_images(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, u, v of 16-bit flow files: steps of 1/64 pixel about 2^15; a third channel of 0 marks unknown vectors, which are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                image = decode(content)
                if image is None or image.dtype != np.uint16 or image.shape[2] != 3:
                    continue
                flat = image.reshape(-1, 3)
                at, known = np.arange(len(flat)), flat[:, 2] > 0
                uv = (flat[:, :2].astype(np.float32) - FLOW_ZERO) / FLOW_STEPS
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(at)), "x": pa.array((at % image.shape[1]).astype(np.int32)), "y": pa.array((at // image.shape[1]).astype(np.int32)), "u": pa.array(uv[:, 0], mask=~known), "v": pa.array(uv[:, 1], mask=~known)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, x int, y int, u float, v float")


def flow_image(u: np.ndarray, v: np.ndarray) -> bytes:
    """The 16-bit file of a flow; NaN is unknown, what is out of range is cut."""
    known = ~(np.isnan(u) | np.isnan(v))
    steps = [np.clip(np.rint(np.nan_to_num(c) * FLOW_STEPS + FLOW_ZERO), 0, 65535) * known for c in (u, v)]
    return encode(np.stack([*steps, known], 2).astype(np.uint16))
