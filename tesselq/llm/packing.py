"""Packing: token sequences of one fixed length with balanced attention cost.

Cost-balanced packing: the cost of a piece of n tokens is estimated as linear * n + quadratic * n * n
(dense layers, and attention within the piece). Documents are taken in descending length; each goes
to the sequence of lowest cost that can still hold it whole; one that fits nowhere is cut at the
sequence with most room. Sequences are opened for the group's exact number of tokens, so a group
leaves less than one sequence of padding.

A group is what one task reads, up to ``group_tokens`` tokens: no shuffle, and memory is bounded
whatever the input. Tokenisation keeps a bounded cache of space-delimited chunks: byte-level BPE
splits before a single space that stands between visible characters, so chunks are independent there.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table

CACHE_ENTRIES = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ChunkIds(dict):
    """Little-endian uint32 ids of " " + chunk, remembered for at most ``CACHE_ENTRIES`` chunks."""

    def __init__(self, ids) -> None:
        super().__init__()
        self.ids = ids

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise LookupError  # white space runs across the cut
        out = self.ids(" " + chunk)
        if len(self) < CACHE_ENTRIES and len(chunk) <= 64:
            self[chunk] = out
        return out


class Encoder:
    """one(text) equals the ids that the tokenizer file gives for the whole text, as little-endian uint32 bytes.

    Where the file is a byte-level BPE whose ids follow its merges, the same vocabulary is run as
    ranks, which is several times faster; any other file, and a text that holds a special token's
    string, goes through the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks(path)
        self.chunks = None
        if ranks:
            import public_tokenizers
            import tiktoken

            core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
            nothing: set[str] = set()
            self.chunks = ChunkIds(lambda text: bytes(core.encode_to_tiktoken_buffer(text, nothing)))

    def slow(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, text: str) -> bytes:
        if not text:
            return b""
        if self.chunks is None or any(s in text for s in self.special):
            return self.slow(text)
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise LookupError
            return self.chunks.ids(first) + b"".join(map(self.chunks.__getitem__, rest))
        except LookupError:
            return self.chunks.ids(text)


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE file, if the ids are 256 bytes and then one for each merge in order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        return None
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocab, merges = model["vocab"], model["merges"]
    for i, m in enumerate(merges):
        a, b = m.split(" ") if isinstance(m, str) else m
        if vocab.get(a + b) != 256 + i:
            return None
    return {bytes(byte_of[c] for c in k): v for k, v in vocab.items() if v < 256 + len(merges)}


def assign(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document index, start, length, sequence, offset) of one group.

    Every token of every document lies in exactly one piece; offsets have no gaps. Ties in length
    keep input order; ties in cost take the lowest sequence. Zero-length documents get no piece.
    """
    total = int(lengths.sum())
    n = -(-total // size)
    pieces: list[tuple[int, int, int, int, int]] = []
    if not n:
        return pieces
    order = np.argsort(-lengths, kind="stable")
    # What fills whole sequences goes first, alone; the rest shares the others.
    rest: list[tuple[int, int, int]] = []  # (-length, document, start)
    used = 0
    for d in order.tolist():
        length = int(lengths[d])
        start = 0
        while length - start >= size:
            pieces.append((d, start, size, used, 0))
            used, start = used + 1, start + size
        if length > start:
            rest.append((start - length, d, start))
    heapq.heapify(rest)
    room = np.full(n - used, size, np.int64)
    cost = np.zeros(n - used)
    while rest:
        neg, d, start = heapq.heappop(rest)
        length = -neg
        fits = np.flatnonzero(room >= length)
        if len(fits):
            s, take = int(fits[np.argmin(cost[fits])]), length
        else:
            s = int(np.argmax(room))
            take = int(room[s])
            heapq.heappush(rest, (take - length, d, start + take))
        pieces.append((d, start, take, used + s, size - int(room[s])))
        room[s] -= take
        cost[s] += linear * take + quadratic * take * take
    return pieces


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    group_tokens: int = 1_500_000,
    with_ids: bool = False,
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``size`` tokens; one row per piece.

    A document is its tokenizer ids followed by ``end_id``; null and empty texts are ``end_id`` alone.
    Repeated rows are packed as often as they occur. Null ids stay null. Other columns are ignored.
    An empty table gives no rows. ``with_ids`` adds the piece's ids (array<int>). sequence_id is
    partition * 2**33 + number, so it is unique across tasks and the same when a task is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        end = np.asarray([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        held_keys: list = []
        held_ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            lengths = np.asarray([len(x) // 4 for x in held_ids], np.int64)
            pieces = assign(lengths, size, linear, quadratic)
            cut = [held_ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            columns = {
                "doc_id": pa.array([held_keys[p[0]] for p in pieces], pa.int64()),
                "start": pa.array([p[1] for p in pieces], pa.int64()),
                "length": pa.array([p[2] for p in pieces], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                "doc_tokens": pa.array(lengths[[p[0] for p in pieces]], pa.int64()),
                "sequence_id": pa.array([base + p[3] for p in pieces], pa.int64()),
                "offset": pa.array([p[4] for p in pieces], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32()))
            base += max((p[3] for p in pieces), default=-1) + 1
            return pa.RecordBatch.from_pydict(columns)

        for part in rows_of(batches, 2_000_000):
            for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = encoder.one(text or "")
                held_keys.append(key)
                held_ids.append(ids + end)
                held += len(ids) // 4 + 1
            if held >= group_tokens:
                yield flush()
                held_keys, held_ids, held = [], [], 0
        if held_ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
