"""Near-duplicate documents: SimHash fingerprints linked within two bits.

Deletion-variant signatures: a 64-bit fingerprint is cut into two segments of 32 bits, so that of two
fingerprints at most two bits apart one segment differs by at most one bit. Each segment is indexed
under its 32 one-wildcard variants (one bit deleted); fingerprints that are equal under a variant are
compared whole. Only distinct fingerprints are indexed, so exact copies never meet in pairs.

A bucket of more than ``bucket_limit`` fingerprints isn't expanded into pairs. Its members are indexed
a second time, under the 65 points at most one bit away from the whole fingerprint: two fingerprints
at most two bits apart share such a point, all that share one are linked, and at most 65 can share
one. Each is tied to the smallest there, which loses no link between groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fresh, materialize, rows_of, table, utf8
from .components import connected
from .near_copies import groups

SEGMENT_BITS = 32
LANES = np.uint64(0x0101010101010101)
LANE_MAX = 255


def _majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of ``hashes``; run i ends at ends[i], none is empty.

    Bits k, k + 8, ... of each hash are counted in the eight bytes of one word, at most 255 hashes at a time.
    """
    starts = np.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    cuts = np.concatenate([np.arange(a, b, LANE_MAX) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    first = np.searchsorted(cuts, starts)
    out = np.zeros(len(ends), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        for byte in range(8):
            out |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints_of(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """uint64 fingerprint of each UTF-8 text; zero for a text without words."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    ends: list[int] = []
    rows: list[int] = []
    out = np.zeros(len(texts), np.uint64)
    for row, text in enumerate(texts):
        words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
        if not words:
            continue
        if len(words) < shingle:
            hashes.append(digest(b" ".join(words), 42))
        else:
            hashes.extend([digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)), strict=False)])
        ends.append(len(hashes))
        rows.append(row)
    if rows:
        out[rows] = _majority(np.asarray(hashes, np.uint64), np.asarray(ends))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of each row of ``docs``: ``fp`` is the fingerprint as a signed long; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 2_000_000):
            fp = fingerprints_of(utf8(part.column("text")), shingle).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").combine_chunks(), "fp": pa.array(fp)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _variants(fp: DataFrame) -> DataFrame:
    """(key, fp) for each segment and each of its one-wildcard variants; the key holds segment, wildcard and the other bits."""
    rows = []
    for segment in range(64 // SEGMENT_BITS):
        bits = F.shiftrightunsigned("fp", segment * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
        for j in range(SEGMENT_BITS):
            tag = (segment * SEGMENT_BITS + j) << SEGMENT_BITS
            rows.append(bits.bitwiseAND(F.lit(((1 << SEGMENT_BITS) - 1) ^ (1 << j))).bitwiseOR(F.lit(tag)))
    return fp.select(F.explode(F.array(*rows)).alias("key"), "fp")


def _pairs_of_sorted(limit: int):
    """mapInArrow function over rows sorted by (key, fp): links within buckets, and members of buckets over ``limit``."""

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Of whole groups."""
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begins, len(key)))
        over = np.repeat(size > limit, size)
        if over.any():
            yield fp[over], fp[over], True
        key, fp = key[~over], fp[~over]
        wild = ((key >> SEGMENT_BITS) & (SEGMENT_BITS - 1)).astype(np.uint64)
        shift = ((key >> (SEGMENT_BITS + 5)) * SEGMENT_BITS).astype(np.uint64)
        for step in range(1, min(limit, len(key))):
            at = np.flatnonzero(key[step:] == key[:-step])
            if not len(at):
                break
            apart = (fp[at] ^ fp[at + step]).view(np.uint64)
            inside = (apart >> shift[at]) & np.uint64((1 << SEGMENT_BITS) - 1)
            # Equal segments meet under every wildcard; count that meeting once.
            once = np.where(inside == 0, wild[at] == 0, True)
            ok = (np.bitwise_count(apart) <= 2) & once
            yield fp[at[ok]], fp[at[ok] + step], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.int64)
        hot = None  # the key of a bucket already known to be over the limit

        def out(parts) -> Iterator[pa.RecordBatch]:
            for a, b, over in parts:
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b, "hot": np.full(len(a), over)})

        for batch in batches:
            key = np.concatenate((key, batch.column("key").to_numpy()))
            fp = np.concatenate((fp, batch.column("fp").to_numpy()))
            if hot is not None:
                n = int(np.searchsorted(key, hot, "right"))
                yield from out([(fp[:n], fp[:n], True)])
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                hot = None
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield from out(links(key[:cut], fp[:cut]))
            key, fp = key[cut:], fp[cut:]
            if len(key) > limit:
                yield from out([(fp, fp, True)])
                hot, key, fp = key[0], key[:0], fp[:0]
        if len(key):
            yield from out(links(key, fp))

    return run


def _stars_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, fp): ties each fingerprint of a key to the key's smallest."""
    last, least = None, None
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(key):
            continue
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        first = fp[np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))]
        if last is not None and key[0] == last:
            first[: int(np.searchsorted(key, last, "right"))] = least
        last, least = key[-1], first[-1]
        ok = first != fp
        yield pa.RecordBatch.from_pydict({"a": first[ok], "b": fp[ok]})


def links(distinct: DataFrame, bucket_limit: int = 16) -> DataFrame:
    """Edges (a, b) between fingerprints of ``distinct`` (fp long, no repeats) at most two bits apart, enough of them to connect all such."""
    found = _variants(distinct).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_pairs_of_sorted(bucket_limit), "a long, b long, hot boolean")
    found = materialize(found, "links")
    points = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << j if j < 63 else -(1 << 63))) for j in range(64)))
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct().select(F.explode(points).alias("key"), "fp")
    stars = hot.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_stars_of_sorted, "a long, b long")
    return found.where("not hot").select("a", "b").union(stars)


def components(fps: DataFrame, bucket_limit: int = 16) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``fps`` (doc_id, fp), which should be a stored table: it is read three times."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = connected(links(distinct.select("fp"), bucket_limit))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket_limit: int = 16) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links of at most two differing bits, a row's own included.
    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other.
    Repeated rows come out as often as they go in. Null ids take part but name no component; a group of
    only such rows has a null component_id. Other columns are ignored; an empty table gives no rows.
    """
    found = components(materialize(fingerprints(docs, shingle), "simhash"), bucket_limit)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near copies: of each group of ``near_copies.groups`` the row of smallest doc_id stays, all columns as they were.

    Its candidates come from deletion variants of SimHash fingerprints too, of more bits than the query's. Rows are told apart by doc_id and text; of rows equal in both
    one stays. Rows with a null doc_id stay, as nothing names them.
    """
    row = F.xxhash64("doc_id", "text")
    found = materialize(groups(docs.select(F.col("doc_id").cast("long"), row.alias("row"), "text"), shingle, similarity), "groups")
    named = found.where("doc_id is not null")
    kept_rows = materialize(named.groupBy("comp").agg(F.min(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n")).where("n > 1"), "keep")
    own = fresh("drop", docs)
    drop = named.join(kept_rows, "comp").where("row <> keep.row").select(F.col("row").alias(own)).distinct()
    drop = materialize(drop, "drop")
    same = row == F.col(own)
    kept = docs.join(bounded(drop), same & F.col("doc_id").isNotNull(), "left_anti")
    again = named.groupBy(F.col("row").alias(own)).agg(F.count("*").alias("n")).where("n > 1").select(own)
    again = materialize(again.join(drop, own, "left_anti"), "again")
    if again.isEmpty():
        return kept
    again = bounded(again)
    return kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
