"""Near copies: groups of texts linked by a Jaccard similarity of their shingle sets of at least 0.8.

Candidates come from SimHash: a fingerprint of ``SEGMENTS`` segments of ``SEGMENT_BITS`` bits, as 64 bits can't tell
similarity 0.8 from none at all. Each segment is indexed under its deletion variants: one bit deleted, of the
``DELETED`` bits nearest to a tie, which are those that an edit turns. Two texts are candidates if a variant of
one equals one of the other and their first 256 bits differ in at most ``APART``. Of two texts of similarity 0.8
a bit differs with probability 0.15, they meet in a segment with 0.25, and three in a million such pairs meet
in none; fewer of closer ones. Shingles have weights between -1 and 1 for each bit, so that this holds for
sets of few shingles too. Every link is verified on the whole shingle sets. Texts of equal shingle sets are
one node, so exact copies never meet in pairs.

A bucket is worked off in rounds. In each, some of its nodes are held against all others of the bucket
that they aren't yet linked with, and leave it; it is done when its nodes are one group. A large group of
near copies so takes few comparisons, and none that could link two groups is left out. The buckets of a few
segments come first, which link most of what there is to link; the others go on with as many comparisons a
round as these came to, as nearly all that they hold apart has to be compared. A node has one row for each unit of
buckets (see ``routes``), not for each bucket, and its partners in a unit are one list. Its set goes once to each
part of the stored sets that holds some of its partners, with the list of them; pairs are never rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, rows_of, utf8
from .components import connected

SEGMENTS, SEGMENT_BITS, DELETED = 44, 16, 8
#: Segments that are indexed at a time; the first few link most.
PORTIONS = ((0, 4), (4, 24), (24, 44))
#: Bits of 256 in which candidates may differ: two texts of similarity 0.8 differ by 39 with deviation 5.7, unlike ones by 128 with 8.
APART, CHECKS = 68, ("c0", "c1", "c2", "c3")
#: Buckets up to this size are compared whole at once; of larger ones PIVOTS ** round nodes are taken.
BUCKET, PIVOTS = 16, 8
#: Pairs that a task holds before it passes them on.
LISTED = 200_000
#: Shingle hashes in one part of the stored sets.
PART_HASHES = 2_000_000
#: An odd factor for each eight bits of the fingerprint, and an odd constant that mixes whole hashes.
FACTORS = np.random.default_rng(20240607).integers(0, 2**63, SEGMENTS * SEGMENT_BITS // 8, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Every other byte of a word; so many bytes add up in 16 bits; hashes worked at a time, to stay in cache.
LANES, LANE_MAX, BLOCK = np.uint64(0x00FF00FF00FF00FF), 257, 32_768
CACHE_WORDS = 300_000


class WordHashes(dict):
    """64-bit hash of each word, remembered for at most ``CACHE_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word, 42)
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out


def shingle_set(text: bytes, shingle: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.asarray([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - shingle + 1
    out = hashes[:n].copy()
    for k in range(1, shingle):
        out ^= out >> np.uint64(29)
        out *= MIX
        out += hashes[k : k + n]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each of ``sets``, none of which is empty, and the bits of each segment to delete, both as rows of longs.

    A shingle's weight for a bit is a byte of its hash, moved to be 0 on average; the bit is set if the weights add up to more than 0.
    """
    hashes = np.concatenate(sets)
    sizes = np.asarray([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    cuts = np.concatenate([np.arange(a, b, LANE_MAX) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    sums = np.empty((len(cuts), 8 * len(FACTORS)), np.uint16)
    at = 0
    while at < len(cuts):
        stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK)))
        some = hashes[cuts[at] : cuts[stop] if stop < len(cuts) else len(hashes)]
        local = cuts[at:stop] - cuts[at]
        x, y = np.empty_like(some), np.empty_like(some)
        for w, factor in enumerate(FACTORS):
            np.multiply(some, factor, out=x)
            x ^= np.right_shift(x, np.uint64(32), out=y)
            x *= MIX
            for odd in range(2):
                np.right_shift(x, np.uint64(8 * odd), out=y)
                y &= LANES
                sums[at:stop, 8 * w + odd : 8 * w + 8 : 2] = np.add.reduceat(y, local).astype("<u8").view("<u2").reshape(-1, 4)
        at = stop
    total = 2 * np.add.reduceat(sums, np.searchsorted(cuts, starts), axis=0, dtype=np.int64) - 255 * sizes[:, None]
    tied = np.argpartition(np.abs(total).reshape(len(sets), SEGMENTS, SEGMENT_BITS), DELETED - 1, axis=2)[:, :, :DELETED]
    low = np.zeros((len(sets), SEGMENTS, SEGMENT_BITS), bool)
    np.put_along_axis(low, tied, True, axis=2)
    return tuple(np.packbits(x.reshape(total.shape), axis=1, bitorder="little").view("<i8") for x in (total > 0, low))


def routes(bits: np.ndarray, low: np.ndarray, first: int, last: int) -> np.ndarray:
    """Where the variants of segments ``first`` to ``last`` are: two numbers a segment, in a row for each row of ``sketches``.

    A bit deleted from one half of a segment leaves the other half whole, so that all equal variants are in one unit: that of
    segment, whole half and its bits. A number is the unit, the bits of the half to delete from, and which bits those are.
    """
    own, low = (np.ascontiguousarray(x).view(np.uint8)[:, 2 * first : 2 * last].astype(np.int64) for x in (bits, low))
    unit = np.arange(2 * first, 2 * last) << 8 | own
    other, low = (x.reshape(len(x), -1, 2)[:, :, ::-1].reshape(x.shape) for x in (own, low))
    return unit << 16 | other << 8 | low


def variants(route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the deletion variants at ``route``, in order, and the index of each one's route; a key holds unit, place and the other bits."""
    row, place = np.nonzero(route[:, None] >> np.arange(8) & 1)
    of = route[row]
    key = of >> 16 << 11 | place << 8 | (of >> 8 & 255 & ~(1 << place))
    order = np.argsort(key, kind="stable")
    return key[order], row[order]


def apart(checks: list[np.ndarray], a: np.ndarray | slice, b: np.ndarray | int) -> np.ndarray:
    """Differing bits of the first 256, of rows ``a`` and ``b`` of their longs ``checks``."""
    return sum(np.bitwise_count((c[a] ^ c[b]).view(np.uint64)).astype(np.int64) for c in checks)


def nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, node, size, bits, low) for each row of ``docs`` (doc_id, row, text): ``node`` stands for the shingle set, of ``size`` hashes.

    ``bits`` and ``low`` are those of ``sketches``, empty for a text without shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in rows_of(batches, 1_000_000):
            sets = [shingle_set(t, shingle, known) for t in utf8(part.column("text"))]
            full = [i for i, s in enumerate(sets) if len(s)]
            bits: list = [[] for _ in sets]
            low: list = [[] for _ in sets]
            if full:
                for i, x, y in zip(full, *sketches([sets[i] for i in full]), strict=True):
                    bits[i], low[i] = x, y
            node = np.asarray([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").combine_chunks(), "row": part.column("row").combine_chunks(), "node": pa.array(node),
                "size": pa.array([len(s) for s in sets], pa.int32()), "bits": pa.array(bits, pa.list_(pa.int64())), "low": pa.array(low, pa.list_(pa.int64())),
            })

    return docs.mapInArrow(run, "doc_id long, row long, node long, size int, bits array<long>, low array<long>")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) for each row of ``docs`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in rows_of(batches, 1_000_000):
            sets = [np.sort(shingle_set(t, shingle, known).view(np.int64)) for t in utf8(part.column("text"))]
            yield pa.RecordBatch.from_pydict({"node": part.column("node").combine_chunks(), "hashes": pa.array(sets, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "node long, hashes array<long>")


COLUMNS = ("route", "node", "size", "comp", *CHECKS)
TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), *(pa.int64() for _ in CHECKS))
#: Bits of a route after its unit, and of a set's size behind it.
ROUTE_BITS, SIZE_BITS = 16, 32
CHECK_SCHEMA = ", ".join(f"{c} long" for c in CHECKS)


def _buckets(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = COLUMNS, shift: int = 0) -> Iterator[list[np.ndarray]]:
    """``columns`` of rows sorted by the first, cut so that no key is in two of them; the key is the first without its last ``shift`` bits.

    With a shift those bits follow as one column more.
    """
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(c).to_numpy() for c in columns]
        if shift:
            now = [now[0] >> shift, *now[1:], now[0] & ((1 << shift) - 1)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        if cut or (held and held[0][0][0] != now[0][0]):
            first = int(np.searchsorted(now[0], held[0][0][0], "right")) if held else 0
            whole = held + [[c[:first] for c in now]]
            if cut > first:
                yield [np.concatenate(c) for c in zip(*whole, [c[first:cut] for c in now], strict=True)]
            else:
                yield [np.concatenate(c) for c in zip(*whole, strict=True)]
            held = [[c[max(cut, first) :] for c in now]]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _round(number: int, parts: int, least: float):
    """mapInArrow function over rows sorted by route: lists of partners (a, part, bs), and the rows of buckets not done.

    All buckets of a unit are worked together: of a pair that meets in several of them one is listed, a node's partners there are
    one list a part, and its row is one, whose route has the places of the buckets not done.
    """

    def lists(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Of pairs, without repeats, a row for each run of equal (a, part)."""
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        part = (b % parts).astype(np.int32)
        order = np.lexsort((b, part, a))
        a, b, part = a[order], b[order], part[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b, part = a[new], b[new], part[new]
        begins = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (part[1:] != part[:-1]))))
        bs = pa.ListArray.from_arrays(pa.array(np.append(begins, len(b)).astype(np.int32)), pa.array(b))
        n = len(begins)
        none = [pa.nulls(n, t) for t in TYPES]
        return pa.RecordBatch.from_arrays([*none, pa.array(a[begins]), pa.array(part[begins]), bs], names=[*COLUMNS, "a", "part", "bs"])

    def rest(rows: list[np.ndarray]) -> pa.RecordBatch:
        n = len(rows[0])
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows), *none], names=[*COLUMNS, "a", "part", "bs"])

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes that allow the similarity."""
        return np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, node, size, comp, *check, tail in _buckets(batches, COLUMNS, ROUTE_BITS):
            key, row = variants(unit << ROUTE_BITS | tail)
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.diff(np.append(begins, len(key)))
            pairs, listed = [], 0
            cold = np.repeat(n <= BUCKET, n)
            k = key[cold]
            v, s, c, *own = (z[row[cold]] for z in (node, size, comp, *check))
            for step in range(1, min(BUCKET, len(k))):
                at = np.flatnonzero(k[step:] == k[:-step])
                if not len(at):
                    break
                at = at[(c[at] != c[at + step]) & near(s[at], s[at + step])]
                at = at[apart(own, at, at + step) <= APART]
                if len(at):
                    pairs.append((np.minimum(v[at], v[at + step]), np.maximum(v[at], v[at + step])))
                    listed += len(at)
            places = np.zeros(len(unit), np.int64)
            for i in np.flatnonzero(n > BUCKET):
                at = row[begins[i] : begins[i] + n[i]]
                v, s, c, *own = (z[at] for z in (node, size, comp, *check))
                _, group, count = np.unique(c, return_inverse=True, return_counts=True)
                if len(count) == 1:
                    continue
                order = np.lexsort((v, count[group]))  # nodes of small groups first, the same ones in every bucket if groups are of one size
                for j, p in enumerate(order[: PIVOTS**number]):
                    others = order[j + 1 :]
                    others = others[(c[others] != c[p]) & near(s[others], s[p])]
                    others = others[apart(own, others, p) <= APART]
                    if len(others):
                        pairs.append((np.full(len(others), v[p]), v[others]))
                        listed += len(others)
                    if listed >= LISTED:
                        yield lists(pairs)
                        pairs, listed = [], 0
                left = order[PIVOTS**number :]
                if len(left) and (c[left] != c[left[0]]).any():
                    places[at[left]] |= 1 << (key[begins[i]] >> 8 & 7)
            if pairs:
                yield lists(pairs)
            on = places > 0
            if on.any():
                yield rest([(unit << ROUTE_BITS | tail & ~255 | places)[on], *(z[on] for z in (node, size, comp, *check))])

    return run


def _verify(least: float):
    """mapInArrow function over rows sorted by part, in each the own sets (``bs`` null) before the lists: pairs (a, b) similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = None, {}
        for batch in batches:
            where, node = batch.column("part").to_pylist(), batch.column("node").to_pylist()
            hashes, bs = batch.column("hashes"), batch.column("bs")
            a, b = [], []
            for i in range(batch.num_rows):
                if where[i] != part:
                    part, own = where[i], {}
                values = hashes[i].values.to_numpy()
                if not bs[i].is_valid:
                    own[node[i]] = values.copy()
                    continue
                partners = bs[i].values.to_numpy()
                for at in range(0, len(partners), 256):
                    some = partners[at : at + 256]
                    sets = [own[x] for x in some.tolist()]
                    n = np.asarray([len(x) for x in sets])
                    both = np.concatenate(sets)
                    hit = values[np.minimum(np.searchsorted(values, both), len(values) - 1)] == both
                    shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
                    ok = some[shared >= least * (n + len(values) - shared) - 1e-9]
                    a.append(np.full(len(ok), node[i]))
                    b.append(ok)
            if a:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _met(unique: DataFrame, first: int, last: int) -> DataFrame:
    """Rows (route, node, size and ``CHECKS``, the first 256 bits) of segments ``first`` to ``last``, each with the places where it has a candidate in its bucket."""
    longs = SEGMENTS * SEGMENT_BITS // 64

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                bits, low = (some.column(c).flatten().to_numpy().reshape(-1, longs) for c in ("bits", "low"))
                packed = (routes(bits, low, first, last) << SIZE_BITS) | some.column("size").to_numpy().astype(np.int64)[:, None]
                n = packed.shape[1]
                yield pa.RecordBatch.from_pydict({"packed": packed.ravel(), "node": np.repeat(some.column("node").to_numpy(), n)} | {c: np.repeat(bits[:, i], n) for i, c in enumerate(CHECKS)})

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, node, *check, tail in _buckets(batches, ("packed", "node", *CHECKS), ROUTE_BITS + SIZE_BITS):
            key, row = variants(unit << ROUTE_BITS | tail >> SIZE_BITS)
            bits = [x[row] for x in check]
            ok = np.zeros(len(key), bool)
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.diff(np.append(begins, len(key)))
            at, step = np.flatnonzero(np.repeat(n <= 8 * BUCKET, n)), 0
            while True:
                step += 1
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]
                if not len(at):
                    break
                hit = at[apart(bits, at, at + step) <= APART]
                ok[hit] = ok[hit + step] = True
            for i in np.flatnonzero(n > 8 * BUCKET):
                # A node known to have a candidate isn't compared itself, so a large group of copies takes few passes.
                found, *own = (z[begins[i] : begins[i] + n[i]] for z in (ok, *bits))
                for p in range(n[i]):
                    if not found[p]:
                        hit = apart(own, slice(None), p) <= APART
                        if np.count_nonzero(hit) > 1:
                            found |= hit
            places = np.bincount(row[ok], 1 << (key[ok] >> 8 & 7), len(unit)).astype(np.int64)
            on = places > 0
            route = unit << ROUTE_BITS | tail >> SIZE_BITS & ~255 | places
            size = (tail & ((1 << SIZE_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"route": route[on], "node": node[on], "size": size[on]} | {c: x[on] for c, x in zip(CHECKS, check, strict=True)})

    rows = unique.mapInArrow(spread, f"packed long, node long, {CHECK_SCHEMA}").repartition(F.shiftright("packed", ROUTE_BITS + SIZE_BITS)).sortWithinPartitions("packed")
    return rows.mapInArrow(crowded, f"route long, node long, size int, {CHECK_SCHEMA}")


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row, comp) for each row of ``docs`` (doc_id, row, text); ``row`` is a hash of a row's id and text.

    Rows have one ``comp`` if a chain of links of at least ``similarity`` leads from one to the other. Null and
    empty texts and those of white space are equal; a text of fewer than ``shingle`` words is like equal ones only.
    """
    all_rows = materialize(nodes(docs, shingle), "nodes")
    unique = materialize(all_rows.where("size > 0").dropDuplicates(["node"]).select("node", "size", "bits", "low"), "unique")
    met = [materialize(_met(unique, *p), "buckets") for p in PORTIONS]
    labels = materialize(functools.reduce(DataFrame.union, [m.select("node") for m in met]).distinct().withColumn("comp", F.col("node")), "labels")
    one = all_rows.join(labels.select("node"), "node").groupBy("node").agg(F.min("row").alias("row"))
    one = materialize(one, "one")
    texts = docs.select("row", "text").join(bounded(one), "row").select("node", "text")
    sets = materialize(sets_of(texts, shingle).dropDuplicates(["node"]), "sets")
    parts = max(1, -(-(sets.agg(F.sum(F.size("hashes"))).first()[0] or 0) // PART_HASHES))
    schema = f"route long, node long, size int, comp long, {CHECK_SCHEMA}"
    number = 0  # goes on over both: what the first few segments leave apart must be compared, and more rounds would only carry it along
    for rows in (met[0], functools.reduce(DataFrame.union, met[1:])):
        left = materialize(rows.join(labels, "node").select(*COLUMNS), "buckets")
        while not left.isEmpty():
            worked = left.repartition(F.shiftright("route", ROUTE_BITS)).sortWithinPartitions("route", "node").mapInArrow(_round(number, parts, similarity), f"{schema}, a long, part int, bs array<long>")
            worked = materialize(worked, "round")
            lists = worked.where("bs is not null").groupBy("a", "part").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs"))
            lists = materialize(lists, "lists")
            sent = lists.join(sets, F.col("a") == F.col("node")).select("part", "node", "hashes", "bs")
            held = sets.join(left.select("node").distinct(), "node", "left_semi").select(F.pmod("node", F.lit(parts)).cast("int").alias("part"), "node", "hashes", F.lit(None).cast("array<long>").alias("bs"))
            linked = held.union(sent).repartition("part").sortWithinPartitions("part", F.col("bs").isNotNull()).mapInArrow(_verify(similarity), "a long, b long")
            linked = materialize(linked, "linked")
            ends = linked.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("_a")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("_b")), "b")
            roots = connected(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).withColumnRenamed("node", "comp")
            labels = materialize(labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
            left = worked.where("bs is null").drop("comp").join(labels, "node").select(*COLUMNS)
            left = materialize(left, "buckets")
            number += 1
    return all_rows.join(labels, "node", "left").select("doc_id", "row", F.coalesce("comp", "node").alias("comp"))
