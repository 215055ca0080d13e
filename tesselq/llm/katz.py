"""Language-model scoring: a word bigram model with Katz backoff.

Counts are discounted by Good-Turing up to ``CUTOFF`` (Katz's form); what a history loses goes to the
words not seen after it, in proportion to their discounted unigram probability, so that the backoff
weight normalises exactly. A word seen nowhere in training is one unknown event, which holds the mass
that the unigrams lose. A token is evaluated recursively: bigram if seen, else weight times unigram.

The tables are partitioned by the hash of the history and never stand on one machine. Tasks cut the
corpus into batches of about ``batch_bytes``; a batch sends each partition the distinct n-grams that it
needs, with its own training counts, as one sorted array, and gets totals back in the same order. So the
rows that move are arrays, their total is linear in the corpus, and what Spark sorts are batch and
partition numbers. A frequent history (over a 512th of all tokens: so at most 512 of them, and the start
of a text) is dealt over all partitions by the following word, and its sums are added up by each batch.
Words are told apart by 64-bit hashes, and have short names once they are counted.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, rows_of, table, utf8

CUTOFF, HOT_SHARE = 5, 512
SEED = 42
#: Not words: no word holds white space.
START, END = b"\n<", b"\n>"
ROWS = "kind int, batch long, part int, payload binary"
STATE, UNIGRAMS, BIGRAMS, TOTALS, FOLLOWERS, COUNTS = range(6)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed; bytes of equal weight stand together."""
    parts = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), len(a)) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, 5))


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for dtype, raw, n in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):  # noqa: S301
        width = np.dtype(dtype).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).reshape(n))
    return out


def batch_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, batch, part, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "batch": pa.array(batch, pa.int64()), "part": pa.array(part, pa.int32()), "payload": pa.array(payload, pa.binary())})


def grouped(df: DataFrame, key: str, fn: Callable[[int, list[tuple[int, int, int, bytes]]], list[tuple[int, int, int, bytes]]]) -> DataFrame:
    """``fn`` of each ``key`` and its rows, by kind, batch and part; a task holds one group at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("kind", "batch", "part", "payload")), strict=True)

    at = {"batch": 1, "part": 2}[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, group in groupby(rows(batches), key=lambda r: r[at]):
            for out in fn(k, list(group)):
                yield batch_of([out])

    return df.select("kind", "batch", "part", "payload").repartition(key).sortWithinPartitions(key, "kind", "batch", "part").mapInArrow(run, ROWS)


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0 to CUTOFF (0: unused), from n[r], how many have count r, up to CUTOFF + 1.

    Where the counts of counts allow no factor in (0, 1), as in small or odd corpora, half a count is taken.
    """
    d = np.ones(CUTOFF + 1)
    last = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        good = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        d[r] = (good - last) / (1 - last) if last < 1 else 0.0
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


class Unigrams:
    """Discounted unigram probabilities from totals: tokens, words, and how many words have each small count."""

    def __init__(self, tokens: int, words: int, n: np.ndarray) -> None:
        self.tokens, self.words, self.d = tokens, words, discounts(n)
        lost = sum((1 - self.d[r]) * r * n[r] for r in range(1, CUTOFF + 1))
        # Without a rare word nothing is lost: the unknown event then counts as one more token.
        self.scale, self.unknown = (1.0, lost / tokens) if lost > 0 else (tokens / (tokens + 1), 1 / (tokens + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.d[np.where(c <= CUTOFF, c, 0)] * c / max(1, self.tokens), self.unknown)


def tokenise(docs: DataFrame, parts: int, batch_bytes: int, learns: Callable[[int | None], bool]) -> DataFrame:
    """A STATE row for each batch, and its UNIGRAMS rows for the partitions."""
    shift = 64 - (parts.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for number, part in enumerate(rows_of(batches, batch_bytes)):
            code: defaultdict[bytes, int] = defaultdict(count().__next__)
            start, end = code[START], code[END]
            codes: list[int] = []
            sizes = []
            for text in utf8(part.column("text")):
                words = text.lower().split()
                codes += map(code.__getitem__, words)
                codes.append(end)
                sizes.append(len(words) + 1)
            hashes = np.asarray([xxhash.xxh64_intdigest(w, SEED) for w in code], np.uint64)
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            hashes, token, size = hashes[order], rank[np.asarray(codes)], np.asarray(sizes, np.int32)
            keys = part.column("doc_id").to_pylist()
            known = np.asarray([learns(k) for k in keys])
            train = np.bincount(token[np.repeat(known, size)], minlength=len(hashes)).astype(np.uint32)
            ids = np.asarray([0 if k is None else k for k in keys], np.int64)
            state = pack(ids, np.asarray([k is None for k in keys]), known, size, token, np.asarray([rank[start]], np.int32))
            cut = np.searchsorted((hashes >> np.uint64(shift)) if shift < 64 else np.zeros(len(hashes), np.uint64), np.arange(parts + 1, dtype=np.uint64))
            yield batch_of([(STATE, base + number, -1, state)])
            for p in range(parts):
                yield batch_of([(UNIGRAMS, base + number, p, pack(hashes[cut[p] : cut[p + 1]], train[cut[p] : cut[p + 1]]))])

    return docs.mapInArrow(run, ROWS)


def sum_unigrams(part: int, rows: list[tuple]) -> list[tuple]:
    """Totals and places in the partition's list of words, for each batch in its own order; and the partition's counts of counts."""
    asked = [unpack(r[3]) for r in rows]
    _, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([a[1] for a in asked])).astype(np.int64)
    cuts = np.cumsum([0, *(len(a[0]) for a in asked)])
    out = [(TOTALS, r[1], part, pack(total[inverse[x:y]], inverse[x:y].astype(np.uint32))) for r, x, y in zip(rows, cuts, cuts[1:], strict=False)]
    small = np.bincount(total[total <= CUTOFF + 1], minlength=CUTOFF + 2)
    return [*out, (COUNTS, -1, part, pack(np.asarray([total.sum(), (total > 0).sum(), *small], np.int64)))]


def sums(df: DataFrame) -> np.ndarray:
    """The COUNTS rows added up: a few numbers a partition, added in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack(x)[0] for b in batches for x in b.column("payload").to_pylist()]
        if found:
            total = np.sum(found, axis=0)
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "n": pa.array(total, pa.int64())})

    rows = df.where(F.col("kind") == COUNTS).mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 + CUTOFF + 2, np.int64)
    for r in rows:
        out[r["i"]] = r["n"]
    return out


class Bigrams:
    """A batch's distinct bigrams, by partition, history and word; and its runs of one history in one partition.

    ``rows`` are the batch's STATE row and its unigram TOTALS. A frequent history has a run in every partition.
    """

    def __init__(self, rows: list[tuple], parts: int, uni: Unigrams) -> None:
        self.ids, self.null, self.known, self.size, token, start = unpack(rows[0][3])
        got = [unpack(r[3]) for r in rows[1:]]
        self.total = np.concatenate([g[0] for g in got])
        place = np.repeat([r[2] for r in rows[1:]], [len(g[0]) for g in got])
        # Short names: a word's partition, and its place there.
        self.name = (place.astype(np.uint64) << np.uint64(40)) | np.concatenate([g[1] for g in got])
        self.first = np.cumsum(self.size) - self.size
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first] = start[0]
        u = self.words = len(self.total)
        self.hot = self.total * HOT_SHARE > uni.tokens
        self.hot[start[0]] = True
        part = np.where(self.hot[before], place[token], place[before])
        key, self.which = np.unique((part * u + before) * u + token, return_inverse=True)
        self.token, self.word = token, key % u
        run_of = key // u
        runs = np.unique(np.concatenate((run_of, (np.arange(parts)[:, None] * u + np.flatnonzero(self.hot)).ravel())))
        self.length = np.bincount(np.searchsorted(runs, run_of), minlength=len(runs)).astype(np.uint32)
        self.history = runs % u
        self.run_cut = np.searchsorted(runs // u, np.arange(parts + 1))
        self.key_cut = np.concatenate(([0], np.cumsum(self.length, dtype=np.int64)))[self.run_cut]


def ask_bigrams(parts: int, uni: Unigrams) -> Callable:
    """Of a batch: its BIGRAMS rows for the partitions."""

    def fn(batch: int, rows: list[tuple]) -> list[tuple]:
        b = Bigrams(rows, parts, uni)
        train = np.bincount(b.which[np.repeat(b.known, b.size)], minlength=len(b.word)).astype(np.uint32)
        out = []
        for p in range(parts):
            r, k = slice(b.run_cut[p], b.run_cut[p + 1]), slice(b.key_cut[p], b.key_cut[p + 1])
            words, at = np.unique(b.word[k], return_inverse=True)
            out.append((BIGRAMS, batch, p, pack(b.name[b.history[r]], b.length[r], b.name[words], b.total[words], at.astype(np.uint32), train[k])))
        return out

    return fn


def sum_bigrams(uni: Unigrams) -> Callable:
    """Totals for each batch in its own order, with sums by history; and the partition's counts of counts.

    Sums by history: how many following words have count 1 ... CUTOFF, occurrences in all and in greater
    counts, and the unigram probability of the words seen.
    """

    def fn(part: int, rows: list[tuple]) -> list[tuple]:
        asked = [unpack(r[3]) for r in rows]
        run_history = np.concatenate([a[0] for a in asked])
        histories, run_at = np.unique(run_history, return_inverse=True)
        history = np.repeat(run_at, np.concatenate([a[1] for a in asked]))
        words, word = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
        of_word = np.zeros(len(words), np.int64)
        of_word[word] = np.concatenate([a[3] for a in asked])
        word_cut = np.cumsum([0, *(len(a[2]) for a in asked)])
        word = np.concatenate([word[x:y][a[4]] for a, x, y in zip(asked, word_cut, word_cut[1:], strict=False)])
        key, inverse = np.unique(history * len(words) + word, return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate([a[5] for a in asked]), minlength=len(key)).astype(np.int64)
        h, w = key // max(1, len(words)), key % max(1, len(words))
        n = len(histories)
        small = np.stack([np.bincount(h[c == r], minlength=n) for r in range(1, CUTOFF + 1)], 1).astype(np.uint32)
        total = np.bincount(h, weights=c, minlength=n).astype(np.int64)
        big = np.bincount(h, weights=np.where(c > CUTOFF, c, 0), minlength=n).astype(np.int64)
        mass = np.bincount(h[c > 0], weights=uni.p(of_word[w[c > 0]]), minlength=n)
        key_cut = np.cumsum([0, *(len(a[4]) for a in asked)])
        run_cut = np.cumsum([0, *(len(a[0]) for a in asked)])
        out = []
        for i, r in enumerate(rows):
            at = run_at[run_cut[i] : run_cut[i + 1]]
            out.append((FOLLOWERS, r[1], part, pack(c[inverse[key_cut[i] : key_cut[i + 1]]], *(small[at, k] for k in range(CUTOFF)), total[at], big[at], mass[at])))
        counts = np.bincount(c[c <= CUTOFF + 1], minlength=CUTOFF + 2)
        return [*out, (COUNTS, -1, part, pack(np.asarray([c.sum(), (c > 0).sum(), *counts], np.int64)))]

    return fn


def weights(small: np.ndarray, total: np.ndarray, big: np.ndarray, mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of the seen, backoff weight) by history; small[i, r - 1] words of count r follow history i.

    A history whose following words all have counts above CUTOFF loses nothing; one occurrence is then added
    to it for the unseen, so that those stay possible.
    """
    kept = big + (small * (d[1:] * np.arange(1, CUTOFF + 1))).sum(1)
    seen = np.maximum(total, 1)
    free = kept >= total * (1 - 1e-12)
    scale = np.where(free, total / (total + 1), 1.0)
    left = np.where(free, 1 / (total + 1), 1 - kept / seen)
    return scale, np.where(total > 0, left / np.maximum(1 - mass, 1e-12), 1.0)


def score_batch(parts: int, uni: Unigrams, d: np.ndarray) -> Callable:
    """Of a batch, with its unigram TOTALS and FOLLOWERS: one row with the scores of its texts."""

    def fn(batch: int, rows: list[tuple]) -> list[tuple]:
        b = Bigrams([r for r in rows if r[0] != FOLLOWERS], parts, uni)
        c, *found = (np.concatenate(x) for x in zip(*(unpack(r[3]) for r in rows if r[0] == FOLLOWERS), strict=True))
        # A frequent history's sums come from every partition.
        found = [np.bincount(b.history, weights=x, minlength=b.words) for x in found]
        small, (total, big, mass) = np.stack(found[:CUTOFF], 1), found[CUTOFF:]
        scale, backoff = weights(small, total, big, mass, d)
        before = np.repeat(b.history, b.length)
        seen = scale[before] * d[np.where(c <= CUTOFF, c, 0)] * c / np.maximum(total[before], 1)
        p = np.log10(np.where(c > 0, seen, backoff[before] * uni.p(b.total[b.word])))
        known = b.total[b.token]
        base = np.log10((known + 1) / (uni.tokens + uni.words + 1))
        sums_ = (np.add.reduceat(x, b.first) for x in ((known > 0).astype(np.int64), base, p[b.which]))
        return [(STATE, batch, -1, pack(b.ids, b.null, b.size.astype(np.int64), *sums_))]

    return fn


def katz_scores(docs: DataFrame, learns: Callable[[int | None], bool], batch_bytes: int = 6_000_000, part_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs`` (doc_id, text).

    ``learns(doc_id)`` says which rows the model is fitted on; all are scored. Tokens are runs of anything but
    ASCII white space, A-Z lower-cased, then one end; null and empty texts are the end alone. base_score is the
    add-one unigram score, score the model's log10 probability. Repeated rows count, and come out, as often as
    they go in. Without training rows every token is the unknown event. Other columns are ignored; an empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << math.ceil(math.log2(max(1, size / part_bytes)))
    tokens = materialize(tokenise(docs, parts, batch_bytes, learns), "tokens", by="kind")
    unigrams = materialize(grouped(tokens.where(F.col("kind") == UNIGRAMS), "part", sum_unigrams), "unigrams")
    forget(tokens, f"kind={UNIGRAMS}")
    n, words, *small = sums(unigrams).tolist()
    uni = Unigrams(n, words, np.asarray(small))
    state = tokens.where(F.col("kind") == STATE).select(unigrams.columns).union(unigrams.where(F.col("kind") == TOTALS))
    bigrams = materialize(grouped(grouped(state, "batch", ask_bigrams(parts, uni)), "part", sum_bigrams(uni)), "bigrams")
    d = discounts(sums(bigrams)[2:])
    known = state.union(bigrams.where(F.col("kind") == FOLLOWERS))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column("payload").to_pylist():
                ids, null, *values = unpack(payload)
                columns = dict(zip(("n_tokens", "n_known", "base_score", "score"), map(pa.array, values), strict=True))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64(), mask=null)} | columns)

    scored = grouped(known, "batch", score_batch(parts, uni, d)).mapInArrow(flat, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def learns(doc_id: int | None) -> bool:
    """Of the production query: crc32 of the id's text, modulo 7, isn't 2. Null ids aren't learnt from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def op3_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod

    found = katz_scores(table(spark, sf_dir, "documents"), learns)
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
