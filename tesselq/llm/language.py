"""Language of texts: unigram models of vocabulary pieces, summed over all segmentations.

The vocabulary is that of a public SentencePiece file. A word (a run of letters, lower-cased, with the
file's word mark before it) is scored as the total probability of all its segmentations into pieces,
by a forward pass over its characters, scaled as it goes, so that words may be of any length; a text is the
product of its words. Piece probabilities by language come from expected counts over all segmentations
(forward and backward, ``ROUNDS`` times), smoothed.

Training takes about ``train_texts`` labelled texts, or ``LEAST_TEXTS`` of each language where its share is less,
chosen by a hash of doc_id; every text is predicted, whole, from its letters alone.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, rows_of, table

UNKNOWN = "und"
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of a word that training takes at once (longer ones in parts; scoring never cuts), rounds, and texts of each language at least.
TRAIN_LETTERS, ROUNDS, LEAST_TEXTS = 40, 2, 300
#: Words of more letters are scored one by one, the others many at a time; both give the same.
ALONE = 200
#: Positions between two scalings, which keep sums of products in the range of doubles.
SCALE_EVERY = 16
#: Words whose scores a worker keeps.
CACHE_WORDS = 400_000
#: Pseudo-count of each piece, and probability of a character outside the vocabulary.
SMOOTH, FLOOR = 0.05, 1e-7


def pieces_of(path: str) -> dict[str, int]:
    """Pieces of a SentencePiece file that words can hold, with their ids: no control or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}


def words_in(text: str) -> Counter:
    """Runs of letters of the lower-cased text, with how often each occurs."""
    return Counter(LETTERS.findall(text.lower()))


class Trie:
    """The pieces, as states: a state and a character give the next state; a state may be a piece."""

    def __init__(self, pieces: list[str]) -> None:
        self.step: dict[tuple[int, str], int] = {}
        at = []
        for piece in pieces:
            state = 0
            for c in piece:
                state = self.step.setdefault((state, c), len(self.step) + 1)
            at.append(state)
        keys = np.asarray([(s << 21) | ord(c) for s, c in self.step], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.asarray(list(self.step.values()), np.int64)[order]
        #: The piece of each state, or -1.
        self.piece = np.full(len(self.step) + 1, -1)
        self.piece[at] = np.arange(len(pieces))
        self.longest = max(map(len, pieces), default=1)

    def codes(self, words: list[str], longest: int) -> np.ndarray:
        return np.frombuffer("".join(w.ljust(longest, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, longest).astype(np.int64)

    def edges(self, codes: np.ndarray, sizes: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, piece) of the pieces that begin at ``start``; piece -1: a character that is none."""
        alive = np.flatnonzero(sizes > start)
        state = np.zeros(len(alive), np.int64)
        for end in range(start + 1, codes.shape[1] + 1):
            key = (state << 21) | codes[alive, end - 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[found] == key) & (sizes[alive] >= end)
            state = self.next[found]
            if end == start + 1:  # every character may stand alone
                alone = alive[~(ok & (self.piece[state] >= 0))]
                if len(alone):
                    yield end, alone, np.full(len(alone), -1)
            alive, state = alive[ok], state[ok]
            if not len(alive):
                break
            whole = self.piece[state] >= 0
            if whole.any():
                yield end, alive[whole], self.piece[state[whole]]


def by_size(words: list[str], cells: int = 400_000) -> Iterator[np.ndarray]:
    """Indices of ``words`` in batches of like length, of about ``cells`` characters."""
    sizes = np.asarray([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and n < 8192 and (n + 1) * int(sizes[order[at + n]]) <= cells:
            n += 1
        yield order[at : at + n]
        at += n


def expected_counts(trie: Trie, p: np.ndarray, words: list[str], n: np.ndarray) -> np.ndarray:
    """Occurrences of each piece, expected over all segmentations of ``words`` (which occur ``n`` times) under the probabilities ``p``."""
    out = np.zeros(len(p))
    p = np.append(p, FLOOR)  # piece -1
    for rows in by_size(words):
        marked = [words[i] for i in rows]
        sizes = np.asarray([len(w) for w in marked])
        codes = trie.codes(marked, int(sizes.max()))
        forward, backward = np.zeros((2, codes.shape[1] + 1, len(rows)))
        forward[0] = 1
        edges = []
        for start in range(codes.shape[1]):
            for end, own, piece in trie.edges(codes, sizes, start):
                forward[end, own] += forward[start, own] * p[piece]
                edges.append((start, end, own, piece))
        at = np.arange(len(rows))
        backward[sizes, at] = 1
        times = n[rows] / forward[sizes, at]
        for start, end, own, piece in reversed(edges):
            through = p[piece] * backward[end, own]
            backward[start, own] += through
            own_piece = piece >= 0
            out += np.bincount(piece[own_piece], (forward[start, own] * through * times[own])[own_piece], len(out))
    return out


class Model:
    """Piece probabilities by language, and the forward pass."""

    def __init__(self, langs: list[str], priors: list[float], table: dict[str, tuple[float, ...]]) -> None:
        self.langs, self.priors, self.table = langs, np.log(priors), table
        self.trie = Trie(list(table))
        self.p = np.asarray([*table.values(), (FLOOR,) * len(langs)]).reshape(len(table) + 1, len(langs))
        self.row: dict[str, int] = {}
        self.matrix = np.zeros((0, len(langs)))

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word by language, over all its segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        marked = [MARK + w for w in words]
        for rows in by_size(marked):
            own = [marked[i] for i in rows]
            out[rows] = self._score(own) if len(own[-1]) <= ALONE else [self._score_alone(w) for w in own]
        return out

    def _score(self, words: list[str]) -> np.ndarray:
        sizes = np.asarray([len(w) for w in words])
        codes = self.trie.codes(words, int(sizes.max()))
        # Sums that end at a place, for as many places as a piece can reach.
        ring = self.trie.longest + 1
        forward = np.zeros((ring, len(words), len(self.langs)))
        forward[0] = 1
        logs, out = np.zeros((2, len(words), len(self.langs)))
        for start in range(codes.shape[1] + 1):
            here = forward[start % ring]
            done = sizes == start
            out[done] = np.log(here[done]) + logs[done]
            if start % SCALE_EVERY == 0 and start:
                scale = np.where((sizes > start)[:, None], here, 1)
                forward /= scale
                logs += np.log(scale)
            for end, own, piece in self.trie.edges(codes, sizes, start):
                forward[end % ring, own] += here[own] * self.p[piece]
            here[:] = 0
        return out

    def _score_alone(self, word: str) -> np.ndarray:
        step, piece, p, size = self.trie.step, self.trie.piece, self.p, len(word)
        ring = self.trie.longest + 1
        forward = np.zeros((ring, len(self.langs)))
        forward[0] = 1
        logs = np.zeros(len(self.langs))
        for start in range(size):
            here = forward[start % ring].copy()
            if start % SCALE_EVERY == 0:
                forward /= here
                logs += np.log(here)
                here = np.ones(len(self.langs))
            forward[start % ring] = 0
            state = step.get((0, word[start]), 0)
            if not state or piece[state] < 0:
                forward[(start + 1) % ring] += here * FLOOR
            end = start + 1
            while state:
                if piece[state] >= 0:
                    forward[end % ring] += here * p[piece[state]]
                state = step.get((state, word[end]), 0) if end < size else 0
                end += 1
        return np.log(forward[size % ring]) + logs

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts = [words_in(t) if t and self.langs else Counter() for t in texts]
        distinct = set().union(*counts)
        new = list(distinct - self.row.keys())
        if len(self.row) + len(new) > CACHE_WORDS:
            self.row, self.matrix, new = {}, self.matrix[:0], list(distinct)
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.matrix = np.concatenate((self.matrix, self.score(new)))
        out = []
        for count in counts:
            if not count:
                out.append((UNKNOWN, 0.0))
                continue
            rows = np.fromiter(map(self.row.__getitem__, count), np.int64, len(count))
            total = np.fromiter(count.values(), float, len(count)) @ self.matrix[rows] + self.priors
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def train(labelled: DataFrame, vocabulary_path: str, train_texts: int = 6000) -> Model:
    """Fit on ``labelled`` (doc_id, text, lang); null langs and texts are left out. No texts: a model without languages.

    Counts are gathered by piece and language, so what reaches the driver is bounded by vocabulary times languages.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    shares = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, total = sorted(shares), sum(shares.values())
    if not langs:
        return Model([], [], {})
    spark = labelled.sparkSession
    drawn = [(x, int(min(1.0, max(train_texts / total, LEAST_TEXTS / shares[x])) * (1 << 20)) + 1) for x in langs]
    bound = F.broadcast(spark.createDataFrame(drawn, "lang string, _bound long"))
    sample = materialize(labelled.join(bound, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("_bound")).select("text", "lang"), "sample")
    pieces = list(pieces_of(vocabulary_path))
    p = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, counts = Trie(pieces), {}
            for part in rows_of(batches, 4_000_000):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    own = counts.setdefault(lang, Counter())
                    for word, n in words_in(text).items():
                        marked = MARK + word
                        for i in range(0, len(marked), TRAIN_LETTERS):
                            own[marked[i : i + TRAIN_LETTERS]] += n
            for lang, own in counts.items():
                n = expected_counts(trie, shared.value[:, langs.index(lang)], list(own), np.asarray(list(own.values()), float))
                ids = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(ids), pa.string()), "piece": pa.array(ids, pa.int32()), "n": pa.array(n[ids], pa.float64())})

        counted = sample.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        n = np.full(p.shape, SMOOTH)
        column = np.asarray([langs.index(x) for x in counted.column("lang").to_pylist()], np.int64)
        n[counted.column("piece").to_numpy(), column] += counted.column("n").to_numpy()
        p = n / n.sum(axis=0)
        shared.unpersist()
    # Sums of doubles depend on their order, so a probability is rounded: the same model on every run.
    return Model(langs, [shares[x] / total for x in langs], {piece: tuple(float(f"{x:.9e}") for x in row) for piece, row in zip(pieces, p.tolist(), strict=True)})


#: The models that this worker process has built, with their scores of words, by name; one at a time.
_BUILT: dict[str, Model] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """lang_pred and score (posterior of that language, 0 to 1) for each row of ``docs`` (doc_id, text); other columns are ignored.

    Null texts and texts without a letter are ``und`` with score 0, as is everything under a model without
    languages. Ties go to the first language in order. Repeated rows are predicted alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.langs, np.exp(model.priors).tolist(), model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, *parts = shared.value
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Model(*parts)
        own = _BUILT[name]
        for part in rows_of(batches, 4_000_000):
            found = own.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").combine_chunks(), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
