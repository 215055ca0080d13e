"""Quality classifier by positive-unlabelled learning.

A small network is trained to minimise the non-negative unbiased risk: trusted positives stand for
label 1; the negatives' risk is that of unlabelled web text less the positives' share of it, and is
not let below zero (when a step would, the step is taken back instead). The share, the class prior, is
estimated from the two sets alone; where labels hold both classes, the share of label 1 among them is its least value.

It is fitted on the driver, on at most about ``train_texts`` positives and as many unlabelled texts,
chosen by a hash of doc_id; features are taken from whole texts, in the tasks, and every text is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, fresh, rows_of, table, utf8

FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digits", "symbols", "exclaims", "pipes", "punctuation", "newlines", "other_bytes",
    "byte_entropy", "variety", "adjacent_repeats", "top_word", "repeated_pairs", "repeated_lines", "line_words", "capital_words", "marked_ends",
)
SYMBOLS = list(b"#*$%&|<>~^_=+{}[]\\")
PUNCTUATION = list(b".,;:?")


def features_of(text: bytes) -> list[float]:
    """``FEATURES`` of a whole UTF-8 text: shares and rates, so that length alone says little; zeros if it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    p = byte[byte > 0] / size
    count = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), (size - n) / n / 10, sum(c for w, c in count.items() if len(w) > 20) / n, upper / max(1, upper + lower),
        int(byte[48:58].sum()) / size, int(byte[SYMBOLS].sum()) / n, int(byte[33]) / n, int(byte[124]) / n, int(byte[PUNCTUATION].sum()) / n,
        len(lines) / n, int(byte[128:].sum()) / size, float(-(p * np.log2(p)).sum()) / 8, float(np.log1p(len(count)) / np.log1p(n)),
        adjacent / n, max(count.values()) / n, sum(c for c in pairs.values() if c > 1) / n,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))) / 5, sum(c for w, c in count.items() if w.isupper()) / n,
        sum(c for w, c in count.items() if w[-1] in b"#*$%&|!") / n,
    ]


def _features(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and ``x`` (array<float>) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 4_000_000):
            x = [features_of(t) for t in utf8(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(k).combine_chunks() for k in keep), pa.array(x, pa.list_(pa.float32()))], names=[*keep, "x"])

    types = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", x array<float>")


class Net:
    """One hidden layer over standardised features; ``score`` is the sigmoid of its output."""

    def __init__(self, weights: list[np.ndarray], mean: np.ndarray, scale: np.ndarray) -> None:
        self.weights, self.mean, self.scale = weights, mean, scale

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        hidden = np.tanh(z @ a + b)
        return hidden, hidden @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.standard(x))[1], -40, 40)))

    def gradient(self, z: np.ndarray, by_output: np.ndarray) -> list[np.ndarray]:
        hidden, _ = self.forward(z)
        back = np.outer(by_output, self.weights[2]) * (1 - hidden * hidden)
        return [z.T @ back, back.sum(0), hidden.T @ by_output, np.asarray([by_output.sum()])]


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of label 1 among the unlabelled, from the two sets alone.

    Whatever a score's upper region holds of the positives, the unlabelled hold that share of their own
    positives too, so the least ratio of the two masses over all upper regions bounds the class prior; the
    bound is tight where negatives are absent. Regions with under nine tenths of the positives are too noisy, and
    one standard error is added, as a least ratio is biased low.
    """
    net = fit(positive, unlabelled, prior=0.5, plain=True)
    p, u = np.sort(net.score(positive)), np.sort(net.score(unlabelled))
    at = p[: max(1, len(p) // 10)]
    in_p, in_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
    return float(np.clip(((in_u + np.sqrt(in_u * (1 - in_u) / len(u))) / in_p).min(), 0.05, 0.98))


def step_gradients(net: Net, zp: np.ndarray, zu: np.ndarray, prior: float, plain: bool = False) -> tuple[float, list[np.ndarray]]:
    """Negatives' risk, and the gradients of a step: of the whole risk or, where that part is below zero, of taking it back.

    Loss of an output s: 1 - s for a positive, s for a negative. ``plain``: unlabelled count as negatives.
    """
    sp, su = (1 / (1 + np.exp(-np.clip(net.forward(z)[1], -40, 40))) for z in (zp, zu))
    slope_p, slope_u = sp * (1 - sp) / len(zp), su * (1 - su) / len(zu)
    if plain:
        negative, by_p, by_u = float(su.mean()), -slope_p, slope_u
    else:
        negative = float(su.mean() - prior * sp.mean())
        by_p, by_u = (-2 * prior * slope_p, slope_u) if negative >= 0 else (prior * slope_p, -slope_u)
    return negative, [a + b for a, b in zip(net.gradient(zp, by_p), net.gradient(zu, by_u), strict=True)]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 8, steps: int = 300, rate: float = 0.02, decay: float = 1.5, plain: bool = False) -> Net:
    """Non-negative risk with the sigmoid loss, by Adam on the whole sets, from a fixed start.

    Weights decay by ``decay`` / positives, 0.01 at most. ``plain``: unlabelled count as negatives.
    """
    decay = min(0.01, decay / len(positive))
    both = np.concatenate((positive, unlabelled))
    rng = np.random.default_rng(7)
    k = both.shape[1]
    net = Net([rng.normal(0, k**-0.5, (k, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)], both.mean(0), both.std(0) + 1e-6)
    zp, zu = net.standard(positive), net.standard(unlabelled)
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    for step in range(1, steps + 1):
        _, grads = step_gradients(net, zp, zu, prior, plain)
        for i, g in enumerate(grads):
            g = g + decay * net.weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            net.weights[i] = net.weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, train_texts: int = 6000) -> Net | None:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), both already without held-out rows.

    Positives are texts of label 1; unlabelled are those that no label row names (all texts where every one is
    labelled). Labels 0 count only in the class prior. Null ids and labels are left out; of contradictory
    labels the largest holds. Without positives there is nothing to learn: None.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = docs.select("doc_id").join(labels, "doc_id", "left")
    counts = {r["quality"]: r["n"] for r in joined.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return None
    free = counts.get(None, 0)
    bits = 1 << 20
    bound = lambda n: int(min(1.0, train_texts / max(1, n)) * bits)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    wanted = joined.where(((F.col("quality") == 1) & (drawn <= bound(counts[1]))) | ((F.col("quality").isNull() if free else F.lit(True)) & (drawn <= bound(free or sum(counts.values())))))
    wanted = wanted.distinct()
    # The drawn ids number about twice train_texts, whatever the input.
    rows = _features(docs.join(F.broadcast(wanted), "doc_id"), ("doc_id", "quality")).orderBy("doc_id").collect()
    x = np.asarray([r["x"] for r in rows], float)
    label = np.asarray([-1 if r["quality"] is None else r["quality"] for r in rows])
    positive, unlabelled = x[label == 1], x[label == -1] if free else x
    if not len(positive) or not len(unlabelled):
        return None
    prior = estimated_prior(positive, unlabelled)
    if counts.get(0):
        prior = max(prior, counts[1] / (counts[0] + counts[1]))
    return fit(positive, unlabelled, min(prior, 0.98))


def score(docs: DataFrame, net: Net | None, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and ``name``, the score (0 to 1) for each row of ``docs``; 0.5 for all without a model.

    Null and empty texts are scored on zero features; repeated rows alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 4_000_000):
            x = np.asarray([features_of(t) for t in utf8(part.column("text"))], float)
            s = net.score(x) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(part.column(k).combine_chunks() for k in keep), pa.array(s, pa.float64())], names=[*keep, name])

    types = dict(docs.dtypes)
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + f", `{name}` double")


def learned(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Net | None:
    """The model of the production query: labels and texts of rows whose crc32 remainder isn't 1."""
    known = F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))
    return train(docs.where(known), table(spark, sf_dir, "labels").where(known))


def reject(docs: DataFrame, net: Net | None, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, all columns as they were."""
    names = docs.columns
    own = fresh("score", docs)
    return score(docs, net, tuple(names), own).where(F.col(own) >= threshold).select(*names)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    scored = score(docs, learned(spark, sf_dir, docs))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
