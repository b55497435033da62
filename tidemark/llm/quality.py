"""Quality classifier: a factorisation machine over hashed words and structure.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
in time linear in the features of a text. Features are hashed words and, as
metadata of the text, binned measures of its structure.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import small_batches

WORD_BITS = 15
BINS = 12
MEASURES = ("words", "word length", "upper", "digits", "symbols", "stops", "lines", "line words", "distinct words", "distinct lines", "commonest", "short words", "tail symbols", "chars")
_UPPER, _DIGIT, _SYMBOL, _TAIL = (regex.compile(p).findall for p in (r"\p{Lu}", r"\d", r"[^\p{L}\p{N}\s.,]", r"[^\p{L}\p{N}\s.,](?=\s|$)"))


def measures(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure of a whole text, one number for each of MEASURES."""
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars, m = max(len(words), 1), max(len(text), 1), max(len(lines), 1)
    return [
        np.log1p(len(words)), chars / n, len(_UPPER(text)) / chars, len(_DIGIT(text)) / chars, len(_SYMBOL(text)) / chars, (text.count(".") + text.count(",")) / n, np.log1p(m), n / m,
        len(counts) / n, len(set(lines)) / m, max(counts.values(), default=0) / n, sum(c for w, c in counts.items() if len(w) <= 2) / n, len(_TAIL(text)) / n, np.log1p(chars),
    ]


class Features:
    """Hashed words of a text (L2-normed logarithmic counts) and its measures; remembers word hashes."""

    def __init__(self, remembered: int = 200_000):
        self.remembered, self.known = remembered, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        if len(self.known) > self.remembered:
            self.known = {}
        known, mask = self.known, (1 << WORD_BITS) - 1
        ids = np.empty(len(counts), np.int64)
        for k, w in enumerate(counts):
            if (h := known.get(w)) is None:
                h = known[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) & mask
            ids[k] = h
        values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        norm = np.sqrt((values**2).sum()) or 1.0
        return ids, values / norm, measures(text, words, counts)


class FactorisationMachine:
    """Weights w0, w and factors v over words and binned measures."""

    def __init__(self, edges: np.ndarray, factors: int = 8, seed: int = 5):
        self.edges = edges  # for each measure its inner bin edges
        self.n = (1 << WORD_BITS) + len(MEASURES) * BINS
        self.w0, self.w = 0.0, np.zeros(self.n)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (self.n, factors))

    def rows(self, found: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices, values and row starts of texts."""
        stats = np.array([f[2] for f in found])
        bins = np.stack([np.searchsorted(self.edges[k], stats[:, k]) for k in range(len(MEASURES))], axis=1)
        bins += (1 << WORD_BITS) + np.arange(len(MEASURES)) * BINS
        scale = np.full(len(MEASURES), 1 / np.sqrt(len(MEASURES)))
        ids = np.concatenate([x for f, b in zip(found, bins) for x in (b, f[0])])
        values = np.concatenate([x for f in found for x in (scale, 0.5 * f[1])])
        starts = np.concatenate([[0], np.cumsum([len(MEASURES) + len(f[0]) for f in found])[:-1]])
        return ids, values, starts

    def raw(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and sum_i v_if x_i of each row."""
        vx = self.v[ids] * values[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx**2).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[ids] * values, starts) + 0.5 * ((s**2).sum(1) - squares), s

    def score(self, found: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(found))[0], -30, 30))) if found else np.zeros(0)

    def fit(self, found: list, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.15, decay: float = 2e-4, seed: int = 11) -> FactorisationMachine:
        """Adagrad over logistic loss."""
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1.0, np.full(self.n, 1e-2), np.full(self.v.shape, 1e-1)
        share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
        self.w0 = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(len(found))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                ids, values, starts = self.rows([found[i] for i in own])
                y, s = self.raw(ids, values, starts)
                d = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[own]) / len(own)
                lengths = np.diff(np.append(starts, len(ids)))
                each = np.repeat(d, lengths) * values
                touched, where = np.unique(ids, return_inverse=True)
                grad_w = np.bincount(where, each, len(touched)) + decay * self.w[touched]
                part = each[:, None] * (np.repeat(s, lengths, axis=0) - self.v[ids] * values[:, None])
                grad_v = np.stack([np.bincount(where, part[:, f], len(touched)) for f in range(part.shape[1])], axis=1) + decay * self.v[touched]
                gw[touched] += grad_w**2
                gv[touched] += grad_v**2
                self.w[touched] -= rate * grad_w / np.sqrt(gw[touched])
                self.v[touched] -= rate * grad_v / np.sqrt(gv[touched])
                g0 += d.sum() ** 2
                self.w0 -= rate * d.sum() / np.sqrt(g0)
        return self


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = 8_000) -> FactorisationMachine | None:
    """Fits on a bounded, documented sample: the ``sample_rows`` labelled ids of smallest hash for which ``usable`` holds.

    A doc_id with two labels that differ is not used, nor is a null one; of
    several texts of one doc_id the least is taken, so no more than
    ``sample_rows`` rows reach the driver. None if no label is left.
    """
    small_batches(spark)
    sure = labels.where(usable & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    picked = sure.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # picked has sample_rows rows at most
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def featurise(batches):
        f = Features()
        for batch in batches:
            found = [f(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.float64())), pa.array([x[2] for x in found], pa.list_(pa.float64()))], names=["doc_id", "quality", "ids", "vals", "stats"])

    got = rows.mapInArrow(featurise, "doc_id long, quality int, ids array<long>, vals array<double>, stats array<double>").toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return None
    found = [(np.asarray(a), np.asarray(b), list(c)) for a, b, c in zip(got["ids"], got["vals"], got["stats"])]
    stats = np.array([f[2] for f in found])
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    return FactorisationMachine(edges).fit(found, got["quality"].to_numpy(float))


def classify(spark: SparkSession, docs: DataFrame, model: FactorisationMachine | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every whole text. A null text scores as an empty one; without a model every score is 0.5."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by WORD_BITS and the factors

    def run(batches):
        f, own = Features(), shared.value
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 128):
                found = [f(t.as_py()) for t in batch.column(1).slice(at, 128)]
                scores.append(own.score(found) if own is not None else np.full(len(found), 0.5))
            every = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every), pa.array((every >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
