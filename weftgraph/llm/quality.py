"""Quality scores by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import SPACE, gram_hashes, keep_rows, text_chunks, word_hashes, word_spans

#: Rows of trusted positives, and of unlabelled texts, that one fit uses at most (those of least hashed id).
SAMPLE_ROWS = 10000
_HISTOGRAM = 128
_PAIRS = 256
N_FEATURES = _HISTOGRAM + 1 + _PAIRS + 16


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values[firsts[i]:firsts[i + 1]]."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[firsts[1:]] - total[firsts[:-1]]


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each owner, and how often its commonest one occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
    most = np.zeros(n)
    np.maximum.at(most, o[new], np.diff(np.append(new, len(k))))
    return np.bincount(o[new], minlength=n), most


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES numbers for each text: byte and byte-pair shares, word shapes and repetition.

    Features are shares or logarithms over the whole text; an empty text gets zeros.
    """
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    symbol = np.minimum(data, _HISTOGRAM).astype(np.int64)
    width = _HISTOGRAM + 1
    hist = np.bincount(doc * width + symbol, minlength=n * width).reshape(n, width) / size[:, None]
    if len(data) > 1:
        pair = ((data[:-1].astype(np.int64) * 31 + data[1:]) * 2654435761 >> 7) % _PAIRS
        inside = doc[:-1] == doc[1:]
        pairs = np.bincount(doc[:-1][inside] * _PAIRS + pair[inside], minlength=n * _PAIRS).reshape(n, _PAIRS) / size[:, None]
    else:
        pairs = np.zeros((n, _PAIRS))

    starts, ends, firsts = word_spans(data, offsets, ~SPACE)
    words = np.diff(firsts)
    per = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    length = ends - starts
    hashes = word_hashes(data, starts, ends)
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    alpha = upper | lower | ((data >= 48) & (data <= 57)) | (data >= 128)
    ups, lows, alphas = (np.concatenate([[0], np.cumsum(x)]) for x in (upper, lower, alpha))
    shout = (ups[ends] - ups[starts] > 1) & (lows[ends] == lows[starts])
    bare = alphas[ends] == alphas[starts]
    tail = ~alpha[ends - 1] & ~np.isin(data[ends - 1], list(b".,")) if len(ends) else np.zeros(0, bool)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    kinds, most = _distinct(owner, hashes, n)
    grams = gram_hashes(hashes, 3)
    whole = owner[: len(grams)] == owner[2:] if len(grams) else np.zeros(0, bool)
    gram_kinds, gram_most = _distinct(owner[: len(grams)][whole], grams[whole], n)
    gram_n = np.maximum(np.bincount(owner[: len(grams)][whole], minlength=n) if len(grams) else 0, 1)
    line = np.concatenate([[0], np.cumsum(data == 10)])
    lines = line[offsets[1:]] - line[offsets[:-1]]
    mean = _sums(length, firsts) / per
    shape = np.stack(
        [
            np.log1p(np.diff(offsets)), np.log1p(words), np.log1p(lines), mean,
            np.sqrt(np.maximum(_sums(length.astype(float) ** 2, firsts) / per - mean**2, 0)),
            _sums(shout, firsts) / per, _sums(bare, firsts) / per, _sums(tail, firsts) / per, _sums(again, firsts) / per,
            kinds / per, most / per, gram_kinds / gram_n, gram_most / gram_n, kinds / np.sqrt(per),
            _sums(upper, offsets) / size, _sums(alpha, offsets) / size,
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(hist), np.sqrt(pairs), shape], axis=1).astype(np.float32)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in the unlabelled scores, by best bin estimation (Garg et al., 2021) on held-back scores."""
    grid = np.unique(np.quantile(positive, np.linspace(0, 0.99, 100)))
    p = np.maximum(1 - np.searchsorted(np.sort(positive), grid, "left") / len(positive), 1e-9)
    u = 1 - np.searchsorted(np.sort(unlabelled), grid, "left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(positive)) + np.sqrt(np.log(4 / delta) / 2 / len(unlabelled))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


@dataclass
class Network:
    """A network with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int, hidden: int = 24, seed: int = 7) -> Network:
    """Minimise the non-negative unbiased risk (Kiryo et al., 2017) with logistic loss; prior None: plain P against U.

    The risk is prior * R+(P) + max(0, R-(U) - prior * R-(P)); where a batch makes the second term negative, the step
    climbs it instead, which keeps a flexible model from driving it below zero.
    """
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float32) for x in (positive, unlabelled))
    d = p.shape[1]
    par = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, 0.3, hidden).astype(np.float32), np.zeros(1, np.float32)]
    m1, m2, step, size = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par], 0, 512
    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for at in range(0, max(len(p), len(u)), size):
            xp = p[order_p[np.arange(at, at + size) % len(p)]]
            xu = u[order_u[np.arange(at, at + size) % len(u)]]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ par[0] + par[1])
            g = h @ par[2] + par[3]
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            if prior is None:
                grad = np.concatenate([(s[:size] - 1) / size, s[size:] / size]) / 2
            else:
                minus = np.logaddexp(0, g)
                rest = minus[size:].mean() - prior * minus[:size].mean()
                sign = 1.0 if rest >= 0 else -1.0
                up = (s[:size] - 1) / size * prior if sign > 0 else 0
                grad = np.concatenate([up - sign * prior * s[:size] / size, sign * s[size:] / size])
            grad = grad.astype(np.float32)
            back = np.outer(grad, par[2]) * (1 - h**2)
            grads = [x.T @ back + 1e-4 * par[0], back.sum(0), h.T @ grad + 1e-4 * par[2], grad.sum(keepdims=True)]
            step += 1
            for i, gr in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * gr
                m2[i] = 0.999 * m2[i] + 0.001 * gr**2
                par[i] = par[i] - 2e-3 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, par[0], par[1], par[2], float(par[3][0]), prior if prior is not None else 0.5)


def fit(positive: np.ndarray, unlabelled: np.ndarray, epochs: int = 40) -> Network:
    """Estimate the class prior on held-back halves, then train. Without positives or unlabelled texts every score is 0.5."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return Network(*(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), np.zeros((N_FEATURES, 1), np.float32), np.zeros(1), np.zeros(1), 0.0))
    first = train(positive[::2], unlabelled[::2], None, max(5, epochs // 4))
    prior = estimate_prior(first.scores(positive[1::2]), first.scores(unlabelled[1::2]))
    return train(positive, unlabelled, prior, epochs)


def _features_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            x = text_features(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["positive", "doc_id", "x"])

    rows = docs.select("positive", "doc_id", "text").mapInArrow(run, "positive boolean, doc_id long, x array<float>")
    return rows.groupBy("positive", "doc_id").agg(F.min("x").alias("x")).select("positive", "x")


def _matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the bounded sample, positives and unlabelled, in an order that does not depend on partitions."""
    found = rows.toArrow()
    x = np.stack(found["x"].to_numpy()).astype(np.float32) if found.num_rows else np.zeros((0, N_FEATURES), np.float32)
    positive = np.array(found["positive"].to_pylist(), bool)
    x, positive = (a[np.lexsort((x @ np.linspace(1, 2, N_FEATURES, dtype=np.float32), positive))] for a in (x, positive))
    rng = np.random.default_rng(3)
    return tuple(part[rng.permutation(len(part))] for part in (x[positive], x[~positive]))


def fit_quality(docs: DataFrame, labels: DataFrame, usable: str = "true", sample_rows: int = SAMPLE_ROWS) -> Network:
    """Fit on at most ``sample_rows`` trusted positives (labels.quality = 1) and as many texts without regard to labels.

    Both samples are the rows of least hashed doc_id among those that satisfy the SQL condition ``usable`` on doc_id, so
    they do not depend on partitioning. Labels of 0 are not read: the prior is estimated from scores of positives and
    unlabelled texts alone. Only sampled ids are broadcast, and one row of features an id reaches the driver (that of the least
    features where an id repeats), so both are bounded. Null ids are not sampled.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).filter(usable)
    trusted = labels.filter("quality = 1").select("doc_id").filter(usable).distinct()
    some = ids.orderBy(order, "doc_id").limit(sample_rows).distinct().select("doc_id", F.lit(False).alias("positive"))
    some = some.union(ids.join(trusted, "doc_id", "left_semi").orderBy(order, "doc_id").limit(sample_rows).distinct().select("doc_id", F.lit(True)))
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    return fit(*_matrix(_features_of(chosen)))


def score_quality(docs: DataFrame, model: Network) -> DataFrame:
    """(doc_id, score) for every row, in place: no shuffle. Null texts score as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.scores(text_features(data, offsets)).astype(float))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: Network, least: float) -> DataFrame:
    """Rows that score ``least`` or more, with all their columns; no shuffle."""
    return keep_rows(docs, lambda data, offsets: model.scores(text_features(data, offsets)) >= least)
