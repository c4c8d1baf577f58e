"""Toxicity scores from two class-conditional Kneser-Ney models over bytes that share their backoff counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .bytescan import keep_rows, text_chunks
from .idset import prefilter

#: Bytes of a gram: the byte that is predicted and its context.
ORDER = 4
DISCOUNT = 0.75
#: Bytes of a stretch. Besides the whole text's, the log-likelihoods of its most toxic stretch of this length are compared.
WINDOW = 20
#: Labelled training rows that the two-parameter calibration uses at most (those of least hashed id).
CALIBRATION_ROWS = 8000
#: Distinct grams that a task keeps before it hands counts on.
_FLUSH = 500_000

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = 48
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-byte gram that ends at each byte of each normalised text, as an integer, and the texts' lengths.

    A-Z is lower-cased, digits become 0, other ASCII a space, runs of spaces one space. Grams never cross texts: each
    text is preceded by spaces.
    """
    x = _FOLD[data]
    n, pad = len(offsets) - 1, ORDER - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    first = offsets[:-1][offsets[:-1] < len(x)]
    keep[first] = x[first] != 32
    x, doc = x[keep], doc[keep]
    out = np.full(len(x) + pad * n, 32, np.int64)
    at = np.arange(len(x)) + pad * (doc + 1)
    out[at] = x
    keys = np.zeros(len(x), np.int64)
    for back in range(pad, -1, -1):
        keys = keys << 8 | out[at - back]
    return keys, np.bincount(doc, minlength=n)


@dataclass
class RatioTable:
    """Log-likelihood ratios of all counted keys: one entry a key, in order of key (8 bytes each)."""

    keys: np.ndarray
    ratios: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's ratio (0 where it was not counted), and whether it was counted."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        keys = keys.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.ratios[at], np.float32(0)).astype(float), known


@dataclass
class ToxicModel:
    """Log-likelihood ratios of grams and of contexts, and the calibration of a text's length-normalised ratios.

    ``growth`` is what the most toxic stretch of an ordinary text gains when the text has e times as many stretches; it is
    taken off, so that a score does not rise with the length of an ordinary text. ``weights`` are those of the whole text's
    ratio, of the stretch's corrected ratio, and the constant.
    """

    grams: RatioTable
    contexts: RatioTable
    growth: float = 0.0
    weights: tuple[float, float, float] = (0.0, 0.0, -2.0)

    def ratios(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean log-likelihood ratio a byte (toxic against ordinary) of each whole text and of its most toxic WINDOW bytes, and
        its number of stretches.

        Texts shorter than a stretch count missing bytes as neutral and are one stretch; a text without bytes gets 0.
        """
        keys, lengths = gram_keys(data, offsets)
        ratio, known = self.grams.find(keys)
        ratio[~known] = self.contexts.find(keys[~known] >> 8)[0]
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        first = np.concatenate([[0], np.cumsum(lengths)])
        whole = total[first[1:]] - total[first[:-1]]
        most = whole.copy()
        short = lengths < WINDOW
        if len(ratio) >= WINDOW and not short.all():
            sums = np.full(len(ratio), -np.inf)
            sums[: len(ratio) - WINDOW + 1] = total[WINDOW:] - total[:-WINDOW]
            left = np.repeat(first[1:], lengths) - np.arange(len(ratio))
            sums[left < WINDOW] = -np.inf
            full = lengths > 0
            most[full] = np.where(short[full], most[full], np.maximum.reduceat(sums, first[:-1][full]))
        return whole / np.maximum(lengths, 1), most / WINDOW, np.maximum(lengths - WINDOW + 1, 1).astype(float)

    def score(self, whole: np.ndarray, most: np.ndarray, stretches: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a * whole + b * (most - self.growth * np.log(stretches)) + c, -30, 30)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text, 0 to 1."""
        return self.score(*self.ratios(data, offsets))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic) counts over all rows of ``labelled(toxic, text)``; tasks combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(keys: list, sums: list) -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            both = np.zeros((len(k), 2), np.int64)
            np.add.at(both, inverse, np.concatenate(sums))
            return k, both

        kept, counts = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for rows, data, offsets in text_chunks(batches):
            keys, lengths = gram_keys(data, offsets)
            toxic = np.repeat(rows.column(0).to_numpy(zero_copy_only=False).astype(bool), lengths)
            k, inverse = np.unique(keys, return_inverse=True)
            kept.append(k)
            counts.append(np.stack([np.bincount(inverse, ~toxic, len(k)), np.bincount(inverse, toxic, len(k))], 1).astype(np.int64))
            if sum(map(len, kept)) > _FLUSH:
                k, c = pack(kept, counts)
                kept, counts = [k], [c]
                if len(k) > _FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c[:, 0]), pa.array(c[:, 1])], ["gram", "ordinary", "toxic"])
                    kept, counts = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        k, c = pack(kept, counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c[:, 0]), pa.array(c[:, 1])], ["gram", "ordinary", "toxic"])

    counted = labelled.select(F.col("toxic").cast("boolean").alias("toxic"), "text").mapInArrow(run, "gram long, ordinary long, toxic long")
    return counted.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def shared_backoff(grams: DataFrame, order: int) -> DataFrame:
    """(gram, p): interpolated Kneser-Ney probability of a gram's last byte, from how many distinct bytes precede it.

    ``grams(gram)`` are the distinct grams of ``order + 1`` bytes of both classes together; the result has their
    suffixes of ``order`` bytes. Each order is discounted and backs off to the next lower one, the last to 1/256.
    """
    kinds = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    context = kinds.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("follow"))
    joined = kinds.withColumn("context", F.shiftright("gram", 8)).join(context, "context")
    if order == 1:
        lower = joined.withColumn("below", F.lit(1 / 256))
    else:
        below = shared_backoff(kinds.select("gram"), order - 1).select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
        lower = joined.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))).join(below, "suffix")
    return lower.select("gram", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("follow") * F.col("below")) / F.col("total")).alias("p"))


def likelihood_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, ratio) of grams and of contexts: log P(byte | context, toxic) - log P(byte | context, ordinary).

    Each class discounts its own gram counts and gives the mass to the backoff that both share, so for a gram that
    neither class has seen the backoff cancels and only the contexts' ratio of given mass is left.
    """
    counts = materialize(counts, "grams")
    contexts = counts.groupBy(F.shiftright("gram", 8).alias("context")).agg(
        *[f(c).alias(f"{c}_{a}") for c in ("ordinary", "toxic") for f, a in ((F.sum, "sum"), (lambda c: F.count(F.when(F.col(c) > 0, 1)), "kinds"))]
    )

    def given(c: str):
        return F.when(F.col(f"{c}_sum") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_sum")).otherwise(F.lit(1.0))

    contexts = contexts.withColumns({"ordinary_given": given("ordinary"), "toxic_given": given("toxic")})
    backoff = shared_backoff(counts.select("gram"), ORDER - 1).select(F.col("gram").alias("suffix"), "p")
    full = counts.withColumns({"context": F.shiftright("gram", 8), "suffix": F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1))})
    full = full.join(contexts, "context").join(backoff, "suffix")

    def chance(c: str):
        return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"{c}_sum"), F.lit(1)) + F.col(f"{c}_given") * F.col("p")

    grams = full.select(F.col("gram").alias("key"), F.log(chance("toxic") / chance("ordinary")).alias("ratio"))
    rest = contexts.select(F.col("context").alias("key"), F.log(F.col("toxic_given") / F.col("ordinary_given")).alias("ratio"))
    return grams, rest


def _table(rows: DataFrame) -> RatioTable:
    """The exact table of ``rows(key, ratio)``; it reaches the driver and grows with the number of distinct keys."""
    found = rows.select("key", F.col("ratio").cast("float").alias("ratio")).toArrow()
    keys, ratios = found["key"].to_numpy().astype(np.uint32), found["ratio"].to_numpy()
    order = np.argsort(keys)
    return RatioTable(keys[order], ratios[order])


def _rated(docs: DataFrame, shared) -> DataFrame:
    """(toxic, doc_id, whole, most, stretches) of every row of ``docs(toxic, doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, shared.value.ratios(data, offsets))], ["toxic", "doc_id", "whole", "most", "stretches"])

    return docs.select("toxic", "doc_id", "text").mapInArrow(run, "toxic boolean, doc_id long, whole double, most double, stretches double")


def calibrate(whole: np.ndarray, most: np.ndarray, stretches: np.ndarray, toxic: np.ndarray) -> tuple[float, tuple[float, float, float]]:
    """(growth, weights) from labelled texts: growth by least squares over ordinary ones, weights by logistic regression.

    Newton steps with a weak prior on weights. Without texts of both classes every score is low.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        return 0.0, (0.0, 0.0, -2.0)
    own = toxic == 0
    at = np.log(stretches[own])
    spread = ((at - at.mean()) ** 2).sum()
    growth = max(0.0, float(((at - at.mean()) * most[own]).sum() / spread)) if spread > 0 else 0.0
    design = np.stack([whole, most - growth * np.log(stretches), np.ones(len(toxic))], 1)
    prior, w = np.diag([0.02, 0.02, 1e-6]), np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w = w + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + prior, design.T @ (toxic - p) - prior @ w).clip(-4, 4)
    return growth, tuple(w.tolist())


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: str = "true", calibration_rows: int = CALIBRATION_ROWS) -> ToxicModel:
    """Count grams over all labelled rows that satisfy the SQL condition ``usable`` on doc_id, and build the model.

    Rows with a null label or id are not used; a doc_id with any toxic label counts as toxic. Only texts that may be
    labelled are shuffled. The calibration takes one row an id (the most toxic where an id repeats) of at most
    ``calibration_rows`` ids. Without labelled rows of both classes every score is low.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(usable)
    known = labels.filter("doc_id is not null and toxic is not null").filter(usable).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    grams, contexts = likelihood_ratios(gram_counts(prefilter(texts, known, "doc_id").join(known, "doc_id")))
    model = ToxicModel(_table(grams), _table(contexts))
    some = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(23)), "doc_id").limit(calibration_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rated = _rated(texts.join(F.broadcast(some), "doc_id"), shared)
    found = rated.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.struct("most", "whole", "stretches")).alias("x")).select("toxic", "x.*").toArrow()
    model.growth, model.weights = calibrate(*(found[c].to_numpy() for c in ("whole", "most", "stretches")), np.array(found["toxic"].to_pylist(), float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score) for every row, in place: no shuffle. Null texts score as empty ones, whose ratios are 0; null ids stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.scores(data, offsets))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_ordinary(docs: DataFrame, model: ToxicModel, below: float) -> DataFrame:
    """Rows that score under ``below``, with all their columns; no shuffle. Null and empty texts stay if an empty text scores so low."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda data, offsets: shared.value.scores(data, offsets) < below)
