"""Arrow text columns as flat byte arrays: word spans and word hashes of many texts in a few vector operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .stagecache import tidy

#: Bytes of text that one vectorised step works on; a single longer text makes a step of its own.
CHUNK_BYTES = 1 << 18

#: Rows of an Arrow batch. Texts are long, and a batch is held several times over on its way to Python and back.
BATCH_ROWS = 1000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words for search: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand BATCH_ROWS rows at a time to Python in this session, unless it is set to fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; nulls become empty texts."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(rows, data, offsets) of at most ``limit`` bytes of text, or of one longer text."""
    tidy()
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of bytes of the set ``inside``, and each text's first word (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = mask[edges]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = mask[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def byte_positions(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... (sizes[i] of them) for all i, one after another."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever and in whatever text the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    values = _TABLE[data[at + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(values, total[:-1]) + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes; fewer words than ``n`` give none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i, p in enumerate(powers(n, 0xD6E8FEB86659FD93)):
        out += words[i : i + len(out)] * p
    return mix(out)


def keep_rows(docs: DataFrame, decide: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` whose text ``decide(data, offsets)`` keeps, with all their columns and in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            yield rows.filter(pa.array(decide(data, offsets)))

    return docs.mapInArrow(run, docs.schema)
