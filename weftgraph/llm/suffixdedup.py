"""Repeated passages by sparse suffix arrays: suffixes at minimiser positions, sorted, compared with neighbours and extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.storage import materialize
from .bitmap import hashed_bitmap, is_set
from .bytescan import SPACE, byte_positions, gram_hashes, mix, text_chunks, word_hashes, word_spans

#: Least number of words of a passage.
MIN_WORDS = 50
#: Words of the gram whose hash decides which positions are retained.
GRAM = 8
#: One position of each run of so many is retained at least; a window's own position is at most SPREAD - 1 words in.
SPREAD = 25
#: Suffixes that one row holds at most on their way from comparison to stretches.
BUNDLE = 256
#: Bits of the bitmap of repeated suffix beginnings (16 MB), whatever the corpus. A fuller one lets more suffixes through.
BITMAP_BITS = 1 << 27


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of values[i:i + width] (the leftmost on ties) for every i that has so many values."""
    at, step = np.arange(len(values)), 1
    while 2 * step <= width:
        left, right = at[:-step], at[step:]
        at, step = np.where(values[right] < values[left], right, left), 2 * step
    left, right = at[: len(values) - width + 1], at[width - step :]
    return np.where(values[right] < values[left], right, left)


class Suffixes:
    """The retained suffixes of the texts of one chunk.

    Every window of ``min_words`` words belongs to the least GRAM-word hash among its first SPREAD positions (leftmost
    on ties), so equal windows belong to suffixes that begin alike wherever they stand. Windows of one suffix are
    consecutive: ``lo`` and ``hi`` are its first and last, ``at`` where it starts, all counted in words of the chunk.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_words: int):
        starts, ends, self.firsts = word_spans(data, offsets, ~SPACE)
        words = word_hashes(data, starts, ends)
        self.lo = self.hi = self.at = self.doc = np.zeros(0, np.int64)
        self.key = self.run = self.windows = np.zeros(0, np.uint64)
        if len(words) < min_words:
            return
        self.windows = gram_hashes(words, min_words)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.firsts))
        q = np.flatnonzero(doc[: len(self.windows)] == doc[min_words - 1 :])
        if not len(q):
            return
        grams = gram_hashes(words, GRAM)
        least = leftmost_least(grams, SPREAD)[q]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(q) != 1) | (np.diff(doc[q]) != 0)]))
        self.lo, self.hi = q[new], q[np.append(new[1:], len(q)) - 1]
        self.at, self.doc = least[new], doc[q[new]]
        self.key = gram_hashes(words, min_words - SPREAD + 1)[self.at]
        self.run = mix(self.windows[self.lo] * np.uint64(3) + self.windows[self.hi] * np.uint64(5) + (self.hi - self.lo).astype(np.uint64))


def _beginnings(docs: DataFrame, min_words: int) -> DataFrame:
    """(key): hash of the first min_words - SPREAD + 1 words of every retained suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(Suffixes(data, offsets, min_words).key.view(np.int64))], ["key"])

    return docs.mapInArrow(run, "key long")


_PLACE = "key long, run long, row long, doc_id long, digest long, word long"


def _candidates(docs: DataFrame, shared, min_words: int) -> DataFrame:
    """Retained suffixes whose beginning may repeat: ``key`` of the beginning, ``run`` of all that their windows cover, place, and window hashes.

    ``row`` is a number of its own for each row of ``docs``, whatever its id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for rows, data, offsets in text_chunks(batches):
            s = Suffixes(data, offsets, min_words)
            keep = np.flatnonzero(is_set(shared.value, (s.key & np.uint64(BITMAP_BITS - 1)).astype(np.int64)))
            count = s.hi[keep] - s.lo[keep] + 1
            begin = np.concatenate([[0], np.cumsum(count)])
            hashes = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(s.windows[byte_positions(s.lo[keep], count)].view(np.int64)))
            own = pa.array(s.doc[keep])
            arrays = [pa.array(s.key[keep].view(np.int64)), pa.array(s.run[keep].view(np.int64)), pa.array(row + s.doc[keep]), rows.column(0).take(own), rows.column(2).take(own), pa.array(s.lo[keep] - s.firsts[s.doc[keep]]), hashes]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "run", "row", "doc_id", "digest", "word", "hashes"])
            row += rows.num_rows

    return docs.mapInArrow(run, f"{_PLACE}, hashes array<long>")


def compare_neighbours(run: np.ndarray, owner: np.ndarray, word: np.ndarray, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, later) of sorted suffixes, whole groups of equal beginnings: bit i is set if the suffix's window i occurs more than once, or before.

    ``owner`` numbers the rows that the suffixes stand in, in their order. Neighbours that agree in all their windows are
    one from here on; of the others, every window (so many words to the left of the suffix, the rest from it on) is
    compared with the equal ones.
    """
    _, first, back = np.unique(run, return_index=True, return_inverse=True)
    copies = np.bincount(back)
    count = np.diff(firsts)[first]
    h = hashes[byte_positions(firsts[first], count)]
    of = np.repeat(np.arange(len(first)), count)
    bit = byte_positions(np.zeros(len(first), np.int64), count)
    place = (owner[first] << 32)[of] + word[first][of] + bit
    order = np.lexsort((place, h))
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[order][1:] != h[order][:-1]]))
    size = np.diff(np.append(new, len(h)))
    times = np.add.reduceat(copies[of[order]], new) if len(new) else np.zeros(0, np.int64)
    again = np.repeat(times > 1, size)
    flag = (np.int64(1) << bit)[order]
    mask, own = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    np.bitwise_or.at(mask, of[order][again], flag[again])
    head = new[times > 1]
    np.bitwise_or.at(own, of[order][head], flag[head])
    least = np.zeros(len(run), np.int64)
    least[first] = own
    return mask[back], mask[back] - least


_LISTS = ["row", "doc_id", "digest", "word", "mask", "later"]
_BUNDLES = ", ".join(f"{c} array<long>" for c in _LISTS)


def _bundles(columns: list[pa.Array], firsts: np.ndarray) -> list[pa.Array]:
    """List columns whose row i has the values from firsts[i] to firsts[i + 1]."""
    return [pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), c) for c in columns]


def _compared(ordered: DataFrame) -> DataFrame:
    """Each range of the sorted suffixes, compared: bundles of suffixes with repeated windows, and of what lies at its edges.

    Suffixes that begin as a range's first or last one may go on in the next range. Of those, the equal ones of a batch are
    a row with their places, without masks, and with ``run``, ``hashes`` and the number of the range as ``part``; the
    others have no ``hashes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, edge, held = TaskContext.get().partitionId(), None, []
        names = ["part", "run", *_LISTS, "hashes"]
        places = _LISTS[:4]

        def raw(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(0, rows.num_rows, BUNDLE):
                some = rows.slice(i, BUNDLE)
                own, first, back = np.unique(some.column("run").to_numpy(), return_index=True, return_inverse=True)
                order = pa.array(np.argsort(back, kind="stable"))
                firsts = np.concatenate([[0], np.cumsum(np.bincount(back))])
                none = pa.nulls(len(own), pa.list_(pa.int64()))
                lists = _bundles([some.column(c).take(order) for c in places], firsts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part)), pa.array(own), *lists, none, none, some.column("hashes").take(pa.array(first))], names)

        def done(rows: pa.RecordBatch) -> pa.RecordBatch:
            row, word = rows.column("row").to_numpy(), rows.column("word").to_numpy()
            lists = rows.column("hashes")
            firsts = lists.offsets.to_numpy().astype(np.int64)
            owner = np.cumsum(np.concatenate([[0], (np.diff(row) != 0).astype(np.int64)]))
            mask, later = compare_neighbours(rows.column("run").to_numpy(), owner, word, lists.flatten().to_numpy(), firsts - firsts[0])
            some = np.flatnonzero(mask)
            take = pa.array(some)
            firsts = np.append(np.arange(0, len(some), BUNDLE), len(some))
            n = len(firsts) - 1
            kept = _bundles([*(rows.column(c).take(take) for c in places), pa.array(mask[some]), pa.array(later[some])], firsts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.nulls(n, pa.int64()), *kept, pa.nulls(n, pa.list_(pa.int64()))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            edge = keys[0] if edge is None else edge
            begin = int(np.searchsorted(keys, edge, "right"))
            if begin:
                yield from raw(batch.slice(0, begin))
            if begin == batch.num_rows:
                continue
            held.append(batch.slice(begin))
            last = int(np.searchsorted(keys, keys[-1]))
            if last > begin or held[0].column("key")[0].as_py() != keys[-1]:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(np.searchsorted(rows.column("key").to_numpy(), keys[-1]))
                yield done(rows.slice(0, cut))
                held = [rows.slice(cut)]
        for rows in held:
            yield from raw(rows)

    return ordered.mapInArrow(run, f"part long, run long, {_BUNDLES}, hashes array<long>")


def _across(edges: DataFrame) -> DataFrame:
    """Bundles with masks of the suffixes at the ranges' edges.

    What a range has of a run of equal suffixes is one row for BUNDLE of them, so that a common passage, which fills many
    ranges, meets in few rows a range; windows are then compared by partial aggregates.
    """
    place = F.struct(F.expr("doc_id[0]").alias("doc_id"), F.expr("row[0]").alias("row"), F.expr("word[0]").alias("word"))
    runs = edges.groupBy("part", "run").agg(F.sum(F.size("row")).alias("copies"), F.min(place).alias("first"), F.min_by("hashes", place).alias("hashes"))
    one = runs.select("part", "run", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"), F.col("first.word").alias("word"), F.posexplode("hashes").alias("i", "h"))
    one = materialize(one.withColumn("q", F.col("word") + F.col("i")), "windows")
    at = F.struct("doc_id", "row", "q")
    windows = materialize(one.groupBy("h").agg(F.sum("copies").alias("times"), F.min(at).alias("least")).filter("times > 1"), "repeated-windows")
    bit = F.expr("shiftleft(1L, i)")
    masks = (
        one.join(windows, "h")
        .groupBy("part", "run")
        .agg(F.bit_or(bit).alias("all"), F.bit_or(F.when(at.eqNullSafe(F.col("least")), bit).otherwise(F.lit(0))).alias("own"), F.min(F.struct("doc_id", "row", "word")).alias("first"))
    )
    found = edges.join(materialize(masks, "masks"), ["part", "run"])
    every = F.array_repeat("all", F.size("row"))
    later = F.when(F.col("first").eqNullSafe(place), F.concat(F.array(F.col("all") - F.col("own")), F.array_repeat("all", F.size("row") - 1))).otherwise(every)
    return found.select(*_LISTS[:4], every.alias("mask"), later.alias("later"))


def _stretches(bundles: DataFrame, min_words: int) -> DataFrame:
    """(row, doc_id, digest, part, start_word, end_word) of each run of set bits of ``mask`` ('repeated') and ``later``: bit i is window word + i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {c: batch.column(c).flatten() for c in _LISTS}
            for first in range(0, len(flat["row"]), 1 << 14):
                some = {c: x.slice(first, 1 << 14) for c, x in flat.items()}
                word = some["word"].to_numpy()
                for part in ("mask", "later"):
                    bits = (some[part].to_numpy()[:, None] >> np.arange(SPREAD + 1) & 1).astype(np.int8)
                    change = np.diff(bits, axis=1, prepend=0)
                    r, begin = np.nonzero(change > 0)
                    end = np.nonzero(change < 0)[1]
                    own = [some[c].take(pa.array(r)) for c in _LISTS[:3]]
                    label = pa.array(["repeated" if part == "mask" else "later"] * len(r), pa.string())
                    yield pa.RecordBatch.from_arrays([*own, label, pa.array(word[r] + begin), pa.array(word[r] + end - 1 + min_words)], ["row", "doc_id", "digest", "part", "start_word", "end_word"])

    return bundles.select(*_LISTS).mapInArrow(run, "row long, doc_id long, digest long, part string, start_word long, end_word long")


def _united(stretches: DataFrame) -> DataFrame:
    """Overlapping or touching stretches of a row as one. A window never holds more than one row's stretches."""
    by = W.partitionBy("row", "part").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(by.rowsBetween(W.unboundedPreceding, -1))
    islands = stretches.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start_word")).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    whole = [F.min("doc_id").alias("doc_id"), F.min("digest").alias("digest"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")]
    return islands.groupBy("row", "part", "island").agg(*whole).select("row", "doc_id", "digest", "part", "start_word", "end_word")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, digest, part, start_word, end_word): stretches of words whose every ``min_words``-word window occurs twice or more.

    Words are runs of anything but ASCII white space, compared by 64-bit hashes; end_word is exclusive. ``part`` is
    'repeated' for all of a stretch, and 'later' for what of it also occurs before, in order of (doc_id, row, word): cutting
    the 'later' stretches leaves one occurrence of everything. Occurrences within one document count like others. ``row``
    numbers the rows of ``docs`` and ``digest`` is the hash of their text.

    1. Suffixes are retained at minimiser positions (about 2 in SPREAD + 1 words). Those whose first
       min_words - SPREAD + 1 words occur once are out: an aggregate over 8-byte hashes finds the others, and a
       bounded bitmap tells tasks, so no text is shuffled.
    2. The other suffixes are sorted in ranges, by the hash of their beginning and then by place. In each range, neighbours
       of one beginning are compared and extended word by word to the left (at most SPREAD - 1) and right, as hashes of
       every window that they are in. Ranges part a common passage by place; what begins as a range's first or last suffix
       is compared across ranges, by one row a range and distinct suffix.
    3. Runs of repeated windows become stretches, and stretches that overlap are united within each row.

    Null and short texts have no windows. An id that occurs on several rows, or is null, counts each row for itself; of equal
    rows the one that is read first is the earlier. Other columns are not read. An empty table gives an empty result.
    """
    if not 2 * GRAM + SPREAD - 1 <= min_words:
        raise ValueError(f"min_words must be {2 * GRAM + SPREAD - 1} or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    again = _beginnings(docs, min_words).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = hashed_bitmap(again.select(F.col("key").bitwiseAND(F.lit(BITMAP_BITS - 1)).alias("h")), BITMAP_BITS)
    found = materialize(_candidates(docs, shared, min_words), "suffixes")
    order = ["key", "doc_id", "row", "word"]
    compared = materialize(_compared(found.repartitionByRange(*order).sortWithinPartitions(*order)), "compared")
    marked = compared.filter("hashes is null").select(*_LISTS).union(_across(compared.filter("hashes is not null")))
    return _united(_stretches(marked, min_words))


def cut_later(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the 'later' stretches of :func:`repeated_passages` cut out of their texts; documents that lose all their words are dropped.

    Rows are told apart by id (null is an id like others) and text. Of rows with windows that are equal in both one stays,
    cut as the first of them. Rows without windows, with null and with empty texts stay. Other columns stay as they are.
    """
    place = F.when(F.col("part") == "later", F.struct("start_word", "end_word"))
    spans = passages.groupBy("doc_id", "digest", "row").agg(F.sort_array(F.collect_list(place)).alias("spans"))
    spans = spans.groupBy("doc_id", "digest").agg(F.count("*").alias("_times"), F.min_by("spans", "row").alias("_spans"))
    spans = materialize(spans.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "_times", "_spans"), "spans")
    columns = docs.columns
    at = columns.index("text")

    def cut(text: str, spans: list) -> str | None:
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, _, _ = word_spans(data, np.array([0, len(raw)]), ~SPACE)
        edge = np.append(starts, len(raw))
        out, last = [], 0
        for s in spans:
            out.append(raw[last : edge[s["start_word"]]])
            last = int(edge[s["end_word"]])
        left = b"".join([*out, raw[last:]])
        return left.decode() if left.split() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()
            new = [cut(t, s) if s else t for t, s in zip(texts, spans)]
            keep = pa.array([not s or t is not None for t, s in zip(new, spans)], pa.bool_())
            arrays = [pa.array(new, batch.column(at).type) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(keep)

    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_digest")), "left")
    if spans.filter("_times > 1").limit(1).count():
        single = joined.filter("coalesce(_times, 1) = 1")
        joined = single.union(joined.filter("_times > 1").dropDuplicates(["_id", "_digest"]))
    return joined.select(*columns, "_spans").mapInArrow(run, docs.schema)
