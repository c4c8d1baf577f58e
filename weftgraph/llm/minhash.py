"""MinHash near-duplicates: banded candidates, pruned by the posterior of their similarity batch by batch, verified on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.storage import materialize
from .bytescan import LOWER, SPACE, byte_positions, gram_hashes, mix, text_chunks, word_hashes, word_spans
from .idset import prefilter

#: Bands and hashes of a band: a pair of similarity 0.8 shares no band with a chance of 5e-7, one of 0.3 shares one with 0.034.
BANDS, ROWS = 48, 6
#: Hashes that are compared between two looks at the posterior, and the chance of 0.8 or more below which a pair is given up.
BATCH, MISS = 48, 1e-7
#: Sets of a task's block of a large bucket; sets that are verified with one copy of their partner; pairs of one numpy step.
BLOCK, FAN, STEP = 1024, 256, 1 << 16
#: Shingles of a task's block of a large bucket.
BLOCK_SHINGLES = 1 << 22

_rng = np.random.default_rng(20240517)
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct 64-bit shingle hashes in order, one text after another, and where each text's begin (n + 1)."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ~SPACE)
    words = word_hashes(data, starts, ends)
    grams, bounds, sets = gram_hashes(words, shingle), first.tolist(), []
    for i, j in zip(bounds[:-1], bounds[1:]):
        if j - i >= shingle:
            sets.append(np.unique(grams[i : j - shingle + 1]))
        elif j > i:
            sets.append(mix(gram_hashes(words[i:j], j - i) + np.uint64(j - i)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum([0] + [len(s) for s in sets])


def _set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set that is not empty."""
    begin, size = bounds[:-1][np.diff(bounds) > 0], np.diff(bounds)[np.diff(bounds) > 0]
    return mix(np.add.reduceat(mix(hashes + np.uint64(0x632BE59BD9B4E019)), begin) + size.astype(np.uint64)) if len(begin) else np.zeros(0, np.uint64)


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, sid, sig, keys): set size, set id, a byte of each minimum, and a key of each band; nulls for empty sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            hashes, bounds = shingle_sets(data, offsets, shingle)
            size = np.diff(bounds)
            full = size > 0
            at = np.cumsum(full) - 1
            sid = _set_ids(hashes, bounds).view(np.int64)
            begin, x = bounds[:-1][full], (hashes >> np.uint64(32)).astype(np.uint32)
            least = np.empty((len(begin), BANDS * ROWS), np.uint32)
            for i in range(BANDS * ROWS if len(begin) else 0):
                least[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], begin)
            sig = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            keys = np.full((len(begin), BANDS), np.arange(1, BANDS + 1, dtype=np.uint64))
            for i in range(ROWS):
                keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + least[:, i::ROWS])
            keys = keys.view(np.int64)
            cells = [
                rows.column("doc_id"),
                pa.array(size.astype(np.int64)),
                pa.array(sid[np.maximum(at, 0)] if len(sid) else np.zeros(len(size), np.int64), mask=~full),
                pa.array([sig[k].tobytes() if f else None for k, f in zip(at.tolist(), full.tolist())], pa.binary()),
                pa.array([keys[k] if f else None for k, f in zip(at.tolist(), full.tolist())], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cells, schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, sid long, sig binary, keys array<long>")


def least_matches(similar: float, miss: float, hashes: int = BANDS * ROWS, batch: int = BATCH) -> np.ndarray:
    """Of each number of hashes compared, the least matches with a chance of ``similar`` or more of ``miss`` at least.

    With a uniform prior, the similarity after m of n matches is Beta(m + 1, n - m + 1), whose upper tail at ``similar``
    is the chance of at most m successes in n + 1 trials. A byte of a hash also matches by chance, which only keeps more.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def _survive(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, i: np.ndarray, j: np.ndarray, similar: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs (a[i], b[j]) that may reach ``similar``, and their matches; sizes first, then batches of hashes."""
    kept, matches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(0, len(i), STEP):
        x, y = i[first : first + STEP], j[first : first + STEP]
        alive = np.flatnonzero(np.minimum(n_a[x], n_b[y]) * 100 >= np.maximum(n_a[x], n_b[y]) * round(100 * similar))
        found = np.zeros(len(alive), np.int64)
        for k, m in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            found += (a[x[alive], part] == b[y[alive], part]).sum(1)
            stay = found >= m
            alive, found = alive[stay], found[stay]
        kept.append(first + alive)
        matches.append(found)
    return np.concatenate(kept), np.concatenate(matches)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _judge_pairs(pairs: DataFrame, sets: DataFrame, similar: float, miss: float) -> DataFrame:
    """(a, b, matches) of the pairs that the sequential test keeps."""
    least = least_matches(similar, miss)
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.arange(batch.num_rows)
            kept, matches = _survive(_sigs(batch.column(3)), _sigs(batch.column(5)), batch.column(2).to_numpy(), batch.column(4).to_numpy(), every, every, similar, least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), pa.array(matches)], ["a", "b", "matches"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "sig_a", "n_b", "sig_b").mapInArrow(run, "a long, b long, matches long")


def _judge_buckets(rows: DataFrame, similar: float, miss: float) -> DataFrame:
    """(a, b): pairs that join all sets of a bucket that may be alike; ``rows(key, i, j, blk, sid, comp, n, sig, short)``.

    Task rows of one (key, i, j) are a bucket's blocks i and j; pairs inside a block are judged where i = j. Pairs of
    different components that the sequential test keeps are counted on ``short``, 32 bits of each shingle's hash, which
    never counts too few. A pair that reaches ``similar`` joins its components, so a task returns no more pairs than sets.
    """
    least, share = least_matches(similar, miss), round(100 * similar)

    def judge(part: pa.Table) -> pa.RecordBatch:
        sid, comp, blk, n = (part.column(c).to_numpy().copy() for c in ("sid", "comp", "blk", "n"))
        sig, bounds = _sigs(part.column("sig")), np.concatenate([[0], np.cumsum(n)])
        codes = np.unique(np.frombuffer(b"".join(part.column("short").to_pylist()), np.uint32), return_inverse=True)[1]
        mine = np.zeros(len(codes), bool)
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        out: list[tuple[int, int]] = []
        for x in left.tolist():
            y = right[(right > x) | (i != j)]
            y = y[comp[y] != comp[x]]
            y = y[_survive(sig, sig, n, n, np.full(len(y), x), y, similar, least)[0]]
            if not len(y):
                continue
            own = codes[bounds[x] : bounds[x + 1]]
            mine[own] = True
            both = np.add.reduceat(mine[codes[byte_positions(bounds[y], n[y])]], np.cumsum(n[y]) - n[y], dtype=np.int64)
            mine[own] = False
            for z in y[100 * both >= share * (n[x] + n[y] - both)].tolist():
                if comp[z] != comp[x]:
                    comp[comp == comp[z]] = comp[x]
                    out.append((min(sid[x], sid[z]), max(sid[x], sid[z])))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            key = np.column_stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if first == last:
                    continue
                if now != (mine := tuple(key[first])) and held:
                    yield judge(pa.Table.from_batches(held))
                    held = []
                now = mine
                held.append(batch.slice(first, last - first))
        if held:
            yield judge(pa.Table.from_batches(held))

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _full_sets(ids: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(sid, hashes) of the sets ``ids(sid)``, made again from one text each."""
    asked = materialize(ids.join(sets.select("sid", "least"), "sid"), "asked")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            hashes, bounds = shingle_sets(data, offsets, shingle)
            full = np.flatnonzero(np.diff(bounds) > 0)
            cells = [hashes[bounds[k] : bounds[k + 1]].tobytes() for k in full.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(_set_ids(hashes, bounds).view(np.int64)), pa.array(cells, pa.binary())], ["sid", "hashes"])

    texts = prefilter(docs, asked.select(F.col("least").alias("doc_id")), "doc_id")
    made = texts.mapInArrow(make, "sid long, hashes binary").join(asked.select("sid"), "sid", "left_semi")
    return materialize(made.groupBy("sid").agg(F.any_value("hashes").alias("hashes")), "sets")


def _open_buckets(bands: DataFrame, sets: DataFrame, placed: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The rows that :func:`_judge_buckets` takes: buckets that hold sets of several components, in blocks, a row for each pair of blocks."""
    where = sets.select("sid", "n", "sig").join(placed.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "n", "sig", F.coalesce("component", "sid").alias("comp"))
    named = bands.join(where.select("sid", "comp", "n"), "sid")
    mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n").alias("words")).filter("low <> high")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("words") / BLOCK_SHINGLES)).cast("int")
    rows = materialize(named.select("key", "sid", "size").join(mixed.select("key", "words"), "key").select("key", "sid", blocks.alias("blocks")), "minhash-open")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [(np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], ["sid", "short"])

    made = _full_sets(rows.select("sid").distinct(), sets, docs, shingle).mapInArrow(cut, "sid long, short binary")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.select("key", "sid", "blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "sid")
    return rows.join(where.join(made, "sid"), "sid").select("key", "i", "j", "blk", "sid", "comp", "n", "sig", "short")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, similar: float) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 100 * similar * union.

    Only the sets that are asked for are made again. A set travels to its partner: one copy of ``a`` for up to about FAN
    partners, and every partner after it, so a task holds two sets whatever the number of pairs.
    """
    share = round(100 * similar)
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    made = _full_sets(ends, sets, docs, shingle)
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans"))
    dealt = pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("fan"))
    heads = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan")).join(made.withColumnRenamed("sid", "a"), "a")
    rest = dealt.join(made.withColumnRenamed("sid", "b"), "b")
    stream = heads.select("a", "fan", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("b"), "hashes").union(rest.select("a", "fan", F.lit(1).alias("kind"), "b", "hashes"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for k, (kind, raw) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("hashes"))):
                mine = np.frombuffer(raw.as_py(), np.uint64)
                if not kind:
                    head = mine
                    continue
                both = np.searchsorted(head, mine)
                both = int((head[np.minimum(both, len(head) - 1)] == mine).sum())
                if 100 * both >= share * (len(head) + len(mine) - both):
                    good.append(k)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return stream.repartition("a", "fan").sortWithinPartitions("a", "fan", "kind").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, similar: float = 0.8, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; component_id is the smallest id reachable over links.

    A-Z is lower-cased, words are runs of anything but ASCII white space; a set holds the distinct ``shingle``-word
    shingles, or the whole sequence where there are fewer words. Two sets link where their Jaccard similarity, counted on
    the full sets, is ``similar`` or more. Shingles and sets are told apart by 64-bit hashes.

    Equal sets are one class from the start, so copies cost nothing. Classes that share one of 48 bands of six minima are
    candidates. In each bucket every class is tested against the bucket's least one: matches of the signatures are
    counted batch by batch, and a pair is given up as soon as the posterior chance of ``similar`` is below ``miss``. The
    best survivor of each class is verified, which already joins most of a group. Then only pairs of a bucket in different
    components are left: they are tested in blocks (a large bucket is many tasks), the survivors are counted there on 32
    bits of each shingle, and what joins two components is verified in full. So every candidate pair is counted, given up
    by the test, or connected already; none is dropped for the size of a bucket, and no list of pairs is written. A
    link of exactly 0.8 is missed with a chance of about 5e-7 (bands) and 5e-6 (test).

    Null and empty texts have no set: n_shingles 0, component_id their own id, linked with nothing. Rows repeat as often
    as in ``docs``. A null id never names a component unless it has no other; kept is whether doc_id and component_id are
    equal (null with null too). An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = materialize(_signed(docs, shingle), "minhash")
    sets = marked.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), *(F.any_value(c).alias(c) for c in ("n", "sig", "keys")))
    sets = materialize(sets, "minhash-sets")
    rows = sets.select("sid", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("sid").alias("head")).filter("size > 1")
    bands = materialize(rows.join(shared, "key"), "minhash-bands")
    stars = bands.filter("sid <> head").select(F.col("head").alias("a"), F.col("sid").alias("b")).distinct()
    stars = materialize(_judge_pairs(stars, sets, similar, miss), "minhash-stars")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("matches", "a")).alias("a")).select("a", "b")
    linked = materialize(_verified(materialize(best, "minhash-best"), sets, docs, shingle, similar), "minhash-links")

    placed = materialize(connected_components(linked), "minhash-placed")
    left = materialize(_judge_buckets(_open_buckets(bands, sets, placed, docs, shingle), similar, miss), "minhash-left")
    if left.limit(1).count():
        linked = linked.union(materialize(_verified(left, sets, docs, shingle, similar), "minhash-more"))
        placed = materialize(connected_components(linked), "minhash-placed")

    final = sets.select("sid", "least").join(placed.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    final = materialize(final, "minhash-class")
    names = final.groupBy("component").agg(F.min("least").alias("component_id"))
    final = materialize(final.join(names, "component").select("sid", "component_id"), "minhash-id")
    out = marked.select("doc_id", "n", "sid").join(final, "sid", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
