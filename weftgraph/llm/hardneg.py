"""Hard negatives from Hilbert-ordered blocks of vectors whose per-dimension bounds say which blocks a window must read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: Rows of a block, which has one zone map, and anchors of a group, which travel together.
BLOCK, GROUP = 256, 256
#: Rows of a shelf, the blocks that lie in one row of the table: a share of all rows between these bounds.
SHELF_ROWS = 1 << 12, 1 << 17
#: Zone maps of so many shelves are sent to a group of anchors at once.
CHUNK = 64
#: Bits of each component in the order along the curve.
HILBERT_BITS = 4
#: Components become floor(SCALE * x). A row whose squares sum to LIMIT or more has no score in a long.
SCALE, LIMIT = 256, 2.0**60

_ROW = "dims int, vec_id long, label long, vector binary, key binary"
_SHELF = "shelf long, dims int, sizes array<int>, low binary, high binary, labels binary, vec_ids binary, vector binary"
_ANCHORS = "grp long, dims int, uids binary, vec_ids binary, labels binary, vector binary, floors binary"


def hilbert_keys(values: np.ndarray, bits: int = HILBERT_BITS) -> np.ndarray:
    """Places of rows of ``bits``-bit coordinates along the Hilbert curve, as big-endian rows of bytes (Skilling, 2004)."""
    x = np.ascontiguousarray(values.T.astype(np.uint32))
    n = len(x)
    top = np.uint32(1 << (bits - 1))
    q = top
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(values.shape[0], np.uint32)
    q = top
    while q > 1:
        t ^= np.where(x[n - 1] & q, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= t
    planes = (x[None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]) & np.uint32(1)
    return np.packbits(planes.reshape(bits * n, -1).T.astype(np.uint8), axis=1)


def _quantised(rows: DataFrame) -> DataFrame:
    """Valid rows as whole numbers, with their place along the curve. The order reads four bits of x in [-1, 1), clipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, length = batch.column(0), batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            owner = np.repeat(np.arange(len(length)), length.astype(np.int64))
            with np.errstate(all="ignore"):
                whole = np.floor(SCALE * values)
                norm = np.bincount(owner, weights=whole * whole, minlength=len(length))
            bad = np.bincount(owner, weights=~np.isfinite(values), minlength=len(length)) > 0
            begin = np.cumsum(length) - length
            for n in np.unique(length).tolist():
                use = np.flatnonzero((length == n) & ~bad & (norm < LIMIT))
                if not len(use):
                    continue
                n = int(n)
                q = whole[begin[use].astype(np.int64)[:, None] + np.arange(n)].astype(np.int64)
                cells = np.clip((q >> 5) + (1 << (HILBERT_BITS - 1)), 0, (1 << HILBERT_BITS) - 1)
                keys = hilbert_keys(cells) if n else np.zeros((len(use), 0), np.uint8)
                take = batch.take(pa.array(use))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(use), n, np.int32)), take.column(1), take.column(2), pa.array([v.tobytes() for v in q], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())],
                    ["dims", "vec_id", "label", "vector", "key"],
                )

    return rows.mapInArrow(run, _ROW)


def _packed(column: pa.Array) -> bytes:
    """The bytes of all values of a binary column, one after another."""
    return b"".join(column.to_pylist())


def _shelves(rows: DataFrame, shelf_rows: int) -> DataFrame:
    """Sorted rows of each partition as shelves of blocks with their zone maps: bounds of every component, and of labels."""

    def cut(part: pa.Table, number: int) -> pa.RecordBatch:
        n, dims = part.num_rows, part.column("dims")[0].as_py()
        vectors = np.frombuffer(_packed(part.column("vector")), np.int64).reshape(n, dims)
        labels = part.column("label").to_numpy()
        begin = np.arange(0, n, BLOCK)
        low = np.minimum.reduceat(vectors, begin, axis=0) if dims else np.zeros((len(begin), 0), np.int64)
        high = np.maximum.reduceat(vectors, begin, axis=0) if dims else low
        width = np.column_stack([np.minimum.reduceat(labels, begin), np.maximum.reduceat(labels, begin)])
        # null ids come last: a flag stands before each id
        ids = part.column("vec_id")
        known = np.column_stack([ids.is_valid().to_numpy(), ids.fill_null(0).to_numpy()]).astype(np.int64)
        sizes = np.diff(np.append(begin, n)).tolist()
        row = [number, dims, sizes, low.tobytes(), high.tobytes(), width.tobytes() + labels.tobytes(), known.tobytes(), vectors.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row[:1]] + [pa.array([dims], pa.int32()), pa.array([sizes], pa.list_(pa.int32()))] + [pa.array([x], pa.binary()) for x in row[3:]], [c.split()[0] for c in _SHELF.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 20, None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                dims = held.column("dims").to_numpy()
                same = int(np.argmax(dims != dims[0])) or len(dims)
                if same == held.num_rows and same < shelf_rows:
                    break
                take = min(same, shelf_rows)
                yield cut(held.slice(0, take), number)
                number, held = number + 1, held.slice(take)
        if held is not None and held.num_rows:
            yield cut(held, number)

    return rows.mapInArrow(run, _SHELF)


class Shelf:
    """One row of the table of shelves in arrays: rows, blocks and bounds."""

    def __init__(self, row: dict):
        self.number, self.dims, self.sizes = row["shelf"], row["dims"], np.array(row["sizes"], np.int64)
        n, blocks = int(self.sizes.sum()), len(self.sizes)
        self.low, self.high = (np.frombuffer(row[c], np.int64).reshape(blocks, self.dims) for c in ("low", "high"))
        labels = np.frombuffer(row["labels"], np.int64)
        self.label_bounds = labels[: 2 * blocks].reshape(blocks, 2)
        if row.get("vector") is not None:
            self.labels = labels[2 * blocks :]
            self.known, self.vec_ids = np.frombuffer(row["vec_ids"], np.int64).reshape(n, 2).T
            self.vectors = np.frombuffer(row["vector"], np.int64).reshape(n, self.dims)
            self.uids = (self.number << 18) + np.arange(n)
            self.first = np.concatenate([[0], np.cumsum(self.sizes)])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exactly: in floating point where no sum can leave 53 bits, else in 64-bit integers."""
    a2, b2 = ((x.astype(np.float64) ** 2).sum(1).max(initial=0) for x in (a, b))
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if a2 * b2 < 2.0**104 else a @ b.T


def _bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that each anchor's inner product with a row of each block can be, by interval arithmetic."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    if max(np.abs(x).max(initial=0) for x in (anchors, low, high)) ** 2 * max(anchors.shape[1], 1) < 2**51:
        f = np.float64
        up, down, low, high = up.astype(f), down.astype(f), low.astype(f), high.astype(f)
        return up @ low.T + down @ high.T, up @ high.T + down @ low.T
    up, down, low, high = (x.astype(object) for x in (up, down, low, high))
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _first(scores: np.ndarray, chosen: np.ndarray, shelf: Shelf, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``k`` chosen columns of each row: higher scores, then smaller ids, null ids last."""
    if chosen.sum() > 64 * max(1, len(chosen)) and scores.shape[1] > k:
        low = np.iinfo(np.int64).min
        held = np.where(chosen, scores, low)
        chosen = chosen & (scores >= np.partition(held, -k, axis=1)[:, -k][:, None])
    r, c = np.nonzero(chosen)
    order = np.lexsort((shelf.uids[at[c]], shelf.vec_ids[at[c]], 1 - shelf.known[at[c]], -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _anchors(shelves: DataFrame, modulo: int, k: int) -> DataFrame:
    """Groups of anchors, with what their own block gives: a score that ``k`` other rows of their label reach, or the least long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shelf = Shelf(row)
                found = np.flatnonzero((shelf.known == 1) & (shelf.vec_ids % modulo == 0))
                for i in range(0, len(found), GROUP):
                    at = found[i : i + GROUP]
                    floors = np.full(len(at), np.iinfo(np.int64).min)
                    block = np.searchsorted(shelf.first, at, "right") - 1
                    for b in np.unique(block).tolist():
                        mine, rows = np.flatnonzero(block == b), np.arange(shelf.first[b], shelf.first[b + 1])
                        scores = _scores(shelf.vectors[at[mine]], shelf.vectors[rows])
                        other = (shelf.labels[at[mine]][:, None] == shelf.labels[rows]) & (at[mine][:, None] != rows)
                        if len(rows) > k:
                            floors[mine] = np.partition(np.where(other, scores, np.iinfo(np.int64).min), -k, axis=1)[:, -k]
                    parts = [shelf.uids[at], shelf.vec_ids[at], shelf.labels[at], np.ascontiguousarray(shelf.vectors[at]), floors]
                    cells = [pa.array([(shelf.number << 9) + i // GROUP]), pa.array([shelf.dims], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
                    yield pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in _ANCHORS.split(", ")])

    return shelves.mapInArrow(run, _ANCHORS)


def _needed(anchors: DataFrame, shelves: DataFrame, positives: bool, low_share: int, top_share: int) -> DataFrame:
    """(shelf, grp, need): which of a shelf's blocks any window of which anchors must read; pairs that need none are left out.

    Groups of anchors meet chunks of zone maps. For positives a block is needed where its greatest possible score reaches
    the anchor's floor and it has the anchor's label; for negatives, where its interval of scores meets a window and it
    has another label.
    """
    numbered = shelves.select("shelf", "dims", "sizes", "low", "high", "labels").withColumn("chunk", F.pmod(F.xxhash64("shelf"), F.lit(1 << 20)))
    chunks = max(1, -(-shelves.count() // CHUNK))
    numbered = numbered.withColumn("chunk", F.col("chunk") % chunks)
    zones = numbered.groupBy("chunk", "dims").agg(F.collect_list(F.struct("shelf", "dims", "sizes", "low", "high", F.expr("substring(labels, 1, 16 * size(sizes))").alias("labels"))).alias("zones"))
    asked = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                labels = np.frombuffer(row["labels"], np.int64)
                vectors = np.frombuffer(row["vector"], np.int64).reshape(len(labels), row["dims"])
                tops = None if positives else np.frombuffer(row["tops"], np.int64).reshape(len(vectors), -1)
                floors = np.frombuffer(row["floors"], np.int64)
                out = []
                for zone in row["zones"]:
                    shelf = Shelf(zone)
                    least, most = _bounds(vectors, shelf.low, shelf.high)
                    first, last = shelf.label_bounds.T
                    if positives:
                        need = (most >= floors[:, None]) & (first <= labels[:, None]) & (labels[:, None] <= last)
                    else:
                        need = np.zeros(least.shape, bool)
                        for top in tops.T:
                            need |= (top >= 0)[:, None] & (top_share * most >= (low_share * top)[:, None]) & (least <= top[:, None])
                        need &= (first != labels[:, None]) | (last != labels[:, None])
                    if need.any():
                        out.append((shelf.number, row["grp"], np.packbits(need.astype(bool)).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))], ["shelf", "grp", "need"])

    return asked.join(zones, ["chunk", "dims"]).mapInArrow(run, "shelf long, grp long, need binary")


def _read(shelves: DataFrame, anchors: DataFrame, needed: DataFrame, positives: bool, k: int, low_share: int, top_share: int) -> DataFrame:
    """(grp, idx, slot, score, vec_id): the first ``k`` rows of each anchor, or of each of its windows, in every shelf.

    Each shelf goes to one task, the groups of anchors that need any of its blocks come after it one by one.
    """
    both = needed.join(anchors, "grp").select("shelf", F.lit(1).alias("kind"), "grp", "need", F.struct([c for c in anchors.columns if c != "grp"]).alias("anchors"))
    blocks = shelves.select("shelf", F.lit(0).alias("kind"), F.struct(*shelves.columns).alias("block")).join(needed.select("shelf").distinct(), "shelf", "left_semi")
    stream = blocks.unionByName(both, allowMissingColumns=True)

    def score(shelf: Shelf, row: dict) -> tuple:
        a = row["anchors"]
        uids, labels, floors = (np.frombuffer(a[c], np.int64) for c in ("uids", "labels", "floors"))
        vectors = np.frombuffer(a["vector"], np.int64).reshape(len(uids), shelf.dims)
        need = np.unpackbits(np.frombuffer(row["need"], np.uint8), count=len(uids) * len(shelf.sizes)).astype(bool).reshape(len(uids), -1)
        parts = []
        for i in range(0, len(shelf.sizes), 16):
            columns = np.flatnonzero(need[:, i : i + 16].any(0)) + i
            lines = np.flatnonzero(need[:, i : i + 16].any(1))
            if not len(columns):
                continue
            at = np.concatenate([np.arange(shelf.first[b], shelf.first[b + 1]) for b in columns.tolist()])
            scores = _scores(vectors[lines], shelf.vectors[at])
            open_ = np.repeat(need[np.ix_(lines, columns)], shelf.sizes[columns], axis=1)
            same = labels[lines][:, None] == shelf.labels[at]
            if positives:
                windows = [(0, open_ & same & (scores >= floors[lines][:, None]) & (uids[lines][:, None] != shelf.uids[at]))]
            else:
                tops = np.frombuffer(a["tops"], np.int64).reshape(len(uids), -1)[lines]
                open_ &= ~same
                windows = [(j, open_ & (t >= 0)[:, None] & (scores <= t[:, None]) & (top_share * scores >= (low_share * t)[:, None])) for j, t in enumerate(tops.T)]
            for slot, chosen in windows:
                r, c = _first(scores, chosen, shelf, at, k)
                parts.append((np.full(len(r), row["grp"]), lines[r], np.full(len(r), slot), scores[r, c], shelf.known[at[c]], shelf.vec_ids[at[c]]))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = None
        for batch in batches:
            for k_ in range(batch.num_rows):
                row = batch.slice(k_, 1).to_pylist()[0]
                if row["kind"] == 0:
                    shelf = Shelf(row["block"])
                    continue
                grp, idx, slot, value, known, ids = score(shelf, row)
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(idx.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(value), pa.array(ids, mask=known == 0)], ["grp", "idx", "slot", "score", "vec_id"])

    return stream.repartition("shelf").sortWithinPartitions("shelf", "kind", "grp").mapInArrow(run, "grp long, idx int, slot int, score long, vec_id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of every (grp, idx, slot) with their rank from 1."""
    order = Window.partitionBy("grp", "idx", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", modulo: int = 100, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor's positives.

    Components become floor(256 * x); a score is the inner product of two rows of the same number of components. Rows whose
    id is divisible by ``modulo`` are anchors; an anchor's positives are its first other rows of its label, and a positive's
    negatives are the first rows of other labels with window[0] * positive <= window[1] * score <= window[1] * positive
    (so a positive below zero has none). Higher scores come first, ties by smaller id; null ids come last and are no anchors.

    Rows are ordered along the Hilbert curve of their first four bits and cut into blocks of 256 with the least and the
    greatest value of every component. A first pass in the anchor's own block bounds its positives from below; interval
    arithmetic on the zone maps then says which blocks the positives, and after them the windows, must read. Where
    vectors have no order to find (independent components), the bounds leave out little and all blocks are read, in
    work that grows as anchors times rows.

    Rows with a null label, a null vector, a null or non-finite component, or squares that sum to 2^60 or more take no
    part. Rows are told apart by place, so repeated rows count as often as they occur, and a repeated anchor's results
    are repeated. Vectors without components have a score of 0. Other columns are not read; an empty table, or one
    without anchors, gives an empty result. Memory of a task: one shelf (up to 2^17 rows) and one group of 256 anchors.
    """
    low_share, top_share = window
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"))
    rows = materialize(_quantised(rows.filter("v is not null and label is not null and not exists(v, x -> x is null)")), "vectors")
    n = rows.count()
    shelf_rows = min(max(SHELF_ROWS[0], n // 128 // BLOCK * BLOCK), SHELF_ROWS[1])
    order = ["dims", "key", "vec_id", "label"]
    parts = max(1, -(-n // (4 * shelf_rows)))
    shelves = materialize(_shelves(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), shelf_rows), "shelves")
    anchors = materialize(_anchors(shelves, modulo, positives), "anchors")
    near = materialize(_ranked(_read(shelves, anchors, _needed(anchors, shelves, True, low_share, top_share), True, positives, low_share, top_share), positives), "positives")
    tops = near.groupBy("grp").agg(F.collect_list(F.struct("idx", "rank", "score")).alias("near"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for uids, found in zip(batch.column("uids").to_pylist(), batch.column("near").to_pylist()):
                table = np.full((len(uids) // 8, positives), -1, np.int64)
                for x in found:
                    table[x["idx"], x["rank"] - 1] = x["score"]
                cells.append(table.tobytes())
            yield batch.drop_columns(["near"]).append_column("tops", pa.array(cells, pa.binary()))

    asking = materialize(anchors.join(tops, "grp").mapInArrow(fill, _ANCHORS + ", tops binary"), "windows")
    hard = _ranked(_read(shelves, asking, _needed(asking, shelves, False, low_share, top_share), False, negatives, low_share, top_share), negatives)
    named = near.select("grp", "idx", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), grp)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["grp", "idx", "anchor_id"])

    who = anchors.select("grp", "vec_ids").mapInArrow(names, "grp long, idx int, anchor_id long")
    out = hard.withColumnRenamed("score", "negative_score").withColumnRenamed("vec_id", "negative_id").join(named, ["grp", "idx", "slot"]).join(who, ["grp", "idx"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
