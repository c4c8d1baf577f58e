"""SimHash fingerprints and near-duplicate components by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.storage import materialize
from .bytescan import LOWER, SPACE, gram_hashes, mix, text_chunks, word_hashes, word_spans
from .idset import prefilter

#: Near copies: words of a shingle, least Jaccard similarity, fingerprints of words, and bits in which two texts'
#: fingerprints of shingles may differ before they are compared exactly.
COPY_WORDS, SIMILAR, WORD_PRINTS, LOOSE_BITS = 5, 0.8, 3, 20
#: Groups of so many texts are compared in pairs; larger ones with a central text, in so many rounds, and
#: what is left in blocks of so many texts. Distances to a central text are told apart in so many steps.
ALL_PAIRS, CENTRES, BLOCK, BINS = 64, 1, 256, 50

#: Variants that one numpy step may hold; larger groups are cut by further bits of the variant.
STEP_VARIANTS = 2_000_000


def simhash(text: bytes, shingle: int) -> int:
    """Majority vote over the bits of XXH64 (seed 42) of the shingles, as an unsigned integer; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    h = np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        votes += np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every row, fp a signed long with the fingerprint's bits. No shuffle.

    A-Z is lower-cased, words are runs of anything but ASCII white space, shingles count with repeats. Texts with
    fewer words than a shingle use the whole sequence; null or empty texts get 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            raw = data.tobytes()
            found = np.fromiter((simhash(raw[i:j], shingle) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint64, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, radius: int) -> list[int]:
    """All words of ``bits`` bits with at most ``radius`` ones."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _collide(low: np.ndarray, who: np.ndarray, left: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (first of a bucket, another of it), and neighbours in a bucket, over all variants of the lower ``bits`` bits.

    ``left`` is how many flips each fingerprint has left. Buckets get a star and a chain each, never all pairs.
    """
    sizes = np.array([sum(math.comb(bits, i) for i in range(r + 1)) for r in range(int(left.max(initial=0)) + 1)])
    if len(low) < 2:
        return
    if sizes[left].sum() > STEP_VARIANTS and bits > 8:
        rest = bits - 4
        top = (low >> np.uint64(rest)).astype(np.int64)
        for value in range(16):
            after = left - np.bitwise_count(top ^ value)
            keep = after >= 0
            yield from _collide(low[keep] & np.uint64((1 << rest) - 1), who[keep], after[keep], rest)
        return
    variants, owners = [], []
    for r in range(len(sizes)):
        if (own := left == r).any():
            masks = np.array(_masks(bits, r), np.uint64)
            variants.append((low[own][:, None] ^ masks).ravel())
            owners.append(np.repeat(who[own], len(masks)))
    v, w = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v, kind="stable")
    v, w = v[order], w[order]
    same = np.flatnonzero(v[1:] == v[:-1]) + 1
    begins = np.concatenate([[True], v[1:] != v[:-1]])
    head = np.maximum.accumulate(np.where(begins, np.arange(len(v)), 0))[same]
    yield w[head], w[same]
    chain = head != same - 1
    yield w[same[chain] - 1], w[same[chain]]


def _link_group(fps: np.ndarray, prefix: int, top_bits: int, radius: int, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the fingerprints that share a variant with this prefix: (fingerprint, its group's first), by number.

    ``check``: further fingerprints, of which linked ones may differ in LOOSE_BITS bits.
    """
    bits = 64 - top_bits
    left = radius // 2 - np.bitwise_count((fps >> np.uint64(bits)).astype(np.int64) ^ prefix).astype(np.int64)
    label = np.arange(len(fps))
    seen = [np.zeros(0, np.int64)]
    for a, b in _collide(fps & np.uint64((1 << bits) - 1), np.arange(len(fps)), left, bits):
        near = (np.bitwise_count(fps[a] ^ fps[b]) <= radius) & (a != b)
        if check is not None:
            near &= np.bitwise_count(check[a] ^ check[b]) <= LOOSE_BITS
        seen.append(np.unique(np.minimum(a, b)[near] * len(fps) + np.maximum(a, b)[near]))
    pairs = np.unique(np.concatenate(seen))
    a, b = pairs // max(len(fps), 1), pairs % max(len(fps), 1)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return moved, label[moved]


def _sent(fps: DataFrame, radius: int, bits: int) -> DataFrame:
    """``fps`` once for each ``bits``-bit ``prefix`` that a variant of its ``fp`` within half the radius has."""
    masks = F.array(*[F.lit(m) for m in _masks(bits, radius // 2)])
    prefix = F.shiftrightunsigned("fp", 64 - bits).cast("long").bitwiseXOR(F.col("mask")).alias("prefix")
    return fps.select("*", F.explode(masks).alias("mask")).select(prefix, *fps.columns)


def _prefix_bits(n: int) -> int:
    return max(10, math.ceil(math.log2(max(2, n) / 256)))


def ball_links(fps: DataFrame, radius: int = 4, prefix_bits: int | None = None) -> DataFrame:
    """Edges (a, b) that join every two distinct fingerprints of ``fps(fp)`` with at most ``radius`` differing bits.

    Two words at distance <= radius have a common variant at distance <= radius/2 of each (radius even). Every
    fingerprint is sent to each ``prefix_bits``-bit prefix that one of its variants has (56 copies of 8 bytes with
    10 bits) and its variants below that prefix are listed only in the task that owns the prefix, so the shuffle
    carries fingerprints and not the 2,081 variants of each. Within a prefix, colliding fingerprints are deduplicated,
    verified and reduced to a spanning forest: no pairs within a bucket are listed, yet every link's two ends stay
    connected. Rows must be distinct, so copies cost nothing, and a bucket holds at most 2,081 fingerprints.
    """
    if radius % 2 or not 2 <= radius <= 6:
        raise ValueError("radius must be 2, 4 or 6")
    bits = prefix_bits or _prefix_bits(fps.count())

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(rows["fp"].to_numpy().view(np.uint64))
        a, b = _link_group(fps, int(key[0]), bits, radius)
        return pd.DataFrame({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    return _sent(fps.select("fp"), radius, bits).groupBy("prefix").applyInPandas(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of <= ``radius`` bits.

    Equal fingerprints are linked first, by grouping, so a group of copies of any size is one row from there on; the
    fingerprint 0 of texts without words is linked like any other. Rows repeat as often as in ``docs``. Rows with a
    null id keep their fingerprint and take part in links; they never name a component unless it has no other id.
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fp")
    classes = connected_components(ball_links(distinct.select("fp"), radius))
    placed = distinct.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    placed = materialize(placed, "simhash-class")
    named = materialize(placed.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-name")
    placed = materialize(placed.join(named, "component").select("fp", "component_id"), "simhash-id")
    return marked.join(placed, "fp").select("doc_id", "fp", "component_id")


def _votes(hashes: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each of ``n`` owners: a bit is set where the weights of its hashes with that bit are more than half."""
    votes = np.zeros((n, 64), np.float32)
    for i in range(0, len(hashes), 1 << 14):
        part = slice(i, i + (1 << 14))
        bits = np.unpackbits(hashes[part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        new = np.flatnonzero(np.concatenate([[True], owner[part][1:] != owner[part][:-1]]))
        votes[owner[part][new]] += np.add.reduceat((2 * bits - 1) * weight[part, None].astype(np.float32), new, axis=0)
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").ravel()


def _shingles(words: np.ndarray, first: int, last: int, grams: np.ndarray) -> np.ndarray:
    """Distinct hashes of the COPY_WORDS-word shingles of one text; fewer words are one shingle, none are none."""
    if last - first >= COPY_WORDS:
        return np.unique(grams[first : last - COPY_WORDS + 1])
    return gram_hashes(words[first:last], last - first) if last > first else np.zeros(0, np.uint64)


def copy_prints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """WORD_PRINTS SimHashes of each text's words (weights: square roots of their numbers), and one of its shingles.

    A-Z is lower-cased. Of texts with a similarity of 0.8 on five-word shingles, few words differ, so the words' prints
    differ in 3 bits or so where the shingles' differ in 10.
    """
    starts, ends, firsts = word_spans(data, offsets, ~SPACE)
    words = word_hashes(LOWER[data], starts, ends)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(firsts))
    grams = gram_hashes(words, COPY_WORDS)
    inside = owner[: len(grams)] == owner[COPY_WORDS - 1 :] if len(grams) else np.zeros(0, bool)
    check = _votes(grams[inside], np.ones(int(inside.sum())), owner[: len(grams)][inside], n)
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(words)), bool), (owner[1:] != owner[:-1]) | (words[1:] != words[:-1])]))
    weight = np.sqrt(np.diff(np.append(new, len(words))))
    prints = [_votes(mix(words[new] ^ np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), weight, owner[new], n) for i in range(WORD_PRINTS)]
    return np.stack([*prints, check], 1)


def _copy_candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between ``nodes(node, p0, p1, ..., check)``: ball hashing of each word print, held against the shingles' print."""
    bits, links = _prefix_bits(nodes.count()), None

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        node = rows["node"].to_numpy()
        a, b = _link_group(rows["fp"].to_numpy().view(np.uint64), int(key[0]), bits, 4, rows["check"].to_numpy().view(np.uint64))
        return pd.DataFrame({"a": node[a], "b": node[b]})

    for i in range(WORD_PRINTS):
        found = _sent(nodes.select(F.col(f"p{i}").alias("fp"), "node", "check"), 4, bits).groupBy("prefix").applyInPandas(link, "a long, b long")
        links = found if links is None else links.union(found)
    return links.distinct()


def _shingle_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, component, size, check, shingles) of ``members(node, pick, component, size, check)``, from one row of ``docs(pick, text)`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            starts, ends, firsts = word_spans(data, offsets, ~SPACE)
            words = word_hashes(LOWER[data], starts, ends)
            grams = gram_hashes(words, COPY_WORDS)
            sets = [_shingles(words, a, b, grams) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            ends_of = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends_of), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("node", "component", "size", "check")), lists], ["node", "component", "size", "check", "shingles"])

    rows = prefilter(docs, members.select("pick"), "pick").dropDuplicates(["pick"])
    return rows.join(members, "pick").select("node", "component", "size", "check", "text").mapInArrow(run, "node long, component long, size long, check long, shingles array<long>")


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, True))
    return both / max(1, len(a) + len(b) - both)


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    return min(len(a), len(b)) >= SIMILAR * max(len(a), len(b)) and _similarity(a, b) >= SIMILAR


def _in_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) of the alike among ``rows(node, shingles[, block])``; with two blocks, of those between the two.

    Texts that are connected already are not compared again.
    """
    rows = rows.drop_duplicates("node").sort_values("node")
    node, own = rows["node"].to_numpy(), [np.sort(x) for x in rows["shingles"]]
    block = rows["block"].to_numpy() if "block" in rows else np.zeros(len(node), np.int64)
    within, label, found = len(set(block)) < 2, np.arange(len(node)), []
    for i in range(len(node)):
        for j in range(i):
            if label[i] != label[j] and (within or block[i] != block[j]) and _alike(own[i], own[j]):
                label[label == label[i]] = label[j]
                found.append((node[i], node[j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _compared(left: DataFrame) -> DataFrame:
    """(node, component, check, shingles, centre, alike, bin): each of ``left`` against its group's central text.

    That is the one whose print of shingles is nearest to the majority of the group's; ``bin`` is the distance in BINS-ths.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = batch.column("shingles"), batch.column("centre_shingles")
            like = np.array([_similarity(own[i].values.to_numpy(), other[i].values.to_numpy()) for i in range(batch.num_rows)])
            columns = [batch.column(c) for c in ("node", "component", "check", "shingles", "centre")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(like >= SIMILAR), pa.array(((1 - like) * BINS).astype(np.int32))], names)

    names = ["node", "component", "check", "shingles", "centre", "alike", "bin"]
    votes = left.select("component", "check", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    votes = votes.groupBy("component", "bit").agg(F.expr("sum((shiftright(check, bit) & 1) * 2 - 1) > 0").alias("most"))
    majority = votes.groupBy("component").agg(F.expr("bit_or(if(most, shiftleft(1L, bit), 0L))").alias("most"))
    apart = F.bit_count(F.col("check").bitwiseXOR(F.col("most")))
    nearest = F.min(F.struct(apart.alias("apart"), "node", "shingles")).alias("best")
    centre = left.join(materialize(majority, "copy-majority"), "component").groupBy("component").agg(nearest)
    centre = materialize(centre.select("component", F.col("best.node").alias("centre"), F.col("best.shingles").alias("centre_shingles")), "copy-centre")
    rows = left.join(centre, "component").filter("node <> centre")
    schema = "node long, component long, check long, shingles array<long>, centre long, alike boolean, bin int"
    return materialize(rows.select("node", "component", "check", "shingles", "centre", "centre_shingles").mapInArrow(compare, schema), "copy-compared")


def _undecided(found: DataFrame) -> DataFrame:
    """(node, component, size, check, shingles) of the texts whose links their central text leaves open, in smaller groups.

    Jaccard distance is a metric: texts can only be alike if their distances to the central text differ by at most
    1 - SIMILAR. So what is alike to the central text is done unless a text that is not lies within that reach, and groups
    part where no text's distance lies in a gap of that width. Distances count in bins, at most BINS + 1 a group.
    """
    reach = math.ceil((1 - SIMILAR) * BINS) + 1
    bins = found.groupBy("component").agg(F.collect_set("bin").alias("bins"), F.expr("collect_set(bin) filter (where not alike)").alias("open"))
    bins = bins.select("component", F.expr(f"array_sort(filter(bins, b -> exists(open, o -> abs(o - b) <= {reach})))").alias("bins"))
    rows = found.join(materialize(bins, "copy-bins"), "component").filter("array_contains(bins, bin)")
    band = F.expr(f"size(filter(bins, (b, i) -> b <= bin and b - get(bins, i - 1) > {reach}))")
    rows = materialize(rows.select("node", F.xxhash64("component", band).alias("component"), "check", "shingles"), "copy-left")
    size = rows.groupBy("component").agg(F.count("*").alias("size"))
    return rows.join(size, "component").select("node", "component", "size", "check", "shingles")


def _in_blocks(left: DataFrame) -> DataFrame:
    """Edges (a, b) of the alike in ``left``'s groups: BLOCK texts or so against as many a task, so no task holds a group."""
    blocks = F.ceil(F.col("size") / BLOCK)
    rows = left.select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("node", "component"), blocks).alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "component", "shingles", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    return rows.groupBy("component", "p", "q").applyInPandas(_in_pairs, "a long, b long")


def _verified(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what is connected by a Jaccard similarity of SIMILAR or more of shingles in a candidate group.

    Groups of up to ALL_PAIRS texts are compared in pairs, as long as they are apart. In larger ones each text is compared
    with a central one, and what that leaves open goes on in smaller groups, for at most CENTRES rounds. Groups that are
    still larger then are compared in blocks, at a cost that grows with the square of such a group. No link is lost at any size.
    """
    edges = sets.filter(F.col("size") <= ALL_PAIRS).groupBy("component").applyInPandas(_in_pairs, "a long, b long")
    left = sets.filter(F.col("size") > ALL_PAIRS)
    for _ in range(CENTRES):
        if not left.limit(1).count():
            return edges
        found = _compared(left)
        edges = edges.union(found.filter("alike").select(F.col("node").alias("a"), F.col("centre").alias("b")))
        rest = materialize(_undecided(found), "copy-open")
        edges = edges.union(rest.filter(F.col("size") <= ALL_PAIRS).groupBy("component").applyInPandas(_in_pairs, "a long, b long"))
        left = rest.filter(F.col("size") > ALL_PAIRS)
    return edges.union(_in_blocks(left))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest doc_id.

    Texts are near copies if their sets of COPY_WORDS-word shingles (A-Z lower-cased) have a Jaccard similarity of SIMILAR or
    more; groups are linked texts. Candidates are texts of which one of WORD_PRINTS SimHashes of words differs in at most
    4 bits, found by ball hashing, and every link is verified on the texts' shingles. Equal texts (told apart by 64-bit
    hashes) are one text from the start, so a group of copies of any size is one row in all later steps.

    Null and empty texts are equal, and one row of them stays. Rows that repeat with one id and text count once. Rows with
    a null id take part and stay only where a group has no other. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            prints = copy_prints(data, offsets).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("node"), *(pa.array(np.ascontiguousarray(p)) for p in prints.T)], names)

    prints = [*(f"p{i}" for i in range(WORD_PRINTS)), "check"]
    names = ["doc_id", "node", *prints]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))
    marked = materialize(own.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "copy-prints")
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.min(p).alias(p) for p in prints))
    nodes = materialize(nodes.withColumn("pick", F.xxhash64("node", "least")), "copy-nodes")
    classes = connected_components(_copy_candidates(nodes)).withColumnRenamed("component", "candidate")
    size = materialize(classes.groupBy("candidate").agg(F.count("*").alias("size")), "copy-sizes")
    members = classes.join(size, "candidate").withColumnRenamed("candidate", "component").join(nodes.select("node", "pick", "check"), "node")
    members = materialize(members, "copy-members")
    sets = materialize(_shingle_sets(own.select("text", F.xxhash64("node", "doc_id").alias("pick")), members), "copy-shingles")
    groups = connected_components(_verified(sets))
    placed = nodes.select("node", "least").join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    kept = materialize(placed.groupBy("component").agg(first.alias("k")).select(F.col("k.least").alias("_id"), F.col("k.node").alias("_node")), "copy-kept")
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_node")), "left_semi")
    if marked.groupBy("doc_id", "node").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        joined = joined.withColumn("_node", F.xxhash64(text)).dropDuplicates(["doc_id", "_node"]).drop("_node")
    return joined.select(docs.columns)
