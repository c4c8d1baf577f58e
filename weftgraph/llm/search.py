"""Exact BM25 top-k: a kept block-max inverted index in shards, searched by block-max WAND and merged by global statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.storage import materialize
from .bytescan import ALNUM, LOWER, byte_positions, text_chunks, word_hashes, word_spans

K1, B = 1.2, 0.75
#: Contributions are whole millionths, so sums do not depend on their order and ties are exact.
UNIT = 1e6
#: Documents and postings of a shard at most (or one longer document), and documents of a block that shares one upper bound for each term.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_DOCS = 16384, 1 << 22, 32
#: A term that more than one in DENSE documents of a shard hold has its contributions as a row over all of them, as far as DENSE_BYTES go.
DENSE, DENSE_BYTES = 16, 32 << 20
#: Queries whose bounds and scores are found together, and postings of rare terms that are added up at a time.
BATCH_QUERIES, BATCH_POSTINGS = 256, 1 << 16
#: Documents whose rows of common terms are multiplied at a time.
TILE_DOCS = 256
#: Distinct terms of all queries that are searched at once (with repeats between queries): 16 MB.
BLOCK_TERMS = 1 << 22
#: One shard in FIRST_SHARDS at most is searched before the others, where there are twice as many.
FIRST_SHARDS = 8


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of each distinct term of each text, ordered, and each text's number of words."""
    starts, ends, firsts = word_spans(data, offsets, ALNUM)
    terms = word_hashes(LOWER[data], starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    order = np.lexsort((terms, doc))
    doc, terms = doc[order], terms[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(doc)), bool), (np.diff(doc) != 0) | (terms[1:] != terms[:-1])]))
    return doc[new], terms[new], np.diff(np.append(new, len(doc))), np.diff(firsts)


def main_terms(doc: np.ndarray, terms: np.ndarray, tf: np.ndarray, docs: int) -> np.ndarray:
    """The most repeated term of each document, the first of equal ones; 0 without terms."""
    main = np.zeros(docs, np.uint64)
    first = np.searchsorted(doc, np.arange(docs + 1))
    size = np.diff(first)
    some = np.flatnonzero(size)
    if len(some):
        most = np.flatnonzero(tf == np.repeat(np.maximum.reduceat(tf, first[some]), size[some]))
        main[some] = terms[most[np.searchsorted(most, first[some])]]
    return main


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, terms, main) of ``queries(query_id, text)``, ``main`` the most repeated term; queries without words stay out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            doc, terms, tf, length = term_counts(data, offsets)
            firsts = np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(firsts), pa.array(terms.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(main_terms(doc, terms, tf, len(length)).view(np.int64))], ["query_id", "terms", "main"])

    return queries.mapInArrow(run, "query_id long, terms array<long>, main long").filter("size(terms) > 0")


_INDEX = "docs int, words long, ids array<long>, lengths binary, terms binary, counts binary, doc binary, tf binary"


def build_index(docs: DataFrame) -> DataFrame:
    """One row a shard of ``docs(doc_id, text)``: ids, lengths, terms with their numbers of postings, and postings by term.

    Documents of a shard are ordered by their most frequent word, then by length, so that a block's documents are alike
    (of one language, mostly) and its bounds close to its scores. No shuffle; a row has at most SHARD_POSTINGS postings,
    or one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            length = np.concatenate([x[4] for x in held])
            base = np.cumsum([0, *(len(x[4]) for x in held)])
            doc, terms, tf = (np.concatenate(x) for x in ([h[1] + b for h, b in zip(held, base.astype(np.int32))], [h[2] for h in held], [h[3] for h in held]))
            order = np.lexsort((length, main_terms(doc, terms, tf, len(length))))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sort = np.lexsort((place[doc], terms))
            terms = terms[sort]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(terms)), bool), terms[1:] != terms[:-1]]))
            arrays = [
                pa.array([len(length)], pa.int32()), pa.array([int(length.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))),
                *(pa.array([x.tobytes()], pa.binary()) for x in (length[order].astype("<i8"), terms[new].astype("<u8"), np.diff(np.append(new, len(terms))).astype("<i4"), place[doc[sort]].astype("<u2"), tf[sort].astype("<u4"))),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["docs", "words", "ids", "lengths", "terms", "counts", "doc", "tf"])

        size = postings = 0
        for rows, data, offsets in text_chunks(batches):
            doc, terms, tf, length = term_counts(data, offsets)
            if held and (size + len(length) > SHARD_DOCS or postings + len(doc) > SHARD_POSTINGS):
                yield flush()
                held, size, postings = [], 0, 0
            held.append((rows.column(0), doc.astype(np.int32), terms, tf.astype(np.uint32), length))
            size, postings = size + len(length), postings + len(doc)
        if held:
            yield flush()

    return docs.mapInArrow(run, _INDEX)


def _frequencies(index: DataFrame, vocabulary) -> DataFrame:
    """(slot, df): documents that hold each term of a block of queries, from the shards' dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df = np.zeros(len(known), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1)):
                terms, counts = np.frombuffer(terms.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<i4")
                at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                hit = known[at] == terms
                df[at[hit]] += counts[hit]
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], ["slot", "df"])

    tasks = 4 * index.sparkSession.sparkContext.defaultParallelism  # each sums up many shards
    return index.select("terms", "counts").coalesce(tasks).mapInArrow(run, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df"))


class Shard:
    """A shard's contributions to the terms of a block of queries: postings of rare terms, and rows with block maxima for common ones.

    ``slot`` (ascending), ``doc`` and ``gain`` are its postings; documents are in the order of the index's blocks. Rows are cut
    into tiles of TILE_DOCS documents, in single precision, which holds their whole numbers exactly.
    """

    def __init__(self, n: int, slot: np.ndarray, doc: np.ndarray, gain: np.ndarray, terms: int):
        self.n, self.tiles = n, -(-n // TILE_DOCS)
        self.blocks = self.tiles * (TILE_DOCS // BLOCK_DOCS)
        self.skipped = self.scored = 0
        self.first = np.searchsorted(slot, np.arange(terms + 1))
        df = np.diff(self.first)
        common = np.flatnonzero(df * DENSE > n)
        if len(common) > (most := max(1, DENSE_BYTES // (4 * n))):
            common = np.sort(common[np.argsort(-df[common], kind="stable")[:most]])
        if len(common):
            at = byte_positions(self.first[common], df[common])
            common = common[np.maximum.reduceat(gain[at], np.cumsum(df[common]) - df[common]) < 1 << 24]
        self.row = np.full(terms, -1)
        self.row[common] = np.arange(len(common))
        at = byte_positions(self.first[common], df[common])
        dense = np.zeros((self.tiles, len(common), TILE_DOCS), np.float32)
        dense[doc[at] // TILE_DOCS, np.repeat(np.arange(len(common)), df[common]), doc[at] % TILE_DOCS] = gain[at]
        most = dense.reshape(self.tiles, len(common), TILE_DOCS // BLOCK_DOCS, BLOCK_DOCS).max(3)
        self.dense_most = most.transpose(1, 0, 2).reshape(len(common), self.blocks)
        self.dense = []  # each tile's rows that are not empty, and their numbers
        for tile, held in zip(dense, most):
            rows = np.flatnonzero(held.any(1))
            self.dense.append((rows, tile[rows]))
        self.doc, self.gain = doc, np.asarray(gain, float)  # whole numbers below 2**53, so sums are exact
        self.count = np.where(self.row < 0, df, 0)

    def _rare(self, query: np.ndarray, term: np.ndarray, queries: int) -> np.ndarray:
        """What the rare terms of each query add up to in each document."""
        width = self.blocks * BLOCK_DOCS
        out = np.empty((queries, width))
        count = self.count[term]
        first = np.searchsorted(query, np.arange(queries + 1))
        upto = np.append(0, np.cumsum(count))[first]
        begin = 0
        while begin < queries:
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + BATCH_POSTINGS, "right")) - 1)
            part = slice(first[begin], first[end])
            posting = byte_positions(self.first[term[part]], count[part])
            place = self.doc[posting]
            if end - begin > 1:
                place += np.repeat((query[part] - begin) * width, count[part])
            out[begin:end] = np.bincount(place, self.gain[posting], (end - begin) * width).reshape(-1, width)
            begin = end
        return out

    def top(self, query: np.ndarray, term: np.ndarray, queries: int, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of all that can be among the k best, given that k scores of ``least`` are known elsewhere.

        ``query`` (ascending) and ``term`` are the distinct pairs of ``queries`` queries. Rare terms are added up in all documents.
        A query's bound of a block is the greatest of these sums there and the maxima of its common terms. Tiles of the greatest
        bounds come first and, where no threshold is known, raise it; blocks whose bound does not reach it are skipped with their
        rows of common terms, unless they share a tile with one that does. Rows are added up in single precision, and what that
        leaves above the threshold is added up exactly.
        """
        row = self.row[term]
        wanted = np.zeros((queries, len(self.dense_most)), np.float32)
        wanted[query[row >= 0], row[row >= 0]] = 1
        off = 1 - (len(self.dense_most) + 2) * 2.0**-23  # a product and a sum have 24 bits each
        rare = self._rare(query[row < 0], term[row < 0], queries)
        blocks = rare.reshape(queries, self.blocks, BLOCK_DOCS)
        bound = blocks.max(2) + wanted @ self.dense_most
        threshold = np.maximum(least, 1)
        fresh = least < 1
        bound = bound.reshape(queries, self.tiles, -1)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for tile in np.argsort(-bound.max(2).sum(0), kind="stable").tolist():
            alive = bound[:, tile] >= (threshold * off)[:, None]
            self.scored += int(alive.sum())
            self.skipped += alive.size - int(alive.sum())
            some = np.flatnonzero(alive.any(1))
            if not len(some):
                continue
            rows, gains = self.dense[tile]
            score = rare[some, tile * TILE_DOCS : (tile + 1) * TILE_DOCS]
            score += wanted[some[:, None], rows] @ gains
            if k <= TILE_DOCS and (new := fresh[some]).any():
                threshold[some[new]] = np.maximum(threshold[some[new]], np.partition(score[new], -k, 1)[:, -k] * off)
            at = np.flatnonzero(score >= (threshold[some] * off)[:, None])
            found.append((some[at // TILE_DOCS], at % TILE_DOCS + tile * TILE_DOCS, score.ravel()[at]))
        q, doc, score = (np.concatenate(x) for x in zip(*found))
        if fresh.any():
            order = np.lexsort((-score, q))
            q, doc, score = q[order], doc[order], score[order]
            kth = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
            threshold[q[kth]] = np.maximum(threshold[q[kth]], score[kth] * off)
            keep = score >= threshold[q] * off
            q, doc = q[keep], doc[keep]
        score = rare[q, doc]
        tiles = doc // TILE_DOCS
        for tile in np.unique(tiles).tolist():
            rows, gains = self.dense[tile]
            for at in np.array_split(pairs := np.flatnonzero(tiles == tile), len(pairs) // 4096 + 1):
                score[at] += np.einsum("ij,ji->i", wanted[q[at][:, None], rows], gains[:, doc[at] % TILE_DOCS], dtype=float)
        keep = score >= threshold[q]
        return q[keep], doc[keep], score[keep].astype(np.int64)


def _search(index: DataFrame, shared, k: int) -> DataFrame:
    """(query_id, doc_id, score): the k best of each query among each task's shards, as far as they reach its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        for batch in batches:
            for i in range(batch.num_rows):
                if least is None:
                    known, idf, mean, names, firsts, slots, least = shared.value
                    least = least.astype(float)
                n, ids = batch.column("docs")[i].as_py(), batch.column("ids")[i].values
                length, terms, counts, doc, tf = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("lengths", "<i8"), ("terms", "<u8"), ("counts", "<i4"), ("doc", "<u2"), ("tf", "<u4")))
                at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                hit = known[at] == terms
                begin = np.cumsum(counts, dtype=np.int64) - counts
                posting = byte_positions(begin[hit], counts[hit].astype(np.int64))
                slot, doc, tf = np.repeat(at[hit], counts[hit]), doc[posting].astype(np.int64), tf[posting]
                gain = np.rint(UNIT * (idf[slot] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean)))))
                shard = Shard(n, slot, doc, gain, len(known))
                value, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                found = [best]
                for first in range(0, len(names), BATCH_QUERIES):
                    last = min(first + BATCH_QUERIES, len(names))
                    query = np.repeat(np.arange(last - first), np.diff(firsts[first : last + 1]))
                    q, d, s = shard.top(query, slots[firsts[first] : firsts[last]].astype(np.int64), last - first, k, least[first:last])
                    found.append((q + first, s, value[d], null[d]))
                query, score, doc, null = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((doc, ~null, -score, query))
                query, score, doc, null = query[order], score[order], doc[order], null[order]
                nth = np.arange(len(query)) - np.searchsorted(query, query)
                full = query[nth == k - 1]
                least[full] = np.maximum(least[full], score[nth == k - 1])
                best = tuple(x[nth < k] for x in (query, score, doc, null))
        query, score, doc, null = best
        for i in range(0, len(query), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(names[query[part]]), pa.array(doc[part], mask=null[part]), pa.array(score[part])], ["query_id", "doc_id", "score"])

    return index.mapInArrow(run, "query_id long, doc_id long, score long")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): for each query the k documents of ``docs`` with the greatest BM25 score, exactly.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; a query's distinct words
    count once. idf = ln(1 + (N - df + 0.5) / (df + 0.5)), with N, df and the mean length of all rows. Equal scores rank by doc_id
    (null first); only scores above 0 rank. Null and empty texts match nothing; queries without words have no rows;
    several query rows of one id are one query; each row of ``docs`` is a document of its own; other columns are not read.

    The index and the queries' terms are built once, as tables in the shared folder. Queries come in blocks of about BLOCK_TERMS
    terms, those of one main term together, each block broadcast to all shards in place: documents are never shuffled.
    One shard in FIRST_SHARDS, or one a core, is searched first; a query's k-th score there is a threshold that all others start from.
    A task keeps at most k rows a query, from which a window takes the best. One number a term and a query of a block reach the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    queries = query_terms(queries.filter("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")))
    queries = materialize(queries, "bm25-queries")
    index = materialize(build_index(docs), "bm25-index")
    size = index.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count("*").alias("shards")).first()
    n, mean, shards = size["n"], max(size["words"] / max(size["n"], 1), 1e-9), size["shards"]
    every = max(FIRST_SHARDS, shards // spark.sparkContext.defaultParallelism)
    is_first = F.pmod(F.xxhash64("lengths"), F.lit(every)) == 0
    terms = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-terms // BLOCK_TERMS))
    by = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    found = []
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if not part.num_rows:
            continue
        names, owner = np.unique(part["query_id"].to_numpy(), return_inverse=True)
        owner = np.repeat(owner, part["terms"].combine_chunks().value_lengths().to_numpy())
        known, flat = np.unique(part["terms"].combine_chunks().flatten().to_numpy().view(np.uint64), return_inverse=True)
        owner, flat = np.divmod(np.unique(owner * len(known) + flat), len(known))
        counts = _frequencies(index, spark.sparkContext.broadcast(known)).toArrow()
        df = np.zeros(len(known))
        df[counts["slot"].to_numpy()] = counts["df"].to_numpy()
        idf = np.where(df > 0, np.log(1 + (n - df + 0.5) / (df + 0.5)), 0)
        size, main = np.bincount(owner), np.zeros(len(names), np.int64)
        main[np.searchsorted(names, part["query_id"].to_numpy())] = part["main"].to_numpy()
        order = np.lexsort((size, main))  # queries of one main term together, so that they need the same blocks
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        flat = flat[np.argsort(place[owner], kind="stable")].astype(np.int32)
        known_of = (known, idf, mean, names[order], np.append(0, np.cumsum(size[order])), flat)
        least, rest = np.zeros(len(names), np.int64), index
        if shards >= 2 * every:
            first = materialize(_search(index.filter(is_first), spark.sparkContext.broadcast((*known_of, least)), k), "bm25-first")
            found.append(first)
            kth = first.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") == k).select("query_id", "score").toArrow()
            least[place[np.searchsorted(names, kth["query_id"].to_numpy())]] = kth["score"].to_numpy()
            rest = index.filter(~is_first)
        found.append(_search(rest, spark.sparkContext.broadcast((*known_of, least)), k))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    ranked = every.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", (F.col("score") / UNIT).alias("score"))
