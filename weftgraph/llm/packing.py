"""Packs documents into sequences of like documents: a sharded BM25 index returns the neighbours that fill a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .bytescan import byte_positions, text_chunks
from .wordcodes import encoder

#: Tokens of a shard, about.
SHARD_TOKENS = 1 << 18
K1, B = 1.2, 0.75
#: Terms that a document draws for its place among the shards (16 bits each); a hash of the row of _TIE_BITS comes after them.
DRAWS, _TIE_BITS = 2, 31
#: Bits of a sequence's number within its task.
_SEQUENCE_BITS = 40


def token_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(row, doc_id, n, ids): each row's token ids, little-endian of two or four bytes, with ``end_id`` last.

    ``row`` is a number of its own for each row, whatever its id; null and empty texts are the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for rows, data, offsets in text_chunks(batches, limit=1 << 19):
            ids, firsts = coder.encode(data, offsets, end_id)
            n = len(firsts) - 1
            flat = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((firsts * coder.dtype.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), rows.column(0), pa.array(np.diff(firsts)), flat], ["row", "doc_id", "n", "ids"])
            row += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "row long, doc_id long, n long, ids binary")


def flat_ids(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column one after another, and where each row's begin (n + 1)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    ids = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype) if len(column) and offsets[-1] > offsets[0] else np.zeros(0, dtype)
    return ids, (offsets - offsets[0]) // np.dtype(dtype).itemsize


def token_counts(ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, tf) of each distinct token of each document but its last id, ordered."""
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    keys = doc << 32 | ids.astype(np.int64)
    keys = np.sort(np.delete(keys, firsts[1:] - 1) if len(firsts) > 1 else keys)
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[new] >> 32, keys[new] & 0xFFFFFFFF, np.diff(np.append(new, len(keys)))


def document_frequencies(tokens: DataFrame, dtype: str) -> DataFrame:
    """(token, df) over all documents. Tasks count in one array of the vocabulary's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            _, token, _ = token_counts(*flat_ids(batch.column(0), dtype))
            if len(token) and token.max() >= len(df):
                df = np.concatenate([df, np.zeros(int(token.max()) + 1 - len(df), np.int64)])
            df += np.bincount(token, minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], ["token", "df"])

    return tokens.select("ids").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def term_lots(vocabulary: int) -> np.ndarray:
    """Each token's exponential lots (DRAWS x vocabulary), the same in every task."""
    return -np.log1p(-np.random.default_rng(20240301).random((DRAWS, vocabulary)))


def _weights(token: np.ndarray, tf: np.ndarray, length: np.ndarray, idf: np.ndarray, mean_length: float) -> np.ndarray:
    return idf[token] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length)))


def lexical_places(ids: np.ndarray, firsts: np.ndarray, idf: np.ndarray, mean_length: float, lots: np.ndarray) -> np.ndarray:
    """The tokens that each document draws, 16 bits each: like documents draw the same ones and so sort together.

    A token is drawn with a chance in proportion to the square of its BM25 weight, by lots that all documents share
    (weighted min-hash), so rare and repeated tokens decide. Documents without weighted tokens get 0.
    """
    doc, token, tf = token_counts(ids, firsts)
    weight = _weights(token, tf, (np.diff(firsts) - 1)[doc], idf, mean_length)
    kept = weight > 0
    doc, token, weight = doc[kept], token[kept], weight[kept]
    out = np.zeros(len(firsts) - 1, np.int64)
    if not len(doc):
        return out
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.append(new, len(doc)))
    for lot in lots:
        value = lot[token] / weight**2
        least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, new), sizes))
        drawn = token[least[np.searchsorted(least, new)]]
        out[doc[new]] = out[doc[new]] << 16 | drawn & 0xFFFF
    return out


def _placed(tokens: DataFrame, dtype: str, shared, mean_length: float) -> DataFrame:
    """``tokens`` with each document's ``key`` in lexical order; rows of equal content are told apart by a hash of ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = term_lots(len(shared.value))
        for batch in batches:
            places = lexical_places(*flat_ids(batch.column("ids"), dtype), shared.value, mean_length, lots)
            keys = places << _TIE_BITS | batch.column("tie").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c) for c in ("row", "doc_id", "n", "ids"))], ["key", "row", "doc_id", "n", "ids"])

    tie = F.xxhash64("row").bitwiseAND(F.lit((1 << _TIE_BITS) - 1)).alias("tie")
    return tokens.select("row", "doc_id", "n", "ids", tie).mapInArrow(run, "key long, row long, doc_id long, n long, ids binary")


class ShardIndex:
    """Inverted index of one shard: for each token the documents that hold it and their BM25 weights.

    idf is max(0, ln((N - df + 0.5) / (df + 0.5))) with N and df of the whole corpus; tokens of weight 0 have no postings.
    """

    def __init__(self, ids: np.ndarray, firsts: np.ndarray, idf: np.ndarray, mean_length: float):
        self.n = len(firsts) - 1
        doc, token, tf = token_counts(ids, firsts)
        weight = _weights(token, tf, (np.diff(firsts) - 1)[doc], idf, mean_length)
        kept = weight > 0
        doc, self.terms, weight = doc[kept], token[kept], weight[kept]
        self.own = np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(self.terms, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(self.terms[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct tokens of one of them."""
        terms = self.terms[self.own[seed] : self.own[seed + 1]]
        at = byte_positions(self.first[terms], self.first[terms + 1] - self.first[terms])
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(ids: np.ndarray, firsts: np.ndarray, idf: np.ndarray, mean_length: float, window: int, sequence: int = 0, used: int = 0) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """(document, start, length, sequence, offset) of every piece, and the last sequence with the tokens in it.

    Packing goes on in ``sequence``, of which ``used`` tokens are taken. A seed's tokens come first; then its best-scored
    unused neighbour, and so on until the window is full. What does not fit of a document opens the next window as its
    seed. Neighbours of equal score, or of none, come in the order given.
    """
    index = ShardIndex(ids, firsts, idf, mean_length)
    size = np.diff(firsts).tolist()
    unused = np.ones(len(size), bool)
    pieces, ahead = [], 0

    def place(d: int) -> None:
        nonlocal sequence, used
        unused[d] = False
        start = 0
        while start < size[d]:
            if used == window:
                sequence, used = sequence + 1, 0
            n = min(window - used, size[d] - start)
            pieces.append((d, start, n, sequence, used))
            start, used = start + n, used + n

    seed = None
    while ahead < len(size):
        if not unused[ahead]:
            ahead += 1
            continue
        if seed is None or used == window:
            seed = ahead
            place(seed)
            opened = sequence
            scores = None
            continue
        if scores is None:
            scores = index.scores(seed)
        best = int(np.argmax(np.where(unused, scores, -1.0)))
        place(best)
        if sequence != opened:
            seed, opened, scores = best, sequence, None
    return pieces, sequence, used


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): pieces of documents, in sequences of ``window`` tokens.

    Every token of every row is in exactly one piece; ``ids`` holds a piece's ids as little-endian unsigned 32-bit
    integers. Shards are lexical: documents are sorted, in ranges, by the tokens that :func:`lexical_places` draws, then by
    a hash of the row, so neither copies nor repeated ids nor equal rows gather. Each range is cut into shards of about
    ``shard_tokens`` tokens (or one longer document) as it is read; a shard's index returns the neighbours, and packing goes
    on in the sequence that the shard before it left open, so one sequence a range is not full. Neighbours that drew other
    tokens are in other shards and not found. Document frequencies, N and the mean length are of all documents; only the
    vocabulary's table (one number a token) reaches the driver. Null and empty texts are the end id alone; rows with a null
    id are packed like others; other columns are not read. An empty table gives an empty result.
    """
    coder = encoder(tokenizer)
    dtype, vocabulary = coder.dtype.str, coder.tokenizer.get_vocab_size()
    tokens = materialize(token_documents(docs, tokenizer, end_id), "tokens")
    size = tokens.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    found = document_frequencies(tokens, dtype).toArrow()
    idf = np.zeros(vocabulary)
    df = found["df"].to_numpy()
    idf[found["token"].to_numpy()] = np.maximum(0, np.log((size["docs"] - df + 0.5) / (df + 0.5)))
    mean_length = max(1.0, size["tokens"] / max(size["docs"], 1) - 1)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequence, used, held, waiting = TaskContext.get().partitionId() << _SEQUENCE_BITS, 0, 0, [], 0

        def shard() -> pa.RecordBatch:
            nonlocal sequence, used
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            rows = rows.take(pa.array(np.lexsort((rows.column("row").to_numpy(), rows.column("doc_id").fill_null(0).to_numpy()))))
            ids, firsts = flat_ids(rows.column("ids"), dtype)
            pieces, sequence, used = pack_shard(ids, firsts, shared.value, mean_length, window, sequence, used)
            d, start, length, number, offset = np.array(pieces, np.int64).T
            cut = ids[byte_positions(firsts[d] + start, length)].astype("<u4")
            ends = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
            flat = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(ends), pa.py_buffer(cut)])
            arrays = [rows.column("doc_id").take(pa.array(d)), pa.array(start), pa.array(length), flat, rows.column("n").take(pa.array(d)), pa.array(base + number), pa.array(offset)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            total = np.cumsum(batch.column("n").to_numpy())
            first = 0
            while first < batch.num_rows:
                before = int(total[first - 1]) if first else 0
                last = min(batch.num_rows, int(np.searchsorted(total, before + shard_tokens - waiting)) + 1)
                held.append(batch.slice(first, last - first))
                waiting += int(total[last - 1]) - before
                first = last
                if waiting >= shard_tokens:
                    yield shard()
                    held, waiting = [], 0
        if held:
            yield shard()

    ordered = _placed(tokens, dtype, shared, mean_length).repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    return ordered.select("row", "doc_id", "n", "ids").mapInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
