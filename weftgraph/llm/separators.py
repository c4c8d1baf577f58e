"""Token counts of documents in flat token files without an index: separators are searched and joined across blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.storage import materialize
from .bytescan import text_chunks
from .wordcodes import encoder

#: Tokens of a block.
BLOCK_TOKENS = 1 << 16
#: Blocks that one window of the first level of the scan takes.
SUPER_BLOCKS = 1 << 12


def write_token_stream(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Tokenise documents into one flat stream a task: (blocks, order).

    ``blocks(file_id, block_no, tokens)`` cut each stream every ``block_tokens`` ids wherever documents end;
    ``order(file_id, doc_no, doc_id)`` says which document comes when, but not where. Both are one table in the shared
    folder, so a retried task replaces both. Special tokens' names in a text are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, True)
        file_id, block_no, doc_no, held = TaskContext.get().partitionId(), 0, 0, b""
        width = block_tokens * coder.dtype.itemsize

        def rows(kind: str, numbers: list[int], ids: pa.Array, tokens: list) -> pa.RecordBatch:
            n = len(numbers)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.string()), pa.array([file_id] * n, pa.int64()), pa.array(numbers, pa.int64()), ids, pa.array(tokens, pa.binary())], ["kind", "file_id", "no", "doc_id", "tokens"]
            )

        for part, data, offsets in text_chunks(batches, limit=1 << 19):
            held += coder.encode(data, offsets, end_id)[0].tobytes()
            full = len(held) // width
            yield rows("block", list(range(block_no, block_no + full)), pa.nulls(full, pa.int64()), [held[i * width : (i + 1) * width] for i in range(full)])
            held, block_no = held[full * width :], block_no + full
            n = part.num_rows
            yield rows("doc", list(range(doc_no, doc_no + n)), part.column(0), [None] * n)
            doc_no += n
        if held:
            yield rows("block", [block_no], pa.nulls(1, pa.int64()), [held])

    written = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, file_id long, no long, doc_id long, tokens binary")
    written = materialize(written, "token-stream")
    blocks = written.filter("kind = 'block'").select("file_id", F.col("no").alias("block_no"), "tokens")
    return blocks, written.filter("kind = 'doc'").select("file_id", F.col("no").alias("doc_no"), "doc_id")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``blocks`` of raw binary token files; file_id is a hash of the file's path. Spark reads each file (up to 2 GB) as a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = width * block_tokens
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                for no, i in enumerate(range(0, len(raw), step)):
                    yield pa.RecordBatch.from_arrays([pa.array([file_id]), pa.array([no]), pa.array([raw.slice(i, min(step, len(raw) - i)).to_pybytes()])], ["file_id", "block_no", "tokens"])

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file_id"), "content")
    return files.mapInArrow(run, "file_id long, block_no long, tokens binary")


def find_separators(blocks: DataFrame, end_id: int, dtype: str) -> DataFrame:
    """(file_id, block_no, n, ends): a block's tokens, and the positions in it of ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x.as_buffer(), dtype) for x in batch.column(2)]
            ends = [np.flatnonzero(t == end_id).astype(np.int32) for t in tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array(ends, pa.list_(pa.int32()))], ["file_id", "block_no", "n", "ends"])

    return blocks.select("file_id", "block_no", "tokens").mapInArrow(run, "file_id long, block_no long, n long, ends array<int>")


def document_counts(blocks: DataFrame, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file_id, doc_no, start, n_tokens, ended): where each document of each file starts and its ids before the separator.

    Blocks are searched apart. A prefix scan over block summaries then tells each block how many documents ended before
    it and where the last one did, which joins documents that go over any number of blocks. The scan has two levels
    (windows of SUPER_BLOCKS blocks, then of those windows), so one huge file is no single task. Ids after a file's last
    separator are a document with ``ended`` false. Every block but a file's last has ``block_tokens`` ids.
    """
    found = materialize(find_separators(blocks, end_id, dtype), "separators")
    base = F.col("block_no") * block_tokens
    some = F.size("ends") > 0
    brief = found.select(
        "file_id", "block_no", F.floor(F.col("block_no") / SUPER_BLOCKS).alias("part"), "n", F.size("ends").cast("long").alias("count"), F.when(some, base + F.element_at("ends", -1) + 1).alias("reach")
    )
    over = brief.groupBy("file_id", "part").agg(F.sum("count").alias("count"), F.max("reach").alias("reach"))
    up = W.partitionBy("file_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    over = over.select("file_id", "part", F.coalesce(F.sum("count").over(up), F.lit(0)).alias("over_count"), F.coalesce(F.max("reach").over(up), F.lit(0)).alias("over_reach"))
    by = W.partitionBy("file_id", "part").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    scanned = brief.withColumns({"before": F.coalesce(F.sum("count").over(by), F.lit(0)), "open": F.max("reach").over(by)}).join(over, ["file_id", "part"])
    carried = scanned.select("file_id", "block_no", (F.col("before") + F.col("over_count")).alias("first_no"), F.greatest(F.coalesce("open", F.lit(0)), "over_reach").alias("first_start"))
    docs = found.join(carried, ["file_id", "block_no"]).select("file_id", "first_no", "first_start", base.alias("base"), "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("first_start")).otherwise(F.col("base") + F.expr("ends[i - 1]") + 1)
    docs = docs.select("file_id", (F.col("first_no") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    total = brief.groupBy("file_id").agg(F.sum("n").alias("n"), F.sum("count").alias("doc_no"), F.coalesce(F.max("reach"), F.lit(0)).alias("start"))
    rest = total.filter("n > start").select("file_id", "doc_no", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.union(rest)


def count_tokens(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, file_id, start, n_tokens) of every row, by writing a token stream and scanning it for separators.

    Null and empty texts have 0 tokens. Ids may be null or repeat: each row has its own place in the stream.
    """
    blocks, order = write_token_stream(docs, tokenizer, end_id)
    counts = document_counts(blocks, end_id, encoder(tokenizer, True).dtype.str)
    return order.join(counts, ["file_id", "doc_no"]).select("doc_id", "file_id", "start", "n_tokens")
