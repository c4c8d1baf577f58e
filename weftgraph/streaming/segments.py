"""Tables that streams grow by segments: a batch writes what it brings, readers see the union, small segments are merged by tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import bm25_index, bm25_topk, idf_of

_LOG = "segment string, tier int, kind string"
_POSTINGS = "doc_id long, chunk_id int, term string, tf long, n long"
_LENGTHS = "doc_id long, chunk_id int, n long"


class Segments:
    """Segments below ``root``, a folder that all machines share, and a log of which of them count.

    ``schemas`` names the tables of a segment, ``merge`` makes one segment's tables of several segments' unions. A segment of a batch
    bears the batch's number: a batch that is tried again is found in the log and changes nothing, and one that failed before its
    log entry writes the same folders again. As soon as ``fan`` segments of one tier count, they become one of the next tier,
    under a name made of theirs; one write to the log takes them out and puts it in. So a row is written about log(batches) times,
    a batch writes what it brings and its share of merges, and readers union about fan * log(batches) segments. One writer at a
    time, as a stream has. Folders of merged segments stay, for readers that still use them.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], merge: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], fan: int = 4):
        self.spark, self.root, self.schemas, self.merge, self.fan = spark, root.rstrip("/"), schemas, merge, fan
        self._write([], "ignore")

    def _write(self, rows: list[tuple], mode: str) -> None:
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode(mode).parquet(f"{self.root}/log")

    def _log(self) -> list:
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/log").distinct().collect()

    def live(self) -> dict[str, int]:
        """Names and tiers of the segments that count (their number grows with the logarithm of the batches)."""
        log = self._log()
        gone = {r["segment"] for r in log if r["kind"] == "drop"}
        return {r["segment"]: r["tier"] for r in log if r["kind"] == "add" and r["segment"] not in gone}

    def read(self, table: str, names: list[str] | None = None) -> DataFrame:
        """Rows of all segments that count, or of those named."""
        names = sorted(self.live()) if names is None else names
        reader = self.spark.read.schema(self.schemas[table])
        return reader.parquet(*[f"{self.root}/{n}/{table}" for n in names]) if names else self.spark.createDataFrame([], self.schemas[table])

    def _store(self, name: str, tables: dict[str, DataFrame]) -> None:
        for table, rows in tables.items():
            rows = rows(lambda t: self.read(t, [name])) if callable(rows) else rows
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}/{table}")

    def add(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """Count the tables of batch number ``batch``, once; one may be a function of the reader of those before it, which are written then."""
        name = f"batch-{batch}"
        if not any(r["segment"] == name for r in self._log()):
            self._store(name, tables)
            self._write([(name, 0, "add")], "append")
        while True:
            tiers: dict[int, list[str]] = {}
            for segment, tier in self.live().items():
                tiers.setdefault(tier, []).append(segment)
            full = min((t for t, names in tiers.items() if len(names) >= self.fan), default=None)
            if full is None:
                return
            parts = sorted(tiers[full], key=lambda s: (len(s), s))[: self.fan]
            merged = f"tier-{full + 1}-of-{parts[0]}-to-{parts[-1].split('-to-')[-1]}"
            self._store(merged, self.merge({t: self.read(t, parts) for t in self.schemas}))
            self._write([(p, full, "drop") for p in parts] + [(merged, full + 1, "add")], "append")


# -- keyword index -----------------------------------------------------------------------------------------------------


def index_segments(spark: SparkSession, root: str, fan: int = 4) -> Segments:
    """Segments of postings, chunk lengths and document frequencies."""

    def merge(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        terms = tables["terms"].groupBy("term").agg(F.sum("df").alias("df"))
        return {"postings": tables["postings"], "lengths": tables["lengths"], "terms": terms}

    return Segments(spark, root, {"postings": _POSTINGS, "lengths": _LENGTHS, "terms": "term string, df long"}, merge, fan)


def add_chunks(index: Segments, batch: DataFrame, number: int, stemmed: bool = False) -> None:
    """Index the chunks ``batch(doc_id, chunk_id, tokens)`` as batch ``number``, their stems if so asked; chunks must be new."""
    postings, lengths = bm25_index(batch.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_id").cast("int").alias("chunk_id"), "tokens"), stemmed)
    index.add(number, {"postings": postings, "lengths": lengths, "terms": lambda read: read("postings").groupBy("term").agg(F.count("*").alias("df"))})


def stream_index(chunks: DataFrame, index: Segments, stemmed: bool = False):
    """A stream writer that makes chunks searchable as they arrive; see :func:`add_chunks`. The batch's size is what a batch costs."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            add_chunks(index, held, number, stemmed)
        finally:
            held.unpersist()

    return chunks.writeStream.foreachBatch(write)


def search_index(index: Segments, queries: DataFrame, k: int = 7) -> DataFrame:
    """The ``k`` best chunks of each of ``queries(query_id, tokens)`` in all segments, as :func:`bm25_topk` on the union would give.

    Document frequencies are sums over segments, so postings are read for the queries' terms alone.
    """
    lengths = index.read("lengths")
    terms = index.read("terms").groupBy("term").agg(F.sum("df").alias("df"))
    asked = queries.select(F.explode("tokens").alias("term")).distinct()
    return bm25_topk(queries, index.read("postings").join(asked, "term", "left_semi"), lengths, k, idf_of(terms, lengths))


# -- latest graph ------------------------------------------------------------------------------------------------------


def graph_segments(spark: SparkSession, root: str, fields: dict[str, str], fan: int = 4) -> Segments:
    """Segments of the latest fields of nodes: ``fields`` names them with their types; each has a ``<field>_seq``."""
    schema = "map_id long, id long, " + ", ".join(f"{f} {t}, {f}_seq long" for f, t in fields.items())
    return Segments(spark, root, {"items": schema}, lambda tables: {"items": _latest(tables["items"], list(fields))}, fan)


def _latest(items: DataFrame, fields: list[str]) -> DataFrame:
    """One row a node: of each field the value of the greatest seq that gives it, null where none does."""
    last = lambda f: F.max_by(f, F.when(F.col(f"{f}_seq").isNotNull(), F.col(f"{f}_seq")))
    return items.groupBy("map_id", "id").agg(*[a for f in fields for a in (last(f).alias(f), F.max(f"{f}_seq").alias(f"{f}_seq"))])


def stream_graph(items: DataFrame, graph: Segments, fields: list[str]):
    """A stream writer of patches ``items(map_id, id, seq, given, fields)``: the batch's own latest fields become a segment.

    Items may come in any order and in any batches, and a batch may be tried again: :func:`latest_graph` does not change by it.
    Items with a null seq do not count; a field that is given as null is null. A batch writes what it brings, not the graph.
    """

    def write(batch: DataFrame, number: int) -> None:
        given = batch.filter("seq is not null").select("map_id", "id", *[c for f in fields for c in (F.col(f), F.when(F.array_contains("given", f), F.col("seq")).alias(f"{f}_seq"))])
        graph.add(number, {"items": _latest(given, fields)})

    return items.writeStream.foreachBatch(write)


def latest_graph(graph: Segments, fields: list[str]) -> DataFrame:
    """(map_id, id, fields) of all nodes as they are now."""
    return _latest(graph.read("items"), fields).select("map_id", "id", *fields)
