"""Queries that run a stream over a given table to its end and return what it wrote."""

import uuid

from pyspark.sql import functions as F

from ..plans.storage import materialize, shared_dir
from ..streaming import jobs as T
from ..streaming import segments as S
from .base import ORACLES, query, table
from .search import _chunks, _queries


def _stream(spark, sf, name):
    """The table as a stream of its files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def _finished(spark, stream, schema, mode="append"):
    """All rows that the stream writes; every file is one micro-batch at most, and the last batch stands in complete mode."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query("SELECT event_type AS run, count(*) AS done, CAST(greatest(5, 5 * round_even(100.0 * count(*) / 3000 / 5, 0)) AS INTEGER) AS percent FROM events GROUP BY 1")
def t1_stream_progress(spark, sf):
    totals = table(spark, sf, "events").select(F.col("event_type").alias("run")).distinct().withColumn("total", F.lit(3000))
    stream = T.stream_progress(_stream(spark, sf, "events").select(F.col("event_type").alias("run")), totals)
    return _finished(spark, stream, "run string, done long, percent int", "complete")


@query("SELECT conv_id, turn AS seq, text || ' ^[doc1]^ [2] ^[1.2.3]^' AS text FROM conversations WHERE NOT contains(text, '[')")
def t2_stream_rewrite_refs(spark, sf):
    c = _stream(spark, sf, "conversations").filter("not contains(text, '[')")
    pieces = c.selectExpr("conv_id", "cast(turn as bigint) AS turn", "posexplode(array(text || ' [', '1', '] [2] [1.', '2.3]')) AS (pos, piece)").selectExpr("conv_id", "turn * 4 + pos AS seq", "piece AS text", "pos = 3 AS final")
    done = _finished(spark, T.stream_rewrite_refs(pieces, {1: "doc1"}), "conv_id long, seq long, text string")
    whole = done.groupBy("conv_id", F.expr("seq div 4").alias("seq")).agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("s"), "text"))).getField("text"), "").alias("text"))
    return whole


@query("SELECT user_id % 5 AS map_id, user_id AS id, arg_max(event_type, event_id) AS name FROM events GROUP BY ALL")
def t3_stream_latest_graph(spark, sf):
    held = {"now": spark.createDataFrame([], "map_id long, id long, name string")}
    items = _stream(spark, sf, "events").selectExpr("user_id % 5 AS map_id", "user_id AS id", "event_id AS seq", "array('name') AS given", "event_type AS name")

    def write(graph):
        held["now"] = materialize(graph, "graph")

    state = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    T.stream_latest_graph(items, lambda: held["now"], write, ["name"]).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return held["now"].drop("name_seq")


@query()
def t4_stream_ingest_chunks(spark, sf):
    docs = _stream(spark, sf, "documents").select("doc_id", "text")
    return _finished(spark, T.stream_ingest_chunks(docs), "doc_id long, pos int, piece string")


@query("SELECT user_id % 5 AS map_id, user_id AS id, arg_max(event_type, event_id) AS name, arg_max({'v': CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END}, CASE WHEN event_id % 3 = 0 THEN event_id END).v AS details FROM events GROUP BY ALL")
def t3_stream_graph_segments(spark, sf):
    """The latest name and details of every node, as segments that five batches of events leave."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    events.repartition(5, "event_id").write.parquet(f"{path}/in")
    items = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in").selectExpr(
        "user_id % 5 AS map_id", "user_id AS id", "event_id AS seq", "IF(event_id % 3 = 0, array('name', 'details'), array('name')) AS given", "event_type AS name", "IF(event_id % 7 = 0, null, props) AS details"
    )
    graph = S.graph_segments(spark, f"{path}/graph", {"name": "string", "details": "string"})
    S.stream_graph(items, graph, ["name", "details"]).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return S.latest_graph(graph, ["name", "details"])


@query(ORACLES["r3_bm25_topk"])
def t4_stream_index(spark, sf):
    """The seven best documents of every benchmark text, in the index that five batches of documents leave."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = _chunks(spark, sf)
    docs.repartition(5, "doc_id").write.parquet(f"{path}/in")
    chunks = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    index = S.index_segments(spark, f"{path}/index")
    S.stream_index(chunks, index, stemmed=True).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return S.search_index(index, _queries(spark, sf)).withColumn("score", F.round("score", 5))
