"""Streams that grow tables by segments: batches, retries and merges against the union."""

import os
import random

from pyspark.sql import functions as F

from weftgraph.operators.retrieval import bm25_index, bm25_topk
from weftgraph.plans.storage import shared_dir
from weftgraph.streaming import segments as S


def test_index_of_batches_equals_the_union(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, 0, rng.choices(words, k=rng.randint(0, 25))) for i in range(90)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, chunk_id int, tokens array<string>")
    queries = spark.createDataFrame([(q, rng.choices(words + ["none"], k=4)) for q in range(12)], "query_id long, tokens array<string>")
    index = S.index_segments(spark, f"file://{tmp_path}/index", fan=2)
    assert S.search_index(index, queries).count() == 0
    for batch in range(3):
        S.add_chunks(index, frame(docs[batch * 30 : batch * 30 + 30]), batch)
        assert S.search_index(index, queries).count() > 0
    key = lambda rows: sorted(map(tuple, rows.collect()))
    want = key(bm25_topk(queries, *bm25_index(frame(docs))))
    assert key(S.search_index(index, queries)) == want and sorted(index.live().values()) == [0, 1]
    before = index.live()
    S.add_chunks(index, frame(docs[:30]), 0)  # tried again after its segment was merged
    S.add_chunks(index, frame(docs[60:]), 2)
    assert index.live() == before and key(S.search_index(index, queries)) == want
    S.add_chunks(index, frame([(500, 0, ["new", "w1"])]), 3)
    assert sorted(index.live().values()) == [2]
    assert [r.doc_id for r in S.search_index(index, spark.createDataFrame([(1, ["new"])], "query_id long, tokens array<string>")).collect()] == [500]


def test_graph_of_batches_in_any_order(spark):
    rng = random.Random(2)
    items = [(i % 2, rng.randrange(6), s, rng.choice([["name"], ["q"], ["name", "q"], []]), rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i, s in enumerate(rng.sample(range(400), 60))] + [(0, 1, None, ["name"], "never", 9)]
    schema = "map_id long, id long, seq long, given array<string>, name string, q long"
    want = {}
    for m, i, s, given, name, q in sorted((x for x in items if x[2] is not None), key=lambda x: x[2]):
        node = want.setdefault((m, i), {"name": None, "q": None})
        node |= {f: v for f, v in (("name", name), ("q", q)) if f in given}
    rng.shuffle(items)
    path = f"{shared_dir(spark)}/graph-test-{os.getpid()}"
    spark.createDataFrame(items, schema).repartition(6).write.mode("overwrite").parquet(f"{path}/in")
    graph = S.graph_segments(spark, f"{path}/graph", {"name": "string", "q": "long"}, fan=3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    S.stream_graph(stream, graph, ["name", "q"]).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    now = lambda: {(r.map_id, r.id): {"name": r.name, "q": r.q} for r in S.latest_graph(graph, ["name", "q"]).collect()}
    assert now() == want and sorted(graph.live().values()) == [1, 1]
    written = spark.read.parquet(*[f"{path}/graph/batch-{b}/items" for b in range(6)]).groupBy(F.input_file_name()).count()
    assert max(r["count"] for r in written.collect()) <= 14  # a batch writes its own rows, not the graph's
    S.Segments.add(graph, 3, {"items": graph.read("items")})
    assert now() == want
