"""Cases of the fourth round's findings."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from weftgraph import catalog
from weftgraph.llm import search
from weftgraph.operators import triggers


def test_tasks_give_out_what_reaches_the_score_of_the_shards_searched_first(spark, monkeypatch):
    """Rows that are dealt do not grow as tasks times queries, and a query's text is taken apart once."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(5, 40)))) for i in range(960)], "doc_id long, text string").repartition(64)
    queries = docs.filter("doc_id % 40 = 0").withColumnRenamed("doc_id", "query_id")
    kept, real = [], search._search

    def seen(*args, **named):
        out = real(*args, **named)
        if "query_id" in out.columns:
            kept.append(out)
        return out

    monkeypatch.setattr(search, "_search", seen)
    held = {c: spark.conf.get(f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes")}
    try:
        for c in held:
            spark.conf.set(f"spark.sql.files.{c}", "1048576")  # a task for each file
        got = search.bm25_topk(docs, queries, 4).collect()
        assert len(got) == 24 * 4
        rows = [x.count() for x in kept]
    finally:
        for c, v in held.items():
            spark.conf.set(f"spark.sql.files.{c}", v)
    assert sum(rows) < 0.5 * 64 * 24 * 4
    monkeypatch.setattr(search, "FIRST_SHARDS", 1000)
    assert sorted(map(tuple, search.bm25_topk(docs, queries, 4).collect())) == sorted(map(tuple, got))


def test_shard_scores_by_tiles_as_one_by_one(monkeypatch):
    """Common terms in tiles, some of them with contributions beyond single precision, and thresholds known or not."""
    rng = np.random.default_rng(10)
    for n, terms, dense in ((700, 50, 16), (300, 20, 2), (40, 9, 10**6), (1, 3, 16)):
        monkeypatch.setattr(search, "DENSE", dense)
        slot, doc = np.nonzero(rng.random((terms, n)) < rng.choice([0.02, 0.3, 0.8], terms)[:, None])
        gain = rng.integers(1, 10**7, len(slot)) * np.where(slot % 5 == 0, 20, 1)
        gain = np.where(slot % 7 == 1, 1_000_000, gain)  # ties
        sums = np.zeros((terms, n), np.int64)
        sums[slot, doc] = gain
        shard = search.Shard(n, slot, doc, gain.astype(float), terms)
        asked = rng.random((30, terms)) < 0.3
        query, term = np.nonzero(asked)
        full = asked.astype(np.int64) @ sums
        for k in (1, 10, 40):
            kth = -np.sort(-full, 1)[:, min(k, n) - 1]
            for least in (np.zeros(30), np.where(np.arange(30) % 2, kth, 0).astype(float)):
                q, d, s = shard.top(query, term, 30, k, least)
                assert (s == full[q, d]).all() and (s >= np.maximum(least[q], 1)).all()
                for i in range(30):
                    want = sorted(zip(-full[i], range(n)))[:k]
                    assert [x for x in sorted(zip(-s[q == i], d[q == i]))[:k]] == [x for x in want if -x[0] >= max(1, least[i])]


def test_questions_go_to_no_more_groups_than_the_cores_need(spark, monkeypatch):
    """Eight groups for four cores are shared out by queries, each group is a task, and the rows stay."""
    rng = np.random.default_rng(11)
    vec = lambda: [float(v) for v in rng.normal(size=3)]
    sizes = {1: 40, 2: 44, 3: 2, 4: 1}
    queries = spark.createDataFrame([(m, q, vec()) for m, n in sizes.items() for q in range(n)], "map_id long, query_id long, embedding array<float>")
    nodes = spark.createDataFrame([(m, n, [("t", vec())]) for m in sizes for n in range(5)], "map_id long, node_id long, questions array<struct<text:string,embedding:array<double>>>")
    dealt, real = [], triggers.materialize

    def seen(df, name):
        out = real(df, name)
        if "groups" in out.columns:
            dealt.append({r.map_id: r.groups for r in out.collect()})
        return out

    monkeypatch.setattr(triggers, "materialize", seen)
    got = triggers.best_nodes(queries, nodes, block=1).withColumn("task", F.spark_partition_id()).collect()
    assert dealt == [{1: 3, 2: 4, 3: 1, 4: 1}] and len(got) == 87 * 5
    tasks = {m: {r.task for r in got if r.map_id == m} for m in sizes}
    assert len(tasks[1] | tasks[2]) == 7 and not tasks[1] & tasks[2]
    monkeypatch.setattr(triggers, "CORE_GROUPS", 0)
    monkeypatch.setattr(triggers, "GROUP_ROWS", 7)
    assert sorted(tuple(r) for r in triggers.best_nodes(queries, nodes).collect()) == sorted(tuple(r)[:-1] for r in got)
    assert dealt[1] == {1: 6, 2: 7, 3: 1, 4: 1}
    assert triggers.best_nodes(queries.limit(0), nodes).count() == 0 and triggers.best_nodes(queries, nodes.limit(0)).count() == 0


def test_halves_are_rounded_as_by_the_sql(spark, tmp_path):
    """Cosines that end in a five at the seventh digit, over which decimal and binary halves fall apart."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3_000_000, 2)).astype(np.float32)
    nine = np.rint(x[:, 0] / np.sqrt((x.astype(float) ** 2).sum(1)) * 1e9).astype(np.int64)
    half = (nine % 1000 == 500) & (nine > 0) & (np.floor(nine / 1e9 * 1e6 + 0.5) < (nine + 500) // 1000)
    found = x[half][:8]
    assert len(found) > 3
    rows = [(0, [1.0, 0.0], 1)] + [(100 * (i + 1), [float(v) for v in e], 1) for i, e in enumerate(found)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["r9_best_trigger"])
    got = catalog.QUERIES["r9_best_trigger"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) == len(rows) ** 2
