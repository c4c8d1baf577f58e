"""Cases of the third round's findings."""

import duckdb
import numpy as np
import pyarrow as pa

from weftgraph import catalog
from weftgraph.functions.text import text_slices
from weftgraph.operators import chunking, clustering, retrieval, triggers, vectors
from weftgraph.sources import documents as D
from weftgraph.sources import html as H
from weftgraph.streaming import segments


def write(spark, path, **tables):
    """A folder of small tables in the given tables' form."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    con = duckdb.connect()
    for name in tables:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return con


def same_as_sql(spark, con, path, name):
    want = con.sql(catalog.ORACLES[name])
    got = sorted(map(str, map(tuple, catalog.QUERIES[name](spark, str(path)).select(*want.columns).collect())))
    assert got == sorted(map(str, want.fetchall()))
    return got


def test_pages_of_one_address_have_indexes_of_their_own(spark, tmp_path):
    pages = [(0, "https://a/"), (1, "https://a/"), (3, "https://a/"), (6, None), (7, None), (12, "https://b/"), (13, "https://c/"), (None, "https://d/")]
    con = write(spark, tmp_path, pages=(pages, "page_id long, url string"))
    assert len(same_as_sql(spark, con, tmp_path, "s9_index_staleness")) == 4
    links = spark.createDataFrame([("x",), ("y",), ("x",)], "link string")
    made = spark.sql("SELECT sha2('x', 256) AS key, 4 AS format_version, 's' AS settings")
    assert [r.link for r in D.stale_links(links, made, 4, "s").collect()] == ["y"]


def test_every_hit_is_looked_up_among_all_documents(spark, tmp_path):
    docs = [(i, "en" if i % 2 else "de") for i in range(7)]
    con = write(spark, tmp_path, documents=(docs, "doc_id long, lang string"), events=([(i,) for i in range(40)], "event_id long"))
    assert len(same_as_sql(spark, con, tmp_path, "r10_chunk_lookup")) == 40
    assert {r.doc_id for r in catalog.QUERIES["r10_chunk_lookup"](spark, str(tmp_path)).collect()} == set(range(7))


def test_best_columns_of_ties_and_nothing():
    rng = np.random.default_rng(5)
    for columns in (1, 3, 4, 40):
        s = rng.choice([-np.inf, np.nan, -1.0, 0.0, 0.5, 0.5], size=(60, columns))
        want = [(i, j) for i in range(60) for j in sorted((j for j in range(columns) if s[i, j] > -np.inf), key=lambda j: (-s[i, j], j))[:4]]
        assert list(zip(*vectors.best_columns(s.copy(), 4))) == want


def test_similarity_does_not_send_vectors_once_a_small_block(spark, tmp_path, monkeypatch):
    """A map of 130 vectors is one block, so one pair of blocks meets and not nine."""
    rng = np.random.default_rng(6)
    rows = [(i * 5, [float(v) for v in rng.normal(size=4)], 1) for i in range(130)]
    con = write(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert len(same_as_sql(spark, con, tmp_path, "e1_similarity")) == 650
    blocks, real = [], vectors._blocked

    def seen(rows, block):
        dealt, sizes = real(rows, block)
        blocks.append(sizes.agg({"blocks": "max"}).first()[0])
        return dealt, sizes

    monkeypatch.setattr(vectors, "_blocked", seen)
    catalog.QUERIES["e1_similarity"](spark, str(tmp_path))
    assert blocks == [1, 1]


def test_texts_are_taken_apart_by_slices(spark):
    texts = ["", None, "x" * 50, "y" * 7, "zz", None, "w" * 9, "é" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["id", "text"])
    slices = list(text_slices(iter([batch, batch.slice(3)]), 1, 20))
    assert [x for s in slices for x in s.column(1).to_pylist()] == texts + texts[3:]
    assert all(s.num_rows == 1 or sum(len((x or "").encode()) for x in s.column(1).to_pylist()) <= 20 for s in slices)
    long = [(i, None if i % 9 == 4 else f"big cat {i} " * (i % 7 * 4000)) for i in range(60)]  # over six million characters
    docs = spark.createDataFrame(long, "id long, text string").coalesce(1)
    got = {(r.id, r.pos): r.piece for r in chunking.recursive_split(docs, id_col="id").collect()}
    assert got == {(i, n): p for i, t in long for n, p in enumerate(chunking.split_text(t))}
    anchors = docs.selectExpr("id", "text", "IF(id % 5 = 2, null, array('cat', 'big cat')) AS link_texts", "array('/c', '/b c') AS link_urls", "'https://e.org/' AS base")
    want = {i: H.link_anchors(t or "", [] if i % 5 == 2 else ["cat", "big cat"], ["/c", "/b c"], "https://e.org/") for i, t in long}
    assert {r.id: r.text for r in H.link_chunk_anchors(anchors).collect()} == want


def test_a_map_of_texts_does_not_meet_in_a_task(spark):
    docs = spark.createDataFrame([(0, i, f"text {i}") for i in range(50)], "map_id long, doc_id long, text string").repartition(5)
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sample = chunking.language_sample(docs)
        assert "BroadcastHashJoin" in sample._jdf.queryExecution().executedPlan().toString() and sample.rdd.getNumPartitions() == 5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    assert sample.count() == 50


def test_tokens_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """Tables of counts that a task holds do not grow with the input; lists without tokens and null ones stay."""
    monkeypatch.setattr(retrieval, "TASK_TOKENS", 50)
    rows = [(i, 0, [f"w{(i * j) % 13}" for j in range(20)]) for i in range(40)] + [(40, 0, []), (41, 0, None)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id int, tokens array<string>")
    assert retrieval.token_tasks(chunks.selectExpr("size(tokens) AS n")) == 16
    postings, lengths = retrieval.bm25_index(chunks)
    assert postings.rdd.getNumPartitions() == 16 and lengths.count() == 42
    assert {(r.doc_id, r.term): r.tf for r in postings.collect()} == {(i, t): ts.count(t) for i, _, ts in rows if ts for t in ts}
    stems = {r.doc_id: r.tokens for r in retrieval.stem_tokens(chunks.select("doc_id", "tokens"), "doc_id").collect()}
    assert stems == {i: ts or [] for i, _, ts in rows}


def test_a_segments_table_may_be_made_of_one_that_is_written(spark, tmp_path):
    index = segments.index_segments(spark, f"file://{tmp_path}/index")
    postings = spark.createDataFrame([(1, 0, "a", 2, 3), (1, 0, "b", 1, 3), (2, 0, "a", 1, 1)], "doc_id long, chunk_id int, term string, tf long, n long")
    index.add(0, {"postings": postings, "terms": lambda read: read("postings").groupBy("term").count().withColumnRenamed("count", "df")})
    assert {(r.term, r.df) for r in index.read("terms").collect()} == {("a", 2), ("b", 1)}


def test_nodes_are_ranked_where_they_are_scored(spark, monkeypatch):
    """Nothing is shuffled after a row for a query and a node is made, whatever is scored and given out at a time."""
    rng = np.random.default_rng(7)
    vec = lambda: None if rng.random() < 0.1 else [float(v) for v in rng.choice([-1.0, 0.0, 0.5, 2.0], size=3)]
    asked = [(m, q, vec()) for m in (1, 2, 3) for q in range(40)]
    cards = [(m, n, [(None if i == 1 else f"{n}.{i}" * n, vec()) for i in range(rng.integers(0, 6))]) for m, many in ((1, 11), (2, 1), (4, 3)) for n in range(many)]
    cosine = lambda a, b: round(float(np.dot(a, b) / ((np.dot(a, a) * np.dot(b, b)) ** 0.5 or 1.0)), 9)
    want = []
    for m, q, e in asked:
        tops = sorted((-max(s for s, _ in found), n, max(found)[1]) for mm, n, qs in cards if mm == m and e and (found := [(cosine(e, x), -i) for i, (_, x) in enumerate(qs) if x]))
        text = {(n, -i): t for mm, n, qs in cards if mm == m for i, (t, _) in enumerate(qs)}
        want += [(m, q, n, -s, text[n, i], at + 1, round(tops[at + 1][0] - s, 9) if at + 1 < len(tops) else 1.0) for at, (s, n, i) in enumerate(tops)]
    queries = spark.createDataFrame(asked, "map_id long, query_id long, embedding array<float>")
    nodes = spark.createDataFrame(cards, "map_id long, node_id long, questions array<struct<text:string,embedding:array<double>>>")
    for rows, text_bytes, block in ((1 << 19, 1 << 26, 128), (25, 1, 7), (4, 40, 1)):
        monkeypatch.setattr(triggers, "ROWS", rows)
        monkeypatch.setattr(triggers, "TEXT_BYTES", text_bytes)
        monkeypatch.setattr(triggers, "BLOCK", block)
        got = retrieval.best_trigger(queries, nodes)
        assert sorted((*tuple(r)[:-1], round(r.margin, 9)) for r in got.collect()) == sorted(want, key=lambda r: r[:3])
        two = triggers.best_nodes(queries, nodes, 2, block).collect()
        assert sorted((*tuple(r)[:4], r.nth, round(r.margin, 9)) for r in two) == sorted((*w[:4], *w[5:]) for w in want if w[5] <= 2)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert len(want) > 300 and not any(word in above for word in ("Join", "Window", "Exchange", "Sort"))


def test_maps_start_with_a_budget_that_can_hold_their_packs(spark, monkeypatch):
    """Budgets under a map's least number of packs are not tried; each of them would have failed. Centres do not go through the driver."""
    rng = np.random.default_rng(8)
    sizes = {0: 200, 1: 150, 2: 30}
    rows = [(m, i, None if i % 10 == 9 else [float(v) for v in rng.normal(size=3)]) for m, n in sizes.items() for i in range(n)]
    concepts = spark.createDataFrame(rows, "map_id long, id long, embedding array<double>")
    plan = spark.createDataFrame([(0, 5, 0), (1, 30, 0), (2, 5, 0), (3, 5, 1)], "map_id long, size int, mult int")
    tried, real = [], clustering.cluster_embeddings

    def seen(rows, asked, *args, **named):
        tried.append({r.map_id: r.mult for r in asked.collect()})
        return real(rows, asked, *args, **named)

    monkeypatch.setattr(clustering, "cluster_embeddings", seen)
    got = clustering.packed_within_budget(concepts, plan).collect()
    assert tried[0] == {0: 2, 1: 1, 2: 0, 3: 1}  # 15, 5 and 3 packs at least
    assert len(got) == sum(n * 9 // 10 for n in sizes.values())
    for m, size, mult in ((0, 5, 0), (0, 5, 1), (1, 30, 0)):
        asked = spark.createDataFrame([(m, 4 * 3**mult, size)], "map_id long, clusters int, size int")
        packs = clustering.pack_small_clusters(real(concepts.filter(f"map_id = {m}"), asked, "ward", split=True))
        assert packs.select("pack").distinct().count() > 4 * 3**mult
    plans, assign = [], clustering._assigned

    def planned(*args):
        out = assign(*args)
        plans.append(out._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(clustering, "_assigned", planned)
    wide = spark.createDataFrame([(0, i, [float(v) for v in rng.normal(size=100)]) for i in range(250)], "map_id long, id long, embedding array<double>")
    clustering._condensed(wide.selectExpr("map_id", "0L AS cell", "id", "embedding", "4L AS k"), 100)
    assert plans and all(p.count("BuildRight") == 2 and "BuildLeft" not in p for p in plans)
