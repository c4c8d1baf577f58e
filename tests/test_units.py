"""Hand-made cases, traps and invariants."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import cited
from weftgraph.operators import chunking, clustering, concepts, edges, graphs, numbering
from weftgraph.plans import components
from weftgraph.plans.components import _stars, connected_components
from weftgraph.plans.strong import strong_components, tarjan
from weftgraph.sources.html import link_anchors, markdown
from weftgraph.streaming.jobs import rewrite_tokens


def test_html_to_markdown():
    md, title = markdown("<title>T</title><h2>A <b>x</b></h2><p>p <a href='../q'>go</a></p><ul><li>one</li><li>two</li></ul><ol><li>a<li>b</ol><script>no</script>", "https://e.org/d/f")
    assert title == "T"
    assert md.split("\n") == ["## A", "## x", "p", "[go](https://e.org/q)", "- one", "- two", "1. a", "2. b"]
    assert markdown(None, None) == ("", "Untitled Page")


def test_anchors_longest_first():
    assert link_anchors("see big cat, cat", ["cat", "big cat"], ["/c", "/b c"], "https://e.org/") == "see [big cat](https://e.org/b%20c), [cat](https://e.org/c)"


def test_split_text_fits_and_covers():
    rng = random.Random(1)
    for _ in range(100):
        text = "".join(rng.choices("ab \n", weights=[5, 5, 2, 1], k=rng.randint(0, 400)))
        for size, overlap in ((10, 0), (40, 8)):
            pieces = chunking.split_text(text, size, overlap)
            assert all(0 < len(p) <= size for p in pieces)
            assert set("".join(text.split())) == set("".join("".join(pieces).split()))
            if not overlap:
                assert "".join("".join(pieces).split()) == "".join(text.split())


def test_greedy_two_budgets(spark):
    rows = spark.createDataFrame([(1, i, t, n) for i, (t, n) in enumerate([(5, 0), (5, 3), (1, 0), (20, 0), (1, 1)])], "doc_id long, pos int, t int, n int")
    got = chunking.greedy_groups(rows, ["doc_id"], "pos", {"t": 10, "n": 2}).orderBy("pos").collect()
    assert [r.grp for r in got] == [1, 2, 3, 4, 5]


def test_numbers_are_dense(spark):
    df = spark.range(1000).selectExpr("id % 17 AS g", "id")
    got = numbering.number_rows(df, ["g"], ["id"], "n").orderBy("g", "id").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    got = numbering.number_distinct(df, "id", "n", 5).orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_cited_text_traps(spark):
    df = spark.createDataFrame([("alpha ^[1.2]^^[3.4]^ . ^[9]^ tail",)], "t string")
    got = df.select(cited.parse_cited_text(F.col("t")).alias("a")).first().a
    assert [(f.fact, f.source_ids) for f in got] == [("alpha", ["1.2"]), ("tail", ["0.0"])]


def test_names_lose_from_first_underscore(spark):
    df = spark.createDataFrame([(1, 1, "net_income_1", 1), (1, 2, "net", 1)], "map_id long, id long, name string, is_active int")
    roots = spark.createDataFrame([(1, 9)], "map_id long, root long")
    assert concepts.duplicate_groups(df, roots).count() == 1
    assert concepts.duplicate_groups(df, roots, suffix_only=True).count() == 0


@pytest.mark.parametrize("contracted", [1 << 18, 3])
def test_components_match_union_find(spark, monkeypatch, contracted):
    """Both where one contraction ends the rounds and where rounds of stars go on."""
    monkeypatch.setattr(components, "CONTRACTED", contracted)
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()}
    least = {x: x for p in pairs for x in p}
    for _ in range(len(pairs)):
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
        if not changed:
            break
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: least[x] for x in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_keep_components():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 400):
        a, b = rng.integers(-n, n, (2, n))
        root = {int(x): int(x) for x in [*a, *b]}
        for _ in range(len(root)):
            for x, y in zip(a.tolist(), b.tolist()):
                root[x] = root[y] = min(root[x], root[y])
        node, least = _stars(a, b)
        assert dict(zip(node.tolist(), least.tolist())) == {x: r for x, r in root.items() if x != r}
    assert [len(x) for x in _stars(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_strong_components_both_ways(spark):
    rng = random.Random(5)
    pairs = [(1, rng.randrange(40), rng.randrange(40)) for _ in range(55)]
    e = spark.createDataFrame(pairs, "map_id long, origin long, target long")
    n = spark.createDataFrame([(1, i) for i in range(40)], "map_id long, id long")
    want = tarjan(list(range(40)), [(a, b) for _, a, b in pairs])
    for bound in (10**6, 0):
        assert {r.id: r.component for r in strong_components(e, n, bound).collect()} == want


def test_redundant_edges_keep_their_number():
    rows = pd.DataFrame({"map_id": 1, "origin": [1, 2, 3, 1], "target": [2, 3, 1, 3], "weight": [2.0, 2.0, 5.0, 1.0], "type": ["related"] * 4})
    assert edges.mark_redundant(rows)["type"].tolist() == ["related", "related", "related", "artificial"]
    rows = rows.iloc[:2]
    assert edges.mark_redundant(rows)["type"].tolist() == ["related", "related"]


def test_clusters_split_and_ward():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.01, (20, 3)) for c in (0, 5, 9)])
    for f in (clustering.kmeans, clustering.ward):
        labels = f(x, 3)
        assert [len(set(labels[i : i + 20])) for i in (0, 20, 40)] == [1, 1, 1]
    labels = clustering.split_labels(np.zeros((30, 2)), np.zeros(30, int), 7, clustering.kmeans)
    assert np.bincount(labels).max() <= 7 and len(labels) == 30


def test_deleting_twice_changes_nothing(spark):
    fact = "array<struct<fact:string,source_ids:array<string>>>"
    n = spark.createDataFrame([(1, "1", [("f", ["7.1.1"])]), (1, "2", [("f", ["1"]), ("g", ["8.1.1", "7.1.2"])]), (1, "3", [("f", ["1"])])], f"map_id long, id string, answer {fact}")
    e = spark.createDataFrame([(1, "2", "3"), (1, "2", "2")], "map_id long, origin string, target string")
    docs = spark.createDataFrame([(1, "7")], "map_id long, doc string")
    once, kept = graphs.delete_documents(n, e, docs)
    assert [(r.id, r.modified, [(f.fact, f.source_ids) for f in r.answer]) for r in once.collect()] == [("2", 1, [("g", ["8.1.1"])])]
    assert kept.count() == 1
    again, _ = graphs.delete_documents(once.drop("modified"), kept, docs)
    assert [(r.id, r.modified) for r in again.collect()] == [("2", 0)]


def test_stream_rewriting_equals_whole_text():
    text, targets = "a [1] b [2] [1.2.3] ^[4.5.6]^ [x] [99999999999999] [", {1: "t"}
    whole, tail, _ = rewrite_tokens(text, targets)
    for seed in range(50):
        rng, out, held, last, i = random.Random(seed), "", "", "", 0
        while i < len(text):
            n = rng.randint(1, 6)
            new, held, last = rewrite_tokens(text[i : i + n], targets, held, last)
            out, i = out + new, i + n
        assert out + held == whole + tail


def test_latest_graph_does_not_depend_on_order(spark):
    """Late items and several patches of one id, in one batch or in many: of each field the item of the greatest seq counts."""
    from weftgraph.streaming import jobs

    items = [(1, 7, 3, ["name"], "old", None), (1, 7, 9, ["name"], "new", None), (1, 7, 5, ["q"], None, "asked"), (1, 7, 6, ["name", "q"], "mid", None), (1, 8, 1, ["q"], None, "x"), (2, 7, 4, ["name"], None, None), (1, 9, None, ["name"], "lost", None)]
    schema = "map_id long, id long, seq long, given array<string>, name string, q string"
    want = {(1, 7): ("new", None), (1, 8): (None, "x"), (2, 7): (None, None), (3, 1): ("kept", "kept")}
    for cuts in ([items], [items[:1], items[1:]], [[x] for x in items[::-1]]):
        held = {"now": spark.createDataFrame([(3, 1, "kept", "kept")], "map_id long, id long, name string, q string")}

        class Stream:
            def foreachBatch(self, fold):
                for part in cuts:
                    fold(spark.createDataFrame(part, schema), 0)

        stream = type("Items", (), {"writeStream": Stream()})()
        jobs.stream_latest_graph(stream, lambda: held["now"], lambda g: held.update(now=spark.createDataFrame(g.collect(), g.schema)), ["name", "q"])
        assert {(r.map_id, r.id): (r.name, r.q) for r in held["now"].collect()} == want


def test_pieces_end_at_the_text_end_only(spark):
    got = spark.sql("SELECT 'a b c. d e\\n' AS t UNION ALL SELECT 'one.\\n'").select(chunking.split_on_separators(F.col("t"), "[.] ", 2).alias("p")).collect()
    assert sorted(r.p for r in got) == [["a b c.", "d e"], ["one."]]
