"""Ways to a previous node against a plain search, and their place in a sub-graph."""

import random

import pytest

from weftgraph.operators import graphs as G


def test_least_shortest_ways_on_random_graphs(spark):
    rng = random.Random(6)
    edges = [(m, rng.randrange(14), rng.randrange(14)) for m in range(4) for _ in range(18)]
    pairs = [(m, a, b) for m in range(4) for a in range(14) for b in rng.sample(range(16), 3)]
    want = {}
    for m, a, b in pairs:
        level = [(a,)]
        for _ in range(4):
            hits = sorted(p for p in level if p[-1] == b)
            if hits:
                want[m, a, b] = list(hits[0])
                break
            level = [(*p, z) for p in level for z in {y for mm, x, y in edges if mm == m and x == p[-1]} | {x for mm, x, y in edges if mm == m and y == p[-1]} if z not in p]
    frame = spark.createDataFrame(edges, "map_id long, origin long, target long")
    got = G.path_to_previous(frame, spark.createDataFrame(pairs, "map_id long, start long, previous long"), 3)
    assert {(r.map_id, r.start, r.previous): r.path for r in got.collect()} == want and max(map(len, want.values())) == 4


def test_the_way_comes_first_in_a_sub_graph(spark):
    edges = spark.createDataFrame([(1, 0, i, "Manual") for i in range(10, 16)] + [(1, 7, 0, "Generated"), (1, 8, 7, "Init"), (1, 8, 9, "Init")], "map_id long, origin long, target long, type string")
    start = spark.createDataFrame([(1, 0)], "map_id long, start long")
    nodes, tree = G.subgraph(edges, start, 3, 5, previous=spark.createDataFrame([(1, 0, 8)], "map_id long, start long, previous long"))
    assert sorted((r.id, r.depth) for r in nodes.collect()) == [(0, 0), (7, 1), (8, 2), (10, 1), (11, 1)]
    assert {(r.origin, r.target) for r in tree.collect()} == {(0, 7), (7, 8), (0, 10), (0, 11)}


@pytest.mark.parametrize("big", [1 << 31, -1])
def test_ids_that_would_merge_maps_are_an_error(spark, big):
    nodes = spark.createDataFrame([(0, 1, "a"), (0, big, "b")], "map_id long, id long, name string")
    edges = spark.createDataFrame([(0, 1, big)], "map_id long, origin long, target long")
    with pytest.raises(Exception, match="must be in 0"):
        G.tree_check(nodes, edges, spark.createDataFrame([(0, 1)], "map_id long, root long")).collect()
