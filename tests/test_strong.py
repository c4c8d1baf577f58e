"""Strong components the large way: long chains, cycles, chains that a component closes, random graphs against Tarjan's algorithm."""

import random

from weftgraph.plans import strong


def components(spark, edges, nodes):
    e = spark.createDataFrame(edges or [(0, 0, 0)], "map_id long, origin long, target long")
    got = strong.strong_components(e, spark.createDataFrame(nodes, "map_id long, id long"), small_edges=0)
    return {(r.map_id, r.id): r.component for r in got.collect()}


def test_random_graphs(spark):
    rng = random.Random(3)
    edges, nodes, want = [], [], {}
    for m in range(40):
        n = rng.randint(1, 25)
        own = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))}
        order = rng.sample(range(n), n)
        own |= {(order[i], order[i + 1]) for i in range(n - 1) if rng.random() < 0.8}
        if rng.random() < 0.3:
            own |= {(order[-1], order[rng.randrange(n)])}
        own = {(a, b) for a, b in own if a != b}
        nodes += [(m, i) for i in range(n)]
        edges += [(m, a, b) for a, b in own]
        want |= {(m, i): c for i, c in strong.tarjan(list(range(n)), sorted(own)).items()}
    assert components(spark, edges, nodes) == want


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """A path of 100,000 nodes with a cycle of 1,000 behind it: rounds grow with the logarithm of the length."""
    tables, write = [], strong.materialize
    monkeypatch.setattr(strong, "materialize", lambda df, name: (tables.append(name), write(df, name))[1])
    n, ring = 100_000, 1_000
    path = spark.range(n).selectExpr("0L AS map_id", "id AS origin", "id + 1 AS target")
    edges = path.union(spark.range(ring).selectExpr("0L", f"{n} + id", f"{n} + (id + 1) % {ring}"))
    nodes = spark.range(n + ring).selectExpr("0L AS map_id", "id")
    got = strong.strong_components(edges, nodes, small_edges=0)
    assert got.filter(f"component <> least(id, {n})").count() == 0 and got.count() == n + ring
    assert sum(t == "chains" for t in tables) < 20 and len(tables) < 40
