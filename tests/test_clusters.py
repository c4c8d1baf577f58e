"""Clusters of maps of any size by one path, and packs within a budget."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import clustering as K


def points(spark, seed, maps, n, dims=6, spots=12):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(maps):
        centres = rng.normal(size=(spots, dims))
        x = centres[rng.integers(spots, size=n)] + rng.normal(scale=0.25, size=(n, dims))
        rows += [(m, int(i), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "map_id long, id long, embedding array<double>"), rows


def spread(rows, labels):
    """Sum of squared distances to the means of the clusters."""
    total = 0.0
    groups = {}
    for m, i, x in rows:
        groups.setdefault((m, labels[m, i]), []).append(x)
    for g in groups.values():
        g = np.array(g)
        total += ((g - g.mean(0)) ** 2).sum()
    return total, groups


@pytest.mark.parametrize("method", ["ward", "kmeans"])
def test_large_maps_as_good_as_one_task(spark, method):
    concepts, rows = points(spark, 3, 3, 700)
    plan = spark.createDataFrame([(m, 12, 9) for m in range(3)], "map_id long, clusters int, size int")
    one = {(r.map_id, r.id): r.cluster for r in K.cluster_embeddings(concepts, plan, method).collect()}
    many = {(r.map_id, r.id): r.cluster for r in K.cluster_embeddings(concepts, plan, method, map_rows=300).collect()}
    assert one.keys() == many.keys() and len(many) == 2100
    (a, x), (b, y) = spread(rows, one), spread(rows, many)
    assert b < 1.05 * a and len(x) == len(y) == 36
    parts = {(r.map_id, r.id): r.cluster for r in K.cluster_embeddings(concepts, plan, method, split=True, map_rows=300).collect()}
    _, groups = spread(rows, parts)
    assert max(map(len, groups.values())) <= 9 and len(parts) == 2100


def test_more_clusters_than_a_task_tells_apart_and_equal_points(spark):
    concepts, rows = points(spark, 5, 1, 300)
    plan = spark.createDataFrame([(0, 40, 9)], "map_id long, clusters int, size int")
    labels = {(r.map_id, r.id): r.cluster for r in K.cluster_embeddings(concepts, plan, "kmeans", map_rows=100).collect()}
    assert len(labels) == 300 and 30 <= len(set(labels.values())) <= 50
    same = concepts.filter("id < 150").withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    split = K.cluster_embeddings(same, plan, "ward", split=True, map_rows=100).groupBy("cluster").count().collect()
    assert sum(r["count"] for r in split) == 150 and max(r["count"] for r in split) <= 9


def test_packs_within_the_budget_after_a_second_round(spark):
    """Map 0 exceeds four packs with multiplier 0; each round against the same step done by hand."""
    concepts, _ = points(spark, 8, 2, 60, spots=3)
    concepts = concepts.filter("map_id = 0 or id < 20")
    plan = spark.createDataFrame([(0, 5, 0), (1, 5, 0)], "map_id long, size int, mult int")
    got = K.packed_within_budget(concepts, plan)
    rows = [tuple(r) for r in got.collect()]
    assert {r[0]: r[4] for r in rows} == {0: 1, 1: 0} and len(rows) == 80
    for m, mult in ((0, 0), (0, 1), (1, 0)):
        asked = spark.createDataFrame([(m, 4 * 3**mult, 5)], "map_id long, clusters int, size int")
        by_hand = K.pack_small_clusters(K.cluster_embeddings(concepts.filter(F.col("map_id") == m), asked, "ward", split=True))
        packs = {tuple(r) for r in by_hand.collect()}
        fits = len({p[3] for p in packs}) <= 4 * 3**mult
        assert fits == ((m, mult) in ((0, 1), (1, 0)))
        if fits:
            assert packs == {r[:4] for r in rows if r[0] == m}
