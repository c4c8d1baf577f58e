"""Hard negatives against brute force: ties, copies, nulls, non-finite and very large components, lengths, empty tables; and against SQL."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from weftgraph.llm import hardneg, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, grp string, score string, shelf string"


def brute(rows, modulo, k):
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2**60:
            good.append((i, q, label))
    out = Counter()
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for a, (i, v, label) in enumerate(good):
        if i is None or i % modulo:
            continue
        scored = [(j, sum(x * y for x, y in zip(v, w)), other == label) for b, (j, w, other) in enumerate(good) if b != a and len(w) == len(v)]
        for p, top, _ in sorted((x for x in scored if x[2]), key=order)[:k]:
            hard = sorted((x for x in scored if not x[2] and 80 * top <= 100 * x[1] <= 100 * top), key=order)[:k]
            out.update((i, p, r + 1, j, top, s) for r, (j, s, _) in enumerate(hard))
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "GROUP", 3)
    monkeypatch.setattr(hardneg, "SHELF_ROWS", (8, 8) if block == 4 else (64, 64))
    rng = random.Random(block)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.randrange(3)) for i in range(150)]
    rows += [(200 + i, [0.5, 0.5, 0.25, 0.0, -0.5], i % 2) for i in range(40)]  # one vector many times: ties
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0], 1), (302, [1.0, math.nan, 0.0, 0.0, 0.0], 1), (303, [math.inf] * 5, 1), (304, [0.1] * 5, None)]
    rows += [(None, [0.5, 0.5, 0.25, 0.0, -0.5], 1), (None, [0.4] * 5, 2), (310, [1e30] * 5, 1), (320, [400000.0] * 5, 1), (321, [390000.0] * 5, 2), (322, [410000.0] * 5, 1)]
    rows += [(330, [0.1, 0.2], 1), (331, [0.1, 0.2], 2), (332, [0.3, 0.2], 1), (340, [], 1), (341, [], 2), (342, [], 1), (10, rows[10][1], rows[10][2]), (20, [0.2] * 5, 0)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    got = hardneg.mine_negatives(frame, modulo=10)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 10, 5)
    assert hardneg.mine_negatives(frame.limit(0)).count() == 0 and hardneg.mine_negatives(frame.filter("vec_id between 1 and 9"), modulo=10).count() == 0


def test_blocks_are_left_out_where_vectors_have_an_order():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 8))
    rows = np.floor(256 * (np.repeat(centres, 64, axis=0) + rng.normal(scale=0.02, size=(1024, 8)))).astype(np.int64)
    keys = hardneg.hilbert_keys(np.clip((rows >> 5) + 8, 0, 15))
    rows = rows[np.lexsort(keys.T[::-1])]
    low, high = (f.reduceat(rows, np.arange(0, 1024, 32), axis=0) for f in (np.minimum, np.maximum))
    least, most = hardneg._bounds(rows[::100], low, high)
    scores = (rows[::100] @ rows.T).reshape(11, 32, 32)
    assert (least <= scores.min(2)).all() and (scores.max(2) <= most).all()
    fifth = np.sort(rows[::100] @ rows.T, axis=1)[:, -5]
    assert (most >= fifth[:, None]).mean() < 0.3


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hardneg.hilbert_keys(grid, bits=3)
    path = grid[np.lexsort(keys.T[::-1])]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.ORACLES["op11_hard_negatives"])
    got = queries.QUERIES["op11_hard_negatives"](spark, SF)
    assert got.columns == want.columns and Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())
