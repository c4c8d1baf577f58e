"""Connected components of an edge table, as alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Edges (two longs each) that a task contracts at once; a table of no more is settled by one such step.
CONTRACTED = 1 << 18


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of every component of these edges, with the component's smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[u] != root[v]).any():
        ends = root[u][apart], root[v][apart]
        np.minimum.at(root, np.maximum(*ends), np.minimum(*ends))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(edges: DataFrame) -> DataFrame:
    """The edges of each task, CONTRACTED at a time, as stars around smallest nodes: fewer edges, the same components."""

    def star(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        found = _stars(*(c.to_numpy() for c in rows.columns))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, rows.schema.types)], rows.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CONTRACTED:
                yield star(held)
                held = []
        if held:
            yield star(held)

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` that has a neighbour; component = smallest node reachable.

    Tasks contract their edges to stars, and large-star / small-star rounds (Kiveris et al., 2014) halve the depth of
    every tree, so a chain of n nodes needs about log n rounds. As soon as no more than CONTRACTED edges are left, one
    contraction of them all ends the rounds; components do not depend on where that is. Minima are partial aggregates;
    in the join back, the distinct edges of one node (two numbers each) meet in one task. Self-loops and rows with a null
    end are ignored; an empty table gives an empty result. Each round is cut by a table in the shared folder.
    """
    edges = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(_contract(_contract(edges).distinct()), "cc")
    before = None
    for _ in range(max_rounds):
        mark = _fingerprint(now)
        if mark[0] <= CONTRACTED:
            now = materialize(_contract(now.coalesce(1)), "cc")
            break
        if mark == before:
            break
        before = mark
        now = materialize(_small_star(_large_star(now)), "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.groupBy("a").agg(F.min("b").alias("b"))
    return ends.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        ends.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
