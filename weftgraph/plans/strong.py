"""Strong components of many graphs, and of one large graph."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Edges up to which a map's components are found in one task.
SMALL_EDGES = 200_000


def tarjan(nodes: list, edges: list[tuple]) -> dict:
    """Node to the least node of its strong component; iterative, so depth is no limit."""
    after: dict = {n: [] for n in nodes}
    for a, b in edges:
        after[a].append(b)
    index: dict = {}
    low: dict = {}
    on, stack, out, clock = set(), [], {}, 0
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = clock
        clock += 1
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for x in rest:
                if x not in index:
                    index[x] = low[x] = clock
                    clock += 1
                    stack.append(x)
                    on.add(x)
                    work.append((x, iter(after[x])))
                    break
                if x in on:
                    low[node] = min(low[node], index[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        group.append(x)
                        if x == node:
                            break
                    least = min(group)
                    out.update(dict.fromkeys(group, least))
    return out


def _small(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = left["id"].tolist()
        known = set(ids)
        found = tarjan(ids, [(a, b) for a, b in zip(right["origin"], right["target"]) if a in known and b in known])
        return pd.DataFrame({"map_id": left["map_id"], "id": left["id"], "component": [found[i] for i in ids]})

    return nodes.groupBy("map_id").cogroup(edges.groupBy("map_id")).applyInPandas(run, "map_id long, id long, component long")


def _spread(edges: DataFrame, labels: DataFrame, start: str, end: str, rounds: int) -> DataFrame:
    """Least label that reaches each node along edges, until nothing changes."""
    for _ in range(rounds):
        sent = edges.join(labels.withColumnRenamed("id", start), ["map_id", start]).select("map_id", F.col(end).alias("id"), "label")
        new = materialize(labels.union(sent).groupBy("map_id", "id").agg(F.min("label").alias("label")), "labels")
        if not new.join(labels.withColumnRenamed("label", "old"), ["map_id", "id"]).filter("label <> old").limit(1).count():
            return new
        labels = new
    raise RuntimeError("labels did not settle")


def _without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    return rows.join(gone.select("map_id", F.col("id").alias(column)), ["map_id", column], "left_anti")


def _coloured(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """Colouring: the least node that reaches a node is its colour; what reaches that node within its colour is its component."""
    left, rest, done = nodes.select("map_id", "id"), edges.select("map_id", "origin", "target"), None
    while left.limit(1).count():
        colour = _spread(rest, left.withColumn("label", F.col("id")), "origin", "target", rounds)
        named = lambda end: colour.select("map_id", F.col("id").alias(end), F.col("label").alias(f"_{end}"))
        inner = materialize(rest.join(named("origin"), ["map_id", "origin"]).join(named("target"), ["map_id", "target"]).filter("_origin = _target"), "inner")
        seen = colour.filter("id = label").select("map_id", "id", "label")
        while True:
            more = inner.join(seen.withColumnRenamed("id", "target"), ["map_id", "target"]).filter("_target = label").select("map_id", F.col("origin").alias("id"), "label")
            new = materialize(seen.union(more).distinct(), "reached")
            if new.count() == seen.count():
                break
            seen = new
        found = seen.select("map_id", "id", F.col("label").alias("component"))
        done = found if done is None else done.union(found)
        left = materialize(left.join(found, ["map_id", "id"], "left_anti"), "left")
        for end in ("origin", "target"):
            rest = _without(rest, found, end)
        rest = materialize(rest.select("map_id", "origin", "target"), "rest")
    return done if done is not None else left.withColumn("component", F.col("id"))


def _contract(rest: DataFrame, least_share: float) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]] | None:
    """Edges without the nodes that have one way out, those nodes, and what finds their components once the others' are known.

    From a node with one edge out all ways lead to the same first node that is not such, its end: pointers doubled as
    often as the longest chain has bits find it. Edges to a chain then lead to its end. Chains that never end run into a
    cycle, which is a component, as no edge leaves it; the rest of such a chain are components of one node. A node of a
    chain belongs to its end's component if what enters the chain at or before the node comes from that component; that
    mark runs down the chain along the same pointers. None where fewer than ``least_share`` of the nodes are such.
    """
    ways = rest.groupBy("map_id", F.col("origin").alias("id")).agg(F.count("*").alias("n"), F.min("target").alias("next"))
    ways = materialize(ways, "ways")
    single = ways.filter("n = 1").select("map_id", "id", "next")
    many = single.count()
    if not many or many < least_share * ways.count():
        return None
    known = single.select("map_id", F.col("id").alias("next"), F.col("id").alias("ptr"))
    now = single.join(known, ["map_id", "next"], "left").select("map_id", "id", "ptr", F.when(F.col("ptr").isNull(), F.col("next")).alias("end"), F.col("id").alias("low"))
    now, jumps = materialize(now, "chains"), []
    for _ in range(many.bit_length()):
        if not now.filter("ptr is not null").limit(1).count():
            break
        jumps.append(now.filter("ptr is not null").select("map_id", "id", "ptr"))
        far = now.select("map_id", F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("end").alias("_end"), F.col("low").alias("_low"))
        now = now.join(far, ["map_id", "ptr"], "left").select("map_id", "id", F.col("_ptr").alias("ptr"), F.coalesce("end", "_end").alias("end"), F.least("low", "_low").alias("low"))
        now = materialize(now, "chains")
    on_cycle = now.filter("ptr is not null").select("map_id", F.col("ptr").alias("id"), F.lit(True).alias("_on")).distinct()
    settled = now.filter("end is null").join(on_cycle, ["map_id", "id"], "left").select("map_id", "id", F.when(F.col("_on"), F.col("low")).otherwise(F.col("id")).alias("component"))
    chained = now.filter("end is not null").select("map_id", "id", "end")
    outer = _without(rest, single, "origin")
    entries = materialize(outer.join(chained.withColumnRenamed("id", "target"), ["map_id", "target"]).select("map_id", F.col("target").alias("id"), "origin", "end"), "entries")
    kept = _without(outer, single, "target").select("map_id", "origin", "target").union(entries.select("map_id", "origin", F.col("end").alias("target")))

    def resolve(known: DataFrame) -> DataFrame:
        of = lambda column, name: known.select("map_id", F.col("id").alias(column), F.col("component").alias(name))
        good = entries.join(of("origin", "a"), ["map_id", "origin"]).join(of("end", "b"), ["map_id", "end"]).filter("a = b").select("map_id", "id").distinct()
        good = materialize(good, "marks")
        if good.limit(1).count():
            for jump in jumps:
                good = materialize(good.union(good.join(jump, ["map_id", "id"]).select("map_id", F.col("ptr").alias("id"))).distinct(), "marks")
        mine = chained.join(of("end", "b"), ["map_id", "end"]).join(good.withColumn("_good", F.lit(True)), ["map_id", "id"], "left")
        mine = mine.select("map_id", "id", F.when(F.col("_good"), F.col("b")).otherwise(F.col("id")).alias("component"))
        return known.union(mine).union(settled)

    return materialize(kept.filter("origin <> target").distinct(), "contracted"), single.select("map_id", "id"), resolve


def _large(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """Chains in both directions go first, as long as they are an eighth of the nodes; what is left is coloured."""
    left, rest = nodes.select("map_id", "id"), edges.select("map_id", "origin", "target")
    swap = lambda e: e.select("map_id", F.col("target").alias("origin"), F.col("origin").alias("target"))
    undo, idle, back = [], 0, False
    while idle < 2:
        found = _contract(swap(rest) if back else rest, 0.125)
        if found:
            rest, gone, resolve = found
            rest, left = swap(rest) if back else rest, materialize(_without(left, gone, "id"), "left")
            undo.append(resolve)
        idle, back = 0 if found else idle + 1, not back
    known = _coloured(rest, left, rounds)
    for resolve in reversed(undo):
        known = materialize(resolve(known), "known")
    names = known.groupBy("map_id", "component").agg(F.min("id").alias("least"))
    return known.join(names, ["map_id", "component"]).select("map_id", "id", F.col("least").alias("component"))


def strong_components(edges: DataFrame, nodes: DataFrame, small_edges: int = SMALL_EDGES, rounds: int = 10_000) -> DataFrame:
    """(map_id, id, component): component is the least id of the node's strong component.

    Maps of up to ``small_edges`` edges are one task's work each. In larger ones chains of nodes with one way out, or one way
    in, are contracted by pointer doubling, in rounds that grow with the logarithm of their length, and the rest is coloured
    by joins, one round a hop. The result is the same either way. Edges whose ends are not nodes do not count.
    """
    nodes = nodes.select(F.col("map_id").cast("long").alias("map_id"), F.col("id").cast("long").alias("id")).distinct()
    edges = edges.select(F.col("map_id").cast("long").alias("map_id"), F.col("origin").cast("long").alias("origin"), F.col("target").cast("long").alias("target")).filter("origin <> target")
    large = edges.groupBy("map_id").agg(F.count("*").alias("n")).filter(F.col("n") > small_edges).select("map_id")
    out = _small(edges.join(large, "map_id", "left_anti"), nodes.join(large, "map_id", "left_anti"))
    if large.limit(1).count():
        ids = nodes.join(large, "map_id", "left_semi")
        valid = edges.join(large, "map_id", "left_semi")
        for end in ("origin", "target"):
            valid = valid.join(ids.withColumnRenamed("id", end), ["map_id", end], "left_semi")
        out = out.union(_large(materialize(valid.select("map_id", "origin", "target"), "large-edges"), ids, rounds))
    return out
