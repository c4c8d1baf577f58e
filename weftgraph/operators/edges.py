"""Edge enhancement: root edges, least degrees, connectivity, redundancy and defaults."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .concepts import dedup_edges_keep_max
from .vectors import top_similar

#: Weights by kind of edge, and thresholds.
ROOT, OTHER_ROOT, BRIDGE, DEFAULT_RELATED = 5.0, 0.1, 0.5, 3.0
STRONG_ROOT = 3.5
FEW_NODES, THRESHOLD_MANY, THRESHOLD_FEW = 100, 2.882, 2.971


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("map_id", F.col("origin").alias("id")).agg(F.count("*").alias("degree"))


def adjust_root_edges(edges: DataFrame, roots: DataFrame, similar: DataFrame | None = None, n: int = 4) -> DataFrame:
    """Every root gets ``n`` strong edges, of weight 5 and type related.

    With more than n root edges, those over 3.5 come first, by their target's out-degree and id, both descending, then the others in the same
    order; the rest get weight 0.1. With fewer, nodes that are targets of edges are added by out-degree descending and id
    ascending, and then those of ``similar(map_id, id, score)`` by score. Only the root's own edges enter a window.
    """
    rows = edges.join(roots, "map_id").withColumn("_own", F.col("origin") == F.col("root"))
    rest, own = rows.filter("not _own").drop("_own", "root"), rows.filter("_own").drop("_own")
    degree = out_degrees(edges)
    own = own.join(degree.withColumnRenamed("id", "target"), ["map_id", "target"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    by = W.partitionBy("map_id").orderBy(F.coalesce(F.col("weight") > STRONG_ROOT, F.lit(False)).desc(), F.desc("degree"), F.desc("target"))
    kept = F.row_number().over(by) <= n
    own = own.withColumn("kept", kept).withColumns({"weight": F.when(F.col("kept"), ROOT).otherwise(OTHER_ROOT), "type": F.when(F.col("kept"), "related").otherwise(F.col("type"))})
    count = roots.join(own.groupBy("map_id").agg(F.count("*").alias("have")), "map_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < n)
    targets = edges.select("map_id", F.col("target").alias("id")).distinct().join(degree, ["map_id", "id"], "left").select("map_id", "id", F.lit(0).alias("stage"), (-F.coalesce("degree", F.lit(0))).cast("double").alias("key"))
    if similar is not None:
        targets = targets.union(similar.select("map_id", "id", F.lit(1), (-F.col("score")).cast("double"))).groupBy("map_id", "id").agg(F.min(F.struct("stage", "key")).alias("s")).select("map_id", "id", "s.stage", "s.key")
    taken = own.select("map_id", F.col("target").alias("id"))
    more = targets.join(count, "map_id").filter("id <> root").join(taken, ["map_id", "id"], "left_anti")
    more = more.withColumn("_i", F.row_number().over(W.partitionBy("map_id").orderBy("stage", "key", "id"))).filter(F.col("_i") <= n - F.col("have"))
    added = more.select("map_id", F.col("root").alias("origin"), F.col("id").alias("target"), F.lit(ROOT).alias("weight"), F.lit("related").alias("type"))
    columns = ["map_id", "origin", "target", "weight", "type"]
    return rest.select(columns).union(own.select(columns)).union(added)


def min_degree_edges(vectors: DataFrame, edges: DataFrame, out: int = 3, into: int = 1, metric: str = "cosine") -> DataFrame:
    """New edges for concepts with fewer than ``out`` out-edges or ``into`` in-edges.

    m = missing out + missing in; of a concept's m most similar non-neighbours the first become targets and the last
    origins (overlapping where there are fewer). Neighbours are those of the given edges only, so rows do not depend on each other.
    """
    both = edges.select("map_id", F.col("origin").alias("id"), F.col("target").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("map_id", "target", "origin", F.lit(0), F.lit(1)))
    have = both.groupBy("map_id", "id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.collect_set("other").alias("exclude"))
    rows = vectors.select("map_id", "id", "embedding").join(have, ["map_id", "id"], "left")
    need = lambda c, n: F.greatest(F.lit(n) - F.coalesce(c, F.lit(0)), F.lit(0))
    rows = rows.withColumns({"need_out": need("n_out", out), "need_in": need("n_in", into)}).filter("need_out + need_in > 0")
    found = top_similar(rows, vectors, out + into, metric).join(rows.select("map_id", "id", "need_out", "need_in"), ["map_id", "id"]).filter("rank <= need_out + need_in")
    found = found.withColumn("n", F.count("*").over(W.partitionBy("map_id", "id")))
    forth = found.filter("rank <= need_out").select("map_id", F.col("id").alias("origin"), F.col("other").alias("target"), "score")
    back = found.filter("rank > n - need_in").select("map_id", F.col("other").alias("origin"), F.col("id").alias("target"), "score")
    return forth.union(back).select("map_id", "origin", "target", F.col("score").alias("weight"), F.lit("related").alias("type"))


def demote_other_root_edges(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Root edges of any weight but 5 get 0.1."""
    weak = (F.col("origin") == F.col("root")) & F.coalesce(F.col("weight") != ROOT, F.lit(True))
    return edges.join(roots, "map_id", "left").withColumn("weight", F.when(weak, OTHER_ROOT).otherwise(F.col("weight"))).drop("root")


def bridge_components(vectors: DataFrame, components: DataFrame, edges: DataFrame) -> DataFrame:
    """Artificial edges of weight 0.5 between each map's largest component (least id on ties) and every other one.

    Of the two most similar pairs of nodes the first leads out of the largest component and the second back into it. Existing edges are not repeated.
    """
    sizes = components.groupBy("map_id", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("map_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).getField("component").alias("largest"))
    placed = vectors.join(components, ["map_id", "id"]).join(largest, "map_id")
    small, big = placed.filter("component <> largest"), placed.filter("component = largest")
    best = top_similar(small, big, 2).join(components, ["map_id", "id"])
    best = best.withColumn("nth", F.row_number().over(W.partitionBy("map_id", "component").orderBy(F.desc("score"), "id", "other"))).filter("nth <= 2")
    first = F.col("nth") == 1
    new = best.select("map_id", F.when(first, F.col("other")).otherwise(F.col("id")).alias("origin"), F.when(first, F.col("id")).otherwise(F.col("other")).alias("target"), F.lit(BRIDGE).alias("weight"), F.lit("artificial").alias("type"))
    return new.join(edges.select("map_id", "origin", "target"), ["map_id", "origin", "target"], "left_anti")


def clean_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """No self-loops, one edge a pair, both ends among the concepts."""
    ids = concepts.select("map_id", "id").distinct()
    rows = dedup_edges_keep_max(edges.filter("origin <> target"))
    for end in ("origin", "target"):
        rows = rows.join(ids.withColumnRenamed("id", end), ["map_id", end], "left_semi")
    return rows.select("map_id", "origin", "target", "weight", "type")


class _Tree:
    """All nodes of a graph reached from one root, as a tree that is mended when one of its edges goes."""

    def __init__(self, after: dict, before: dict, rank: dict, root):
        self.after, self.before, self.rank, self.root = after, before, rank, root
        found = self._grow([(-rank[root, x], root, x) for x in after.get(root, ())], None)
        self.parent: dict = {root: None} | found
        self.below: dict = {}
        for y, x in found.items():
            self.below.setdefault(x, set()).add(y)

    def _grow(self, heap: list, inside: set | None) -> dict:
        """Nodes with the node that they are taken from, strongest edges first; ``inside``: those that may be taken, or all."""
        heapq.heapify(heap)
        found: dict = {}
        while heap:
            _, a, b = heapq.heappop(heap)
            if b in found or b == self.root:
                continue
            found[b] = a
            for x in self.after.get(b, ()):
                if x not in found and (inside is None or x in inside):
                    heapq.heappush(heap, (-self.rank[b, x], b, x))
        return found

    def survives(self, a, b) -> bool:
        """Whether all nodes are still reached without the edge (a, b), which is not in the graph any more; mends the tree if so."""
        if self.parent[b] != a:
            return True
        cut, todo = {b}, [b]
        while todo:
            new = self.below.get(todo.pop(), ())
            cut.update(new)
            todo.extend(new)
        heap = [(-self.rank[x, y], x, y) for y in cut for x in self.before.get(y, ()) if x not in cut]
        found = self._grow(heap, cut)
        if len(found) < len(cut):
            return False
        for y in cut:
            self.below[self.parent[y]].discard(y)
        for y, x in found.items():
            self.parent[y] = x
            self.below.setdefault(x, set()).add(y)
        return True


def mark_redundant(rows: pd.DataFrame) -> pd.DataFrame:
    """One map's edges with redundant ones marked; see :func:`mark_redundant_edges`.

    Certificate of strong connection: a tree out of a root and a tree into it. An edge in neither goes without a search,
    and the trees take the strongest edges first, so nearly all weak edges do. A tree edge goes if the part of the tree
    below it is reached from the rest some other way, by a search of that part alone, which also mends the tree.
    """
    nodes = set(rows["origin"]) | set(rows["target"])
    threshold = THRESHOLD_MANY if len(nodes) > FEW_NODES else THRESHOLD_FEW
    kinds = ["artificial" if w < threshold else t for w, t in zip(rows["weight"], rows["type"])]
    ends = list(zip(rows["origin"], rows["target"]))
    order = sorted((w, i) for i, w in enumerate(rows["weight"]))
    rank = {ends[i]: r for r, (_, i) in enumerate(order)}
    after: dict = {}
    before: dict = {}
    for a, b in ends:
        after.setdefault(a, set()).add(b)
        before.setdefault(b, set()).add(a)
    root = ends[0][0] if ends else None
    out = _Tree(after, before, rank, root) if ends else None
    into = _Tree(before, after, {(b, a): r for (a, b), r in rank.items()}, root) if ends else None
    strong = bool(ends) and len(out.parent) == len(into.parent) == len(nodes)
    for w, i in order:
        if not w < ROOT:
            continue
        a, b = ends[i]
        after[a].discard(b)
        before[b].discard(a)
        if not (strong and out.survives(a, b) and into.survives(b, a)):
            kinds[i] = "related"
            after[a].add(b)
            before[b].add(a)
    return rows.assign(type=kinds)


def mark_redundant_edges(edges: DataFrame) -> DataFrame:
    """Edges under the threshold (2.882 in maps of over 100 nodes, else 2.971) become artificial; then, weakest first, every edge under 5
    without which its map would not be strongly connected is kept and becomes related. No edge is deleted.

    Where a map is not strongly connected to begin with, every tested edge becomes related. The order matters, so a map is
    one task's work (maps are user-sized graphs); see :func:`mark_redundant` for why that is near linear in its edges.
    Edges must be unique, without self-loops, with weights; equal weights are taken by origin and target.
    """
    columns = ["map_id", "origin", "target", "weight", "type"]
    ordered = lambda rows: mark_redundant(rows.sort_values(["origin", "target"], ignore_index=True))
    return edges.select(columns).groupBy("map_id").applyInPandas(ordered, edges.select(columns).schema)


def sort_edges(edges: DataFrame) -> DataFrame:
    """Related first, then by weight descending, then by ends."""
    return edges.orderBy("map_id", (F.col("type") != "related").cast("int"), F.desc("weight"), "origin", "target")


def default_weights(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Null weights: artificial 0.5, related 3, others 0. In a map with any null, related edges at the root all get 5."""
    some = edges.groupBy("map_id").agg(F.max(F.col("weight").isNull()).alias("_some"))
    rows = edges.join(some, "map_id").join(roots, "map_id", "left")
    given = F.when(F.col("type") == "artificial", BRIDGE).when(F.col("type") == "related", DEFAULT_RELATED).otherwise(0.0)
    at_root = F.col("_some") & (F.col("type") == "related") & F.coalesce((F.col("origin") == F.col("root")) | (F.col("target") == F.col("root")), F.lit(False))
    return rows.withColumn("weight", F.when(at_root, ROOT).otherwise(F.coalesce("weight", given))).drop("_some", "root")


def auto_edges(vectors: DataFrame, edges: DataFrame, target: int = 3) -> DataFrame:
    """Generated edges anew: those given go; nodes with fewer than ``target`` out-neighbours get the missing ones of their nearest
    ``target``; then nodes without in-edges get one from their nearest node that they do not already come from."""
    kept = edges.filter("type <> 'Generated'").select("map_id", "origin", "target", "type")
    have = kept.groupBy("map_id", F.col("origin").alias("id")).agg(F.countDistinct("target").alias("n"))
    few = vectors.join(have, ["map_id", "id"], "left").filter(F.coalesce("n", F.lit(0)) < target).select("map_id", "id", "embedding")
    few = materialize(few, "few-edges")  # what the block steps read more than once
    near = top_similar(few, vectors, target).select("map_id", F.col("id").alias("origin"), F.col("other").alias("target"))
    near = materialize(near, "nearest")
    new = near.join(kept.select("map_id", "origin", "target"), ["map_id", "origin", "target"], "left_anti").withColumn("type", F.lit("Generated"))
    now = kept.unionByName(new)
    lonely = vectors.join(now.select("map_id", F.col("target").alias("id")).distinct(), ["map_id", "id"], "left_anti")
    lonely = materialize(lonely.select("map_id", "id", "embedding"), "lonely")
    back = top_similar(lonely, vectors, 1).select("map_id", F.col("other").alias("origin"), F.col("id").alias("target"), F.lit("Generated").alias("type"))
    return now.unionByName(back)


def patch_edges(new_nodes: DataFrame, vectors: DataFrame, k: int = 4) -> DataFrame:
    """(map_id, id, origin, target) for nodes just added: of the k nearest without itself the last becomes an in-edge and the others
    out-edges; a single one an out-edge."""
    near = top_similar(new_nodes, vectors, k - 1).withColumn("n", F.count("*").over(W.partitionBy("map_id", "id")))
    back = (F.col("rank") == F.col("n")) & (F.col("n") > 1)
    rows = near.select("map_id", F.when(back, F.col("other")).otherwise(F.col("id")).alias("origin"), F.when(back, F.col("id")).otherwise(F.col("other")).alias("target"))
    return rows.withColumn("id", F.concat(F.lit("E"), F.col("origin").cast("string"), F.lit("_"), F.col("target").cast("string")))
