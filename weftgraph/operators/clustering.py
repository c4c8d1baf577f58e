"""Clusters of concepts, levels of the hierarchy, and synthesised concepts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..plans.storage import materialize
from .chunking import greedy_groups
from .concepts import ROOT, SYNTHESISED, dedup_edges_keep_max, id_changes, propagate_relations

#: Sizes and budgets of clusters and levels.
SIZE_CAP, SIZE_DEFAULT, SIZE_FLOOR, PACK, LEAST_CONCEPTS = 12, 5, 10, 12, 4
#: Concepts of a cell that one task clusters; larger ones are condensed to half as many micro-clusters first.
MAP_ROWS = 4000


def max_cluster_size(chunks: DataFrame) -> DataFrame:
    """(map_id, size) of ``chunks(map_id, ids)``: the largest number of concepts of a chunk, 5 where that is none or at most 10, 12 at most."""
    most = chunks.groupBy("map_id").agg(F.max(F.size("ids")).alias("m"))
    return most.select("map_id", F.least(F.when(F.coalesce("m", F.lit(0)) <= SIZE_FLOOR, SIZE_DEFAULT).otherwise(F.col("m")), F.lit(SIZE_CAP)).alias("size"))


def multiplier(n: Column, size: Column) -> Column:
    """max(ceil(log3(n / size / 4)), 0)."""
    return F.greatest(F.ceil(F.round(F.log(n / size / 4) / F.lit(math.log(3)), 9)), F.lit(0)).cast("int")


def level_plan(counts: DataFrame) -> DataFrame:
    """``counts(map_id, level, n, size)`` with mult, budget = 4 * 3^mult clusters, and last: whether the level ends the hierarchy."""
    m = multiplier(F.col("n"), F.col("size"))
    rows = counts.withColumn("mult", F.when(F.col("n") > 0, m).otherwise(0)).withColumn("budget", (4 * F.pow(F.lit(3), F.col("mult"))).cast("long"))
    return rows.withColumn("last", (F.col("n") < LEAST_CONCEPTS) | (F.col("mult") == 0) | (F.col("budget") <= F.col("size")))


# -- clusters ----------------------------------------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, weight: np.ndarray | None = None, seed: int = 0, rounds: int = 50) -> np.ndarray:
    """Labels 0 .. of k-means with k-means++ starts; fewer clusters where points coincide. A point may stand for ``weight`` points."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(x)) if weight is None else weight
    k = min(k, len(x))
    centres = x[[int(rng.integers(len(x)))]]
    d = ((x - centres[0]) ** 2).sum(1) * w
    while len(centres) < k and d.sum() > 0:
        centres = np.vstack([centres, x[int(rng.choice(len(x), p=d / d.sum()))]])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1) * w)
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        new = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        if (new == labels).all():
            break
        labels = new
        for c in np.unique(labels):
            centres[c] = np.average(x[labels == c], axis=0, weights=w[labels == c])
    return np.unique(labels, return_inverse=True)[1]


def ward(x: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Labels 0 .. of k clusters by Ward's criterion, along nearest-neighbour chains. A point may stand for ``weight`` points."""
    n = len(x)
    k = min(k, n)
    centre, active = x.astype(float).copy(), np.ones(n, bool)
    size = np.ones(n) if weight is None else weight.astype(float).copy()
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(active)[0])]
        while True:
            a = chain[-1]
            d = ((centre - centre[a]) ** 2).sum(1) * size * size[a] / (size + size[a])
            d[~active] = np.inf
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        merges.append((float(((centre[a] - centre[b]) ** 2).sum() * size[a] * size[b] / (size[a] + size[b])), a, b))
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        active[b] = False
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


METHODS = {"kmeans": kmeans, "ward": ward}


def split_labels(x: np.ndarray, labels: np.ndarray, most: int, method) -> np.ndarray:
    """Labels in which every cluster of more than ``most`` points is clustered again into ceil(n / most) parts, until none is left.

    Where clustering does not divide (equal points), the points are dealt out in order.
    """
    todo, out, following = [np.flatnonzero(labels == c) for c in np.unique(labels)], np.zeros(len(x), int), 0
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out[rows] = following
            following += 1
            continue
        parts = method(x[rows], -(-len(rows) // most))
        if parts.max() == 0:
            parts = np.arange(len(rows)) // most
        todo += [rows[parts == c] for c in range(parts.max() + 1)]
    return out


def _assigned(rows: DataFrame, centres: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows(map_id, cell, id, embedding)`` with ``near``, the number of the nearest of its cell's ``centres(map_id, cell, near, centre)``.

    ``sizes(map_id, cell, blocks)`` is a table of its own, so that Spark sends it to the centres and not the centres to all tasks, by way of the driver.
    """
    left = rows.join(sizes, ["map_id", "cell"]).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
    right = centres.join(sizes, ["map_id", "cell"]).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def nearest(points: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(points):
            return points.assign(near=pd.Series([], dtype="int64")).drop(columns="blk")
        around = around.sort_values("near")
        x, c = np.stack(points["embedding"]).astype(float), np.stack(around["centre"]).astype(float)
        if len(c) > 1 and not np.ptp(c, axis=0).any():  # all centres are one point: any is the nearest
            best = points["id"].to_numpy() % len(c)
        else:
            best = np.concatenate([((c**2).sum(1)[None, :] - 2 * x[i : i + 512] @ c.T).argmin(1) for i in range(0, len(x), 512)])
        return points.assign(near=around["near"].to_numpy()[best]).drop(columns="blk")

    schema = f"map_id long, cell long, id long, embedding array<double>, {'k long, ' if 'k' in rows.columns else ''}near long"
    return left.groupBy("map_id", "cell", "blk").cogroup(right.groupBy("map_id", "cell", "blk")).applyInPandas(nearest, schema)


def _condensed(rows: DataFrame, most: int, rounds: int = 2, block: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Rows with their micro-cluster ``near``, and (map_id, cell, near, centre, n) of these, ``most`` a cell: k-means of all cells at once.

    Centres start at the rows of least hashed id. Tasks assign blocks of rows to their cell's centres, and new centres are
    partial sums of every component by (map_id, cell, near), so no cell meets in a task.
    """
    dims = len(rows.first()["embedding"])
    sizes = materialize(rows.groupBy("map_id", "cell").agg(F.ceil(F.count("*") / block).alias("blocks")), "cell-sizes")
    order = W.partitionBy("map_id", "cell").orderBy(F.xxhash64("id"), "id")
    centres = rows.withColumn("near", F.row_number().over(order).cast("long")).filter(F.col("near") <= most).select("map_id", "cell", "near", F.col("embedding").alias("centre"))
    for last in [False] * rounds + [True]:
        placed = materialize(_assigned(rows, materialize(centres, "centres"), sizes), "assigned")
        sums = placed.groupBy("map_id", "cell", "near").agg(F.count("*").alias("n"), *[F.avg(F.col("embedding")[i]).alias(f"_{i}") for i in range(dims)])
        centres = sums.select("map_id", "cell", "near", F.array(*[F.col(f"_{i}") for i in range(dims)]).alias("centre"), "n")
        if last:
            return placed, materialize(centres, "centres")
        centres = centres.drop("n")


def cluster_embeddings(concepts: DataFrame, plan: DataFrame, method: str = "kmeans", split: bool = False, map_rows: int = MAP_ROWS) -> DataFrame:
    """(map_id, id, cluster) of ``concepts(map_id, id, embedding)`` by ``plan(map_id, clusters, size)``; method kmeans or ward.

    Maps are cells that all rounds treat alike. A cell of up to ``map_rows`` concepts is clustered by one task, with rows sorted
    by id so that results are stable. Of a larger one k-means over blocks first makes half as many micro-clusters, all cells
    at once, and a task clusters these by the method with their numbers as weights: concepts in different micro-clusters
    still meet. If a cell wants more clusters than an eighth of its micro-clusters can tell apart, or ``split`` asks for
    clusters of ``size`` concepts at most, what comes out are cells of the next round, with their share of clusters. Rounds
    grow with the logarithm of a map's size. Null embeddings are left out.
    """
    f, micro = METHODS[method], max(2, map_rows // 2)
    rows = concepts.filter("embedding is not null").select("map_id", "id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.join(plan.select("map_id", F.col("clusters").cast("long").alias("k")), "map_id").withColumn("cell", F.lit(0).cast("long"))
    rows, done = rows.select("map_id", "cell", "id", "embedding", "k"), None
    limits = plan.select("map_id", "size")

    def whole(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        x = np.stack(part["embedding"]).astype(float)
        labels = f(x, max(1, int(part["k"][0])))
        if split:
            labels = split_labels(x, labels, int(part["size"][0]), f)
        return pd.DataFrame({"map_id": part["map_id"], "id": part["id"], "cell": key[1], "label": labels})

    def weighted(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("near", ignore_index=True)
        n, k = part["n"].to_numpy().astype(float), int(part["k"][0])
        if len(part) == 1:  # nothing tells these rows apart: halves by id
            half = max(-(-k // 2), -(-int(n[0]) // (2 * int(part["size"][0]))) if split else 1)
            return pd.DataFrame({"map_id": part["map_id"], "cell": key[1], "near": part["near"], "label": -1, "share": half})
        labels = f(np.stack(part["centre"]).astype(float), max(2, min(k, len(part) // 8)), n)
        if labels.max() == 0:
            labels = np.arange(len(part)) % 2
        total = np.bincount(labels, weights=n)[labels]
        share = np.maximum(1, np.rint(k * total / n.sum())) if k > len(part) // 8 else np.ones(len(part))
        if split:
            share = np.maximum(share, np.ceil(total / part["size"].to_numpy()))
        return pd.DataFrame({"map_id": part["map_id"], "cell": key[1], "near": part["near"], "label": labels, "share": share.astype(int)})

    while True:
        sizes = rows.groupBy("map_id", "cell").agg(F.count("*").alias("n"), F.max("k").alias("k"))
        large = materialize(sizes.filter(F.col("n") > map_rows).select("map_id", "cell", F.col("k").alias("_k")), "large")
        small = rows.join(large, ["map_id", "cell"], "left_anti").join(limits, "map_id")
        found = small.groupBy("map_id", "cell").applyInPandas(whole, "map_id long, id long, cell long, label long")
        found = found.select("map_id", "id", F.xxhash64("cell", "label").alias("part"))
        done = found if done is None else done.union(found)
        if not large.limit(1).count():
            break
        big = rows.join(large.select("map_id", "cell"), ["map_id", "cell"], "left_semi")
        placed, centres = _condensed(big, micro)
        named = centres.join(large.withColumnRenamed("_k", "k"), ["map_id", "cell"]).join(limits, "map_id")
        named = materialize(named.groupBy("map_id", "cell").applyInPandas(weighted, "map_id long, cell long, near long, label long, share long"), "cells")
        rows = placed.join(named, ["map_id", "cell", "near"]).select("map_id", F.xxhash64("cell", F.when(F.col("label") < 0, F.pmod(F.xxhash64("id", "cell"), F.lit(2))).otherwise(F.col("label"))).alias("cell"), "id", "embedding", F.col("share").alias("k"))
        rows = materialize(rows, "cells")
        if not split:  # a cell that wants one cluster is one, whatever its size
            done = done.union(rows.filter("k = 1").select("map_id", "id", F.col("cell").alias("part")))
            rows = rows.filter("k > 1")
    done = materialize(done, "parts")
    names = done.groupBy("map_id", "part").agg(F.min("id").alias("first"))
    names = names.withColumn("cluster", F.row_number().over(W.partitionBy("map_id").orderBy("first")) - 1)
    return done.join(names, ["map_id", "part"]).select("map_id", "id", "cluster")


def pack_small_clusters(clusters: DataFrame, target: int = PACK) -> DataFrame:
    """(map_id, id, cluster, pack) of ``clusters(map_id, id, cluster)``: clusters by size, neighbours together while they have ``target`` concepts at most.

    Only the table of cluster sizes goes through the greedy helper.
    """
    sizes = clusters.groupBy("map_id", "cluster").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("i", F.row_number().over(W.partitionBy("map_id").orderBy("n", "cluster")))
    packs = sizes.join(greedy_groups(sizes, ["map_id"], "i", {"n": target}, "pack"), ["map_id", "i"])
    return clusters.join(packs.select("map_id", "cluster", "pack"), ["map_id", "cluster"]).select("map_id", "id", "cluster", "pack")


def packed_within_budget(concepts: DataFrame, plan: DataFrame, method: str = "ward", target: int = PACK, rounds: int = 20) -> DataFrame:
    """(map_id, id, cluster, pack, mult) of ``concepts(map_id, id, embedding)`` by ``plan(map_id, size, mult)``: packs within 4 * 3^mult a map.

    Every map is cut into 4 * 3^mult clusters, those over ``size`` are split and small ones packed. Maps that end with more packs
    than that try again with ``mult`` + 1, all together in a round, until none is left; more clusters are smaller ones, which
    pack better. No pack has more concepts than ``target`` and size allow, so a map starts with the first ``mult`` whose budget is not
    less than the packs it must have: with a smaller one it would be clustered in vain. ``target`` and size decide whether that
    ends; after ``rounds`` it is an error.
    """
    counts = concepts.filter("embedding is not null").groupBy("map_id").agg(F.count("*").alias("n"))
    least = F.ceil(F.coalesce("n", F.lit(0)) / F.greatest(F.lit(target), "size"))
    short = F.size(F.filter(F.sequence(F.lit(0), F.lit(39)), lambda m: 4 * F.pow(F.lit(3), m) < least))
    left = plan.join(counts, "map_id", "left").select("map_id", "size", F.greatest(F.col("mult").cast("int"), short).alias("mult"))
    left = materialize(left, "plan")
    done = None
    for _ in range(rounds):
        asked = left.withColumn("clusters", (4 * F.pow(F.lit(3), F.col("mult"))).cast("long"))
        rows = concepts.join(asked.select("map_id"), "map_id", "left_semi")
        packs = materialize(pack_small_clusters(cluster_embeddings(rows, asked, method, split=True), target).join(asked, "map_id"), "packs")
        over = packs.groupBy("map_id").agg(F.countDistinct("pack").alias("n"), F.max("clusters").alias("budget")).filter("n > budget").select("map_id")
        over = materialize(over, "over-budget")
        good = packs.join(over, "map_id", "left_anti").select("map_id", "id", "cluster", "pack", "mult")
        done = good if done is None else done.union(good)
        if not over.limit(1).count():
            return done
        left = left.join(over, "map_id", "left_semi").withColumn("mult", F.col("mult") + 1)
    raise RuntimeError(f"packs exceed the budget after {rounds} rounds")


def cluster_payload(concepts: DataFrame) -> DataFrame:
    """(map_id, cluster_id, payload): each cluster's {name, question} by id, as JSON."""
    rows = concepts.groupBy("map_id", "cluster_id").agg(F.sort_array(F.collect_list(F.struct("id", "name", "question"))).alias("l"))
    return rows.select("map_id", "cluster_id", F.to_json(F.transform("l", lambda c: F.struct(c["name"].alias("name"), c["question"].alias("question")))).alias("payload"))


# -- synthesis ---------------------------------------------------------------------------------------------------------


def apply_synthesis(concepts: DataFrame, synth: DataFrame, level: int) -> DataFrame:
    """Concepts with those of ``synth(map_id, cluster_id, name, question, is_root, sources)`` added and their sources inactive.

    ``concepts(map_id, id, name, question, cluster_id, level, is_active, part_ids)``. Sources are looked up by (map, cluster, name) among active
    concepts; names that are unknown drop out, and a new concept without any known source is not made. Part ids are united; ids go on from the
    map's greatest; roots go to ``level`` + 1. A row without a question and sources copies the active concept of its name.
    """
    active = concepts.filter("is_active = 1").groupBy("map_id", "cluster_id", "name").agg(F.min("id").alias("sid"), F.min_by("part_ids", "id").alias("sparts"), F.min_by("question", "id").alias("squestion"))
    rows = synth.withColumn("sources", F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array("name")))
    rows = rows.withColumn("source", F.explode("sources")).join(active.withColumnRenamed("name", "source"), ["map_id", "cluster_id", "source"])
    made = rows.groupBy("map_id", "cluster_id", "name", "is_root").agg(
        F.coalesce(F.first("question", True), F.min_by("squestion", "sid")).alias("question"), F.array_sort(F.collect_set("sid")).alias("source_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sparts")))).alias("part_ids")
    )
    top = concepts.groupBy("map_id").agg(F.max("id").alias("top"))
    number = F.row_number().over(W.partitionBy("map_id").orderBy("cluster_id", "is_root", "name"))
    made = made.join(top, "map_id").withColumn("id", F.col("top") + number)
    made = made.select("map_id", "id", "name", "question", "cluster_id", F.when(F.col("is_root"), level + 1).otherwise(level).alias("level"), F.lit(1).alias("is_active"), "part_ids", "source_ids")
    used = made.select("map_id", F.explode("source_ids").alias("id")).distinct().withColumn("_used", F.lit(1))
    kept = concepts.join(used, ["map_id", "id"], "left").withColumn("is_active", F.when(F.col("_used") == 1, 0).otherwise(F.col("is_active"))).drop("_used")
    return kept.unionByName(made, allowMissingColumns=True)


def synthesis_relations(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """(map_id, origin, target, weight, type) of ``relations(map_id, cluster_id, source_name, target_name)`` by name (without suffix) and cluster."""
    names = concepts.filter("is_active = 1").groupBy("map_id", "cluster_id", base_name(F.col("name")).alias("n")).agg(F.min("id").alias("id"))
    rows = relations
    for side, end in (("source_name", "origin"), ("target_name", "target")):
        rows = rows.withColumn("n", base_name(F.col(side))).join(names.withColumnRenamed("id", end), ["map_id", "cluster_id", "n"]).drop("n")
    return rows.select("map_id", "origin", "target", F.lit(SYNTHESISED).alias("weight"), F.lit("related").alias("type"))


def split_levels(concepts: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Active concepts that stay at the level, and those promoted to the next."""
    active = concepts.filter("is_active = 1")
    return active.filter(F.col("level") == level), active.filter(F.col("level") == level + 1)


def rebuild_levels(concepts: DataFrame, new: DataFrame, plan_of, synthesise) -> DataFrame:
    """Add mode: for each level in ascending order, -1 last, the level's concepts and the promoted ones are clustered and synthesised again.

    ``plan_of(rows)`` gives (map_id, clusters, size) and ``synthesise(rows, level)`` the synth table of clustered rows. Maps with fewer than four new
    concepts are left out; a level with fewer than four concepts is left as its roots. One round of jobs a level.
    """
    many = new.groupBy("map_id").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_CONCEPTS).select("map_id")
    rows = concepts.join(many, "map_id", "left_semi").unionByName(new.join(many, "map_id", "left_semi"), allowMissingColumns=True)
    levels = sorted((r["level"] for r in rows.filter("is_active = 1").select("level").distinct().collect()), key=lambda v: (v == -1, v))
    for level in levels:
        here = rows.filter((F.col("is_active") == 1) & (F.col("level") == level))
        enough = here.groupBy("map_id").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_CONCEPTS).select("map_id")
        here = here.join(enough, "map_id", "left_semi")
        placed = cluster_embeddings(here, plan_of(here), split=True)
        clustered = rows.join(placed, ["map_id", "id"], "left").withColumn("cluster_id", F.coalesce("cluster", "cluster_id")).drop("cluster")
        clustered = materialize(clustered, "level")
        rows = apply_synthesis(clustered, synthesise(clustered.join(placed.select("map_id", "id"), ["map_id", "id"], "left_semi"), level), level)
        rows = materialize(rows, "level")
    return concepts.join(many, "map_id", "left_anti").unionByName(rows, allowMissingColumns=True)


def define_root(concepts: DataFrame, relations: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``choices(map_id, root)`` made the main root: cluster and level -1; other concepts of the top level get cluster -1.

    Edges of weight 4 lead from it to the first four other roots by id; relations follow concepts and all become related.
    """
    top = concepts.filter("is_active = 1").groupBy("map_id").agg(F.max("level").alias("_top"))
    rows = concepts.join(top, "map_id").join(choices, "map_id", "left")
    main, at_top = F.coalesce(F.col("id") == F.col("root"), F.lit(False)), (F.col("level") == F.col("_top")) & (F.col("is_active") == 1)
    out = rows.withColumns({"cluster_id": F.when(main | at_top, -1).otherwise(F.col("cluster_id")), "level": F.when(main, -1).otherwise(F.col("level"))}).select(concepts.columns)
    subs = rows.filter(at_top & ~main).withColumn("_i", F.row_number().over(W.partitionBy("map_id").orderBy("id"))).filter("_i <= 4 and root is not null")
    new = subs.select("map_id", F.col("root").alias("origin"), F.col("id").alias("target"), F.lit(ROOT).alias("weight"), F.lit("related").alias("type"))
    old = relations if "source_ids" not in concepts.columns else propagate_relations(relations, id_changes(concepts.filter("source_ids is not null")))
    return out, dedup_edges_keep_max(old.select("map_id", "origin", "target", "weight", F.lit("related").alias("type")).unionByName(new))
