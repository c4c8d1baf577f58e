"""Similarity of vectors: given pairs, and the k most similar of each by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: Vectors of a block; a task multiplies two blocks, so many rows of one at a time.
BLOCK, ROWS = 2048, 256
METRICS = ("cosine", "l2", "sql2", "inner")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def score(a: Column, b: Column, metric: str) -> Column:
    """cosine similarity, l2 distance, sql2 squared distance, or inner product of two vectors, in double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    if metric in ("l2", "sql2"):
        d = _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
        return F.sqrt(d) if metric == "l2" else d
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    if metric == "inner":
        return dot
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def score_pairs(pairs: DataFrame, vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """``pairs(map_id, a, b)`` with ``score``, by two joins on ids."""
    v = vectors.select("map_id", "id", "embedding")
    rows = pairs.join(v.select("map_id", F.col("id").alias("a"), F.col("embedding").alias("_a")), ["map_id", "a"]).join(v.select("map_id", F.col("id").alias("b"), F.col("embedding").alias("_b")), ["map_id", "b"])
    return rows.withColumn("score", score(F.col("_a"), F.col("_b"), metric)).drop("_a", "_b")


def matrix_scores(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """All scores of two blocks; greater is always more similar (distances are negative)."""
    dot = q @ t.T
    if metric == "inner":
        return dot
    nq, nt = (q * q).sum(1), (t * t).sum(1)
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(dot / np.sqrt(nq[:, None] * nt[None, :]))
    d = np.maximum(nq[:, None] + nt[None, :] - 2 * dot, 0)
    return -(np.sqrt(d) if metric == "l2" else d)


def best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` greatest scores, greatest first and ties by column; a score of minus infinity or none is left out."""
    s[np.isnan(s)] = -np.inf
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    else:
        i, j = np.nonzero(s > -np.inf)
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept]


def _blocked(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt to blocks, and (map_id, blocks): a table of its own, so Spark knows how small it is and no map's vectors meet for it."""
    sizes = materialize(rows.groupBy("map_id").agg(F.ceil(F.count("*") / block).alias("blocks")), "block-sizes")
    return rows.join(sizes, "map_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks"), sizes


def top_similar(queries: DataFrame, targets: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = True, block: int = BLOCK, digits: int = 9) -> DataFrame:
    """(map_id, id, other, score, rank): for each of ``queries(map_id, id, embedding[, exclude])`` the k most similar of the same map's targets.

    Scores are rounded to ``digits``, ties go by the other's id; distances are given as positive numbers, nearest first. ``exclude`` is an
    array of ids that do not count. Every block of queries meets every block of targets of its map in a task of its own, which keeps k rows a
    query, so memory is two blocks and a part of their product whatever a map's size; a vector travels once a block of the other side, so
    smaller blocks cost more of a shuffle that grows with the square of a map. Vectors of null are left out.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    columns = ["map_id", "id", "embedding"]
    queries = queries.filter("embedding is not null")
    if "exclude" not in queries.columns:
        queries = queries.withColumn("exclude", F.array().cast("array<bigint>"))
    q, qsizes = _blocked(queries.select(*columns, "exclude"), block)
    t, tsizes = _blocked(targets.filter("embedding is not null").select(*columns), block)
    every = lambda sizes, name: sizes.select("map_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias(name))
    q = q.withColumnRenamed("block", "qb").join(every(tsizes, "tb"), "map_id")
    t = t.withColumnRenamed("block", "tb").join(every(qsizes, "qb"), "map_id")
    t = t.select(*[F.col(c).alias(c) for c in t.columns])  # new attributes, as both sides may be one table

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"map_id": [], "id": [], "other": [], "score": []}).astype({"map_id": "int64", "id": "int64", "other": "int64", "score": "float64"})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values("id", kind="stable")
        ids, others, out = left["id"].to_numpy(), right["id"].to_numpy(), []
        x, y = np.stack(left["embedding"]).astype(float), np.stack(right["embedding"]).astype(float)
        for at in range(0, len(left), ROWS):
            own = ids[at : at + ROWS]
            s = np.round(matrix_scores(x[at : at + ROWS], y, metric), digits)
            if exclude_self:
                s[own[:, None] == others[None, :]] = -np.inf
            for i, ex in enumerate(left["exclude"].iloc[at : at + ROWS]):
                if ex is not None and len(ex):
                    s[i, np.isin(others, ex)] = -np.inf
            i, j = best_columns(s, k)
            out.append(pd.DataFrame({"map_id": left["map_id"].iloc[0], "id": own[i], "other": others[j], "score": s[i, j]}))
        return pd.concat(out, ignore_index=True)

    pairs = q.groupBy("map_id", "qb", "tb").cogroup(t.groupBy("map_id", "qb", "tb")).applyInPandas(meet, "map_id long, id long, other long, score double")
    by = W.partitionBy("map_id", "id").orderBy(F.desc("score"), "other")
    ranked = pairs.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.abs("score")) if metric in ("l2", "sql2") else ranked


def squared_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` with score = 1 - d^2 / (greatest d^2 of the map's pairs)."""
    rows = score_pairs(pairs, vectors, "sql2")
    most = rows.groupBy("map_id").agg(F.max("score").alias("_most"))
    return rows.join(most, "map_id").withColumn("score", 1 - F.col("score") / F.nullif(F.col("_most"), F.lit(0.0))).drop("_most")
