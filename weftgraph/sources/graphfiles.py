"""Graph files: node and edge JSON to rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "struct<nodes:array<struct<data:struct<id:string,label:string,question:string,details:string,metadata:struct<answer:array<struct<fact:string,source_ids:array<string>>>,level:int,cluster_id:int>>>>,root:string>"
EDGES = "struct<edges:array<struct<data:struct<id:string,source:string,target:string,type:string,weight:string>>>>"


def flatten_nodes(files: DataFrame, column: str = "json") -> DataFrame:
    """(map_id, id, name, question, details, answer, level, cluster_id, root): one row a node of each graph file.

    ``[...]`` goes out of fact texts; what is missing is null. Files that are not JSON give no rows.
    """
    read = files.select("map_id", F.from_json(column, NODES).alias("g")).select("map_id", F.col("g.root").alias("root"), F.explode("g.nodes").alias("n"))
    data = F.col("n.data")
    facts = F.transform(data["metadata"]["answer"], lambda f: F.struct(F.trim(F.regexp_replace(f["fact"], r"\[[^\]]*\]", "")).alias("fact"), f["source_ids"].alias("source_ids")))
    return read.select(
        "map_id", data["id"].alias("id"), data["label"].alias("name"), data["question"].alias("question"), data["details"].alias("details"),
        facts.alias("answer"), data["metadata"]["level"].alias("level"), data["metadata"]["cluster_id"].alias("cluster_id"), "root",
    )


def read_edges(files: DataFrame, column: str = "json") -> DataFrame:
    """(map_id, id, source, target, type, weight) as they stand in the files."""
    return files.select("map_id", F.explode(F.from_json(column, EDGES)["edges"]).alias("e")).select("map_id", "e.data.*")


def flatten_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outside edges to inside ones: (map_id, origin, target, type, weight).

    Edges to or from ``"nan"`` go; Init is artificial, Generated and Manual are related, any other type fails the job;
    weight ``"nan"`` or none is null; only edges with both ends among ``nodes(map_id, id)`` stay (two semi-joins).
    """
    kind = F.when(F.col("type") == "Init", "artificial").when(F.col("type").isin("Generated", "Manual"), "related").otherwise(F.raise_error(F.concat(F.lit("unknown edge type "), F.coalesce("type", F.lit("null")))))
    weight = F.expr("try_cast(nullif(weight, 'nan') AS DOUBLE)")
    rows = edges.filter("source <> 'nan' and target <> 'nan'").select("map_id", F.col("source").alias("origin"), "target", kind.alias("type"), weight.alias("weight"))
    ids = nodes.select("map_id", "id").distinct()
    return rows.join(ids.withColumnRenamed("id", "origin"), ["map_id", "origin"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["map_id", "target"], "left_semi").select("map_id", "origin", "target", "type", "weight")


def node_rows(nodes: DataFrame) -> DataFrame:
    """Outside form of nodes. Where a map of ``nodes`` has no active row there is nothing to write; see :func:`empty_graph`."""
    meta = F.to_json(F.struct(F.col("answer"), "level", "cluster_id"))
    return nodes.select("map_id", F.col("id").cast("string").alias("id"), F.col("name").alias("label"), "question", F.coalesce("details", F.lit("")).alias("details"), meta.alias("metadata"))


def edge_rows(edges: DataFrame, symmetric: bool = False) -> DataFrame:
    """Outside form of edges: artificial becomes Generated and any other type Init, so that reading them back swaps the
    types, as the format has always done; ``symmetric`` writes what reading turns into the same type."""
    names = ("Init", "Generated") if symmetric else ("Generated", "Init")
    ends = [F.col(c).cast("string").alias(n) for c, n in (("origin", "source"), ("target", "target"))]
    kind = F.when(F.col("type") == "artificial", names[0]).otherwise(names[1])
    return edges.select("map_id", F.concat_ws("_", "origin", "target").alias("id"), *ends, kind.alias("type"), F.coalesce(F.col("weight").cast("string"), F.lit("nan")).alias("weight"))


def empty_graph(maps: DataFrame, nodes: DataFrame) -> DataFrame:
    """One ``Empty Graph`` node for each map without nodes."""
    return maps.select("map_id").join(nodes.select("map_id").distinct(), "map_id", "left_anti").select("map_id", F.lit("0").alias("id"), F.lit("Empty Graph").alias("label"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge rows as JSON files by map."""
    node_rows(nodes).write.mode("overwrite").partitionBy("map_id").json(f"{path}/nodes")
    edge_rows(edges).write.mode("overwrite").partitionBy("map_id").json(f"{path}/edges")
