"""Graph maintenance: validation, ids, deletions, patches, versions, history and browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.storage import materialize

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
FAN_OUT, MAX_NODES, HISTORY = 6, 19, 10


def is_node_id(source: Column) -> Column:
    """Digits alone, or a UUID."""
    return source.rlike(r"^\d+$") | source.rlike(UUID)


def fact_sources(nodes: DataFrame) -> DataFrame:
    """(map_id, id, pos, fact, source) of ``nodes(map_id, id, answer)``."""
    facts = nodes.select("map_id", "id", F.posexplode("answer").alias("pos", "f"))
    return facts.select("map_id", "id", "pos", "f.fact", F.explode_outer("f.source_ids").alias("source"))


def validate_graph(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, invalid ids) of ``nodes(map_id, id, answer, has_metadata)`` and ``edges(map_id, origin, target)``.

    A node is invalid if a source is ``0.0``, is dotted but not of three numbers (nodes with metadata), or is the id of a node that is absent or
    invalid itself. The cascade joins only what was found in the last round with (node, cited node) pairs. An invalid root fails the job.
    """
    pairs = materialize(fact_sources(nodes).select("map_id", "id", "source", F.lit(0).alias("x")).join(nodes.select("map_id", "id", "has_metadata"), ["map_id", "id"]).filter("source is not null"), "sources")
    dotted = F.col("source").contains(".") & ~F.col("source").rlike(r"^\d+\.\d+\.\d+$")
    bad = pairs.filter((F.col("source") == "0.0") | (F.col("has_metadata") & dotted)).select("map_id", "id")
    cited = materialize(pairs.filter(is_node_id(F.col("source"))).select("map_id", "id", "source").distinct(), "cited")
    absent = cited.join(nodes.select("map_id", F.col("id").alias("source")), ["map_id", "source"], "left_anti").select("map_id", "id")
    new = invalid = materialize(bad.union(absent).distinct(), "invalid")
    while new.limit(1).count():
        found = cited.join(new.withColumnRenamed("id", "source"), ["map_id", "source"], "left_semi").select("map_id", "id").distinct()
        new = materialize(found.join(invalid, ["map_id", "id"], "left_anti"), "invalid")
        invalid = materialize(invalid.union(new), "invalid")
    if roots is not None:
        hit = F.raise_error(F.concat(F.lit("the root of a map is invalid: "), F.col("id").cast("string")))
        roots.withColumnRenamed("root", "id").join(invalid, ["map_id", "id"], "left_semi").select(hit.alias("e")).foreach(lambda _: None)
    good = edges
    for end in ("origin", "target"):
        good = good.join(invalid.withColumnRenamed("id", end), ["map_id", end], "left_anti")
    return nodes.join(invalid, ["map_id", "id"], "left_anti"), good.select(edges.columns), invalid


def assign_int_ids(nodes: DataFrame) -> DataFrame:
    """(map_id, original_id, id): digits keep their number, other ids get the next ones above the map's greatest, dense and by name."""
    rows = nodes.select("map_id", F.col("id").alias("original_id"), F.expr("try_cast(id AS BIGINT)").alias("number"))
    top = rows.groupBy("map_id").agg(F.coalesce(F.max("number"), F.lit(0)).alias("top"))
    fresh = rows.filter("number is null").withColumn("_i", F.row_number().over(W.partitionBy("map_id").orderBy("original_id"))).join(top, "map_id")
    return rows.filter("number is not null").select("map_id", "original_id", F.col("number").alias("id")).union(fresh.select("map_id", "original_id", (F.col("top") + F.col("_i")).alias("id")))


def manual_nodes(nodes: DataFrame, per_cluster: int = 5) -> DataFrame:
    """Nodes without level and cluster get level 1 and the next cluster numbers, five nodes each by id. Only one of both missing fails the job."""
    both = F.col("level").isNull() & F.col("cluster_id").isNull()
    odd = F.when(F.col("level").isNull() != F.col("cluster_id").isNull(), F.raise_error(F.lit("level and cluster_id must both be given or both be missing")).cast("int"))
    top = nodes.groupBy("map_id").agg(F.coalesce(F.max("cluster_id"), F.lit(-1)).alias("_top"))
    fresh = nodes.filter(both).withColumn("_i", F.row_number().over(W.partitionBy("map_id").orderBy("id")) - 1).join(top, "map_id")
    fresh = fresh.withColumns({"level": F.lit(1), "cluster_id": (F.col("_top") + 1 + F.floor(F.col("_i") / per_cluster)).cast("int")}).select(nodes.columns)
    return nodes.filter(~both).withColumn("level", F.coalesce(odd, F.col("level"))).select(nodes.columns).unionByName(fresh)


def delete_documents(nodes: DataFrame, edges: DataFrame, docs: DataFrame, digits_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the documents of ``docs(map_id, doc)``.

    Sources that start with ``doc.`` go; facts without sources go; nodes without facts go, and facts that cite such a node lose that source,
    until nothing changes (``digits_only``: UUID sources do not follow). Facts are unfolded once and arrays built once, at the end;
    ``modified`` = 1 marks nodes that lost something.
    """
    rows = fact_sources(nodes).filter("source is not null").withColumn("doc", F.regexp_extract("source", r"^([^.]*)\.", 1))
    left = materialize(rows.join(docs, ["map_id", "doc"], "left_anti").select("map_id", "id", "pos", "fact", "source"), "facts")
    alive = nodes.select("map_id", "id")
    cites = F.col("source").rlike(r"^\d+$") if digits_only else is_node_id(F.col("source"))
    while True:
        now = materialize(left.select("map_id", "id").distinct(), "alive")
        gone = materialize(alive.join(now, ["map_id", "id"], "left_anti").select("map_id", F.col("id").cast("string").alias("source")), "gone")
        if not gone.limit(1).count():
            break
        cut = left.filter(cites).join(gone, ["map_id", "source"], "left_semi").select("map_id", "id", "pos", "source").distinct()
        left = materialize(left.join(cut, ["map_id", "id", "pos", "source"], "left_anti").select("map_id", "id", "pos", "fact", "source"), "facts")
        alive = now
    facts = left.groupBy("map_id", "id", "pos").agg(F.first("fact").alias("fact"), F.array_sort(F.collect_set("source")).alias("source_ids"))
    back = facts.groupBy("map_id", "id").agg(F.sort_array(F.collect_list(F.struct("pos", "fact", "source_ids"))).alias("_l"), F.sum(F.size("source_ids")).alias("_left"))
    before = fact_sources(nodes).filter("source is not null").groupBy("map_id", "id").agg(F.count("*").alias("_had"))
    out = nodes.join(back, ["map_id", "id"]).join(before, ["map_id", "id"])
    out = out.withColumns({"answer": F.transform("_l", lambda f: F.struct(f["fact"].alias("fact"), f["source_ids"].alias("source_ids"))), "modified": (F.col("_left") < F.col("_had")).cast("int")})
    kept = edges
    for end in ("origin", "target"):
        kept = kept.join(out.select("map_id", F.col("id").alias(end)), ["map_id", end], "left_semi")
    return out.select(*nodes.columns, "modified"), kept.select(edges.columns)


def root_candidates(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """(map_id, id, degree, rank): the first n connected nodes by level, degree (both descending) and id."""
    ends = edges.select("map_id", F.explode(F.array("origin", "target")).alias("id"))
    rows = nodes.select("map_id", "id", "level").join(ends.groupBy("map_id", "id").agg(F.count("*").alias("degree")), ["map_id", "id"])
    rank = F.row_number().over(W.partitionBy("map_id").orderBy(F.desc("level"), F.desc("degree"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).select("map_id", "id", "degree", "rank")


def restore_ids(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of integer ids back to the original ones of ``ids(map_id, original_id, id)``; ids without an entry become text."""
    for c in columns:
        back = ids.select("map_id", F.col("id").alias(c), F.col("original_id").alias("_o"))
        rows = rows.join(back, ["map_id", c], "left").withColumn(c, F.coalesce("_o", F.col(c).cast("string"))).drop("_o")
    return rows


def reindex_clashes(new: DataFrame, used: DataFrame) -> DataFrame:
    """(map_id, id, new_id): ids that are used already get the next ones above the greatest of both tables."""
    top = used.select("map_id", "id").union(new.select("map_id", "id")).groupBy("map_id").agg(F.max("id").alias("top"))
    rows = new.select("map_id", "id").join(used.select("map_id", "id", F.lit(True).alias("_clash")).distinct(), ["map_id", "id"], "left")
    clash = rows.filter("_clash").withColumn("_i", F.row_number().over(W.partitionBy("map_id").orderBy("id"))).join(top, "map_id")
    return rows.filter("_clash is null").select("map_id", "id", F.col("id").alias("new_id")).union(clash.select("map_id", "id", (F.col("top") + F.col("_i")).alias("new_id")))


def merge_added(old: DataFrame, new: DataFrame, ids: tuple[str, ...] = ("id",), key: str = "id") -> DataFrame:
    """Both tables, the new rows' id columns offset by the map's greatest ``key`` + 1 and flagged ``new`` = 1."""
    top = old.groupBy("map_id").agg((F.max(key) + 1).alias("_top"))
    rows = new.join(top, "map_id", "left").withColumn("_top", F.coalesce("_top", F.lit(0)))
    rows = rows.withColumns({c: F.col(c) + F.col("_top") for c in ids}).drop("_top")
    return old.withColumn("new", F.lit(0)).unionByName(rows.withColumn("new", F.lit(1)), allowMissingColumns=True)


def tree_check(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(map_id, duplicate_labels, root_ok, dangling, components, cycle) of each map with nodes.

    Components are those of the undirected graph of edges with both ends; parallel edges and self-loops are cycles: there is one
    if there are more such edges than nodes less components. Node ids and map ids outside of 0 .. 2^31 - 1 are an error.
    """
    fits = lambda c: F.col(c).between(0, (1 << 31) - 1)
    key = lambda c: F.when(fits("map_id") & fits(c), F.col("map_id") * (1 << 31) + F.col(c)).otherwise(F.raise_error(F.lit("node ids and map ids must be in 0 .. 2^31 - 1")).cast("long")).alias(c)
    labels = nodes.groupBy("map_id", "name").agg(F.count("*").alias("n")).filter("n > 1").groupBy("map_id").agg(F.count("*").alias("duplicate_labels"))
    ids = nodes.select("map_id", "id").distinct()
    valid = edges
    for end in ("origin", "target"):
        valid = valid.join(ids.withColumnRenamed("id", end), ["map_id", end], "left_semi")
    valid = materialize(valid.select("map_id", "origin", "target"), "valid")
    total, inner = (e.groupBy("map_id").agg(F.count("*").alias(n)) for e, n in ((edges, "n_all"), (valid, "n_valid")))
    joined = connected_components(valid.select(key("origin").alias("a"), key("target").alias("b")))
    merged = joined.filter("node <> component").select(F.expr("node div 2147483648").alias("map_id")).groupBy("map_id").agg(F.count("*").alias("merged"))
    rooted = roots.join(ids.withColumnRenamed("id", "root"), ["map_id", "root"], "left_semi").select("map_id", F.lit(True).alias("root_ok")).distinct()
    out = ids.groupBy("map_id").agg(F.count("*").alias("n"))
    for part in (labels, rooted, total, inner, merged):
        out = out.join(part, "map_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "map_id", zero("duplicate_labels").alias("duplicate_labels"), F.coalesce("root_ok", F.lit(False)).alias("root_ok"), (zero("n_all") - zero("n_valid")).alias("dangling"),
        (F.col("n") - zero("merged")).alias("components"), (zero("n_valid") > zero("merged")).alias("cycle"),
    )


def label_edges_to_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(map_id, origin, target) in both directions of ``edges(map_id, source_label, target_label)``: a label is its first node; unknown labels and
    self-loops drop out; one edge a pair."""
    first = nodes.groupBy("map_id", "name").agg(F.min("id").alias("id"))
    rows = edges.join(first.select("map_id", F.col("name").alias("source_label"), F.col("id").alias("a")), ["map_id", "source_label"]).join(first.select("map_id", F.col("name").alias("target_label"), F.col("id").alias("b")), ["map_id", "target_label"])
    one = rows.filter("a <> b").select("map_id", F.least("a", "b").alias("origin"), F.greatest("a", "b").alias("target")).distinct()
    return one.union(one.select("map_id", "target", "origin"))


def path_to_previous(edges: DataFrame, pairs: DataFrame, depth: int = 3) -> DataFrame:
    """(map_id, start, previous, path): a shortest way of at most ``depth`` steps from ``start`` to ``previous`` along edges in either direction.

    Of equally short ways the one with the least ids in order; ``pairs(map_id, start, previous)`` without one are left out. Both ends
    are searched breadth-first in turns, a level at a time, until they meet in the middle; each node found keeps the least way
    to it, and pairs that have met are not followed further.
    """
    one = edges.filter("origin <> target").select("map_id", "origin", "target")
    both = materialize(one.union(one.select("map_id", "target", "origin")).distinct(), "ways")
    keys = ["map_id", "start", "previous"]
    ends = pairs.select(*keys).distinct()
    sides = {c: materialize(ends.select(*keys, F.col(c).alias("id"), F.array(c).alias("path"), F.lit(0).alias("steps")), "side") for c in ("start", "previous")}
    done = None
    for level in range(depth + 1):
        if level:
            c = "start" if level % 2 else "previous"
            seen, steps = sides[c], (level + 1) // 2
            front = seen.filter(F.col("steps") == steps - 1).join(done.select(*keys), keys, "left_anti")
            near = front.join(both, (front["map_id"] == both["map_id"]) & (front["id"] == both["origin"])).select(*[front[k] for k in keys], F.col("target").alias("to"), "path")
            way = F.concat("path", F.array("to")) if c == "start" else F.concat(F.array("to"), F.col("path"))
            found = near.groupBy(*keys, F.col("to").alias("id")).agg(F.min(way).alias("path"))
            found = found.join(seen.select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("steps", F.lit(steps))
            sides[c] = materialize(seen.unionByName(found), "side")
        back = sides["previous"].select(*keys, "id", F.col("path").alias("_rest"))
        met = sides["start"].join(back, [*keys, "id"]).groupBy(*keys).agg(F.min(F.concat("path", F.expr("slice(_rest, 2, size(_rest))"))).alias("path"))
        met = met if done is None else met.join(done.select(*keys), keys, "left_anti")
        done = materialize(met if done is None else done.unionByName(met), "met")
    return done


def subgraph(edges: DataFrame, starts: DataFrame, depth: int = 3, max_nodes: int = MAX_NODES, universal: bool = True, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (map_id, start, id, depth) and tree edges (map_id, start, origin, target) found breadth-first from each of ``starts(map_id, start)``.

    Neighbours go Manual, Init, Generated and then by id; in universal mode a start shows six at most. A node hangs on the first that finds it.
    Every level is one join of its frontier, at most ``max_nodes`` rows a start, with the edges. With ``previous(map_id, start, previous)``,
    one node a start, the way to it (:func:`path_to_previous`) is in the result whatever its length, before all others.
    """
    order = F.when(F.col("type") == "Manual", 0).when(F.col("type") == "Init", 1).otherwise(2)
    both = edges.filter("origin <> target").select("map_id", "origin", "target", order.alias("o")).groupBy("map_id", "origin", "target").agg(F.min("o").alias("o"))
    seen = starts.select("map_id", "start", F.col("start").alias("id"), F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("parent"))
    if previous is not None:
        ways = path_to_previous(edges, previous.join(starts, ["map_id", "start"], "left_semi"), depth).select("map_id", "start", F.posexplode("path").alias("n", "id"), "path")
        parent = F.expr("element_at(path, n)")  # counts from 1: the node before
        seen = seen.unionByName(ways.filter("n > 0").select("map_id", "start", "id", F.col("n").alias("depth"), "n", parent.alias("parent")))
    seen = materialize(seen, "seen")
    for level in range(1, depth + 1):
        front = seen.filter(F.col("depth") == level - 1).select("map_id", "start", F.col("id").alias("origin"), F.col("n").alias("pn"))
        next_ = front.join(both, ["map_id", "origin"])
        if level == 1 and universal:
            next_ = next_.withColumn("_r", F.row_number().over(W.partitionBy("map_id", "start").orderBy("o", "target"))).filter(F.col("_r") <= FAN_OUT).drop("_r")
        found = next_.groupBy("map_id", "start", F.col("target").alias("id")).agg(F.min(F.struct("pn", "o", "origin")).alias("by"))
        found = found.join(seen.select("map_id", "start", "id"), ["map_id", "start", "id"], "left_anti")
        have = seen.groupBy("map_id", "start").agg(F.count("*").alias("have"))
        found = found.join(have, ["map_id", "start"]).withColumn("n", F.col("have") - 1 + F.row_number().over(W.partitionBy("map_id", "start").orderBy("by.pn", "by.o", "id"))).filter(F.col("n") < max_nodes)
        seen = materialize(seen.unionByName(found.select("map_id", "start", "id", F.lit(level).alias("depth"), F.col("n").cast("int").alias("n"), F.col("by.origin").alias("parent"))), "seen")
    return seen.select("map_id", "start", "id", "depth"), seen.filter("parent is not null").select("map_id", "start", F.col("parent").alias("origin"), F.col("id").alias("target"))


def upsert(old: DataFrame, patch: DataFrame, fields: list[str], deletes: DataFrame | None = None) -> DataFrame:
    """``old(map_id, id, fields)`` with ``patch(map_id, id, fields, given)``: a field that is named in ``given`` is overwritten (null deletes its value),
    others stay; unknown ids are inserted; ids of ``deletes`` go."""
    new = patch.select("map_id", "id", F.col("given").alias("_given"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = old.join(new, ["map_id", "id"], "full_outer")
    rows = rows.withColumns({f: F.when(F.array_contains("_given", f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).select(old.columns)
    return rows.join(deletes.select("map_id", "id"), ["map_id", "id"], "left_anti").select(old.columns) if deletes is not None else rows


def delete_nodes(nodes: DataFrame, edges: DataFrame, roots: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and roots without ``gone(map_id, id)``; a root that goes becomes null."""
    kept = edges
    for end in ("origin", "target"):
        kept = kept.join(gone.withColumnRenamed("id", end), ["map_id", end], "left_anti")
    lost = gone.select("map_id", F.col("id").alias("root"), F.lit(True).alias("_lost")).distinct()
    left = roots.join(lost, ["map_id", "root"], "left").select("map_id", F.when(F.col("_lost").isNull(), F.col("root")).alias("root"))
    return nodes.join(gone, ["map_id", "id"], "left_anti"), kept.select(edges.columns), left


def check_new_edges(new: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``new(map_id, edge_id, origin, target, type)`` with ``reason``, null where it may be added; the first reason in order: type, end, id, pair."""
    ids = nodes.select("map_id", "id").distinct()
    rows = new
    for end in ("origin", "target"):
        rows = rows.join(ids.select("map_id", F.col("id").alias(end), F.lit(True).alias(f"_{end}")), ["map_id", end], "left")
    rows = rows.join(edges.select("map_id", "edge_id", F.lit(True).alias("_id")).distinct(), ["map_id", "edge_id"], "left")
    rows = rows.join(edges.select("map_id", "origin", "target", F.lit(True).alias("_pair")).distinct(), ["map_id", "origin", "target"], "left")
    reason = (
        F.when(F.coalesce(F.col("type") != "Manual", F.lit(True)), "type")
        .when(F.col("_origin").isNull() | F.col("_target").isNull(), "end")
        .when(F.col("_id"), "id")
        .when(F.col("_pair"), "pair")
    )
    return rows.select(*new.columns, reason.alias("reason"))


def graph_diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = ("name", "details", "question")) -> DataFrame:
    """(map_id, id, change): added, removed or changed (null-safe on ``fields``)."""
    a = old.select("map_id", "id", F.struct(*fields).alias("_a"))
    b = new.select("map_id", "id", F.struct(*fields).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, ["map_id", "id"], "full_outer").select("map_id", "id", change.alias("change")).filter("change is not null")


def source_changes(versions: DataFrame) -> DataFrame:
    """(id, version, action): an active REMOVED version in the graph is deleted; an active one that is not in it is added, and the version that is, deleted."""
    active = lambda x: F.max(F.when(F.col("active"), x))
    by = versions.groupBy("id").agg(
        active(F.col("version")).alias("v"), active(F.col("status")).alias("status"), active(F.col("in_graph").cast("int")).alias("inside"),
        F.max(F.when(F.col("in_graph") & ~F.col("active"), F.col("version"))).alias("other"),
    ).filter("v is not null")
    removed = F.col("status") == "REMOVED"
    delete_active = by.filter(removed & (F.col("inside") == 1)).select("id", F.col("v").alias("version"), F.lit("delete").alias("action"))
    add = by.filter(~removed & (F.col("inside") == 0)).select("id", F.col("v").alias("version"), F.lit("add").alias("action"))
    return delete_active.union(add).union(by.filter((removed | (F.col("inside") == 0)) & F.col("other").isNotNull()).select("id", F.col("other").alias("version"), F.lit("delete")))


def add_version(versions: DataFrame, ids: DataFrame) -> DataFrame:
    """A new version (greatest + 1, active, not in the graph) of each of ``ids(id)``; its other versions become inactive."""
    top = versions.join(ids, "id", "left_semi").groupBy("id").agg(F.max("version").alias("top"))
    kept = versions.join(top, "id", "left").withColumn("active", F.when(F.col("top").isNotNull(), F.lit(False)).otherwise(F.col("active"))).drop("top")
    new = top.select("id", (F.col("top") + 1).cast("int").alias("version"), F.lit(True).alias("active"), F.lit(False).alias("in_graph"), F.lit("IN_PROGRESS").alias("status"))
    return kept.unionByName(new, allowMissingColumns=True)


def drop_failed(versions: DataFrame) -> DataFrame:
    """Active versions that FAILED go; the highest that is left becomes active."""
    left = versions.filter(~(F.col("active") & (F.col("status") == "FAILED")))
    gone = versions.join(left, ["id", "version"], "left_anti").select("id").distinct().withColumn("_gone", F.lit(True))
    top = left.groupBy("id").agg(F.max("version").alias("_top"))
    rows = left.join(gone, "id", "left").join(top, "id")
    return rows.withColumn("active", F.when(F.col("_gone"), F.col("version") == F.col("_top")).otherwise(F.col("active"))).drop("_gone", "_top")


def activate(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Version ``wanted(id, version)`` active, its others not."""
    w = wanted.select("id", F.col("version").alias("_v"))
    return versions.join(w, "id", "left").withColumn("active", F.when(F.col("_v").isNotNull(), F.col("version") == F.col("_v")).otherwise(F.col("active"))).drop("_v")


def after_apply(versions: DataFrame) -> DataFrame:
    """What is active is in the graph, and active REMOVED versions are gone."""
    return versions.filter(~(F.col("active") & (F.col("status") == "REMOVED"))).withColumn("in_graph", F.col("active"))


def history_state(steps: DataFrame, at: int) -> DataFrame:
    """(map_id, type, id, value): the last new_value among steps up to ``at``."""
    return steps.filter(F.col("step") <= at).groupBy("map_id", "type", "id").agg(F.max_by("new_value", "step").alias("value"))


def undo_redo_ranges(steps: DataFrame, current: DataFrame, user: str) -> DataFrame:
    """(map_id, undo_first, undo_last, redo_first, redo_last, can_undo, can_redo) of ``current(map_id, step)`` for ``user``.

    ``steps(map_id, step, user, skip)`` count from 0. The user's skipped steps belong to the step before them: undoing starts at the
    current step and goes back to the first that does not belong to its predecessor, redoing takes the next step and all that
    belong to it. A range is null where there is nothing, or where its step is another user's. can_undo and can_redo are
    whether the step where such a walk ends is the user's. One aggregate a map, no windows.
    """
    rows = steps.join(current.select("map_id", F.col("step").alias("_at")), "map_id").withColumn("_own", F.col("user") == user)
    here, alone = F.col("step"), ~(F.col("_own") & F.coalesce("skip", F.lit(False)))
    when = lambda test, value=here: F.when(test, value)
    back, ahead = (here <= F.col("_at")) & alone, here > F.col("_at")
    found = rows.groupBy("map_id", "_at").agg(
        F.count("*").alias("n"),
        F.max(when(back)).alias("head"),
        F.max_by("_own", when(back)).alias("head_own"),
        F.max(when(here == F.col("_at"), F.col("_own"))).alias("here_own"),
        F.max(when(here == F.col("_at") + 1, F.col("_own"))).alias("next_own"),
        F.min(when((here > F.col("_at") + 1) & alone)).alias("stop"),
        F.min_by("_own", when(ahead & alone)).alias("stop_own"),
        F.max_by("_own", "step").alias("end_own"),
        F.max(ahead & alone).alias("any_alone"),
    )
    undo = F.col("here_own") & F.col("head").isNotNull()
    last = F.coalesce(F.col("stop") - 1, F.col("n") - 1)
    redo = F.coalesce("next_own", F.lit(False)) | (last > F.col("_at") + 1)
    ends = F.when(F.col("any_alone"), F.col("stop_own")).otherwise(F.col("end_own"))
    return found.select(
        "map_id",
        F.when(undo, F.col("head")).alias("undo_first"),
        F.when(undo, F.col("_at")).alias("undo_last"),
        F.when(redo, F.col("_at") + 1).alias("redo_first"),
        F.when(redo, last).alias("redo_last"),
        ((F.col("_at") < F.col("n")) & F.coalesce("head_own", F.lit(False))).alias("can_undo"),
        ((F.col("_at") + 1 < F.col("n")) & F.coalesce(ends, F.lit(False))).alias("can_redo"),
    )


def undo_redo_values(changes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(map_id, action, type, id, value) of ``changes(map_id, step, type, id, old_value, new_value)``: what undoing or redoing a range leaves.

    Undoing gives the old value of a field's first change in the range, redoing the new value of its last; null deletes it.
    """
    out = []
    for action, value, pick in (("undo", "old_value", F.min_by), ("redo", "new_value", F.max_by)):
        span = ranges.select("map_id", F.col(f"{action}_first").alias("_a"), F.col(f"{action}_last").alias("_b")).filter("_a is not null")
        rows = changes.join(span, "map_id").filter("step between _a and _b")
        out.append(rows.groupBy("map_id", F.lit(action).alias("action"), "type", "id").agg(pick(value, "step").alias("value")))
    return out[0].union(out[1])


def append_step(steps: DataFrame, current: DataFrame, new: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Steps of each map up to ``current(map_id, step)`` (undone ones go) with those of ``new``; the last ``keep`` step numbers stay."""
    rows = steps.join(current.select("map_id", F.col("step").alias("_c")), "map_id", "left").filter("_c is null or step <= _c").select(steps.columns)
    rows = rows.unionByName(new)
    numbers = rows.select("map_id", "step").distinct().withColumn("_r", F.row_number().over(W.partitionBy("map_id").orderBy(F.desc("step")))).filter(F.col("_r") <= keep)
    return rows.join(numbers.select("map_id", "step"), ["map_id", "step"], "left_semi").select(steps.columns)


def normalise_questions(nodes: DataFrame, with_meta: bool = True) -> DataFrame:
    """``questions`` defaults to ``[question]`` and ``question`` goes; without meta-information also questions, details and link."""
    rows = nodes.withColumn("questions", F.coalesce("questions", F.when(F.col("question").isNotNull(), F.array("question")))).drop("question")
    return rows if with_meta else rows.drop("questions", "details", "link")
