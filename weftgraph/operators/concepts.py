"""Extraction results to concepts and relations; duplicate names and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_name, is_trivial_text, normalise_details
from ..plans.storage import materialize

#: Weights of relations by origin, and their decay when an end is replaced.
EXTRACTED, SYNTHESISED, ROOT, DECAY = 3.0, 2.0, 4.0, 0.99


# -- extraction --------------------------------------------------------------------------------------------------------


def explode_concepts(extractions: DataFrame) -> DataFrame:
    """``extractions(flat_chunk_id, concepts)`` to one row a concept with page_ids = sorted distinct sources of its facts."""
    c = extractions.select("flat_chunk_id", F.posexplode("concepts").alias("pos", "c"))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(F.col("c.answer"), lambda f: f["source_ids"]))))
    return c.select("flat_chunk_id", "pos", "c.name", "c.question", "c.answer", pages.alias("page_ids"))


def explode_relations(extractions: DataFrame) -> DataFrame:
    return extractions.select("flat_chunk_id", F.explode("relations").alias("r")).select("flat_chunk_id", "r.source_name", "r.target_name")


def attach_parts(concepts: DataFrame, parts: DataFrame, explode_pages: bool = False) -> DataFrame:
    """Concepts ``(flat_chunk_id, doc_cat, name, question, answer, page_ids)`` with ``part_ids`` from ``parts(flat_chunk_id, page_ids, flat_part_id)``.

    Slides (PPTX) are looked up page by page and grouped back. Others join on the whole page list, so that a concept that cites two
    pages of one-page parts is lost, as it always was; ``explode_pages`` looks these up page by page too.
    """
    slides = F.lit(True) if explode_pages else F.col("doc_cat").startswith("PPTX")
    key = ["name", "question", "flat_chunk_id", "doc_cat"]
    one = concepts.filter(slides).withColumn("page", F.explode("page_ids")).join(parts.select("flat_chunk_id", F.col("page_ids")[0].alias("page"), "flat_part_id").filter("page is not null"), ["flat_chunk_id", "page"])
    one = one.groupBy(*key).agg(F.min_by("answer", "flat_part_id").alias("answer"), F.array_sort(F.collect_set("flat_part_id")).alias("part_ids"))
    rest = concepts.filter(~slides).join(parts.select("flat_chunk_id", "page_ids", "flat_part_id"), ["flat_chunk_id", "page_ids"]).select(*key, "answer", F.array("flat_part_id").alias("part_ids"))
    return one.unionByName(rest)


def suffix_duplicate_names(concepts: DataFrame, keys: list[str] = ["map_id"]) -> DataFrame:  # noqa: B006
    """Each of n > 1 equal names becomes ``name_1 ... name_n`` by id. Counts are a partial aggregate; only names that repeat enter a window."""
    counts = concepts.groupBy(*keys, "name").agg(F.count("*").alias("_n"))
    rows = concepts.join(counts, [*keys, "name"])
    many = rows.filter("_n > 1").withColumn("_i", F.row_number().over(W.partitionBy(*keys, "name").orderBy("id")))
    named = many.withColumn("name", F.concat_ws("_", "name", F.col("_i").cast("string"))).drop("_i", "_n")
    return rows.filter("_n = 1").drop("_n").unionByName(named)


def resolve_relations(relations: DataFrame, concepts: DataFrame, weight: float = EXTRACTED) -> DataFrame:
    """(origin, target, weight) of ``relations(flat_chunk_id, source_name, target_name)``; names that no concept of the chunk has drop
    out, names that several have multiply."""
    names = concepts.select("flat_chunk_id", "name", "id")
    a = names.select("flat_chunk_id", F.col("name").alias("source_name"), F.col("id").alias("origin"))
    b = names.select("flat_chunk_id", F.col("name").alias("target_name"), F.col("id").alias("target"))
    return relations.join(a, ["flat_chunk_id", "source_name"]).join(b, ["flat_chunk_id", "target_name"]).select("origin", "target", F.lit(weight).alias("weight"))


def chunk_concept_lists(chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """(flat_chunk_id, ids): each chunk's concept ids in order, ``[]`` if none."""
    lists = concepts.groupBy("flat_chunk_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return chunks.select("flat_chunk_id").join(lists, "flat_chunk_id", "left").select("flat_chunk_id", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def missing_embeddings(concepts: DataFrame) -> DataFrame:
    """Rows for the encoder: active and without a vector."""
    return concepts.filter("is_active = 1 and embedding is null")


def inherit_embeddings(concepts: DataFrame, sources: DataFrame) -> DataFrame:
    """A concept without a vector, with exactly one source and that source's question takes its vector."""
    given = sources.select(F.col("id").alias("_source"), F.col("question").alias("_question"), F.col("embedding").alias("_embedding"))
    only = F.when(F.size("source_ids") == 1, F.col("source_ids")[0])
    rows = concepts.withColumn("_source", only).join(given, "_source", "left")
    same = F.col("_question") == F.col("question")
    return rows.withColumn("embedding", F.coalesce("embedding", F.when(same, F.col("_embedding")))).drop("_source", "_question", "_embedding")


def encode_missing(concepts: DataFrame, encoder, batch_size: int = 128) -> DataFrame:
    """(id, embedding) by a caller's function from a list of texts to a list of vectors, in batches."""

    def run(batches):
        for rows in batches:
            for i in range(0, len(rows), batch_size):
                part = rows.iloc[i : i + batch_size]
                yield part[["id"]].assign(embedding=list(encoder(part["question"].tolist())))

    return missing_embeddings(concepts).select("id", "question").mapInPandas(run, "id long, embedding array<float>")


#: Weight of a relation that a merge answer gives.
RELATED = 3.0

# -- duplicates --------------------------------------------------------------------------------------------------------


def duplicate_groups(concepts: DataFrame, roots: DataFrame, suffix_only: bool = False) -> DataFrame:
    """(map_id, base, ids, n, has_root): active concepts whose name without its suffix repeats in a map; ``roots(map_id, root)``."""
    rows = concepts.filter("is_active = 1").withColumn("base", base_name(F.col("name"), suffix_only)).join(roots, "map_id", "left")
    groups = rows.groupBy("map_id", "base").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"), F.max(F.coalesce(F.col("id") == F.col("root"), F.lit(False))).alias("has_root"))
    return groups.filter("n > 1")


def beaten_max(value: Column) -> Column:
    """Aggregate: the greatest value; -1 beats all, and nothing gives -1."""
    return F.when((F.count(value) == 0) | F.max(F.coalesce(value == -1, F.lit(False))), F.lit(-1)).otherwise(F.max(value))


def group_level_and_cluster(concepts: DataFrame, roots: DataFrame) -> DataFrame:
    """(map_id, base, level, cluster_id) of each duplicate group, without the root itself."""
    rows = concepts.filter("is_active = 1").withColumn("base", base_name(F.col("name"))).join(roots, "map_id", "left")
    other = F.coalesce(F.col("id") != F.col("root"), F.lit(True))
    grouped = rows.groupBy("map_id", "base").agg(F.count("*").alias("n"), beaten_max(F.when(other, F.col("level"))).alias("level"), beaten_max(F.when(other, F.col("cluster_id"))).alias("cluster_id"))
    return grouped.filter("n > 1").drop("n")


def merge_duplicates(concepts: DataFrame, relations: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: each duplicate group becomes a new active concept, its sources inactive, and relations follow with decay.

    The merged concept has the group's base name, the least id's question, the group's level and cluster, ids above the map's
    greatest, and ``source_ids`` of the group. A caller that has texts for it joins them by (map_id, base).
    """
    groups = duplicate_groups(concepts, roots).join(group_level_and_cluster(concepts, roots), ["map_id", "base"])
    top = concepts.groupBy("map_id").agg(F.max("id").alias("top"))
    fresh = groups.join(top, "map_id").withColumn("id", F.col("top") + F.row_number().over(W.partitionBy("map_id").orderBy("base")))
    first = concepts.select("map_id", F.col("id").alias("_first"), "question")
    fresh = fresh.withColumn("_first", F.col("ids")[0]).join(first, ["map_id", "_first"]).select("map_id", "id", F.col("base").alias("name"), "question", "cluster_id", "level", F.lit(1).alias("is_active"), F.col("ids").alias("source_ids"))
    gone = fresh.select("map_id", F.explode("source_ids").alias("id"), F.lit(1).alias("_gone"))
    kept = concepts.join(gone, ["map_id", "id"], "left").withColumn("is_active", F.when(F.col("_gone") == 1, 0).otherwise(F.col("is_active"))).drop("_gone")
    moved = dedup_edges_keep_max(propagate_relations(relations, id_changes(fresh)))
    return kept.unionByName(fresh, allowMissingColumns=True), moved


def merge_to_fixed_point(concepts: DataFrame, relations: DataFrame, roots: DataFrame, answers: DataFrame | None = None, links: DataFrame | None = None, rounds: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, relations, roots) after rounds of merging until no name repeats among a map's active concepts, ``rounds`` at most.

    Names lose their suffix first. In each round every group of active concepts of one name becomes the concepts that
    ``answers(map_id, base, pos, name, question, is_root)`` gives for it, or one of its own name and its least id's question;
    the group goes inactive. New concepts have ids above the map's greatest, in order of base and pos, the group's level and
    cluster (of its members but the root), its members as ``source_ids``, and, where ``concepts`` has ``answer`` arrays, the
    distinct facts of all members in order of id. Where the group holds the root, the answer marked ``is_root``, or the one
    concept of a group without answers, is the new root with level and cluster -1. Relations follow to all successors with
    decay, ``links(map_id, base, origin_name, target_name)`` of a merged group add relations of weight 3 between concepts of
    this round (of equal names the last), and of equal pairs the greatest weight stays. An answer may bear a name that
    others have: then the next round merges again. At last edges of inactive concepts go.

    Only names that the last round gave are grouped again, so a round costs what the last one changed, apart from the
    table it writes. Each round is cut by tables in the shared folder.
    """
    with_facts = "answer" in concepts.columns
    now = materialize(concepts.withColumn("name", base_name(F.col("name"))), "merge-concepts")
    edges = relations.select("map_id", "origin", "target", F.col("weight").cast("double").alias("weight"), "type")
    roots, touched = roots.select("map_id", "root"), None
    for _ in range(rounds):
        rows = now.filter("is_active = 1")
        if touched is not None:
            rows = rows.join(touched, ["map_id", "name"], "left_semi")
        rows = rows.join(roots, "map_id", "left")
        other = F.coalesce(F.col("id") != F.col("root"), F.lit(True))
        merged = [
            F.sort_array(F.collect_list("id")).alias("ids"),
            F.count("*").alias("n"),
            F.max(~other).alias("has_root"),
            F.min_by("question", "id").alias("question"),
            beaten_max(F.when(other, F.col("level"))).alias("level"),
            beaten_max(F.when(other, F.col("cluster_id"))).alias("cluster_id"),
        ]
        if with_facts:
            merged.append(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "answer"))), lambda x: F.coalesce(x["answer"], F.array())))).alias("answer"))
        groups = materialize(rows.groupBy("map_id", F.col("name").alias("base")).agg(*merged).filter("n > 1"), "merge-groups")
        if not groups.limit(1).count():
            break
        if answers is None:
            new = groups.withColumns({"name": F.col("base"), "pos": F.lit(0), "is_root": F.col("has_root")})
        else:
            given = answers.select("map_id", "base", F.col("pos").alias("_pos"), F.col("name").alias("_name"), F.col("question").alias("_question"), F.col("is_root").alias("_root"))
            new = groups.join(given, ["map_id", "base"], "left").withColumns(
                {
                    "is_root": F.col("has_root") & F.when(F.col("_name").isNull(), True).otherwise(F.coalesce("_root", F.lit(False))),
                    "name": F.coalesce("_name", "base"),
                    "pos": F.coalesce("_pos", F.lit(0)),
                    "question": F.coalesce("_question", "question"),
                }
            )
        top = now.groupBy("map_id").agg(F.max("id").alias("top"))
        number = F.row_number().over(W.partitionBy("map_id").orderBy("base", "pos", "name"))
        fresh = new.join(top, "map_id").withColumn("id", F.col("top") + number)
        for c in ("level", "cluster_id"):
            fresh = fresh.withColumn(c, F.when(F.col("is_root"), -1).otherwise(F.col(c)).cast(now.schema[c].dataType))
        fresh = fresh.select("map_id", "id", "base", "name", "question", "level", "cluster_id", "is_root", F.lit(1).alias("is_active"), F.col("ids").alias("source_ids"), *(["answer"] if with_facts else []))
        fresh = materialize(fresh, "merge-fresh")
        edges = propagate_relations(edges, id_changes(fresh))
        if links is not None:
            named = fresh.groupBy("map_id", "name").agg(F.max("id").alias("id"))
            end = lambda c, to: named.select("map_id", F.col("name").alias(c), F.col("id").alias(to))
            asked = links.join(groups.select("map_id", "base"), ["map_id", "base"], "left_semi")
            found = asked.join(end("origin_name", "origin"), ["map_id", "origin_name"]).join(end("target_name", "target"), ["map_id", "target_name"])
            edges = edges.unionByName(found.select("map_id", "origin", "target", F.lit(RELATED).alias("weight"), F.lit("related").alias("type")))
        edges = materialize(dedup_edges_keep_max(edges.filter("origin <> target")), "merge-edges")
        gone = groups.select("map_id", F.explode("ids").alias("id"), F.lit(True).alias("_gone"))
        kept = now.join(gone, ["map_id", "id"], "left").withColumn("is_active", F.when(F.col("_gone"), 0).otherwise(F.col("is_active"))).drop("_gone")
        now = materialize(kept.unionByName(fresh.drop("base", "is_root"), allowMissingColumns=True), "merge-concepts")
        moved = fresh.filter("is_root").groupBy("map_id").agg(F.max("id").alias("_to"))
        roots = materialize(roots.join(moved, "map_id", "left").select("map_id", F.coalesce("_to", "root").alias("root")), "merge-roots")
        touched = fresh.select("map_id", "name").distinct()
    return now, drop_inactive_edges(edges, now), roots


def drop_inactive_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges without self-loops and without ends that are inactive."""
    off = concepts.filter("is_active = 0").select("map_id", "id")
    rest = edges.filter("origin <> target")
    for end in ("origin", "target"):
        rest = rest.join(off.withColumnRenamed("id", end), ["map_id", end], "left_anti")
    return rest


def unique_names_by_activity(concepts: DataFrame) -> DataFrame:
    """Repeated names of a map told apart: one active among inactive ones keeps its name and the others get ``_``; several active
    get ``_1``, ``_2``, ... by id and inactive ones ``_``; without any active all get ``_``."""
    counts = concepts.groupBy("map_id", "name").agg(F.sum("is_active").alias("_on"), F.count("*").alias("_n"))
    rows = concepts.join(counts, ["map_id", "name"])
    many = rows.filter("_n > 1").withColumn("_i", F.row_number().over(W.partitionBy("map_id", "name", "is_active").orderBy("id")))
    named = F.when((F.col("is_active") == 1) & (F.col("_on") == 1), F.col("name")).when(F.col("is_active") == 1, F.concat_ws("_", "name", F.col("_i").cast("string"))).otherwise(F.concat("name", F.lit("_")))
    return rows.filter("_n = 1").unionByName(many.withColumn("name", named).drop("_i")).drop("_on", "_n")


def rename_batches(concepts: DataFrame, size: int = 10) -> DataFrame:
    """(map_id, batch, rows): names that repeat in a map, in batches of ``size`` by id, as JSON of {id, name}."""
    again = concepts.groupBy("map_id", "name").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = concepts.join(again, ["map_id", "name"], "left_semi").select("map_id", "id", "name")
    rows = rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("map_id").orderBy("id")) - 1) / size))
    return rows.groupBy("map_id", "batch").agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "name")))).alias("rows"))


def apply_names(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """New names of ``names(map_id, id, name)`` by id; others stay."""
    new = names.select("map_id", "id", F.col("name").alias("_new"))
    return concepts.join(new, ["map_id", "id"], "left").withColumn("name", F.coalesce("_new", "name")).drop("_new")


def rename_until_unique(concepts: DataFrame, names: DataFrame, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(concepts, rest): concepts whose names repeat in their map renamed by ``names(map_id, attempt, id, name)``, ``tries`` times at most.

    In each attempt, from 1, all concepts of a repeated name take the name proposed for them, where there is one; a proposal may
    clash with any name of the map, which the next attempt looks at. A map is done when its names are distinct, and only maps
    that are not, and names that repeat in them, take part in the next attempt. ``rest(map_id, name, n)`` are names that repeat
    at the end.
    """
    repeated = lambda rows: rows.groupBy("map_id", "name").agg(F.count("*").alias("n")).filter("n > 1")
    now = concepts
    for attempt in range(1, tries + 1):
        again = materialize(repeated(now), "repeated")
        if not again.limit(1).count():
            break
        asked = now.join(again.select("map_id", "name"), ["map_id", "name"], "left_semi").select("map_id", "id")
        given = names.filter(F.col("attempt") == attempt).select("map_id", "id", "name").join(asked, ["map_id", "id"], "left_semi")
        now = materialize(apply_names(now, given), "renamed")
    return now, repeated(now)


def duplicate_node_report(nodes: DataFrame) -> DataFrame:
    """(map_id, id, duplicate_of, reason) of ``nodes(map_id, id, question, details)``: details equal to an earlier node's once
    normalised, details that repeat the question, or trivial ones. One aggregate by hash; no pairs are listed."""
    text = normalise_details(F.col("details"))
    rows = nodes.withColumns({"_h": F.xxhash64(text), "_text": text, "_same": text == normalise_details(F.col("question"))})
    first = rows.groupBy("map_id", "_h", "_text").agg(F.min("id").alias("least"))
    rows = rows.join(first, ["map_id", "_h", "_text"])
    reason = F.when(is_trivial_text(F.col("details")), "trivial").when(F.col("_same"), "question").when(F.col("id") > F.col("least"), "duplicate")
    return rows.select("map_id", "id", F.when(reason == "duplicate", F.col("least")).alias("duplicate_of"), reason.alias("reason")).filter("reason is not null")


# -- succession --------------------------------------------------------------------------------------------------------


def id_changes(concepts: DataFrame) -> DataFrame:
    """(map_id, old_id, new_id): every source of a concept with the concept built from it."""
    return concepts.select("map_id", F.explode("source_ids").alias("old_id"), F.col("id").alias("new_id"))


def propagate_relations(relations: DataFrame, changes: DataFrame, decay: float = DECAY) -> DataFrame:
    """Both ends replaced by all their successors; weight times ``decay`` where either was; pairs of equal ends go, replaced or not."""
    a = changes.select("map_id", F.col("old_id").alias("origin"), F.col("new_id").alias("_a"))
    b = changes.select("map_id", F.col("old_id").alias("target"), F.col("new_id").alias("_b"))
    rows = relations.join(a, ["map_id", "origin"], "left").join(b, ["map_id", "target"], "left")
    moved = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    rows = rows.withColumn("weight", F.when(moved, F.col("weight") * decay).otherwise(F.col("weight"))).withColumns({"origin": F.coalesce("_a", "origin"), "target": F.coalesce("_b", "target")})
    return rows.drop("_a", "_b").filter("origin <> target")


def dedup_edges_keep_max(edges: DataFrame) -> DataFrame:
    """One edge for each (map_id, origin, target): greatest weight, ``related`` first on ties. A partial aggregate, no window."""
    best = F.max(F.struct(F.col("weight"), (F.col("type") == "related").alias("_related"), F.col("type")))
    return edges.groupBy("map_id", "origin", "target").agg(best.alias("b")).select("map_id", "origin", "target", "b.weight", "b.type")
