"""Citations of concepts: looked up, rewritten, numbered and resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import number_distinct

_EMPTY = "array<string>"


def concept_citations(concepts: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, citations) of ``concepts(id, part_ids)``: each part's citation in order; parts that are unknown leave no mark."""
    rows = concepts.select("id", F.posexplode("part_ids").alias("pos", "part_id")).join(parts.select("part_id", "citation"), "part_id", "left")
    found = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("citation").isNotNull(), F.struct("pos", "citation")))).getField("citation").alias("citations"))
    return concepts.select("id").join(found, "id", "left").select("id", F.coalesce("citations", F.array().cast(_EMPTY)).alias("citations"))


def _fact_sources(concepts: DataFrame) -> DataFrame:
    facts = concepts.select("id", F.posexplode("answer").alias("pos", "f")).select("id", "pos", "f.fact", "f.source_ids")
    return facts.select("id", "pos", "fact", "source_ids", F.posexplode_outer("source_ids").alias("at", "source"))


def _facts_back(facts: DataFrame) -> DataFrame:
    """(id, answer) from (id, pos, fact, source_ids)."""
    rows = facts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "fact", "source_ids"))).alias("l"))
    return rows.select("id", F.transform("l", lambda f: F.struct(f["fact"].alias("fact"), f["source_ids"].alias("source_ids"))).alias("answer"))


def cite_facts(concepts: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, answer): every fact's part ids as sorted distinct citations; unknown ones drop out, null sources give []."""
    rows = _fact_sources(concepts).withColumn("part_id", F.col("source").cast("long")).join(parts.select("part_id", "citation"), "part_id", "left")
    return _facts_back(rows.groupBy("id", "pos").agg(F.first("fact").alias("fact"), F.array_sort(F.collect_set("citation")).alias("source_ids")))


def citations_to_part_ids(concepts: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, answer): the inverse. A fact with any citation that is unknown stays as it is."""
    rows = _fact_sources(concepts).join(parts.select(F.col("citation").alias("source"), "part_id"), "source", "left")
    facts = rows.groupBy("id", "pos").agg(
        F.first("fact").alias("fact"), F.first("source_ids").alias("old"), F.bool_and(F.col("source").isNull() | F.col("part_id").isNotNull()).alias("known"), F.array_sort(F.collect_set("part_id")).alias("new")
    )
    return _facts_back(facts.select("id", "pos", "fact", F.when(F.col("known"), F.col("new").cast(_EMPTY)).otherwise(F.col("old")).alias("source_ids")))


def render_grouped_answer(concepts: DataFrame) -> DataFrame:
    """(id, text): neighbouring facts with equal source sets as one, followed by ``^[^a]^^[b]^`` for sources a, b (the first
    caret twice, as ever); empty facts are left out."""
    facts = concepts.select("id", F.posexplode("answer").alias("pos", "f")).select("id", "pos", F.trim("f.fact").alias("fact"), F.array_sort(F.array_distinct("f.source_ids")).alias("s")).filter("fact <> ''")
    by = W.partitionBy("id").orderBy("pos")
    facts = facts.withColumn("new", (~F.col("s").eqNullSafe(F.lag("s").over(by))).cast("int")).withColumn("island", F.sum("new").over(by))
    rows = facts.groupBy("id", "island").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "fact"))).getField("fact"), " ").alias("text"), F.first("s").alias("s"))
    marks = F.when(F.size("s") > 0, F.concat(F.lit(" ^[^"), F.array_join("s", "]^^["), F.lit("]^"))).otherwise("")
    rows = rows.select("id", "island", F.concat("text", marks).alias("text"))
    return rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("island", "text"))).getField("text"), " ").alias("text"))


def batches(rows: DataFrame, size: int = 10, keys: list[str] = ["map_id"], order: str = "id") -> DataFrame:  # noqa: B006
    """``batch`` = 0, 1, ...: ``size`` rows each in order, within keys."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1) / size))


def citation_part_ids(nodes: DataFrame) -> DataFrame:
    """(id, part_ids) of ``nodes(id, citations)``: all distinct citations numbered from 1 in sorted order, mapped back."""
    rows = nodes.select("id", F.posexplode("citations").alias("pos", "citation"))
    numbered = rows.join(number_distinct(rows, "citation", "part_id"), "citation")
    back = numbered.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "part_id"))).getField("part_id").alias("part_ids"))
    return nodes.select("id").join(back, "id", "left").select("id", F.coalesce("part_ids", F.array().cast("array<bigint>")).alias("part_ids"))


def part_table(nodes: DataFrame, new_parts: DataFrame | None = None) -> DataFrame:
    """Distinct (part_id, citation) of ``nodes(citations, part_ids)``, with ``new_parts`` united: one row a part id (least citation)."""
    rows = nodes.select(F.explode(F.arrays_zip("part_ids", "citations")).alias("z")).select(F.col("z.part_ids").alias("part_id"), F.col("z.citations").alias("citation"))
    if new_parts is not None:
        rows = rows.union(new_parts.select("part_id", "citation"))
    return rows.filter("part_id is not null").groupBy("part_id").agg(F.min("citation").alias("citation"))


def map_sources(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, answer): sources through ``mapping(source, mapped)``; those without an entry stay; order is kept."""
    rows = _fact_sources(concepts).join(mapping.select("source", "mapped"), "source", "left").withColumn("to", F.coalesce("mapped", "source"))
    facts = rows.groupBy("id", "pos").agg(F.first("fact").alias("fact"), F.sort_array(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("at", "to")))).getField("to").alias("source_ids"))
    return _facts_back(facts)


def _reference_tokens(answers: DataFrame, pattern: str) -> DataFrame:
    """(id, pos, lead, ref): the text before each reference and the reference; ref is null in the last row."""
    leads = F.split("answer", pattern)
    refs = F.regexp_extract_all("answer", F.lit(f"({pattern})"), F.lit(1))
    return answers.select("id", F.posexplode(F.arrays_zip(leads.alias("lead"), refs.alias("ref"))).alias("pos", "z")).select("id", "pos", "z.lead", "z.ref")


def rewrite_answer_refs(answers: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, answer): ``[n]`` by ``targets(id, n, target)`` as ``^[target]^``; a bare ``[a.b.c]`` not after a caret gets carets; others stay."""
    tokens = _reference_tokens(answers, r"\[\d+(?:\.\d+)*\]")
    number = F.regexp_extract("ref", r"^\[(\d+)\]$", 1)
    rows = tokens.withColumn("n", F.expr("try_cast(nullif(regexp_extract(ref, '^\\\\[(\\\\d+)\\\\]$', 1), '') AS INT)")).join(targets.select("id", "n", "target"), ["id", "n"], "left")
    after = F.coalesce(F.col("lead").endswith("^"), F.lit(False))
    new = (
        F.when(F.col("ref").isNull(), "")
        .when((number != "") & F.col("target").isNotNull(), F.concat(F.lit("^["), "target", F.lit("]^")))
        .when((number == "") & ~after & F.col("ref").rlike(r"^\[\d+\.\d+\.\d+\]$"), F.concat(F.lit("^"), "ref", F.lit("^")))
        .otherwise(F.col("ref"))
    )
    return rows.select("id", "pos", F.concat("lead", new).alias("t")).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "t"))).getField("t"), "").alias("answer"))


def renumber_refs(answers: DataFrame) -> DataFrame:
    """(id, answer, order) of ``answers(id, answer, n_docs)``: ``<[n]>`` renumbered ``[1], [2], ...`` by first appearance; numbers out of
    1..n_docs stay as they are. ``order`` has the old numbers."""
    tokens = _reference_tokens(answers, r"<\[\d+\]>").join(answers.select("id", "n_docs"), "id").withColumn("n", F.regexp_extract("ref", r"\d+", 0))
    inside = F.expr("CASE WHEN try_cast(nullif(n, '') AS INT) BETWEEN 1 AND n_docs THEN try_cast(nullif(n, '') AS INT) END")
    tokens = tokens.withColumn("n", inside)
    first = tokens.filter("n is not null").groupBy("id", "n").agg(F.min("pos").alias("p"))
    first = first.withColumn("new", F.row_number().over(W.partitionBy("id").orderBy("p")))
    rows = tokens.join(first.select("id", "n", "new"), ["id", "n"], "left")
    text = F.concat("lead", F.coalesce(F.concat(F.lit("["), F.col("new").cast("string"), F.lit("]")), "ref", F.lit("")))
    out = rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))).getField("t"), "").alias("answer"))
    order = first.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("new", "n"))).getField("n").alias("order"))
    return out.join(order, "id", "left").select("id", "answer", F.coalesce("order", F.array().cast("array<int>")).alias("order"))


def resolve_references(texts: DataFrame, pages: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, nth, ref, kind, content): the distinct ``^[...]^`` of each text by first appearance, as a page or chunk of a document or a node.

    ``doc.version.number`` is a page if there is one, else a chunk; two parts mean version 1; without a match it is left out. One part is a node.
    """
    refs = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\^\[([^\[\]^]+)\]\^"), F.lit(1))).alias("pos", "ref"))
    refs = refs.groupBy("id", "ref").agg(F.min("pos").alias("pos")).withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("pos")))
    part = F.split("ref", r"\.")
    refs = refs.withColumns(
        {
            "doc": F.when(F.size(part) > 1, part[0]),
            "version": F.expr("CASE WHEN size(split(ref, '[.]')) = 2 THEN 1 ELSE try_cast(get(split(ref, '[.]'), 1) AS INT) END"),
            "number": F.expr("try_cast(element_at(split(ref, '[.]'), -1) AS INT)"),
        }
    )
    of_doc = refs.filter("doc is not null")
    page = of_doc.join(pages.select("doc", "version", "number", "content"), ["doc", "version", "number"]).select("id", "nth", "ref", F.lit("page").alias("kind"), "content")
    chunk = of_doc.join(pages, ["doc", "version", "number"], "left_anti").join(chunks.select("doc", "version", "number", "content"), ["doc", "version", "number"]).select("id", "nth", "ref", F.lit("chunk"), "content")
    node = refs.filter("doc is null").join(nodes.select(F.col("node_id").alias("ref"), "content"), "ref").select("id", "nth", "ref", F.lit("node"), "content")
    return page.union(chunk).union(node)


def build_citation_map(hits: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """(id, n, target) of ``hits(id, kind, rank, node_id, doc, version, page, chunk_id)``: 1.. over cards and then chunks by rank;
    target is the node's id or ``doc.version.(page or chunk_id + chunks of the document + 1)``."""
    rows = hits.join(chunk_counts.select("doc", "version", "n_chunks"), ["doc", "version"], "left")
    place = F.coalesce("page", F.col("chunk_id") + F.coalesce("n_chunks", F.lit(0)) + 1).cast("string")
    target = F.when(F.col("kind") == "card", F.col("node_id")).otherwise(F.concat_ws(".", "doc", F.col("version").cast("string"), place))
    n = F.row_number().over(W.partitionBy("id").orderBy((F.col("kind") != "card").cast("int"), "rank"))
    return rows.select("id", n.alias("n"), target.alias("target"))
