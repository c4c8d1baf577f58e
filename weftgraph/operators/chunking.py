"""Documents to chunks and parts, with stable numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip_links, text_slices
from ..plans.storage import materialize
from .numbering import number_rows

#: Sizes and limits of chunks.
TXT_SIZE, TXT_OVERLAP = 2048, 204
CARD_SIZE, CARD_OVERLAP = 1200, 200
MAX_TOKENS, MAX_IMAGES = 2048, 50
SAMPLE_BUDGET = 15000


# -- splitting ---------------------------------------------------------------------------------------------------------


def split_by_header(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, md)`` to (doc_id, section, header, text): cut at lines ``# ...``, whose text is the header of what follows."""
    lines = docs.select("doc_id", F.posexplode(F.split("md", "\n")).alias("pos", "line"))
    by = W.partitionBy("doc_id").orderBy("pos")
    head = F.when(F.col("line").rlike("^# "), F.trim(F.substr("line", F.lit(3))))
    lines = lines.withColumns({"header": F.last(head, True).over(by), "section": F.count(head).over(by), "is_head": head.isNotNull()})
    body = lines.groupBy("doc_id", "section").agg(F.first("header").alias("header"), F.sort_array(F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "line")))).alias("l"))
    return body.select("doc_id", "section", "header", F.trim(F.array_join(F.col("l.line"), "\n")).alias("text")).filter("text <> ''")


def _cut(text: str, separators: tuple[str, ...], size: int) -> Iterator[str]:
    """Pieces of at most ``size`` characters that make up the text; each but the first keeps the separator in front."""
    if len(text) <= size:
        yield text
        return
    for i, s in enumerate(separators):
        if s and s in text:
            break
    else:
        yield from (text[j : j + size] for j in range(0, len(text), size))
        return
    first, *others = text.split(s)
    for part in [first, *(s + x for x in others)]:
        if part:
            yield from _cut(part, separators[i + 1 :], size)


def split_text(text: str | None, size: int = TXT_SIZE, overlap: int = TXT_OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", " ")) -> list[str]:
    """Chunks of at most ``size`` characters, each starting with up to ``overlap`` characters of the one before.

    The text is cut at the first of the separators that it has, and longer pieces at the next; pieces then fill chunks
    in order. The overlap is made of whole pieces. Chunks are stripped; empty ones are left out.
    """
    out, held, total = [], [], 0
    for piece in _cut(text or "", separators, size):
        if total + len(piece) > size and held:
            out.append("".join(held))
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    out.append("".join(held))
    return [c for c in (x.strip() for x in out) if c]


def recursive_split(docs: DataFrame, size: int = TXT_SIZE, overlap: int = TXT_OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, piece) of :func:`split_text` on every row; no shuffle. A task holds one Arrow batch, and of its texts and pieces as
    Python strings one slice (:func:`text_slices`)."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, 1):
            pieces = [split_text(t, size, overlap) for t in rows.column(1).to_pylist()]
            n = np.array([len(p) for p in pieces])
            ids = rows.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([i for k in n for i in range(k)], pa.int32()), pa.array([x for p in pieces for x in p], pa.string())], [id_col, "pos", "piece"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, pos int, piece string")


# -- grouping ----------------------------------------------------------------------------------------------------------


def greedy_groups(sizes: DataFrame, keys: list[str], order: str, budgets: dict[str, int], out: str = "grp") -> DataFrame:
    """``out`` = 1, 2, ...: in ``order``, a row joins the open group while every budget's running sum holds, else opens one.

    Only keys, order and sizes travel to the helper, never texts: one array a group of keys (a document), many of them a batch.
    Null sizes count as 0.
    """
    kinds = {f.name: f.dataType.simpleString() for f in sizes.select(*keys, order).schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", _rows array<struct<{order}: {kinds[order]}, {out}: bigint>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["_rows"] = [[{order: r[order], out: g} for r, g in zip(own, group_numbers([[r[c] or 0 for c in budgets] for r in own], list(budgets.values())))] for own in rows["_rows"]]
            yield rows

    lists = sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *budgets))).alias("_rows"))
    return lists.mapInPandas(run, schema).select(*keys, F.explode("_rows").alias("_r")).select(*keys, "_r.*")


def group_numbers(sizes: list[list[float]], most: list[float]) -> list[int]:
    """Number of the group of each row of ``sizes``: a row opens a new one where a sum would go over its budget."""
    group, totals, out = 0, None, []
    for values in sizes:
        if totals is None or any(t + v > m for t, v, m in zip(totals, values, most)):
            group, totals = group + 1, [0] * len(most)
        totals = [t + v for t, v in zip(totals, values)]
        out.append(group)
    return out


def merge_small_chunks(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``chunks(doc_id, pos, text, header, tokens)`` to (doc_id, grp, text, header, tokens): neighbours merged while their tokens fit.

    Texts are joined by a blank line, differing headers by " and "; token sums are kept, not counted again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc_id, own in zip(rows["doc_id"], rows["l"]):
                held: dict[int, list] = {}
                for grp, row in zip(group_numbers([[r["tokens"] or 0] for r in own], [max_tokens]), own):
                    held.setdefault(grp, []).append(row)
                for grp, part in held.items():
                    heads = dict.fromkeys(r["header"] for r in part if r["header"] is not None)
                    out.append((doc_id, grp, "\n\n".join(r["text"] for r in part if r["text"] is not None), " and ".join(heads) if heads else None, sum(r["tokens"] or 0 for r in part)))
            yield pd.DataFrame(out, columns=["doc_id", "grp", "text", "header", "tokens"])

    lists = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "header", F.col("tokens").cast("long").alias("tokens")))).alias("l"))
    return lists.mapInPandas(run, f"doc_id {chunks.schema['doc_id'].dataType.simpleString()}, grp long, text string, header string, tokens long")


def group_pages(pages: DataFrame, max_tokens: int = MAX_TOKENS, max_images: int = MAX_IMAGES) -> DataFrame:
    """``pages(doc_id, page_id, tokens, n_images)`` with ``grp``: pages in order, closed when either budget would overflow."""
    return pages.join(greedy_groups(pages, ["doc_id"], "page_id", {"tokens": max_tokens, "n_images": max_images}), ["doc_id", "page_id"])


def split_oversized_pages(pages: DataFrame, tokens: Column, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pages(doc_id, page_id, text, n_images)`` as (doc_id, page_id, piece, text, n_images): pages over ``max_tokens`` tokens
    are split by characters with a tenth of overlap; images stay with the first piece, if it leaves room for any tokens."""
    pages = pages.withColumn("_tokens", tokens).withColumn("_key", F.struct("doc_id", "page_id"))
    small = pages.filter(F.col("_tokens") <= max_tokens).select("doc_id", "page_id", F.lit(0).alias("piece"), "text", "n_images")
    big = pages.filter(F.col("_tokens") > max_tokens)
    key = F.to_json(F.struct("doc_id", "page_id")).alias("_id")
    pieces = recursive_split(big.select(key, "text"), max_tokens, max_tokens // 10, "_id").join(big.select(key, "doc_id", "page_id", "n_images"), "_id")
    first = (F.col("pos") == 0) & (F.length("piece") < max_tokens)
    return small.union(pieces.select("doc_id", "page_id", F.col("pos").alias("piece"), F.col("piece").alias("text"), F.when(first, F.col("n_images")).otherwise(0)))


def page_chunk_text(pages: DataFrame, keys: list[str], prefix: bool = True) -> DataFrame:
    """``pages(..., page_id, text)`` to one text a chunk: ``Page n: ...`` lines in page order, and the sorted distinct pages."""
    rows = pages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page_id", "text"))).alias("l"))
    line = (lambda p: F.concat(F.lit("Page "), p["page_id"].cast("string"), F.lit(": "), p["text"])) if prefix else (lambda p: p["text"])
    return rows.select(*keys, F.array_join(F.transform("l", line), "\n").alias("text"), F.array_sort(F.array_distinct("l.page_id")).alias("page_ids"))


def whole_documents(docs: DataFrame) -> DataFrame:
    """One chunk a document; empty texts are dropped."""
    return docs.filter(F.trim("text") != "").select("doc_id", "text")


# -- numbers -----------------------------------------------------------------------------------------------------------


def number_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks(doc_id, pos, text, header)`` with chunk_id = 1.. in each document, flat_chunk_id = 1.. over all, and content
    (``# header`` in front of the text where there is one)."""
    own = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    content = F.when(F.col("header").isNotNull(), F.concat(F.lit("# "), "header", F.lit("\n"), "text")).otherwise(F.col("text"))
    return number_rows(chunks.withColumns({"chunk_id": own, "content": content}), ["doc_id"], ["pos"], "flat_chunk_id").select("doc_id", "chunk_id", "flat_chunk_id", "content")


def flat_parts(chunks: DataFrame, start_part_id: int = 0) -> DataFrame:
    """``chunks(doc_id, chunk_id, flat_chunk_id, page_ids)`` to parts: one a page, or one for a chunk without pages.

    citation = ``doc.page`` or ``doc.chunk``; flat_part_id = start_part_id + 1, ... by flat_chunk_id and page.
    """
    pages = F.when(F.size("page_ids") > 0, F.col("page_ids"))
    rows = chunks.select("doc_id", "chunk_id", "flat_chunk_id", F.posexplode_outer(pages).alias("pos", "page_id"))
    rows = rows.withColumns({"pos": F.coalesce("pos", F.lit(0)), "citation": F.concat_ws(".", F.col("doc_id").cast("string"), F.coalesce("page_id", "chunk_id").cast("string"))})
    return number_rows(rows, ["flat_chunk_id"], ["pos"], "flat_part_id", start_part_id + 1).select("doc_id", "chunk_id", "flat_chunk_id", "page_id", "citation", "flat_part_id")


# -- search documents and samples --------------------------------------------------------------------------------------


def node_search_docs(nodes: DataFrame) -> DataFrame:
    """``nodes(id, title, question, details)`` to (id, kind, text): pieces of the details, the title and the question."""
    pieces = recursive_split(nodes, CARD_SIZE, CARD_OVERLAP, "id", "details").select("id", F.lit("details").alias("kind"), F.col("piece").alias("text"))
    for c in ("title", "question"):
        pieces = pieces.union(nodes.filter(F.coalesce(F.col(c), F.lit("")) != "").select("id", F.lit(c), c))
    return pieces


def page_description_chunks(descriptions: DataFrame) -> DataFrame:
    """``descriptions(doc_id, page, json)`` to (doc_id, page, pos, text): summary, key fact, then each image's and table's description and key fact.

    Code fences and commas before a closing bracket are repaired first; empty entries and "no images/tables are present" are left out;
    line breaks become blanks. What is still no JSON gives no rows.
    """
    item = "array<struct<description:string,keyfact:string>>"
    fixed = F.regexp_replace(F.regexp_replace("json", r"(?s)^.*?```(?:json)?|```.*$", ""), r",\s*([\]}])", "$1")
    read = descriptions.select("doc_id", "page", F.from_json(fixed, f"summary string, keyfact string, images {item}, tables {item}").alias("d"))
    parts = F.concat(
        F.array("d.summary", "d.keyfact"),
        F.flatten(F.transform(F.concat(F.coalesce("d.images", F.array().cast(item)), F.coalesce("d.tables", F.array().cast(item))), lambda x: F.array(x["description"], x["keyfact"]))),
    )
    flat = F.transform(F.filter(parts, lambda t: t.isNotNull()), lambda t: F.trim(F.regexp_replace(t, r"\s*\n\s*", " ")))
    kept = F.filter(flat, lambda t: (t != "") & ~F.lower(t).rlike("no (images|tables)( or (images|tables))? (are|is) present"))
    return read.select("doc_id", "page", F.posexplode(kept).alias("pos", "text"))


def split_on_separators(text: Column, pattern: str, min_words: int) -> Column:
    """Pieces cut at matches of ``pattern`` (kept with what precedes it), only where the current piece has ``min_words`` words."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).+?(?:{pattern}|\\z)"), F.lit(0))
    words = lambda t: F.regexp_count(t, F.lit(r"\S+"))
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    joined = F.aggregate(
        parts,
        begin,
        lambda a, p: F.when(words(a["now"]) >= min_words, F.struct(F.array_append(a["done"], a["now"]).alias("done"), p.alias("now"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["now"], p).alias("now"))),
        lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])),
    )
    return F.filter(F.transform(joined, lambda t: F.regexp_replace(t, r"\A\s+|\s+\z", "")), lambda t: t != "")


def language_sample(docs: DataFrame, budget: int = SAMPLE_BUDGET) -> DataFrame:
    """``docs(map_id, doc_id, text)`` to (map_id, doc_id, sample): the first min(len, max(100, floor(len / total * budget))) characters
    of the text without links; documents that are empty then are dropped. Totals are joined, one row a map: a table of their own, so Spark knows how small they are
    and sends them to the texts, and a map's texts do not meet in a task."""
    clean = docs.select("map_id", "doc_id", strip_links(F.col("text")).alias("t")).filter("t <> ''")
    total = materialize(clean.groupBy("map_id").agg(F.sum(F.length("t")).alias("total")), "totals")
    n = F.greatest(F.lit(100), F.floor(F.length("t") * F.lit(budget) / F.col("total")).cast("int"))
    return clean.join(total, "map_id").select("map_id", "doc_id", F.substr("t", F.lit(1), n).alias("sample"))


def dominant_language(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """(map_id, lang): the label with most characters of ``docs(map_id, lang, text)``, "English" without any; ties by name."""
    totals = docs.filter("lang is not null").groupBy("map_id", "lang").agg(F.sum(F.length("text")).alias("n"))
    best = totals.groupBy("map_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang"))["lang"].alias("lang"))
    return maps.select("map_id").distinct().join(best, "map_id", "left").select("map_id", F.coalesce("lang", F.lit("English")).alias("lang"))


def document_blocks(chunks: DataFrame, start: int = 0, simple: bool = False) -> DataFrame:
    """``chunks(doc_id, chunk_id, text)`` to (doc_id, block): ``<document id>``, ``<chunk n>text</chunk>`` in order, ``</document>``;
    n = chunk_id + start + 1. ``simple`` leaves out the chunk tags and empty texts."""
    rows = chunks.filter(F.trim("text") != "") if simple else chunks
    number = (F.col("chunk_id") + start + 1).cast("string")
    line = F.col("text") if simple else F.concat(F.lit("<chunk "), number, F.lit(">"), "text", F.lit("</chunk>"))
    lines = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", line.alias("line")))).alias("l"))
    return lines.select("doc_id", F.concat(F.lit("<document "), F.col("doc_id").cast("string"), F.lit(">\n"), F.array_join("l.line", "\n"), F.lit("\n</document>")).alias("block"))
