"""Citations inside texts and answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_trivial_text

#: A reference in a text, and the source of text that cites none.
REFERENCE = r"\^\[(\d+(?:\.\d+)*)\]\^"
NO_SOURCE = "0.0"


def parse_cited_text(details: Column) -> Column:
    """Facts of a cited text: what stands before a reference has that single source, the rest ``0.0``. Trivial facts are out.

    Of two references side by side the second has no text before it, so the fact keeps one source.
    """
    texts = F.split(details, REFERENCE)
    sources = F.concat(F.regexp_extract_all(details, F.lit(REFERENCE), F.lit(1)), F.array(F.lit(NO_SOURCE)))
    pairs = F.zip_with(texts, sources, lambda t, s: F.struct(F.trim(t).alias("fact"), F.array(F.coalesce(s, F.lit(NO_SOURCE))).alias("source_ids")))
    return F.filter(pairs, lambda p: ~is_trivial_text(p["fact"]))


def upgrade_citations(answer: Column) -> Column:
    """Two-part sources ``a.b`` become ``a.1.b``."""

    def full(s: Column) -> Column:
        return F.when(F.size(F.split(s, r"\.")) == 2, F.regexp_replace(s, r"^([^.]*)\.([^.]*)$", "$1.1.$2")).otherwise(s)

    return F.transform(answer, lambda f: F.struct(f["fact"].alias("fact"), F.transform(f["source_ids"], full).alias("source_ids")))


def has_old_citations(answer: Column) -> Column:
    return F.exists(answer, lambda f: F.exists(f["source_ids"], lambda s: F.size(F.split(s, r"\.")) == 2))


def citation_set(answer: Column) -> Column:
    """Sorted distinct sources of all facts."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(answer, lambda f: f["source_ids"]))))


def spread_sources(answer: Column, part_ids: Column) -> Column:
    """Every fact gets the concept's sorted part ids."""
    return F.transform(answer, lambda f: F.struct(f["fact"].alias("fact"), F.array_sort(part_ids).alias("source_ids")))


def render_answer(answer: Column) -> Column:
    """``fact[1][2] fact[3]``."""
    marks = F.transform(answer, lambda f: F.concat(f["fact"], F.array_join(F.transform(f["source_ids"], lambda s: F.concat(F.lit("["), s.cast("string"), F.lit("]"))), "")))
    return F.array_join(marks, " ")


def fix_references(text: Column) -> Column:
    """``^[0]^`` out; a caret shared by two references doubled, also with a blank before it; ``]^ ^[`` to ``]^^[``."""
    out = F.regexp_replace(text, r"\^\[0\]\^", "")
    out = F.regexp_replace(out, r"(?<=\]) ?\^(?=\[\d+(?:\.\d+)*\]\^)(?<!\]\^\^)", "^^")
    return F.regexp_replace(out, r"\]\^ \^\[", "]^^[")


def assemble_details(statements: Column) -> Column:
    """``statement ^[doc.chunk]^`` joined by blanks from an array of {statement, doc, chunk}; without a statement skipped, without a chunk ``^[doc]^``."""
    kept = F.filter(statements, lambda s: s["statement"].isNotNull() & (s["statement"] != ""))
    mark = lambda s: F.concat(s["statement"], F.lit(" ^["), F.concat_ws(".", s["doc"], s["chunk"]), F.lit("]^"))
    return F.array_join(F.transform(kept, mark), " ")
