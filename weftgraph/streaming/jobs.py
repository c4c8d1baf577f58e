"""Progress, reference rewriting, graph folding and ingestion over streams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import progress
from ..operators.chunking import recursive_split

#: Characters of an unfinished ``[...`` that are held back.
HELD = 10
_NUMBER, _DOTTED = re.compile(r"\[(\d+)\]"), re.compile(r"\[\d+\.\d+\.\d+\]")


def stream_progress(results: DataFrame, totals: DataFrame) -> DataFrame:
    """(run, done, percent) as results arrive: a running count of ``results(run)`` against the static ``totals(run, total)``."""
    counts = results.groupBy("run").agg(F.count("*").alias("done"))
    return counts.join(totals, "run").select("run", "done", progress(F.col("done"), F.col("total")).alias("percent"))


def rewrite_tokens(text: str, targets: dict[int, str], tail: str = "", last: str = "") -> tuple[str, str, str]:
    """(text to emit, text held back, last character emitted) of the next piece of an answer.

    ``[n]`` with a target becomes ``^[target]^``, a bare ``[a.b.c]`` not after a caret gets carets, all else stays; an unfinished ``[`` with digits and
    dots of up to HELD characters waits for the next piece.
    """
    text = tail + text
    out, i = [], 0
    while i < len(text):
        if text[i] != "[":
            out.append(text[i])
            last = text[i]
            i += 1
            continue
        found = re.compile(r"\[[\d.]*\]").match(text, i)
        if found:
            ref = found.group()
            number = _NUMBER.fullmatch(ref)
            if number and int(number[1]) in targets:
                ref = f"^[{targets[int(number[1])]}]^"
            elif _DOTTED.fullmatch(ref) and last != "^":
                ref = f"^{ref}^"
            out.append(ref)
            last = ref[-1]
            i = found.end()
        elif re.fullmatch(r"\[[\d.]*", text[i:]) and len(text) - i <= HELD:
            return "".join(out), text[i:], last
        else:
            out.append("[")
            last = "["
            i += 1
    return "".join(out), "", last


def stream_rewrite_refs(pieces: DataFrame, targets: dict[int, str]) -> DataFrame:
    """(conv_id, seq, text) of a stream ``pieces(conv_id, seq, text, final)``, rewritten in order of seq within each batch.

    A conversation's state is what is held back and the last character; ``final`` lets the held text go and drops the state.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, last = state.get if state.exists else ("", "")
        for rows in [pd.concat(list(batches)).sort_values("seq", kind="stable")]:
            out = []
            for text, final in zip(rows["text"], rows["final"]):
                new, tail, last = rewrite_tokens(text or "", targets, tail, last)
                out.append(new + (tail if final else ""))
                if final:
                    tail, last = "", ""
            yield pd.DataFrame({"conv_id": key[0], "seq": rows["seq"].to_numpy(), "text": out})
        if tail or last:
            state.update((tail, last))
        elif state.exists:
            state.remove()

    return pieces.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, seq long, text string", "tail string, last string", "append", GroupStateTimeout.NoTimeout)


def stream_latest_graph(items: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], fields: list[str]):
    """A stream writer that folds items ``(map_id, id, seq, given, fields)`` into the latest graph: of each field the item of the greatest seq
    that gives it counts, in whatever order and batches items arrive.

    ``read`` returns the graph as it is and ``write`` replaces it. The graph keeps ``<field>_seq`` beside each field, null where
    the value was there before any item. A batch that is tried again folds to the same graph. Items with a null seq do not count.
    """

    def fold(batch: DataFrame, _: int) -> None:
        held = read()
        first = F.lit(-(1 << 63)).cast("long")
        old = held.select("map_id", "id", *[F.col(f) for f in fields], *[(F.coalesce(f"{f}_seq", first) if f"{f}_seq" in held.columns else first).alias(f"{f}_seq") for f in fields])
        new = batch.filter("seq is not null").select("map_id", "id", *fields, *[F.when(F.array_contains("given", f), F.col("seq")).alias(f"{f}_seq") for f in fields])
        rows = old.unionByName(new).groupBy("map_id", "id").agg(*[F.max_by(f, f"{f}_seq").alias(f) for f in fields], *[F.max(f"{f}_seq").alias(f"{f}_seq") for f in fields])
        write(rows.withColumns({f"{f}_seq": F.when(F.col(f"{f}_seq") > first, F.col(f"{f}_seq")) for f in fields}))

    return items.writeStream.foreachBatch(fold)


def stream_ingest_chunks(docs: DataFrame, size: int = 2048, overlap: int = 204) -> DataFrame:
    """(doc_id, pos, piece) of new documents as they arrive; stateless, so it runs on a stream as on a table."""
    return recursive_split(docs, size, overlap)
