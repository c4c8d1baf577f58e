"""Drops rows that a later exact join would drop, before their texts are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import hashed_bitmap, is_set

#: Bits of the bitmap (8 MB), whatever the number of ids. Past some ten million ids it lets ever more rows through.
BITMAP_BITS = 1 << 26


def prefilter(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``rows`` whose id may be in ``ids``: every id that is, and a few that are not. An exact join must follow."""
    slot = F.pmod(F.xxhash64(id_col), F.lit(BITMAP_BITS)).alias("h")
    shared = hashed_bitmap(ids.select(slot), BITMAP_BITS)
    last = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_set(shared.value, batch.column(last).to_numpy()))).select(range(last))

    return rows.select("*", slot).mapInArrow(run, rows.schema)
