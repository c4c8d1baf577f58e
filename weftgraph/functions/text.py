"""Text measures and clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is, and what counts as punctuation.
TOKEN = r"\w+|[^\w\s]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: UTF-8 bytes of the texts that a Python helper takes apart at a time (one text at least).
SLICE_BYTES = 1 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches`` in slices whose texts in ``column`` have ``most`` bytes together, or that are one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def count_tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Tokens of a text: words and single other marks. Null counts 0; pass another pattern to count otherwise."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def is_trivial_text(text: Column) -> Column:
    """Nothing left without punctuation, or one character at most. Null is trivial."""
    left = F.trim(F.regexp_replace(text, PUNCTUATION, ""))
    return F.coalesce((F.length(left) == 0) | (F.length(F.trim(text)) <= 1), F.lit(True))


def normalise_details(text: Column) -> Column:
    """Lower case, punctuation out, one blank between words; null as empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""), r"\s+", " "))


def base_name(name: Column, suffix_only: bool = False) -> Column:
    """A name without its suffix: from the first underscore on, or (``suffix_only``) without a final ``_number`` only."""
    return F.regexp_replace(name, r"_\d+$" if suffix_only else r"(?s)_.*", "")


def image_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image: fitted into 2048 x 2048, its shorter side to 768 if both are longer, then 170 a tile of 512 and 85."""
    fit = F.least(F.lit(1.0), F.lit(2048.0) / F.greatest(width, height))
    w, h = F.floor(width * fit), F.floor(height * fit)
    short = F.when((w > 768) & (h > 768), F.lit(768.0) / F.least(w, h)).otherwise(F.lit(1.0))
    return (85 + 170 * F.ceil(F.floor(w * short) / 512) * F.ceil(F.floor(h * short) / 512)).cast("long")


def progress(done: Column, total: Column) -> Column:
    """Percent in steps of five, half to even, five at least."""
    return F.greatest(F.lit(5), (5 * F.bround(100.0 * done / total / 5, 0)).cast("int"))


def strip_links(text: Column) -> Column:
    """Markdown links to their text, bare addresses out, runs of white space to one blank."""
    plain = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"https?://\S+|www\.\S+", ""), r"\s+", " "))
