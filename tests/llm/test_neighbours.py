"""Like documents meet in a window although the corpus has many shards."""

import random

import numpy as np
import public_tokenizers

from weftgraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_neighbours_are_found_across_many_shards(spark):
    """40 subjects of 12 documents each, in shards of about 24 documents: random shards hold less than one neighbour a seed."""
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("rk", "nd", "st", "lm", "sh")]
    subjects = [rng.sample(words, 8) for _ in range(40)]
    rows = [(k, " ".join(rng.choices(subjects[k % 40], k=60))) for k in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pieces = packing.pack_documents(docs, PATH, 1, 512, 3000).toPandas()
    assert pieces.length.sum() > 10 * 3000
    alike = []
    for _, window in pieces[pieces.start == 0].sort_values("offset").groupby("sequence_id"):
        subject = window.doc_id % 40
        alike += (subject.iloc[1:] == subject.iloc[0]).tolist()
    assert np.mean(alike) > 0.6


def test_equal_rows_do_not_gather(spark):
    """Rows that are equal in id and text have keys of their own, so ranges can part them, and each shard keeps its size."""
    docs = spark.createDataFrame([(7, "one text many times " * 5)] * 300, "doc_id long, text string")
    tokens = packing.token_documents(docs, PATH, 1)
    shared = spark.sparkContext.broadcast(np.ones(49408))
    keys = packing._placed(tokens, "<u2", shared, 20.0).select("key").collect()
    assert len(set(keys)) > 290 and len({k.key >> packing._TIE_BITS for k in keys}) == 1
    pieces = packing.pack_documents(docs, PATH, 1, 64, 500).toPandas()
    assert pieces.length.sum() == 300 * 21 and (pieces.groupby("sequence_id").length.sum() < 64).sum() <= pieces.sequence_id.floordiv(1 << 40).nunique()
