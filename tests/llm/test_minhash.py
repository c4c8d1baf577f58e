"""MinHash components against exact similarities of all pairs; nulls, empty and short texts, copies, repeated ids, hot groups, empty tables."""

import random
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import minhash, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                part[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    out = Counter()
    for k, (i, _) in enumerate(rows):
        c = least[root(k)] if sets[k] else i
        out[(i, len(sets[k]), c, i == c)] += 1
    return out


def group(rng, centre, copies, change):
    out = []
    for _ in range(copies):
        text = list(centre)
        for at in rng.sample(range(len(text)), max(1, int(change * len(text)))):
            text[at] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 8)])
def test_against_all_pairs(spark, monkeypatch, seed, block):
    """Groups whose members are alike only through their centre, groups near the threshold, and what must not link."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "FAN", 3)
    rng = random.Random(seed)
    texts = []
    for k in range(14):
        centre = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 160))]
        texts += [" ".join(centre)] * (k % 3) + group(rng, centre, rng.choice([1, 3, 9]), rng.choice([0.01, 0.03, 0.05, 0.07, 0.12]))
    texts += ["A b c d E f", "a b c d e", "a b c d e f g", "x y", "X  Y", "x", "x", "y x", "x y x y x y"]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \t"), (None, texts[0]), (None, "alone here now"), (None, None), (3, texts[9]), (3, texts[3])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1, "x") for i, t in rows], "doc_id long, text string, sid string, n int, component string").repartition(3)
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs).collect()) == brute(rows)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_keeps_what_may_be_similar():
    least = minhash.least_matches(0.8, 1e-7)
    assert len(least) == minhash.BANDS * minhash.ROWS // minhash.BATCH and (np.diff(least) > 0).all()
    rng = np.random.default_rng(1)
    for similarity, kept in ((0.8, 1.0), (0.3, 0.0)):
        a = rng.integers(0, 256, (4000, minhash.BANDS * minhash.ROWS)).astype(np.uint8)
        b = np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 256, a.shape).astype(np.uint8))
        n, every = np.full(4000, 100), np.arange(4000)
        assert abs(len(minhash._survive(a, b, n, n, every, every, 0.8, least)[0]) / 4000 - kept) < 0.001


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op12_minhash_near_dedup"](spark, SF)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and Counter(tuple(r) for r in got.collect()) == brute(rows)
