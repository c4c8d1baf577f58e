"""Periodic runs against brute force: random and periodic words, planted tails, nulls, empty and long texts, repeats, empty tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from weftgraph.llm import queries, runs
from weftgraph.llm.bytescan import mix

SF = "/root/testdata/sf0.001"


def brute(w):
    """(start, length, period) of all runs: every period by itself, then the least one of each interval."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def words_of(rng):
    k, n = rng.choice([1, 2, 3, 5, 40]), rng.choice([0, 1, 5, 23, 24, 25, 60, 150, 300])
    w = [rng.randrange(k) for _ in range(n)]
    if n > 10 and rng.random() < 0.6:
        for _ in range(rng.randint(1, 4)):
            p, a = rng.randint(1, max(1, n // 4)), rng.randrange(n)
            for i in range(a + p, min(n, a + rng.randint(1, 6) * p + rng.randint(0, p))):
                w[i] = w[i - p]
    elif rng.random() < 0.2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(100):
        texts = [words_of(rng) for _ in range(rng.randint(1, 8))]
        first = np.cumsum([0] + [len(t) for t in texts])
        text, start, end, period = runs.word_runs(mix(np.array([x + 1 for t in texts for x in t], np.uint64)), first)
        got = [[] for _ in texts]
        for k, s, e, q in zip(text.tolist(), start.tolist(), end.tolist(), period.tolist()):
            got[k].append((s, e - s, q))
        assert got == [sorted(brute(t), key=lambda r: (r[0], r[2])) for t in texts]


def test_grammar_gives_its_words_back():
    rng = random.Random(3)
    words = np.array([rng.randrange(3) for _ in range(400)] + [0, 1] * 90 + [2] * 77)
    stretch = np.repeat([0, 1, 2], [300, 200, len(words) - 500])
    left, right, symbols, owner = runs.re_pair(words, stretch)
    base = int(words.max()) + 1

    def spell(x):
        return [x] if x < base else spell(left[x - base]) + spell(right[x - base])

    assert [y for x in symbols.tolist() for y in spell(x)] == words.tolist() and len(symbols) < len(words) / 2
    assert [k for x, k in zip(symbols.tolist(), owner.tolist()) for _ in spell(x)] == stretch.tolist()
    pairs = [p for k in range(3) for p in zip(symbols[owner == k][:-1].tolist(), symbols[owner == k][1:].tolist())]
    assert len(pairs) - len(set(pairs)) < len(pairs) / 3


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(brute(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_rows_with_nulls_empty_and_long_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(f"été{x}" for x in words_of(rng)) for _ in range(60)] + [None, "", " \t\n", "one", "a b c " * 40 + "x", "same " * 900]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (7, texts[7]), (7, "z " * 30), (10**12, " ".join(str(i % 700) for i in range(2500)))]
    docs = spark.createDataFrame([(i, t, "x", "x", 1) for i, t in rows], "doc_id long, text string, h string, runs string, n_runs int").repartition(3)
    key = lambda r: tuple(map(str, r))
    got = runs.periodic_runs(docs, planted=True)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    plain = {r.doc_id: r for r in runs.periodic_runs(docs.filter("doc_id in (64, 65)")).collect()}
    assert [tuple(x) for x in plain[64].runs] == [(0, 120, 3)] and [tuple(x) for x in plain[65].runs] == [(0, 900, 1)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_on_given_tables(spark):
    got = queries.QUERIES["op13_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [expected(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 2500").collect()]
    have = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(want) > 100 and all(have[r[0]] == r for r in want) and any(r[1] for r in want)
