"""Links between near copies in candidate groups of any size, against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import simhash


def _changed(rng, shingles, n):
    out = list(shingles)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.getrandbits(40)
    return out


def _components(edges, nodes):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def groups():
    """A chain whose ends are unlike, texts that are all unlike, copies of one text with more or less changed, and a small group."""
    rng = random.Random(5)
    step, core = [rng.getrandbits(40) for _ in range(100)], [rng.getrandbits(40) for _ in range(100)]
    rows = []
    for _ in range(50):
        step = _changed(rng, step, rng.choice([3, 8, 14]))
        rows.append((1, set(step)))
    rows += [(2, {rng.getrandbits(40) for _ in range(50)}) for _ in range(40)]
    rows += [(3, set(_changed(rng, core, rng.randrange(14)))) for _ in range(80)]
    rows += [(4, set(core[: 90 + k])) for k in range(10)]
    return [(7 * i + 1, group, own) for i, (group, own) in enumerate(rows)]


@pytest.mark.parametrize(("centres", "pairs", "block"), [(3, 16, 256), (1, 8, 16), (0, 8, 16)])
def test_no_link_is_lost(spark, monkeypatch, groups, centres, pairs, block):
    for name, value in (("CENTRES", centres), ("ALL_PAIRS", pairs), ("BLOCK", block)):
        monkeypatch.setattr(simhash, name, value)
    size, own = Counter(g for _, g, _ in groups), {n: s for n, _, s in groups}
    votes = {n: simhash._votes(np.array(sorted(s), np.uint64), np.ones(len(s)), np.zeros(len(s), np.int64), 1).view(np.int64)[0] for n, _, s in groups}
    rows = [(n, g, size[g], int(votes[n]), sorted(s)) for n, g, s in groups]
    sets = spark.createDataFrame(rows, "node long, component long, size long, check long, shingles array<long>")
    alike = lambda a, b: len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])
    truth = [(a, b) for i, (a, g, _) in enumerate(groups) for b, h, _ in groups[:i] if g == h and alike(a, b)]
    got = [tuple(r) for r in simhash._verified(sets).collect()]
    assert all(alike(a, b) for a, b in got)
    assert _components(got, own) == _components(truth, own)
