"""Every gram keeps its own ratio, whatever other grams the corpus has."""

import random
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import toxicity


def test_grams_never_take_the_ratio_of_others(spark):
    """Frequent ordinary pairs of letters that share a hash bucket of 21 bits with the grams of a rare toxic word."""
    letters = np.array([list(chr(c).encode()) for c in range(128, 2048)], np.int64) @ [256, 1]
    pairs = (letters[:, None] << 16 | letters).ravel()
    bucket = lambda k: (k * 1640531527 & (1 << 52) - 1) >> 31
    raw = np.frombuffer(b"wzkkqjx", np.uint8)
    toxic = toxicity.gram_keys(raw, np.array([0, len(raw)]))[0]
    strangers = pairs[np.isin(bucket(pairs), bucket(toxic))]
    assert len(strangers) > 5
    ordinary = " ".join(int(k).to_bytes(4, "big").decode() for k in strangers)
    rows = [(i, ordinary * 20) for i in range(20)] + [(20 + i, "wzkkqjx") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 20)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    grams, _ = toxicity.likelihood_ratios(toxicity.gram_counts(docs.join(labels, "doc_id").select("toxic", "text")))
    exact = {r.key: r.ratio for r in grams.collect()}
    whole, most, stretches = model.ratios(raw, np.array([0, len(raw)]))
    assert whole[0] * len(raw) == pytest.approx(sum(exact[k] for k in toxic.tolist()), rel=1e-5) and most[0] == pytest.approx(whole[0] * len(raw) / toxicity.WINDOW) and stretches[0] == 1
    unseen = np.frombuffer(b"0000", np.uint8)
    assert model.ratios(unseen, np.array([0, 4]))[1][0] == pytest.approx(model.contexts.find(np.array([0x202020]))[0][0] / toxicity.WINDOW, rel=1e-5)


def literal_model(texts):
    """Interpolated Kneser-Ney by its formula, from counters: each class discounts its own counts, lower orders count preceding bytes of both."""
    order, d = toxicity.ORDER, toxicity.DISCOUNT
    counts = [Counter(), Counter()]
    for text, toxic in texts:
        raw = b" " * (order - 1) + text
        counts[toxic].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    kinds = {order - 1: Counter(g[1:] for g in set(counts[0]) | set(counts[1]))}
    for k in range(order - 2, 0, -1):
        kinds[k] = Counter(g[1:] for g in kinds[k + 1])

    def shared(gram):
        if not gram:
            return 1 / 256
        same = {g: n for g, n in kinds[len(gram)].items() if g[:-1] == gram[:-1]}
        return (same[gram] - d + d * len(same) * shared(gram[1:])) / sum(same.values())

    def chance(gram, c):
        same = {g: n for g, n in counts[c].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        given = d * len(same) / total if total else 1.0
        return max(counts[c][gram] - d, 0) / max(total, 1) + given * shared(gram[1:])

    return {g: float(np.log(chance(g, 1) / chance(g, 0))) for g in set(counts[0]) | set(counts[1])}


def test_ratios_equal_the_formula(spark):
    texts = [(b"the cat sat on the mat", 0), (b"a cat and a hat", 0), (b"the bad bad cat", 1), (b"bad hat", 1), (b"tha", 0)]
    rows = spark.createDataFrame([(bool(y), t.decode()) for t, y in texts], "toxic boolean, text string")
    grams, _ = toxicity.likelihood_ratios(toxicity.gram_counts(rows))
    got = {int(r.key).to_bytes(toxicity.ORDER, "big"): r.ratio for r in grams.collect()}
    want = literal_model(texts)
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)


def test_scores_do_not_rise_with_length(spark):
    """Joined ordinary texts score as low as their parts; a joined text with one toxic part stays high."""
    rng = random.Random(5)
    stems = ["".join(rng.choices("abdeghiklmnorstu", k=rng.randint(2, 4))) for _ in range(60)]
    plain = lambda n: " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        words = plain(rng.randint(10, 200)).split()
        if i % 6 == 0:
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["wzkkqx", "jxvvuz"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(labels, "doc_id long, toxic int"))
    mean = lambda n, tail="": np.mean([model.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in ((plain(50 * n) + tail).encode() for _ in range(40))])
    one, many = mean(1), mean(20)
    assert one < 0.1 and many < 0.1 and many < one + 0.03
    assert mean(2, " wzkkqx jxvvuz wzkkqx") > 0.7
