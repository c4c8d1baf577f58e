"""Operators against brute force, round trips and held-out labels; nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from weftgraph.llm import flac, pieces, quality, search, simhash, suffixdedup, toxicity, urlfilter

WORDS = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "été", "日本", "eta.", "theta,"]
SCHEMA = "doc_id long, text string, n string, h string, word string, run string, score string"


def frame(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)


def some_texts(seed, n, low=0, high=90):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(low, high))) for _ in range(n)]


def test_simhash_components(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base * 3)] + [(100 + i, t + " more") for i, t in enumerate(base)] + [(200, None), (201, ""), (202, " \n"), (203, "one"), (203, "one"), (None, base[0])]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = [(i, simhash.simhash((t or "").encode(), 4)) for i, t in rows]
    part = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fp[i][1] ^ fp[j][1]).bit_count() <= 4:
                    part[i] = min(part[i], part[j])
    want = Counter((i, min(k for k, p in zip([r[0] for r in rows], part) if p == part[x] and k is not None)) for x, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("seed,pairs", [(1, 64), (2, 64), (2, 3)])
def test_near_copies_against_all_pairs(spark, monkeypatch, seed, pairs):
    """One row of each group of texts with a similarity of 0.8, by brute force; nothing else goes. Also groups compared by centres."""
    monkeypatch.setattr(simhash, "ALL_PAIRS", pairs)
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(3000)}" for _ in range(3000)]
    rows, k = [], 0
    for base in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(100, 400))]
        for copy in range(rng.choice([1, 2, 3, 12]) if pairs > 3 else rng.choice([1, 9])):
            changed = list(text)
            for _ in range(0 if copy == 0 else max(1, int(len(text) * rng.choice([0.0, 0.005, 0.012, 0.1])))):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((k, " ".join(changed)))
            k += 1
    rng.shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, "two words"), (1003, "Two words"), (None, "two words"), (None, "alone"), (None, "alone"), (1004, rows[0][1]), (1004, "another text of this id"), (1002, "two words")]
    label = list(range(len(rows)))
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    for _ in range(len(rows)):
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    want = {min((i for i in range(len(rows)) if label[i] == g), key=key) for g in set(label)}
    kept = simhash.keep_representatives(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = Counter((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    target = Counter((rows[i][0], (rows[i][1] or "").lower()) for i in want)
    assert not target - got and sum((got - target).values()) <= len(alike) * 0.03
    assert simhash.keep_representatives(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius,prefix", [(4, 10), (4, 3), (2, 6)])
def test_ball_links_join_every_close_pair(spark, radius, prefix):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 20, dtype=np.int64)
    near = np.concatenate([[c ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for _ in range(6)] for c in centre])
    values = sorted({int(v) for v in near})
    edges = simhash.ball_links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, prefix).collect()
    group = {v: v for v in values}

    def find(v):
        while group[v] != v:
            v = group[v]
        return v

    for e in edges:
        group[find(e.a)] = find(e.b)
    want = {v: v for v in values}

    def find2(v):
        while want[v] != v:
            v = want[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                want[find2(a)] = find2(b)
    same = lambda f: {frozenset(x for x in values if f(x) == f(v)) for v in values}
    assert same(find) == same(find2)


def test_repeated_passages(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(80)]
    texts = [[word() for _ in range(rng.randint(0, 70))] + passage[: rng.choice([49, 50, 60, 80])] + [word() for _ in range(rng.randint(0, 70))] for _ in range(12)]
    texts += [["same"] * 130, passage, passage, [], ["short"]]
    rows = [(i, " \n".join(t)) for i, t in enumerate(texts)] + [(90, None), (91, "")]
    got = {(r.doc_id, r.part, r.start_word, r.end_word) for r in suffixdedup.repeated_passages(frame(spark, rows)).collect()}
    seen, want = {}, set()
    grams = [(i, q, tuple(t[q : q + 50])) for i, t in enumerate(texts) for q in range(len(t) - 49)]
    times = Counter(g for _, _, g in grams)
    marks = {"repeated": set(), "later": set()}
    for i, q, g in sorted(grams):
        if times[g] > 1:
            marks["repeated"] |= {(i, q + k) for k in range(50)}
            if g in seen:
                marks["later"] |= {(i, q + k) for k in range(50)}
        seen.setdefault(g, (i, q))
    for part, cells in marks.items():
        for i, p in cells:
            if (i, p - 1) not in cells:
                end = p
                while (i, end) in cells:
                    end += 1
                want.add((i, part, p, end))
    assert got == want
    docs = frame(spark, rows)
    cut = {r.doc_id: r.text for r in suffixdedup.cut_later(docs, suffixdedup.repeated_passages(docs)).collect()}
    for i, t in enumerate(texts):
        left = [w for k, w in enumerate(t) if (i, k) not in marks["later"]]
        assert (cut[i].split() if i in cut else []) == left
    assert 90 in cut and 91 in cut and 14 not in cut
    assert suffixdedup.repeated_passages(frame(spark, [])).count() == 0


def test_repeated_ids_and_null_ids_are_rows_of_their_own(spark):
    """Rows of one id, or of none, are cut each by its own passages; of equal rows one stays."""
    p, u = " ".join(f"p{i}" for i in range(80)), " ".join(f"u{i}" for i in range(100))
    rows = [(1, p), (2, p), (2, "short text"), (2, u), (None, p + " tail"), (None, u.upper()), (3, u), (4, "v " + u.lower()), (4, "v " + u.lower()), (5, None), (5, None)]
    docs = frame(spark, rows)
    got = Counter((r.doc_id, r.text) for r in suffixdedup.cut_later(docs, suffixdedup.repeated_passages(docs)).collect())
    assert got == Counter([(None, p + " tail"), (None, u.upper()), (2, "short text"), (2, u), (4, "v "), (5, None), (5, None)])


@pytest.mark.parametrize("seed", range(6))
def test_passages_over_many_ranges(spark, seed):
    """Common passages that fill ranges of sorted suffixes and go on in the next ones, against all windows."""
    rng = random.Random(seed)
    pool = [[f"{k}x{i}" for i in range(120)] for k in range(3)] + [["a", "b"] * 60]
    texts = []
    for _ in range(90):
        t = list(rng.choice(pool))
        a, b = sorted(rng.choices(range(len(t) + 1), k=2))
        t = t[a:b] + ([f"n{rng.randrange(10**6)}"] if rng.random() < 0.4 else []) + t[b:]
        texts.append(t)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {(r.doc_id, r.part, r.start_word, r.end_word) for r in suffixdedup.repeated_passages(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    grams = [(i, q, tuple(t[q : q + 50])) for i, t in enumerate(texts) for q in range(len(t) - 49)]
    times, seen, marks = Counter(g for *_, g in grams), set(), {"repeated": set(), "later": set()}
    for i, q, g in grams:
        if times[g] > 1:
            marks["repeated"] |= {(i, q + k) for k in range(50)}
        if g in seen:
            marks["later"] |= {(i, q + k) for k in range(50)}
        seen.add(g)
    cells = {part: {(i, p) for i, x, a, b in got if x == part for p in range(a, b)} for part in marks}
    assert cells == marks


def test_search_equals_exhaustive_scoring(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 16)
    monkeypatch.setattr(search, "BLOCK_TERMS", 200)
    rows = [(i, t) for i, t in enumerate(some_texts(7, 150, 0, 25))] + [(500, None), (501, "alpha"), (501, "alpha"), (502, "beta " * 3000)]
    docs = frame(spark, rows)
    queries = docs.filter("doc_id % 10 = 0 or doc_id >= 500").select(F.col("doc_id").alias("query_id"), "text")
    got = [(r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in search.bm25_topk(docs, queries, 5).collect()]
    import re

    words = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for i, t in rows]
    n, mean = len(words), sum(len(w) for _, w in words) / len(words)
    df = Counter(x for _, w in words for x in set(w))
    want = []
    asked = {}
    for i, w in words:
        if i % 10 == 0 or i >= 500:
            asked.setdefault(i, set()).update(w)
    for q, terms in asked.items():
        scored = []
        for i, w in words:
            tf = Counter(w)
            s = sum(int(np.rint(1e6 * (np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * (tf[x] * 2.2 / (tf[x] + 1.2 * (1 - 0.75 + 0.75 * len(w) / mean)))))) for x in terms if tf[x])
            if s > 0:
                scored.append((-s, i))
        want += [(q, r + 1, i, round(-s / 1e6, 6)) for r, (s, i) in enumerate(sorted(scored)[:5])]
    assert sorted(got) == sorted(want)
    assert search.bm25_topk(frame(spark, []), queries, 5).count() == 0


def test_url_rules(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]
    urls = [None, "no scheme", "http://", "https://WWW.Example.COM/en/a?x#y", "http://a.example.com/en/x", "http://example.com", "ftp://xexample.com/en/", "http://q.net/es/1", "http://q.net/fr/es/", "http://com/?", "x://net/es"]
    want = [None, None, None, "www.example.com/en/", "example.com/en/", None, "com/", "net/es/", None, "com/", None]
    rows = spark.createDataFrame([(i, u, "x", "x", "x") for i, u in enumerate(urls * 2)], "page_id long, url string, key string, keys string, host string")
    got = urlfilter.judge_urls(rows, rules).collect()
    assert sorted((r.page_id, r.rule or "") for r in got) == sorted((i, w or "") for i, w in enumerate(want * 2))
    assert all(r.verdict == (dict(rules)[r.rule] if r.rule else "allow") for r in got)


def test_cascade_is_exact(spark):
    keys = spark.range(4000).selectExpr("cast(id as string) AS key")
    cascade = urlfilter.build_cascade(keys.filter("cast(key as int) % 37 = 5"), keys)
    assert len(cascade.levels) > 1
    assert keys.filter(cascade.contains(F.col("key")) != F.expr("cast(key as int) % 37 = 5")).count() == 0


def test_pieces_equal_sentencepiece(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    texts = ["", "  two  spaces ", "x" * 2000, "a▁b", "tab\tnew\nline", "日本語é\u0301😀"] + ["".join(rng.choices("abcthe  .,éü日\n", k=rng.randint(1, 200))) for _ in range(60)]
    rows = frame(spark, list(enumerate(texts)) + [(900, None)])
    got = {r.doc_id: r for r in pieces.decode_pieces(pieces.encode_pieces(rows, path), path).collect()}
    for i, t in enumerate(texts):
        ids = np.frombuffer(got[i].ids, "<u2").tolist()
        assert ids == sp.encode(t) and got[i].text == sp.decode(ids)
    assert got[900].ids == b"" and got[900].text == ""


def test_flac_round_trip_and_damage(spark):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(some_texts(9, 20))] + [(50, None), (51, ""), (52, "a" * 9000), (53, "".join(map(chr, rng.choices(range(32, 900), k=5000))))]
    got = {r.doc_id: r for r in flac.read_media(flac.store_media(frame(spark, rows))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        assert got[i].payload == flac.payload(raw) and got[i].n_bytes == len(raw)
        samples = np.frombuffer(got[i].payload, np.uint8).astype(int) - 128
        assert flac.read_samples(got[i].media, 10, 4200).tolist() == samples[10:4210].tolist()
    kinds = set()
    for r in got.values():
        total, _, points, base = flac.parse_stream(r.media)
        for _, offset, _ in points:
            size = flac._parse_header(r.media, base + offset)[2]
            kinds.add(r.media[base + offset + size] >> 1 & 63)
        bare = r.media[:4] + bytes([0x80]) + r.media[5:42] + r.media[base:]  # without the seek table
        assert flac.decode_streams([bare]) == [r.payload] and flac.parse_stream(bare)[2] == points
    assert 31 + flac.TAPS in kinds and 0 in kinds
    stored = flac.store_media(frame(spark, [(i, t) for i, t in rows if i is not None]))
    found = {}
    for r in flac.pcm_blocks(stored).collect():
        found.setdefault(r.doc_id, {})[r.sample] = bytes(r.pcm)
    for i, t in rows:
        blocks = sorted(found[i].items())
        assert b"".join(b for _, b in blocks) == flac.payload((t or "").encode())
        assert [k for k, _ in blocks] == list(np.cumsum([0, *(len(b) for _, b in blocks)])[:-1])
    bad = bytearray(got[53].media)
    bad[-40] ^= 4
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(bad)])


def test_flac_linear_predictor():
    """A hand-made frame of order 2 with quantised coefficients 2, -1 and no shift, as the fixed predictor of order 2."""
    x = [1, 3, 6, 8, 9, 7, 4, 2] * 8
    residual = [x[i] - (2 * x[i - 1] - x[i - 2]) for i in range(2, len(x))]
    bits = f"{0:01b}{32 + 1:06b}0" + "".join(f"{v & 255:08b}" for v in x[:2]) + f"{3 - 1:04b}{0:05b}" + "".join(f"{c & 7:03b}" for c in (2, -1)) + "00" + "0000" + f"{1:04b}"
    for r in residual:
        u = 2 * r if r >= 0 else -2 * r - 1
        bits += "0" * (u >> 1) + "1" + str(u & 1)
    head = bytes([0xFF, 0xF8, 0x70, 0x02, 0]) + (len(x) - 1).to_bytes(2, "big")
    frame_ = head + bytes([flac.crc8(head)]) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    data = np.frombuffer(frame_, np.uint8)
    frame_ += int(flac.crc16(data, np.array([0]), np.array([len(data)]))[0]).to_bytes(2, "big")
    for reserved in (2, 7, 13, 31):
        broken = frame_[: 8 + 0] + bytes([reserved << 1]) + frame_[9:-2]
        broken += int(flac.crc16(np.frombuffer(broken, np.uint8), np.array([0]), np.array([len(broken)]))[0]).to_bytes(2, "big")
        with pytest.raises(ValueError):
            flac.decode_frames(broken, [(0, len(broken), len(x))])
    coefficients_fit = flac.decode_frames(frame_, [(0, len(frame_), len(x))])[0].tolist()
    assert coefficients_fit == x


def labelled(spark, n=240):
    rng = random.Random(6)
    rows, labels = [(9001, None), (9002, ""), (None, "no id")], [(9001, 1, 0), (9003, None, None)]
    for i in range(n):
        words = rng.choices([f"{a}{b}" for a in ("re", "th", "on", "in") for b in ("ing", "ed", "er", "and")], k=60)
        good, toxic = i % 4 != 0, i % 3 == 0
        if toxic:
            words[10] = words[30] = rng.choice(["wzkkq", "jxvvu"])
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels + labels[5:8], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    held = "doc_id % 5 = 1"
    q = {r.doc_id: r.score for r in quality.score_quality(docs, quality.fit_quality(docs, labels, f"not ({held})")).collect()}
    t = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, f"not ({held})")).collect()}
    out = [i for i in q if i is not None and i < 9000 and i % 5 == 1]
    assert np.mean([(q[i] >= 0.5) == bool(truth[i].quality) for i in out]) > 0.9
    assert np.mean([(t[i] >= 0.5) == bool(truth[i].toxic) for i in out]) > 0.9
    assert len(q) == len(t) == 243 and all(0 <= v <= 1 for v in [*q.values(), *t.values()])
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect())


def test_search_skips_blocks():
    """Documents of two vocabularies in blocks of their own: blocks of the other one are never scored, and no hit is lost."""
    rng = np.random.default_rng(3)
    n, per = 40 * search.BLOCK_DOCS, 12
    doc = np.repeat(np.arange(n), per)
    slot = np.concatenate([np.sort(rng.choice(30, per, False)) + 30 * (d >= n // 2) for d in range(n)])
    gain = rng.integers(1, 1000, len(doc))
    order = np.lexsort((doc, slot))
    shard = search.Shard(n, slot[order], doc[order], gain[order].astype(float), 60)
    term = np.concatenate([np.arange(0, 10), np.arange(35, 50)])
    query = np.repeat([0, 1], [10, 15])
    q, d, s = shard.top(query, term, 2, 5, np.zeros(2))
    assert shard.skipped >= 40 and shard.scored > 0
    for k in (0, 1):
        full = np.bincount(doc, gain * np.isin(slot, term[query == k]), n)
        want = sorted(zip(-full, range(n)))[:5]
        assert sorted(zip((-s[q == k]).tolist(), d[q == k].tolist()))[:5] == want
