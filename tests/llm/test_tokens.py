"""Separator scan and packing against direct tokenisation."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import packing, separators, wordcodes
from weftgraph.llm.bytescan import text_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (1, "Hello world, it's a   test\t\n of Ünïcödé — naïve 日本語 text 123!"), (2, None), (3, ""), (4, "   \n "), (5, "<|endoftext|> inside <|startoftext|>x"),
    (6, "word " * 5000), (6, "word " * 5000), (None, "no id at all"), (7, "é ́combining  nbsp　wide"), (8, "don't they're 'S we'LL"),
    *[(100 + i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma,", "delta.", "Epsilon", "zeta!"], k=40 + i))) for i in range(60)],
]


ODD = ["<|endoftext|> x", "it's DON'T 'll", "é É ß ẞ İi ŉ ǅ", "a--b c- -c ...", "x2y 2021, ½", "Ａ ª", "a\x85b a\x1cb", "÷é é÷ É.", "z" * 300, "\ufeffx", "가 각", "a\0b", "ab\u200bcd", "naïve façade---", "Ça va&&& é"]


@pytest.mark.parametrize("special", [False, True])
def test_word_ids_equal_the_library(special):
    """Merges in arrays, words kept between texts, and words whose hashes collide."""
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices("abethinonréüß .,'-3", k=rng.randint(0, 300))) for _ in range(200)]
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = special
    want = [[*e.ids, 1] for e in library.encode_batch(texts, add_special_tokens=False)]
    coder = wordcodes.WordEncoder(PATH, special)
    for _ in range(2):
        ids, firsts = coder.encode(*text_bytes(pa.array(texts)), 1)
        assert [ids[a:b].tolist() for a, b in zip(firsts, firsts[1:])] == want


def test_colliding_hashes_do_not_change_ids(monkeypatch):
    real = wordcodes.word_hashes
    monkeypatch.setattr(wordcodes, "word_hashes", lambda *a: real(*a) % np.uint64(11))
    test_word_ids_equal_the_library(False)


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string").repartition(3)


def direct(text, special):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = special
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_counts_equal_direct_tokenisation(spark, block):
    blocks, order = separators.write_token_stream(docs(spark), PATH, 49407, block)
    found = order.join(separators.document_counts(blocks, 49407, "<u2", block), ["file_id", "doc_no"]).collect()
    assert sorted(((r.doc_id or -1), r.n_tokens) for r in found) == sorted(((i or -1), len(direct(t, True))) for i, t in TEXTS)


def test_raw_files_and_open_end(spark, tmp_path):
    np.array([9, 4, 4, 0, 0, 5, 6], "<u2").tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    np.array([1, 0], "<u2").tofile(tmp_path / "c.bin")
    blocks = separators.read_token_files(spark, str(tmp_path), 2, 2)
    found = separators.document_counts(blocks, 0, "<u2", 2).collect()
    assert sorted((r.doc_no, r.start, r.n_tokens, r.ended) for r in found) == [(0, 0, 1, True), (0, 0, 3, True), (1, 4, 0, True), (2, 5, 2, False)]


def test_empty_table(spark):
    assert separators.count_tokens(docs(spark, []), PATH, 49407).count() == 0
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("shard", [1 << 18, 3000])
def test_packing_keeps_every_token_once(spark, shard):
    pieces = packing.pack_documents(docs(spark), PATH, 1, 256, shard).toPandas()
    got = []
    for (_, crc), rows in pieces.assign(k=pieces.doc_id.fillna(-1)).groupby(["k", "doc_tokens"]):
        got.append(int(rows.length.sum()))
    want = {}
    for i, t in TEXTS:
        n = len(direct(t, False)) + 1
        want[(i or -1, n)] = want.get((i or -1, n), 0) + n
    assert sorted(got) == sorted(want.values())
    one = pieces[pieces.doc_id == 1].sort_values("start")
    assert b"".join(one.ids) == np.array([*direct(TEXTS[0][1], False), 1], "<u4").tobytes() and zlib.crc32(one.ids.iloc[0]) >= 0
    for _, rows in pieces.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 256
    full = pieces.groupby("sequence_id").length.sum()
    assert (full < 256).sum() <= pieces.sequence_id.floordiv(1 << 40).nunique()


def test_seed_takes_its_best_neighbours():
    rng = np.random.default_rng(1)
    documents = [np.append(rng.integers(0, 50, 30) + 100 * (i % 2), 1).astype("<u2") for i in range(40)]
    idf = np.ones(300)
    ids, firsts = np.concatenate(documents), np.arange(41) * 31
    pieces, _, _ = packing.pack_shard(ids, firsts, idf, 30.0, 62)
    index = packing.ShardIndex(ids, firsts, idf, 30.0)
    used = set()
    for sequence in range(20):
        members = [p[0] for p in pieces if p[3] == sequence]
        seed = members[0]
        used.add(seed)
        scores = index.scores(seed)
        assert members[1] == min((d for d in range(40) if d not in used), key=lambda d: (-scores[d], d))
        used.add(members[1])
