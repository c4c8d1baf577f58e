"""Stems of English terms against the published sample vocabulary and cases of every rule."""

import math
import random

from pyspark.sql import functions as F

from weftgraph.functions.stems import english_stems
from weftgraph.operators import retrieval as R

#: Words and their published stems.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knife knife knight knight knightly knight knights knight knit knit
knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker
knocking knock knocks knock knot knot knots knot""".split()
CASES = """sky sky skies sky dying die news news inning inning innings inning proceed proceed proceeding proceed exceeds exceed ties tie cries cri gas gas
this this gaps gap kiwis kiwi hopping hop hoped hope hoping hope fall fall falling fall luxuriated luxuri sized size cry cri by by say say
happy happi enjoy enjoy youth youth boyish boyish generate generat generously generous general general communism communism community communiti
arsenal arsenal arsenic arsenic rational ration relational relat digitizer digit feudalism feudal hopefulness hope callousness callous
geologi geolog formative format adoption adopt replacement replac adjustment adjust sensibility sensibl rate rate controlling control
roll roll agreed agre feed feed bleed bleed yes yes abyss abyss tr tr a a w123s w123s running run runs run dog's dog 'tis tis""".split()


def pairs(text):
    return dict(zip(text[::2], text[1::2]))


def test_published_vocabulary(spark):
    want = pairs(STEMS)
    got = english_stems(spark.createDataFrame([(w,) for w in want], "term string"))
    assert {r.term: r.stem for r in got.collect()} == want


def test_cases_of_the_rules(spark):
    want = pairs(CASES) | {"": "", None: None, "é": "é", ",": ","}
    got = english_stems(spark.createDataFrame([(w,) for w in want], "term string"))
    assert {r.term: r.stem for r in got.collect()} == want


def test_tokens_keep_their_order_and_empty_rows(spark):
    rows = spark.createDataFrame([(1, ["running", ",", "dogs", "running"], "x"), (2, [], "y"), (3, None, "z"), (None, ["Y"], "n")], "id long, tokens array<string>, stem string")
    got = {r.id: (r.tokens, r.stem) for r in R.stem_tokens(rows, "id").collect()}
    assert got == {1: (["run", ",", "dog", "run"], "x"), 2: ([], "y"), 3: ([], "z"), None: (["y"], "n")}
    assert R.stem_tokens(rows.limit(0), "id").count() == 0


def test_index_of_stems_adds_what_has_one_stem(spark):
    rows = spark.createDataFrame([(1, 0, ["run", "running", "runs", "dog"]), (2, 0, ["dogs"]), (3, 0, [])], "doc_id long, chunk_id int, tokens array<string>")
    postings, lengths = R.bm25_index(rows, stemmed=True)
    assert {(r.doc_id, r.term): r.tf for r in postings.collect()} == {(1, "run"): 3, (1, "dog"): 1, (2, "dog"): 1}
    assert {r.doc_id: r.n for r in lengths.collect()} == {1: 4, 2: 1, 3: 0}
    apart, _ = R.bm25_index(R.stem_tokens(rows, "doc_id", "chunk_id"))
    assert sorted(apart.select(*postings.columns).collect()) == sorted(postings.collect())


def test_stems_are_joined_on_distinct_terms_without_python(spark):
    rows = spark.range(100).select(F.lit("running").alias("term"), "id")
    plan = R.stem_terms(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and R.stem_terms(rows).filter("term = 'run'").count() == 100


def test_blocks_of_scores_equal_a_plain_loop(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(25)]
    docs = {(f"d{i % 40}", i // 40): rng.choices(words, k=rng.randint(0, 12)) for i in range(120)}
    asked = {q: rng.choices(words + ["none"], k=q % 5) for q in range(30)}
    monkeypatch.setattr(R, "CHUNK_BLOCK", 16)
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    rows = spark.createDataFrame([(*k, t) for k, t in docs.items()], "doc_id string, chunk_id int, tokens array<string>")
    got = R.bm25_topk(spark.createDataFrame(list(asked.items()), "query_id long, tokens array<string>"), *R.bm25_index(rows), k=3)
    count = {w: sum(w in t for t in docs.values()) for w in words}
    raw = {w: math.log((len(docs) - n + 0.5) / (n + 0.5)) for w, n in count.items() if n}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    want = []
    for q, tokens in asked.items():
        scores = {}
        for key, t in docs.items():
            if set(t) & set(tokens):
                scores[key] = round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in tokens if w in t), 9)
        best = sorted(scores, key=lambda key: (scores[key], key), reverse=True)[:3]
        want += [(q, n, *key, scores[key]) for n, key in enumerate(best, 1)]
    found = sorted(map(tuple, got.collect()))
    assert [r[:4] for r in found] == [r[:4] for r in want] and all(abs(a[4] - b[4]) < 2e-9 for a, b in zip(found, want))
    assert R.bm25_topk(spark.createDataFrame([], "query_id long, tokens array<string>"), *R.bm25_index(rows)).count() == 0
    assert R.bm25_topk(spark.createDataFrame([(1, ["w1"])], "query_id long, tokens array<string>"), *R.bm25_index(rows.limit(0))).count() == 0


def test_sql_stems_equal_the_published_ones():
    import duckdb

    from weftgraph.catalog.stemsql import stem_sql

    want = pairs(STEMS) | pairs(CASES) | {"": "", "é": "é", ",": ","}
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS term", [list(want)])
    assert dict(con.sql(f"WITH {stem_sql('words')} SELECT term, stem FROM stems").fetchall()) == want


def test_an_index_shuffles_chunks_and_no_terms(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "0 AS chunk_id", "array('a', 'b', 'a') AS tokens")
    for stemmed in (False, True):
        postings, _ = R.bm25_index(rows, stemmed)
        plan = postings._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert postings.filter("tf = 2 and n = 3").count() == 1000


def test_more_stems_than_are_sent_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, ["run", "running", "dog"]), (2, 0, ["dogs", "é"])], "doc_id long, chunk_id int, tokens array<string>")
    want = sorted(R.bm25_index(rows, stemmed=True)[0].collect())
    monkeypatch.setattr(R, "STEMS_SENT", 0)
    assert sorted(R.bm25_index(rows, stemmed=True)[0].collect()) == want and len(want) == 4


def test_tokens_with_line_breaks_nulls_and_nothing_are_counted(spark):
    rows = [(1, 0, ["a\nb", "a", "a"]), (2, 0, [""]), (3, 0, ["a", None]), (4, 0, []), (5, 0, None), (6, 0, ["a", "", ""])]
    postings, lengths = R.bm25_index(spark.createDataFrame(rows, "doc_id long, chunk_id int, tokens array<string>"))
    want = {(1, "a\nb"): 1, (1, "a"): 2, (2, ""): 1, (3, "a"): 1, (3, None): 1, (6, "a"): 1, (6, ""): 2}
    assert {(r.doc_id, r.term): r.tf for r in postings.collect()} == want and lengths.count() == 6
