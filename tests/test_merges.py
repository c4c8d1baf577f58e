"""Merging to a fixed point against a plain loop, and redundant edges against a search for every edge."""

import os
import random

import pandas as pd
import pytest

from weftgraph.catalog import QUERIES
from weftgraph.catalog.base import fixture
from weftgraph.catalog.concepts import merge_answers
from weftgraph.operators import concepts as X
from weftgraph.operators import edges as E

SF = "/root/testdata/sf0.001"


def plain(concepts, relations, roots, answers, links, rounds=10):
    """One map after another in Python: {map: ({id: (name, question, level, cluster, sources, active, facts)}, {pair: (weight, type)}, root)}."""
    out = {}
    for m, root in roots.items():
        now = {i: [n.split("_")[0], q, lvl, c, [], a, f] for mm, i, n, q, lvl, c, a, f in concepts if mm == m}
        rel = [(a, b, w, t) for mm, a, b, w, t in relations if mm == m]
        done = 0
        for _ in range(rounds):
            groups = {}
            for i in sorted(now):
                if now[i][5]:
                    groups.setdefault(now[i][0], []).append(i)
            groups = {n: ids for n, ids in groups.items() if len(ids) > 1}
            if not groups:
                break
            done += 1
            top, after, names, fresh, news = max(now), {}, {}, [], root
            for base, ids in groups.items():
                given = sorted((pos, name, q, r) for (mm, b, pos, name, q, r) in answers if (mm, b) == (m, base)) or [(0, base, None, True)]
                rest = [i for i in ids if i != root]
                worst = lambda k: -1 if not rest or any(now[i][k] == -1 for i in rest) else max(now[i][k] for i in rest)  # noqa: B023, E731
                facts = list(dict.fromkeys(f for i in ids for f in now[i][6]))
                fresh += [(base, pos, name, q or now[ids[0]][1], worst(2), worst(3), ids, bool(r and root in ids), facts) for pos, name, q, r in given]
            for k, (base, pos, name, q, lvl, c, ids, r, facts) in enumerate(sorted(fresh, key=lambda x: x[:3])):
                new = top + 1 + k
                now[new] = [name, q, -1 if r else lvl, -1 if r else c, ids, 1, facts]
                names[name] = new
                news = new if r else news
                for i in ids:
                    after.setdefault(i, []).append(new)
            for i in after:
                now[i][5] = 0
            moved = [(a2, b2, w * 0.99 if (a in after or b in after) else w, t) for a, b, w, t in rel for a2 in after.get(a, [a]) for b2 in after.get(b, [b])]
            moved += [(names[o], names[t], 3.0, "related") for mm, base, o, t in links if mm == m and base in groups and o in names and t in names]
            best = {}
            for a, b, w, t in moved:
                if a != b:
                    best[a, b] = max(best.get((a, b), (-1.0, False, "")), (w, t == "related", t))
            rel, root = [(a, b, w, t) for (a, b), (w, _, t) in best.items()], news
        on = {i for i in now if now[i][5]}
        out[m] = (now, {(a, b): (round(w, 6), t) for a, b, w, t in rel if a != b and not ({a, b} & (set(now) - on))}, root, done)
    return out


def test_three_rounds_and_new_relations(spark):
    rng = random.Random(1)
    concepts = [(m, i, f"a{i % 6}" + ("_2" if i % 4 == 0 else ""), f"q{i}", 1 + i % 3, i % 4, int(i % 9 != 5), [f"f{i % 5}", f"g{i}"]) for m in (1, 2) for i in range(20)] + [(3, 1, "x", "q", 1, 1, 1, ["f"])]
    relations = [(m, rng.randrange(20), rng.randrange(20), rng.choice([0.5, 2.0, 4.0]), rng.choice(["related", "artificial"])) for m in (1, 2) for _ in range(50)]
    roots = {1: 3, 2: 0, 3: 1}
    answers = [(1, f"a{k}", 0, f"b{k % 2}", None, True) for k in range(6)] + [(1, "a1", 1, "c", "why?", False), (1, "b0", 0, "z", "all?", True), (1, "b1", 0, "z", None, False), (2, "a2", 0, "a3", None, False)]
    links = [(1, "a1", "b0", "c"), (1, "a2", "c", "nowhere"), (1, "b0", "z", "z"), (2, "a2", "a3", "a1")]
    want = plain(concepts, relations, roots, answers, links)
    assert max(w[3] for w in want.values()) >= 3
    frame = spark.createDataFrame
    done, edges, found = X.merge_to_fixed_point(
        frame(concepts, "map_id long, id long, name string, question string, level int, cluster_id int, is_active int, answer array<string>"),
        frame(relations, "map_id long, origin long, target long, weight double, type string"),
        frame(list(roots.items()), "map_id long, root long"),
        frame(answers, "map_id long, base string, pos int, name string, question string, is_root boolean"),
        frame(links, "map_id long, base string, origin_name string, target_name string"),
    )
    assert {(r.map_id, r.id): [r.name, r.question, r.level, r.cluster_id, r.source_ids or [], r.is_active, r.answer] for r in done.collect()} == {(m, i): v for m in want for i, v in want[m][0].items()}
    assert {(r.map_id, r.origin, r.target): (round(r.weight, 6), r.type) for r in edges.collect()} == {(m, *k): v for m in want for k, v in want[m][1].items()}
    assert {r.map_id: r.root for r in found.collect()} == {m: want[m][2] for m in want}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_query_against_the_plain_loop(spark):
    c = [(r.map_id, r.id, r.name, r.question, r.level, r.cluster_id, r.is_active, []) for r in fixture(spark, SF, "fx_concepts").collect()]
    roots = {}
    for r in c:
        roots[r[0]] = min(roots.get(r[0], r[1]), r[1])
    answers = [(r.map_id, r.base, r.pos, r.name, r.question, r.is_root) for r in merge_answers(spark, SF).collect()]
    rel = [(r.map_id, r.origin, r.target, r.weight if r.weight is not None else -9.0, r.type) for r in fixture(spark, SF, "fx_edges").collect()]
    want = plain(c, rel, roots, answers, [(m, "m3", "rest", "all") for m in roots])
    assert min(w[3] for w in want.values()) >= 3
    got = {(r.map_id, r.id): (r.name, r.level, r.cluster_id, r.is_root) for r in QUERIES["d3_merge_to_fixed_point"](spark, SF).collect()}
    assert got == {(m, i): (v[0], v[2], v[3], i == w[2]) for m, w in want.items() for i, v in w[0].items() if v[5]}


def test_redundant_edges_as_by_a_search_for_every_edge():
    rng = random.Random(7)

    def strong(edges, nodes):
        for k in (0, 1):
            seen, todo = set(), [min(nodes)]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [e[1 - k] for e in edges if e[k] == x]
            if seen != nodes:
                return False
        return True

    for _ in range(150):
        n = rng.randint(2, 9)
        ring = rng.sample(range(n), n)
        ends = {(ring[i], ring[(i + 1) % n]) for i in range(n)} if rng.random() < 0.8 else set()
        ends |= {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 30))) if a != b} or {(0, 1)}
        rows = pd.DataFrame([(*e, rng.choice([0.5, 1, 2, 2.9, 3, 5, 6]), rng.choice(["related", "artificial"])) for e in sorted(ends)], columns=["origin", "target", "weight", "type"])
        left, nodes = set(ends), {x for e in ends for x in e}
        kinds = ["artificial" if w < (2.882 if len(nodes) > 100 else 2.971) else t for w, t in zip(rows["weight"], rows["type"])]
        for w, i in sorted((w, i) for i, w in enumerate(rows["weight"]) if w < 5):
            e = (rows["origin"][i], rows["target"][i])
            left.discard(e)
            if not strong(left, nodes):
                left.add(e)
                kinds[i] = "related"
        assert E.mark_redundant(rows)["type"].tolist() == kinds
