"""Queries of graph maintenance."""

from pyspark.sql import functions as F

from ..operators import graphs as G
from .base import fixture, query, table

_IDS = "ids AS (SELECT DISTINCT map_id, origin AS id FROM fx_edges)"


def _cited_nodes(spark, sf):
    """Nodes that cite pages, other nodes, absent nodes or nothing valid."""
    d = table(spark, sf, "documents").selectExpr("doc_id % 7 AS map_id", "doc_id", "doc_id % 5 <> 0 AS has_metadata")
    source = "CASE WHEN doc_id % 41 = 3 THEN '0.0' WHEN doc_id % 43 = 4 THEN '1.2' WHEN doc_id % 3 = 0 AND doc_id >= 7 THEN cast(doc_id - 7 as string) WHEN doc_id % 97 = 1 THEN '999999999' ELSE (doc_id % 20) || '.1.1' END"
    fact = lambda s: f"named_struct('fact', 'f', 'source_ids', array({s}))"
    return d.selectExpr("map_id", "cast(doc_id as string) AS id", "has_metadata", f"array({fact(source)}, {fact(repr('500.1.1'))}) AS answer")


_CITED = """n AS (SELECT doc_id % 7 AS map_id, CAST(doc_id AS VARCHAR) AS id, doc_id % 5 <> 0 AS has_metadata,
CASE WHEN doc_id % 41 = 3 THEN '0.0' WHEN doc_id % 43 = 4 THEN '1.2' WHEN doc_id % 3 = 0 AND doc_id >= 7 THEN CAST(doc_id - 7 AS VARCHAR) WHEN doc_id % 97 = 1 THEN '999999999' ELSE (doc_id % 20) || '.1.1' END AS source FROM documents)"""


@query("WITH RECURSIVE " + _CITED + """, bad AS (SELECT map_id, id FROM n WHERE source = '0.0' OR (has_metadata AND source = '1.2') OR source = '999999999'
UNION SELECT n.map_id, n.id FROM n JOIN bad ON bad.map_id = n.map_id AND n.source = bad.id) SELECT map_id, id FROM bad""")
def g1_validate_graph(spark, sf):
    nodes = _cited_nodes(spark, sf)
    edges = nodes.select("map_id", F.col("id").alias("origin"), F.col("id").alias("target"))
    return G.validate_graph(nodes, edges)[2]


@query("""WITH n AS (SELECT doc_id % 7 AS map_id, CASE WHEN doc_id % 4 = 1 THEN 'u' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents), m AS (SELECT map_id, max(TRY_CAST(id AS BIGINT)) AS top FROM n GROUP BY map_id)
SELECT map_id, id AS original_id, TRY_CAST(id AS BIGINT) AS id FROM n WHERE TRY_CAST(id AS BIGINT) IS NOT NULL UNION ALL SELECT map_id, id, top + row_number() OVER (PARTITION BY map_id ORDER BY id) FROM n JOIN m USING (map_id) WHERE TRY_CAST(id AS BIGINT) IS NULL""")
def g2_assign_int_ids(spark, sf):
    return G.assign_int_ids(table(spark, sf, "documents").selectExpr("doc_id % 7 AS map_id", "CASE WHEN doc_id % 4 = 1 THEN 'u' || doc_id ELSE cast(doc_id as string) END AS id"))


@query("""WITH c AS (SELECT map_id, id, CASE WHEN id % 4 = 0 THEN NULL ELSE level END AS level, CASE WHEN id % 4 = 0 THEN NULL ELSE cluster_id END AS cluster_id FROM fx_concepts), t AS (SELECT map_id, max(cluster_id) AS top FROM c GROUP BY map_id)
SELECT map_id, id, coalesce(level, 1) AS level, CAST(CASE WHEN level IS NULL THEN top + 1 + floor((row_number() OVER (PARTITION BY map_id, level IS NULL ORDER BY id) - 1) / 5) ELSE cluster_id END AS INTEGER) AS cluster_id FROM c JOIN t USING (map_id)""", "fx_concepts")
def g3_manual_nodes(spark, sf):
    c = fixture(spark, sf, "fx_concepts").selectExpr("map_id", "id", "CASE WHEN id % 4 <> 0 THEN level END AS level", "CASE WHEN id % 4 <> 0 THEN cluster_id END AS cluster_id")
    return G.manual_nodes(c)


@query("WITH RECURSIVE " + _CITED + """, gone AS (SELECT map_id, id, source FROM n WHERE regexp_extract(source, '^([^.]*)[.]', 1) IN ('1', '2', '3') OR source = '999999999x'
UNION SELECT n.map_id, n.id, n.source FROM n JOIN gone ON gone.map_id = n.map_id AND n.source = gone.id)
SELECT map_id, id, 1 AS n_facts, 0 AS modified FROM n WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = n.id)""")
def g4_delete_documents(spark, sf):
    nodes = _cited_nodes(spark, sf).withColumn("answer", F.slice("answer", 1, 1))
    docs = nodes.select("map_id").distinct().withColumn("doc", F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("3"))))
    kept, _ = G.delete_documents(nodes, nodes.select("map_id", F.col("id").alias("origin"), F.col("id").alias("target")), docs)
    return kept.select("map_id", "id", F.size("answer").alias("n_facts"), "modified")


@query("""WITH d AS (SELECT map_id, id, count(*) AS degree FROM (SELECT map_id, origin AS id FROM fx_edges UNION ALL SELECT map_id, target FROM fx_edges) GROUP BY ALL)
SELECT map_id, id, degree, CAST(r AS INTEGER) AS rank FROM (SELECT c.map_id, c.id, degree, row_number() OVER (PARTITION BY c.map_id ORDER BY level DESC, degree DESC, c.id) AS r FROM fx_concepts c JOIN d USING (map_id, id)) WHERE r <= 5""", "fx_concepts fx_edges")
def g5_root_candidates(spark, sf):
    return G.root_candidates(fixture(spark, sf, "fx_concepts"), fixture(spark, sf, "fx_edges"))


@query("SELECT map_id, CASE WHEN origin % 4 = 1 THEN 'u' || origin ELSE CAST(origin AS VARCHAR) END AS origin, CASE WHEN target % 4 = 1 THEN 'u' || target ELSE CAST(target AS VARCHAR) END AS target FROM fx_edges", "fx_edges")
def g6_restore_ids(spark, sf):
    e = fixture(spark, sf, "fx_edges").select("map_id", "origin", "target")
    ids = e.select("map_id", F.col("origin").alias("id")).union(e.select("map_id", "target")).distinct().filter("id % 4 = 1").selectExpr("map_id", "'u' || id AS original_id", "id")
    return G.restore_ids(e, ids, ["origin", "target"])


@query("""WITH new AS (SELECT map_id, id + 250 - id % 5 AS id FROM fx_concepts WHERE id % 2 = 0), u AS (SELECT map_id, id FROM fx_concepts), nn AS (SELECT map_id, id - (id % 5) + map_id AS id FROM new),
t AS (SELECT map_id, max(id) AS top FROM (SELECT * FROM nn UNION ALL SELECT * FROM u) GROUP BY map_id), m AS (SELECT nn.*, EXISTS (SELECT 1 FROM u WHERE u.map_id = nn.map_id AND u.id = nn.id) AS clash FROM nn)
SELECT map_id, id, CASE WHEN clash THEN top + row_number() OVER (PARTITION BY map_id, clash ORDER BY id) ELSE id END AS new_id FROM m JOIN t USING (map_id)""", "fx_concepts")
def g7_reindex_clashes(spark, sf):
    c = fixture(spark, sf, "fx_concepts").select("map_id", "id")
    new = c.filter("id % 2 = 0").selectExpr("map_id", "id + 250 - id % 5 AS id").selectExpr("map_id", "id - (id % 5) + map_id AS id")
    return G.reindex_clashes(new, c)


@query("""WITH t AS (SELECT map_id, max(id) + 1 AS top FROM fx_concepts GROUP BY map_id) SELECT map_id, id, name, 0 AS new FROM fx_concepts UNION ALL SELECT c.map_id, id + top, name, 1 FROM fx_concepts c JOIN t USING (map_id) WHERE level = 2""", "fx_concepts")
def g8_merge_added(spark, sf):
    c = fixture(spark, sf, "fx_concepts").select("map_id", "id", "name", "level")
    return G.merge_added(c, c.filter("level = 2")).drop("level")


@query("""WITH RECURSIVE e AS (SELECT map_id, origin, target FROM fx_edges), v AS (SELECT e.* FROM e WHERE EXISTS (SELECT 1 FROM fx_concepts c WHERE c.map_id = e.map_id AND c.id = e.origin) AND EXISTS (SELECT 1 FROM fx_concepts c WHERE c.map_id = e.map_id AND c.id = e.target)),
b AS (SELECT map_id, origin AS x, target AS y FROM v UNION SELECT map_id, target, origin FROM v), reach AS (SELECT map_id, id AS x, id AS y FROM fx_concepts UNION SELECT r.map_id, r.x, b.y FROM reach r JOIN b ON b.map_id = r.map_id AND b.x = r.y),
comp AS (SELECT map_id, count(DISTINCT m) AS components FROM (SELECT map_id, x, min(y) AS m FROM reach GROUP BY ALL) GROUP BY map_id), dup AS (SELECT map_id, count(*) AS d FROM (SELECT map_id, name FROM fx_concepts GROUP BY ALL HAVING count(*) > 1) GROUP BY map_id),
n AS (SELECT map_id, count(*) AS n FROM fx_concepts GROUP BY map_id)
SELECT n.map_id, coalesce(d, 0) AS duplicate_labels, n.map_id <> 3 AS root_ok, coalesce((SELECT count(*) FROM e WHERE e.map_id = n.map_id), 0) - coalesce((SELECT count(*) FROM v WHERE v.map_id = n.map_id), 0) AS dangling, components,
coalesce((SELECT count(*) FROM v WHERE v.map_id = n.map_id), 0) > n - components AS cycle FROM n JOIN comp USING (map_id) LEFT JOIN dup USING (map_id)""", "fx_concepts fx_edges")
def g9_tree_check(spark, sf):
    c = fixture(spark, sf, "fx_concepts")
    e = fixture(spark, sf, "fx_edges").select("map_id", "origin", "target")
    return G.tree_check(c, e, c.groupBy("map_id").agg(F.min("id").alias("root")).withColumn("root", F.expr("CASE WHEN map_id = 3 THEN -5 ELSE root END")))


@query("""WITH f AS (SELECT map_id, name, min(id) AS id FROM fx_concepts GROUP BY ALL), e AS (SELECT map_id, 'n' || origin % 200 AS s, 'n' || target % 200 AS t FROM fx_edges),
o AS (SELECT DISTINCT e.map_id, least(a.id, b.id) AS x, greatest(a.id, b.id) AS y FROM e JOIN f a ON a.map_id = e.map_id AND a.name = s JOIN f b ON b.map_id = e.map_id AND b.name = t WHERE a.id <> b.id) SELECT map_id, x AS origin, y AS target FROM o UNION ALL SELECT map_id, y, x FROM o""", "fx_concepts fx_edges")
def g10_label_edges_to_ids(spark, sf):
    e = fixture(spark, sf, "fx_edges").selectExpr("map_id", "'n' || origin % 200 AS source_label", "'n' || target % 200 AS target_label")
    return G.label_edges_to_ids(e, fixture(spark, sf, "fx_concepts"))


@query()
def g11_subgraph(spark, sf):
    e = fixture(spark, sf, "fx_edges").selectExpr("map_id", "origin", "target", "CASE WHEN weight IS NULL THEN 'Manual' WHEN type = 'related' THEN 'Init' ELSE 'Generated' END AS type")
    starts = fixture(spark, sf, "fx_concepts").filter("id % 50 < 5").select("map_id", F.col("id").alias("start"))
    return G.subgraph(e, starts)[0]


@query("""WITH RECURSIVE b AS (SELECT map_id, origin AS a, target AS z FROM fx_links WHERE origin <> target UNION SELECT map_id, target, origin FROM fx_links WHERE origin <> target),
p AS (SELECT map_id, id AS start, id + 5 * (1 + id % 7) AS previous, id, [id] AS path FROM fx_concepts UNION ALL SELECT p.map_id, start, previous, z, list_append(path, z) FROM p JOIN b ON b.map_id = p.map_id AND b.a = p.id WHERE len(path) <= 4 AND p.id <> previous)
SELECT map_id, start, previous, path FROM p WHERE id = previous QUALIFY row_number() OVER (PARTITION BY map_id, start, previous ORDER BY len(path), path) = 1""", "fx_links fx_concepts")
def g11_path_to_previous(spark, sf):
    """Shortest ways of up to four steps between every concept and one a few places on."""
    pairs = fixture(spark, sf, "fx_concepts").selectExpr("map_id", "id AS start", "id + 5 * (1 + id % 7) AS previous")
    return G.path_to_previous(fixture(spark, sf, "fx_links"), pairs, 4)


@query("""WITH p AS (SELECT map_id, id + CASE WHEN id % 3 = 0 THEN 5000 ELSE 0 END AS id, 'p' || id AS name, NULL AS question FROM fx_concepts WHERE id % 2 = 0)
SELECT coalesce(c.map_id, p.map_id) AS map_id, coalesce(c.id, p.id) AS id, CASE WHEN p.id IS NOT NULL THEN p.name ELSE c.name END AS name, CASE WHEN p.id % 4 = 0 THEN NULL ELSE c.question END AS question
FROM fx_concepts c FULL OUTER JOIN p ON p.map_id = c.map_id AND p.id = c.id WHERE coalesce(c.id, p.id) % 10 <> 9""", "fx_concepts")
def g12_upsert(spark, sf):
    c = fixture(spark, sf, "fx_concepts").select("map_id", "id", "name", "question")
    p = c.filter("id % 2 = 0").selectExpr("map_id", "id + CASE WHEN id % 3 = 0 THEN 5000 ELSE 0 END AS id", "'p' || id AS name", "cast(null as string) AS question")
    p = p.withColumn("given", F.expr("CASE WHEN id % 4 = 0 THEN array('name', 'question') ELSE array('name') END"))
    return G.upsert(c, p, ["name", "question"], c.filter("id % 10 = 9"))


@query("SELECT map_id, origin, target, weight, type FROM fx_edges WHERE origin % 6 <> 1 AND target % 6 <> 1", "fx_edges")
def g13_delete_nodes(spark, sf):
    e = fixture(spark, sf, "fx_edges")
    n = e.select("map_id", F.col("origin").alias("id")).union(e.select("map_id", "target")).distinct()
    return G.delete_nodes(n, e, n.groupBy("map_id").agg(F.min("id").alias("root")), n.filter("id % 6 = 1"))[1].select("map_id", "origin", "target", "weight", "type")


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY map_id, origin, target) AS k, map_id, origin, target FROM (SELECT DISTINCT map_id, origin, target FROM fx_edges)),
w AS (SELECT map_id, origin * 1000 + target AS edge_id, origin, target + CASE WHEN origin % 7 = 0 THEN 0 ELSE 5 END AS target, CASE WHEN origin % 11 = 5 THEN 'Init' ELSE 'Manual' END AS type FROM n WHERE origin % 5 = 1),
c AS (SELECT DISTINCT map_id, id FROM fx_concepts)
SELECT w.*, CASE WHEN type <> 'Manual' THEN 'type' WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.map_id = w.map_id AND c.id = w.origin) OR NOT EXISTS (SELECT 1 FROM c WHERE c.map_id = w.map_id AND c.id = w.target) THEN 'end'
WHEN EXISTS (SELECT 1 FROM n WHERE n.map_id = w.map_id AND n.origin * 1000 + n.target = w.edge_id AND n.origin % 13 = 1) THEN 'id' WHEN EXISTS (SELECT 1 FROM n WHERE n.map_id = w.map_id AND n.origin = w.origin AND n.target = w.target AND n.origin % 13 = 1) THEN 'pair' END AS reason FROM w""", "fx_edges fx_concepts")
def g14_check_new_edges(spark, sf):
    n = fixture(spark, sf, "fx_edges").select("map_id", "origin", "target").distinct().withColumn("edge_id", F.expr("origin * 1000 + target"))
    new = n.filter("origin % 5 = 1").selectExpr("map_id", "edge_id", "origin", "target + CASE WHEN origin % 7 = 0 THEN 0 ELSE 5 END AS target", "CASE WHEN origin % 11 = 5 THEN 'Init' ELSE 'Manual' END AS type")
    return G.check_new_edges(new, fixture(spark, sf, "fx_concepts"), n.filter("origin % 13 = 1"))


@query("""SELECT map_id, id, CASE WHEN id % 10 = 1 THEN 'added' WHEN id % 10 = 2 THEN 'removed' ELSE 'changed' END AS change FROM fx_concepts WHERE id % 10 IN (1, 2, 3)""", "fx_concepts")
def g15_graph_diff(spark, sf):
    c = fixture(spark, sf, "fx_concepts").selectExpr("map_id", "id", "name", "question", "CASE WHEN id % 2 = 0 THEN 'd' END AS details")
    new = c.filter("id % 10 <> 2").withColumn("details", F.expr("CASE WHEN id % 10 = 3 THEN 'other' ELSE details END"))
    return G.graph_diff(c.filter("id % 10 <> 1"), new)


@query("""WITH a AS (SELECT id, version AS v, status, in_graph FROM fx_versions WHERE active), o AS (SELECT id, max(version) AS o FROM fx_versions WHERE in_graph AND NOT active GROUP BY id)
SELECT id, v AS version, 'delete' AS action FROM a WHERE status = 'REMOVED' AND in_graph UNION ALL SELECT id, v, 'add' FROM a WHERE status <> 'REMOVED' AND NOT in_graph
UNION ALL SELECT id, o, 'delete' FROM a JOIN o USING (id) WHERE status = 'REMOVED' OR NOT in_graph""", "fx_versions")
def g16_source_changes(spark, sf):
    return G.source_changes(fixture(spark, sf, "fx_versions"))


@query("""WITH f AS (SELECT DISTINCT id FROM fx_versions WHERE active AND status = 'FAILED'), l AS (SELECT * FROM fx_versions WHERE NOT (active AND status = 'FAILED')), t AS (SELECT id, max(version) AS top FROM l GROUP BY id),
d AS (SELECT l.id, version, CASE WHEN f.id IS NOT NULL THEN version = top ELSE active END AS active, in_graph, status FROM l JOIN t USING (id) LEFT JOIN f USING (id)),
n AS (SELECT id, version, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN false ELSE active END AS active, in_graph, status FROM d UNION ALL SELECT id, CAST(top + 1 AS INTEGER), true, false, 'IN_PROGRESS' FROM t WHERE CAST(id AS BIGINT) % 4 = 0)
SELECT id, version, active, active AS in_graph, status FROM n WHERE NOT (active AND status = 'REMOVED')""", "fx_versions")
def g17_source_versioning(spark, sf):
    v = G.drop_failed(fixture(spark, sf, "fx_versions"))
    return G.after_apply(G.add_version(v, v.filter("cast(id as bigint) % 4 = 0").select("id").distinct()))


@query("SELECT map_id, type, id, arg_max(new_value, step) AS value FROM fx_history WHERE step <= 300 GROUP BY ALL", "fx_history")
def g18_history_state(spark, sf):
    return G.history_state(fixture(spark, sf, "fx_history"), 300)


_STEPS = """s AS (SELECT map_id, step, CASE WHEN step % 11 = 4 THEN 'other' ELSE 'me' END AS user, step % 5 > 1 OR map_id = 7 AS skip FROM fx_history),
c AS (SELECT map_id, count(*) AS n, count(*) * (map_id + 1) // 11 AS cur FROM s GROUP BY map_id),
u AS (SELECT map_id, n, cur, cur AS l FROM c UNION ALL SELECT u.map_id, n, cur, l - 1 FROM u JOIN s ON s.map_id = u.map_id AND s.step = l WHERE s.user = 'me' AND skip),
r AS (SELECT map_id, n, cur, cur + 1 AS r FROM c UNION ALL SELECT r.map_id, n, cur, r + 1 FROM r JOIN s ON s.map_id = r.map_id AND s.step = r + 1 WHERE s.user = 'me' AND skip),
w AS (SELECT map_id, n, cur, cur + 1 AS w FROM c UNION ALL SELECT w.map_id, n, cur, w + 1 FROM w JOIN s ON s.map_id = w.map_id AND s.step = w WHERE s.user = 'me' AND skip AND w + 1 < n),
e AS (SELECT c.map_id, n, cur, (SELECT min(l) FROM u WHERE u.map_id = c.map_id) AS l, (SELECT max(r) FROM r WHERE r.map_id = c.map_id) AS r, (SELECT max(w) FROM w WHERE w.map_id = c.map_id) AS w FROM c),
g AS (SELECT e.*, h.user = 'me' AS me_h, x.user = 'me' AS me_at, y.user = 'me' AS me_r, z.user = 'me' AS me_w FROM e LEFT JOIN s h ON h.map_id = e.map_id AND h.step = l LEFT JOIN s x ON x.map_id = e.map_id AND x.step = cur
      LEFT JOIN s y ON y.map_id = e.map_id AND y.step = r LEFT JOIN s z ON z.map_id = e.map_id AND z.step = w),
t AS (SELECT map_id, CASE WHEN me_at AND l >= 0 THEN l END AS undo_first, CASE WHEN me_at AND l >= 0 THEN cur END AS undo_last, CASE WHEN me_r THEN cur + 1 END AS redo_first, CASE WHEN me_r THEN r END AS redo_last,
      cur < n AND l >= 0 AND coalesce(me_h, false) AS can_undo, cur + 1 < n AND coalesce(me_w, false) AS can_redo FROM g)"""


def _ranges(spark, sf):
    h = fixture(spark, sf, "fx_history")
    steps = h.selectExpr("map_id", "step", "CASE WHEN step % 11 = 4 THEN 'other' ELSE 'me' END AS user", "step % 5 > 1 OR map_id = 7 AS skip")
    current = h.groupBy("map_id").agg(F.expr("count(*) * (map_id + 1) div 11").alias("step"))
    return h, G.undo_redo_ranges(steps, current, "me")


@query("WITH RECURSIVE " + _STEPS + " SELECT * FROM t", "fx_history")
def g18_undo_redo_ranges(spark, sf):
    """Grouped steps by the step-by-step walk of the SQL; map 7 has skipped steps only."""
    return _ranges(spark, sf)[1]


@query("WITH RECURSIVE " + _STEPS + """ SELECT h.map_id, 'undo' AS action, type, id, arg_min('o' || new_value, step) AS value FROM fx_history h JOIN t ON t.map_id = h.map_id AND step BETWEEN undo_first AND undo_last GROUP BY ALL
UNION ALL SELECT h.map_id, 'redo', type, id, arg_max(new_value, step) FROM fx_history h JOIN t ON t.map_id = h.map_id AND step BETWEEN redo_first AND redo_last GROUP BY ALL""", "fx_history")
def g18_undo_redo_values(spark, sf):
    h, ranges = _ranges(spark, sf)
    return G.undo_redo_values(h.withColumn("old_value", F.concat(F.lit("o"), "new_value")), ranges)


@query("SELECT map_id, id, name, CASE WHEN id % 3 = 0 THEN ['a', 'b'] ELSE [question] END AS questions FROM fx_concepts", "fx_concepts")
def g19_normalise_questions(spark, sf):
    return G.normalise_questions(fixture(spark, sf, "fx_concepts").select("map_id", "id", "name", "question", F.expr("CASE WHEN id % 3 = 0 THEN array('a', 'b') END").alias("questions")))
