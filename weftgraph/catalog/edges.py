"""Queries of edge enhancement."""

from pyspark.sql import functions as F

from ..operators import concepts as X
from ..operators import edges as E
from ..operators import vectors as V
from ..plans.strong import strong_components
from .base import fixture, query

_VEC = "v AS (SELECT map_id, id, CAST(embedding AS DOUBLE[]) AS e FROM fx_concepts)"
_PAIRS = _VEC + ", p AS (SELECT a.map_id, a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.map_id = b.map_id AND a.id <> b.id)"
_K = "k AS (SELECT map_id, origin, target, max(weight) AS weight, coalesce(arg_max(type, (coalesce(weight, -1), type = 'related', type)), any_value(type)) AS type FROM fx_edges GROUP BY ALL)"


def _vectors(spark, sf):
    return fixture(spark, sf, "fx_concepts").select("map_id", "id", "embedding")


def _unique(spark, sf):
    return X.dedup_edges_keep_max(fixture(spark, sf, "fx_edges"))


def _roots(edges):
    return edges.groupBy("map_id").agg(F.min("origin").alias("root"))


def _rounded(df):
    return df.withColumn("weight", F.round("weight", 6))


@query("WITH " + _PAIRS + " SELECT map_id, id, other, round(s, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY map_id, id ORDER BY s DESC, other) AS r FROM p) WHERE r <= 5", "fx_concepts")
def e1_similarity(spark, sf):
    v = _vectors(spark, sf)
    return V.top_similar(v, v, 5).withColumn("score", F.round("score", 6))


@query("WITH " + _VEC + """, p AS (SELECT DISTINCT map_id, origin AS a, target AS b FROM fx_edges),
d AS (SELECT p.*, list_distance(x.e, y.e) ** 2 AS d FROM p JOIN v x ON x.map_id = p.map_id AND x.id = p.a JOIN v y ON y.map_id = p.map_id AND y.id = p.b)
SELECT map_id, a, b, round(1 - d / nullif(max(d) OVER (PARTITION BY map_id), 0), 6) AS score FROM d""", "fx_concepts fx_edges")
def e1_pair_scores(spark, sf):
    v = _vectors(spark, sf)
    pairs = fixture(spark, sf, "fx_edges").select("map_id", F.col("origin").alias("a"), F.col("target").alias("b")).distinct()
    return V.squared_similarity(pairs, v).withColumn("score", F.round("score", 6))


@query("WITH " + _K + """, r AS (SELECT map_id, min(origin) AS root FROM k GROUP BY map_id), e AS (SELECT k.* FROM k JOIN r USING (map_id) WHERE NOT (origin = root AND map_id % 2 = 1 AND target % 100 > 1)),
deg AS (SELECT map_id, origin AS id, count(*) AS degree FROM e GROUP BY ALL), own AS (SELECT e.*, root, row_number() OVER (PARTITION BY e.map_id ORDER BY coalesce(weight > 3.5, false) DESC, coalesce(degree, 0) DESC, target DESC) AS i, count(*) OVER (PARTITION BY e.map_id) AS have
FROM e JOIN r ON r.map_id = e.map_id AND e.origin = root LEFT JOIN deg d ON d.map_id = e.map_id AND d.id = e.target),
more AS (SELECT t.map_id, root, t.target, row_number() OVER (PARTITION BY t.map_id ORDER BY coalesce(degree, 0) DESC, t.target) AS i, coalesce(h.have, 0) AS have FROM (SELECT DISTINCT map_id, target FROM e) t JOIN r USING (map_id)
LEFT JOIN deg d ON d.map_id = t.map_id AND d.id = t.target LEFT JOIN (SELECT map_id, count(*) AS have FROM own GROUP BY map_id) h ON h.map_id = t.map_id WHERE t.target <> root AND NOT EXISTS (SELECT 1 FROM own o WHERE o.map_id = t.map_id AND o.target = t.target))
SELECT e.map_id, e.origin, e.target, e.weight, e.type FROM e JOIN r USING (map_id) WHERE origin <> root UNION ALL SELECT map_id, origin, target, CASE WHEN i <= 4 THEN 5.0 ELSE 0.1 END, CASE WHEN i <= 4 THEN 'related' ELSE type END FROM own
UNION ALL SELECT map_id, root, target, 5.0, 'related' FROM more WHERE i <= 4 - have""", "fx_edges")
def e2_adjust_root_edges(spark, sf):
    k = _unique(spark, sf)
    r = _roots(k)
    e = k.join(r, "map_id").filter("not (origin = root and map_id % 2 = 1 and target % 100 > 1)").drop("root")
    return E.adjust_root_edges(e, r)


@query("WITH " + _PAIRS + """, e AS (SELECT DISTINCT map_id, origin, target FROM fx_links), nb AS (SELECT map_id, origin AS id, target AS other FROM e UNION SELECT map_id, target, origin FROM e),
o AS (SELECT map_id, origin AS id, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT map_id, target AS id, count(*) AS n FROM e GROUP BY ALL),
need AS (SELECT v.map_id, v.id, greatest(3 - coalesce(o.n, 0), 0) AS no, greatest(1 - coalesce(i.n, 0), 0) AS ni FROM v LEFT JOIN o ON o.map_id = v.map_id AND o.id = v.id LEFT JOIN i ON i.map_id = v.map_id AND i.id = v.id),
k AS (SELECT p.*, no, ni, row_number() OVER (PARTITION BY p.map_id, p.id ORDER BY s DESC, p.other) AS r FROM p JOIN need USING (map_id, id) WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.map_id = p.map_id AND nb.id = p.id AND nb.other = p.other)),
m AS (SELECT *, count(*) OVER (PARTITION BY map_id, id) AS n FROM k WHERE r <= no + ni)
SELECT map_id, id AS origin, other AS target, round(s, 6) AS weight, 'related' AS type FROM m WHERE r <= no UNION ALL SELECT map_id, other, id, round(s, 6), 'related' FROM m WHERE r > n - ni""", "fx_concepts fx_links")
def e3_min_degree_edges(spark, sf):
    e = fixture(spark, sf, "fx_links").distinct()
    return _rounded(E.min_degree_edges(_vectors(spark, sf), e))


@query("WITH r AS (SELECT map_id, min(origin) AS root FROM fx_edges GROUP BY map_id) SELECT e.map_id, origin, target, CASE WHEN origin = root AND coalesce(weight <> 5, true) THEN 0.1 ELSE weight END AS weight, type FROM fx_edges e JOIN r USING (map_id)", "fx_edges")
def e4_demote_other_root_edges(spark, sf):
    e = fixture(spark, sf, "fx_edges")
    return E.demote_other_root_edges(e, _roots(e)).select("map_id", "origin", "target", "weight", "type")


def _distinct(spark, sf):
    return fixture(spark, sf, "fx_edges").select("map_id", "origin", "target").distinct()


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.map_id, origin, target FROM fx_edges a WHERE EXISTS (SELECT 1 FROM fx_concepts c WHERE c.map_id = a.map_id AND c.id = origin) AND EXISTS (SELECT 1 FROM fx_concepts c WHERE c.map_id = a.map_id AND c.id = target)),
reach AS (SELECT map_id, id AS a, id AS b FROM fx_concepts UNION SELECT r.map_id, r.a, e.target FROM reach r JOIN e ON e.map_id = r.map_id AND e.origin = r.b)
SELECT x.map_id, x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON y.map_id = x.map_id AND y.a = x.b AND y.b = x.a GROUP BY ALL""", "fx_concepts fx_edges")
def e5_strong_components(spark, sf):
    return strong_components(_distinct(spark, sf), fixture(spark, sf, "fx_concepts"))


@query()
def e6_bridge_components(spark, sf):
    e = fixture(spark, sf, "fx_links")
    return _rounded(E.bridge_components(_vectors(spark, sf), strong_components(e, fixture(spark, sf, "fx_concepts")), e))


@query("WITH " + _K + " SELECT k.* FROM k WHERE origin <> target AND EXISTS (SELECT 1 FROM fx_concepts c WHERE c.map_id = k.map_id AND c.id = origin) AND EXISTS (SELECT 1 FROM fx_concepts c WHERE c.map_id = k.map_id AND c.id = target)", "fx_edges fx_concepts")
def e7_clean_edges(spark, sf):
    return E.clean_edges(fixture(spark, sf, "fx_edges"), fixture(spark, sf, "fx_concepts"))


@query()
def e8_mark_redundant_edges(spark, sf):
    e = E.clean_edges(fixture(spark, sf, "fx_edges"), fixture(spark, sf, "fx_concepts")).filter("weight is not null")
    return E.mark_redundant_edges(e)


@query("SELECT map_id, origin, target, weight, type FROM fx_edges ORDER BY map_id, type <> 'related', weight DESC, origin, target", "fx_edges")
def e9_sort_edges(spark, sf):
    return E.sort_edges(fixture(spark, sf, "fx_edges"))


@query("""WITH r AS (SELECT map_id, min(origin) AS root FROM fx_edges GROUP BY map_id), f AS (SELECT * FROM fx_edges WHERE map_id <> 2 OR weight IS NOT NULL), s AS (SELECT map_id, bool_or(weight IS NULL) AS gap FROM f GROUP BY map_id)
SELECT f.map_id, origin, target, type, CASE WHEN gap AND type = 'related' AND (origin = root OR target = root) THEN 5.0 ELSE coalesce(weight, CASE type WHEN 'artificial' THEN 0.5 WHEN 'related' THEN 3.0 ELSE 0.0 END) END AS weight FROM f JOIN r USING (map_id) JOIN s USING (map_id)""", "fx_edges")
def e10_default_weights(spark, sf):
    e = fixture(spark, sf, "fx_edges")
    return E.default_weights(e.filter("map_id <> 2 or weight is not null"), _roots(e))


@query("WITH " + _PAIRS + """, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_id, id ORDER BY s DESC, other) AS r FROM p) WHERE r <= 3),
kept AS (SELECT DISTINCT map_id, origin, target, 'Manual' AS type FROM fx_edges WHERE type = 'related'), have AS (SELECT map_id, origin AS id, count(DISTINCT target) AS n FROM kept GROUP BY ALL),
now AS (SELECT * FROM kept UNION ALL SELECT near.map_id, near.id, other, 'Generated' FROM near LEFT JOIN have h ON h.map_id = near.map_id AND h.id = near.id WHERE coalesce(h.n, 0) < 3 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.map_id = near.map_id AND k.origin = near.id AND k.target = other))
SELECT * FROM now UNION ALL SELECT map_id, other, id, 'Generated' FROM near WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM now WHERE now.map_id = near.map_id AND now.target = near.id)""", "fx_concepts fx_edges")
def e11_auto_edges(spark, sf):
    e = fixture(spark, sf, "fx_edges").select("map_id", "origin", "target", F.expr("CASE WHEN type = 'related' THEN 'Manual' ELSE 'Generated' END").alias("type")).distinct()
    return E.auto_edges(_vectors(spark, sf), e)


@query("WITH " + _PAIRS + """, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_id, id ORDER BY s DESC, other) AS r FROM p) WHERE r <= 3),
x AS (SELECT map_id, CASE WHEN r = 3 THEN other ELSE id END AS origin, CASE WHEN r = 3 THEN id ELSE other END AS target FROM n) SELECT *, 'E' || origin || '_' || target AS id FROM x""", "fx_concepts")
def e12_patch_edges(spark, sf):
    v = _vectors(spark, sf)
    return E.patch_edges(v, v)
