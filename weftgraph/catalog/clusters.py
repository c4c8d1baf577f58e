"""Queries of clustering and hierarchy."""

from pyspark.sql import functions as F

from ..operators import clustering as K
from ..operators import concepts as X
from .base import fixture, query

_C = "fx_concepts"


def _concepts(spark, sf):
    return fixture(spark, sf, _C)


def _plan(concepts, size=12):
    return concepts.groupBy("map_id").agg(F.ceil(F.count("*") / size).alias("clusters")).withColumn("size", F.lit(size))


@query("SELECT map_id, CAST(least(CASE WHEN max(n) <= 10 THEN 5 ELSE max(n) END, 12) AS INTEGER) AS size FROM (SELECT map_id, id % (3 + map_id * 5) AS g, count(*) AS n FROM fx_concepts GROUP BY ALL) GROUP BY map_id", _C)
def k1_max_cluster_size(spark, sf):
    c = _concepts(spark, sf)
    return K.max_cluster_size(c.groupBy("map_id", F.expr("id % (3 + map_id * 5)").alias("g")).agg(F.collect_list("id").alias("ids")))


@query("""WITH n AS (SELECT user_id AS map_id, CAST(1 AS INTEGER) AS level, count(*) * 7 AS n, CAST(5 + user_id % 8 AS INTEGER) AS size FROM events GROUP BY user_id),
m AS (SELECT *, CAST(greatest(ceil(round(ln(n / CAST(size AS DOUBLE) / 4) / ln(3), 9)), 0) AS INTEGER) AS mult FROM n) SELECT *, CAST(4 * pow(3, mult) AS BIGINT) AS budget, n < 4 OR mult = 0 OR 4 * pow(3, mult) <= size AS last FROM m""")
def k2_level_plan(spark, sf):
    from .base import table

    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("map_id")).agg((F.count("*") * 7).alias("n"))
    return K.level_plan(e.select("map_id", F.lit(1).alias("level"), "n", F.expr("cast(5 + map_id % 8 as int)").alias("size")))


@query()
def k3_cluster_embeddings(spark, sf):
    c = _concepts(spark, sf)
    return K.cluster_embeddings(c, _plan(c), "ward")


@query()
def k4_split_oversized_clusters(spark, sf):
    c = _concepts(spark, sf)
    return K.cluster_embeddings(c, _plan(c, 10).withColumn("clusters", F.lit(3)), "kmeans", split=True)


@query("""WITH RECURSIVE s AS (SELECT map_id, id % 23 * 3 % 17 AS cluster, count(*) AS n FROM fx_concepts WHERE id % 23 * 3 % 17 < id % 19 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY n, cluster) AS i FROM s),
g AS (SELECT map_id, cluster, i, n AS run, 1 AS pack FROM o WHERE i = 1 UNION ALL SELECT o.map_id, o.cluster, o.i, CASE WHEN run + o.n <= 12 THEN run + o.n ELSE o.n END, CASE WHEN run + o.n <= 12 THEN pack ELSE pack + 1 END FROM g JOIN o ON o.map_id = g.map_id AND o.i = g.i + 1)
SELECT c.map_id, c.id, g.cluster, pack FROM fx_concepts c JOIN g ON g.map_id = c.map_id AND g.cluster = c.id % 23 * 3 % 17 WHERE id % 23 * 3 % 17 < id % 19""", _C)
def k5_pack_small_clusters(spark, sf):
    return K.pack_small_clusters(_concepts(spark, sf).selectExpr("map_id", "id", "id % 23 * 3 % 17 AS cluster").filter("cluster < id % 19"))


@query()
def k5_packed_within_budget(spark, sf):
    """Packs of every map within its number of clusters, maps that exceed it with the next multiplier."""
    c = _concepts(spark, sf)
    return K.packed_within_budget(c, c.select("map_id").distinct().selectExpr("map_id", "cast(5 + map_id as int) AS size", "0 AS mult"))


@query("""SELECT map_id, cluster_id, '[' || string_agg('{"name":"' || name || '","question":"' || question || '"}', ',' ORDER BY id) || ']' AS payload FROM fx_concepts GROUP BY ALL""", _C)
def k6_cluster_payload(spark, sf):
    return K.cluster_payload(_concepts(spark, sf))


_SYNTH = """a AS (SELECT map_id, cluster_id, name, min(id) AS sid FROM fx_concepts WHERE is_active = 1 GROUP BY ALL), s AS (SELECT map_id, cluster_id, 'S' || (sid % 3) AS name, list(name) AS sources, bool_or(sid % 3 = 0) AS is_root FROM a GROUP BY ALL)"""


def _synth(spark, sf):
    a = _concepts(spark, sf).filter("is_active = 1").groupBy("map_id", "cluster_id", "name").agg(F.min("id").alias("sid"))
    s = a.groupBy("map_id", "cluster_id", F.expr("'S' || (sid % 3)").alias("n")).agg(F.array_append(F.collect_list("name"), "unknown").alias("sources"), F.bool_or(F.expr("sid % 3 = 0")).alias("is_root"))
    return s.select("map_id", "cluster_id", F.col("n").alias("name"), F.lit("Why?").alias("question"), "is_root", "sources")


def _applied(spark, sf):
    c = _concepts(spark, sf).drop("embedding").withColumn("part_ids", F.array(F.expr("id % 40"), F.lit(7).cast("long")))
    return K.apply_synthesis(c, _synth(spark, sf), 1)


@query(f"""WITH {_SYNTH}, t AS (SELECT map_id, max(id) AS top FROM fx_concepts GROUP BY map_id), m AS (SELECT a.map_id, a.cluster_id, 'S' || (sid % 3) AS name, sid % 3 = 0 AS is_root, list_sort(list(sid)) AS source_ids, list_sort(list_distinct(flatten(list([sid % 40, 7])))) AS part_ids FROM a GROUP BY ALL),
n AS (SELECT m.*, top + row_number() OVER (PARTITION BY m.map_id ORDER BY cluster_id, is_root, name) AS id FROM m JOIN t USING (map_id)), u AS (SELECT map_id, unnest(source_ids) AS id FROM n)
SELECT c.map_id, c.id, name, level, CASE WHEN u.id IS NOT NULL THEN 0 ELSE is_active END AS is_active, [c.id % 40, 7] AS part_ids, NULL AS source_ids FROM fx_concepts c LEFT JOIN u ON u.map_id = c.map_id AND u.id = c.id
UNION ALL SELECT map_id, id, name, CASE WHEN is_root THEN 2 ELSE 1 END, 1, part_ids, source_ids FROM n""", _C)
def k7_apply_synthesis(spark, sf):
    return _applied(spark, sf).select("map_id", "id", "name", "level", "is_active", "part_ids", "source_ids")


@query("""WITH n AS (SELECT map_id, cluster_id, regexp_replace(name, '_.*', '') AS n, min(id) AS id FROM fx_concepts WHERE is_active = 1 GROUP BY ALL), r AS (SELECT map_id, cluster_id, 'n' || (id % 180) AS s, 'n' || ((id + 7) % 180) AS t FROM fx_concepts)
SELECT r.map_id, a.id AS origin, b.id AS target, CAST(2.0 AS DOUBLE) AS weight, 'related' AS type FROM r JOIN n a ON a.map_id = r.map_id AND a.cluster_id = r.cluster_id AND a.n = s JOIN n b ON b.map_id = r.map_id AND b.cluster_id = r.cluster_id AND b.n = t""", _C)
def k8_synthesis_relations(spark, sf):
    c = _concepts(spark, sf)
    return K.synthesis_relations(c.selectExpr("map_id", "cluster_id", "'n' || (id % 180) || '_x' AS source_name", "'n' || ((id + 7) % 180) AS target_name"), c)


@query(f"WITH {_SYNTH}, t AS (SELECT map_id, max(id) AS top FROM fx_concepts GROUP BY map_id), m AS (SELECT DISTINCT map_id, cluster_id, 'S' || (sid % 3) AS name, sid % 3 = 0 AS is_root FROM a), n AS (SELECT m.*, top + row_number() OVER (PARTITION BY m.map_id ORDER BY cluster_id, is_root, name) AS id FROM m JOIN t USING (map_id)) SELECT a.map_id, sid AS old_id, n.id AS new_id FROM a JOIN n ON n.map_id = a.map_id AND n.cluster_id = a.cluster_id AND n.name = 'S' || (sid % 3)", _C)
def k9_concept_id_changes(spark, sf):
    return X.id_changes(_applied(spark, sf).filter("source_ids is not null"))


_CH = "ch AS (SELECT map_id, id AS old_id, id + 1000 AS new_id FROM fx_concepts WHERE id % 4 = 0 UNION ALL SELECT map_id, id, 1000 FROM fx_concepts WHERE id % 8 = 0)"


@query(f"""WITH {_CH} SELECT e.map_id, coalesce(a.new_id, origin) AS origin, coalesce(b.new_id, target) AS target, round(CASE WHEN a.new_id IS NOT NULL OR b.new_id IS NOT NULL THEN weight * 0.99::DOUBLE ELSE weight END, 6) AS weight, type
FROM fx_edges e LEFT JOIN ch a ON a.map_id = e.map_id AND a.old_id = origin LEFT JOIN ch b ON b.map_id = e.map_id AND b.old_id = target WHERE coalesce(a.new_id, origin) <> coalesce(b.new_id, target)""", "fx_concepts fx_edges")
def k10_propagate_relations(spark, sf):
    c = _concepts(spark, sf)
    ch = c.filter("id % 4 = 0").selectExpr("map_id", "id AS old_id", "id + 1000 AS new_id").union(c.filter("id % 8 = 0").selectExpr("map_id", "id", "cast(1000 as bigint)"))
    return X.propagate_relations(fixture(spark, sf, "fx_edges"), ch).select("map_id", "origin", "target", F.round("weight", 6).alias("weight"), "type")


@query("SELECT map_id, origin, target, weight, type FROM (SELECT *, row_number() OVER (PARTITION BY map_id, origin, target ORDER BY weight DESC NULLS LAST, type = 'related' DESC) AS i FROM fx_edges) WHERE i = 1", "fx_edges")
def k11_dedup_edges_keep_max(spark, sf):
    return X.dedup_edges_keep_max(fixture(spark, sf, "fx_edges"))


@query("SELECT map_id, id, CASE level WHEN 1 THEN 'stay' ELSE 'promoted' END AS part FROM fx_concepts WHERE is_active = 1 AND level IN (1, 2)", _C)
def k12_split_levels(spark, sf):
    stay, up = K.split_levels(_concepts(spark, sf), 1)
    return stay.select("map_id", "id", F.lit("stay").alias("part")).union(up.select("map_id", "id", F.lit("promoted")))


@query()
def k13_rebuild_levels(spark, sf):
    c = _concepts(spark, sf).filter("level > 0").withColumn("part_ids", F.array(F.expr("id % 40")))
    new = c.filter("id % 10 = 1").withColumns({"id": F.col("id") + 100_000, "level": F.lit(1)})

    def synthesise(rows, level):
        one = rows.groupBy("map_id", "cluster_id").agg(F.collect_set("name").alias("sources"), F.min("question").alias("question"))
        return one.select("map_id", "cluster_id", F.concat(F.lit(f"L{level}c"), "cluster_id").alias("name"), "question", F.lit(True).alias("is_root"), "sources")

    return K.rebuild_levels(c, new, _plan, synthesise).select("map_id", "id", "name", "level", "is_active")


@query("""WITH t AS (SELECT map_id, max(level) AS top FROM fx_concepts WHERE is_active = 1 GROUP BY map_id), r AS (SELECT map_id, min(id) AS root FROM fx_concepts GROUP BY map_id),
s AS (SELECT c.map_id, root, id, row_number() OVER (PARTITION BY c.map_id ORDER BY id) AS i FROM fx_concepts c JOIN t USING (map_id) JOIN r USING (map_id) WHERE is_active = 1 AND level = top AND id <> root),
e AS (SELECT map_id, origin, target, weight FROM fx_edges UNION ALL SELECT map_id, root, id, 4.0 FROM s WHERE i <= 4) SELECT map_id, origin, target, max(weight) AS weight, 'related' AS type FROM e GROUP BY ALL""", "fx_concepts fx_edges")
def k14_define_root(spark, sf):
    c = _concepts(spark, sf)
    return K.define_root(c, fixture(spark, sf, "fx_edges"), c.groupBy("map_id").agg(F.min("id").alias("root")))[1]
