"""Queries of extraction, duplicates and succession."""

from pyspark.sql import functions as F

from ..functions import cited
from ..functions.text import is_trivial_text
from ..operators import concepts as X
from .base import fixture, query, table

_EXTRACT = """SELECT doc_id AS flat_chunk_id, pos, 'c' || (doc_id % 50) || '_' || pos AS name, 'q' || pos AS question, list_sort(list_distinct([doc_id % 3 + 1, pos + 1])) AS page_ids
FROM documents CROSS JOIN (VALUES (0), (1), (2)) t(pos)"""


def _extractions(spark, sf):
    fact = lambda k: f"named_struct('fact', 'f', 'source_ids', array({k}))"
    concept = lambda p: f"named_struct('name', 'c' || (doc_id % 50) || '_{p}', 'question', 'q{p}', 'answer', array({fact('doc_id % 3 + 1')}, {fact(f'cast({p + 1} as bigint)')}))"
    names = "array(named_struct('source_name', 'c' || (doc_id % 50) || '_0', 'target_name', 'c' || (doc_id % 50) || '_1'), named_struct('source_name', 'c' || (doc_id % 50) || '_2', 'target_name', 'missing'))"
    return table(spark, sf, "documents").selectExpr("doc_id AS flat_chunk_id", f"array({', '.join(concept(p) for p in range(3))}) AS concepts", f"{names} AS relations")


@query(_EXTRACT.replace("pos, 'c'", "CAST(pos AS INTEGER) AS pos, 'c'"))
def x1_explode_extractions(spark, sf):
    return X.explode_concepts(_extractions(spark, sf)).drop("answer")


@query(f"""WITH c AS ({_EXTRACT}), k AS (SELECT *, CASE WHEN flat_chunk_id % 2 = 0 THEN 'PPTX' ELSE 'PDF' END AS doc_cat FROM c),
p AS (SELECT doc_id AS flat_chunk_id, page, doc_id * 4 + page AS part FROM documents, (VALUES (1), (2), (3)) t(page))
SELECT name, question, k.flat_chunk_id, doc_cat, list_sort(list_distinct(list(part))) AS part_ids FROM k JOIN p ON p.flat_chunk_id = k.flat_chunk_id AND list_contains(page_ids, page)
WHERE doc_cat = 'PPTX' OR len(page_ids) = 1 GROUP BY ALL""")
def x2_attach_parts(spark, sf):
    c = X.explode_concepts(_extractions(spark, sf)).withColumn("doc_cat", F.expr("CASE WHEN flat_chunk_id % 2 = 0 THEN 'PPTX' ELSE 'PDF' END"))
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("flat_chunk_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>")).alias("page"))
    return X.attach_parts(c, p.select("flat_chunk_id", F.array("page").alias("page_ids"), (F.col("flat_chunk_id") * 4 + F.col("page")).alias("flat_part_id"))).drop("answer")


@query("SELECT map_id, id, CASE WHEN count(*) OVER n > 1 THEN name || '_' || row_number() OVER (PARTITION BY map_id, name ORDER BY id) ELSE name END AS name FROM fx_concepts WINDOW n AS (PARTITION BY map_id, name)", "fx_concepts")
def x3_suffix_duplicate_names(spark, sf):
    return X.suffix_duplicate_names(fixture(spark, sf, "fx_concepts").select("map_id", "id", "name"))


@query("SELECT doc_id * 3 AS origin, doc_id * 3 + 1 AS target, CAST(3.0 AS DOUBLE) AS weight FROM documents")
def x4_resolve_relations(spark, sf):
    e = _extractions(spark, sf)
    ids = X.explode_concepts(e).withColumn("id", F.col("flat_chunk_id") * 3 + F.col("pos"))
    return X.resolve_relations(X.explode_relations(e), ids)


@query("SELECT doc_id AS flat_chunk_id, CASE WHEN doc_id % 5 = 0 THEN [] ELSE [doc_id * 3, doc_id * 3 + 1, doc_id * 3 + 2] END AS ids FROM documents")
def x5_chunk_concept_lists(spark, sf):
    e = _extractions(spark, sf)
    return X.chunk_concept_lists(e, X.explode_concepts(e).filter("flat_chunk_id % 5 <> 0").withColumn("id", F.col("flat_chunk_id") * 3 + F.col("pos")))


_ANSWER = "array(named_struct('fact', 'f' || doc_id, 'source_ids', array(cast(doc_id as string), '2')), named_struct('fact', 'g', 'source_ids', array('3')))"


@query("SELECT doc_id, 'f' || doc_id || '[3][' || doc_id || '] g[3][' || doc_id || ']' AS text FROM documents WHERE doc_id > 3")
def x6_spread_sources(spark, sf):
    d = table(spark, sf, "documents").filter("doc_id > 3").select("doc_id", F.expr(_ANSWER).alias("a"))
    return d.select("doc_id", cited.render_answer(cited.spread_sources(F.col("a"), F.array(F.col("doc_id"), F.lit(3).cast("bigint")))).alias("text"))


@query("SELECT doc_id, 'f' || doc_id || '[' || doc_id || '][2] g[3]' AS text FROM documents")
def x7_render_answer(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cited.render_answer(F.expr(_ANSWER)).alias("text"))


@query("""SELECT c.id, round(CAST(CASE WHEN c.id % 4 > 1 THEN c.embedding[1] WHEN s.question = c.question THEN s.embedding[1] END AS DOUBLE), 6) AS first FROM fx_concepts c LEFT JOIN fx_concepts s ON s.id = c.id - 180 AND c.id % 3 <> 0""", "fx_concepts")
def x8_missing_embeddings(spark, sf):
    c = fixture(spark, sf, "fx_concepts")
    given = c.withColumns({"embedding": F.expr("CASE WHEN id % 4 > 1 THEN embedding END"), "source_ids": F.expr("CASE WHEN id % 3 = 0 THEN array(id - 180, id - 1) ELSE array(id - 180) END")})
    return X.inherit_embeddings(given, c).select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


_BASE = "WITH c AS (SELECT *, regexp_replace(name, '_.*', '') AS base FROM fx_concepts WHERE is_active = 1)"


def _roots(c):
    return c.groupBy("map_id").agg(F.min("id").alias("root"))


@query(_BASE + " SELECT map_id, base, list(id ORDER BY id) AS ids, count(*) AS n, bool_or(id = map_id) AS has_root FROM c GROUP BY ALL HAVING count(*) > 1", "fx_concepts")
def d1_duplicate_groups(spark, sf):
    c = fixture(spark, sf, "fx_concepts")
    return X.duplicate_groups(c, _roots(c))


@query(_BASE + """ SELECT map_id, base, CAST(CASE WHEN count(level) FILTER (id <> map_id) = 0 OR bool_or(level = -1 AND id <> map_id) THEN -1 ELSE max(level) FILTER (id <> map_id) END AS BIGINT) AS level,
CAST(CASE WHEN count(*) FILTER (id <> map_id) = 0 OR bool_or(cluster_id = -1 AND id <> map_id) THEN -1 ELSE max(cluster_id) FILTER (id <> map_id) END AS INTEGER) AS cluster_id FROM c GROUP BY map_id, base HAVING count(*) > 1""", "fx_concepts")
def d2_group_level_and_cluster(spark, sf):
    c = fixture(spark, sf, "fx_concepts")
    return X.group_level_and_cluster(c, _roots(c))


@query(_BASE + """, g AS (SELECT map_id, base, list(id) AS ids FROM c GROUP BY ALL HAVING count(*) > 1), top AS (SELECT map_id, max(id) AS top FROM fx_concepts GROUP BY map_id),
n AS (SELECT g.map_id, base, ids, top + row_number() OVER (PARTITION BY g.map_id ORDER BY base) AS id FROM g JOIN top USING (map_id)), ch AS (SELECT map_id, unnest(ids) AS old_id, id AS new_id FROM n),
r AS (SELECT e.map_id, coalesce(a.new_id, e.origin) AS origin, coalesce(b.new_id, e.target) AS target, CASE WHEN a.new_id IS NOT NULL OR b.new_id IS NOT NULL THEN weight * 0.99::DOUBLE ELSE weight END AS weight, type
FROM fx_edges e LEFT JOIN ch a ON a.map_id = e.map_id AND a.old_id = e.origin LEFT JOIN ch b ON b.map_id = e.map_id AND b.old_id = e.target)
SELECT map_id, origin, target, round(max(weight), 6) AS weight FROM r WHERE origin <> target GROUP BY ALL""", "fx_concepts fx_edges")
def d3_merge_duplicates(spark, sf):
    c = fixture(spark, sf, "fx_concepts")
    _, moved = X.merge_duplicates(c.drop("embedding"), fixture(spark, sf, "fx_edges"), _roots(c))
    return moved.select("map_id", "origin", "target", F.round("weight", 6).alias("weight"))


def merge_answers(spark, sf):
    """Answers that bring names together again: n0 .. n179 become four names m0 .. m3 a map, and those one name but for m3, which becomes two."""
    c = fixture(spark, sf, "fx_concepts").selectExpr("map_id", "id % 180 AS k").distinct()
    first = c.select("map_id", F.expr("concat('n', k)").alias("base"), F.lit(0).alias("pos"), F.expr("concat('m', k div 5 % 4)").alias("name"))
    later = c.select("map_id").distinct().crossJoin(spark.createDataFrame([("m0", 0, "all"), ("m1", 0, "all"), ("m2", 0, "all"), ("m3", 0, "all"), ("m3", 1, "rest")], "base string, pos int, name string"))
    return first.union(later).withColumns({"question": F.lit(None).cast("string"), "is_root": F.col("pos") == 0})


@query()
def d3_merge_to_fixed_point(spark, sf):
    """All rounds: n names, then m names, then one; relations of the answers go from each merged name to the next."""
    c = fixture(spark, sf, "fx_concepts").drop("embedding")
    answers = merge_answers(spark, sf)
    links = answers.filter("base = 'm3'").selectExpr("map_id", "base", "'rest' AS origin_name", "'all' AS target_name")
    done, edges, roots = X.merge_to_fixed_point(c, fixture(spark, sf, "fx_edges"), _roots(c), answers, links)
    ends = edges.groupBy("map_id", F.col("origin").alias("id")).agg(F.count("*").alias("n_out"), F.round(F.sum("weight"), 6).alias("weight_out"))
    rows = done.filter("is_active = 1").join(ends, ["map_id", "id"], "left").join(roots, "map_id", "left")
    return rows.select("map_id", "id", "name", "level", "cluster_id", F.size("source_ids").alias("sources"), "n_out", "weight_out", (F.col("id") == F.col("root")).alias("is_root"))


@query("""WITH off AS (SELECT map_id, id FROM fx_concepts WHERE is_active = 0) SELECT * FROM fx_edges e WHERE origin <> target AND NOT EXISTS (SELECT 1 FROM off WHERE off.map_id = e.map_id AND off.id IN (e.origin, e.target))""", "fx_concepts fx_edges")
def d4_drop_inactive_edges(spark, sf):
    return X.drop_inactive_edges(fixture(spark, sf, "fx_edges"), fixture(spark, sf, "fx_concepts"))


@query("""SELECT map_id, id, CASE WHEN n = 1 OR (is_active = 1 AND act = 1) THEN name WHEN is_active = 1 THEN name || '_' || i ELSE name || '_' END AS name FROM (SELECT *, count(*) OVER w AS n, sum(is_active) OVER w AS act,
row_number() OVER (PARTITION BY map_id, name, is_active ORDER BY id) AS i FROM fx_concepts WINDOW w AS (PARTITION BY map_id, name))""", "fx_concepts")
def d5_unique_names_by_activity(spark, sf):
    return X.unique_names_by_activity(fixture(spark, sf, "fx_concepts").select("map_id", "id", "name", "is_active")).drop("is_active")


@query("""WITH m AS (SELECT *, count(*) OVER (PARTITION BY map_id, name) AS n FROM fx_concepts), b AS (SELECT map_id, id, name, CAST(floor((row_number() OVER (PARTITION BY map_id ORDER BY id) - 1) / 10) AS BIGINT) AS batch FROM m WHERE n > 1)
SELECT map_id, batch, '[' || string_agg('{"id":' || id || ',"name":"' || name || '"}', ',' ORDER BY id) || ']' AS rows FROM b GROUP BY ALL""", "fx_concepts")
def d6_rename_batches(spark, sf):
    return X.rename_batches(fixture(spark, sf, "fx_concepts"))


_RENAMED = "CASE WHEN count(*) OVER (PARTITION BY map_id, name) > 1 THEN {} ELSE name END AS name"


@query("WITH a AS (SELECT map_id, id, " + _RENAMED.format("'n' || (id % 29)") + " FROM fx_concepts), b AS (SELECT map_id, id, " + _RENAMED.format("CASE WHEN id % 4 = 0 THEN name ELSE 'x' || (id // 3) END") + " FROM a) SELECT map_id, id, " + _RENAMED.format("'y' || id") + " FROM b", "fx_concepts")
def d6_rename_until_unique(spark, sf):
    """Three rounds of names: proposals of the first clash with names that were not asked for, the second has none for every fourth concept."""
    c = fixture(spark, sf, "fx_concepts").select("map_id", "id", "name")
    rows = [("1", "concat('n', id % 29)", "true"), ("2", "concat('x', id div 3)", "id % 4 <> 0"), ("3", "concat('y', id)", "true")]
    names = [c.filter(test).selectExpr("map_id", f"{attempt} AS attempt", "id", f"{name} AS name") for attempt, name, test in rows]
    return X.rename_until_unique(c, names[0].union(names[1]).union(names[2]))[0]


@query(r"""WITH t AS (SELECT doc_id % 7 AS map_id, doc_id AS id, coalesce(text, '') AS text, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', '', 'g'), '[\x09-\x0D ]+', ' ', 'g')) AS n FROM documents),
f AS (SELECT *, min(id) OVER (PARTITION BY map_id, n) AS least FROM t),
r AS (SELECT map_id, id, least, CASE WHEN trim(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) = '' OR length(trim(text)) <= 1 THEN 'trivial' WHEN n = 'same' THEN 'question' WHEN id > least THEN 'duplicate' END AS reason FROM f)
SELECT map_id, id, CASE WHEN reason = 'duplicate' THEN least END AS duplicate_of, reason FROM r WHERE reason IS NOT NULL""")
def d7_duplicate_node_report(spark, sf):
    return X.duplicate_node_report(table(spark, sf, "documents").select(F.expr("doc_id % 7").alias("map_id"), F.col("doc_id").alias("id"), F.lit("Same?").alias("question"), F.col("text").alias("details")))


@query(r"SELECT page_id, (length(trim(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g'))) = 0 OR length(trim(t)) <= 1) AS trivial FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN regexp_replace(url, '[A-Za-z0-9]', '', 'g') ELSE url END AS t FROM pages)")
def d8_is_trivial_text(spark, sf):
    p = table(spark, sf, "pages").selectExpr("page_id", "CASE WHEN page_id % 4 = 0 THEN regexp_replace(url, '[A-Za-z0-9]', '') ELSE url END AS t")
    return p.select("page_id", is_trivial_text(F.col("t")).alias("trivial"))
