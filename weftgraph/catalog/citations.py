"""Queries of the citations section."""

from pyspark.sql import functions as F

from ..functions import cited
from ..operators import citations as C
from .base import fixture, query, table

_SETS = "f AS (SELECT id, pos, fact, list_sort(list_distinct([part_a, part_b])) AS p FROM fx_facts)"


def _concepts(spark, sf):
    f = fixture(spark, sf, "fx_facts").select("id", "pos", F.struct("fact", F.array(F.col("part_a").cast("string"), F.col("part_b").cast("string")).alias("source_ids")).alias("f"))
    return f.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "f"))).getField("f").alias("answer"))


def _facts(answers):
    return answers.select("id", F.posexplode("answer").alias("pos", "f")).select("id", "pos", "f.fact", "f.source_ids")


def _parts(spark, sf):
    return fixture(spark, sf, "fx_parts")


@query("""WITH e AS (SELECT id * 4 + pos AS id, [part_a, part_b] AS ids FROM fx_facts), x AS (SELECT id, unnest(ids) AS part_id, unnest([0, 1]) AS k FROM e)
SELECT id, coalesce(list(citation ORDER BY k) FILTER (citation IS NOT NULL), []) AS citations FROM x LEFT JOIN fx_parts USING (part_id) GROUP BY id""", "fx_facts fx_parts")
def f1_concept_citations(spark, sf):
    return C.concept_citations(fixture(spark, sf, "fx_facts").select(F.expr("id * 4 + pos").alias("id"), F.array("part_a", "part_b").alias("part_ids")), _parts(spark, sf))


@query(f"""WITH {_SETS}, x AS (SELECT id, pos, fact, unnest(p) AS part_id FROM f) SELECT id, CAST(pos AS INTEGER) AS pos, fact, coalesce(list_sort(list_distinct(list(citation) FILTER (citation IS NOT NULL))), []) AS source_ids
FROM x LEFT JOIN fx_parts USING (part_id) GROUP BY ALL""", "fx_facts fx_parts")
def f2_cite_facts(spark, sf):
    return _facts(C.cite_facts(_concepts(spark, sf), _parts(spark, sf)))


@query(f"""WITH {_SETS}, x AS (SELECT id, pos, fact, unnest(p) AS part_id FROM f), y AS (SELECT id, pos, fact, coalesce(citation, 'u') AS c, q.part_id FROM x LEFT JOIN fx_parts q USING (part_id))
SELECT id, CAST(pos AS INTEGER) AS pos, fact, CASE WHEN bool_and(part_id IS NOT NULL) THEN [CAST(v AS VARCHAR) FOR v IN list_sort(list(DISTINCT part_id))] ELSE list_sort(list(DISTINCT c)) END AS source_ids FROM y GROUP BY id, pos, fact""", "fx_facts fx_parts")
def f3_citations_to_part_ids(spark, sf):
    parts = _parts(spark, sf)
    given = fixture(spark, sf, "fx_facts").select("id", "pos", "fact", F.explode(F.array_distinct(F.array("part_a", "part_b"))).alias("part_id")).join(parts, "part_id", "left")
    facts = given.groupBy("id", "pos", "fact").agg(F.array_sort(F.collect_set(F.coalesce("citation", F.lit("u")))).alias("source_ids"))
    answers = facts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("fact", "source_ids").alias("f")))).getField("f").alias("answer"))
    return _facts(C.citations_to_part_ids(answers, parts))


@query("""WITH f AS (SELECT id, pos, fact, list_sort(list_distinct([CAST(part_a AS VARCHAR), CAST(part_b AS VARCHAR)])) AS s FROM fx_facts),
g AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM f), h AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS island FROM g),
i AS (SELECT id, island, string_agg(fact, ' ' ORDER BY pos) || ' ^[^' || array_to_string(any_value(s), ']^^[') || ']^' AS text FROM h GROUP BY id, island) SELECT id, string_agg(text, ' ' ORDER BY island) AS text FROM i GROUP BY id""", "fx_facts")
def f4_render_grouped_answer(spark, sf):
    return C.render_grouped_answer(_concepts(spark, sf))


@query("SELECT map_id, id, CAST(floor((row_number() OVER (PARTITION BY map_id ORDER BY id) - 1) / 10) AS BIGINT) AS batch FROM fx_concepts", "fx_concepts")
def f5_batches(spark, sf):
    return C.batches(fixture(spark, sf, "fx_concepts").select("map_id", "id"))


_PARSED = r"""p AS (SELECT id, string_split_regex(details, '\^\[\d+(?:\.\d+)*\]\^') AS t, list_append(regexp_extract_all(details, '\^\[(\d+(?:\.\d+)*)\]\^', 1), '0.0') AS s FROM fx_cited),
q AS (SELECT id, generate_subscripts(t, 1) AS pos, trim(unnest(t)) AS fact, unnest(s) AS source FROM p),
k AS (SELECT * FROM q WHERE length(trim(regexp_replace(fact, '[!-/:-@\[-`{-~]', '', 'g'))) > 0 AND length(fact) > 1)"""


def _parsed(spark, sf):
    return fixture(spark, sf, "fx_cited").select("id", cited.parse_cited_text(F.col("details")).alias("answer"))


@query(f"WITH {_PARSED} SELECT id, fact, [source] AS source_ids FROM k", "fx_cited")
def f6_parse_cited_text(spark, sf):
    return _facts(_parsed(spark, sf)).drop("pos")


@query(rf"WITH {_PARSED} SELECT id, fact, CASE WHEN len(string_split(source, '.')) = 2 THEN replace(source, '.', '.1.') ELSE source END AS source FROM k", "fx_cited")
def f7_upgrade_citations(spark, sf):
    up = _parsed(spark, sf).select("id", cited.upgrade_citations(F.col("answer")).alias("answer"))
    return _facts(up).select("id", "fact", F.col("source_ids")[0].alias("source"))


@query(f"WITH {_PARSED} SELECT id, list_sort(list_distinct(list(source))) AS citations FROM k GROUP BY id", "fx_cited")
def f8_citation_set(spark, sf):
    return _parsed(spark, sf).select("id", cited.citation_set(F.col("answer")).alias("citations")).filter("size(citations) > 0")


@query(f"""WITH {_PARSED}, n AS (SELECT source, row_number() OVER (ORDER BY source) AS part_id FROM (SELECT DISTINCT source FROM k)), s AS (SELECT DISTINCT id, source FROM k) SELECT id, list(part_id ORDER BY source) AS part_ids FROM s JOIN n USING (source) GROUP BY id""", "fx_cited")
def f9_citation_part_ids(spark, sf):
    nodes = _parsed(spark, sf).select("id", cited.citation_set(F.col("answer")).alias("citations"))
    return C.citation_part_ids(nodes).filter("size(part_ids) > 0")


@query(f"""WITH {_PARSED}, n AS (SELECT source, row_number() OVER (ORDER BY source) AS part_id FROM (SELECT DISTINCT source FROM k)) SELECT part_id, source AS citation FROM n""", "fx_cited")
def f10_part_table(spark, sf):
    nodes = _parsed(spark, sf).select("id", cited.citation_set(F.col("answer")).alias("citations"))
    return C.part_table(C.citation_part_ids(nodes).join(nodes, "id"))


@query("""SELECT id, CAST(pos AS INTEGER) AS pos, fact, [CASE WHEN part_a % 3 = 0 THEN 'm' || part_a ELSE CAST(part_a AS VARCHAR) END, CASE WHEN part_b % 3 = 0 THEN 'm' || part_b ELSE CAST(part_b AS VARCHAR) END] AS source_ids FROM fx_facts""", "fx_facts")
def f11_map_sources(spark, sf):
    mapping = table(spark, sf, "documents").filter("doc_id % 3 = 0").selectExpr("cast(doc_id as string) AS source", "'m' || doc_id AS mapped")
    return _facts(C.map_sources(_concepts(spark, sf), mapping))


@query("SELECT doc_id, 'a ^[' || doc_id || '.1]^^[2.2]^ b ^[3]^^[4.1.2]^ c ' AS text FROM documents")
def f12_fix_references(spark, sf):
    t = F.concat(F.lit("a ^["), F.col("doc_id").cast("string"), F.lit(".1]^[2.2]^ b ^[3]^ ^[4.1.2]^ c ^[0]^"))
    return table(spark, sf, "documents").select("doc_id", cited.fix_references(t).alias("text"))


@query("SELECT doc_id, 's' || doc_id || ' ^[' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.7' ELSE '' END || ']^ t ^[1.2]^' AS details FROM documents")
def f13_assemble_details(spark, sf):
    item = lambda s, d, c: f"named_struct('statement', {s}, 'doc', {d}, 'chunk', {c})"
    a = F.expr(f"array({item(chr(39) + 's' + chr(39) + ' || doc_id', 'cast(doc_id as string)', 'CASE WHEN doc_id % 2 = 0 THEN ' + chr(39) + '7' + chr(39) + ' END')}, {item('cast(null as string)', repr('9'), repr('9'))}, {item(repr('t'), repr('1'), repr('2'))})")
    return table(spark, sf, "documents").select("doc_id", cited.assemble_details(a).alias("details"))


@query("SELECT doc_id AS id, 'x ^[t' || doc_id || ']^ y [2] z ^[1.2.3]^ ^[4.5.6]^ w [7.8]' AS answer FROM documents")
def f14_rewrite_answer_refs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    answers = d.withColumn("answer", F.lit("x [1] y [2] z [1.2.3] ^[4.5.6]^ w [7.8]"))
    return C.rewrite_answer_refs(answers, d.select("id", F.lit(1).alias("n"), F.concat(F.lit("t"), "id").alias("target")))


@query("SELECT doc_id AS id, 'a [1] b [2] c [1]' || CASE WHEN doc_id % 2 = 0 THEN ' <[9]>' ELSE '' END AS answer, [3, 1] AS \"order\" FROM documents")
def f15_renumber_refs(spark, sf):
    d = table(spark, sf, "documents")
    return C.renumber_refs(d.selectExpr("doc_id AS id", "'a <[3]> b <[1]> c <[3]>' || CASE WHEN doc_id % 2 = 0 THEN ' <[9]>' ELSE '' END AS answer", "4 AS n_docs"))


@query("""SELECT doc_id AS id, CAST(nth AS INTEGER) AS nth, ref, kind, content FROM (SELECT doc_id, 1 AS nth, doc_id || '.1.1' AS ref, 'page' AS kind, 'p' || doc_id AS content FROM documents
UNION ALL SELECT doc_id, 2, doc_id || '.5', 'chunk', 'c' || doc_id FROM documents UNION ALL SELECT doc_id, 4, 'n7', 'node', 'seven' FROM documents)""")
def f16_resolve_references(spark, sf):
    d = table(spark, sf, "documents")
    texts = d.selectExpr("doc_id AS id", "'a ^[' || doc_id || '.1.1]^^[' || doc_id || '.5]^ b ^[' || doc_id || '.1.1]^ c ^[x.9.9]^ ^[n7]^' AS text")
    of = lambda number, letter: d.selectExpr("cast(doc_id as string) AS doc", "1 AS version", f"{number} AS number", f"'{letter}' || doc_id AS content")
    nodes = d.filter("doc_id = 7").selectExpr("'n' || doc_id AS node_id", "'seven' AS content")
    return C.resolve_references(texts, of(1, "p"), of(5, "c"), nodes)


@query("""WITH h AS (SELECT event_id // 10 AS id, CAST(event_id % 10 AS INTEGER) AS r FROM events)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY CASE WHEN r % 3 = 0 THEN 0 ELSE 1 END, r) AS INTEGER) AS n,
CASE WHEN r % 3 = 0 THEN 'N' || r ELSE 'd' || (r % 2) || '.1.' || (CASE WHEN r % 4 = 1 THEN r + 100 ELSE r + (r % 2) * 5 + 1 END) END AS target FROM h""")
def f17_build_citation_map(spark, sf):
    h = table(spark, sf, "events").selectExpr("event_id div 10 AS id", "cast(event_id % 10 as int) AS rank")
    hits = h.selectExpr("id", "CASE WHEN rank % 3 = 0 THEN 'card' ELSE 'chunk' END AS kind", "rank", "'N' || rank AS node_id", "'d' || (rank % 2) AS doc", "1 AS version", "CASE WHEN rank % 4 = 1 THEN rank + 100 END AS page", "rank AS chunk_id")
    return C.build_citation_map(hits, h.selectExpr("'d' || (rank % 2) AS doc", "1 AS version", "(rank % 2) * 5 AS n_chunks").distinct())
