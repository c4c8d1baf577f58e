"""Queries of the chunking section."""

from pyspark.sql import functions as F

from ..functions.text import count_tokens, image_tokens
from ..operators import chunking as C
from .base import fixture, query, table  # noqa: F401

_LINES = r"""lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
chunks AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, text, CASE WHEN pos % 3 > 0 THEN 'H' || (pos // 3 % 2) END AS header, len(regexp_extract_all(text, '\w+|[^\w\s]')) AS tokens FROM lines)"""


def _chunks(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.withColumns({"header": F.expr("CASE WHEN pos % 3 > 0 THEN 'H' || (pos div 3 % 2) END"), "tokens": count_tokens(F.col("text"))})


def _pages(spark, sf):
    return _chunks(spark, sf).select("doc_id", (F.col("pos") + 1).alias("page_id"), "text", "tokens", F.expr("pos % 4 * 9").alias("n_images"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\w+|[^\w\s]')) AS n_tokens FROM documents")
def c1_count_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", count_tokens(F.col("text")).alias("n_tokens"))


@query("""WITH a AS (SELECT event_id, CAST(1 + event_id % 4000 AS DOUBLE) AS w, CAST(1 + user_id * 37 % 3000 AS DOUBLE) AS h FROM events),
b AS (SELECT event_id, floor(w * least(1.0, 2048.0 / greatest(w, h))) AS w, floor(h * least(1.0, 2048.0 / greatest(w, h))) AS h FROM a),
c AS (SELECT event_id, floor(w * s) AS w, floor(h * s) AS h FROM (SELECT *, CASE WHEN w > 768 AND h > 768 THEN 768.0 / least(w, h) ELSE 1.0 END AS s FROM b))
SELECT event_id, CAST(85 + 170 * ceil(w / 512) * ceil(h / 512) AS BIGINT) AS n FROM c""")
def c2_image_tokens(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "CAST(1 + event_id % 4000 AS DOUBLE) w", "CAST(1 + user_id * 37 % 3000 AS DOUBLE) h")
    return e.select("event_id", image_tokens(F.col("w"), F.col("h")).alias("n"))


@query(f"""WITH {_LINES}, md AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 1 THEN '# ' || substr(text, 1, 9) ELSE text END AS line FROM chunks),
h AS (SELECT *, CASE WHEN starts_with(line, '# ') THEN trim(substr(line, 3)) END AS head FROM md),
s AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id, section, max(head) AS header, trim(string_agg(line, chr(10) ORDER BY pos) FILTER (head IS NULL)) AS text FROM s GROUP BY doc_id, section HAVING trim(string_agg(line, chr(10) ORDER BY pos) FILTER (head IS NULL)) <> ''""")
def c3_split_by_header(spark, sf):
    md = _chunks(spark, sf).withColumn("line", F.expr("CASE WHEN pos % 3 = 1 THEN '# ' || substr(text, 1, 9) ELSE text END"))
    docs = md.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "line"))).getField("line"), "\n").alias("md"))
    return C.split_by_header(docs)


@query()
def c4_recursive_split(spark, sf):
    return C.recursive_split(table(spark, sf, "documents"))


_GREEDY = """WITH RECURSIVE {lines}, g AS (SELECT doc_id, pos, tokens, 1 AS grp, tokens AS run FROM chunks WHERE pos = 0
UNION ALL SELECT c.doc_id, c.pos, c.tokens, CASE WHEN run + c.tokens <= {most} THEN grp ELSE grp + 1 END, CASE WHEN run + c.tokens <= {most} THEN run + c.tokens ELSE c.tokens END
FROM g JOIN chunks c ON c.doc_id = g.doc_id AND c.pos = g.pos + 1)"""


@query(_GREEDY.format(lines=_LINES, most=2048) + """, heads AS (SELECT doc_id, grp, string_agg(header, ' and ' ORDER BY pos) AS header FROM (SELECT doc_id, grp, header, min(pos) AS pos FROM g JOIN chunks USING (doc_id, pos) WHERE header IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT m.*, h.header FROM (SELECT doc_id, grp, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, CAST(sum(g.tokens) AS BIGINT) AS tokens FROM g JOIN chunks c USING (doc_id, pos) GROUP BY ALL) m LEFT JOIN heads h USING (doc_id, grp)""")
def c5_merge_small_chunks(spark, sf):
    return C.merge_small_chunks(_chunks(spark, sf))


@query(f"""WITH RECURSIVE {_LINES}, p AS (SELECT doc_id, pos + 1 AS page_id, tokens, pos % 4 * 9 AS n_images FROM chunks),
g AS (SELECT doc_id, page_id, tokens, n_images, 1 AS grp, tokens AS a, n_images AS b FROM p WHERE page_id = 1
UNION ALL SELECT p.doc_id, p.page_id, p.tokens, p.n_images, CASE WHEN a + p.tokens <= 2048 AND b + p.n_images <= 50 THEN grp ELSE grp + 1 END,
CASE WHEN a + p.tokens <= 2048 AND b + p.n_images <= 50 THEN a + p.tokens ELSE p.tokens END, CASE WHEN a + p.tokens <= 2048 AND b + p.n_images <= 50 THEN b + p.n_images ELSE p.n_images END
FROM g JOIN p ON p.doc_id = g.doc_id AND p.page_id = g.page_id + 1) SELECT doc_id, page_id, tokens, n_images, grp FROM g""")
def c6_group_pages(spark, sf):
    return C.group_pages(_pages(spark, sf).drop("text"))


@query()
def c7_split_oversized_pages(spark, sf):
    return C.split_oversized_pages(_pages(spark, sf), F.col("tokens"), 300)


@query(f"""WITH {_LINES} SELECT doc_id, string_agg('Page ' || (pos + 1) || ': ' || text, chr(10) ORDER BY pos) AS text, list(pos + 1 ORDER BY pos) AS page_ids FROM chunks GROUP BY doc_id""")
def c8_page_chunk_text(spark, sf):
    return C.page_chunk_text(_pages(spark, sf), ["doc_id"])


@query("SELECT doc_id, text FROM documents WHERE trim(text) <> ''")
def c9_whole_documents(spark, sf):
    return C.whole_documents(table(spark, sf, "documents"))


@query(f"""WITH {_LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS chunk_id, row_number() OVER (ORDER BY doc_id, pos) AS flat_chunk_id,
CASE WHEN header IS NULL THEN text ELSE '# ' || header || chr(10) || text END AS content FROM chunks""")
def c10_number_chunks(spark, sf):
    return C.number_chunks(_chunks(spark, sf))


@query("""WITH c AS (SELECT doc_id, CAST(1 AS INTEGER) AS chunk_id, row_number() OVER (ORDER BY doc_id) AS flat_chunk_id, doc_id % 4 AS n FROM documents),
p AS (SELECT *, unnest(CASE WHEN n = 0 THEN [NULL] ELSE range(1, n + 1) END) AS page_id FROM c)
SELECT doc_id, chunk_id, flat_chunk_id, CAST(page_id AS INTEGER) AS page_id, doc_id || '.' || coalesce(page_id, chunk_id) AS citation, 100 + row_number() OVER (ORDER BY flat_chunk_id, page_id) AS flat_part_id FROM p""")
def c11_flat_parts(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", F.lit("x").alias("text"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("header"))
    pages = F.when(F.col("doc_id") % 4 > 0, F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    return C.flat_parts(C.number_chunks(c).withColumn("page_ids", pages), 100)


@query()
def c12_node_search_docs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substr("text", F.lit(1), F.lit(20)).alias("title"), F.lit("What?").alias("question"), F.col("text").alias("details"))
    return C.node_search_docs(d)


@query("""WITH d AS (SELECT doc_id, unnest(['s ' || doc_id, 'k', 'd' || doc_id || ' x', 'f', 't1']) AS text, unnest(range(5)) AS pos FROM documents WHERE doc_id % 7 <> 3)
SELECT doc_id, CAST(1 AS INTEGER) AS page, CAST(pos AS INTEGER) AS pos, text FROM d""")
def c13_page_description_chunks(spark, sf):
    good = "concat('```json\n{\"summary\": \"s ', doc_id, '\", \"keyfact\": \"k\", \"images\": [{\"description\": \"d', doc_id, '\\\\n x\", \"keyfact\": \"f\"},], \"tables\": [{\"description\": \"t1\", \"keyfact\": \"No tables are present\"}]}\n```')"
    d = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), F.expr(f"CASE WHEN doc_id % 7 = 3 THEN 'not json' ELSE {good} END").alias("json"))
    return C.page_description_chunks(d)


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(text, '(?s).+?(?:[.] |$)') AS l FROM documents), p AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM l),
s AS (SELECT doc_id, i, piece, len(regexp_extract_all(piece, '[^\x09-\x0D ]+')) AS w FROM p),
g AS (SELECT doc_id, i, w AS now, 0 AS grp FROM s WHERE i = 1
UNION ALL SELECT s.doc_id, s.i, CASE WHEN now >= 12 THEN s.w ELSE now + s.w END, CASE WHEN now >= 12 THEN grp + 1 ELSE grp END FROM g JOIN s ON s.doc_id = g.doc_id AND s.i = g.i + 1),
last AS (SELECT doc_id, grp, regexp_replace(string_agg(piece, '' ORDER BY i), '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g') AS text FROM g JOIN s USING (doc_id, i) GROUP BY ALL)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(text, '|' ORDER BY grp)) AS digest FROM last WHERE text <> '' GROUP BY doc_id""")
def c14_split_on_separators(spark, sf):
    pieces = C.split_on_separators(F.col("text"), "[.] ", 12)
    d = table(spark, sf, "documents").select("doc_id", pieces.alias("p")).filter("size(p) > 0")
    return d.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|").cast("binary")).alias("digest"))


@query(r"""WITH t AS (SELECT doc_id % 3 AS map_id, doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://[^\x09-\x0D ]+|www\.[^\x09-\x0D ]+', '', 'g'), '[\x09-\x0D ]+', ' ', 'g')) AS t FROM documents),
s AS (SELECT map_id, sum(length(t)) AS total FROM t WHERE t <> '' GROUP BY map_id)
SELECT map_id, doc_id, md5(substr(t, 1, greatest(100, CAST(floor(length(t) * 15000 / total) AS INTEGER)))) AS digest FROM t JOIN s USING (map_id) WHERE t <> ''""")
def c15_language_sample(spark, sf):
    d = table(spark, sf, "documents").select(F.expr("doc_id % 3").alias("map_id"), "doc_id", "text")
    return C.language_sample(d).select("map_id", "doc_id", F.md5(F.col("sample").cast("binary")).alias("digest"))


@query("""WITH n AS (SELECT doc_id % 12 AS map_id, lang, sum(length(text)) AS n FROM documents WHERE doc_id % 12 <> 5 GROUP BY ALL),
b AS (SELECT map_id, arg_min(lang, (-n, lang)) AS lang FROM n GROUP BY map_id) SELECT m.map_id, coalesce(lang, 'English') AS lang FROM (SELECT DISTINCT doc_id % 12 AS map_id FROM documents) m LEFT JOIN b USING (map_id)""")
def c16_dominant_language(spark, sf):
    d = table(spark, sf, "documents").select(F.expr("doc_id % 12").alias("map_id"), "lang", "text")
    return C.dominant_language(d.filter("map_id <> 5"), d)


@query(f"""WITH {_LINES} SELECT doc_id, '<document ' || doc_id || '>' || chr(10) || string_agg('<chunk ' || (pos + 3) || '>' || text || '</chunk>', chr(10) ORDER BY pos) || chr(10) || '</document>' AS block FROM chunks GROUP BY doc_id""")
def c17_document_blocks(spark, sf):
    return C.document_blocks(_chunks(spark, sf).withColumnRenamed("pos", "chunk_id"), 2)
