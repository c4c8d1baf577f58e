"""Queries of retrieval."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import retrieval as R
from .base import fixture, query, table
from .stemsql import stem_sql

_STOP = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
_TOKENS = rf"[lower(t) FOR t IN regexp_extract_all(coalesce(text, ''), '\w+|[^\w\s]') IF t NOT IN ({_STOP})]"
_CUT = f"c AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents), b AS (SELECT item_id, {_TOKENS} AS tokens FROM benchmark)"
_STEMS = _CUT + ", terms AS (SELECT unnest(tokens) AS term FROM c UNION ALL SELECT unnest(tokens) FROM b), " + stem_sql("terms")
_INDEX = _STEMS + """, t AS (SELECT doc_id, unnest(tokens) AS term FROM c), p AS (SELECT doc_id, stem AS term, count(*) AS tf FROM t JOIN stems USING (term) GROUP BY ALL)"""
_IDF = """, raw AS (SELECT term, ln(((SELECT count(*) FROM c) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM p GROUP BY term), idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_id"), R.keywords(F.col("text")).alias("tokens"))


def _queries(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), R.keywords(F.col("text")).alias("tokens"))
    return R.stem_tokens(asked, "query_id")


def _vectors(spark, sf):
    return fixture(spark, sf, "fx_concepts").select("map_id", "id", "embedding")


@query(f"""WITH {_STEMS}, s AS (SELECT doc_id, count(*) AS n, string_agg(stem, ' ' ORDER BY pos) AS l FROM (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM c) JOIN stems USING (term) GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n, md5(coalesce(l, '')) AS digest FROM c LEFT JOIN s USING (doc_id)""")
def r1_keywords(spark, sf):
    stems = R.stem_tokens(_chunks(spark, sf).select("doc_id", "tokens"), "doc_id")
    return stems.select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query(f"WITH {_INDEX}{_IDF} SELECT term, round(idf, 6) AS idf FROM idf")
def r2_bm25_index(spark, sf):
    return R.bm25_idf(*R.bm25_index(_chunks(spark, sf), stemmed=True)).select("term", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_INDEX}{_IDF}, q AS (SELECT item_id AS query_id, stem AS term, count(*) AS times FROM (SELECT item_id, unnest(tokens) AS term FROM b) JOIN stems USING (term) GROUP BY ALL), l AS (SELECT doc_id, len(tokens) AS n FROM c),
s AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (SELECT avg(n) FROM l)))), 9) AS score FROM p JOIN q USING (term) JOIN idf USING (term) JOIN l USING (doc_id) GROUP BY ALL)
SELECT query_id, CAST(r AS INTEGER) AS rank, doc_id, 0 AS chunk_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS r FROM s) WHERE r <= 7""")
def r3_bm25_topk(spark, sf):
    postings, lengths = R.bm25_index(_chunks(spark, sf), stemmed=True)
    return R.bm25_topk(_queries(spark, sf), postings, lengths).withColumn("score", F.round("score", 5))


_PAIRS = "v AS (SELECT map_id, id, CAST(embedding AS DOUBLE[]) AS e FROM fx_concepts), d AS (SELECT a.map_id, a.id, b.id AS other, round(list_distance(a.e, b.e), 9) AS d, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.map_id = b.map_id)"


@query(f"WITH {_PAIRS} SELECT map_id, id, other, round(d, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY map_id, id ORDER BY d, other) AS r FROM d WHERE id <> other) WHERE r <= 6", "fx_concepts")
def r4_vector_topk(spark, sf):
    from ..operators.vectors import top_similar

    v = _vectors(spark, sf)
    return top_similar(v, v, 6, "l2").withColumn("score", F.round("score", 6))


@query("SELECT d.doc_id, 1 AS chunk_id, e.vec_id FROM documents d JOIN embeddings e ON e.vec_id // 2 = d.doc_id AND e.vec_id % 2 = d.doc_id % 2")
def r5_page_vectors_to_chunks(spark, sf):
    chunks = table(spark, sf, "documents").selectExpr("doc_id", "1 AS chunk_id", "1 + doc_id % 2 AS page_number")
    pages = table(spark, sf, "embeddings").selectExpr("vec_id div 2 AS doc_id", "vec_id % 2 AS page_index", "vec_id AS embedding")
    return R.page_vectors_to_chunks(chunks, pages).withColumnRenamed("embedding", "vec_id")


@query("""WITH h AS (SELECT user_id AS query_id, event_id % 40 AS doc_id, CAST(event_id % 3 AS INTEGER) AS chunk_id, 1 + event_id % 7 AS rank FROM events)
SELECT query_id, doc_id, chunk_id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score FROM h GROUP BY ALL""")
def r6_rank_fusion(spark, sf):
    h = table(spark, sf, "events").selectExpr("user_id AS query_id", "event_id % 40 AS doc_id", "cast(event_id % 3 as int) AS chunk_id", "1 + event_id % 7 AS rank", "1.0D AS weight")
    return R.rank_fusion(h).select("query_id", "doc_id", "chunk_id", F.round("score", 9).alias("score"))


@query("SELECT doc_id % 90 AS map_id, sum(length(text) + length(source) + 30) <= 12000 AS fits FROM documents GROUP BY 1")
def r7_fits_in_prompt(spark, sf):
    return R.fits_in_prompt(table(spark, sf, "documents").selectExpr("doc_id % 90 AS map_id", "text", "source AS attributes"))


@query(f"WITH {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY map_id, id ORDER BY s DESC, other) AS r FROM d), f AS (SELECT map_id, id, other % 9 AS parent, min(r) AS r FROM k WHERE r <= 5 GROUP BY ALL) SELECT map_id, id, parent, CAST(row_number() OVER (PARTITION BY map_id, id ORDER BY r) AS INTEGER) AS nth FROM f", "fx_concepts")
def r8_multi_vector_topk(spark, sf):
    v = _vectors(spark, sf)
    return R.multi_vector_topk(v, v, v.selectExpr("map_id", "id", "id % 9 AS parent"))


@query(f"WITH {_PAIRS}, b AS (SELECT map_id, id AS query_id, other // 20 AS node_id, max(s) AS best FROM d GROUP BY ALL) SELECT map_id, query_id, node_id, round(best, 6) AS best, CAST(row_number() OVER w AS INTEGER) AS nth, round(coalesce(best - lead(best) OVER w, 1.0), 6) AS margin FROM b WINDOW w AS (PARTITION BY map_id, query_id ORDER BY best DESC, node_id)", "fx_concepts")
def r9_best_trigger(spark, sf):
    v = _vectors(spark, sf)
    nodes = v.groupBy("map_id", F.expr("id div 20").alias("node_id")).agg(F.collect_list(F.struct(F.col("id").cast("string").alias("text"), "embedding")).alias("questions"))
    found = R.best_trigger(v.select("map_id", F.col("id").alias("query_id"), "embedding"), nodes, text=False)
    six = lambda c: F.expr(f"if({c} < 0, -1, 1) * floor(abs({c}) * 1e6D + 0.5D) / 1e6D").alias(c)  # noqa: E731  as DuckDB rounds, halves by their binary value
    return found.select("map_id", "query_id", "node_id", six("best"), "nth", six("margin"))


#: Token vectors of a text: as many slices of eight numbers of its vector as its id says, two at least.
_TOKEN_VECTORS = "list_transform(range(0, 2 + id % {n}), lambda i: list_slice(e, i * 8 + 1, i * 8 + 8))"


@query(f"""WITH v AS (SELECT map_id, id, CAST(embedding AS DOUBLE[]) AS e FROM fx_concepts),
t AS (SELECT map_id, id, {_TOKEN_VECTORS.format(n=6)} AS qt, {_TOKEN_VECTORS.format(n=4)} AS tt FROM v),
d AS (SELECT a.map_id, a.id AS query_id, b.id // 20 AS node_id, b.id AS q, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.map_id = b.map_id WHERE a.id % 4 = 1 AND b.id % 4 <> 1),
b AS (SELECT map_id, query_id, node_id, max(s) AS best, min_by(q, (-s, q)) AS q FROM d GROUP BY ALL),
m AS (SELECT *, best - lead(best) OVER w AS ahead, row_number() OVER w AS nth FROM b WINDOW w AS (PARTITION BY map_id, query_id ORDER BY best DESC, node_id)),
c AS (SELECT m.map_id, m.query_id, m.node_id, m.q, best, coalesce(ahead, 1.0) AS margin, i, j, list_cosine_similarity(x.qt[i], y.tt[j]) AS s FROM m JOIN t x ON x.map_id = m.map_id AND x.id = m.query_id JOIN t y ON y.map_id = m.map_id AND y.id = m.q,
      unnest(range(1, 10)) AS r1(i), unnest(range(1, 10)) AS r2(j) WHERE nth = 1 AND i <= len(x.qt) AND j <= len(y.tt)),
by_j AS (SELECT map_id, query_id, min(s) AS least, avg(s) AS mean FROM (SELECT map_id, query_id, j, max(s) AS s FROM c GROUP BY ALL) GROUP BY ALL),
by_i AS (SELECT map_id, query_id, min(s) AS least, avg(s) AS mean FROM (SELECT map_id, query_id, i, max(s) AS s FROM c GROUP BY ALL) GROUP BY ALL)
SELECT DISTINCT c.map_id, c.query_id, c.node_id, round(c.best, 6) AS best, round(c.margin, 6) AS margin, round(by_j.least, 6) AS least_of_question, round(by_i.least, 6) AS least_of_query,
round(by_j.mean, 6) AS mean_of_question, round(by_i.mean, 6) AS mean_of_query FROM c JOIN by_j USING (map_id, query_id) JOIN by_i USING (map_id, query_id)""", "fx_concepts")
def r9_match_features(spark, sf):
    """The six features of every question (one of four vectors is a user's, the others are cards')."""
    from ..operators.triggers import FEATURES, match_features

    v = _vectors(spark, sf)
    tokens = lambda n: F.expr(f"transform(sequence(0, 1 + cast(id % {n} as int)), i -> slice(embedding, i * 8 + 1, 8))").alias("tokens")
    cards, asked = v.filter("id % 4 <> 1").withColumn("node_id", F.expr("id div 20")), v.filter("id % 4 = 1").withColumnRenamed("id", "query_id")
    listed = cards.groupBy("map_id", "node_id").agg(F.sort_array(F.collect_list(F.struct("id", F.struct(F.col("id").cast("string").alias("text"), "embedding").alias("q")))).alias("l"))
    nodes = listed.select("map_id", "node_id", F.col("l.q").alias("questions"))
    place = cards.withColumn("pos", F.row_number().over(W.partitionBy("map_id", "node_id").orderBy("id")) - 1)
    found = match_features(asked, nodes, asked.withColumn("id", F.col("query_id")).select("map_id", "query_id", tokens(6)), place.select("map_id", "node_id", "pos", tokens(4)))
    return found.select("map_id", "query_id", "node_id", *[F.round(c, 6).alias(c) for c in FEATURES])


@query("WITH h AS (SELECT event_id, event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id FROM events) SELECT event_id, doc_id, lang FROM h JOIN documents USING (doc_id)")
def r10_chunk_lookup(spark, sf):
    """Every event is a hit, and every document may be looked up."""
    chunks = table(spark, sf, "documents").selectExpr("doc_id", "0 AS chunk_id", "lang")
    hits = table(spark, sf, "events").select("event_id", (F.col("event_id") % chunks.agg(F.max("doc_id") + 1).scalar()).alias("doc_id"), F.lit(0).alias("chunk_id"))
    return R.chunk_lookup(hits, chunks).drop("chunk_id")


@query("""WITH h AS (SELECT user_id AS query_id, event_id % 6 AS doc_id, event_id % 2 AS page, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS later, event_id AS rank FROM events), f AS (SELECT query_id, doc_id, page, min((later, rank)) AS o FROM h GROUP BY ALL)
SELECT query_id, doc_id, page, CAST(n AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id, page) AS n FROM f) WHERE n <= 4""")
def r11_pages_to_show(spark, sf):
    return R.pages_to_show(table(spark, sf, "events").selectExpr("user_id AS query_id", "event_id % 6 AS doc_id", "event_id % 2 AS page", "CASE WHEN event_id % 5 = 0 THEN 'image' ELSE 'text' END AS kind", "event_id AS rank"))


@query("""SELECT doc_id % 100 AS query_id, string_agg('<doc id=''' || doc_id || ''' source_display_name=''' || source || ''' page_number=''1''>' || chr(10) || text || chr(10) || '</doc>', chr(10) ORDER BY doc_id) AS context FROM documents GROUP BY 1""")
def r12_context_blocks(spark, sf):
    return R.context_blocks(table(spark, sf, "documents").selectExpr("doc_id % 100 AS query_id", "doc_id AS rank", "source", "1 AS page_number", "cast(null as string) AS title", "text"))


@query(r"""SELECT conv_id, arg_max(CASE WHEN role = 'assistant' THEN regexp_replace(regexp_replace(t, '^!\w+ ', ''), '\[(\d+)\]', '<[\1]>', 'g') ELSE regexp_replace(t, '^!\w+ ', '') END, turn) AS query, count(*) FILTER (role = 'user') > 1 AS needs_rewriting
FROM (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN '!go ' ELSE '' END || trim(text) || ' [3]' AS t FROM conversations) GROUP BY conv_id""")
def r13_conversation_query(spark, sf):
    return R.conversation_query(table(spark, sf, "conversations").selectExpr("conv_id", "turn", "role", "CASE WHEN turn % 2 = 0 THEN '!go ' ELSE '' END || trim(text) || ' [3]' AS text"))


@query("SELECT conv_id, turn, ['/attach x' || turn, '/model m'] AS commands, text FROM conversations WHERE NOT contains(text, chr(10)) AND NOT starts_with(text, '/')")
def r14_message_commands(spark, sf):
    c = table(spark, sf, "conversations").filter("not contains(text, '\n') and not startswith(text, '/')")
    commands, rest = R.message_commands(F.expr("'/attach x' || turn || '\n' || text || '\n/model m'"))
    return c.select("conv_id", "turn", commands.alias("commands"), rest.alias("text"))


@query("SELECT id, version FROM fx_versions WHERE active AND status = 'INDEXED'", "fx_versions")
def r15_searchable_docs(spark, sf):
    v = fixture(spark, sf, "fx_versions")
    return R.searchable_docs(v.select("id", "version"), v)
