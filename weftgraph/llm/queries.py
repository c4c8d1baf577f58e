"""Queries over the given tables, one for each operator of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import small_batches

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 4-word SimHash and its component over links of at most 4 bits."""
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by positive-unlabelled learning from labels outside the held-out quarter."""
    from .quality import fit_quality, score_quality

    docs, held = table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 4 = 2"
    model = fit_quality(docs, table(spark, sf_dir, "labels"), usable=f"not ({held})")
    return score_quality(docs, model).select("doc_id", F.expr(held).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by class-conditional Kneser-Ney models of labels outside the held-out fifth."""
    from .toxicity import fit_toxicity, score_toxicity

    docs, held = table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 5 = 0"
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), usable=f"not ({held})")
    return score_toxicity(docs, model).select("doc_id", F.expr(held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur more than once in the documents, and what of them occurs before."""
    from .suffixdedup import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "part", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


ORACLES["op5_suffix_array_dedup"] = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, q, list_slice(w, q + 1, q + 50) AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS q FROM docs WHERE len(w) >= 50)),
marked AS (SELECT doc_id, q, count(*) OVER (PARTITION BY g) AS times, row_number() OVER (PARTITION BY g ORDER BY doc_id, q) AS nth FROM grams),
parts AS (SELECT 'repeated' AS part, doc_id, q FROM marked WHERE times > 1 UNION ALL SELECT 'later', doc_id, q FROM marked WHERE nth > 1),
gaps AS (SELECT *, CASE WHEN q - lag(q) OVER (PARTITION BY part, doc_id ORDER BY q) <= 50 THEN 0 ELSE 1 END AS new FROM parts),
islands AS (SELECT *, sum(new) OVER (PARTITION BY part, doc_id ORDER BY q ROWS UNBOUNDED PRECEDING) AS island FROM gaps)
SELECT doc_id, part, min(q) AS start_word, max(q) + 50 AS end_word, max(q) + 50 - min(q) AS n_words FROM islands GROUP BY part, doc_id, island
"""


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens of lexically like documents."""
    import public_tokenizers

    from .packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by a separator scan of the flat token stream of all documents."""
    import public_tokenizers

    from .separators import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=49407)


#: The url rules of the query.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    from .urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op3_url_filters"] = r"""
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM cut),
urls AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT u.page_id, u.host, u.path, r.rule, r.verdict FROM urls u LEFT JOIN rules r
         ON (u.host = split_part(r.rule, '/', 1) OR ends_with(u.host, '.' || split_part(r.rule, '/', 1)))
         AND starts_with(u.path, substr(r.rule, instr(r.rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""


@query
def op4_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for every document whose id is divisible by 100."""
    from .search import bm25_topk

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25_topk(docs, docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), k=10)


ORACLES["op4_exact_topk_search"] = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
size AS (SELECT count(*) AS n, (SELECT sum(dl) FROM len) / count(*) AS mean FROM documents),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, size GROUP BY term, n),
score AS (SELECT q.doc_id AS query_id, d.doc_id,
          sum(CAST(round(1e6 * (idf * (d.tf * (1.2 + 1) / (d.tf + CAST(1.2 AS DOUBLE) * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / mean))))) AS BIGINT)) AS score
          FROM tf q JOIN tf d USING (term) JOIN idf USING (term) JOIN len ON len.doc_id = d.doc_id, size WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS DOUBLE) / 1e6 AS score
FROM score WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether decoding them gives its text back."""
    import public_tokenizers

    from .pieces import decode_pieces, encode_pieces, piece_model

    path = public_tokenizers.path("piece_bpe_32k.model")
    width = piece_model(path).dtype.itemsize
    found = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), path), path)
    return found.select("doc_id", (F.octet_length("ids") / width).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query
def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as FLAC in the shared folder, read back and described."""
    from ..plans.storage import materialize
    from .flac import read_media, store_media

    found = read_media(materialize(store_media(table(spark, sf_dir, "documents")), "media"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hard negatives of each of the five positives of every vector whose id is divisible by 100."""
    from .hardneg import mine_negatives

    moved = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label")
    return mine_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved))


ORACLES["op11_hard_negatives"] = r"""
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
       list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
       WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
       FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
       QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and its component over links of 0.8 or more of its 2-word shingles."""
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similar=0.8)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, some of them with a tail that repeats, and the text without the repeats."""
    from .runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), planted=True).drop("runs")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's sequences, each piece by digest columns."""
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf_dir)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
