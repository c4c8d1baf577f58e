"""Registration of queries, and the fixtures that both engines derive from the given tables with the same SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Written for both dialects: {name} is a given table, VARCHAR is STRING in Spark.
FIXTURES = {
    "fx_concepts": """SELECT vec_id AS id, vec_id % 5 AS map_id,
        'n' || (vec_id % 180) || CASE WHEN vec_id % 7 = 0 THEN '_' || (vec_id % 3 + 1) ELSE '' END AS name,
        'What is n' || (vec_id % 180) || '?' AS question, embedding,
        CASE WHEN vec_id = 0 THEN -1 ELSE label END AS cluster_id,
        CASE WHEN vec_id = 0 THEN -1 ELSE 1 + vec_id % 3 END AS level,
        CASE WHEN vec_id % 11 = 10 THEN 0 ELSE 1 END AS is_active FROM {embeddings}""",
    "fx_edges": """SELECT l_partkey % 5 AS map_id, CAST(l_partkey % 500 AS BIGINT) AS origin, CAST((l_orderkey * 7 + l_linenumber) % 500 AS BIGINT) AS target,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(floor(l_quantity) AS INT) % 5 + CAST(0.5 AS DOUBLE) END AS weight,
        CASE WHEN l_linestatus = 'O' THEN 'related' ELSE 'artificial' END AS type FROM {lineitem}""",
    "fx_links": """SELECT vec_id % 5 AS map_id, vec_id AS origin, CASE WHEN vec_id % 6 = 0 THEN vec_id - 30 ELSE vec_id + 5 * (1 + vec_id % 3) END AS target FROM {embeddings}""",
    "fx_cited": """SELECT doc_id AS id, doc_id % 7 AS map_id, substr(text, 1, 40) || ' ^[' || doc_id || '.1.1]^ . ^[' || doc_id || '.1.2]^ '
        || substr(text, 41, 40) || ' ^[' || (doc_id + 1) || '.3]^ ' || substr(text, 81) AS details FROM {documents}""",
    "fx_facts": """SELECT doc_id AS id, doc_id % 7 AS map_id, p.pos AS pos, 'fact ' || doc_id || ' ' || p.pos AS fact,
        CAST(doc_id % 97 + p.pos * (doc_id % 3) AS BIGINT) AS part_a, CAST(doc_id % 89 + 7 AS BIGINT) AS part_b
        FROM {documents} CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) p""",
    "fx_parts": """SELECT CAST(doc_id AS BIGINT) AS part_id, CAST(doc_id - doc_id % 10 AS VARCHAR) || '.1.' || (doc_id % 10) AS citation, CAST(doc_id - doc_id % 10 AS BIGINT) AS flat_chunk_id
        FROM {documents} WHERE doc_id % 13 <> 5""",
    "fx_versions": """SELECT CAST(doc_id - doc_id % 3 AS VARCHAR) AS id, CAST(doc_id % 3 + 1 AS INT) AS version, doc_id % 3 = 2 AS active,
        doc_id % 3 = 1 AS in_graph, CASE WHEN doc_id % 9 = 2 THEN 'REMOVED' WHEN doc_id % 9 = 8 AND doc_id % 2 = 0 THEN 'FAILED' ELSE 'INDEXED' END AS status FROM {documents}""",
    "fx_usage": """SELECT 'd' || (user_id % 3) AS deployment, event_type AS model,
        CAST(floor(value * 100) AS BIGINT) AS prompt_tokens, event_id % 500 AS completion_tokens FROM {events}""",
    "fx_cache": """SELECT 'p' || user_id AS prompt, event_type AS llm, CAST(event_id % 2 AS INT) AS idx, props AS response, ts AS last_accessed_at, event_id FROM {events}""",
    "fx_history": """SELECT user_id % 10 AS map_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS step,
        event_type AS type, CAST(user_id AS VARCHAR) AS id, CAST(event_id AS VARCHAR) AS new_value FROM {events}""",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame over the given tables."""
    text = FIXTURES[name].replace("VARCHAR", "STRING")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text})


def query(sql: str | None = None, uses: str = "") -> Callable:
    """Register a function (spark, sf_dir) under its name; ``sql`` may read the fixtures named in ``uses``."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            given = [f"{n} AS ({FIXTURES[n].format_map({t: t for t in _TABLES})})" for n in uses.split()]
            body = sql.strip()
            if given:
                recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
                body = body.replace("WITH RECURSIVE ", "WITH ", 1) if recursive else body
                body = f"WITH {recursive}" + ", ".join(given) + (", " + body[5:] if body.startswith("WITH ") else " " + body)
            ORACLES[f.__name__] = body
        return f

    return add
