"""Queries of usage, cost and cache."""

from pyspark.sql import functions as F

from ..functions.text import progress
from ..operators import usage as U
from .base import fixture, query, table

_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@query("SELECT deployment, model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM fx_usage GROUP BY ALL", "fx_usage")
def u1_usage_by_model(spark, sf):
    return U.usage_by_model(fixture(spark, sf, "fx_usage"))


@query("""WITH m AS (SELECT model, row_number() OVER (ORDER BY model) AS i FROM (SELECT DISTINCT model FROM fx_usage)), p AS (SELECT model, i * 0.25::DOUBLE AS p, i * 0.5::DOUBLE AS c FROM m WHERE i <> 2)
SELECT deployment, u.model, round(sum((prompt_tokens * p + completion_tokens * c) / 1000000), 4) AS cost FROM fx_usage u LEFT JOIN p ON p.model = u.model GROUP BY ALL""", "fx_usage")
def u2_usage_cost(spark, sf):
    u = fixture(spark, sf, "fx_usage")
    m = spark.createDataFrame([(r["model"], i) for i, r in enumerate(u.select("model").distinct().orderBy("model").collect(), 1) if i != 2], "model string, i int")
    priced = U.usage_cost(u, m.select("model", (F.col("i") * 0.25).alias("prompt"), (F.col("i") * 0.5).alias("completion")), per_million=True)
    return priced.groupBy("deployment", "model").agg(F.round(F.sum("cost"), 4).alias("cost"))


@query("""WITH r AS (SELECT user_id, event_id AS request_id, event_id % 9 * 10 AS total, user_id % 4 * 50 AS used FROM events), s AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY user_id ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reserved FROM r)
SELECT request_id, CAST(total AS BIGINT) AS total, CAST(reserved AS BIGINT) AS reserved, total + reserved > 400 - used AS refused, round(total / 30.0, 6)::DOUBLE AS minutes, round(greatest(1.5 * 60 * total / 30.0, 300), 6)::DOUBLE AS limit_seconds FROM s""")
def u3_token_budget(spark, sf):
    r = table(spark, sf, "events").selectExpr("user_id", "event_id AS request_id", "event_id % 9 AS estimate", "10 AS items", "user_id % 4 * 50 AS used")
    b = U.token_budget(r, F.lit(400), F.lit(30.0))
    return b.select("request_id", "total", "reserved", "refused", F.round("minutes", 6).alias("minutes"), F.round("limit_seconds", 6).alias("limit_seconds"))


@query("SELECT prompt, llm, idx, r.response AS response, CAST(r.t AS VARCHAR) AS at FROM (SELECT prompt, llm, idx, max({'t': last_accessed_at, 'response': response}) AS r FROM fx_cache GROUP BY ALL)", "fx_cache")
def u4_cache_upsert(spark, sf):
    c = fixture(spark, sf, "fx_cache")
    up = U.cache_upsert(c.filter("event_id % 2 = 0").drop("event_id"), c.filter("event_id % 2 = 1").drop("event_id"))
    return up.select("prompt", "llm", "idx", "response", F.col("last_accessed_at").cast("string").alias("at"))


@query("SELECT event_id FROM fx_cache WHERE last_accessed_at >= (SELECT max(last_accessed_at) FROM fx_cache) - INTERVAL 5 DAY AND contains(prompt, 'p1')", "fx_cache")
def u5_cache_retention(spark, sf):
    c = fixture(spark, sf, "fx_cache")
    last = F.lit(c.agg(F.max("last_accessed_at")).first()[0])
    return U.cache_search(U.cache_retention(c, last, 5), "p1").select("event_id")


@query("SELECT event_id, CAST(greatest(5, 5 * round_even(100.0 * (event_id % 201) / 200 / 5, 0)) AS INTEGER) AS percent FROM events")
def u6_progress(spark, sf):
    return table(spark, sf, "events").select("event_id", progress(F.col("event_id") % 201, F.lit(200)).alias("percent"))


@query("SELECT event_id FROM events WHERE event_id % 120 > 60")
def u7_ttl_filter(spark, sf):
    return U.ttl_filter(table(spark, sf, "events").selectExpr("event_id", "event_id % 120 AS expired"), F.lit(60)).select("event_id")
