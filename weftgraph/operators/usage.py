"""Token usage, budgets, and the table of cached answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usage_by_model(usage: DataFrame) -> DataFrame:
    """Sums of prompt, completion and all tokens by deployment and model."""
    rows = usage.groupBy("deployment", "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return rows.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def usage_cost(usage: DataFrame, pricing: DataFrame, per_million: bool = False) -> DataFrame:
    """``cost`` by ``pricing(model, prompt, completion)``, null without a price. Spark broadcasts the prices where they are small."""
    scale = 1e6 if per_million else 1.0
    rows = usage.join(pricing.select("model", F.col("prompt").alias("_p"), F.col("completion").alias("_c")), "model", "left")
    return rows.withColumn("cost", (F.col("prompt_tokens") * F.col("_p") + F.col("completion_tokens") * F.col("_c")) / scale).drop("_p", "_c")


def token_budget(requests: DataFrame, day_total: Column, per_minute: Column) -> DataFrame:
    """``requests(user_id, request_id, estimate, items, used)`` with total, reserved before it, refused, minutes and time limit.

    total = estimate * items; refused if total and what earlier requests of the user reserved are over what is left of the day;
    minutes = total / per-minute limit; limit = max(1.5 * seconds, 300).
    """
    by = W.partitionBy("user_id").orderBy("request_id").rowsBetween(W.unboundedPreceding, -1)
    rows = requests.withColumn("total", F.col("estimate") * F.col("items")).withColumn("reserved", F.coalesce(F.sum("total").over(by), F.lit(0)))
    rows = rows.withColumns({"refused": F.col("total") + F.col("reserved") > day_total - F.col("used"), "minutes": F.col("total") / per_minute})
    return rows.withColumn("limit_seconds", F.greatest(1.5 * 60 * F.col("minutes"), F.lit(300.0)))


def cache_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (prompt, llm, idx): the newest, of equally new ones the greatest response."""
    newest = F.max(F.struct("last_accessed_at", "response"))
    return old.unionByName(new).groupBy("prompt", "llm", "idx").agg(newest.alias("r")).select("prompt", "llm", "idx", "r.response", "r.last_accessed_at")


def cache_touch(cache: DataFrame, looked_up: DataFrame, now: Column) -> DataFrame:
    """Rows of ``looked_up(prompt, llm, idx)`` get the time of the lookup."""
    hit = looked_up.select("prompt", "llm", "idx", F.lit(True).alias("_hit")).distinct()
    return cache.join(hit, ["prompt", "llm", "idx"], "left").withColumn("last_accessed_at", F.when(F.col("_hit"), now).otherwise(F.col("last_accessed_at"))).drop("_hit")


def cache_retention(cache: DataFrame, now: Column, days: int, drop_newer: bool = False) -> DataFrame:
    """Rows within the last ``days`` days, or with ``drop_newer`` those before."""
    edge = now - F.make_interval(days=F.lit(days))
    return cache.filter(F.col("last_accessed_at") < edge if drop_newer else F.col("last_accessed_at") >= edge)


def cache_search(cache: DataFrame, text: str) -> DataFrame:
    return cache.filter(F.col("prompt").contains(text))


def cache_recent(cache: DataFrame, n: int) -> DataFrame:
    """The n most recent rows with the first 80 characters of prompt and response."""
    rows = cache.orderBy(F.desc("last_accessed_at"), "prompt", "llm", "idx").limit(n)
    return rows.select("llm", "idx", F.substring("prompt", 1, 80).alias("prompt"), F.substring("response", 1, 80).alias("response"))


def ttl_filter(rows: DataFrame, now: Column, expires: str = "expired") -> DataFrame:
    """Rows that have not expired."""
    return rows.filter(F.col(expires) > now)
