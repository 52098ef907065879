"""Request telemetry: normalised counts (unknown is null, not zero) and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ("prompt_tokens", "completion_tokens", "total_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens", "reasoning_tokens")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(f"{c} STRING" for c in COUNTS)
    return spark.read.schema(f"session_id STRING, request_id STRING, time STRING, model STRING, stage STRING, operation_id STRING, attempt INT, duration_ms BIGINT, max_tokens INT, error_type STRING, finish_reason STRING, usage STRUCT<{fields}>").json(path)


def count(c: Column) -> Column:
    """A count that was logged as a whole number; anything else is unknown."""
    return F.when(c.cast("string").rlike(r"^\d+$"), c.cast("string").try_cast("bigint"))


def normalised(log: DataFrame) -> DataFrame:
    """Valid counts; a missing cache miss follows from the prompt and the hits, and contradictory ones become unknown."""
    rows = log
    for c in COUNTS:
        rows = rows.withColumn(c, count(F.col(f"usage.{c}")))
    p, h, m = (F.col(c) for c in ("prompt_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens"))
    bad = (h > p) | (m > p) | (h + m != p)
    miss = F.when(F.coalesce(bad, F.lit(False)), None).otherwise(F.coalesce(m, p - h))
    return rows.withColumn("prompt_cache_miss_tokens", miss).withColumn("prompt_cache_hit_tokens", F.when(F.coalesce(bad, F.lit(False)), None).otherwise(h))


def measures() -> list[Column]:
    hit, miss = F.col("prompt_cache_hit_tokens"), F.col("prompt_cache_miss_tokens")
    both = hit.isNotNull() & miss.isNotNull()
    rate = F.sum(F.when(both, hit)) / F.nullif(F.sum(F.when(both, hit + miss)), F.lit(0))
    return [F.count("*").alias("requests"), F.count("total_tokens").alias("known"), *[F.sum(c).alias(c) for c in COUNTS], F.round(rate, 4).alias("cache_hit_rate")]


def rollup(rows: DataFrame) -> DataFrame:
    """In one pass: the total, by stage and by model (grouping sets)."""
    return rows.groupingSets([[], [F.col("stage")], [F.col("model")]], F.col("stage"), F.col("model")).agg(F.grouping("stage").alias("g_stage"), F.grouping("model").alias("g_model"), *measures())


def latest_session(rows: DataFrame) -> DataFrame:
    last = rows.agg(F.max_by("session_id", "time").alias("session_id"))
    return rows.join(last, "session_id").groupBy("session_id").agg(*measures())
