"""The driver's tables as conversations: which table plays which part of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..operators import messages as ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed messages: a conversation per user, times to the second, clicks and views are 'me'."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    t = F.date_trunc("second", "ts").cast("timestamp_ntz")
    rows = e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("original_index"), F.when(F.col("event_type").isin("click", "view"), "me").otherwise("other").alias("sender"), F.col("event_type").alias("type"), F.col("event_type").alias("content"), t.alias("time"), F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("time_str"), F.col("value"))
    order = Window.partitionBy("conv_id").orderBy("time", "original_index")
    return rows.withColumn("epoch", F.lit(None).cast("double")).withColumn("position", F.row_number().over(order))


def raw_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untimed raw rows: user is 'me', system rows are system messages."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", ms.SYSTEM).otherwise(ms.TEXT)
    return c.select("conv_id", F.col("turn").cast("int").alias("original_index"), kind.alias("type"), F.col("text").alias("content"), (F.col("role") == "user").cast("int").alias("is_send"), F.lit(None).cast("string").alias("time_str"), F.lit(None).cast("string").alias("create_time"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.positioned(ms.parse(raw_conversations(spark, sf_dir)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts: a conversation per source, positions by doc_id."""
    d = table(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy("doc_id")
    return d.select(F.col("source").alias("conv_id"), F.row_number().over(order).alias("position"), "doc_id", F.col("text").alias("content"), F.octet_length("text").alias("bytes"))
