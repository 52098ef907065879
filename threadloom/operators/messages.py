"""From raw export rows to the message table: filters, projections, order and diagnostics.

Raw rows: ``conv_id, original_index, type, content, is_send, time_str, create_time``. Message rows add ``sender, time,
epoch, position``. Everything is partitioned by conv_id, so one hash partitioning serves the operators that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times

#: Message types.
SYSTEM, TEXT, QUOTE, IMAGE, EMOJI = "系统消息", "文本消息", "引用消息", "图片消息", "动画表情"


def kept() -> Column:
    """System messages go; images and emoji stay whatever their content; the rest stays if it has content."""
    return ~(F.coalesce(F.col("type"), F.lit("")) == SYSTEM) & (F.col("type").isin(IMAGE, EMOJI) | (F.coalesce(F.col("content"), F.lit("")) != ""))


def skip_reason() -> Column:
    return F.when(F.col("type") == SYSTEM, "system_message").when(F.coalesce(F.col("content"), F.lit("")) == "", "empty_content").otherwise("unsupported")


def parse(raw: DataFrame) -> DataFrame:
    content = F.when(F.col("type").isin(IMAGE, EMOJI) & (F.coalesce(F.col("content"), F.lit("")) == ""), F.concat(F.lit("["), "type", F.lit("]"))).otherwise(F.col("content"))
    sender = F.when(F.col("is_send") == 1, "me").otherwise("other")
    return raw.where(kept()).select(
        "conv_id", "original_index", "type", content.alias("content"), sender.alias("sender"), "time_str",
        times.parse_time(F.col("time_str")).alias("time"), times.parse_epoch(F.col("create_time")).alias("epoch"),
    )


def positioned(messages: DataFrame) -> DataFrame:
    """``position`` from 1: rows with an epoch by it, then rows with a local time by that, then the rest as they came."""
    tier = F.when(F.col("epoch").isNotNull(), 0).when(F.col("time").isNotNull(), 1).otherwise(2)
    key = F.coalesce(F.col("epoch"), times.seconds(F.col("time")).cast("double"), F.col("original_index").cast("double"))
    order = Window.partitionBy("conv_id").orderBy(tier, key, "original_index")
    return messages.withColumn("position", F.row_number().over(order))


def diagnostics(raw: DataFrame) -> DataFrame:
    """One row per conversation: counts, invalid times, whether sorting changed the order, and histograms as maps."""
    rows = positioned(parse(raw))
    came = F.row_number().over(Window.partitionBy("conv_id").orderBy("original_index"))
    parsed = rows.withColumn("came", came).groupBy("conv_id").agg(
        F.count("*").alias("parsed"), F.count_if(F.col("time").isNull()).alias("invalid_times"), F.count_if(F.col("epoch").isNull()).alias("invalid_timestamps"),
        F.bool_or(F.col("came") != F.col("position")).alias("sort_changed"),
    )
    counts = raw.groupBy("conv_id").agg(F.count("*").alias("raw"), F.count_if(~kept()).alias("skipped"))
    kind = F.when(F.coalesce(F.col("type"), F.lit("")) == "", "unknown").otherwise(F.col("type"))
    types = histogram(raw.withColumn("kind", kind), "kind", "message_types")
    reasons = histogram(raw.where(~kept()).withColumn("reason", skip_reason()), "reason", "skip_reasons")
    out = counts.join(parsed, "conv_id", "left").join(types, "conv_id", "left").join(reasons, "conv_id", "left")
    return out.fillna(0, ["parsed", "invalid_times", "invalid_timestamps"]).fillna(False, ["sort_changed"])


def histogram(rows: DataFrame, key: str, name: str) -> DataFrame:
    """A map of counts per conversation."""
    each = rows.groupBy("conv_id", key).agg(F.count("*").alias("n"))
    return each.groupBy("conv_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))


def line(other: str = "对方") -> Column:
    """One transcript line; line breaks in the content become a literal backslash n."""
    text = F.replace(F.replace(F.coalesce("content", F.lit("")), F.lit("\r\n"), F.lit("\\n")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.col("time_str"), F.lit(" "), F.when(F.col("sender") == "me", "【我】").otherwise(f"【{other}】"), F.lit(" "), text)


def compact_transcript(messages: DataFrame, chunk: str = "chunk_index", other: str = "对方") -> DataFrame:
    """``transcript`` per (conv_id, chunk): a date line where the date changes, short numbers, times without dates."""
    w = Window.partitionBy("conv_id", chunk).orderBy("position")
    full = F.col("time_str").rlike(r"^(?s).{4}-.{2}-.{2} .{8}$")
    text = F.replace(F.replace(F.coalesce("content", F.lit("")), F.lit("\r\n"), F.lit("\\n")), F.lit("\n"), F.lit("\\n"))
    who = F.when(F.col("sender") == "me", "【我】").otherwise(f"【{other}】")
    rows = messages.withColumn("n", F.row_number().over(w)).withColumn("date", F.when(full, F.substring("time_str", 1, 10)))
    before = F.last("date", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    head = F.when(F.col("date").isNotNull() & (before.isNull() | (before != F.col("date"))), F.concat(F.lit("=== "), "date", F.lit(" ===\n"))).otherwise("")
    shown = F.when(full, F.expr("substring(time_str, 12)")).otherwise(F.coalesce("time_str", F.lit("")))
    rows = rows.withColumn("line", F.concat(head, F.lit("[m"), "n", F.lit("] "), shown, F.lit(" "), who, F.lit(" "), text))
    return rows.groupBy("conv_id", chunk).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("transcript"))


def expand_transcript(chunks: DataFrame, chunk: str = "chunk_index") -> DataFrame:
    """The inverse: ``conv_id, chunk, n, line`` with dates put back."""
    rows = chunks.select("conv_id", chunk, F.posexplode(F.split("transcript", "\n")).alias("at", "line"))
    date = F.when(F.col("line").rlike("^=== .{10} ===$"), F.substring("line", 5, 10))
    w = Window.partitionBy("conv_id", chunk).orderBy("at")
    rows = rows.withColumn("date", date).withColumn("of", F.last("date", True).over(w)).where("date is null")
    timed = F.regexp_extract("line", r"^\[m\d+\] (\d{2}:\d{2}:\d{2} [\s\S]*)$", 1)
    rest = F.regexp_extract("line", r"^\[m\d+\] ([\s\S]*)$", 1)
    full = F.when((timed != "") & F.col("of").isNotNull(), F.concat("of", F.lit(" "), timed)).otherwise(rest)
    return rows.select("conv_id", chunk, F.row_number().over(w).alias("n"), full.alias("line"))
