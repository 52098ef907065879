"""Descriptive statistics over the message table; one shuffle by conversation and label each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from . import sessions
from .messages import EMOJI, IMAGE, TEXT

#: The hours of a late night.
LATE = (23, 0, 1, 2, 3, 4)


def by_sender() -> list[Column]:
    return [F.count("*").alias("total"), F.count_if(F.col("sender") == "me").alias("me"), F.count_if(F.col("sender") == "other").alias("other")]


def totals(m: DataFrame) -> DataFrame:
    label = times.date_label(F.col("time"), F.col("time_str"))
    return m.groupBy("conv_id").agg(
        *by_sender(), F.count_distinct(label).alias("active_days"), F.count_if(F.hour("time").isin(*LATE)).alias("late_night"),
        F.count_if(F.col("type") == EMOJI).alias("emoji"), F.count_if(F.col("type") == IMAGE).alias("images"), F.count_if(F.col("time").isNull()).alias("invalid_times"),
    )


def daily(m: DataFrame) -> DataFrame:
    return m.groupBy("conv_id", times.date_label(F.col("time"), F.col("time_str")).alias("day")).agg(*by_sender())


def monthly(m: DataFrame) -> DataFrame:
    return m.groupBy("conv_id", times.month_label(F.col("time"), F.col("time_str")).alias("month")).agg(*by_sender())


def _filled(m: DataFrame, bin_: Column, n: int, name: str) -> DataFrame:
    """Counts of n bins, zero where nothing fell; a conversation has all bins."""
    counts = m.where("time is not null").groupBy("conv_id", bin_.alias(name)).agg(F.count("*").alias("n"))
    bins = m.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    return bins.join(counts, ["conv_id", name], "left").select("conv_id", name, F.coalesce("n", F.lit(0)).alias("n"))


def hourly(m: DataFrame) -> DataFrame:
    return _filled(m, F.hour("time"), 24, "hour")


def weekdays(m: DataFrame) -> DataFrame:
    """Monday is 0."""
    return _filled(m, F.weekday("time"), 7, "weekday")


def daily_first_last(m: DataFrame) -> DataFrame:
    """How often each sender wrote first, and last, on a day."""
    days = m.groupBy("conv_id", times.date_label(F.col("time"), F.col("time_str")).alias("day")).agg(F.min_by("sender", "position").alias("first"), F.max_by("sender", "position").alias("last"))
    return days.groupBy("conv_id").agg(*[F.count_if(F.col(end) == who).alias(f"{end}_{who}") for end in ("first", "last") for who in ("me", "other")])


def top_days(m: DataFrame, k: int = 10) -> DataFrame:
    days = m.groupBy("conv_id", times.date_label(F.col("time"), F.col("time_str")).alias("day")).agg(F.count("*").alias("total"), F.min("position").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "_first"))
    return days.withColumn("rank", rank).where(F.col("rank") <= k).select("conv_id", "rank", "day", "total")


def top_sessions(summary: DataFrame, k: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("message_count"), "session"))
    return summary.withColumn("rank", rank).where(F.col("rank") <= k).select("conv_id", "rank", "session", "message_count")


def _running(value: str, *by: str) -> Column:
    """The sum so far, session by session: fractions are added in that order, since a sum's last bits depend on it."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _mean(value: str) -> Column:
    return F.max_by("_held", "session") / F.nullif(F.count(value), F.lit(0))


def session_shape(summary: DataFrame) -> DataFrame:
    return summary.withColumn("_held", _running("duration_minutes", "conv_id")).groupBy("conv_id").agg(
        F.count("*").alias("n_sessions"), times.round1(F.avg("message_count")).alias("avg_size"), times.round1(F.median("message_count")).alias("median_size"),
        times.round1(_mean("duration_minutes")).alias("avg_minutes"), times.round1(F.median("duration_minutes")).alias("median_minutes"),
        F.count_if(F.col("initiator") == "me").alias("initiated_by_me"), F.count_if(F.col("closer") == "me").alias("closed_by_me"),
    )


def reply_latency(m: DataFrame) -> DataFrame:
    """Per replier over all consecutive rows: count, mean, median of replies strictly inside the window."""
    lo, hi = sessions.REPLY
    d = sessions.reply_deltas(m).where((F.col("delta") > lo) & (F.col("delta") < hi))
    return d.groupBy("conv_id", "sender").agg(F.count("*").alias("n"), times.round1(F.avg("delta")).alias("avg_seconds"), times.round1(F.median("delta")).alias("median_seconds"))


def session_reply_latency(m: DataFrame) -> DataFrame:
    """The mean over sessions of a replier's mean reply there, which is rounded before."""
    lo, hi = sessions.SESSION_REPLY
    d = sessions.reply_deltas(sessions.gap_sessions(m), "session").where((F.col("delta") > lo) & (F.col("delta") < hi))
    each = d.groupBy("conv_id", "session", "sender").agg(times.round1(F.avg("delta")).alias("a"))
    each = each.withColumn("_held", _running("a", "conv_id", "sender"))
    return each.groupBy("conv_id", "sender").agg(F.count("*").alias("n_sessions"), times.round1(_mean("a")).alias("avg_seconds"))


def text_length(m: DataFrame) -> DataFrame:
    """Mean characters of text messages by sender; 0.0 for a sender without any."""
    n = lambda who: times.round1(F.coalesce(F.avg(F.when((F.col("sender") == who) & (F.col("type") == TEXT), F.char_length("content"))), F.lit(0.0)))
    return m.groupBy("conv_id").agg(n("me").alias("me_chars"), n("other").alias("other_chars"))


def uniform_sample(m: DataFrame, least: int = 150, most: int = 260, per: int = 120) -> DataFrame:
    """Rows int(i * len / n) for i below n = clamp(len // per, least, most), or all rows if there are no more."""
    w = Window.partitionBy("conv_id")
    rows = m.withColumn("len", F.count("*").over(w)).withColumn("k", F.greatest(F.lit(least), F.least(F.lit(most), F.expr(f"len div {per}"))))
    # Row r (from 0) is taken if some i has floor(i * len / k) = r.
    r = F.col("position") - 1
    i = F.expr("((position - 1) * k + len - 1) div len")
    return rows.where((F.col("len") <= F.col("k")) | ((i < F.col("k")) & (F.expr("(((position - 1) * k + len - 1) div len) * len div k") == r))).drop("len", "k")


def representative_segments(summary: DataFrame, n: int = 15, longest: int = 5) -> DataFrame:
    """The longest sessions and an even stride through the others, in order."""
    w = Window.partitionBy("conv_id")
    rows = summary.withColumn("by_size", F.row_number().over(w.orderBy(F.desc("message_count"), "session"))).withColumn("of", F.count("*").over(w))
    rest = rows.where(F.col("by_size") > longest).withColumn("k", F.row_number().over(w.orderBy("session")) - 1)
    step = F.greatest(F.lit(1), F.expr(f"(of - {longest}) div {n - longest}"))
    rest = rest.where(F.col("k") % step == 0).drop("k")
    both = rows.where(F.col("by_size") <= longest).union(rest)
    return both.withColumn("rank", F.row_number().over(w.orderBy("session"))).where(F.col("rank") <= n).select("conv_id", "rank", "session", "message_count")
