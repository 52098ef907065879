"""Reports over one conversation as text: lines are rows, and only the last step joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sessions, statistics
from .messages import EMOJI, IMAGE

#: Characters shown of a message in a segment and in a sample, messages of a preview's segment, bars' scale.
SHOWN, SAMPLE, PREVIEW, BAR, BARS = 100, 150, 18, 10, 50


def joined(lines: DataFrame, *by: str) -> DataFrame:
    """``report``: the lines (by, at, line) of each group in order."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return lines.groupBy(*by).agg(F.array_join(each, "\n").alias("report"))


def type_ranking(raw: DataFrame) -> DataFrame:
    """``conv_id, rank, type, n``: most frequent types first, ties by which came first; an empty type is ``unknown``."""
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("unknown"))
    each = raw.groupBy("conv_id", kind.alias("type")).agg(F.count("*").alias("n"), F.min("original_index").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "_first"))
    return each.select("conv_id", rank.alias("rank"), "type", "n")


def who(mine: str = "我", other: str = "对方") -> Column:
    return F.when(F.col("sender") == "me", f"【{mine}】").otherwise(f"【{other}】")


def full_transcript(messages: DataFrame, mine: str = "我", other: str = "对方") -> DataFrame:
    """``conv_id, report``: a head and all messages, unabridged."""
    head = ["=" * 60, "聊天记录全量解析文本", "=" * 60, f"- 对方昵称/备注: {other}", f"- 我的昵称: {mine}"]
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    top = counts.select("conv_id", F.lit(0).alias("at"), F.concat(F.lit("\n".join([*head, "- 有效消息数: "])), F.col("n").cast("string"), F.lit("\n\n## 全量消息")).alias("line"))
    rows = messages.select("conv_id", F.col("position").alias("at"), F.concat_ws(" ", "time_str", who(mine, other), F.coalesce("content", F.lit(""))).alias("line"))
    return joined(top.union(rows), "conv_id")


def diagnostics_text(diagnostics: DataFrame, ranking: DataFrame) -> DataFrame:
    """``conv_id, report`` of messages.diagnostics and :func:`type_ranking`: counts, reasons by name, types by rank."""
    n = lambda label, c: F.concat(F.lit(f"- {label}: "), c.cast("string"))
    head = F.concat_ws("\n", F.lit("## 解析诊断"), n("原始消息数", F.col("raw")), n("有效解析消息数", F.col("parsed")), n("跳过消息数", F.col("skipped")), n("是否重新排序", F.initcap(F.col("sort_changed").cast("string"))), n("时间格式异常消息", F.col("invalid_times")), n("时间戳异常消息", F.col("invalid_timestamps")), F.lit("\n### 跳过原因"))
    reasons = F.transform(F.array_sort(F.map_entries(F.coalesce("skip_reasons", F.create_map().cast("map<string,bigint>")))), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string")))
    types = ranking.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "type", F.lit(": "), F.col("n").cast("string")).alias("line")))), lambda x: x["line"]), "\n").alias("types"))
    both = diagnostics.join(types, "conv_id", "left")
    none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "- 无").otherwise(c)
    return both.select("conv_id", F.concat_ws("\n", head, none(F.array_join(reasons, "\n")), F.lit("\n### 原始消息类型"), none(F.col("types"))).alias("report"))


def percent(part: Column, whole: Column) -> Column:
    return F.concat(F.call_function("format_number", F.lit(100.0) * part / whole, F.lit("0.0")), F.lit("%"))


def bars(hourly: DataFrame) -> DataFrame:
    """``conv_id, hour, line``: a bar for each hour with messages."""
    line = F.concat(F.format_string("  %02d:00  %5d ", "hour", "n"), F.repeat(F.lit("█"), F.least(F.lit(BARS), F.expr(f"cast(n div {BAR} AS int)"))))
    return hourly.where("n > 0").select("conv_id", "hour", line.alias("line"))


def statistics_report(m: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """``conv_id, report``: everything that the statistics say about a conversation, as text, section after section.

    ``samples``: rows of the conversation that are shown at the end, see statistics.uniform_sample. Figures that do not exist
    (no reply, say) are ``-``.
    """
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    summary = sessions.session_summary(m)
    t = statistics.totals(m).join(m.groupBy("conv_id").agg(F.min("time_str").alias("first"), F.max("time_str").alias("last")), "conv_id")
    pictures = m.groupBy("conv_id").agg(*[F.count_if((F.col("sender") == who) & F.col("type").isin(EMOJI, IMAGE)).alias(f"{who}_pictures") for who in ("me", "other")])
    sides = lambda df, *cols: df.groupBy("conv_id").agg(*[F.max(F.when(F.col("sender") == who, F.col(c))).alias(f"{who}_{c}") for c in cols for who in ("me", "other")])
    turns = sessions.speaker_turns(m).groupBy("conv_id").agg(F.count("*").alias("n_turns"), *[F.count_if(F.col("sender") == who).alias(f"{who}_turns") for who in ("me", "other")])
    inner = sides(statistics.session_reply_latency(m).withColumnRenamed("avg_seconds", "inner"), "inner")
    shape = summary.groupBy("conv_id").agg(F.count_if(F.col("initiator") == "other").alias("initiated_by_other"), F.count_if(F.col("closer") == "other").alias("closed_by_other")).join(statistics.session_shape(summary), "conv_id")
    for other in (pictures, statistics.daily_first_last(m), statistics.text_length(m), sides(statistics.reply_latency(m), "n", "avg_seconds", "median_seconds"), turns, inner, shape):
        t = t.join(other, "conv_id", "left")
    both = lambda label, a, b, unit: line(f"- {label}: 我=", count(a), f"{unit}, 对方=", count(b), unit)
    blocks = [
        [
            line("## 基本信息"), line("- 聊天时间跨度: ", s("first"), " ~ ", s("last")), line("- 活跃天数: ", s("active_days"), " 天"), line("- 总消息数: ", s("total")),
            *[line(f"- {name}发送: ", s(c), " 条 (", percent(F.col(c), F.col("total")), ")") for name, c in (("我", "me"), ("对方", "other"))],
            line("- 每日平均消息数: ", F.call_function("format_number", F.col("total") / F.greatest("active_days", F.lit(1)), F.lit("0.0")), " 条"), line("- 时间格式异常消息: ", s("invalid_times"), " 条"),
        ],
        [line("\n## 主动性指标"), both("每日首条消息发起者", "first_me", "first_other", "天"), both("每日末条消息发送者", "last_me", "last_other", "天")],
        [
            line("\n## 消息特征"), line("- 我的平均文本消息长度: ", s("me_chars"), " 字"), line("- 对方的平均文本消息长度: ", s("other_chars"), " 字"),
            line("- 我的表情/图片消息数: ", s("me_pictures")), line("- 对方的表情/图片消息数: ", s("other_pictures")), line("- 深夜消息数(23-5点): ", s("late_night")),
        ],
        [
            line("\n## 回复速度"), *[line(f"- {name}的平均回复间隔: ", s(f"{who}_avg_seconds"), "秒 (样本", count(f"{who}_n"), "次)") for name, who in (("我", "me"), ("对方", "other"))],
            *[line(f"- {name}的中位回复间隔: ", s(f"{who}_median_seconds"), "秒") for name, who in (("我", "me"), ("对方", "other"))],
        ],
        [
            line("\n## 对话轮次与会话"), line("- 总对话轮次: ", s("n_turns")), both("连续发言轮次发起统计", "me_turns", "other_turns", "次"), line("- 会话切分间隔: ", F.lit(str(sessions.GAP // 3600)), "小时"), line("- 总会话数: ", s("n_sessions")),
            both("会话发起者", "initiated_by_me", "initiated_by_other", "次"), both("会话收尾者", "closed_by_me", "closed_by_other", "次"), line("- 平均每会话消息数: ", s("avg_size"), " 条，中位 ", s("median_size"), " 条"),
            line("- 平均会话时长: ", s("avg_minutes"), " 分钟，中位 ", s("median_minutes"), " 分钟"), *[line(f"- 会话内{name}平均回复: ", s(f"{who}_inner"), "秒") for name, who in (("我的", "me"), ("对方", "other"))],
        ],
    ]
    key = lambda k, x="": F.struct(F.lit(k).alias("k"), (F.lit(x) if isinstance(x, str) else x).alias("x")).alias("at")
    lines = t.select("conv_id", key(0), F.concat_ws("\n", *[x for block in blocks for x in block]).alias("line"))
    titles = ["", "\n## 最活跃会话 TOP 10", "\n## 月度趋势", "\n## 最活跃日期 TOP 10", "\n## 每小时分布"]
    if samples is not None:
        titles.append("\n## 文本消息样本")
    for k, title in enumerate(titles):
        lines = lines.union(t.select("conv_id", key(2 * k), F.lit(title).alias("line"))) if title else lines
    place = lambda c: F.format_string("%020d", F.col(c).cast("long"))
    when = m.select("conv_id", "position", "time_str")
    top = statistics.top_sessions(summary).join(summary.drop("message_count"), ["conv_id", "session"])
    for name in ("first", "last"):
        top = top.join(when.withColumnsRenamed({"position": f"{name}_position", "time_str": f"{name}_time"}), ["conv_id", f"{name}_position"])
    say = F.create_map(F.lit("me"), F.lit("我"), F.lit("other"), F.lit("对方"))
    lines = lines.union(top.select("conv_id", key(3, place("rank")), line("  会话", s("session"), ": ", s("first_time"), " ~ ", s("last_time"), "，总", s("message_count"), "条，我", s("me_count"), "条，对方", s("other_count"), "条，发起=", say[F.col("initiator")], "，收尾=", say[F.col("closer")]).alias("line")))
    lines = lines.union(statistics.monthly(m).select("conv_id", key(5, F.col("month")), line("  ", s("month"), ": 总", s("total"), "条 (我", s("me"), ", 对方", s("other"), ")").alias("line")))
    days = statistics.top_days(m).drop("total").join(statistics.daily(m), ["conv_id", "day"])
    lines = lines.union(days.select("conv_id", key(7, place("rank")), line("  ", s("day"), ": 总", s("total"), "条 (我", s("me"), ", 对方", s("other"), ")").alias("line")))
    lines = lines.union(bars(statistics.hourly(m)).select("conv_id", key(9, place("hour")), "line"))
    if samples is not None:
        text = shown(F.coalesce("content", F.lit("")), SAMPLE)
        lines = lines.union(samples.select("conv_id", key(11, place("position")), F.concat_ws(" ", F.concat(F.lit("  "), "time_str"), who(), text).alias("line")))
    return joined(lines, "conv_id")


def shown(c: Column, most: int) -> Column:
    return F.when(F.char_length(c) < most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("...")))


def segment_lines(messages: DataFrame, summary: DataFrame, most: int = PREVIEW) -> DataFrame:
    """``conv_id, rank, report``: chosen sessions (conv_id, session, rank) cut to their first and last messages.

    ``messages`` hold their session; one of more than ``most`` messages shows the first half and the last.
    """
    rows = messages.join(summary.select("conv_id", "session", "rank"), ["conv_id", "session"])
    w = Window.partitionBy("conv_id", "session")
    rows = rows.withColumn("r", F.row_number().over(w.orderBy("position"))).withColumn("n", F.count("*").over(w))
    kept = rows.where((F.col("n") <= most) | (F.col("r") <= most // 2) | (F.col("r") > F.col("n") - (most - most // 2)))
    line = F.concat_ws(" ", F.substring("time_str", 12, 5), who(), shown(F.coalesce("content", F.lit("")), SHOWN))
    return joined(kept.select("conv_id", "rank", F.col("position").alias("at"), line.alias("line")), "conv_id", "rank")


def month_bars(monthly: DataFrame, last: int = 12) -> DataFrame:
    """``conv_id, month, me_width, other_width``: the last months, in per cent of the greatest of their totals."""
    w = Window.partitionBy("conv_id")
    rows = monthly.withColumn("r", F.row_number().over(w.orderBy(F.desc("month")))).where(F.col("r") <= last)
    most = F.greatest(F.lit(1), F.max("total").over(w))
    return rows.select("conv_id", "month", (F.col("me") * 100.0 / most).alias("me_width"), (F.col("other") * 100.0 / most).alias("other_width"))


def diagnostics_line(diagnostics: DataFrame) -> DataFrame:
    """``conv_id, line``: the counters that are not zero."""
    part = lambda label, c: F.when(F.col(c) > 0, F.concat(F.lit(f"{label} "), F.col(c).cast("string"), F.lit(" 条")))
    return diagnostics.select("conv_id", F.concat_ws(" · ", part("跳过", "skipped"), part("时间格式异常", "invalid_times"), part("时间戳异常", "invalid_timestamps")).alias("line"))
