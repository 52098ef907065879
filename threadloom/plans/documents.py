"""Queries over evidence documents, reports and claims, each with its DuckDB counterpart; see :mod:`.registry`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import claims, evidence, grounding, messages, reports, retrieval, scoring, selection, sessions, statistics, usage
from . import testdata as td
from .registry import _COV, _CTX, _CV, _EV, _GAP, _GOLD, _SENDERS, _TURNS, _anchored, _covered, _labelled, _rounded, query


@query("WITH k AS (SELECT conv_id, CASE WHEN role = 'system' THEN '系统消息' ELSE '文本消息' END AS type, turn FROM conversations), g AS (SELECT conv_id, type, count(*) AS n, min(turn) AS f FROM k GROUP BY ALL) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) AS rank, type, n FROM g")
def message_type_ranking(spark, sf_dir):
    return reports.type_ranking(td.raw_conversations(spark, sf_dir))


@query(_EV + " SELECT conv_id, md5(repeat('=', 60) || chr(10) || '聊天记录全量解析文本' || chr(10) || repeat('=', 60) || chr(10) || '- 对方昵称/备注: 对方' || chr(10) || '- 我的昵称: 我' || chr(10) || '- 有效消息数: ' || count(*) || chr(10) || chr(10) || '## 全量消息' || chr(10) || string_agg(strftime(t, '%Y-%m-%d %H:%M:%S') || CASE WHEN sender = 'me' THEN ' 【我】 ' ELSE ' 【对方】 ' END || event_type, chr(10) ORDER BY position)) AS report_md5 FROM m GROUP BY conv_id")
def full_transcripts(spark, sf_dir):
    return reports.full_transcript(td.events(spark, sf_dir)).select("conv_id", F.md5("report").alias("report_md5"))


@query(_CV + """, c AS (SELECT conv_id, count(*) AS raw, count(*) FILTER (WHERE reason IS NULL) AS parsed, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped FROM raw GROUP BY conv_id),
s AS (SELECT conv_id, string_agg('- ' || reason || ': ' || n, chr(10) ORDER BY reason) AS t FROM (SELECT conv_id, reason, count(*) AS n FROM raw WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY conv_id),
k AS (SELECT conv_id, string_agg('- ' || kind || ': ' || n, chr(10) ORDER BY n DESC, f) AS t FROM (SELECT conv_id, CASE WHEN role = 'system' THEN '系统消息' ELSE '文本消息' END AS kind, count(*) AS n, min(turn) AS f FROM raw GROUP BY ALL) GROUP BY conv_id)
SELECT c.conv_id, concat_ws(chr(10), '## 解析诊断', '- 原始消息数: ' || raw, '- 有效解析消息数: ' || parsed, '- 跳过消息数: ' || skipped, '- 是否重新排序: False', '- 时间格式异常消息: ' || parsed, '- 时间戳异常消息: ' || parsed, chr(10) || '### 跳过原因', coalesce(s.t, '- 无'), chr(10) || '### 原始消息类型', k.t) AS report FROM c LEFT JOIN s USING (conv_id) LEFT JOIN k USING (conv_id)""")
def diagnostics_reports(spark, sf_dir):
    raw = td.raw_conversations(spark, sf_dir)
    return reports.diagnostics_text(messages.diagnostics(raw), reports.type_ranking(raw))


_PCT = "printf('%.1f', 100.0 * {0} / total) || '%)'"
_NUM = "coalesce(CAST({0} AS VARCHAR), '-')"
_R1 = "CAST(printf('%.1f', CAST({0} AS DOUBLE)) AS DOUBLE)"
_SIDE = {"me": "我", "other": "对方"}


def _lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


_REPORT = _GAP + f""", mt AS (SELECT conv_id, position, coalesce(CASE WHEN lag(sender) OVER w <> sender THEN date_diff('second', lag(t) OVER w, t) END, -1) AS x, sender, CASE WHEN lag(sender) OVER w IS NULL OR lag(sender) OVER w <> sender THEN 1 ELSE 0 END AS f FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY position)),
rl AS (SELECT conv_id, {', '.join(f"count(*) FILTER (WHERE x > 5 AND x < 7200 AND sender = '{k}') AS {k}_n, {_R1.format(f"avg(x) FILTER (WHERE x > 5 AND x < 7200 AND sender = '{k}')")} AS {k}_a, {_R1.format(f"median(x) FILTER (WHERE x > 5 AND x < 7200 AND sender = '{k}')")} AS {k}_m, count(*) FILTER (WHERE f = 1 AND sender = '{k}') AS {k}_t" for k in _SIDE)}, sum(f) AS turns FROM mt GROUP BY conv_id),
ie AS (SELECT conv_id, session, sender, {_R1.format('avg(sd)')} AS a FROM d WHERE sd > 5 AND sd < 14400 GROUP BY ALL), ir AS (SELECT conv_id, {', '.join(f"{_R1.format(f"avg(a) FILTER (WHERE sender = '{k}')")} AS {k}_i" for k in _SIDE)} FROM ie GROUP BY conv_id),
fl AS (SELECT conv_id, {', '.join(f"count(*) FILTER (WHERE {c} = '{k}') AS {c}_{k}" for c in ('f', 'l') for k in _SIDE)} FROM (SELECT conv_id, CAST(t AS DATE) AS day, arg_min(sender, position) AS f, arg_max(sender, position) AS l FROM m GROUP BY ALL) GROUP BY conv_id),
sh AS (SELECT conv_id, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE {c} = '{k}') AS {c}_{k}" for c in ('initiator', 'closer') for k in _SIDE)}, {_R1.format('avg(message_count)')} AS ms, {_R1.format('median(message_count)')} AS md, {_R1.format('avg(duration_minutes)')} AS da, {_R1.format('median(duration_minutes)')} AS dm FROM ss GROUP BY conv_id),
t AS (SELECT conv_id, {_SENDERS}, count(DISTINCT CAST(t AS DATE)) AS days, count(*) FILTER (WHERE hour(t) IN (23, 0, 1, 2, 3, 4)) AS late, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS a, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS z FROM m GROUP BY conv_id),
tp AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY message_count DESC, session) AS r FROM ss), ts AS (SELECT tp.conv_id, string_agg('  会话' || session || ': ' || strftime(x.t, '%Y-%m-%d %H:%M:%S') || ' ~ ' || strftime(y.t, '%Y-%m-%d %H:%M:%S') || '，总' || message_count || '条，我' || me_count || '条，对方' || other_count || '条，发起=' || CASE initiator WHEN 'me' THEN '我' ELSE '对方' END || '，收尾=' || CASE closer WHEN 'me' THEN '我' ELSE '对方' END, chr(10) ORDER BY r) AS x
 FROM tp JOIN m x ON x.conv_id = tp.conv_id AND x.position = first_position JOIN m y ON y.conv_id = tp.conv_id AND y.position = last_position WHERE r <= 10 GROUP BY tp.conv_id),
mo AS (SELECT conv_id, string_agg('  ' || month || ': 总' || total || '条 (我' || me || ', 对方' || other || ')', chr(10) ORDER BY month) AS x FROM (SELECT conv_id, strftime(t, '%Y-%m') AS month, {_SENDERS} FROM m GROUP BY ALL) GROUP BY conv_id),
dy AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY total DESC, p) AS r FROM (SELECT conv_id, strftime(t, '%Y-%m-%d') AS day, min(position) AS p, {_SENDERS} FROM m GROUP BY ALL)), td AS (SELECT conv_id, string_agg('  ' || day || ': 总' || total || '条 (我' || me || ', 对方' || other || ')', chr(10) ORDER BY r) AS x FROM dy WHERE r <= 10 GROUP BY conv_id),
ho AS (SELECT conv_id, string_agg(printf('  %02d:00  %5d ', h, n) || repeat('█', CAST(least(50, n // 10) AS INTEGER)), chr(10) ORDER BY h) AS x FROM (SELECT conv_id, CAST(hour(t) AS INTEGER) AS h, CAST(count(*) AS INTEGER) AS n FROM m GROUP BY ALL) GROUP BY conv_id),
sa AS (SELECT conv_id, string_agg('  ' || strftime(t, '%Y-%m-%d %H:%M:%S') || CASE WHEN sender = 'me' THEN ' 【我】 ' ELSE ' 【对方】 ' END || event_type, chr(10) ORDER BY position) AS x FROM m WHERE position % 20 = 0 GROUP BY conv_id)
SELECT conv_id, {_lines(
    "'## 基本信息'", "'- 聊天时间跨度: ' || a || ' ~ ' || z", "'- 活跃天数: ' || days || ' 天'", "'- 总消息数: ' || total", f"'- 我发送: ' || me || ' 条 (' || {_PCT.format('me')}", f"'- 对方发送: ' || other || ' 条 (' || {_PCT.format('other')}",
    "'- 每日平均消息数: ' || printf('%.1f', total / greatest(days, 1)) || ' 条'", "'- 时间格式异常消息: 0 条'", "chr(10) || '## 主动性指标'", "'- 每日首条消息发起者: 我=' || f_me || '天, 对方=' || f_other || '天'", "'- 每日末条消息发送者: 我=' || l_me || '天, 对方=' || l_other || '天'",
    "chr(10) || '## 消息特征'", "'- 我的平均文本消息长度: 0.0 字'", "'- 对方的平均文本消息长度: 0.0 字'", "'- 我的表情/图片消息数: 0'", "'- 对方的表情/图片消息数: 0'", "'- 深夜消息数(23-5点): ' || late", "chr(10) || '## 回复速度'",
    *[f"'- {n}的平均回复间隔: ' || {_NUM.format(f'{k}_a')} || '秒 (样本' || {k}_n || '次)'" for k, n in _SIDE.items()], *[f"'- {n}的中位回复间隔: ' || {_NUM.format(f'{k}_m')} || '秒'" for k, n in _SIDE.items()],
    "chr(10) || '## 对话轮次与会话'", "'- 总对话轮次: ' || turns", "'- 连续发言轮次发起统计: 我=' || me_t || '次, 对方=' || other_t || '次'", "'- 会话切分间隔: 4小时'", "'- 总会话数: ' || sh.n", "'- 会话发起者: 我=' || initiator_me || '次, 对方=' || initiator_other || '次'",
    "'- 会话收尾者: 我=' || closer_me || '次, 对方=' || closer_other || '次'", "'- 平均每会话消息数: ' || ms || ' 条，中位 ' || md || ' 条'", "'- 平均会话时长: ' || da || ' 分钟，中位 ' || dm || ' 分钟'", f"'- 会话内我的平均回复: ' || {_NUM.format('me_i')} || '秒'", f"'- 会话内对方平均回复: ' || {_NUM.format('other_i')} || '秒'",
    "chr(10) || '## 最活跃会话 TOP 10'", "ts.x", "chr(10) || '## 月度趋势'", "mo.x", "chr(10) || '## 最活跃日期 TOP 10'", "td.x", "chr(10) || '## 每小时分布'", "ho.x", "chr(10) || '## 文本消息样本'", "sa.x",
)} AS report FROM t JOIN rl USING (conv_id) LEFT JOIN ir USING (conv_id) JOIN fl USING (conv_id) JOIN sh USING (conv_id) JOIN ts USING (conv_id) JOIN mo USING (conv_id) JOIN td USING (conv_id) JOIN ho USING (conv_id) LEFT JOIN sa USING (conv_id)"""  # noqa: E501


@query(_REPORT)
def statistics_reports(spark, sf_dir):
    m = td.events(spark, sf_dir)
    return reports.statistics_report(m, m.where("position % 20 = 0"))


@query(_GAP + """, a AS (SELECT conv_id, session, message_count, row_number() OVER (PARTITION BY conv_id ORDER BY message_count DESC, session) AS z FROM ss), k AS (SELECT s.conv_id, z AS rank, s.position, s.t, s.sender, s.event_type, row_number() OVER (PARTITION BY s.conv_id, s.session ORDER BY s.position) AS r, message_count AS n FROM s JOIN a ON a.conv_id = s.conv_id AND a.session = s.session WHERE z <= 10)
SELECT conv_id, rank, string_agg(strftime(t, '%H:%M') || CASE WHEN sender = 'me' THEN ' 【我】 ' ELSE ' 【对方】 ' END || event_type, chr(10) ORDER BY position) AS report FROM k WHERE n <= 3 OR r <= 1 OR r > n - 2 GROUP BY conv_id, rank""")
def segment_previews(spark, sf_dir):
    m = sessions.gap_sessions(td.events(spark, sf_dir))
    return reports.segment_lines(m, statistics.top_sessions(sessions.session_summary(td.events(spark, sf_dir))), 3)


@query(_EV + f", mo AS (SELECT conv_id, strftime(t, '%Y-%m-%d') AS month, {_SENDERS} FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY month DESC) AS r FROM mo), w AS (SELECT *, greatest(1, max(total) OVER (PARTITION BY conv_id)) AS most FROM r WHERE r <= 12) SELECT conv_id, month, round(me * 100.0 / most, 6) AS me_width, round(other * 100.0 / most, 6) AS other_width FROM w")
def month_charts(spark, sf_dir):
    """Days stand for months here, since the events cover little time."""
    return _rounded(reports.month_bars(statistics.daily(td.events(spark, sf_dir)).withColumnRenamed("day", "month")))


@query(_CV + " SELECT conv_id, concat_ws(' · ', CASE WHEN count(*) FILTER (WHERE reason IS NOT NULL) > 0 THEN '跳过 ' || count(*) FILTER (WHERE reason IS NOT NULL) || ' 条' END, CASE WHEN count(*) FILTER (WHERE reason IS NULL) > 0 THEN '时间格式异常 ' || count(*) FILTER (WHERE reason IS NULL) || ' 条' END, CASE WHEN count(*) FILTER (WHERE reason IS NULL) > 0 THEN '时间戳异常 ' || count(*) FILTER (WHERE reason IS NULL) || ' 条' END) AS line FROM raw GROUP BY conv_id")
def diagnostics_lines(spark, sf_dir):
    return reports.diagnostics_line(messages.diagnostics(td.raw_conversations(spark, sf_dir)))


# Model answers stand for an extractor's output: an object in a fence, a bare one, one with a bad field, or none.
_ANSWER = """CASE event_id % 6
 WHEN 0 THEN concat('Text\n```JSON {"events": [{"summary": "', event_type, '", "evidence": "e', CAST(event_id AS {0}), '", "confidence": "high"}], "relation_signals": [], "persona_signals": [], "counter_evidence": [], "uncertainties": [{"question": "q", "reason": "r"}]} ```')
 WHEN 1 THEN '{"events": [], "relation_signals": [], "persona_signals": [], "counter_evidence": [], "uncertainties": []}'
 WHEN 2 THEN '{"events": [{"summary": " ", "evidence": "e", "confidence": "high"}], "relation_signals": [], "persona_signals": [], "counter_evidence": [], "uncertainties": []}'
 WHEN 3 THEN '{"events": [{"summary": 5, "evidence": "e", "confidence": "high"}], "relation_signals": [], "persona_signals": [], "counter_evidence": [], "uncertainties": []}'
 WHEN 4 THEN concat('note {"x": 1} and {"events": [], "relation_signals": [{"model": "m", "direction": "', CASE WHEN event_id % 4 = 0 THEN 'support' ELSE 'sideways' END, '", "signal": "s", "evidence": "a } b", "confidence": "low"}], "persona_signals": [], "counter_evidence": [], "uncertainties": []} end')
 ELSE 'no object here' END"""
_JSON = (
    "WITH a AS (SELECT event_id, " + _ANSWER.replace("{0}", "VARCHAR") + " AS answer FROM events), f AS (SELECT event_id, CASE WHEN contains(answer, '```') THEN regexp_extract(answer, '(?s)```JSON (.*) ```', 1) WHEN starts_with(answer, '{') THEN answer ELSE regexp_extract(answer, '(\\{\"events.*\\})', 1) END AS j FROM a),"
    " v AS (SELECT event_id, j, json_valid(j) AND j <> '' AS is_json FROM f),"
    " d AS (SELECT event_id, CASE WHEN is_json THEN j ELSE '{}' END AS j FROM v),"
    " e AS (SELECT event_id, j, coalesce(json_array_length(j, '$.events'), -1) AS ne, coalesce(json_array_length(j, '$.relation_signals'), -1) AS nr, coalesce(json_array_length(j, '$.uncertainties'), -1) AS nu FROM d),"
    " o AS (SELECT *, ne >= 0 AND nr >= 0 AND nu >= 0 AND (ne = 0 OR (json_type(j, '$.events[0].summary') = 'VARCHAR' AND trim(json_extract_string(j, '$.events[0].summary')) <> '')) AND (nr = 0 OR json_extract_string(j, '$.relation_signals[0].direction') IN ('support', 'against', 'mixed')) AS ok FROM e)"
)


def _answers(spark, sf_dir) -> DataFrame:
    return td.table(spark, sf_dir, "events").select(F.lit("c").alias("conv_id"), F.col("event_id").alias("chunk_index"), F.expr(_ANSWER.replace("{0}", "STRING")).alias("answer"))


@query(_JSON + " SELECT event_id AS chunk_index, CASE WHEN ok THEN 'ok' ELSE 'fallback' END AS parse_status, CASE WHEN ok AND ne + nr + nu > 0 THEN 'signals' WHEN ok THEN 'insufficient' END AS evidence_status FROM o")
def answer_documents(spark, sf_dir):
    return evidence.normalised(_answers(spark, sf_dir))[0].drop("conv_id")


@query(_JSON + """ SELECT event_id AS chunk_index, 'events' AS category, json_extract_string(j, '$.events[0].summary') AS summary, CAST(NULL AS VARCHAR) AS signal, CAST(NULL AS VARCHAR) AS question FROM o WHERE ok AND ne > 0
UNION ALL SELECT event_id, 'relation_signals', NULL, json_extract_string(j, '$.relation_signals[0].signal'), NULL FROM o WHERE ok AND nr > 0
UNION ALL SELECT event_id, 'uncertainties', NULL, NULL, CASE WHEN ok THEN json_extract_string(j, '$.uncertainties[0].question') ELSE '结构化证据未能从模型输出中可靠解析' END FROM o WHERE NOT ok OR nu > 0""")
def answer_items(spark, sf_dir):
    return evidence.normalised(_answers(spark, sf_dir))[1].select("chunk_index", "category", "summary", "signal", "question")


_STORE = """WITH i AS (SELECT user_id % 12 AS conv_id, user_id AS chunk_index, event_id AS eid, CASE event_type WHEN 'click' THEN 'events' WHEN 'view' THEN 'relation_signals' WHEN 'purchase' THEN 'persona_signals' ELSE 'uncertainties' END AS category, 'm' || (event_id % 9) AS label,
CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'not_applicable' WHEN event_id % 5 = 0 THEN 'unmatched' WHEN event_id % 7 = 0 THEN 'ambiguous' ELSE 'matched' END AS status, CASE event_id % 3 WHEN 0 THEN 'me' ELSE 'other' END AS sender, CAST(ts AS DATE) AS day, 'E_' || (event_id % 400) AS evidence_id, event_type FROM events WHERE user_id IS NOT NULL),
q AS (SELECT *, status IN ('matched', 'not_applicable') AS grounded, status IN ('matched', 'not_applicable') AND (category <> 'persona_signals' OR sender = 'other') AS usable FROM i)"""


def _store(spark, sf_dir) -> DataFrame:
    e, i = td.table(spark, sf_dir, "events").where("user_id is not null"), F.col("event_id")
    category = F.when(F.col("event_type") == "click", "events").when(F.col("event_type") == "view", "relation_signals").when(F.col("event_type") == "purchase", "persona_signals").otherwise("uncertainties")
    status = F.when(category == "uncertainties", "not_applicable").when(i % 5 == 0, "unmatched").when(i % 7 == 0, "ambiguous").otherwise("matched")
    label = F.concat(F.lit("m"), (i % 9).cast("string"))
    one = lambda *names: F.when(category.isin(*names), F.col("event_type"))
    return e.select(
        (F.col("user_id") % 12).alias("conv_id"), F.col("user_id").alias("chunk_index"), i.alias("at"), category.alias("category"), status.alias("status"), F.when(i % 3 == 0, "me").otherwise("other").alias("sender"), F.to_date("ts").alias("day"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.lit("? ~ ?").alias("time_range"), F.concat(F.lit("E_"), (i % 400).cast("string")).alias("evidence_id"),
        F.when(category == "relation_signals", label).alias("model"), F.when(category == "persona_signals", label).alias("trait"), one("events").alias("summary"), one("relation_signals", "persona_signals").alias("signal"),
        F.when(category != "uncertainties", F.concat(F.lit("said\n"), "event_type")).alias("evidence"), F.lit("support").alias("direction"), F.lit(None).cast("string").alias("against"), one("uncertainties").alias("question"), F.lit("why").alias("reason"), F.when(category != "uncertainties", F.lit("low")).alias("confidence"),
    )


@query(_STORE + " SELECT conv_id, count(DISTINCT evidence_id) AS evidence, count(*) AS occurrences, count(DISTINCT evidence_id) FILTER (WHERE status IN ('unmatched', 'ambiguous')) AS quarantined FROM i GROUP BY conv_id")
def store_counts(spark, sf_dir):
    return evidence.store_counts(_store(spark, sf_dir))


@query(_STORE + " SELECT conv_id, category, label, count(DISTINCT chunk_index) AS n_chunks, count(DISTINCT day) AS n_days FROM q WHERE usable AND status = 'matched' AND category IN ('relation_signals', 'persona_signals') GROUP BY ALL")
def signal_recurrence(spark, sf_dir):
    return evidence.recurrence(_store(spark, sf_dir))


@query(_STORE + " SELECT conv_id, CAST((chunk_index - 1) // 8 + 1 AS BIGINT) AS phase, category, count(*) AS n_items, min(chunk_index) AS first_chunk, max(chunk_index) AS last_chunk FROM (SELECT * FROM q WHERE usable AND chunk_index > 0) GROUP BY ALL")
def phase_items(spark, sf_dir):
    return evidence.phases(_store(spark, sf_dir).where("chunk_index > 0"))


_CHOSEN = """, u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, category, chunk_index ORDER BY eid, evidence_id) - 1 AS depth FROM q WHERE usable),
a AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id, category ORDER BY chunk_index) - 1 AS g FROM u), b AS (SELECT *, max(g) OVER (PARTITION BY conv_id, category) + 1 AS n FROM a),
c AS (SELECT * FROM b WHERE n <= 20 OR list_contains([CAST(round_even(k * (n - 1) / 19.0, 0) AS BIGINT) FOR k IN range(20)], g)),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, category, depth ORDER BY chunk_index) - 1 AS ix, count(*) OVER (PARTITION BY conv_id, category, depth) AS o FROM c),
z AS (SELECT conv_id, category, depth, count(*) AS k FROM c GROUP BY ALL), y AS (SELECT conv_id, category, depth, 20 - coalesce(sum(k) OVER (PARTITION BY conv_id, category ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM z),
p AS (SELECT l.* FROM l JOIN y USING (conv_id, category, depth) WHERE room > 0 AND (o <= room OR (room = 1 AND ix = (o - 1) // 2) OR (room > 1 AND list_contains([CAST(round_even(k * (o - 1) / CAST(room - 1 AS DOUBLE), 0) AS BIGINT) FOR k IN range(CAST(room AS BIGINT))], ix))))"""


@query(_STORE + _CHOSEN + ", s AS (SELECT conv_id, category, count(*) AS total, count(*) FILTER (WHERE grounded) AS grounded, count(*) FILTER (WHERE usable) AS usable FROM q GROUP BY ALL), h AS (SELECT conv_id, category, count(*) AS chosen FROM p GROUP BY ALL) SELECT s.*, coalesce(chosen, 0) AS chosen FROM s LEFT JOIN h USING (conv_id, category)")
def summary_counts(spark, sf_dir):
    return evidence.summary_counts(_store(spark, sf_dir), 20)


@query(_STORE + _CHOSEN + """, t AS (SELECT p.*, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS time FROM p JOIN events e ON e.event_id = p.eid),
w AS (SELECT conv_id, category, string_agg('- ' || evidence_id || CASE WHEN category <> 'uncertainties' THEN CASE sender WHEN 'me' THEN ' / 我' ELSE ' / 对方' END ELSE '' END || ' / ' || time || ': ' || CASE category WHEN 'events' THEN event_type WHEN 'relation_signals' THEN label || ' / support: ' || event_type WHEN 'persona_signals' THEN label || ': ' || event_type ELSE event_type || '；原因：why' END
 || CASE WHEN category <> 'uncertainties' THEN '；证据：said ' || event_type || '；可信度：low' ELSE '' END, chr(10) ORDER BY chunk_index, depth) AS body FROM t GROUP BY ALL),
n AS (SELECT DISTINCT conv_id, category FROM q) SELECT n.conv_id, n.category, CASE n.category WHEN 'events' THEN '事件证据' WHEN 'relation_signals' THEN '关系建模证据' WHEN 'persona_signals' THEN '人物建模证据' ELSE '存疑问题' END AS title, md5(coalesce(body, '- 暂无结构化条目。')) AS body_md5 FROM n LEFT JOIN w USING (conv_id, category)""")
def evidence_summaries(spark, sf_dir):
    return evidence.summary(_store(spark, sf_dir), 20).select("conv_id", "category", "title", F.md5("body").alias("body_md5"))


@query("""WITH b AS (SELECT user_id AS conv_id, string_agg('- E_' || md5(CAST(event_id % 50 AS VARCHAR)) || CASE WHEN event_id % 2 = 0 THEN ' / 我 / ' ELSE ' / 对方 / ' END || strftime(ts, '%Y-%m-%d') || CASE WHEN event_id % 90 = 0 THEN ' 反证' ELSE '' END, chr(10) ORDER BY event_id) AS body FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT conv_id, 'local' AS name, strlen(body) AS bytes, len(list_distinct(regexp_extract_all(body, 'E_[0-9a-f]{32}'))) AS n_ids, len(list_distinct(regexp_extract_all(body, '[0-9]{4}-[0-9]{2}-[0-9]{2}'))) AS n_dates, contains(body, ' / 我 / ') AND contains(body, ' / 对方 / ') AS has_speakers, contains(body, '反证') AS has_counter, false AS has_open FROM b""")
def phase_measures(spark, sf_dir):
    e, i = td.table(spark, sf_dir, "events").where("user_id is not null"), F.col("event_id")
    line = F.concat(F.lit("- E_"), F.md5((i % 50).cast("string")), F.when(i % 2 == 0, " / 我 / ").otherwise(" / 对方 / "), F.date_format("ts", "yyyy-MM-dd"), F.when(i % 90 == 0, " 反证").otherwise(""))
    return evidence.phase_measures(reports.joined(e.select(F.col("user_id").alias("conv_id"), i.alias("at"), line.alias("line")), "conv_id").select("conv_id", F.lit("local").alias("name"), F.col("report").alias("body")))


_CLAIMS = """WITH c AS (SELECT o_orderkey AS claim_id, o_custkey, CAST(o_orderkey % 9 AS INTEGER) AS section, CASE o_orderkey % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'inference' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'hypothesis' ELSE 'rumour' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'repeated' ELSE 'long_term' END AS scope,
CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS confidence, CASE o_orderkey % 2 WHEN 0 THEN 'peer' ELSE 'user' END AS subject, CASE o_orderkey % 7 WHEN 0 THEN 'found' WHEN 1 THEN 'not_assessed' ELSE 'not_found_in_selected' END AS counter_review,
'body (' || (o_custkey % 50) || ')' AS text, CASE WHEN o_orderkey % 11 = 0 THEN 'see <b>' ELSE 'x' END AS context_review, 'u' AS uncertainty FROM orders)"""


def _claims(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    return td.table(spark, sf_dir, "orders").select(
        k.alias("claim_id"), (k % 9).cast("int").alias("section"), pick(5, "fact", "inference", "uncertain", "hypothesis", "rumour").alias("kind"), pick(3, "local", "repeated", "long_term").alias("scope"), pick(4, "low", "high", "medium", "medium").alias("confidence"),
        pick(2, "peer", "user").alias("subject"), F.when(k % 7 == 0, "found").when(k % 7 == 1, "not_assessed").otherwise("not_found_in_selected").alias("counter_review"),
        F.concat(F.lit("body ("), (F.col("o_custkey") % 50).cast("string"), F.lit(")")).alias("text"), F.when(k % 11 == 0, "see <b>").otherwise("x").alias("context_review"), F.lit("u").alias("uncertainty"),
    )


@query(_CLAIMS + " SELECT claim_id, 'kind' AS field FROM c WHERE kind = 'rumour' UNION ALL SELECT claim_id, 'section' FROM c WHERE section NOT BETWEEN 1 AND 7 UNION ALL SELECT claim_id, 'context_review' FROM c WHERE contains(context_review, '<')")
def claim_shapes(spark, sf_dir):
    return claims.shape_violations(_claims(spark, sf_dir), 7)


@query(_CLAIMS + """, r AS (SELECT l_orderkey AS claim_id, CASE WHEN l_linenumber = 3 THEN 'counter' ELSE 'support' END AS role, l_partkey % 10 <> 0 AS inside, CASE WHEN l_suppkey % 2 = 0 THEN 'other' ELSE 'me' END AS sender FROM lineitem WHERE l_linenumber > 1),
g AS (SELECT claim_id, count(*) FILTER (WHERE role = 'support') AS s, count(*) FILTER (WHERE role = 'counter') AS k, count(*) FILTER (WHERE NOT inside) AS o, count(*) FILTER (WHERE role = 'support' AND sender = 'other') AS p FROM r GROUP BY claim_id),
b AS (SELECT c.*, coalesce(s, 0) AS s, coalesce(k, 0) AS k, coalesce(o, 0) AS o, coalesce(p, 0) AS p FROM c LEFT JOIN g USING (claim_id))
SELECT claim_id, 'no_support' AS violation FROM b WHERE kind <> 'uncertain' AND s = 0 UNION ALL SELECT claim_id, 'uncertain' FROM b WHERE kind = 'uncertain' AND (confidence <> 'low' OR scope <> 'local') UNION ALL SELECT claim_id, 'counter_review' FROM b WHERE (k > 0) <> (counter_review = 'found') OR (kind <> 'uncertain' AND counter_review = 'not_assessed')
UNION ALL SELECT claim_id, 'context' FROM b WHERE kind <> 'uncertain' AND (kind <> 'fact' OR scope <> 'local') AND o > 0 UNION ALL SELECT claim_id, 'peer_words' FROM b WHERE subject = 'peer' AND kind <> 'uncertain' AND p = 0""")
def claim_gates(spark, sf_dir):
    line = td.table(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    refs = line.select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_linenumber") == 3, "counter").otherwise("support").alias("role"), F.col("l_partkey").alias("evidence_id"), F.when(F.col("l_suppkey") % 2 == 0, "other").otherwise("me").alias("sender"))
    return claims.gate_violations(_claims(spark, sf_dir), refs, line.where("l_partkey % 10 <> 0").select(F.col("l_partkey").alias("evidence_id")))


@query(_CV + ", r AS (SELECT conv_id, 'P_' || (turn + 1) AS ref FROM raw UNION ALL SELECT conv_id, 'E_' || turn FROM raw) SELECT r.conv_id AS claim_id, ref, coalesce(CASE WHEN m.position IS NOT NULL THEN 'M' || m.position END, ref) AS id FROM r LEFT JOIN (SELECT DISTINCT position FROM p) m ON ref = 'P_' || m.position")
def alias_references(spark, sf_dir):
    c = td.table(spark, sf_dir, "conversations")
    m = td.conversations(spark, sf_dir).select("position").distinct().select("position", F.concat(F.lit("M"), F.col("position").cast("string")).alias("message_id"))
    refs = c.select(F.col("conv_id").alias("claim_id"), F.concat(F.lit("P_"), (F.col("turn") + 1).cast("string")).alias("ref")).union(c.select("conv_id", F.concat(F.lit("E_"), F.col("turn").cast("string"))))
    return claims.alias_map(m, refs)


@query(_CLAIMS + " SELECT claim_id, dense_rank() OVER (ORDER BY section, kind, text) AS class, row_number() OVER (PARTITION BY section, kind, text ORDER BY claim_id) > 1 AS duplicate FROM c")
def claim_duplicates(spark, sf_dir):
    """Claims with the same key are one class; the class numbers follow section, kind and text."""
    keyed = claims.identified(_claims(spark, sf_dir), "S_x", "relation", ("section", "kind", "text"))
    classes = keyed.groupBy("claim_key").agg(F.min(F.struct("section", "kind", "text")).alias("f"))
    classes = classes.withColumn("class", F.dense_rank().over(Window.orderBy("f")))  # a row per distinct claim
    return keyed.join(classes, "claim_key").select("claim_id", "class", "duplicate")


_LINES = "(kind <> 'fact') AS nf, claim_id, '- body ' || chr(92) || '(' || (o_custkey % 50) || chr(92) || ') [C' || claim_id || ']' AS line"


@query(_CLAIMS + f", l AS (SELECT section, {_LINES} FROM c) SELECT section, md5(string_agg(line, chr(10) ORDER BY nf, claim_id)) AS body_md5 FROM l GROUP BY section")
def claim_reports(spark, sf_dir):
    rows = _claims(spark, sf_dir).withColumn("claim_key", F.concat(F.lit("C"), F.col("claim_id").cast("string")))
    return claims.rendered(rows).select("section", F.md5("body").alias("body_md5"))


@query("SELECT section, violation FROM (VALUES (3, 'missing'), (5, 'changed'), (99, 'extra')) t(section, violation)")
def claim_report_audit(spark, sf_dir):
    """A report in which one section was left out, one changed, and one put in."""
    rows = _claims(spark, sf_dir).withColumn("claim_key", F.concat(F.lit("C"), F.col("claim_id").cast("string")))
    body = claims.rendered(rows).where("section <> 3").withColumn("body", F.when(F.col("section") == 5, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return claims.report_audit(rows, body.union(spark.createDataFrame([(99, "x")], "section int, body string")))


_CAT = """WITH e AS (SELECT DISTINCT 'E_' || md5(CAST(doc_id AS VARCHAR)) AS id, doc_id % 6 = 0 AS bad FROM documents), i AS (SELECT id FROM e UNION SELECT 'M_' || md5(CAST(doc_id AS VARCHAR)) FROM documents),
t AS (SELECT DISTINCT left(CASE doc_id % 2 WHEN 0 THEN 'E_' ELSE 'M_' END || md5(CAST(doc_id AS VARCHAR)), 3 + CAST(doc_id % 8 AS INTEGER)) AS p, CASE doc_id % 3 WHEN 0 THEN '…' WHEN 1 THEN '...' ELSE '' END AS tail FROM documents)"""


@query(_CAT + """, n AS (SELECT p || tail AS ref, p, count(i.id) AS n, min(i.id) AS one FROM t LEFT JOIN i ON starts_with(i.id, p) GROUP BY ALL)
SELECT ref, CASE WHEN starts_with(ref, 'E_') THEN 'evidence' ELSE 'message' END AS kind, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN e.bad THEN 'quarantined' ELSE 'resolved' END AS status, CASE WHEN n = 1 THEN one END AS id FROM n LEFT JOIN e ON n.n = 1 AND e.id = n.one
UNION ALL SELECT 'chunk_' || c, 'chunk', CASE WHEN c % 25 < 20 AND c < 20 THEN 'resolved' ELSE 'missing' END, printf('chunk_%03d', CAST(c AS INTEGER)) FROM range(25) r(c)""")
def reference_catalogue(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    e = d.select(F.concat(F.lit("E_"), "h").alias("id"), F.when(F.col("doc_id") % 6 == 0, "ambiguous").otherwise("matched").alias("status"))
    head = F.expr("substring(concat(CASE WHEN doc_id % 2 = 0 THEN 'E_' ELSE 'M_' END, h), 1, cast(3 + doc_id % 8 as int))")
    tail = F.when(F.col("doc_id") % 3 == 0, "…").when(F.col("doc_id") % 3 == 1, "...").otherwise("")
    tokens = d.select(F.concat(head, tail).alias("ref")).union(spark.range(25).select(F.concat(F.lit("chunk_"), F.col("id").cast("string"))))
    return retrieval.catalogue(tokens, e, d.select(F.concat(F.lit("M_"), "h").alias("id")), spark.range(20).select(F.col("id").alias("chunk_index")))


@query("SELECT doc_id, sha256(length_(CAST(doc_id AS VARCHAR)) || ':' || doc_id || length_(coalesce(lang, '')) || ':' || coalesce(lang, '') || length_(coalesce(text, '')) || ':' || coalesce(text, '')) AS revision FROM documents".replace("length_(", "strlen("))
def revision_keys(spark, sf_dir):
    return td.table(spark, sf_dir, "documents").select("doc_id", retrieval.revision(F.col("doc_id"), F.col("lang"), F.col("text")).alias("revision"))


@query("SELECT source AS source_id, count(*) AS n FROM documents WHERE source = (SELECT min(source) FROM documents) GROUP BY source")
def scoped_store(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents")
    one = d.agg(F.min("source").alias("s")).first()["s"]
    store = d.where(F.col("source") == one).select(F.col("source").alias("source_id"), F.lit("v1").alias("policy"))
    return retrieval.in_scope(store, one, "v1").groupBy("source_id").agg(F.count("*").alias("n"))


@query(_CTX + ' SELECT an.conv_id, an.position, count(*) FILTER (WHERE m.position % 10 = 0) > 0 AS needed FROM an JOIN m ON an.conv_id = m.conv_id AND m.position BETWEEN "left" AND "right" GROUP BY ALL')
def retrieval_needs(spark, sf_dir):
    return retrieval.need_retrieval(_anchored(spark, sf_dir), td.events(spark, sf_dir).where("position % 10 <> 0"))


_EXTRACT = "WITH x AS (SELECT doc_id AS case_id, lang AS dim, text AS source, CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN NULL ELSE CAST(doc_id % 3 AS INTEGER) END AS value, CASE WHEN doc_id % 13 = 0 THEN 1.5 ELSE 0.5 END AS confidence, CASE doc_id % 4 WHEN 0 THEN 'nowhere to be found' WHEN 1 THEN ' ' ELSE substr(text, 4, 12) END AS quote FROM documents WHERE text IS NOT NULL)"


@query(_EXTRACT + " SELECT case_id, 'value' AS violation FROM x WHERE value = 3 UNION ALL SELECT case_id, 'confidence' FROM x WHERE confidence > 1 UNION ALL SELECT case_id, 'quote' FROM x WHERE value IS NOT NULL AND (trim(quote) = '' OR NOT contains(source, quote)) UNION ALL SELECT case_id, 'dimension' FROM x WHERE dim NOT IN ('en', 'de', 'fr')")
def extraction_checks(spark, sf_dir):
    i = F.col("doc_id")
    d = td.table(spark, sf_dir, "documents").where("text is not null")
    rows = d.select(i.alias("case_id"), F.col("lang").alias("dim"), F.col("text").alias("source"), F.when(i % 5 == 0, 3).when(i % 5 != 1, (i % 3).cast("int")).alias("value"), F.when(i % 13 == 0, 1.5).otherwise(0.5).alias("confidence"), F.when(i % 4 == 0, "nowhere to be found").when(i % 4 == 1, " ").otherwise(F.substring("text", 4, 12)).alias("quote"))
    return scoring.extraction_violations(rows, ("en", "de", "fr")).select("case_id", "violation")


@query(_GOLD + """, s AS (SELECT doc_id, count(*) FILTER (WHERE gold = pred) AS tp, count(*) FILTER (WHERE gold IS NOT NULL AND pred IS NOT NULL AND gold <> pred) AS fp, count(*) FILTER (WHERE gold IS NOT NULL AND (pred IS NULL OR gold <> pred)) AS fn FROM g GROUP BY doc_id),
l AS (SELECT dim, v, count(*) FILTER (WHERE gold = v AND pred = v) AS tp, count(*) FILTER (WHERE gold IS NOT NULL AND pred = v AND gold <> v) AS fp, count(*) FILTER (WHERE gold = v AND (pred IS NULL OR pred <> v)) AS fn FROM g, (VALUES (0), (1), (2)) t(v) GROUP BY ALL)
SELECT (SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 6) FROM s WHERE tp + fp + fn > 0) AS sample_macro_f1, (SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 6) FROM l WHERE tp + fp + fn > 0) AS label_macro_f1, (SELECT round(avg(tp / (tp + fp + fn)), 6) FROM s WHERE tp + fp + fn > 0) AS jaccard""")
def macro_scores(spark, sf_dir):
    return _rounded(scoring.macros(_labelled(spark, sf_dir)))


@query()
def repetition_windows(spark, sf_dir):
    """No SQL form: windows are added one by one while their bytes fit; a test holds it against a plain loop."""
    m = td.events(spark, sf_dir)
    return selection.repetition_windows(m, m.where("type = 'purchase'").select("conv_id", "content").distinct(), 3000)


@query(_TURNS + " SELECT conv_id, count(*) AS turns, CAST(sum(n_messages) AS BIGINT) AS n_messages FROM tt GROUP BY conv_id")
def turn_totals(spark, sf_dir):
    return sessions.speaker_turns(td.conversations(spark, sf_dir)).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("n_messages").alias("n_messages"))


@query("""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts AS time, event_id % 1000 AS p, event_id % 100 AS c FROM events WHERE user_id IS NOT NULL), l AS (SELECT arg_max(session_id, time) AS session_id FROM u) SELECT u.session_id, count(*) AS requests, CAST(sum(p + c) AS BIGINT) AS total_tokens FROM u JOIN l USING (session_id) GROUP BY u.session_id""")
def latest_usage_session(spark, sf_dir):
    e = td.table(spark, sf_dir, "events").where("user_id is not null")
    p, c = F.col("event_id") % 1000, F.col("event_id") % 100
    none = F.lit(None).cast("string")
    log = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("time"), F.lit("s").alias("stage"), F.lit("m").alias("model"), F.struct(p.cast("string").alias("prompt_tokens"), c.cast("string").alias("completion_tokens"), (p + c).cast("string").alias("total_tokens"), none.alias("prompt_cache_hit_tokens"), none.alias("prompt_cache_miss_tokens"), none.alias("reasoning_tokens")).alias("usage"))
    return usage.latest_session(usage.normalised(log)).select("session_id", "requests", "total_tokens")


_PERM = """WITH r AS (SELECT d.doc_id, d.source AS profile, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS variant, CAST(l.quality AS INTEGER) AS pred FROM documents d LEFT JOIN labels l USING (doc_id)),
n AS (SELECT profile, row_number() OVER (ORDER BY profile) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT profile FROM r))"""


@query(_PERM + " SELECT r.doc_id AS case_id, o.pred FROM r JOIN n a USING (profile) JOIN n b ON b.k = a.k % a.n + 1 LEFT JOIN r o ON o.profile = b.profile AND o.variant = r.variant")
def permuted_baseline(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").withColumn("variant", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    lab = td.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("pred"))
    rows = d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("case_id"), F.col("source").alias("profile"), "variant", F.lit("d").alias("dim"), "pred")
    return scoring.permuted(rows).select("case_id", "pred")


@query(_EV + ", f AS (SELECT conv_id, event_type, min(position) AS p FROM m GROUP BY ALL) SELECT conv_id, event_type, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS rank FROM f")
def first_occurrences(spark, sf_dir):
    return selection.first_occurrences(td.events(spark, sf_dir).withColumnRenamed("type", "event_type"), "event_type", "position")


@query("WITH u AS (SELECT user_id, list_sort(list_distinct(list(event_id % 20))) AS ids, list_distinct(list(event_id % 7)) AS seen FROM events WHERE user_id IS NOT NULL GROUP BY user_id) SELECT user_id, array_to_string([x FOR x IN ids IF list_contains(seen, x)], ',') AS kept, array_to_string([x FOR x IN ids IF NOT list_contains(seen, x)], ',') AS gone FROM u")
def pruned_ids(spark, sf_dir):
    e = td.table(spark, sf_dir, "events").where("user_id is not null").groupBy("user_id").agg(F.sort_array(F.collect_set(F.col("event_id") % 20)).alias("ids"), F.collect_set(F.col("event_id") % 7).alias("seen"))
    kept, gone = selection.pruned("ids", "seen")
    return e.select("user_id", *[F.array_join(x.cast("array<string>"), ",").alias(n) for n, x in (("kept", kept), ("gone", gone))])


@query(_EV + " SELECT conv_id, idx AS original_index, CASE WHEN event_type = 'error' THEN '其他消息' ELSE event_type END AS type, event_type || ' [邮箱1] [手机号1]' AS content, CASE WHEN idx % 10 = 0 THEN 'at [手机号1]' ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS time_str, CASE WHEN idx % 2 = 0 THEN 'source:' || (idx + 1) END AS source_message_id FROM m")
def safe_snapshot(spark, sf_dir):
    from ..operators import redaction

    i, c = F.col("original_index"), F.col("conv_id").cast("string")
    phone = F.concat(F.lit("1380013"), F.lpad(c, 4, "0"))
    m = td.events(spark, sf_dir).select("conv_id", "original_index", "type", F.concat("content", F.lit(" u"), c, F.lit("@x.org "), phone).alias("content"), F.when(i % 10 == 0, F.concat(F.lit("at +86"), phone)).otherwise(F.col("time_str")).alias("time_str"), F.when(i % 2 == 0, F.lit("secret")).alias("source_message_id"))
    return redaction.snapshot(m, ("click", "view", "purchase", "scroll", "login", "logout", "signup"))


@query(_EV + """ SELECT conv_id, idx AS original_index, CASE WHEN idx % 3 = 0 THEN 'mail [邮箱1]' ELSE '{"u@x.org": "[邮箱1]", "n": ' || idx || ', "confidence": "high", "other": "对方", "list": ["[邮箱1] \\"q\\"", true]}' END AS answer FROM m""")
def redacted_answers(spark, sf_dir):
    from ..operators import redaction

    mail, i = F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("@x.org")), F.col("original_index")
    body = F.concat(F.lit('{"u@x.org": "'), mail, F.lit('", "n": '), i.cast("string"), F.lit(', "confidence": "high", "other": "high", "list": ["'), mail, F.lit(' \\"q\\"", true]}'))
    rows = td.events(spark, sf_dir).select("conv_id", "original_index", F.when(i % 3 == 0, F.concat(F.lit("mail "), mail)).otherwise(body).alias("answer"))
    known = rows.select("conv_id").distinct().select("conv_id", F.lit("high").alias("value"), F.lit("对方").alias("alias"))
    return redaction.redact_json(rows, grounding.ENUMS, known)


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')) AS html_md5 FROM pages")
def html_escapes(spark, sf_dir):
    from ..functions import text as tx

    return td.table(spark, sf_dir, "pages").select("page_id", F.md5(tx.html_escaped(F.col("html"))).alias("html_md5"))


@query("""WITH x AS (SELECT DISTINCT user_id % 12 AS conv_id, user_id AS chunk_index FROM events WHERE user_id IS NOT NULL)
SELECT conv_id, chunk_index, 'missing_document' AS violation FROM x WHERE chunk_index % 10 = 1 UNION ALL SELECT conv_id, chunk_index, 'stray_items' FROM x WHERE chunk_index % 10 = 1 AND chunk_index % 3 = 0 UNION ALL SELECT conv_id, chunk_index, 'extra_document' FROM x WHERE chunk_index % 10 = 2 UNION ALL SELECT conv_id, chunk_index, 'repeated_document' FROM x WHERE chunk_index % 10 = 3
UNION ALL SELECT conv_id, chunk_index, 'fallback_items' FROM x WHERE chunk_index % 10 = 4 AND chunk_index % 3 = 0""")
def artefact_audits(spark, sf_dir):
    """Planned chunks of which some have no document, some one too many, and some items that do not go with it."""
    x = td.table(spark, sf_dir, "events").where("user_id is not null").select((F.col("user_id") % 12).alias("conv_id"), F.col("user_id").alias("chunk_index")).distinct()
    k = F.col("chunk_index")
    documents = x.where(k % 10 != 1).withColumn("parse_status", F.when(k % 10 == 4, "fallback").otherwise("ok"))
    documents = documents.union(documents.where(k % 10 == 3))
    items = x.where((k % 3 == 0) & (k % 10 != 4)).withColumn("category", F.lit("events")).union(x.where(k % 10 == 4).withColumn("category", F.lit("uncertainties"))).union(x.where((k % 10 == 4) & (k % 3 == 0)).withColumn("category", F.lit("events")))
    return evidence.artefact_audit(documents, items, x.where(k % 10 != 2))


@query(_EV + """, a AS (SELECT conv_id, position, event_type, t FROM m), l AS (SELECT conv_id AS claim_id, position AS from_id, position + CASE WHEN position % 5 = 0 THEN -1 WHEN position % 7 = 0 THEN 1000000 ELSE 2 END AS to_id FROM m UNION ALL SELECT conv_id, position, position + 2 FROM m WHERE position % 11 = 0)
SELECT l.claim_id, from_id, to_id, CASE WHEN b.position IS NULL THEN 'unknown' WHEN from_id >= to_id THEN 'order' ELSE 'repeated' END AS violation FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, from_id, to_id) AS r FROM l) l LEFT JOIN a b ON b.conv_id = l.claim_id AND b.position = l.to_id WHERE b.position IS NULL OR from_id >= to_id OR r > 1""")
def time_link_checks(spark, sf_dir):
    e, p = td.events(spark, sf_dir), F.col("position")
    facts = e.select(F.col("conv_id").alias("claim_id"), p.alias("evidence_id"), p.alias("message_id"), "position", "time")
    to = p + F.when(p % 5 == 0, -1).when(p % 7 == 0, 1_000_000).otherwise(2)
    links = e.select(F.col("conv_id").alias("claim_id"), p.alias("from_id"), to.alias("to_id"))
    return claims.time_link_violations(links.union(e.where(p % 11 == 0).select("conv_id", p, p + 2)), facts)


@query(_EV + """, b AS (SELECT conv_id AS claim_id, position, event_type AS t, position % 8 AS k FROM m)
SELECT claim_id, 'text' AS field, position AS source_id, CASE k WHEN 0 THEN 'statement' WHEN 1 THEN 'source' WHEN 2 THEN 'usage' WHEN 3 THEN 'quote' ELSE 'unregistered' END AS violation FROM b WHERE k <= 4""")
def basis_checks(spark, sf_dir):
    """Review bases with a fault each: a statement not there, a source not seen, and so on; k above 4 has none."""
    e, p = td.events(spark, sf_dir), F.col("position")
    k = p % 8
    of = F.concat_ws("/", "conv_id", "position")
    basis = e.select(F.col("conv_id").alias("claim_id"), F.lit("text").alias("field"), F.when(k == 0, "not there").otherwise(F.lit("stated")).alias("statement"), of.alias("source_id"), F.when(k == 3, "zzz").otherwise(F.left("content", F.lit(3))).alias("quote"), F.when(k == 2, "gossip").when(k == 5, "context").when(k != 6, "assertion").alias("usage"))
    sources = e.where(k != 1).select(of.alias("source_id"), of.alias("message_id"), F.col("content").alias("text"))
    registered = e.where((k != 4) & (k != 5)).select(F.col("conv_id").alias("claim_id"), of.alias("message_id"), F.col("content").alias("quote"))
    found = claims.basis_violations(basis, e.select(F.col("conv_id").alias("claim_id"), F.lit("text").alias("field"), F.lit("as stated here").alias("text")).distinct(), sources, registered)
    return found.withColumn("source_id", F.element_at(F.split("source_id", "/"), -1).cast("int"))


@query("""WITH d AS (SELECT doc_id, doc_id % 9 AS k FROM documents)
SELECT doc_id AS position, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'repeated' WHEN 2 THEN 'participants' WHEN 3 THEN 'event' WHEN 4 THEN 'unknown' ELSE 'binding' END AS violation FROM d WHERE k <= 6""")
def source_readings(spark, sf_dir):
    """Readings of sources with a fault each: none, two, a nobody, no event, an unknown with a binding, a quote that is not there, nobody bound."""
    d, k = td.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("position"), "text"), F.col("doc_id") % 9
    people = F.when(k == 2, F.array(F.lit("me"), F.lit("them"))).when((k == 4) | (k == 8), F.array(F.lit("unknown"))).otherwise(F.array(F.lit("me")))
    one = F.struct(F.lit("me").alias("participant"), F.col("position").alias("position"), F.when(k == 5, "not in there").otherwise(F.left("text", F.lit(4))).alias("quote"))
    facts = d.where(k != 0).select("position", people.alias("participants"), F.when(k == 3, " ").otherwise("said").alias("event"), F.when(k == 8, "who?").otherwise("").alias("uncertainty"), F.when((k == 6) | (k == 8), F.array().cast("array<struct<participant:string,position:bigint,quote:string>>")).otherwise(F.array(one)).alias("bindings"))
    facts = facts.union(facts.where("position % 9 = 1"))
    return claims.source_violations(facts, d.select("position"), d.select("position", "text"))


@query("WITH c AS (SELECT l_orderkey AS claim_id, l_partkey AS position FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_partkey % 4 = 0) SELECT claim_id, array_to_string(list_sort(list_distinct(list(position))), ',') AS positions FROM c GROUP BY claim_id")
def unresolved_sources(spark, sf_dir):
    line = td.table(spark, sf_dir, "lineitem")
    cited = line.select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("position"))
    facts = line.select(F.col("l_partkey").alias("position"), F.when(F.col("l_partkey") % 4 == 0, F.array(F.lit("unknown"))).otherwise(F.array(F.lit("me"))).alias("participants"))
    kinds = td.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 3 == 0, "uncertain").otherwise("fact").alias("kind"))
    return claims.unresolved(kinds, cited, facts).select("claim_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


_UN = _CTX + """, u0 AS (SELECT *, max("right") OVER (PARTITION BY conv_id, session ORDER BY "left", position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM an),
uu AS (SELECT *, sum(CASE WHEN edge IS NULL OR "left" > edge + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY session, "left", position ROWS UNBOUNDED PRECEDING) AS unit FROM u0)"""


@query(_UN + """, k AS (SELECT conv_id, CAST(unit AS BIGINT) AS unit, CASE position % 3 WHEN 0 THEN 'events' WHEN 1 THEN 'relation_signals' ELSE 'counter_evidence' END AS c, CASE WHEN position % 3 = 1 THEN CASE position % 2 WHEN 0 THEN 'support' ELSE 'against' END END AS d FROM uu),
g AS (SELECT conv_id, unit, list_sort(list_distinct(list(c))) AS categories, list_sort(list_distinct(coalesce(list(d) FILTER (WHERE d IS NOT NULL), []))) AS directions FROM k GROUP BY ALL)
SELECT conv_id, unit, array_to_string(categories, ',') AS categories, array_to_string(directions, ',') AS directions, (list_contains(directions, 'support') OR list_contains(categories, 'events')) AND (list_contains(directions, 'against') OR list_contains(categories, 'counter_evidence')) AS contrast FROM g""")
def unit_label_sets(spark, sf_dir):
    a, p = _anchored(spark, sf_dir), F.col("position")
    labelled = a.select("conv_id", "position", F.when(p % 3 == 0, "events").when(p % 3 == 1, "relation_signals").otherwise("counter_evidence").alias("category"), F.when(p % 3 == 1, F.when(p % 2 == 0, "support").otherwise("against")).alias("direction"))
    found = sessions.unit_labels(sessions.candidate_units(a), labelled)
    return found.select("conv_id", "unit", *[F.array_join(c, ",").alias(c) for c in ("categories", "directions")], "contrast")


@query("SELECT source AS conv_id, doc_id, CASE WHEN (rank - 1) % 12 < 10 THEN CAST((rank - 1) // 12 + 1 AS INTEGER) END AS chunk_index FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)")
def positions_in_chunks(spark, sf_dir):
    from ..operators import chunks

    d = td.documents(spark, sf_dir).select("conv_id", "position", "doc_id")
    found = d.groupBy("conv_id", F.expr("cast((position - 1) div 12 + 1 as int)").alias("chunk_index")).agg(F.min("position").alias("start_message"), (F.expr("min(position) div 12") * 12 + 10).alias("end_message"))
    return chunks.in_chunks(d, found).select("conv_id", "doc_id", "chunk_index")


@query("WITH p AS (SELECT doc_id AS case_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id + 100000000 FROM labels WHERE doc_id % 7 = 0) SELECT case_id, CASE WHEN d.doc_id IS NULL THEN 'extra' ELSE 'repeated' END AS violation FROM (SELECT case_id, count(*) AS n FROM p GROUP BY case_id) q LEFT JOIN documents d ON d.doc_id = q.case_id WHERE d.doc_id IS NULL OR n > 1")
def prediction_checks(spark, sf_dir):
    lab = td.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"))
    given = lab.union(lab.where("case_id % 5 = 0")).union(lab.where("case_id % 7 = 0").select(F.col("case_id") + 100_000_000))
    return scoring.prediction_violations(td.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id")), given)


@query("""WITH r AS (SELECT o_orderkey AS report, ['E_' || left(md5(CAST(o_custkey AS VARCHAR)), 10) || '…', 'chunk_' || (o_custkey % 90), 'chunk_7', 'chunk_' || (o_custkey % 8), 'M_' || md5(CAST(o_orderkey AS VARCHAR))] AS refs FROM orders),
x AS (SELECT report, unnest(refs) AS ref, generate_subscripts(refs, 1) AS k FROM r), f AS (SELECT report, ref, min(k) AS k FROM x GROUP BY ALL) SELECT report, ref, CAST(row_number() OVER (PARTITION BY report ORDER BY k) - 1 AS INTEGER) AS place FROM f""")
def report_references(spark, sf_dir):
    from ..functions import text as tx

    o = td.table(spark, sf_dir, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    body = F.concat(F.lit("See E_"), F.left(F.md5(c.cast("string")), F.lit(10)), F.lit("… and chunk_"), (c % 90).cast("string"), F.lit("/7/"), (c % 8).cast("string"), F.lit(", not xE_0123456789 or E_123; M_"), F.md5(k.cast("string")), F.lit("."))
    return o.select(k.alias("report"), F.posexplode(tx.references(body)).alias("place", "ref"))


@query()
def bootstrap_intervals(spark, sf_dir):
    """No SQL form: the draws come from a seeded generator; a test holds all metrics against a plain loop."""
    rows = _labelled(spark, sf_dir)
    return scoring.bootstrap(rows, scoring.drawn_weights(rows.select("profile")))
