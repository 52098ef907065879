"""Queries over the driver's tables, one or more for each family of operators, each with its DuckDB counterpart.

``QUERIES[name](spark, sf_dir)`` and ``ORACLES[name]`` give the same columns and rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..operators import chunks, claims, grounding, messages, redaction, retrieval, scoring, selection, sessions, statistics
from . import testdata as td

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_EV = """WITH ev AS (SELECT user_id AS conv_id, event_id AS idx, date_trunc('second', ts) AS t, CASE WHEN event_type IN ('click','view') THEN 'me' ELSE 'other' END AS sender, event_type, value FROM events WHERE user_id IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, idx) AS position FROM ev)"""
_GAP = (
    _EV
    + """,
g AS (SELECT *, CASE WHEN date_diff('second', lag(t) OVER w, t) > 14400 THEN 1 ELSE 0 END AS f FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY position)),
s AS (SELECT *, 1 + sum(f) OVER (PARTITION BY conv_id ORDER BY position) AS session FROM g),
d AS (SELECT *, CASE WHEN lag(sender) OVER v <> sender THEN date_diff('second', lag(t) OVER v, t) END AS sd FROM s WINDOW v AS (PARTITION BY conv_id, session ORDER BY position)),
ss AS (SELECT conv_id, session, count(*) AS message_count, count(*) FILTER (WHERE sender = 'me') AS me_count, count(*) FILTER (WHERE sender = 'other') AS other_count, arg_min(sender, position) AS initiator, arg_max(sender, position) AS closer,
 min(position) AS first_position, max(position) AS last_position, CAST(printf('%.1f', date_diff('second', min(t), max(t)) / 60.0) AS DOUBLE) AS duration_minutes,
 count(*) FILTER (WHERE sd > 5 AND sd < 14400) AS reply_count, CASE WHEN count(*) FILTER (WHERE sd > 5 AND sd < 14400) > 0 THEN CAST(printf('%.1f', CAST(avg(sd) FILTER (WHERE sd > 5 AND sd < 14400) AS DOUBLE)) AS DOUBLE) END AS reply_avg
 FROM d GROUP BY conv_id, session)"""
)
_CV = """WITH raw AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'system' THEN 'system_message' WHEN coalesce(text, '') = '' THEN 'empty_content' END AS reason FROM conversations),
p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'me' ELSE 'other' END AS sender, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM raw WHERE reason IS NULL)"""


def r1(x: str) -> str:
    return f"CAST(printf('%.1f', CAST({x} AS DOUBLE)) AS DOUBLE)"


@query(_CV + """ SELECT r.conv_id, count(*) AS raw, count(*) FILTER (WHERE reason IS NULL) AS parsed, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped,
count(*) FILTER (WHERE reason IS NULL) AS invalid_times, count(*) FILTER (WHERE reason IS NULL) AS invalid_timestamps, false AS sort_changed, count(*) FILTER (WHERE role = 'system') AS system_rows FROM raw r GROUP BY r.conv_id""")
def parse_diagnostics(spark, sf_dir: str) -> DataFrame:
    d = messages.diagnostics(td.raw_conversations(spark, sf_dir))
    return d.select("conv_id", "raw", "parsed", "skipped", "invalid_times", "invalid_timestamps", "sort_changed", F.coalesce(F.col("message_types")[messages.SYSTEM], F.lit(0)).cast("long").alias("system_rows"))


@query(_CV + " SELECT reason, count(*) AS n FROM raw WHERE reason IS NOT NULL GROUP BY reason")
def skip_reasons(spark, sf_dir):
    return td.raw_conversations(spark, sf_dir).where(~messages.kept()).groupBy(messages.skip_reason().alias("reason")).agg(F.count("*").alias("n"))


@query(_CV + " SELECT conv_id, turn AS original_index, position, sender FROM p")
def message_positions(spark, sf_dir):
    return td.conversations(spark, sf_dir).select("conv_id", F.col("original_index").cast("long").alias("original_index"), F.col("position").cast("long").alias("position"), "sender")


_TURNS = _CV + """, x AS (SELECT *, CASE WHEN lag(sender) OVER w IS NULL OR lag(sender) OVER w <> sender THEN 1 ELSE 0 END AS f FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY position)),
y AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY position) AS turn_no FROM x),
tt AS (SELECT conv_id, CAST(turn_no AS BIGINT) AS turn, min(sender) AS sender, count(*) AS n_messages, min(position) AS first_position, max(position) AS last_position FROM y GROUP BY conv_id, turn_no)"""


@query(_TURNS + " SELECT * FROM tt")
def speaker_turns(spark, sf_dir):
    return sessions.speaker_turns(td.conversations(spark, sf_dir))


@query(_TURNS + " SELECT conv_id, sender, count(*) AS n_turns FROM tt GROUP BY conv_id, sender")
def turn_starters(spark, sf_dir):
    return sessions.speaker_turns(td.conversations(spark, sf_dir)).groupBy("conv_id", "sender").agg(F.count("*").alias("n_turns"))


@query(_GAP + " SELECT conv_id, idx AS original_index, position, CAST(session AS BIGINT) AS session FROM s")
def gap_sessions(spark, sf_dir):
    return sessions.gap_sessions(td.events(spark, sf_dir)).select("conv_id", "original_index", "position", "session")


@query(_GAP + " SELECT * FROM ss")
def sessions_summary(spark, sf_dir):
    return sessions.session_summary(td.events(spark, sf_dir))


@query(_GAP + ", r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY message_count DESC, session) AS rank, session, message_count FROM ss) SELECT * FROM r WHERE rank <= 10")
def top_sessions(spark, sf_dir):
    return statistics.top_sessions(sessions.session_summary(td.events(spark, sf_dir)))


@query(_GAP + f""" SELECT conv_id, count(*) AS n_sessions, {r1('avg(message_count)')} AS avg_size, {r1('median(message_count)')} AS median_size, {r1('avg(duration_minutes)')} AS avg_minutes, {r1('median(duration_minutes)')} AS median_minutes,
count(*) FILTER (WHERE initiator = 'me') AS initiated_by_me, count(*) FILTER (WHERE closer = 'me') AS closed_by_me FROM ss GROUP BY conv_id""")
def session_size_duration_stats(spark, sf_dir):
    return statistics.session_shape(sessions.session_summary(td.events(spark, sf_dir)))


@query(_EV + f""", d AS (SELECT conv_id, sender, CASE WHEN lag(sender) OVER w <> sender THEN date_diff('second', lag(t) OVER w, t) END AS x FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY position))
SELECT conv_id, sender, count(*) AS n, {r1('avg(x)')} AS avg_seconds, {r1('median(x)')} AS median_seconds FROM d WHERE x > 5 AND x < 7200 GROUP BY conv_id, sender""")
def global_reply_latency(spark, sf_dir):
    return statistics.reply_latency(td.events(spark, sf_dir))


@query(_GAP + f""", e AS (SELECT conv_id, session, sender, {r1('avg(sd)')} AS a FROM d WHERE sd > 5 AND sd < 14400 GROUP BY conv_id, session, sender)
SELECT conv_id, sender, count(*) AS n_sessions, {r1('avg(a)')} AS avg_seconds FROM e GROUP BY conv_id, sender""")
def session_reply_latency(spark, sf_dir):
    return statistics.session_reply_latency(td.events(spark, sf_dir))


_SENDERS = "count(*) AS total, count(*) FILTER (WHERE sender = 'me') AS me, count(*) FILTER (WHERE sender = 'other') AS other"


@query(_EV + f" SELECT conv_id, strftime(t, '%Y-%m-%d') AS day, {_SENDERS} FROM m GROUP BY ALL")
def daily_counts(spark, sf_dir):
    return statistics.daily(td.events(spark, sf_dir))


@query(_EV + f" SELECT conv_id, strftime(t, '%Y-%m') AS month, {_SENDERS} FROM m GROUP BY ALL")
def monthly_trend(spark, sf_dir):
    return statistics.monthly(td.events(spark, sf_dir))


@query(_EV + ", c AS (SELECT conv_id, CAST(hour(t) AS INTEGER) AS hour, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT conv_id, CAST(h AS INTEGER) AS hour FROM (SELECT DISTINCT conv_id FROM m), range(24) r(h)) SELECT b.conv_id, b.hour, coalesce(c.n, 0) AS n FROM b LEFT JOIN c ON b.conv_id = c.conv_id AND b.hour = c.hour")
def hourly_distribution(spark, sf_dir):
    return statistics.hourly(td.events(spark, sf_dir))


@query(_EV + ", c AS (SELECT conv_id, CAST(isodow(t) - 1 AS INTEGER) AS weekday, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT conv_id, CAST(h AS INTEGER) AS weekday FROM (SELECT DISTINCT conv_id FROM m), range(7) r(h)) SELECT b.conv_id, b.weekday, coalesce(c.n, 0) AS n FROM b LEFT JOIN c ON b.conv_id = c.conv_id AND b.weekday = c.weekday")
def weekday_distribution(spark, sf_dir):
    return statistics.weekdays(td.events(spark, sf_dir))


@query(_EV + """, d AS (SELECT conv_id, CAST(t AS DATE) AS day, arg_min(sender, position) AS f, arg_max(sender, position) AS l FROM m GROUP BY ALL)
SELECT conv_id, count(*) FILTER (WHERE f = 'me') AS first_me, count(*) FILTER (WHERE f = 'other') AS first_other, count(*) FILTER (WHERE l = 'me') AS last_me, count(*) FILTER (WHERE l = 'other') AS last_other FROM d GROUP BY conv_id""")
def daily_first_last(spark, sf_dir):
    return statistics.daily_first_last(td.events(spark, sf_dir))


@query(_EV + """, d AS (SELECT conv_id, strftime(t, '%Y-%m-%d') AS day, count(*) AS total, min(position) AS f FROM m GROUP BY ALL), r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY total DESC, f) AS rank, day, total FROM d) SELECT * FROM r WHERE rank <= 10""")
def top_active_days(spark, sf_dir):
    return statistics.top_days(td.events(spark, sf_dir))


@query(_EV + f" SELECT conv_id, {_SENDERS}, count(DISTINCT CAST(t AS DATE)) AS active_days, count(*) FILTER (WHERE hour(t) IN (23, 0, 1, 2, 3, 4)) AS late_night, 0::BIGINT AS emoji, 0::BIGINT AS images, 0::BIGINT AS invalid_times FROM m GROUP BY conv_id")
def conversation_totals(spark, sf_dir):
    return statistics.totals(td.events(spark, sf_dir))


@query(_CV + f" SELECT conv_id, {r1('''coalesce(avg(length(text)) FILTER (WHERE sender = 'me'), 0)''')} AS me_chars, {r1('''coalesce(avg(length(text)) FILTER (WHERE sender = 'other'), 0)''')} AS other_chars FROM p GROUP BY conv_id")
def text_length_by_role(spark, sf_dir):
    return statistics.text_length(td.conversations(spark, sf_dir))


@query(_EV + """, c AS (SELECT conv_id, count(*) AS len, greatest(20, least(40, count(*) // 3)) AS k FROM m GROUP BY conv_id),
i AS (SELECT conv_id, len, k, unnest(range(k)) AS i FROM c WHERE len > k), pick AS (SELECT DISTINCT conv_id, (i * len) // k + 1 AS position FROM i)
SELECT m.conv_id, m.position FROM m JOIN pick USING (conv_id, position) UNION ALL SELECT m.conv_id, m.position FROM m JOIN c USING (conv_id) WHERE len <= k""")
def uniform_text_sample(spark, sf_dir):
    return statistics.uniform_sample(td.events(spark, sf_dir), 20, 40, 3).select("conv_id", "position")


@query(_GAP + """, a AS (SELECT conv_id, session, message_count, row_number() OVER (PARTITION BY conv_id ORDER BY message_count DESC, session) AS z, count(*) OVER (PARTITION BY conv_id) AS n FROM ss),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY session) - 1 AS k FROM a WHERE z > 5),
c AS (SELECT conv_id, session, message_count FROM a WHERE z <= 5 UNION ALL SELECT conv_id, session, message_count FROM b WHERE k % greatest(1, (n - 5) // 10) = 0),
e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY session) AS rank, CAST(session AS BIGINT) AS session, message_count FROM c) SELECT * FROM e WHERE rank <= 15""")
def representative_segments(spark, sf_dir):
    return statistics.representative_segments(sessions.session_summary(td.events(spark, sf_dir)))


_CHUNK = """WITH RECURSIVE d AS (SELECT source AS conv_id, doc_id, CAST(strlen(text) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents),
c AS (SELECT conv_id, position, bytes, 1 AS chunk_index, 1 AS n, bytes + 1 AS held FROM d WHERE position = 1
UNION ALL SELECT d.conv_id, d.position, d.bytes, CASE WHEN c.n >= 1200 OR c.held + d.bytes + 1 > 18000 THEN c.chunk_index + 1 ELSE c.chunk_index END, CASE WHEN c.n >= 1200 OR c.held + d.bytes + 1 > 18000 THEN 1 ELSE c.n + 1 END,
CASE WHEN c.n >= 1200 OR c.held + d.bytes + 1 > 18000 THEN d.bytes + 1 ELSE c.held + d.bytes + 1 END FROM c JOIN d ON c.conv_id = d.conv_id AND d.position = c.position + 1)"""


@query(_CHUNK + " SELECT conv_id, position, bytes, chunk_index FROM c")
def message_chunks(spark, sf_dir):
    return chunks.chunked(td.documents(spark, sf_dir))


@query(_CHUNK + " SELECT conv_id, chunk_index, min(position) AS start_message, max(position) AS end_message, count(*) AS message_count, CAST(sum(bytes + 1) - 1 AS BIGINT) AS transcript_bytes FROM c GROUP BY conv_id, chunk_index")
def chunk_manifest(spark, sf_dir):
    return chunks.manifest(chunks.chunked(td.documents(spark, sf_dir)))


@query(_CHUNK + " SELECT conv_id, count(*) AS n_messages, max(chunk_index)::BIGINT AS n_chunks, true AS complete FROM c GROUP BY conv_id")
def chunk_coverage(spark, sf_dir):
    d = td.documents(spark, sf_dir)
    return chunks.coverage(chunks.manifest(chunks.chunked(d)), d)


@query(_EV + """, x AS (SELECT *, (position - 1) // 200 AS chunk_index, (position - 1) % 200 + 1 AS n FROM m),
y AS (SELECT *, CASE WHEN lag(CAST(t AS DATE)) OVER w IS NULL OR lag(CAST(t AS DATE)) OVER w <> CAST(t AS DATE) THEN '=== ' || strftime(t, '%Y-%m-%d') || ' ===' || chr(10) ELSE '' END AS head FROM x WINDOW w AS (PARTITION BY conv_id, chunk_index ORDER BY position))
SELECT conv_id, chunk_index, string_agg(head || '[m' || n || '] ' || strftime(t, '%H:%M:%S') || CASE WHEN sender = 'me' THEN ' 【我】 ' ELSE ' 【对方】 ' END || event_type, chr(10) ORDER BY position) AS transcript FROM y GROUP BY conv_id, chunk_index""")
def compact_transcript(spark, sf_dir):
    return messages.compact_transcript(td.events(spark, sf_dir).withColumn("chunk_index", F.expr("(position - 1) div 200")))


_GROUND = """WITH h AS (SELECT b.item_id, d.doc_id, len([i FOR i IN range(1, length(d.text) - length(b.text) + 2) IF substr(d.text, CAST(i AS INTEGER), length(b.text)) = b.text]) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
q AS (SELECT b.item_id, coalesce(sum(n), 0)::BIGINT AS candidate_count FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY b.item_id),
st AS (SELECT item_id, candidate_count, CASE WHEN candidate_count = 0 THEN 'unmatched' WHEN candidate_count = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM q)"""


def _grounded(spark, sf_dir):
    """One chunk holds all documents, so any item may occur in any of them; see grounding.anchors for what keeps that small."""
    items = td.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"), F.lit(1).alias("chunk_index"))
    docs = td.table(spark, sf_dir, "documents").select(F.lit(1).alias("chunk_index"), F.col("doc_id").alias("message_id"), F.col("doc_id").alias("position"), F.col("text").alias("content"))
    return grounding.ground(items, docs, ("chunk_index",))


@query(_GROUND + " SELECT * FROM st")
def quote_grounding(spark, sf_dir):
    return _grounded(spark, sf_dir).select(F.col("quote_id").alias("item_id"), "candidate_count", "status")


@query(_GROUND + " SELECT count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'unmatched') AS unmatched, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, 0::BIGINT AS not_applicable FROM st")
def grounding_stats(spark, sf_dir):
    return grounding.status_counts(_grounded(spark, sf_dir))


_ROLES = """WITH e AS (SELECT event_id, value, CASE event_type WHEN 'click' THEN 'events' WHEN 'view' THEN 'relation_signals' WHEN 'purchase' THEN 'counter_evidence' ELSE 'uncertainties' END AS category,
CASE event_id % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'against' ELSE 'mixed' END AS direction, CASE event_id % 5 WHEN 0 THEN 'unmatched' WHEN 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM events),
r AS (SELECT *, CASE WHEN status IN ('unmatched', 'ambiguous') THEN 'quarantine' WHEN category = 'uncertainties' THEN 'uncertainty' WHEN category = 'counter_evidence' OR direction = 'against' THEN 'counter' WHEN direction = 'mixed' THEN 'mixed' ELSE 'support' END AS role FROM e)"""


def _roles(spark, sf_dir):
    e = td.table(spark, sf_dir, "events")
    category = F.when(F.col("event_type") == "click", "events").when(F.col("event_type") == "view", "relation_signals").when(F.col("event_type") == "purchase", "counter_evidence").otherwise("uncertainties")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % n + 1).cast("int"))
    rows = e.select("event_id", "value", category.alias("category"), pick(3, "support", "against", "mixed").alias("direction"), pick(5, "unmatched", "ambiguous", "matched", "matched", "matched").alias("status"))
    return rows.withColumn("role", grounding.role())


@query(_ROLES + " SELECT category, role, count(*) AS n FROM r GROUP BY ALL")
def evidence_roles(spark, sf_dir):
    return _roles(spark, sf_dir).groupBy("category", "role").agg(F.count("*").alias("n"))


@query(_ROLES + ", k AS (SELECT role, event_id, row_number() OVER (PARTITION BY role ORDER BY value DESC NULLS LAST, event_id) AS rank FROM r) SELECT * FROM k WHERE rank <= 10")
def role_topk(spark, sf_dir):
    w = Window.partitionBy("role").orderBy(F.desc_nulls_last("value"), "event_id")
    return _roles(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("role", "event_id", "rank")


def _tf(term: str) -> str:
    return f"len([i FOR i IN range(1, length(l) - {len(term)} + 2) IF substr(l, CAST(i AS INTEGER), {len(term)}) = '{term}'])"


_BM25 = f"""WITH d AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS l, greatest(0, length(lower(coalesce(text, ''))) - 2) AS len FROM documents),
t AS (SELECT *, CASE WHEN contains(l, 'the re') THEN {_tf('the re')} ELSE 0 END AS a, CASE WHEN contains(l, 'tion') THEN {_tf('tion')} ELSE 0 END AS b FROM d),
s AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (WHERE a > 0) AS na, count(*) FILTER (WHERE b > 0) AS nb FROM t),
w AS (SELECT *, CASE WHEN ln((n - na + 0.5) / (na + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - na + 0.5) / (na + 0.5)) END AS ia, CASE WHEN ln((n - nb + 0.5) / (nb + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - nb + 0.5) / (nb + 0.5)) END AS ib FROM s),
x AS (SELECT lang AS role, doc_id, -(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / al))) - (ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM t, w WHERE a > 0 AND b > 0),
k AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY round(score, 9), doc_id) AS rank, doc_id, round(score, 5) AS score FROM x) SELECT * FROM k WHERE rank <= 10"""


def _ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("role").orderBy(F.round("score", 9), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("role", "rank", F.col("id").alias("doc_id"), F.round("score", 5).alias("score"))


def _searchable(spark, sf_dir) -> DataFrame:
    d = td.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("role"), F.lower(F.coalesce("text", F.lit(""))).alias("l"))


@query(_BM25)
def trigram_bm25(spark, sf_dir):
    return _ranked(retrieval.bm25(_searchable(spark, sf_dir), ["the re", "tion"]))


@query(_BM25)
def indexed_bm25(spark, sf_dir):
    """The same search through the trigram index, which is built here and would be kept elsewhere."""
    rows = _searchable(spark, sf_dir)
    return _ranked(retrieval.bm25(rows, ["the re", "tion"], retrieval.postings(rows, "id", "l")))


@query("WITH k AS (SELECT lang AS role, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, doc_id, CAST(NULL AS DOUBLE) AS score FROM documents WHERE contains(lower(text), 'of') AND contains(lower(text), 'pathetic')) SELECT * FROM k WHERE rank <= 20")
def short_literal_search(spark, sf_dir):
    return retrieval.search(td.table(spark, sf_dir, "documents"), "Of pathetic", 20, "doc_id", "text", "lang")


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_MAIL}', '[邮箱]', 'g')) AS masked_md5, regexp_matches(text, '{_MAIL}') AS changed FROM documents")
def redact_documents(spark, sf_dir):
    masked = redaction.masked(F.col("text"), ("email",))
    return td.table(spark, sf_dir, "documents").select("doc_id", F.md5(masked).alias("masked_md5"), F.col("text").rlike(_MAIL).alias("changed"))


_FOUND = f"WITH d AS (SELECT source AS conv_id, doc_id, regexp_extract_all(text, '{_MAIL}') AS xs FROM documents), f AS (SELECT conv_id, doc_id, unnest(xs) AS value, generate_subscripts(xs, 1) AS ix FROM d), g AS (SELECT conv_id, value, min(row(doc_id, ix)) AS first, count(*) AS n FROM f GROUP BY ALL)"


@query(_FOUND + " SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS serial, n FROM g")
def placeholder_serials(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("original_index"), F.xxhash64("text").alias("h"), F.col("text").alias("content"))
    found = redaction.matches(d.join(redaction.patterns(None, d), "conv_id"))
    return redaction.serials(found).where("kind = 'email'").select("conv_id", F.col("key").alias("value"), "serial", "n")


@query(_FOUND + " SELECT conv_id, 'email' AS kind, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY conv_id")
def redaction_counts(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("original_index"), F.col("text").alias("content"))
    return redaction.replacement_counts(redaction.redact(d)).where("kind = 'email'")


@query("SELECT source AS conv_id, doc_id, count(*) OVER (PARTITION BY source, text) AS same_text FROM documents WHERE text <> '' QUALIFY count(*) OVER (PARTITION BY source, text) > 1")
def repetition_counts(spark, sf_dir):
    rows = claims.repeated_texts(td.documents(spark, sf_dir).withColumn("sender", F.lit("me")))
    return rows.where("same_text > 1").select("conv_id", "doc_id", "same_text")


@query("""WITH r AS (SELECT source AS conv_id, text, min(doc_id) AS p, count(*) AS same_text FROM documents WHERE text <> '' GROUP BY ALL HAVING count(*) > 1),
k AS (SELECT conv_id, row_number() OVER w AS note_rank, md5(text) AS text_md5, same_text, sum(strlen(text) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS b FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY length(text) DESC, p)) SELECT conv_id, note_rank, text_md5, same_text FROM k WHERE b <= 4000""")
def repeated_notes(spark, sf_dir):
    rows = claims.repeated_texts(td.documents(spark, sf_dir).withColumn("sender", F.lit("me")))
    return selection.repetition_notes(rows).select("conv_id", "note_rank", F.md5("content").alias("text_md5"), "same_text")


_CTX = _EV + """, c AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR abs(date_diff('second', lag(t) OVER w, t)) > 14400 THEN 1 ELSE 0 END AS f FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY position)),
cs AS (SELECT conv_id, idx, position, sender, t, CAST(sum(f) OVER (PARTITION BY conv_id ORDER BY position) AS BIGINT) AS session FROM c),
tf AS (SELECT *, CASE WHEN lag(sender) OVER w IS NULL OR lag(sender) OVER w <> sender THEN 1 ELSE 0 END AS tf FROM cs WINDOW w AS (PARTITION BY conv_id, session ORDER BY position)),
tn AS (SELECT *, sum(tf) OVER (PARTITION BY conv_id, session ORDER BY position) AS turn FROM tf),
tb AS (SELECT *, min(position) OVER (PARTITION BY conv_id, session) AS sa, max(position) OVER (PARTITION BY conv_id, session) AS sz, min(position) OVER (PARTITION BY conv_id, session, turn) AS ta, max(position) OVER (PARTITION BY conv_id, session, turn) AS tz FROM tn),
aw AS (SELECT conv_id, position, session, coalesce(lag(ta, 16) OVER w, sa) AS "left", coalesce(lead(tz, 16) OVER w, sz) AS "right", idx FROM tb WINDOW w AS (PARTITION BY conv_id, session ORDER BY position)),
an AS (SELECT conv_id, position, session, "left", "right" FROM aw JOIN events ON event_id = idx WHERE event_type = 'purchase')"""


@query(_CTX + " SELECT conv_id, position, session FROM cs")
def context_sessions(spark, sf_dir):
    return sessions.context_sessions(td.events(spark, sf_dir)).select("conv_id", "position", "session")


def _anchored(spark, sf_dir):
    e = td.events(spark, sf_dir)
    return sessions.anchor_windows(e, e.where("type = 'purchase'"))


@query(_CTX + " SELECT * FROM an")
def anchor_windows(spark, sf_dir):
    return _anchored(spark, sf_dir)


@query(_CTX + """, u AS (SELECT *, max("right") OVER (PARTITION BY conv_id, session ORDER BY "left", position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM an),
v AS (SELECT *, sum(CASE WHEN edge IS NULL OR "left" > edge + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY session, "left", position ROWS UNBOUNDED PRECEDING) AS unit FROM u)
SELECT conv_id, CAST(unit AS BIGINT) AS unit, count(*) AS n_anchors, min(position) AS first_anchor, min("left") AS "left", max("right") AS "right" FROM v GROUP BY conv_id, unit""")
def candidate_units(spark, sf_dir):
    return sessions.candidate_units(_anchored(spark, sf_dir))


_PLAN = [("q1", "support", "the RE"), ("q1", "challenge", "idiot"), ("q2", "support", "ciónque"), ("q2", "challenge", "nowhere to be found")]
_PQ = "WITH q(question, direction, query) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _PLAN) + "), h AS (SELECT question, direction, query, source AS conv_id, doc_id FROM q, documents WHERE contains(lower(text), lower(query)))"


def _plan(spark):
    return spark.createDataFrame(_PLAN, "question string, direction string, query string")


def _hits(spark, sf_dir):
    return retrieval.proposition_hits(_plan(spark), td.table(spark, sf_dir, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("position"), F.col("text").alias("content")))


@query(_PQ + " SELECT question, direction, query, conv_id, doc_id AS position FROM h")
def proposition_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


_IDF = ", w AS (SELECT q.question, q.direction, q.query, count(h.doc_id) AS hits FROM q LEFT JOIN h ON q.question = h.question AND q.direction = h.direction AND q.query = h.query GROUP BY ALL)"


@query(_PQ + _IDF + " SELECT question, direction, query, hits, round(ln(1 + (SELECT count(*) FROM documents) / greatest(1, hits)), 6) AS weight FROM w")
def query_idf(spark, sf_dir):
    total = td.table(spark, sf_dir, "documents").count()
    return retrieval.query_weights(_plan(spark), _hits(spark, sf_dir), total).withColumn("weight", F.round("weight", 6))


_SEEN = ", b AS (SELECT h.*, sum(n_chars) OVER (PARTITION BY question, direction, query ORDER BY h.doc_id) AS held FROM h JOIN documents d ON d.doc_id = h.doc_id AND d.source = h.conv_id), v AS (SELECT question, direction, query, count(*) AS n FROM b WHERE held <= 40000 GROUP BY ALL)"


@query(_PQ + _IDF + _SEEN + " SELECT w.question, w.direction, w.query, hits, coalesce(n, 0) AS included_hits, CASE WHEN hits = 0 THEN 'no_match' WHEN coalesce(n, 0) >= hits THEN 'selected' WHEN coalesce(n, 0) > 0 THEN 'partially_selected' ELSE 'budget_exceeded' END AS status FROM w LEFT JOIN v ON w.question = v.question AND w.direction = v.direction AND w.query = v.query")
def query_status(spark, sf_dir):
    """What is visible: a query's hits in order, while their texts have at most 40,000 characters together."""
    hits = _hits(spark, sf_dir)
    weights = retrieval.query_weights(_plan(spark), hits, 1).drop("weight")
    sizes = td.table(spark, sf_dir, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("position"), "n_chars")
    w = Window.partitionBy("question", "direction", "query").orderBy("position")
    return retrieval.query_status(weights, hits.join(sizes, ["conv_id", "position"]).withColumn("held", F.sum("n_chars").over(w)).where("held <= 40000"))


_COV = """WITH c AS (SELECT o_custkey AS claim_id, count(DISTINCT o_orderkey) AS n_positions, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n_sessions, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS INTEGER) AS span_days FROM orders GROUP BY o_custkey)"""


def _covered(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    return claims.coverage(o.select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("position"), F.to_date("o_orderdate").alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("session")))


@query(_COV + " SELECT * FROM c")
def claim_coverage(spark, sf_dir):
    return _covered(spark, sf_dir)


@query(_COV + " SELECT claim_id, CASE WHEN n_days >= 3 AND n_sessions >= 3 AND span_days >= 30 THEN 'long_term' WHEN n_days >= 2 AND n_sessions >= 2 THEN 'repeated' ELSE 'local' END AS scope FROM c")
def claim_scope(spark, sf_dir):
    return _covered(spark, sf_dir).select("claim_id", claims.widest_scope().alias("scope"))


@query(_EV + ", p AS (SELECT a.conv_id, a.position AS from_position, b.position AS to_position, a.t AS x, b.t AS y FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.position = a.position + 3) SELECT conv_id, from_position, to_position, CAST(date_diff('day', CAST(x AS DATE), CAST(y AS DATE)) AS INTEGER) AS days, date_diff('second', x, y) AS seconds, true AS forward FROM p")
def time_links(spark, sf_dir):
    e = td.events(spark, sf_dir)
    return claims.time_links(e.select("conv_id", F.col("position").alias("from_position"), (F.col("position") + 3).alias("to_position")), e)


_REF = "WITH i AS (SELECT DISTINCT sha256(CAST(doc_id AS VARCHAR)) AS id FROM documents), r AS (SELECT DISTINCT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2 + CAST(doc_id % 5 AS INTEGER)) AS ref FROM documents UNION SELECT 'zz' || CAST(doc_id % 3 AS VARCHAR) FROM documents)"


@query(_REF + ", g AS (SELECT r.ref, count(i.id) AS n, min(i.id) AS one FROM r LEFT JOIN i ON starts_with(i.id, r.ref) GROUP BY r.ref) SELECT ref, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one END AS id FROM g")
def reference_prefix_resolve(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("id"))
    refs = d.select(F.expr("substring(id, 1, cast(2 + doc_id % 5 as int))").alias("ref")).union(d.select(F.concat(F.lit("zz"), (F.col("doc_id") % 3).cast("string"))))
    return retrieval.resolve(refs, d)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_missing_chunks(spark, sf_dir):
    return chunks.missing(td.table(spark, sf_dir, "documents").select("doc_id"), td.table(spark, sf_dir, "labels").select("doc_id"))


_GOLD = """WITH g AS (SELECT d.doc_id, d.lang AS dim, d.source AS profile, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(d.n_chars % 3 AS INTEGER) END AS gold, CAST(l.quality + l.toxic AS INTEGER) AS pred FROM documents d LEFT JOIN labels l USING (doc_id))"""
_M3 = """count(*) FILTER (WHERE gold = pred) AS tp, count(*) FILTER (WHERE pred IS NOT NULL AND (gold IS NULL OR gold <> pred)) AS fp, count(*) FILTER (WHERE gold IS NOT NULL AND (pred IS NULL OR gold <> pred)) AS fn, count(gold) AS known,
count(*) FILTER (WHERE gold IS NOT NULL AND pred IS NOT NULL) AS answered, count(*) FILTER (WHERE gold <> pred) AS wrong, count(*) FILTER (WHERE gold IS NOT NULL AND pred IS NULL) AS silent, count(*) FILTER (WHERE gold IS NULL AND pred IS NOT NULL) AS told, count(*) FILTER (WHERE gold IS NULL) AS open,
sum(CASE WHEN gold IS NOT NULL THEN coalesce(abs(gold - pred) / 2.0, 1.0) END) AS penalty, avg(abs(gold - pred) / 2.0) AS mc"""
_M4 = """tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS micro_f1, round(answered / nullif(known, 0), 6) AS coverage, round(wrong / nullif(answered, 0), 6) AS mismatch, round(told / nullif(open, 0), 6) AS unanswerable_assertion,
round(tp / nullif(tp + fp + fn, 0), 6) AS jaccard, round((2 * wrong + silent) / nullif(known * 3, 0), 6) AS hamming, round(CAST(mc AS DOUBLE), 6) AS mae_covered, round(CAST(penalty AS DOUBLE) / known, 6) AS mae_penalised, round((2 * tp / (2 * tp + fp + fn) + 1 - CAST(penalty AS DOUBLE) / known) / 2, 6) AS coupling"""


def _labelled(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents")
    gold = F.when(F.col("doc_id") % 11 != 0, (F.col("n_chars") % 3).cast("int"))
    plan = d.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("dim"), F.col("source").alias("profile"), gold.alias("gold"))
    pred = td.table(spark, sf_dir, "labels").join(d.select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("dim"), (F.col("quality") + F.col("toxic")).cast("int").alias("pred"))
    return scoring.planned(plan, pred)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_GOLD + f", t AS (SELECT {_M3} FROM g) SELECT {_M4} FROM t")
def planned_rows_score(spark, sf_dir):
    return _rounded(scoring.scores(_labelled(spark, sf_dir)))


@query(_GOLD + f", t AS (SELECT dim, {_M3} FROM g GROUP BY dim) SELECT dim, {_M4} FROM t")
def per_dimension(spark, sf_dir):
    return _rounded(scoring.scores(_labelled(spark, sf_dir), "dim"))


@query(_GOLD + """, b AS (SELECT * FROM g WHERE gold IS NOT NULL AND pred IS NOT NULL), o AS (SELECT dim, count(*) AS n, sum((gold - pred) * (gold - pred)) AS seen FROM b GROUP BY dim),
c AS (SELECT x.dim, sum((x.gold - y.pred) * (x.gold - y.pred)) AS chance FROM b x JOIN b y ON x.dim = y.dim GROUP BY x.dim) SELECT o.dim, n, CASE WHEN chance <> 0 THEN round(1 - CAST(seen AS DOUBLE) * n / CAST(chance AS DOUBLE), 6) END AS kappa FROM o JOIN c USING (dim)""")
def weighted_kappa(spark, sf_dir):
    return _rounded(scoring.kappa(_labelled(spark, sf_dir), "dim"))


_USE = "WITH u AS (SELECT event_type AS stage, 'model' || CAST(event_id % 3 AS VARCHAR) AS model, CASE WHEN event_id % 4 <> 0 THEN event_id % 1000 END AS p, CASE WHEN event_id % 4 <> 0 THEN event_id % 100 END AS c, CASE WHEN event_id % 5 <> 0 AND event_id % 4 <> 0 THEN (event_id % 1000) // 2 END AS h FROM events)"


@query(_USE + " SELECT stage, model, CAST(grouping(stage) AS INTEGER) AS g_stage, CAST(grouping(model) AS INTEGER) AS g_model, count(*) AS requests, count(p + c) AS known, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens, CAST(sum(h) AS BIGINT) AS prompt_cache_hit_tokens, round(sum(h) FILTER (WHERE p IS NOT NULL) / nullif(sum(p) FILTER (WHERE h IS NOT NULL), 0), 4) AS cache_hit_rate FROM u GROUP BY GROUPING SETS ((), (stage), (model))")
def usage_rollup(spark, sf_dir):
    from ..operators import usage

    e = td.table(spark, sf_dir, "events")
    p, c = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 1000), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100)
    h = F.when((F.col("event_id") % 5 != 0) & (F.col("event_id") % 4 != 0), F.expr("event_id % 1000 div 2"))
    log = e.select(F.col("event_type").alias("stage"), F.concat(F.lit("model"), (F.col("event_id") % 3).cast("string")).alias("model"), F.struct(p.cast("string").alias("prompt_tokens"), c.cast("string").alias("completion_tokens"), (p + c).cast("string").alias("total_tokens"), h.cast("string").alias("prompt_cache_hit_tokens"), F.lit(None).cast("string").alias("prompt_cache_miss_tokens"), F.lit("x").alias("reasoning_tokens")).alias("usage"))
    out = usage.rollup(usage.normalised(log))
    return out.select("stage", "model", F.col("g_stage").cast("int").alias("g_stage"), F.col("g_model").cast("int").alias("g_model"), "requests", "known", "prompt_tokens", "total_tokens", "prompt_cache_hit_tokens", "cache_hit_rate")


@query("""WITH d AS (SELECT source AS conv_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT conv_id, doc_id FROM d WHERE n <= 9 OR list_contains([CAST(round_even(i * (n - 1) / 8.0, 0) AS BIGINT) FOR i IN range(9)], r)""")
def evenly_spaced_items(spark, sf_dir):
    return grounding.evenly_spaced(td.table(spark, sf_dir, "documents").select(F.col("source").alias("conv_id"), "doc_id"), 9, "doc_id")


_BAL = """WITH i AS (SELECT conv_id, (position - 1) // 10 AS chunk_index, (position - 1) % 10 AS depth, position FROM (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS position FROM events WHERE user_id IS NOT NULL) z WHERE (position % 10) < 1 + (position // 10) % 7 OR (position - 1) % 10 < 2),
a AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY chunk_index) - 1 AS g FROM i), b AS (SELECT *, max(g) OVER (PARTITION BY conv_id) + 1 AS n FROM a),
c AS (SELECT * FROM b WHERE n <= 12 OR list_contains([CAST(round_even(k * (n - 1) / 11.0, 0) AS BIGINT) FOR k IN range(12)], g)),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, depth ORDER BY chunk_index) - 1 AS ix, count(*) OVER (PARTITION BY conv_id, depth) AS o FROM c),
z AS (SELECT conv_id, depth, count(*) AS k FROM c GROUP BY ALL), y AS (SELECT conv_id, depth, 12 - coalesce(sum(k) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM z)
SELECT l.conv_id, l.chunk_index, l.depth FROM l JOIN y USING (conv_id, depth) WHERE room > 0 AND (o <= room OR (room = 1 AND ix = (o - 1) // 2) OR (room > 1 AND list_contains([CAST(round_even(k * (o - 1) / CAST(room - 1 AS DOUBLE), 0) AS BIGINT) FOR k IN range(CAST(room AS BIGINT))], ix)))"""


@query(_BAL)
def balanced_items(spark, sf_dir):
    e = td.events(spark, sf_dir).where("(position % 10) < 1 + (position div 10) % 7 or (position - 1) % 10 < 2")
    items = e.select("conv_id", F.expr("(position - 1) div 10").alias("chunk_index"), ((F.col("position") - 1) % 10).cast("long").alias("depth"))
    return grounding.balanced(items, 12).select("conv_id", "chunk_index", "depth")


@query()
def bootstrap_interval(spark, sf_dir):
    """No SQL form: the draws come from a seeded generator."""
    rows = _labelled(spark, sf_dir)
    return scoring.bootstrap_f1(rows, scoring.drawn_weights(rows.select("profile")))


@query()
def redacted_messages(spark, sf_dir):
    """No SQL form: numbers follow the order of a conversation and eight pattern families."""
    d = td.table(spark, sf_dir, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("original_index"), F.col("text").alias("content"))
    return redaction.redact(d).select("conv_id", "original_index", F.sha2("content", 256).alias("content_sha256"), F.size("replaced").alias("n_kinds"))


@query("SELECT CAST(dayofmonth(ts) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY ALL")
def label_check(spark, sf_dir):
    t = times.parse_time(F.date_format("ts", "yyyy-M-d H:m:s"))
    return td.table(spark, sf_dir, "events").groupBy(F.dayofmonth(t).alias("day")).agg(F.count("*").alias("n"))
