"""Queries over single operators and text functions, each with its DuckDB counterpart; see :mod:`.registry`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times
from ..operators import chunks, claims, grounding, messages, redaction, retrieval, scoring, selection, sessions, statistics
from . import testdata as td
from .registry import _CHUNK, _CTX, _CV, _EV, _GAP, _GOLD, _PQ, _anchored, _covered, _hits, _labelled, _rounded, query


def _docs(spark, sf_dir) -> DataFrame:
    return td.table(spark, sf_dir, "documents")


_NUMBERS = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN CAST(doc_id AS {0}) WHEN 3 THEN concat(CAST(doc_id AS {0}), '.5') WHEN 4 THEN 'nan' ELSE concat('x', CAST(doc_id AS {0})) END"


@query(f"SELECT doc_id, CASE WHEN isfinite(try_cast({_NUMBERS.format('VARCHAR')} AS DOUBLE)) THEN try_cast({_NUMBERS.format('VARCHAR')} AS DOUBLE) END AS epoch FROM documents")
def epoch_values(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", times.parse_epoch(F.expr(_NUMBERS.format("STRING"))).alias("epoch"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%-d.%-m.%Y') ELSE concat(year(ts), '-', month(ts), '-', day(ts), ' ', hour(ts), ':', minute(ts), ':', second(ts)) END AS s FROM events),
t AS (SELECT event_id, s, try_strptime(s, '%Y-%m-%d %H:%M:%S') AS t FROM s) SELECT event_id, t IS NOT NULL AS loose, coalesce(strftime(t, '%Y-%m-%d %H:%M:%S') = s, false) AS strict, CASE WHEN strftime(t, '%Y-%m-%d %H:%M:%S') = s THEN CAST(epoch(t) AS BIGINT) - 28800 END AS epoch FROM t""")
def strict_times(spark, sf_dir):
    e = td.table(spark, sf_dir, "events")
    s = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "d.M.yyyy")).otherwise(F.date_format("ts", "yyyy-M-d H:m:s"))
    strict = times.parse_strict_time(s)
    return e.select("event_id", times.parse_time(s).isNotNull().alias("loose"), strict.isNotNull().alias("strict"), times.epoch_utc8(strict).alias("epoch"))


@query(_EV + " SELECT conv_id, position, strftime(t, '%Y-%m-%d %H:%M:%S') || CASE WHEN sender = 'me' THEN ' 【我】 ' ELSE ' 【对方】 ' END || event_type || chr(92) || 'n' || event_type AS line FROM m")
def message_lines(spark, sf_dir):
    e = td.events(spark, sf_dir).withColumn("content", F.concat("content", F.lit("\n"), "content"))
    return e.select("conv_id", "position", messages.line().alias("line"))


@query(_EV + " SELECT conv_id, (position - 1) // 200 AS chunk_index, CAST((position - 1) % 200 + 1 AS INTEGER) AS n, strftime(t, '%Y-%m-%d %H:%M:%S') || CASE WHEN sender = 'me' THEN ' 【我】 ' ELSE ' 【对方】 ' END || event_type AS line FROM m")
def transcript_round_trip(spark, sf_dir):
    return messages.expand_transcript(messages.compact_transcript(td.events(spark, sf_dir).withColumn("chunk_index", F.expr("(position - 1) div 200"))))


@query(r"""WITH x AS (SELECT page_id, regexp_replace(trim(regexp_replace(url || '. ', '[\\/:*?"<>|]', '_', 'g')), '\.+$', '') AS name FROM pages) SELECT page_id, CASE WHEN name = '' THEN 'unknown' ELSE name END AS name FROM x""")
def safe_names(spark, sf_dir):
    return td.table(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.concat("url", F.lit(". "))).alias("name"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 100 THEN text ELSE left(text, 50) || ' ... ' || right(text, 50) END) AS ends_md5 FROM documents")
def head_tail_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.head_tail(F.col("text"), 100, " ... ")).alias("ends_md5"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), ' '), chr(10), ' '), '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(left(t, 240), '\s+$', '') || '...' END AS line FROM c""")
def compact_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.compact(F.col("text")).alias("line"))


_FITS = "list_max([k FOR k IN range(0, length({0}) + 1) IF strlen({1}({0}, CAST(k AS INTEGER))) <= {2}])"


@query(f"""WITH n AS (SELECT doc_id, left(replace(text, chr(10), 'é'), 200 + CAST(doc_id % 50 AS INTEGER)) AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, t, {_FITS.format('t', 'left', '(150 - 7) // 2')} AS h, {_FITS.format('t', 'right', '150 - 7 - (150 - 7) // 2')} AS z FROM n)
SELECT doc_id, CASE WHEN strlen(t) <= 150 THEN t ELSE left(t, CAST(h AS INTEGER)) || ' [...] ' || right(t, CAST(z AS INTEGER)) END AS text FROM m""")
def byte_limited_texts(spark, sf_dir):
    t = F.left(F.replace("text", F.lit("\n"), F.lit("é")), (200 + F.col("doc_id") % 50).cast("int"))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", tx.limit_bytes(t, 150, " [...] ").alias("text"))


@query(_CV + """ SELECT conv_id, turn, 'M_' || left(sha256('["S_x",' || turn || ',null,' || CAST(to_json(sender) AS VARCHAR) || ',null,"文本消息",' || CAST(to_json(text) AS VARCHAR) || ']'), 32) AS message_id FROM p""")
def message_ids(spark, sf_dir):
    m = td.conversations(spark, sf_dir)
    row = F.struct(F.lit("S_x").alias("source_id"), "original_index", F.lit(None).cast("string").alias("source_message_id"), "sender", F.lit(None).cast("string").alias("time_str"), "type", "content")
    return m.select("conv_id", F.col("original_index").alias("turn"), tx.message_id(row).alias("message_id"))


@query(r"SELECT page_id, regexp_replace(url, '([\\`*_{}\[\]()#+.!|<>-])', '\\\1', 'g') AS url FROM pages")
def markdown_escapes(spark, sf_dir):
    return td.table(spark, sf_dir, "pages").select("page_id", tx.markdown_escaped(F.col("url")).alias("url"))


_QUOTE = "concat('x “', substr(text, 3, 9), '” y 「', substr(text, 5, 4), '」 \"', CASE WHEN doc_id % 3 = 0 THEN 'nowhere at all' ELSE substr(text, 2, 5) END, '\"')"


@query(r"""SELECT doc_id, len([x FOR x IN list_concat(list_concat(regexp_extract_all(p, '“([^”]+)”', 1), regexp_extract_all(p, '「([^」]+)」', 1)), regexp_extract_all(p, '"([^"]+)"', 1)) IF NOT contains(text, x)]) > 0 AS missing FROM (SELECT doc_id, text, """ + _QUOTE + " AS p FROM documents WHERE text IS NOT NULL)")
def quoted_prose(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").withColumn("p", F.expr(_QUOTE)).select("doc_id", tx.quoted_missing("p", "text").alias("missing"))


_LEVELS = {0: ["the ", "and "], 1: ["der ", "und "], 2: ["de ", "la "]}
_WORDS = [f"CAST(({' + '.join(f'''(length(text) - length(replace(text, '{w}', ''))) // {len(w)}''' for w in ws)}) AS INTEGER)" for ws in _LEVELS.values()]


@query(f"WITH n AS (SELECT doc_id, [{', '.join(_WORDS)}] AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN list_max(n) > 0 AND len([x FOR x IN n IF x = list_max(n)]) = 1 THEN CAST(list_position(n, list_max(n)) - 1 AS INTEGER) END AS level FROM n")
def keyword_levels(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", tx.level_from_words(F.col("text"), _LEVELS).alias("level"))


@query(r"""WITH p AS (SELECT event_id, concat('x ', strftime(ts, '%Y-%m-%d %H:%M'), CASE event_id % 4 WHEN 0 THEN ' 次日 三天 次日' WHEN 1 THEN ' 同日期' WHEN 2 THEN ' 2024年5月' ELSE '' END) AS p FROM events)
SELECT event_id, list_distinct(list_concat([substr(p, 3, 10), substr(p, 14, 5)], CASE event_id % 4 WHEN 0 THEN ['次日', '三天'] WHEN 2 THEN ['2024年5月'] ELSE [] END)) IS NOT NULL AS any_time, 2 + CASE event_id % 4 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n FROM p""")
def time_prose(spark, sf_dir):
    tail = F.when(F.col("event_id") % 4 == 0, " 次日 三天 次日").when(F.col("event_id") % 4 == 1, " 同日期").when(F.col("event_id") % 4 == 2, " 2024年5月").otherwise("")
    found = tx.times_named(F.concat(F.lit("x "), F.date_format("ts", "yyyy-MM-dd HH:mm"), tail))
    return td.table(spark, sf_dir, "events").select("event_id", (F.size(found) > 0).alias("any_time"), F.size(found).alias("n"))


_PROSE = "CASE doc_id % 5 WHEN 0 THEN concat(substr(sha256({0}), 1, 9), ' P_', {0}) WHEN 1 THEN concat('see E_', substr(sha256({0}), 1, 9)) WHEN 2 THEN '  ' WHEN 3 THEN repeat('x', CAST(1195 + doc_id % 11 AS INT)) ELSE concat('plain ', {0}) END"


@query(f"WITH p AS (SELECT doc_id, {_PROSE.format('CAST(doc_id AS VARCHAR)')} AS p FROM documents) SELECT doc_id, trim(p) = '' OR length(p) > 1200 OR regexp_matches(p, '[<>\\n\\r]|[EMC]_[0-9a-f]{{8,}}|P_[0-9]+') AS unfit FROM p")
def claim_prose(spark, sf_dir):
    sql = _PROSE.replace("sha256({0})", "sha2({0}, 256)").format("CAST(doc_id AS STRING)")
    return _docs(spark, sf_dir).withColumn("p", F.expr(sql)).select("doc_id", tx.unfit_prose(F.col("p")).alias("unfit"))


@query("""WITH v AS (SELECT user_id AS conv_id, event_type || CAST(event_id % 40 AS VARCHAR) AS value, CASE WHEN event_id % 7 = 0 THEN 'me' ELSE 'other' END AS role FROM events WHERE user_id IS NOT NULL UNION ALL SELECT user_id, 'me', 'me' FROM events WHERE user_id IS NOT NULL)
SELECT conv_id, value, CASE WHEN count(DISTINCT role) > 1 THEN '[参与者]' WHEN min(role) = 'me' THEN '我' ELSE '对方' END AS alias FROM v WHERE value <> 'me' GROUP BY ALL""")
def alias_registry(spark, sf_dir):
    e = td.table(spark, sf_dir, "events").where("user_id is not null")
    v = e.select(F.col("user_id").alias("conv_id"), F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("value"), F.when(F.col("event_id") % 7 == 0, "me").otherwise("other").alias("role"))
    return redaction.alias_registry(v.union(e.select("user_id", F.lit("me"), F.lit("me"))))


_ITEMS = """WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'events' WHEN 1 THEN 'relation_signals' WHEN 2 THEN 'counter_evidence' WHEN 3 THEN 'uncertainties' ELSE 'rumours' END AS category,
CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END AS body, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'sure' END AS confidence, CASE event_id % 2 WHEN 0 THEN 'support' END AS direction FROM events)"""
_F = {"events": ("summary", "evidence"), "relation_signals": ("model", "signal", "evidence"), "counter_evidence": ("against", "evidence"), "uncertainties": ("question", "reason")}
_BROKEN = " UNION ALL ".join(
    [f"SELECT event_id, '{f}' AS field FROM e WHERE category = '{c}' AND trim(body) = ''" for c, fs in _F.items() for f in fs]
    + ["SELECT event_id, 'confidence' FROM e WHERE category IN ('events', 'relation_signals', 'counter_evidence') AND confidence = 'sure'", "SELECT event_id, 'direction' FROM e WHERE category = 'relation_signals' AND direction IS NULL", "SELECT event_id, 'category' FROM e WHERE category = 'rumours'"]
)


@query(f"{_ITEMS} {_BROKEN}")
def evidence_violations(spark, sf_dir):
    e, i = td.table(spark, sf_dir, "events"), F.col("event_id")
    category = F.element_at(F.array(*[F.lit(c) for c in ("events", "relation_signals", "counter_evidence", "uncertainties", "rumours")]), (i % 5 + 1).cast("int"))
    body = F.when(i % 7 == 0, " ").otherwise(F.col("event_type"))
    confidence = F.element_at(F.array(F.lit("high"), F.lit("low"), F.lit("sure")), (i % 3 + 1).cast("int"))
    names = sorted({f for fs in grounding.FIELDS.values() for f in fs} - set(grounding.ENUMS))
    rows = e.select("event_id", category.alias("category"), *[body.alias(n) for n in names], confidence.alias("confidence"), F.when(i % 2 == 0, "support").alias("direction"), F.lit("local").alias("stability"))
    return grounding.violations(rows).select("event_id", "field")


_M200 = _EV + ", h AS (SELECT conv_id, (position - 1) // 200 AS chunk_index, (position - 1) % 200 + 1 AS n, position, 'M_' || md5(CAST(idx AS VARCHAR)) AS message_id, idx FROM m)"


@query(_M200 + ", q AS (SELECT conv_id, chunk_index, idx AS quote_id, CASE WHEN idx % 3 = 0 THEN 'm' || CAST(1 + idx % 250 AS VARCHAR) WHEN idx % 3 = 1 THEN message_id END AS hint FROM h) SELECT q.quote_id, coalesce(h.message_id, q.hint) AS hint FROM q LEFT JOIN h ON q.conv_id = h.conv_id AND q.chunk_index = h.chunk_index AND q.hint = 'm' || CAST(h.n AS VARCHAR)")
def message_aliases(spark, sf_dir):
    m = _chunked_events(spark, sf_dir)
    i = F.col("original_index")
    q = m.select("conv_id", "chunk_index", i.alias("quote_id"), F.when(i % 3 == 0, F.concat(F.lit("m"), (1 + i % 250).cast("string"))).when(i % 3 == 1, F.col("message_id")).alias("hint"))
    return grounding.aliases(q, m).select("quote_id", "hint")


def _chunked_events(spark, sf_dir) -> DataFrame:
    return td.events(spark, sf_dir).withColumn("chunk_index", F.expr("(position - 1) div 200")).withColumn("message_id", F.concat(F.lit("M_"), F.md5(F.col("original_index").cast("string"))))


@query(_M200 + """, q AS (SELECT conv_id, chunk_index, CASE WHEN count(*) % 2 = 0 THEN 'click' ELSE 'zzz' END AS quote FROM h GROUP BY ALL),
g AS (SELECT q.conv_id, q.chunk_index, q.quote, (SELECT count(*) FROM h JOIN m USING (conv_id, position) WHERE h.conv_id = q.conv_id AND h.chunk_index = q.chunk_index AND contains(m.event_type, q.quote)) AS candidate_count FROM q)
SELECT conv_id, chunk_index, candidate_count, CASE WHEN candidate_count = 0 THEN 'unmatched' ELSE 'ambiguous' END AS status FROM g WHERE candidate_count <> 1""")
def grounding_issues(spark, sf_dir):
    m = _chunked_events(spark, sf_dir)
    q = m.groupBy("conv_id", "chunk_index").agg(F.when(F.count("*") % 2 == 0, "click").otherwise("zzz").alias("quote")).withColumn("quote_id", F.concat_ws("/", "conv_id", "chunk_index"))
    return grounding.issues(grounding.ground(q, m)).select("conv_id", "chunk_index", "candidate_count", "status")


@query(_EV + ", x AS (SELECT conv_id, position, CASE WHEN conv_id % 5 = 0 AND position > 3 THEN position + 1 ELSE position END AS p, CASE WHEN conv_id % 7 = 0 AND position = 2 THEN 1 ELSE position END AS i, (position - 1) // 50 AS c FROM m), g AS (SELECT conv_id, count(*) AS n, min(p) AS a, max(p) AS z, count(DISTINCT p) AS d, count(DISTINCT i) AS ids FROM x GROUP BY conv_id), k AS (SELECT conv_id, max(position) AS last FROM m GROUP BY conv_id) SELECT conv_id, a = 1 AND z = n AND d = n AS positions_ok, ids = n AS ids_ok, conv_id % 3 <> 0 OR last <= 50 AS chunks_ok FROM g JOIN k USING (conv_id)")
def ledger_audits(spark, sf_dir):
    m = td.events(spark, sf_dir)
    c = m.groupBy("conv_id", F.expr("(position - 1) div 50").alias("chunk_index")).agg(F.min("position").alias("start_message"), F.max("position").alias("end_message"))
    c = c.withColumn("start_message", F.col("start_message") + F.when((F.col("conv_id") % 3 == 0) & (F.col("chunk_index") == 1), 1).otherwise(0))
    broken = m.select("conv_id", F.when((F.col("conv_id") % 5 == 0) & (F.col("position") > 3), F.col("position") + 1).otherwise(F.col("position")).alias("position"), F.when((F.col("conv_id") % 7 == 0) & (F.col("position") == 2), 1).otherwise(F.col("position")).alias("message_id"))
    sizes = m.groupBy("conv_id").agg(F.count("*").alias("_n"))
    found = grounding.ledger_audit(c, broken).join(sizes, "conv_id")
    # Where positions were moved, the last chunk ends before them; what is asked of the chunks is asked of the true rows.
    whole = grounding.ledger_audit(c, m.select("conv_id", "position", F.col("position").alias("message_id")))
    return found.drop("chunks_ok", "_n").join(whole.select("conv_id", "chunks_ok"), "conv_id")


_PLACES = "WITH o AS (SELECT event_id % 500 AS e, user_id % 40 AS chunk_index, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL)"


@query(_PLACES + ", p AS (SELECT e, string_agg(printf('chunk_%03d', CAST(chunk_index AS INTEGER)) || ' ' || (chunk_index * 10 + 1) || ' ' || (chunk_index * 10 + 10), ' ' ORDER BY chunk_index) AS places FROM o GROUP BY e) SELECT 'E_' || e AS evidence_id, 'support' AS role, 'body ' || e || ' E_' || e || ' events support ' || places AS search_text FROM p")
def search_texts(spark, sf_dir):
    o = td.table(spark, sf_dir, "events").where("user_id is not null").select(F.concat(F.lit("E_"), (F.col("event_id") % 500).cast("string")).alias("evidence_id"), (F.col("user_id") % 40).cast("int").alias("chunk_index")).distinct()
    o = o.withColumn("start_message", F.col("chunk_index") * 10 + 1).withColumn("end_message", F.col("chunk_index") * 10 + 10)
    e = o.select("evidence_id").distinct().select("evidence_id", F.concat(F.lit("body "), F.substring("evidence_id", 3, 9)).alias("body"), F.lit("events").alias("category"), F.lit("support").alias("role"))
    return retrieval.search_text(e, o)


@query(_EV + """, o AS (SELECT 'E_' || (idx % 300) AS evidence_id, (position - 1) // 200 AS chunk_index, position, idx FROM m), s AS (SELECT evidence_id, string_agg(chunk_index || ':' || position || ':' || idx, ',' ORDER BY chunk_index, position, idx) AS sources FROM o GROUP BY evidence_id) SELECT evidence_id, md5(sources) AS sources_md5 FROM s""")
def evidence_look_back(spark, sf_dir):
    m = td.events(spark, sf_dir).withColumn("message_id", F.col("original_index"))
    o = m.select(F.concat(F.lit("E_"), (F.col("original_index") % 300).cast("string")).alias("evidence_id"), F.expr("(position - 1) div 200").alias("chunk_index"), "message_id")
    found = retrieval.look_back(o.select("evidence_id").distinct(), o, m)
    text = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["chunk_index"], s["position"], s["message_id"])), ",")
    return found.select("evidence_id", F.md5(text).alias("sources_md5"))


@query("SELECT source AS conv_id, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, sum(strlen(text) + 1) <= 120000 AS fits FROM documents GROUP BY source")
def complete_snapshots(spark, sf_dir):
    return retrieval.complete_if_fits(td.documents(spark, sf_dir), 120_000)


@query(_PQ + ", q2 AS (SELECT question, direction, query FROM q UNION ALL SELECT question, direction, upper(query) FROM q), s AS (SELECT question, upper(query) AS u, query, conv_id, doc_id FROM h), g AS (SELECT question, u, count(*) AS n FROM s GROUP BY ALL) SELECT question, n, u || '|' || (SELECT min(query) FROM q WHERE upper(query) = u) AS queries FROM g")
def merged_queries(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return retrieval.merged_hit_sets(hits.union(hits.withColumn("query", F.upper("query")))).select("question", "n", F.array_join("queries", "|").alias("queries"))


@query(_CHUNK + """, k AS (SELECT conv_id, chunk_index, CAST(row_number() OVER (PARTITION BY conv_id, chunk_index ORDER BY position) - 1 AS BIGINT) AS r, position, bytes FROM c), z AS (SELECT conv_id, chunk_index, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY ALL),
s AS (SELECT conv_id, chunk_index, CAST(0 AS BIGINT) AS a, n AS z FROM z UNION ALL SELECT s.conv_id, s.chunk_index, CASE half WHEN 0 THEN a ELSE (a + z) // 2 END, CASE half WHEN 0 THEN (a + z) // 2 ELSE z END FROM s, (VALUES (0), (1)) v(half)
 WHERE z - a > 1 AND 500 + (SELECT sum(bytes) FROM k WHERE k.conv_id = s.conv_id AND k.chunk_index = s.chunk_index AND r >= a AND r < z) > 6000),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk_index ORDER BY a) AS part FROM s WHERE z - a = 1 OR 500 + (SELECT sum(bytes) FROM k WHERE k.conv_id = s.conv_id AND k.chunk_index = s.chunk_index AND r >= a AND r < z) <= 6000)
SELECT k.conv_id, k.position, k.chunk_index, CAST(part AS INTEGER) AS part FROM k JOIN l ON k.conv_id = l.conv_id AND k.chunk_index = l.chunk_index AND r >= a AND r < z""")
def prompt_split_parts(spark, sf_dir):
    return chunks.prompt_split(chunks.chunked(td.documents(spark, sf_dir)), 500, 6000).select("conv_id", "position", "chunk_index", "part")


@query(_CHUNK.replace("c.n >= 1200 OR ", "").replace("18000", "30000") + " SELECT conv_id, position, chunk_index AS batch FROM c")
def merge_batches(spark, sf_dir):
    return chunks.batches_by_bytes(td.documents(spark, sf_dir), 30_000).select("conv_id", "position", F.col("chunk_index").alias("batch"))


_UNITS = _CTX + """, u0 AS (SELECT *, max("right") OVER (PARTITION BY conv_id, session ORDER BY "left", position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM an),
v AS (SELECT *, sum(CASE WHEN edge IS NULL OR "left" > edge + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY session, "left", position ROWS UNBOUNDED PRECEDING) AS unit FROM u0),
un AS (SELECT conv_id, CAST(unit AS BIGINT) AS unit, count(*) AS n_anchors, min(position) AS first_anchor, min("left") AS "left", max("right") AS "right" FROM v GROUP BY conv_id, unit),
ch AS (SELECT conv_id, position, t, coalesce(lag(sender) OVER (PARTITION BY conv_id ORDER BY position) <> sender, false) AS c FROM m),
um AS (SELECT un.*, count(*) FILTER (WHERE c AND ch.position > "left") AS turn_changes, date_diff('second', min(t), max(t)) AS seconds, count(*) AS n_rows FROM un JOIN ch ON un.conv_id = ch.conv_id AND ch.position BETWEEN "left" AND "right" GROUP BY ALL)"""


@query(_UNITS + ' SELECT conv_id, unit, turn_changes, seconds, n_rows FROM um')
def unit_measures(spark, sf_dir):
    return _measured(spark, sf_dir).select("conv_id", "unit", "turn_changes", "seconds", "n_rows")


def _measured(spark, sf_dir) -> DataFrame:
    return sessions.unit_metrics(sessions.candidate_units(_anchored(spark, sf_dir)), td.events(spark, sf_dir))


@query(_UNITS + ', z AS (SELECT conv_id, count(*) AS n FROM m GROUP BY conv_id) SELECT conv_id, unit, row_number() OVER (PARTITION BY conv_id ORDER BY n_anchors DESC, turn_changes DESC, "right" - "left", unit) AS priority, CAST(least(3, first_anchor * 4 // n) AS INTEGER) AS quarter FROM um JOIN z USING (conv_id)')
def unit_priorities(spark, sf_dir):
    sizes = td.events(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n_rows_of_conversation"))
    return selection.unit_priority(_measured(spark, sf_dir).join(sizes, "conv_id")).select("conv_id", "unit", "priority", "quarter")


@query(_UNITS + ' SELECT un.conv_id, un.unit, count(*) FILTER (WHERE m.position % 10 = 0) = 0 AS complete FROM un JOIN m ON un.conv_id = m.conv_id AND m.position BETWEEN "left" AND "right" GROUP BY ALL')
def citable_units(spark, sf_dir):
    visible = td.events(spark, sf_dir).where("position % 10 <> 0")
    return selection.complete_units(sessions.candidate_units(_anchored(spark, sf_dir)), visible).select("conv_id", "unit", "complete")


@query(_CTX + ", k AS (SELECT conv_id, session, position, position - row_number() OVER (PARTITION BY conv_id, session ORDER BY position) AS g FROM cs WHERE position % 6 <> 0) SELECT conv_id, session, min(position) AS start, max(position) AS \"end\" FROM k GROUP BY conv_id, session, g")
def position_ranges(spark, sf_dir):
    rows = sessions.context_sessions(td.events(spark, sf_dir)).where("position % 6 <> 0")
    return sessions.contiguous_ranges(rows.select("conv_id", "session", "position"))


@query(_EV + """, x AS (SELECT conv_id, position, CASE WHEN position <= 2 OR position % 9 = 0 THEN NULL ELSE t END AS t FROM m), y AS (SELECT * FROM x WHERE position > 2), z AS (SELECT *, max(t) OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM y)
SELECT conv_id, position, CAST(1 + sum(CASE WHEN date_diff('second', b, t) > 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY position) AS BIGINT) AS session FROM z""")
def segment_sessions(spark, sf_dir):
    m = td.events(spark, sf_dir).withColumn("time", F.when((F.col("position") > 2) & (F.col("position") % 9 != 0), F.col("time")))
    return sessions.segment_sessions(m).select("conv_id", "position", "session")


@query(_EV + ", c AS (SELECT conv_id, position, CASE WHEN position % 11 = 0 THEN NULL ELSE t END AS t FROM m), f AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY position) AS b FROM c) SELECT conv_id, position, CAST(sum(CASE WHEN b IS NULL OR t IS NULL OR abs(date_diff('second', b, t)) > 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY position) AS BIGINT) AS session FROM f")
def coverage_sessions(spark, sf_dir):
    m = td.events(spark, sf_dir).withColumn("epoch", F.col("position").cast("double")).withColumn("time", F.when(F.col("position") % 11 != 0, F.col("time")))
    return sessions.context_sessions(m, use_epoch=False).select("conv_id", "position", "session")


@query(_EV + """, n AS (SELECT conv_id, t, position - 1 AS r, idx % 3 = 0 AS chosen, count(*) OVER (PARTITION BY conv_id) AS n FROM m), q AS (SELECT conv_id, t, chosen, CAST((r >= n // 4) AS INTEGER) + CAST((r >= 2 * n // 4) AS INTEGER) + CAST((r >= 3 * n // 4) AS INTEGER) AS quarter FROM n)
SELECT conv_id, quarter, count(*) AS total, count(*) FILTER (WHERE chosen) AS chosen, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_time FROM q GROUP BY ALL""")
def quarter_coverage(spark, sf_dir):
    m = td.events(spark, sf_dir).withColumn("chosen", F.col("original_index") % 3 == 0)
    return selection.quarter_coverage(m).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_time", "last_time")})


_REFS = "WITH r AS (SELECT l_orderkey AS claim_id, 'E' || (l_partkey % 900) AS evidence_id, CASE WHEN l_linenumber % 3 = 0 THEN 'counter' ELSE 'support' END AS role FROM lineitem), e AS (SELECT 'E' || p AS evidence_id, CASE p % 6 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'unmatched' ELSE 'matched' END AS status FROM range(850) t(p))"


def _refs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    r = td.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.concat(F.lit("E"), (F.col("l_partkey") % 900).cast("string")).alias("evidence_id"), F.when(F.col("l_linenumber") % 3 == 0, "counter").otherwise("support").alias("role"))
    e = spark.range(850).select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("evidence_id"), F.when(F.col("id") % 6 == 0, "ambiguous").when(F.col("id") % 6 == 1, "unmatched").otherwise("matched").alias("status"))
    return r, e


@query(_REFS + ", b AS (SELECT r.claim_id, r.evidence_id, e.status, (SELECT count(DISTINCT s.role) FROM r s WHERE s.claim_id = r.claim_id AND s.evidence_id = r.evidence_id) AS roles FROM r LEFT JOIN e USING (evidence_id)) SELECT DISTINCT claim_id, evidence_id, CASE WHEN status IS NULL THEN 'unknown' WHEN status IN ('ambiguous', 'unmatched') THEN 'quarantined' ELSE 'several_roles' END AS violation FROM b WHERE status IS NULL OR status IN ('ambiguous', 'unmatched') OR roles > 1")
def claim_references(spark, sf_dir):
    return claims.reference_violations(*_refs(spark, sf_dir))


@query(_EV + """, f AS (SELECT conv_id AS claim_id, position AS evidence_id, event_type AS quote, sender, position FROM m), a AS (SELECT conv_id AS claim_id, position AS evidence_id, CASE WHEN position % 5 = 0 THEN 'zzz' ELSE left(event_type, 4) END AS quote, CASE WHEN position % 7 = 0 THEN 'q' ELSE left(event_type, 2) END AS actor, CASE WHEN position % 3 = 0 THEN substr(event_type, 2, 2) WHEN position % 11 = 0 THEN 'xx' END AS target, CASE WHEN position % 4 = 0 THEN position + 1 END AS confirmation_id, event_type AS confirmation_quote FROM m)
SELECT a.claim_id, a.evidence_id, CASE WHEN NOT contains(f.quote, a.quote) THEN 'quote' WHEN NOT contains(a.quote, actor) THEN 'actor' WHEN target IS NOT NULL AND NOT contains(a.quote, target) THEN 'target' ELSE 'confirmation' END AS violation FROM a JOIN f USING (claim_id, evidence_id) LEFT JOIN f c ON c.claim_id = a.claim_id AND c.evidence_id = a.confirmation_id
WHERE NOT contains(f.quote, a.quote) OR NOT contains(a.quote, actor) OR (target IS NOT NULL AND NOT contains(a.quote, target)) OR (confirmation_id IS NOT NULL AND (c.quote IS NULL OR NOT contains(c.quote, confirmation_quote) OR c.sender = f.sender OR c.position <= f.position))""")
def action_checks(spark, sf_dir):
    e = td.events(spark, sf_dir)
    f = e.select(F.col("conv_id").alias("claim_id"), F.col("position").alias("evidence_id"), F.col("content").alias("quote"), "sender", "position")
    p = F.col("position")
    a = e.select(
        F.col("conv_id").alias("claim_id"), p.alias("evidence_id"), F.when(p % 5 == 0, "zzz").otherwise(F.left("content", F.lit(4))).alias("quote"), F.when(p % 7 == 0, "q").otherwise(F.left("content", F.lit(2))).alias("actor"),
        F.when(p % 3 == 0, F.substring("content", 2, 2)).when(p % 11 == 0, "xx").alias("target"), F.when(p % 4 == 0, p + 1).alias("confirmation_id"), F.col("content").alias("confirmation_quote"),
    )
    return claims.action_violations(a, f)


@query("WITH w AS (SELECT doc_id FROM documents), g AS (SELECT doc_id FROM labels WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 9 = 1 UNION ALL SELECT doc_id + 100000000 FROM labels WHERE doc_id % 13 = 0), c AS (SELECT doc_id, count(*) AS got FROM g GROUP BY doc_id) SELECT doc_id, CASE WHEN w.doc_id IS NULL THEN 'extra' WHEN got IS NULL THEN 'missing' ELSE 'repeated' END AS violation FROM w FULL JOIN c USING (doc_id) WHERE w.doc_id IS NULL OR got IS NULL OR got > 1")
def review_cover(spark, sf_dir):
    lab = td.table(spark, sf_dir, "labels").select("doc_id")
    given = lab.where("doc_id % 4 <> 0").union(lab.where("doc_id % 9 = 1")).union(lab.where("doc_id % 13 = 0").select(F.col("doc_id") + 100_000_000))
    return claims.exact_cover(_docs(spark, sf_dir).select("doc_id"), given, "doc_id")


@query("SELECT l_orderkey AS claim_id, bool_and(l_linenumber % 4 <> 0 OR l_quantity < 40) AS passed, count(*) FILTER (WHERE NOT (l_linenumber % 4 <> 0 OR l_quantity < 40)) AS failed_fields FROM lineitem GROUP BY l_orderkey")
def review_verdicts(spark, sf_dir):
    rows = td.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), ((F.col("l_linenumber") % 4 != 0) | (F.col("l_quantity") < 40)).alias("ok"))
    return claims.verdicts(rows)


@query("SELECT d.doc_id AS claim_id, CASE WHEN l.doc_id IS NULL THEN d.n_chars ELSE l.quality END AS body FROM documents d LEFT JOIN labels l USING (doc_id)")
def claim_revisions(spark, sf_dir):
    c = _docs(spark, sf_dir).select(F.col("doc_id").alias("claim_id"), F.col("n_chars").cast("long").alias("body"))
    return claims.revised(c, td.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id"), F.col("quality").cast("long").alias("body")))


@query("""WITH b AS (SELECT o_orderkey AS report, 'M_' || md5(CAST(o_custkey AS VARCHAR)) AS a, 'E_' || md5(CAST(o_custkey % 7 AS VARCHAR)) AS b FROM orders), t AS (SELECT report, a AS ref, 0 AS k FROM b UNION ALL SELECT report, b, 1 FROM b UNION ALL SELECT report, a, 2 FROM b), f AS (SELECT report, ref, min(k) AS k FROM t GROUP BY ALL) SELECT report, ref, row_number() OVER (PARTITION BY report ORDER BY k) AS number FROM f""")
def citation_order(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    a, b = F.concat(F.lit("M_"), F.md5(F.col("o_custkey").cast("string"))), F.concat(F.lit("E_"), F.md5((F.col("o_custkey") % 7).cast("string")))
    return claims.citation_numbers(o.select(F.col("o_orderkey").alias("report"), F.concat(F.lit("see "), a, F.lit(", "), b, F.lit(" and `"), a, F.lit("`\n```\nM_"), F.md5(F.lit("no")), F.lit("\n```\n<!-- E_"), F.md5(F.lit("no")), F.lit(" -->")).alias("body")))


@query(_REFS + ", m AS (SELECT p, 'M' || (p * 3) AS message_id, p * 3 AS position, CASE p % 2 WHEN 0 THEN 'me' ELSE 'other' END AS sender FROM range(850) t(p)) SELECT r.claim_id, r.evidence_id, m.message_id, m.position, m.sender FROM r JOIN m ON r.evidence_id = 'E' || m.p")
def cited_facts(spark, sf_dir):
    r, e = _refs(spark, sf_dir)
    n = F.substring("evidence_id", 2, 9).cast("long")
    evidence = e.select("evidence_id", F.concat(F.lit("M"), (n * 3).cast("string")).alias("message_id"), F.lit("x").alias("quote"))
    rows = e.select(F.concat(F.lit("M"), (n * 3).cast("string")).alias("message_id"), (n * 3).alias("position"), F.when(n % 2 == 0, "me").otherwise("other").alias("sender"), F.lit(None).cast("timestamp_ntz").alias("time"))
    return claims.source_facts(r.drop("role"), evidence, rows).drop("quote", "time")


@query("""WITH c AS (SELECT doc_id, lang, doc_id % 3 AS r, [doc_id % 5, doc_id % 7] AS need FROM documents), p AS (SELECT doc_id, quality, toxic FROM labels)
SELECT c.doc_id AS case_id, p.doc_id IS NOT NULL AND quality = 1 AND toxic = 0 AND c.r <> 2 AND len([x FOR x IN need IF NOT list_contains([0, 1, 2, 3, 4], x)]) = 0 AS passed, p.doc_id IS NULL AS missing FROM c LEFT JOIN p USING (doc_id)""")
def annotation_scores(spark, sf_dir):
    i = F.col("doc_id")
    cases = _docs(spark, sf_dir).select(i.alias("case_id"), F.lit("p").alias("proposition"), F.lit("holds").alias("assessment"), F.create_map(F.lit("a"), F.lit("support"), F.lit("b"), F.lit("counter")).alias("roles"), F.array((i % 5), (i % 7)).alias("required_positions"))
    given = td.table(spark, sf_dir, "labels").select(
        i.alias("case_id"), F.when(F.col("quality") == 1, "p").otherwise("q").alias("proposition"), F.when(F.col("toxic") == 0, "holds").otherwise("fails").alias("assessment"),
        F.when(i % 3 == 2, F.create_map(F.lit("a"), F.lit("support"))).otherwise(F.create_map(F.lit("b"), F.lit("counter"), F.lit("a"), F.lit("support"))).alias("roles"), F.array(*[F.lit(x).cast("long") for x in range(5)]).alias("available_positions"),
    )
    return scoring.annotations(cases, given)


@query(_GOLD + ", s AS (SELECT profile, count(*) FILTER (WHERE gold = pred) AS tp, count(*) FILTER (WHERE pred IS NOT NULL AND (gold IS NULL OR gold <> pred)) AS fp, count(*) FILTER (WHERE gold IS NOT NULL AND (pred IS NULL OR gold <> pred)) AS fn FROM g GROUP BY profile) SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM s WHERE 2 * tp + fp + fn > 0")
def macro_f1(spark, sf_dir):
    return _rounded(scoring.macro(_labelled(spark, sf_dir), "profile", "macro_f1"))


_BOTH = _GOLD + ", b AS (SELECT dim, CAST(gold AS DOUBLE) AS x, CAST(pred AS DOUBLE) AS y FROM g WHERE gold IS NOT NULL AND pred IS NOT NULL)"


@query(_BOTH + ", m AS (SELECT dim, count(*) AS n, (avg(x) + avg(y)) / 2 AS gm, avg(x) AS mx, avg(y) AS my FROM b GROUP BY dim), s AS (SELECT dim, n, sum(2 * ((x + y) / 2 - gm) ** 2) / (n - 1) AS msr, n * ((mx - gm) ** 2 + (my - gm) ** 2) AS msc, sum((x - (x + y) / 2 - mx + gm) ** 2 + (y - (x + y) / 2 - my + gm) ** 2) / (n - 1) AS mse FROM b JOIN m USING (dim) GROUP BY dim, n, mx, my, gm) SELECT dim, n, round((msr - mse) / (msr + mse + 2 * (msc - mse) / n), 6) AS icc FROM s")
def agreement_icc(spark, sf_dir):
    return _rounded(scoring.icc(_labelled(spark, sf_dir), "dim"))


@query(_BOTH + ", a AS (SELECT dim, count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0 END) AS po FROM b GROUP BY dim), e AS (SELECT dim, sum(p * q) AS pe FROM (SELECT dim, v, avg(CASE WHEN x = v THEN 1.0 ELSE 0 END) AS p, avg(CASE WHEN y = v THEN 1.0 ELSE 0 END) AS q FROM b, (VALUES (0), (1), (2)) t(v) GROUP BY dim, v) GROUP BY dim) SELECT dim, n, round((po - pe) / (1 - pe), 6) AS kappa FROM a JOIN e USING (dim)")
def plain_kappa(spark, sf_dir):
    return _rounded(scoring.kappa(_labelled(spark, sf_dir), "dim", weighted=False))


@query(_EV + ", z AS (SELECT conv_id, position, CASE WHEN position % 13 = 0 THEN 'x-bad-time' END AS bad, t FROM m) SELECT conv_id, count(*) FILTER (WHERE bad IS NOT NULL) AS invalid_times, count(DISTINCT coalesce(bad, strftime(t, '%Y-%m-%d'))) AS active_days FROM z GROUP BY conv_id")
def invalid_time_counts(spark, sf_dir):
    bad = F.col("position") % 13 == 0
    m = td.events(spark, sf_dir).withColumn("time", F.when(~bad, F.col("time"))).withColumn("time_str", F.when(bad, F.lit("x-bad-time")).otherwise(F.col("time_str")))
    return statistics.totals(m).select("conv_id", "invalid_times", "active_days")


@query(_GAP + ", d2 AS (SELECT conv_id, sender, delta FROM (SELECT conv_id, sender, CASE WHEN lag(sender) OVER w <> sender THEN date_diff('second', lag(t) OVER w, t) END AS delta FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY position)) q WHERE delta IS NOT NULL) SELECT conv_id, sender, count(*) AS n, CAST(sum(delta) AS BIGINT) AS seconds FROM d2 GROUP BY ALL")
def reply_delta_sums(spark, sf_dir):
    return sessions.reply_deltas(td.events(spark, sf_dir)).where("delta is not null").groupBy("conv_id", "sender").agg(F.count("*").alias("n"), F.sum("delta").alias("seconds"))


@query("SELECT o_custkey AS claim_id, array_to_string(list_concat(['local'], list_concat(CASE WHEN count(DISTINCT CAST(o_orderdate AS DATE)) >= 2 AND count(DISTINCT strftime(o_orderdate, '%Y-%m')) >= 2 THEN ['repeated'] ELSE [] END, CASE WHEN count(DISTINCT CAST(o_orderdate AS DATE)) >= 3 AND count(DISTINCT strftime(o_orderdate, '%Y-%m')) >= 3 AND date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) >= 30 THEN ['long_term'] ELSE [] END)), ',') AS scopes, CASE WHEN bool_or(o_orderkey % 5 = 0) THEN 'user,interaction,peer' ELSE 'user,interaction' END AS subjects FROM orders GROUP BY o_custkey")
def allowed_scopes(spark, sf_dir):
    refs = td.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("claim_id"), F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise("me").alias("sender"))
    return claims.allowed(_covered(spark, sf_dir), refs).select("claim_id", *[F.array_join(c, ",").alias(c) for c in ("scopes", "subjects")])
