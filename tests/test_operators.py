"""Operators on tiny tables, against rules restated plainly."""

import functools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions import times
from threadloom.operators import chunks, claims, grounding, messages, redaction, retrieval, scoring, selection, sessions, statistics, usage
from threadloom.sources import exports
from threadloom.streaming import live

MSG = "conv_id string, position int, original_index int, sender string, time_str string, type string, content string, epoch double"


def msgs(spark, rows):
    df = spark.createDataFrame([("c", p, p, s, t, messages.TEXT, x, None) for p, (s, t, x) in enumerate(rows, 1)], MSG)
    return df.withColumn("time", times.parse_time(F.col("time_str")))


def test_times(spark):
    got = spark.createDataFrame([("2024-1-2 3:04:05",), ("2024-02-30 00:00:00",), ("bad-date-text",), (None,)], "s string").select(times.parse_time(F.col("s")).alias("t"), times.parse_strict_time(F.col("s")).alias("u"), times.date_label(times.parse_time(F.col("s")), F.col("s")).alias("d")).collect()
    assert [str(r.t) for r in got] == ["2024-01-02 03:04:05", "None", "None", "None"] and all(r.u is None for r in got)
    assert [r.d for r in got] == ["2024-01-02", "2024-02-30", "bad-date-t", "unknown"]
    xs = [0.35, 0.25, 2.675, 0.05, 1.25, 12345.65, -0.45]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(times.round1(F.col("x"))).collect()] == [round(x, 1) for x in xs]
    assert [r[0] for r in spark.createDataFrame([("12",), ("1.5",), ("",), ("nan",), (None,)], "s string").select(times.parse_epoch(F.col("s"))).collect()] == [12.0, 1.5, None, None, None]


def test_parse_order_and_diagnostics(spark):
    raw = spark.createDataFrame(
        [("c", 0, messages.TEXT, "a", 1, "bad time", "2000"), ("c", 1, messages.TEXT, "b", 0, "2024-01-01 00:00:00", "1000"), ("c", 2, messages.SYSTEM, "", 0, None, None), ("c", 3, messages.IMAGE, None, 0, "2024-01-01 00:00:01", ""), ("c", 4, messages.TEXT, "", 1, None, None)],
        "conv_id string, original_index int, type string, content string, is_send int, time_str string, create_time string",
    )
    rows = messages.positioned(messages.parse(raw)).orderBy("position").collect()
    assert [(r.original_index, r.sender) for r in rows] == [(1, "other"), (0, "me"), (3, "other")]
    d = messages.diagnostics(raw).first()
    assert (d.raw, d.parsed, d.skipped, d.invalid_times, d.invalid_timestamps, d.sort_changed) == (5, 3, 2, 1, 1, True)
    assert d.skip_reasons == {"system_message": 1, "empty_content": 1}


def test_session_definitions_differ(spark):
    m = msgs(spark, [("me", "2024-01-01 10:00:00", "a"), ("me", None, "b"), ("other", "2024-01-01 14:00:00", "c"), ("other", "2024-01-01 09:00:00", "d"), ("me", "2024-01-01 13:00:01", "e")])
    of = lambda df: [r.session for r in df.orderBy("position").collect()]
    assert of(sessions.gap_sessions(m)) == [1, 1, 1, 1, 2]
    assert of(sessions.context_sessions(m)) == [1, 2, 3, 4, 5]
    lead = msgs(spark, [("me", None, "a"), ("me", "2024-01-01 10:00:00", "b")])
    assert of(sessions.segment_sessions(lead)) == [1] and of(sessions.gap_sessions(lead)) == [1, 1]


def naive_window(rows, anchor, radius=16):
    """rows: (session, sender); walk out until a turn ends after radius steps, or the session does."""
    out = []
    for step in (-1, 1):
        at = anchor
        while 0 <= at + step < len(rows) and rows[at + step][0] == rows[anchor][0]:
            if abs(at - anchor) >= radius and rows[at + step][1] != rows[at][1]:
                break
            at += step
        out.append(at + 1)
    return tuple(out)


def test_anchor_windows_equal_a_walk(spark):
    rng = random.Random(8)
    at, rows, plain = 0, [], []
    for _ in range(160):
        gap = rng.choice([10, 10, 10, 10, 10, 10, 10, 10, 10, 20000])
        at += gap
        rows.append((rng.choice(["me", "other"]) if rng.random() < 0.4 or not rows else rows[-1][0], f"2024-01-{1 + at // 86400:02d} {at % 86400 // 3600:02d}:{at % 3600 // 60:02d}:{at % 60:02d}", "x"))
        plain.append(((plain[-1][0] if plain else 0) + (gap > 14400), rows[-1][0]))
    m = msgs(spark, rows)
    got = {r.position: (r.left, r.right) for r in sessions.anchor_windows(m, m.select("conv_id", "position"), 5).collect()}
    assert got == {k + 1: naive_window(plain, k, 5) for k in range(160)}


def test_transcript_round_trip(spark):
    m = msgs(spark, [("me", "2024-01-01 10:00:00", "a\nb"), ("other", "2024-01-01 11:00:00", "c"), ("me", "soon", "d"), ("me", "2024-01-02 00:00:00", "e")]).withColumn("chunk_index", F.lit(1))
    packed = messages.compact_transcript(m)
    assert packed.first().transcript == "=== 2024-01-01 ===\n[m1] 10:00:00 【我】 a\\nb\n[m2] 11:00:00 【对方】 c\n[m3] soon 【我】 d\n=== 2024-01-02 ===\n[m4] 00:00:00 【我】 e"
    assert [r.line for r in messages.expand_transcript(packed).orderBy("n").collect()] == [r.l for r in m.orderBy("position").select(messages.line().alias("l")).collect()]


def test_chunks_and_shrinking(spark):
    rows = spark.createDataFrame([("a", k, 10 * k) for k in range(1, 30)] + [("b", 1, 10**6)], "conv_id string, position int, bytes int")
    got = {}
    for r in chunks.chunked(rows, 5, 400).collect():
        got.setdefault((r.conv_id, r.chunk_index), []).append(r)
    assert all(len(v) <= 5 and (len(v) == 1 or sum(x.bytes + 1 for x in v) <= 400) for v in got.values())
    assert chunks.coverage(chunks.manifest(chunks.chunked(rows, 5, 400)), rows).where("not complete").count() == 0
    assert chunks.shrink(100, 18000, 32000) == (55, 12000, 18000)
    assert chunks.split_to_budget([5, 5, 5, 50], 1, 12) == [(0, 2), (2, 3), (3, 4)]


def test_grounding(spark):
    m = spark.createDataFrame([("c", 1, "M1", 1, "aaa b"), ("c", 1, "M2", 2, "b 😀 end")], "conv_id string, chunk_index int, message_id string, position int, content string")
    q = spark.createDataFrame([("c", 1, "q1", "😀 e", None), ("c", 1, "q2", "aa", None), ("c", 1, "q3", "zz", None), ("c", 1, "q4", "", None), ("c", 1, "q5", "b", "m2")], "conv_id string, chunk_index int, quote_id string, quote string, hint string")
    got = {r.quote_id: r for r in grounding.ground(grounding.aliases(q, m), m).collect()}
    assert {k: v.status for k, v in got.items()} == {"q1": "matched", "q2": "ambiguous", "q3": "unmatched", "q4": "not_applicable", "q5": "matched"}
    assert (got["q1"].source_refs[0].start, got["q1"].source_refs[0].end) == (2, 5) and got["q2"].candidate_count == 2


def test_evidence_rules(spark):
    names = ["summary", "evidence", "confidence", "model", "direction", "signal", "trait", "stability", "against", "question", "reason"]
    rows = [(1, "events", {"summary": "s", "evidence": "e", "confidence": "high"}), (1, "events", {"summary": " ", "evidence": "e", "confidence": "sure"}), (1, "other", {})]
    df = spark.createDataFrame([(k, c, *[d.get(n) for n in names]) for k, c, d in rows], "chunk_index int, category string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(r.field for r in grounding.violations(df).collect()) == ["category", "confidence", "summary"]


def test_balanced_items(spark):
    items = spark.createDataFrame([("c", k, d) for k in range(70) for d in range(1 + k % 3)], "conv_id string, chunk_index int, depth int")
    got = sorted((r.chunk_index, r.depth) for r in grounding.balanced(items, 60).collect())
    assert len(got) == 60 and got[0] == (0, 0) and got[-1] == (69, 0)
    assert [r.chunk_index for r in grounding.balanced(items, 1).collect()] == [69]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("E1", "support", "the banana"), ("E2", "counter", "bananana split"), ("E3", "support", "nothing"), ("E4", "support", "")], "evidence_id string, role string, search_text string")
    import math

    n, avg = 4, (8 + 12 + 5 + 0) / 4
    idf = math.log((n - 2 + 0.5) / 2.5)
    idf = idf if idf > 0 else 1e-6
    want = {i: -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ln / avg)) for i, tf, ln in (("E1", 2, 8), ("E2", 3, 12))}
    got = {r.evidence_id: r.score for r in retrieval.search(docs, "ana", 5).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert [r.evidence_id for r in retrieval.search(docs, "NA an", 5).orderBy("role").collect()] == ["E2", "E1"]
    with pytest.raises(ValueError):
        retrieval.search(docs, "", 5)


def test_resolve_prefixes(spark):
    ids = spark.createDataFrame([("abc",), ("abd",), ("xyz",)], "id string")
    refs = spark.createDataFrame([("ab",), ("abc",), ("x",), ("q",)], "ref string")
    assert {r.ref: (r.status, r.id) for r in retrieval.resolve(refs, ids).collect()} == {"ab": ("ambiguous", None), "abc": ("resolved", "abc"), "x": ("resolved", "xyz"), "q": ("missing", None)}


def most_rows(df):
    """Rows that the busiest step of a plan gives when it runs."""
    df._jdf.collect()

    def walk(node):
        if "AdaptiveSparkPlan" in node.nodeName():
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        own = node.metrics().get("numOutputRows").get().value() if node.metrics().contains("numOutputRows") else 0
        return max([own, *[walk(node.children().apply(k)) for k in range(node.children().size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def test_prefixes_meet_no_ids_that_they_do_not_fit(spark):
    names = [f"{k:04x}" for k in range(1 << 12)]
    ids = spark.createDataFrame([(x,) for x in [*names, "0", None, "ab"]], "id string")
    refs = [x[: 1 + k % 4] for k, x in enumerate(names)] + ["", "00001", "zz", None]
    found = retrieval.resolve(spark.createDataFrame([(r,) for r in refs], "ref string"), ids)
    known = {*names, "0", "ab"}
    want = {}
    for r in set(refs):
        fits = [] if r is None else [x for x in known if x.startswith(r)]
        want[r] = ("missing" if not fits else "resolved" if len(fits) == 1 else "ambiguous", fits[0] if len(fits) == 1 else None)
    assert {r.ref: (r.status, r.id) for r in found.collect()} == want
    run = retrieval.resolve(spark.createDataFrame([(r,) for r in refs], "ref string"), ids)
    assert most_rows(run) <= 7 * len(known)  # at most a row for each length of a reference


def test_redaction_numbers_by_order_and_is_idempotent(spark):
    rows = spark.createDataFrame([("c", 0, "mail a@b.com or +86 138 0013 8000"), ("c", 1, "13800138000, then A@b.com and a@b.com by Bob"), ("d", 0, "see https://x.y/z. " + "M_" + "0" * 32), ("d", 1, None)], "conv_id string, original_index int, content string")
    alias = redaction.alias_registry(spark.createDataFrame([("c", "Bob", "other"), ("c", "me", "me"), ("d", "Al", "me"), ("d", "Al", "other")], "conv_id string, value string, role string"))
    once = redaction.redact(rows, alias)
    got = {(r.conv_id, r.original_index): r.content for r in once.collect()}
    assert got[("c", 0)] == "mail [邮箱1] or [手机号1]" and got[("c", 1)] == "[手机号1], then [邮箱2] and [邮箱1] by 对方"
    assert got[("d", 0)] == "see [链接1] " + "M_" + "0" * 32 and got[("d", 1)] is None
    again = {(r.conv_id, r.original_index): r.content for r in redaction.redact(once.drop("replaced"), alias).collect()}
    assert again == got
    assert {(r.conv_id, r.kind): r.n for r in redaction.replacement_counts(once).collect()}[("c", "email")] == 3


def _native(**more):
    return {"type": "文本消息", "content": "x", "isSend": 1, "formattedTime": "2024-01-01 00:00:00", **more}


def _canonical(**more):
    people = [{"id": "p", "role": "me", "name": "P"}, {"id": "q", "role": "other", "name": "Q"}]
    rows = [{"id": "1", "sender_id": "q", "time": "1970-01-01 08:00:01", "type": "image"}]
    return {"schema": "some.conversation", "version": 1, "session": {"id": "s", "type": "private", "display_name": "Q"}, "participants": people, "messages": rows, **more}


MD = "# t\n\n- 会话：`s`\n- 导出账号：me\\_1\n- 导出时间：2024-01-01 00:00:00\n\n---\n"
BODY = "**me\\_1** · 2024-01-01 10:00:00\nhi \\*there\\*\nmore\n\n**you** · 2024-01-01 10:00:01 · 图片\n\n**you** · 2024-01-01 10:00:02 · 红包\nx\n**you** · 2024-01-01 10:00:03\n\n**x** · 2024-01-01 10:00:04 · 系统\nnote\n"


def test_exports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"session": {"type": "私聊"}, "messages": [_native(createTime=5)]}), encoding="utf-8-sig")
    (tmp_path / "b.json").write_text(json.dumps(_canonical()))
    (tmp_path / "c.md").write_text("\ufeff" + (MD + BODY).replace("\n", "\r\n"))
    (tmp_path / "d.json").write_text(json.dumps({"session": {}, "messages": [_native(isSend=True)]}))
    (tmp_path / "e.md").write_text("no transcript")
    got = {}
    for r in exports.read(spark, str(tmp_path)).orderBy("conv_id", "original_index").collect():
        got.setdefault(r.conv_id, []).append(r)
    assert (got["a"][0].create_time, got["a"][0].is_send) == ("5", 1)
    assert (got["b"][0].create_time, got["b"][0].content, got["b"][0].type) == ("1", "[图片消息]", "图片消息")
    assert [r.content for r in got["c"]] == ["hi *there*\nmore", "[图片消息]", "[原导出类型：红包；仅保留发生记录，附件内容未解析]", "[原导出类型：文本；仅保留发生记录，导出正文为空]", "note"]
    assert [r.is_send for r in got["c"]] == [1, 0, 0, 0, 0] and [r.type for r in got["c"]] == ["文本消息", "图片消息", "文件消息", "文件消息", "系统消息"]
    assert [r.original_index for r in got["c"]] == [0, 1, 2, 3, 4] and got["c"][0].create_time == "1704074400"
    assert "isSend" in got["d"][0].error and got["d"][0].content is None and "head" in got["e"][0].error
    assert [r.conv_id for r in exports.read(spark, str(tmp_path), names=["A", "B"], limit=1).collect()] == ["a"]
    exports.publish(spark.range(3).toDF("x"), str(tmp_path / "pub"), "t", "r1")
    exports.publish(spark.range(5).toDF("x"), str(tmp_path / "pub"), "t", "r2")
    assert exports.current(spark, str(tmp_path / "pub"), "t").count() == 5


@pytest.mark.parametrize(
    "change",
    [
        {"messages": []}, {"messages": [_native(formattedTime=None)]}, {"messages": [_native(type="text")]}, {"messages": [_native(content=5)]}, {"isGroup": True}, {"session": {"isGroupChat": True}},
        {"session": {"type": "chatroom"}}, {"session": {"id": "x@chatroom"}}, {"session": {"participants": [1, 2, 3]}}, {"session": {"displayName": " "}}, {"session": []},
        {"messages": [_native(senderId=1), _native(senderId="2")]}, {"messages": [_native(senderUin=1.5)]},
    ],
)
def test_native_exports_that_break_a_rule(change):
    with pytest.raises(ValueError):
        exports.parse_json(json.dumps({"messages": [_native()], **change}).encode())


def test_native_exports_that_keep_the_rules():
    rows = [_native(senderId=1, sender_id="a"), _native(senderId="1", isSend=0, content=None), _native(type="系统消息", senderId="zz")]
    assert len(exports.parse_json(json.dumps({"session": {"type": "anything"}, "messages": rows}).encode())) == 3


@pytest.mark.parametrize(
    "change",
    [
        {"schema": "other"}, {"version": True}, {"session": {"id": "s", "type": "group", "display_name": "Q"}}, {"session": {"id": "s", "type": "private"}}, {"participants": [{"id": "p", "role": "me", "name": "P"}]},
        {"participants": [{"id": "p", "role": "me", "name": "P"}, {"id": "q", "role": "me", "name": "Q"}]}, {"isGroup": True}, {"messages": []},
        *[{"messages": [{"id": "1", "sender_id": "q", "time": "1970-01-01 08:00:01", "type": "text", "content": "x", **m}]} for m in ({"content": " "}, {"type": "note"}, {"sender_id": None}, {"type": "system", "sender_id": "zz"}, {"time": "1970-1-1 8:0:1"}, {"content": 4}, {"id": ""})],
    ],
)
def test_canonical_exports_that_break_a_rule(change):
    with pytest.raises(ValueError):
        exports.parse_json(json.dumps(_canonical(**change)).encode())


def test_transcripts_that_break_a_rule(spark):
    bad = [MD.replace("- 会话：`s`\n", "") + BODY, MD.replace("- 会话", "- 会话：y\n- 会话") + BODY, MD.replace("`s`", "s@chatroom") + BODY, MD.replace("2024-01-01 00:00:00", "2024-1-1 0:0:0") + BODY, MD, MD + "text\n" + BODY, MD + BODY.replace("**you** ·", "**you** · later"), MD + BODY.replace("you", "me\\_1"), MD + BODY.replace("me\\_1", "him"), MD + BODY.replace("10:00:03", "10:00:63")]
    rows = exports.transcripts(spark.createDataFrame([(str(k), t) for k, t in enumerate([*bad, MD + BODY])], "conv_id string, text string")).collect()
    assert sorted(r.conv_id for r in rows if r.error) == sorted(map(str, range(len(bad)))) and sum(r.error is None for r in rows) == 5


def test_terms_are_read_whole(spark, tmp_path):
    (tmp_path / "t.json").write_text("[\n" + ",\n" * 0 + "\n" * 20_000 + '"b", "a", " a "]')
    (tmp_path / "t.txt").write_text("b\na\n")
    assert exports.read_terms(spark, str(tmp_path / "t.json")) == exports.read_terms(spark, str(tmp_path / "t.txt")) == ["a", "b"]
    (tmp_path / "many.txt").write_text("\n".join(f"t{k}" for k in range(10_001)))
    with pytest.raises(ValueError):
        exports.read_terms(spark, str(tmp_path / "many.txt"))


def test_a_plan_of_too_many_queries_raises(spark):
    rows = spark.createDataFrame([("c", 1, "q1 q128 q129 x"), ("c", 2, None)], "conv_id string, position int, content string")
    plan = lambda n: spark.createDataFrame([("a", "support", f"q{k}") for k in range(1, n + 1)], "question string, direction string, query string")
    assert {r.query for r in retrieval.proposition_hits(plan(128), rows).collect()} == {"q1", "q12", "q128"}
    with pytest.raises(ValueError, match="128"):
        retrieval.proposition_hits(plan(129), rows)


KINDS = [  # a plain restatement of what each kind of match looks like, tried at every place in order of priority
    ("placed", r"\[(?:手机号|邮箱|证件|银行卡|链接|账号|自定义)\d+\]|\[参与者\]"), *redaction.PATTERNS.items(),
]


def plain_redaction(rows, known, terms):
    """rows: (conv, index, text); every conversation by a plain loop over its texts, matches and numbers."""
    numbers, out = {}, {}
    for conv, index, text in sorted(rows, key=lambda r: r[:2]):
        kinds = [*KINDS, *[("known", re.escape(w)) for w in sorted(known.get(conv, {}), key=lambda w: (-len(w), w))], *[("custom", re.escape(w)) for w in sorted(terms, key=lambda w: (-len(w), w))]]
        at, done = 0, ""
        while at < len(text):
            for kind, pattern in kinds:
                m = re.compile(pattern).match(text, at)
                if m and m.end() > at:
                    break
            else:
                done, at = done + text[at], at + 1
                continue
            value, at = m.group(), m.end()
            if kind in ("placed", "technical"):
                done += value
            elif kind == "known":
                done += known[conv][value]
            else:
                key = re.sub("[ -]", "", value) if kind in ("phone", "card") else value
                digits = re.sub(r"\D", "", key)
                if kind == "phone" and len(digits) == 13 and key.lstrip("+").startswith("86"):
                    key = digits[2:]
                mine = numbers.setdefault((conv, kind), {})
                done += f"[{redaction.LABELS[kind]}{mine.setdefault(key, len(mine) + 1)}]"
        out[conv, index] = done
    return out


def test_redaction_equals_a_plain_loop(spark):
    rng = random.Random(6)
    parts = ["a@b.com", "A.b@c.org", "+86 138 0013 8000", "13800138000", "138-0013-8000", "6222 0202 0000 1111 222", "11010119900307123X", "wxid_abc12", "QQ：123456", "https://x.y/z?a=1", "www.q.r，", "Bob", "Bobby", "term", "[邮箱1]", "[参与者]", "M_" + "a" * 32, "high|medium|low", "中文", " ", ", ", "0571-1234567", "٣٤", "x", "\n", "E.Q\\E"]
    rows = [(f"c{k % 3}", k, "".join(rng.choice(parts) + rng.choice(["", " ", "。"]) for _ in range(rng.randrange(9)))) for k in range(300)]
    known = {"c0": {"Bob": "对方", "Bobby": "我"}, "c1": {"E.Q\\E": "[参与者]"}}
    alias = spark.createDataFrame([(c, v, a) for c, of in known.items() for v, a in of.items()], "conv_id string, value string, alias string")
    got = redaction.redact(spark.createDataFrame(rows, "conv_id string, original_index int, content string"), alias, ["term", "中文"])
    assert {(r.conv_id, r.original_index): r.content for r in got.collect()} == plain_redaction(rows, known, ["term", "中文"])


def test_byte_limits_cut_between_characters():
    rng = random.Random(8)
    for _ in range(500):
        t = "".join(rng.choice("aé中\U0001f600\n") for _ in range(rng.randrange(60)))
        most = rng.randrange(1, 90)
        got = tx.limited(t, most, "[..]")
        raw = t.encode()
        if len(raw) <= most:
            assert got == t
        elif most <= 4:
            assert got == "[..]"[:most]
        else:
            assert got == raw[: (most - 4) // 2].decode(errors="ignore") + "[..]" + raw[len(raw) - (most - 4 - (most - 4) // 2) :].decode(errors="ignore")


def test_scores_golden(spark):
    rows = spark.createDataFrame([("1", "p", "a", 2, 0), ("1", "p", "b", 0, 0), ("1", "p", "c", 1, None)], "case_id string, profile string, dim string, gold int, pred int")
    r = scoring.scores(rows).first()
    assert (r.precision, round(r.recall, 9), round(r.micro_f1, 9), round(r.coverage, 9), r.mae_covered, round(r.mae_penalised, 9)) == (0.5, round(1 / 3, 9), 0.4, round(2 / 3, 9), 0.5, round(2 / 3, 9))
    same = spark.createDataFrame([("k", v, v) for v in (0, 1, 2, 2)], "dim string, gold int, pred int")
    assert scoring.kappa(same).first().kappa == 1.0 and abs(scoring.icc(same).first().icc - 1) < 1e-12
    assert scoring.kappa(spark.createDataFrame([("k", 1, 1)], "dim string, gold int, pred int")).first().kappa is None


def test_usage_unknown_is_null(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text("\n".join(json.dumps({"session_id": "s", "time": str(k), "model": "m", "stage": "x", "usage": u}) for k, u in enumerate([{"prompt_tokens": 10, "prompt_cache_hit_tokens": 4, "total_tokens": 12}, {"prompt_tokens": True, "total_tokens": -1}, {"prompt_tokens": "50x"}, {}])))
    rows = usage.normalised(usage.read_log(spark, str(tmp_path)))
    t = usage.rollup(rows).where("g_stage = 1 and g_model = 1").first()
    assert (t.requests, t.known, t.prompt_tokens, t.prompt_cache_miss_tokens, t.cache_hit_rate, t.reasoning_tokens) == (4, 1, 10, 6, 0.4, None)
    assert usage.latest_session(rows).first().requests == 4


def test_claims(spark):
    refs = spark.createDataFrame([("A", p, d, s) for p, d, s in ((1, "2024-01-01", 1), (2, "2024-01-02", 2), (3, "2024-02-05", 3))] + [("B", 1, "2024-01-01", 1)], "claim_id string, position int, day string, session int").withColumn("day", F.to_date("day"))
    cov = claims.coverage(refs)
    assert {r.claim_id: r.s for r in cov.select("claim_id", claims.widest_scope().alias("s")).collect()} == {"A": "long_term", "B": "local"}
    c = spark.createDataFrame([("A", "fact", "long_term", "high"), ("B", "fact", "repeated", "high"), ("C", "fact", "local", "low")], "claim_id string, kind string, scope string, confidence string")
    assert {r.claim_id: r.violation for r in claims.scope_violations(c, cov).collect()} == {"B": "repeated", "C": "no_support"}
    ev = spark.createDataFrame([("E1", "matched"), ("E2", "ambiguous")], "evidence_id string, status string")
    r = spark.createDataFrame([("A", "support", "E1"), ("A", "counter", "E1"), ("A", "support", "E2"), ("A", "support", "E9")], "claim_id string, role string, evidence_id string")
    assert {(x.evidence_id, x.violation) for x in claims.reference_violations(r, ev).collect()} == {("E1", "several_roles"), ("E2", "quarantined"), ("E9", "unknown")}
    facts = spark.createDataFrame([("A", "E1", "I will pay Bob", "me", 3), ("A", "E2", "thanks", "other", 5)], "claim_id string, evidence_id string, quote string, sender string, position int")
    act = spark.createDataFrame([("A", "E1", "I will pay", "I", None, "E2", "thanks"), ("A", "E1", "I will pay", "you", None, None, None), ("A", "E2", "thanks", "thanks", None, "E1", "pay")], "claim_id string, evidence_id string, quote string, actor string, target string, confirmation_id string, confirmation_quote string")
    assert sorted(x.violation for x in claims.action_violations(act, facts).collect()) == ["actor", "confirmation"]
    want, got = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,), (3,)], "k int")
    assert {x.k: x.violation for x in claims.exact_cover(want, got, "k").collect()} == {1: "missing", 2: "repeated", 3: "extra"}
    new = c.where("claim_id = 'B'").withColumn("scope", F.lit("local"))
    assert {x.claim_id: x.scope for x in claims.revised(c, new).collect()} == {"A": "long_term", "B": "local", "C": "local"}


def test_selection():
    assert list(selection.spread_order(list(range(9))))[:3] == [4, 0, 8] and sorted(selection.spread_order(list(range(23)))) == list(range(23))
    rows = {"s": [f"- x / {'support' if k % 2 else 'against'}: {k}" for k in range(20)]}
    kept = selection.pack_sections(rows, 200)["s"]
    assert abs(sum("support" in r for r in kept) - sum("against" in r for r in kept)) <= 1 and sum(len(r) + 1 for r in kept) + 2 <= 200
    best = selection.best_sessions({"a": 60, "b": 50, "c": 100}, [("q1", frozenset("a"), 1.0), ("q2", frozenset("b"), 1.0), ("q1", frozenset("c"), 5.0)], 110)
    assert best == {"a", "b"}


def test_text_functions(spark):
    assert tx.limited("é" * 100, 51).encode().__len__() <= 51 and tx.limited("abc", 3) == "abc"
    assert tx.json_object('say ```json\n{"a": 1}\n``` and {"b": 2}') == '{"a": 1}' and tx.json_object('x {"a": {"b": 1}} y {bad}') == '{"a": {"b": 1}}'
    assert tx.markdown_blocks("a\nb\n\n- c\n```\n- d\n```\n| e") == ["a\nb", "- c", "```\n- d\n```", "| e"]
    df = spark.createDataFrame([("a😀b aaa",)], "t string")
    assert df.select(F.expr(tx.offsets("t", "'aa'")).alias("o"), F.expr(tx.offsets("t", "'b'")).alias("p")).first()[:] == ([4, 5], [2])
    assert spark.createDataFrame([(" a/b?. ",)], "s string").select(tx.safe_name(F.col("s"))).first()[0] == "a_b_"
    level = tx.level_from_words(F.col("t"), {0: ["zz"], 1: ["aa"], 2: ["b", "😀"]})
    assert df.select(level).first()[0] == 2
    ids = msgs(spark, [("me", "t", "x")]).select(tx.message_id(F.struct(F.lit("S").alias("s"), "original_index", F.lit(None).cast("string").alias("i"), "sender", "time_str", "type", "content"))).first()[0]
    assert ids == "M_" + tx.canonical_sha256(["S", 1, None, "me", "t", messages.TEXT, "x"])[:32]


def test_streams(spark, tmp_path):
    rows = [("c", f"2024-01-01 {h:02d}:00:00", s) for h, s in ((0, "me"), (1, "me"), (5, "other"), (11, "me"))]
    spark.createDataFrame(rows, "conv_id string, time string, sender string").withColumn("time", F.to_timestamp("time")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("conv_id string, time timestamp, sender string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("s1", live.sessions(stream()), "complete"), ("s2", live.turns(stream()), "append"), ("s3", live.daily(stream()), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.message_count for r in spark.table("s1").collect()) == [1, 3]
    assert [(r.sender, r.n_messages) for r in spark.table("s2").orderBy("first_time").collect()] == [("me", 2), ("other", 1)]
    assert spark.table("s3").first().total == 4


def test_redaction_keeps_every_row(spark):
    rows = [(None, 0, "a@b.com and Al"), (None, 0, "a@b.com and Al"), ("c", None, "Al c@d.org"), ("c", 1, "c@d.org 13800138000"), ("c", 1, None), ("c", 2, ""), ("c", 3, "﷐ e@f.net ﷑﷒﷓ ﷐x")]
    alias = spark.createDataFrame([(None, "Al", "我"), ("c", "Al", "对方"), ("c", "﷐x", "对方")], "conv_id string, value string, alias string")
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id string, original_index int, content string, pattern string, at string")
    got = sorted((repr((r.conv_id, r.original_index, r.content)), r.pattern + r.at) for r in redaction.redact(df, alias).collect())
    want = [(None, 0, "[邮箱1] and 我")] * 2 + [("c", None, "对方 [邮箱1]"), ("c", 1, "[邮箱1] [手机号1]"), ("c", 1, None), ("c", 2, ""), ("c", 3, "﷐ [邮箱2] ﷑﷒﷓ 对方")]
    assert got == sorted((repr(w), "xy") for w in want)
    shot = redaction.snapshot(df.withColumn("type", F.lit("t")).withColumn("time_str", F.lit("never")).withColumn("source_message_id", F.lit("s")).where("original_index = 0 or original_index = 2"), ("t",))
    assert shot.count() == 3
    kinds = ["url", "email", "identity", "card", "account", "phone", "custom", "technical"]
    text = "www.x.org/a a@b.co 11010519491231002X 6222020000000000000 wxid_abc +8613800138000 secret high|medium|low"
    one = redaction.redact(spark.createDataFrame([("c", 0, text)], "conv_id string, original_index int, content string"), None, ["secret"]).first()
    assert one.content == "[链接1] [邮箱1] [证件1] [银行卡1] [账号1] [手机号1] [自定义1] high|medium|low" and one.replaced == dict.fromkeys(kinds[:-1], 1)


def test_grounding_sends_no_text_for_an_anchor(spark):
    """One chunk of long texts and a few quotes: null keys, quotes of one id in two chunks, and what the plan moves."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(60)]
    m = spark.createDataFrame([(None if k % 3 else "c", f"M{k}", k, t) for k, t in enumerate(texts)] + [("c", "M60", None, texts[0])], "c string, message_id string, position int, content string")
    quotes = [(None, "q", texts[1][5:300]), ("c", "q", texts[1][5:300]), ("c", "r", texts[3][9:200]), ("c", "s", texts[0][7:400]), (None, "r", texts[4][:3]), (None, None, texts[4][100:300]), ("c", "r", "no such text " * 9)]
    q = spark.createDataFrame([(*x, "x") for x in quotes], "c string, quote_id string, quote string, content string")
    got = sorted((repr((r.c, r.quote_id, r.quote)), r.candidate_count) for r in grounding.ground(q, m, ("c",)).collect())
    count = lambda c, s: sum(t.startswith(s, k) for cc, t in [(None if k % 3 else "c", t) for k, t in enumerate(texts)] + [("c", texts[0])] if cc == c for k in range(len(t)))
    assert got == sorted((repr(x), count(x[0], x[2])) for x in quotes)
    plan = grounding.candidates(q.where("quote <> ''"), m, ["c"])._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_a_catalogue_makes_no_pairs_that_do_not_fit(spark):
    ids = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("h"), "id")
    evidence = ids.select(F.concat(F.lit("E_"), "h").alias("id"), F.when(F.col("id") % 6 == 0, "ambiguous").otherwise("matched").alias("status"))
    tokens = ids.select(F.expr("concat(CASE WHEN id % 2 = 0 THEN 'E_' ELSE 'M_' END, left(h, cast(1 + id % 8 as int)), '…')").alias("ref"))
    found = retrieval.catalogue(tokens, evidence, ids.select(F.concat(F.lit("M_"), "h").alias("id")), spark.range(3).select(F.col("id").alias("chunk_index")))
    assert most_rows(found) <= 8 * 6000 and found.count() == tokens.distinct().count()


def test_means_over_sessions_add_up_in_their_order(spark):
    rng, held = random.Random(1), {}
    while len(held) < 6:  # lists whose mean, added up backwards, rounds to another tenth
        x = [rng.randrange(2000) / 10 for _ in range(20)]
        one, two = (functools.reduce(lambda a, b: a + b, y) / len(y) for y in (x, x[::-1]))
        if f"{one:.1f}" != f"{two:.1f}":
            held[len(held)] = (x, float(f"{one:.1f}"))
    rows = [(c, k, v, 1, "me", "me") for c, (x, _) in held.items() for k, v in reversed(list(enumerate(x)))]
    summary = spark.createDataFrame(rows, "conv_id int, session int, duration_minutes double, message_count int, initiator string, closer string").coalesce(1)
    assert {r.conv_id: r.avg_minutes for r in statistics.session_shape(summary).collect()} == {c: want for c, (_, want) in held.items()}
    none = statistics.session_shape(summary.withColumn("duration_minutes", F.lit(None).cast("double"))).first()
    assert none.avg_minutes is None and none.n_sessions == 20
