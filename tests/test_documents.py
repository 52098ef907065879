"""Operators that no query covers, or not in full, against plain restatements."""

import itertools
import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import msgs
from threadloom.operators import chunks, evidence, grounding, redaction, retrieval, scoring, selection, sessions
from threadloom.sources import exports
from threadloom.streaming import live

LISTS = {c: [] for c in grounding.FIELDS}


def answer(**more):
    return json.dumps({**LISTS, **more}, ensure_ascii=False)


EVENT = {"summary": "s", "evidence": "hello", "confidence": "high"}


def test_answers_are_read_or_fall_back(spark):
    good = [answer(), answer(events=[EVENT]), "x ```json\n" + answer(events=[EVENT, EVENT]) + "```", "said {bad} " + answer(uncertainties=[{"question": "q", "reason": "r"}])]
    bad = [None, "", "nothing", "[1]", json.dumps({"events": []}), answer(events={}), answer(events=[{**EVENT, "confidence": "sure"}]), answer(events=[{**EVENT, "summary": 5}]), answer(events=[{**EVENT, "evidence": " "}]), answer(events=["x"])]
    rows = spark.createDataFrame([("c", k, a) for k, a in enumerate(good + bad)], "conv_id string, chunk_index int, answer string")
    documents, items = evidence.normalised(rows)
    got = {r.chunk_index: (r.parse_status, r.evidence_status) for r in documents.collect()}
    assert [got[k] for k in range(4)] == [("ok", "insufficient"), ("ok", "signals"), ("ok", "signals"), ("ok", "signals")]
    assert all(got[4 + k] == ("fallback", None) for k in range(len(bad)))
    each = items.groupBy("chunk_index", "category").count().collect()
    assert {(r.chunk_index, r.category): r["count"] for r in each} == {(1, "events"): 1, (2, "events"): 2, (3, "uncertainties"): 1, **{(4 + k, "uncertainties"): 1 for k in range(len(bad))}}


def test_ids_follow_the_binding_and_tampering_shows(spark):
    rows = spark.createDataFrame([("c", 1, a) for a in [answer(events=[EVENT, EVENT, {**EVENT, "evidence": "nowhere"}])]], "conv_id string, chunk_index int, answer string")
    items = evidence.normalised(rows)[1].withColumn("quote_id", F.col("at")).withColumn("quote", F.col("evidence"))
    said = spark.createDataFrame([("c", 1, "M1", 1, "oh hello there"), ("c", 1, "M2", 2, "bye")], "conv_id string, chunk_index int, message_id string, position int, content string")
    grounded = grounding.ground(items, said)
    named = evidence.identified(grounded, "S_x")
    assert sorted((r.at, r.status) for r in named.collect()) == [(0, "matched"), (2, "unmatched")]
    assert evidence.tampered(named, grounded, "S_x").count() == 0
    forged = named.withColumn("evidence_id", F.when(F.col("at") == 2, F.lit("E_0")).otherwise(F.col("evidence_id")))
    assert [r.at for r in evidence.tampered(forged, grounded, "S_x").collect()] == [2]


def test_quotes_with_and_without_anchors(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdef é中") for _ in range(n))
    said = [(k, text(rng.randrange(0, 700))) for k in range(60)] + [(60, None), (61, "aaaaa")]
    quotes = [(k, said[rng.randrange(60)][1][a : a + n]) for k, (a, n) in enumerate((rng.randrange(300), rng.randrange(1, 300)) for _ in range(80))] + [(80, "aa"), (81, "not there " * 30), (82, None), (83, "")]
    q = spark.createDataFrame([(1, i, t) for i, t in quotes], "c int, quote_id int, quote string")
    m = spark.createDataFrame([(1, f"M{i}", i, t) for i, t in said], "c int, message_id string, position int, content string")
    got = {r.quote_id: (r.status, r.candidate_count) for r in grounding.ground(q, m, ("c",)).collect()}
    for i, t in quotes:
        n = sum(t == x[k : k + len(t)] for _, x in said if x for k in range(len(x))) if t else 0
        assert got[i] == (("not_applicable", 0) if not t else ("unmatched", 0) if not n else ("matched" if n == 1 else "ambiguous", n)), t
    assert sum(len(t or "") > 100 for _, t in quotes) > 20
    plan = grounding.candidates(q, m, ["c"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_sessions_are_chosen_for_the_worst_answered_question():
    rng = random.Random(5)
    for _ in range(60):
        names = list("abcdef")[: rng.randrange(2, 7)]
        costs = {x: rng.randrange(5, 40) for x in names}
        groups = [(f"q{rng.randrange(3)}", frozenset(rng.sample(names, rng.randrange(1, min(3, len(names)) + 1))), rng.choice([0.5, 1.0, 2.0])) for _ in range(5)]
        budget = rng.randrange(20, 120)
        totals = {q: sum(w for of, _, w in groups if of == q) for q in {g[0] for g in groups}}

        def worth(chosen, groups=groups, totals=totals, costs=costs):
            return tuple(sorted(sum(w for of, need, w in groups if of == q and need <= chosen) / totals[q] for q in totals)), -sum(costs[x] for x in chosen)

        every = [frozenset(c) for n in range(len(names) + 1) for c in itertools.combinations(names, n) if sum(costs[x] for x in c) <= budget]
        best = selection.best_sessions(costs, groups, budget)
        assert worth(best) == max(map(worth, every))
        # What really fits is asked last: here every choice takes ten bytes more than its parts.
        fits = selection.best_sessions(costs, groups, budget, lambda c, costs=costs: sum(costs[x] for x in c) + 10)
        assert not fits or sum(costs[x] for x in fits) + 10 <= budget


def test_phase_budget_takes_whole_blocks():
    texts = [f"## 阶段总结 {k}\nintro\n### A\n- {'x' * 30}{k}\n- {'y' * 30}{k}\n### B\n| t{k}" for k in range(9)]
    assert selection.phase_budget(texts, 10_000) == "\n\n".join(texts) and selection.phase_budget([], 5) == ""
    for budget in (400, 700, 900):
        got = selection.phase_budget(texts, budget)
        assert len(got.encode()) <= budget + 200 and got.startswith("[阶段材料共 9 份，预算选取 6 份")
        blocks = {b for t in texts for b in t.split("\n")}
        assert all(line in blocks for part in got.split("\n\n")[1:] for line in part.split("\n"))


def test_repetition_windows_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["me", "other"]), f"2024-01-0{1 + k // 40} {10 + k % 40 // 8}:{rng.randrange(10, 60)}:00", rng.choice(["long text said often", f"own {k} " + "z" * rng.randrange(30)])) for k in range(200)]
    m = msgs(spark, rows)
    quotes = spark.createDataFrame([("c", "long text said often"), ("c", "own 3 zz")], "conv_id string, content string")
    many = [p for p, r in enumerate(rows, 1) if r[2] == "long text said often"]
    windows = {r.position: (r.left, r.right) for r in sessions.anchor_windows(m, m.where("content = 'long text said often'")).collect()}
    for budget in (0, 300, 900, 3000, 10**6):
        inside, want = set(), {}
        for p in many:
            new = set(range(windows[p][0], windows[p][1] + 1)) - inside
            room = budget - sum(len(rows[k - 1][2].encode()) + 1 for k in inside)
            want[p] = sum(len(rows[k - 1][2].encode()) + 1 for k in new) <= room
            if want[p]:
                inside |= new
        assert {r.position: r.covered for r in selection.repetition_windows(m, quotes, budget).collect()} == want


def test_baselines(spark):
    rows = spark.createDataFrame([(f"{p}{v}", p, v, "d", k) for k, (p, v) in enumerate(itertools.product("xyz", (1, 2)))], "case_id string, profile string, variant int, dim string, pred int")
    assert {r.case_id: r.pred for r in scoring.permuted(rows).collect()} == {"x1": 2, "x2": 3, "y1": 4, "y2": 5, "z1": 0, "z2": 1}
    drawn = [scoring.uniform(spark.range(3000).select(F.col("id").alias("case_id"), F.lit("d").alias("dim")), t).select("pred").collect() for t in (0, 0, 1)]
    assert drawn[0] == drawn[1] != drawn[2] and {r.pred for r in drawn[0]} == {0, 1, 2}
    assert all(900 < sum(r.pred == k for r in drawn[0]) < 1100 for k in range(3))


def test_paired_difference_uses_the_same_draws(spark):
    rows = [(f"c{k}", f"p{k % 4}", "d", k % 3, (k * 7) % 3) for k in range(40)]
    a = spark.createDataFrame(rows, "case_id string, profile string, dim string, gold int, pred int")
    b = a.withColumn("pred", F.when(F.col("profile") == "p1", F.col("gold")).otherwise(F.col("pred")))
    weights = scoring.resample_weights(spark, ["p0", "p1", "p2", "p3"], 25)
    drawn = {}
    for r in weights.collect():
        drawn.setdefault(r.rep, {})[r.profile] = r.weight

    def f1(rows, weight):
        tp = sum(weight.get(p, 0) for _, p, _, g, x in rows if g == x)
        return 2 * tp / (2 * tp + 2 * sum(weight.get(p, 0) for _, p, _, g, x in rows if g != x))

    better = [(c, p, d, g, g if p == "p1" else x) for c, p, d, g, x in rows]
    got = {r.rep: r.difference for r in scoring.paired_difference(a, b, weights).collect()}
    assert all(abs(got[k] - (f1(rows, w) - f1(better, w))) < 1e-12 for k, w in drawn.items()) and len(got) == 25


def test_redacted_json_keeps_its_structure(spark):
    value = {"name": "Bob a@b.co", "confidence": "high", "Bob": ["Bob", 1, None, {"direction": "support", "text": 'q "x" \\ é Bob'}]}
    rows = spark.createDataFrame([("c", 0, json.dumps(value)), ("c", 1, "Bob said no"), ("c", 2, "{}")], "conv_id string, original_index int, answer string")
    known = spark.createDataFrame([("c", "Bob", "对方"), ("c", "high", "我")], "conv_id string, value string, alias string")
    got = {r.original_index: r.answer for r in redaction.redact_json(rows, grounding.ENUMS, known).collect()}
    assert json.loads(got[0]) == {"name": "对方 [邮箱1]", "confidence": "high", "Bob": ["对方", 1, None, {"direction": "support", "text": 'q "x" \\ é 对方'}]}
    assert got[1] == "对方 said no" and got[2] == "{}"


def test_policy_tells_terms_apart():
    assert redaction.policy() != redaction.policy(["a"]) == redaction.policy([" a ", "a"])


def test_scope_guard_and_revisions(spark):
    store = spark.createDataFrame([("S1", "p", 1), ("S1", "p", 2)], "source_id string, policy string, x int")
    assert retrieval.in_scope(store, "S1", "p").count() == 2
    with pytest.raises(Exception, match="another snapshot"):
        retrieval.in_scope(store, "S2", "p").collect()
    keys = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc")], "x string, y string").select(retrieval.revision(F.col("x"), F.col("y")).alias("k")).collect()
    assert len({r.k for r in keys}) == 3


def test_group_publishing_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "pub")
    one = {"messages": spark.createDataFrame([("c", 1, "M1"), ("c", 2, "M2")], "conv_id string, position int, message_id string"), "chunks": spark.createDataFrame([("c", 1, 1, 2)], "conv_id string, chunk_index int, start_message int, end_message int")}
    exports.publish_group(one, root, "r1")
    assert exports.read_ledger(spark, root)[0].count() == 2
    broken = {"messages": one["messages"].limit(1), "chunks": one["chunks"].select(F.raise_error(F.lit("no")).cast("string").alias("conv_id"))}
    with pytest.raises(Exception, match="no"):
        exports.publish_group(broken, root, "r2")
    assert exports.read_ledger(spark, root)[0].count() == 2 and not (tmp_path / "pub/_revisions/r2").exists()
    exports.publish_group({**one, "chunks": one["chunks"].withColumn("end_message", F.lit(1))}, root, "r3")
    with pytest.raises(ValueError, match="hold together"):
        exports.read_ledger(spark, root)
    exports.write_texts(spark.createDataFrame([("a", "line 1\nline 2")], "conv_id string, report string"), str(tmp_path / "texts"), "conv_id")
    assert [p.read_text() for p in (tmp_path / "texts/conv_id=a").glob("part-*")] == ["line 1\nline 2\n"]


def test_extractor_hook(spark):
    rows = spark.createDataFrame([("c", k, f"text {k}") for k in range(5)], "conv_id string, chunk_index int, transcript string")

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": frame["conv_id"], "chunk_index": frame["chunk_index"], "answer": '{"said": "' + frame["transcript"] + '"}'})

    assert sorted(r.answer for r in evidence.extracted(rows, model).collect()) == [f'{{"said": "text {k}"}}' for k in range(5)]


def test_shrink_schedule_ends_at_its_floors():
    now, steps = (chunks.SIZE, chunks.BYTES, chunks.PROMPT), 0
    while (then := chunks.shrink(*now)) is not None:
        assert all(b <= a and b >= f for a, b, f in zip(now, then, chunks.FLOORS, strict=True)) and then != now
        now, steps = then, steps + 1
    assert now[1:] == chunks.FLOORS[1:] and steps < 20


def run_stream(df, sink, path, mode="append"):
    q = df.writeStream.format("memory").queryName(sink).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_of_late_rows_windows_and_usage(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [("c", "2024-01-01 10:00:00", "me"), ("c", "2024-01-01 12:00:00", "me"), ("c", "2024-01-01 11:00:00", "other"), ("d", "2024-01-01 10:30:00", "me")]
    spark.createDataFrame(rows, "conv_id string, time string, sender string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id string, time timestamp, sender string").json(str(tmp_path / "in"))
    heard = live.Progress()
    spark.streams.addListener(heard)
    try:
        run_stream(live.out_of_order(stream), "late_rows", tmp_path / "k1")
        assert sorted((r.conv_id, str(r.time), r.late) for r in spark.table("late_rows").collect()) == [("c", "2024-01-01 10:00:00", False), ("c", "2024-01-01 11:00:00", True), ("c", "2024-01-01 12:00:00", False), ("d", "2024-01-01 10:30:00", False)]
        run_stream(live.tumbling(stream, "2 hours"), "windows", tmp_path / "k2", "complete")
        assert sum(r.total for r in spark.table("windows").collect()) == 4 and spark.table("windows").count() == 4
        usage = [{"session_id": "s", "time": "t", "stage": "a", "model": "m", "usage": {"prompt_tokens": "10", "completion_tokens": "2", "total_tokens": "12"}}] * 2
        (tmp_path / "log").mkdir()
        (tmp_path / "log/1.json").write_text("\n".join(map(json.dumps, usage)))
        run_stream(live.usage_log(spark, str(tmp_path / "log")), "usage_now", tmp_path / "k3", "complete")
        assert [(r.stage, r.requests, r.total_tokens) for r in spark.table("usage_now").collect()] == [("a", 2, 24)]
        for _ in range(50):
            if {e[0] for e in heard.events} >= {"started", "progress", "ended"}:
                break
            time.sleep(0.1)
        assert {e[0] for e in heard.events} >= {"started", "progress", "ended"} and any(e[3] == 4 for e in heard.events)
    finally:
        spark.streams.removeListener(heard)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "conv_id string, time timestamp, sender string"
    for k in range(2):
        spark.createDataFrame([("c", f"2024-01-0{k + 1} 10:00:00", "me")], "conv_id string, time string, sender string").coalesce(1).write.mode("append").json(str(source))
        q = live.out_of_order(spark.readStream.schema(schema).json(str(source))).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def plain_scores(rows):
    """rows: (gold, pred); the metrics of a bootstrap by definition."""
    known = [(g, p) for g, p in rows if g is not None]
    both = [(g, p) for g, p in known if p is not None]
    tp = sum(g == p for g, p in both)
    f1 = 2 * tp / (2 * tp + 2 * (len(both) - tp) + len(known) - len(both)) if known else None
    mae = sum(1 if p is None else abs(g - p) / 2 for g, p in known) / len(known) if known else None
    n = len(both)
    out = {"micro_f1": f1, "coverage": n / len(known) if known else None, "mae_penalised": mae, "coupling": (f1 + 1 - mae) / 2 if known else None}
    chance = sum((a - b) ** 2 for a, _ in both for _, b in both)
    out["weighted_kappa"] = 1 - sum((g - p) ** 2 for g, p in both) * n / chance if chance else None
    if n > 1:
        grand = sum(g + p for g, p in both) / (2 * n)
        msr = sum(2 * ((g + p) / 2 - grand) ** 2 for g, p in both) / (n - 1)
        columns = [sum(x[k] for x in both) / n for k in (0, 1)]
        msc = n * sum((c - grand) ** 2 for c in columns)
        mse = sum((x[k] - (x[0] + x[1]) / 2 - columns[k] + grand) ** 2 for x in both for k in (0, 1)) / (n - 1)
        down = msr + mse + 2 * (msc - mse) / n
        out["icc"] = (msr - mse) / down if abs(down) > 1e-15 else None
    return out


def test_bootstrap_of_all_metrics_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(f"c{k}", f"p{k % 6}", "d", rng.choice([0, 1, 2, None]), rng.choice([0, 1, 2, None])) for k in range(70)]
    df = spark.createDataFrame(rows, "case_id string, profile string, dim string, gold int, pred int")
    got = {r.metric: (r.low, r.high) for r in scoring.bootstrap(df, scoring.drawn_weights(df.select("profile"), 200)).collect()}
    draw, keys, values = random.Random(scoring.SEED), sorted({r[1] for r in rows}), {}
    for _ in range(200):
        drawn = [(r[3], r[4]) for k in draw.choices(keys, k=len(keys)) for r in rows if r[1] == k]
        for name, x in plain_scores(drawn).items():
            if x is not None:
                values.setdefault(name, []).append(x)
    assert got.keys() == set(scoring.INTERVALS)
    for name, x in values.items():
        x.sort()
        want = x[int(0.025 * (len(x) - 1))], x[int(0.975 * (len(x) - 1))]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[name], want, strict=True)), name


def test_queries_that_cannot_be_cited_and_cases_of_letters(spark):
    rows = spark.createDataFrame([("c", 1, 1, "图片消息", "STRASSE here"), ("c", 2, 2, "文本消息", "another Straße"), ("c", 3, 3, "图片消息", "only a picture")], "conv_id string, position int, session int, type string, content string")
    plan = spark.createDataFrame([("a", "support", " straße "), ("a", "challenge", "PICTURE"), ("b", "support", "none")], "question string, direction string, query string")
    hits = retrieval.proposition_hits(plan, rows)
    assert sorted((r.query.strip(), r.position) for r in hits.collect()) == [("PICTURE", 3), ("straße", 1), ("straße", 2)]
    weights = retrieval.query_weights(plan, hits, 3).drop("weight")
    got = {r["query"].strip(): r.status for r in retrieval.query_status(weights, hits.limit(0), retrieval.citable_hits(hits, rows, ("文本消息",))).collect()}
    assert got == {"straße": "budget_exceeded", "PICTURE": "missing_reference", "none": "no_match"}


def test_budgeted_summary_keeps_counts_and_takes_turns():
    rows = {"### A": [f"- E_{k:032x} / support: {'a' * 20}" for k in range(6)], "### B": [f"- E_{k:032x} x" for k in range(10, 13)]}
    notes = {"### A": ["- 总数 6"]}
    whole = evidence.budgeted_summary(rows, notes, 10_000)
    assert all(line in whole for of in rows.values() for line in of) and "- 总数 6" in whole
    wanted = rows["### A"][5]
    some = evidence.budgeted_summary(rows, notes, 420, (f"E_{5:032x}",))
    assert len(some.encode()) <= 420 and wanted in some and "- 总数 6" in some and sum(line in some for of in rows.values() for line in of) < 9
    assert evidence.budgeted_summary(rows, notes, 100).startswith("[") and len(evidence.budgeted_summary(rows, notes, 60).encode()) <= 60


def test_units_are_offered_in_turn_and_narrowed_where_they_do_not_fit():
    def unit(name, quarter, priority, *windows):
        return {"unit": name, "quarter": quarter, "priority": priority, "windows": list(windows)}

    units = [unit("long", 0, 1, (5, 0, 20), (40, 30, 60), (90, 80, 95)), unit("short", 0, 9, (200, 198, 203)), unit("late", 3, 2, (300, 299, 301), (305, 304, 306))]
    everything = selection.select_units(units, len, 1000)
    assert set(everything.whole) == {"long", "short", "late"} and len(everything.positions) == 21 + 31 + 16 + 6 + 6 and not everything.narrowed
    some = selection.select_units(units, len, 45)
    assert some.whole == ["short", "late"] and some.narrowed == {"long": [40]} and len(some.positions) == 6 + 31 + 6
    few = selection.select_units(units, len, 12)
    assert few.whole == ["short", "late"] and few.narrowed == {} and len(few.positions) == 12
    assert selection.select_units(units, lambda p: 50 + len(p), 40).positions == set()
    rng = random.Random(1)
    for _ in range(50):
        many = [unit(k, rng.randrange(4), k, *[(a, a - rng.randrange(4), a + rng.randrange(4)) for a in sorted(rng.sample(range(k * 40, k * 40 + 30), rng.randrange(1, 4)))]) for k in range(1, 9)]
        got = selection.select_units(many, len, budget := rng.randrange(5, 80))
        assert len(got.positions) <= budget
        for u in many:
            shown = [w[0] for w in u["windows"] if set(range(w[1], w[2] + 1)) <= got.positions]
            assert (u["unit"] in got.whole) == (len(shown) == len(u["windows"])) and got.narrowed.get(u["unit"], []) == ([] if u["unit"] in got.whole else shown)


def test_postings_count_every_trigram(spark):
    texts = [(1, "aaaa b"), (2, "Ab\U0001f600ab\U0001f600"), (3, "xy"), (4, None), (5, "")]
    want = {}
    for i, t in texts:
        low = (t or "").lower()
        for k in range(len(low) - 2):
            want[low[k : k + 3], i] = want.get((low[k : k + 3], i), 0) + 1
    assert {(r.trigram, r.doc): r.tf for r in retrieval.postings(spark.createDataFrame(texts, "evidence_id int, search_text string")).collect()} == want


def test_hit_sets_whose_hashes_add_up_beyond_a_long(spark):
    rows = spark.range(4000).select(F.lit("q").alias("question"), F.lit("a").alias("query"), F.lit(1).alias("conv_id"), F.col("id").alias("position"))
    rows = rows.where(F.xxhash64("conv_id", "position") > 1 << 61)
    got = retrieval.merged_hit_sets(rows.union(rows.withColumn("query", F.lit("A")))).collect()
    assert [(r.question, r.n, r.queries) for r in got] == [("q", rows.count(), ["A", "a"])]


def test_ranked_search_goes_through_its_index_once(spark):
    texts = [(k, "x", t) for k, t in enumerate(("a\U0001f600b\U0001f600b tion the re", "tion\ntion the re the re", "ti on", "", "the re", "tion the re " * 9))]
    rows = spark.createDataFrame(texts, "id int, role string, l string")
    index = retrieval.postings(rows, "id", "l")
    assert {r.trigram for r in index.where("doc = 0").collect()} == {t[k : k + 3] for t in (texts[0][2],) for k in range(len(t) - 2)}
    found = retrieval.bm25(rows, ["the re", "tion"], index)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp" not in plan  # what is left to read are numbers
    assert sorted(found.collect()) == sorted(retrieval.bm25(rows, ["the re", "tion"]).collect()) and {r.id for r in found.collect()} == {0, 1, 5}
