import random
import re
import time

from tests.llm.rows import awkward, empty
from threadloom.llm import passages
from threadloom.llm.queries import op4_line_hashing


def plain_spans(rows, least=passages.MIN_WORDS):
    """rows: (doc_id, text), no row twice."""
    docs = []
    for i, t in rows:
        own, at = [], 0
        for m in [*re.finditer(r"\n|(?<=\w[.!?])\s+", t or ""), None]:
            stop, after = (m.start(), m.end()) if m else (len(t or ""), 0)
            if (t or "")[at:stop].split():
                own.append((at, stop, " ".join((t or "")[at:stop].lower().split())))
            at = after
        docs.append((i, own))
    first = {}
    for i, own in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for n, (_, _, u) in enumerate(own):
            first.setdefault(u, (i, n))
    out = []
    for i, own in docs:
        run = []
        for n, (a, z, u) in [*enumerate(own), (-1, (0, 0, None))]:
            if u is not None and first[u] != (i, n):
                run.append((a, z, len(u.split()), first[u][0]))
                continue
            if run and sum(r[2] for r in run) >= least:
                out.append((i, run[0][0], run[-1][1], sum(r[2] for r in run), run[0][3]))
            run = []
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.start, r.end, r.n_words, r.kept_doc_id) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op4_line_hashing(spark, sf)) == plain_spans(rows)


def test_long_passages_go_wherever_they_stand_and_short_lines_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = " ".join(sentence(9) for _ in range(7))
    licence = "Released under some licence."
    rows = [(k, f"{sentence(30)} {sentence(8)}" + (f" {passage} {sentence(12)}" if k % 2 else f"\n{licence}")) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = {r.doc_id: r.text for r in passages.cut(df).collect()}
    assert [k for k in text if passage in text[k]] == [1]
    assert all(text[k] == t for k, t in rows if k % 2 == 0 or k == 1)
    assert all(text[k] == t.replace(passage, "") for k, t in rows if k % 2 and k > 1)


def test_awkward_rows(spark):
    rows = awkward(spark)
    assert got(passages.spans(rows)) == plain_spans(sorted({(r.doc_id, r.text) for r in rows.collect()}, key=str))
    out = passages.cut(rows).collect()
    assert len(out) == rows.count() and {f.name for f in passages.cut(rows).schema} == {*rows.columns, "removed"}
    assert sum(r.text == "" and r.removed is not None for r in out) <= 1
    assert passages.spans(empty(spark)).count() == 0 and passages.cut(empty(spark)).count() == 0


def test_cut_is_linear_and_replaces_a_column_removed(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [" ".join(word() for _ in range(22)) + "." for _ in range(6000)]
    long = "\n".join(f"{s}\nown{k}." for k, s in enumerate(shared))
    df = spark.createDataFrame([(1, "\n".join(shared), 5, 6, 7), (2, long, 5, 6, 7)], "doc_id long, text string, removed int, id int, hash int")
    began = time.monotonic()
    out = {r.doc_id: r for r in passages.cut(df).collect()}
    assert time.monotonic() - began < 15
    assert out[1].text == "\n".join(shared) and out[1].removed is None and (out[2].id, out[2].hash) == (6, 7)
    assert out[2].text == "\n".join(f"\nown{k}." for k in range(6000)) and len(out[2].removed) == 6000


def test_without_a_floor_every_later_occurrence_goes(spark):
    df = spark.createDataFrame([(1, "Some line.\nown one."), (2, "some  LINE.\nown two.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in passages.cut(df, 1).collect()} == {1: "Some line.\nown one.", 2: "\nown two."}
    assert {r.text for r in passages.cut(df).collect()} == {"Some line.\nown one.", "some  LINE.\nown two."}
