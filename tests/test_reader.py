"""The streaming data source of exports."""

import io
import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from threadloom.sources import exports, reader


def message(k, **change):
    return {"type": "文本消息", "content": f"t{k}", "isSend": k % 2, "formattedTime": "2024-01-01 00:00:00"} | change


def streamed(data, chunk=7):
    data = data if isinstance(data, bytes) else data.encode()
    out = [r for b in reader.batches(lambda: io.BytesIO(data), "x", chunk) for r in b.to_pylist()]
    return [{k: v for k, v in r.items() if k not in ("conv_id", "original_index", "error")} for r in out if r["error"] is None], [r["error"] for r in out if r["error"]]


def whole(data):
    try:
        return exports.parse_json(data if isinstance(data, bytes) else data.encode()), []
    except ValueError as e:
        return [], [str(e)]


CANONICAL = {
    "schema": "x.conversation", "version": 1, "session": {"id": "s", "type": "private", "display_name": "d"},
    "participants": [{"id": "a", "role": "me", "name": "A"}, {"id": "b", "role": "other", "name": "B"}],
    "messages": [{"id": f"m{k}", "sender_id": "ab"[k % 2], "time": "2024-01-01 00:00:00", "type": "text", "content": "é\\\" {[" * k + "."} for k in range(30)],
}
GOOD = [
    {"session": {"type": "private"}, "messages": [message(k, content=None if k == 3 else "\U0001f600]}\"" * k) for k in range(40)]},
    {"messages": [message(1)], "session": {"type": "private"}, "other": [1.5, {"messages": [2]}], "isGroup": False},
    CANONICAL, dict(reversed(CANONICAL.items())),
]
BAD = [
    {}, [], 3, "x", {"messages": []}, {"messages": 3}, {"messages": [1]}, {"messages": [message(1)], "isGroup": True}, {"messages": [message(1, isSend=True)]}, {"messages": [message(1, senderId="a"), message(3, senderId="b")]},
    CANONICAL | {"version": 2}, CANONICAL | {"messages": CANONICAL["messages"][:2] * 2}, CANONICAL | {"participants": []}, CANONICAL | {"session": {"id": "x@chatroom", "type": "private", "display_name": "d"}},
]


@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 20])
def test_stream_equals_the_parser_of_whole_files(chunk):
    for d in GOOD:
        for text in (json.dumps(d), json.dumps(d, ensure_ascii=False, indent=1), "﻿" + json.dumps(d)):
            assert streamed(text, chunk) == whole(text) and streamed(text, chunk)[0]
    for d in BAD:
        rows, errors = streamed(json.dumps(d), chunk)
        assert not rows and len(errors) == 1 and whole(json.dumps(d))[1], d
    for text in ("", "{", '{"messages": [', '{"messages": [{}', '{"a" 1}', "{} {}", '{"messages": [{"a": tru}]}', '{"a": "\x01"}', "nope", b'{"a": "\xff"}'):
        assert streamed(text, chunk)[0] == [] and len(streamed(text, chunk)[1]) == 1, text


def test_ids_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(reader, "hash", lambda x: 7, raising=False)
    assert len(streamed(json.dumps(CANONICAL))[0]) == 30
    assert streamed(json.dumps(CANONICAL | {"messages": CANONICAL["messages"] + CANONICAL["messages"][:1]}))[1] == ["a message id is repeated"]


def test_data_source_reads_only_the_files_it_is_asked_for(spark, tmp_path):
    reader.register(spark)
    for k in range(12):
        (tmp_path / f"Chat{k:02d}.json").write_text(json.dumps({"messages": [message(j) for j in range(k + 1)]}))
    (tmp_path / "Broken.json").write_text("{")
    (tmp_path / "note.txt").write_text("no export")
    load = lambda **o: spark.read.format("chat_exports").options(**o).load(str(tmp_path))
    assert load().groupBy().agg(F.count_if(F.col("error").isNull()).alias("n"), F.count("error").alias("bad")).first()[:] == (78, 1)
    assert {r.conv_id for r in load(names='["chat1", "T03"]', limit="2").collect()} == {"Chat03", "Chat10"}
    assert load().where("conv_id = 'Chat05'").count() == 6 and load().where("conv_id in ('Chat05', 'Chat01', 'x')").count() == 8
    assert load().where("conv_id like 'Chat1%' and is_send = 1").count() == 11
    (tmp_path / "Chat00.json").unlink()  # listed by the first of these, opened by neither
    asked = reader.Reader([(str(tmp_path / f"Chat{k:02d}.json"), 10) for k in range(12)])
    left = list(asked.pushFilters([reader.EqualTo(("conv_id",), "Chat05"), reader.EqualTo(("is_send",), 1)]))
    assert len(left) == 1 and [x for x, _ in asked.files] == [str(tmp_path / "Chat05.json")] and len(list(asked.read(asked.partitions()[0]))) == 1
    large = reader.Reader([(f"f{k}", reader.TOGETHER // 2 + 1) for k in range(3)] + [(f"g{k}", 1) for k in range(5)])
    assert [len(p.paths) for p in large.partitions()] == [1, 1, 6] and [p.paths for p in reader.Reader([]).partitions()] == [[]]


def test_written_exports_come_back(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"c/{c}", k, "文本消息", rng.choice([None, "", "a\nb", "\U0001f600\"\\"]), k % 2, "2024-01-01 00:00:00") for c in range(20) for k in range(rng.randrange(1, 9))]
    df = spark.createDataFrame([*rows, (None, 0, "文本消息", "x", 1, "")], "conv_id string, original_index int, type string, content string, is_send int, time_str string")
    exports.write_native(df, str(tmp_path))
    back = exports.read(spark, str(tmp_path)).where("error is null").select("conv_id", "original_index", "type", "content", "is_send", "time_str")
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((c.replace("/", "_"), *r)) for c, *r in rows)
    assert not list(tmp_path.glob(".*"))


def test_a_large_file_takes_little_memory(tmp_path):
    """A file of 192 MB is read in a process that may grow by a quarter of that."""
    path = tmp_path / "big.json"
    one = json.dumps(message(1, content="x" * 1000), ensure_ascii=False)
    with path.open("w") as f:
        f.write('{"session": {"type": "private"}, "messages": [' + one)
        for _ in range(192):
            f.write((", " + one) * (1_000_000 // len(one)))
        f.write("]}")
    code = f"""
import resource, sys
sys.path.insert(0, {str(reader.__file__.rpartition('/threadloom/')[0])!r})
from threadloom.sources import reader
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for b in reader.batches({str(path)!r}, "big"))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split())
    assert n > 150_000 and grown < 48, grown
