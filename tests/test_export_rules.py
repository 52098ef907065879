"""The two JSON formats by name, and the usage log."""

import pytest

from threadloom.sources import exports


def test_native_rows_and_rules():
    rows = [{"type": "文本消息", "content": "a", "isSend": 1, "formattedTime": "x", "createTime": 5}, {"type": "系统消息", "content": None, "isSend": 0, "formattedTime": "", "senderId": ["any"]}]
    got = exports.native({"messages": rows})
    assert [(r["type"], r["content"], r["is_send"], r["create_time"]) for r in got] == [("文本消息", "a", 1, "5"), ("系统消息", None, 0, None)]
    for change in ({"isSend": "1"}, {"type": "text"}, {"content": 3}, {"formattedTime": None}, {"senderId": 1.5}):
        with pytest.raises(exports.Bad):
            exports.native({"messages": [rows[0] | change]})
    with pytest.raises(exports.Bad):
        exports.native({"session": {"type": "Group"}, "messages": rows})


def test_canonical_rows_and_rules():
    people = [{"id": "a", "role": "me", "name": "A"}, {"id": "b", "role": "other", "name": "B"}]
    one = {"id": "1", "sender_id": "b", "time": "1970-01-01 08:00:01", "type": "image", "content": None}
    d = {"schema": "chat.conversation", "version": 1, "session": {"id": "s", "type": "private", "display_name": "d"}, "participants": people, "messages": [one, {**one, "id": "2", "sender_id": "a", "type": "text", "content": "hi"}]}
    assert [(r["type"], r["content"], r["is_send"], r["create_time"], r["source_message_id"]) for r in exports.canonical(d)] == [("图片消息", "[图片消息]", 0, "1", "1"), ("文本消息", "hi", 1, "1", "2")]
    for change in ({"type": "text"}, {"sender_id": "c"}, {"time": "1970-1-1 8:00:01"}, {"id": ""}, {"type": "other"}):
        with pytest.raises(exports.Bad):
            exports.canonical(d | {"messages": [one | change]})
    with pytest.raises(exports.Bad, match="repeated"):
        exports.canonical(d | {"messages": [one, one]})


def test_usage_log_grows(spark, tmp_path):
    for k in range(3):
        exports.append_usage(spark.createDataFrame([("s", k)], "session_id string, total_tokens int"), str(tmp_path / "log"))
    assert sorted(r.total_tokens for r in spark.read.json(str(tmp_path / "log")).collect()) == [0, 1, 2]


def test_directions_take_turns():
    from threadloom.operators import selection

    rows = ["- a / support: 1", "- b / support: 2", "- c / support: 3", "- d / against: 4", "plain", "反证 text"]
    order = selection.balanced_order(rows)
    assert sorted(order) == list(range(6)) and {selection.direction_of(rows[k]) for k in order[:3]} == {"support", "against", "paragraph"}
    assert {selection.direction_of(rows[k]) for k in order[-1:]} == {"support"} and selection.balanced_order([]) == []
