import json
import random

from spanloom.llm import tool_calls as t

SCHEMA = "conv_id long, turn long, role string, text string, json string"
call = lambda i, name="search", **a: "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": a}) + "</tool_call>"
result = lambda i, content: "<tool_result>" + json.dumps({"tool_call_id": i, "content": content}) + "</tool_result>"


def run(spark, rows, schemas=t.SCHEMAS):
    return {r["conv_id"]: r for r in t.linked_conversations(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), schemas).collect()}


def test_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "first " + call("b", query="${a.0}") + call("a", query="x", top_k=3) + " end"),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": "é"}})),
        (1, 3, "tool", result("b", "done") + result("q", 1)),
        (1, 4, "assistant", call("c", name="nope") + call("d", query="", top_k=0, more=1) + "<tool_call>{bad</tool_call>"),
        (1, 5, "assistant", call("a", query="again")),
    ]
    r = run(spark, rows)[1]
    assert (r["messages"], r["calls"], r["linked"], r["invalid"], r["problems"], r["cyclic"]) == (6, 5, 2, 2, 2, 0)
    got = json.loads(r["json"])
    assert r["json"] == json.dumps(got, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and "é" in r["json"]
    assert [c["id"] for c in got["tool_calls"]] == ["a", "b", "c", "d", "a"]
    assert got["tool_calls"][0]["result"] == {"z": 1, "a": "é"} and got["messages"][1]["content"] == "first  end"
    assert got["tool_calls"][2]["problems"] == ["no_result", "unknown_tool"] and got["tool_calls"][4]["problems"] == ["duplicate_call"]
    assert got["tool_calls"][3]["problems"] == ["no_result", "$.more: additionalProperties", "$.query: minLength", "$.top_k: minimum"]
    assert {p["problem"] for p in got["problems"]} == {"orphan_result", "malformed"}


def test_whole_message_calls_and_cycles(spark):
    rows = [(5, 0, "assistant", json.dumps({"content": None, "tool_calls": [{"id": "x", "function": {"name": "calculator", "arguments": json.dumps({"expression": "${y}"})}}, {"id": "y", "name": "calculator", "arguments": {"expression": "${x}"}}, {"id": "z", "name": "calculator", "arguments": {"expression": "1"}}]}))]
    r = run(spark, rows)[5]
    got = json.loads(r["json"])
    assert [c["id"] for c in got["tool_calls"]] == ["z", "x", "y"] and r["cyclic"] == 2 and "cycle" in got["tool_calls"][1]["problems"]


def test_topological_order_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 8)
        calls = [{"id": str(i), "needs": {str(rng.randrange(n)) for _ in range(rng.randrange(3))}} for i in range(n)]
        order, cyclic = t.topological(calls)
        assert sorted(c["id"] for c in order) == sorted(c["id"] for c in calls)
        place = {c["id"]: k for k, c in enumerate(order)}
        done, left = [], list(range(n))  # smallest free one first
        while free := [i for i in left if all(int(x) in done for x in calls[i]["needs"])]:
            done.append(free[0])
            left.remove(free[0])
        assert [int(c["id"]) for c in order] == done + left and cyclic == set(left)
        assert all(place[x] < place[c["id"]] for c in order for x in c["needs"] if int(c["id"]) in done)


def test_schema_keywords():
    s = {"type": "object", "properties": {"a": {"type": ["integer", "null"]}, "b": {"type": "array", "items": {"enum": [1, "x"]}, "minItems": 1}, "c": {"anyOf": [{"const": 1}, {"pattern": "^q"}]}, "d": {"type": "number", "maximum": 2}}, "required": ["a"]}
    assert t.violations({"a": None, "b": [1, "x"], "c": "qq", "d": 1.5}, s) == []
    assert t.violations({"a": True, "b": [], "c": "z", "d": 3}, s) == ["$.a: type", "$.b: minItems", "$.c: anyOf", "$.d: maximum"]
    assert t.violations({"b": [2]}, s) == ["$.a: required", "$.b[0]: enum"] and t.violations([], s) == ["$: type"]


def test_edges(spark):
    rows = [(1, 0, None, None), (1, None, "user", "late"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (None, 0, "user", "gone"), (2, 0, "user", ""), (3, 0, "user", "y" * 500_000)]
    got = run(spark, rows)
    assert got.keys() == {1, 2, 3}
    assert json.loads(got[1]["json"])["messages"] == [{"content": None, "role": None}, {"content": "a", "role": "user"}, {"content": "b", "role": "user"}, {"content": "late", "role": "user"}]
    assert len(json.loads(got[3]["json"])["messages"][0]["content"]) == 500_000
    assert run(spark, []) == {}


def test_hostile_json(spark):
    block = lambda body: f"<tool_call>{body}</tool_call>"
    deep = "[" * 20_000 + "]" * 20_000
    texts = [
        block('{"id": "a", "name": "n", "arguments": ' + deep + "}"),
        block('{"id": "b", "name": "n", "arguments": {"x": 1e999}}'),
        block('{"id": "c", "name": "n", "arguments": {"x": NaN}}'),
        block('{"id": "d", "name": "n", "arguments": {"x": "\\ud800 \\ud83d\\ude00"}}'),
        block('{"id": "e\\udc00", "name": "n", "arguments": "' + deep + '"}'),
        block('{"id": true, "name": "n"}'),
        block('{"id": 7, "name": "n", "arguments": ' + "9" * 5000 + "}"),
        deep,
        '{"tool_calls": ' + deep + "}",
        '{"content": "x", "tool_calls": [1, null, {"id": "f", "function": {"name": "n"}}]}',
        block('{"id": "g", "name": "n", "arguments": {"k": 1, "k": 2}}'),
        block('{"id": "h", "name": "n", "arguments": ' + "[" * 90 + "]" * 90 + "}"),
    ]
    r = run(spark, [(1, i, "assistant", x) for i, x in enumerate(texts)], {"n": True})[1]
    got = json.loads(r["json"], parse_constant=lambda x: 1 / 0)
    calls = {c["id"]: c for c in got["tool_calls"]}
    assert calls.keys() == {"d", "f", "g", "h"} and calls["d"]["arguments"] == {"x": "� \U0001f600"} and calls["g"]["arguments"] == {"k": 2}
    assert sum(p["count"] for p in got["problems"] if p["problem"] == "malformed") == 8
    assert run(spark, [(1, 0, "assistant", call("a"))], {"search": False})[1]["invalid"] == 1


def test_linking_against_brute_force(spark):
    """Random conversations, linked by loops over all pairs of messages."""
    rng = random.Random(5)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(9)):
            blocks = [rng.choice([lambda: call(rng.choice("abcd"), rng.choice(["search", "other"]), query=rng.choice(["x", "", "${b}", "${c.0}"])), lambda: result(rng.choice("abcde"), rng.randrange(5)), lambda: "<tool_result>{</tool_result>", lambda: "text "])() for _ in range(rng.randrange(4))]
            rows.append((conv, turn, "assistant", "".join(blocks)))
    got = run(spark, rows)
    for conv in {r[0] for r in rows}:
        calls, results, malformed = [], [], 0
        for _, turn, _, text in sorted(r for r in rows if r[0] == conv):
            for part in text.replace("<tool_", "\0<tool_").split("\0"):
                body = part.partition(">")[2].partition("</")[0]
                if part.startswith("<tool_call>"):
                    calls.append((turn, json.loads(body)))
                elif part.startswith("<tool_result>"):
                    if body == "{":
                        malformed += 1
                    else:
                        results.append((turn, json.loads(body)))
        want, problems, linked = [], [], 0
        for k, (turn, c) in enumerate(calls):
            mine = [r for _, r in results if r["tool_call_id"] == c["id"]]
            notes = []
            if any(o["id"] == c["id"] for _, o in calls[:k]):
                notes, mine = ["duplicate_call"], []
            elif not mine:
                notes = ["no_result"]
            if c["name"] == "other":
                notes.append("unknown_tool")
            elif c["arguments"]["query"] == "":
                notes.append("$.query: minLength")
            linked += bool(mine)
            want.append((c["id"], turn, tuple(notes), mine[0]["content"] if mine else "none"))
        for k, (turn, r) in enumerate(results):
            if any(o["tool_call_id"] == r["tool_call_id"] for _, o in results[:k]):
                problems.append(("duplicate_result", turn))
            elif not any(c["id"] == r["tool_call_id"] for _, c in calls):
                problems.append(("orphan_result", turn))
        doc = json.loads(got[conv]["json"])
        have = [(c["id"], c["message"], tuple(n for n in c["problems"] if n != "cycle"), c.get("result", "none")) for c in doc["tool_calls"]]
        assert sorted(map(str, have)) == sorted(map(str, want)) and got[conv]["linked"] == linked
        assert sorted((p["problem"], p["message"]) for p in doc["problems"] if p["problem"] != "malformed") == sorted(problems)
        assert sum(p.get("count", 0) for p in doc["problems"]) == malformed
