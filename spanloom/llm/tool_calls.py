"""Chat formatting with tool-call linking: one canonical JSON text for each conversation.

Calls and results are parsed from message texts. Calls: <tool_call>{"id", "name", "arguments"}</tool_call> in a text, or a text that
is an object with "tool_calls" of {"id", "function": {"name", "arguments"}} or {"id", "name", "arguments"}. Results:
<tool_result>{"tool_call_id", "content"}</tool_result>, or a message of role "tool" that is such an object. Calls and results are hash-joined by
(conversation, identifier); arguments are validated against the JSON schema of the tool (type, enum, const, required, properties,
additionalProperties, items, minimum, maximum, minLength, maxLength, pattern, minItems, maxItems, anyOf). A call depends on each call
whose identifier its arguments mention as {"$ref": id} or "${id}" or "${id.path}"; calls are ordered topologically,
earlier ones first where free, and each carries its result.

Defined results: null conversation ids are left out; exactly repeated rows count once; rows are ordered by turn (nulls last), role, text;
null roles and texts are JSON nulls; of calls (or results) with one identifier the first is linked, later ones are
reported "duplicate_call" ("duplicate_result"); a result without a call is "orphan_result", a call without one "no_result"; calls on a cycle,
or after one, follow in order of appearance with "cycle"; unparsable blocks stay text and count as "malformed", which holds too for numbers
beyond double precision, NaN, and values nested more than MOST_DEPTH deep; half surrogate pairs become U+FFFD; of keys that repeat in an object the last counts; a tool
without schema is "unknown_tool" if any schemas are given. Very long texts are parsed whole; other columns are ignored, whatever their names;
an empty table has no rows.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import store, trimmed

BLOCKS = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
HALF_PAIR = re.compile(r"[\ud800-\udfff]")
MOST_DEPTH = 100
REFERENCE = re.compile(r"\$\{([^}.\s]+)[^}]*\}")

#: Schemas used by the registered query: those of common tools.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "top_k": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"], "additionalProperties": False},
    "get_weather": {"type": "object", "properties": {"city": {"type": "string"}, "unit": {"enum": ["celsius", "fahrenheit"]}}, "required": ["city"]},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _number(text: str) -> float:
    if not math.isfinite(x := float(text)):
        raise ValueError(f"{text} is beyond double precision")
    return x


def _constant(text: str):
    raise ValueError(f"{text} is no JSON")


def _whole(text: str) -> str:
    """text without halves of surrogate pairs, which no UTF-8 can hold."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if HALF_PAIR.search(text) else text


def _clean(value, depth: int = 0):
    """value with whole strings; ValueError if it is nested too deep."""
    if depth > MOST_DEPTH:
        raise ValueError(f"nested more than {MOST_DEPTH} deep")
    if isinstance(value, str):
        return _whole(value)
    if isinstance(value, list):
        return [_clean(x, depth + 1) for x in value]
    return {_whole(k): _clean(x, depth + 1) for k, x in value.items()} if isinstance(value, dict) else value


def loads(text: str):
    """The value of a JSON text that can be written again; else ValueError."""
    try:
        return _clean(json.loads(text, parse_float=_number, parse_constant=_constant))
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def canonical(value) -> str:
    """JSON with sorted keys, no spare space, text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, object))


def violations(value, schema: dict | bool, at: str = "$") -> list[str]:
    """Where value breaks the schema, as "path: keyword". The schema true allows all, false nothing."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: false"]
    out = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: type"]
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{at}: enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: const")
    if "anyOf" in schema and all(violations(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: anyOf")
    if _is(value, "number"):
        out += [f"{at}: {k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value))), ("pattern", "pattern" in schema and not re.search(schema["pattern"], value))) if bad]
    if isinstance(value, list):
        out += [f"{at}: {k}" for k, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", len(value)))) if bad]
        for i, x in enumerate(value):
            out += violations(x, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in properties:
                out += violations(value[k], properties[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: additionalProperties")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(value[k], schema["additionalProperties"], f"{at}.{k}")
    return out


def references(value) -> set[str]:
    """Identifiers of the calls that a call's arguments mention."""
    if isinstance(value, dict):
        own = {value["$ref"]} if isinstance(value.get("$ref"), str) else set()
        return own.union(*(references(x) for x in value.values()))
    if isinstance(value, list):
        return set().union(*(references(x) for x in value))
    return set(REFERENCE.findall(value)) if isinstance(value, str) else set()


def _is_id(x) -> bool:
    return isinstance(x, (str, int)) and not isinstance(x, bool)


def _call(x) -> dict | None:
    if not isinstance(x, dict):
        return None
    f = x["function"] if isinstance(x.get("function"), dict) else x
    arguments = f.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = loads(arguments)
        except ValueError:
            return None
    if not _is_id(x.get("id")) or not isinstance(f.get("name"), str):
        return None
    return {"id": str(x["id"]), "name": f["name"], "arguments": arguments}


def _result(x) -> dict | None:
    if not isinstance(x, dict) or not _is_id(x.get("tool_call_id")):
        return None
    return {"id": str(x["tool_call_id"]), "content": x.get("content")}


def parse(role: str | None, text: str | None) -> tuple[str | None, list[dict], list[dict], int]:
    """(text that remains, calls, results, malformed blocks) of a message."""
    if not text:
        return text, [], [], 0
    if text.lstrip()[:1] == "{":
        try:
            whole = loads(text)
        except ValueError:
            whole = None
        if isinstance(whole, dict) and isinstance(whole.get("tool_calls"), list):
            calls = [_call(x) for x in whole["tool_calls"]]
            rest = whole.get("content")
            return rest if rest is None or isinstance(rest, str) else canonical(rest), [c for c in calls if c], [], sum(c is None for c in calls)
        if role == "tool" and (r := _result(whole)):
            return "", [], [r], 0
    calls, results, malformed, rest, at = [], [], 0, [], 0
    for m in BLOCKS.finditer(text):
        try:
            x = loads(m[2])
        except ValueError:
            x = None
        got = _call(x) if m[1] == "call" else _result(x)
        if got is None:
            malformed += 1
            continue
        (calls if m[1] == "call" else results).append(got)
        rest.append(text[at : m.start()])
        at = m.end()
    return "".join(rest) + text[at:], calls, results, malformed


def topological(calls: list[dict]) -> tuple[list[dict], set[int]]:
    """Calls (with "id" and "needs") so that each follows those it needs, by position where free; and the positions on or after cycles."""
    first: dict[str, int] = {}
    for i, c in enumerate(calls):
        first.setdefault(c["id"], i)
    # a reference to itself is a cycle too
    needs = [{first[r] for r in c["needs"] if r in first} for c in calls]
    users: list[list[int]] = [[] for _ in calls]
    for i, n in enumerate(needs):
        for j in n:
            users[j].append(i)
    open_ = [len(n) for n in needs]
    ready, out = [i for i, n in enumerate(open_) if not n], []
    heapq.heapify(ready)
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        for j in users[i]:
            open_[j] -= 1
            if not open_[j]:
                heapq.heappush(ready, j)
    cyclic = sorted(set(range(len(calls))) - set(out))
    return [calls[i] for i in out + cyclic], set(cyclic)


_PART = "id long, at int, role string, content string, kind string, call_id string, n int, body string, malformed int"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each message as one row of kind "message", and a row for each call and result in it; body is canonical JSON."""
    schema = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("role", pa.string()), ("content", pa.string()), ("kind", pa.string()), ("call_id", pa.string()), ("n", pa.int32()), ("body", pa.string()), ("malformed", pa.int32())])
    for batch in batches:
        out = []
        for i, at, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            rest, calls, results, malformed = parse(role, text)
            out.append((i, at, role, rest, "message", None, 0, None, malformed))
            out += [(i, at, None, None, "call", c["id"], n, canonical(c), 0) for n, c in enumerate(calls)]
            out += [(i, at, None, None, "result", r["id"], n, canonical(r), 0) for n, r in enumerate(results)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _serialise(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.sort(key=lambda p: (p["at"], p["kind"] != "message", p["kind"], p["n"]))
                calls, problems, linked, invalid = [], [], 0, 0
                for p in parts:
                    if p["kind"] == "call":
                        c = json.loads(p["body"])
                        notes = [] if p["link"] else ["duplicate_call"] if p["rank"] > 1 else ["no_result"]
                        if c["name"] in schemas:
                            notes += violations(c["arguments"], schemas[c["name"]])
                        elif schemas:
                            notes.append("unknown_tool")
                        linked += bool(p["link"])
                        invalid += any(n not in ("duplicate_call", "no_result") for n in notes)
                        calls.append(c | {"needs": references(c["arguments"]), "at": p["at"], "notes": notes, "result": json.loads(p["link"])["content"] if p["link"] else None, "linked": bool(p["link"])})
                    elif p["kind"] == "result" and not p["link"]:
                        problems.append({"problem": "duplicate_result" if p["rank"] > 1 else "orphan_result", "tool_call_id": p["call_id"], "message": p["at"]})
                    if p["malformed"]:
                        problems.append({"problem": "malformed", "count": p["malformed"], "message": p["at"]})
                order, cyclic = topological(calls)
                on_cycle = {id(calls[k]) for k in cyclic}
                rendered = []
                for c in order:
                    notes = c["notes"] + ["cycle"] * (id(c) in on_cycle)
                    rendered.append({"id": c["id"], "name": c["name"], "arguments": c["arguments"], "message": c["at"], "problems": notes} | ({"result": c["result"]} if c["linked"] else {}))
                messages = [{"role": p["role"], "content": p["content"]} for p in parts if p["kind"] == "message"]
                text = canonical({"conversation": i, "messages": messages, "tool_calls": rendered, "problems": problems})
                out.append((i, len(messages), len(calls), linked, invalid, len(problems), len(cyclic), text))
            if out:
                schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int32()) for n in ("messages", "calls", "linked", "invalid", "problems", "cyclic")), ("json", pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def linked_conversations(conversations: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, messages, calls, linked, invalid, problems, cyclic, json), one for each conversation."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).where("id is not null").distinct()
    order = Window.partitionBy("id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    # parsed once: messages, calls and results are each read from what is stored
    parts = store(rows.select("id", (F.row_number().over(order) - 1).alias("at"), "role", "text").mapInArrow(trimmed(_parts), _PART), "parts")
    ranked = parts.where("kind <> 'message'").withColumn("rank", F.row_number().over(Window.partitionBy("id", "kind", "call_id").orderBy("at", "n")))
    calls, results = (ranked.where((F.col("kind") == k) & (F.col("rank") == 1)).select("id", "call_id", F.col("body").alias("link")) for k in ("call", "result"))
    other = results.withColumn("kind", F.lit("call")).unionAll(calls.withColumn("kind", F.lit("result"))).withColumn("rank", F.lit(1))
    linked = ranked.join(other, ["id", "kind", "call_id", "rank"], "left")
    columns = ["id", "at", "role", "content", "kind", "call_id", "n", "body", "malformed", "rank", "link"]
    every = linked.select(*columns).unionAll(parts.where("kind = 'message'").withColumn("rank", F.lit(1)).withColumn("link", F.lit(None).cast("string")).select(*columns))
    grouped = every.groupBy("id").agg(F.collect_list(F.struct(*columns[1:])).alias("parts"))
    return grouped.mapInArrow(trimmed(_serialise(schemas or {})), "conv_id long, messages int, calls int, linked int, invalid int, problems int, cyclic int, json string")
