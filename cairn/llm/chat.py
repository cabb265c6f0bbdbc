"""Chat formatting with tool calls linked to their results.

A turn is a plain message unless its text is a JSON object of one of two shapes: an assistant's
{"content"?, "tool_calls": [{"id", "name", "arguments"}]} (arguments an object or its JSON text), or a tool's
{"tool_call_id", "content"}. Calls and results are linked by a hash join on conversation and id. The links form a
graph of two levels, call before result, so a topological order is: by the later of a result's own turn and its
call's turn, then level, then own turn. Arguments are checked against the tool's JSON schema (type or a list of
types, required, properties, additionalProperties, enum, items, minimum, maximum; true and false are schemas), which are
looked through before the job: one that can't be judged is a ValueError. Messages are serialised as canonical JSON: sorted
keys, no spaces, characters as they are (a lone surrogate, which no text can hold, as its \\u escape).

The result has one row for each message, so a long conversation never meets in one task; `assemble` joins messages to
one text for each conversation where such a text is wanted.

Defined cases: null text is empty content; a text that is not valid JSON of these shapes, or holds a number beyond a
double (1e999) or NaN, is plain content; where an id
is called twice the first call (turn, then place) is the one results link to; a result without a call is an orphan and
keeps its place; a call without a result is not counted in n_linked; a null conv_id is no conversation and a call without
a turn has no place, so neither links to anything; repeated rows give repeated messages; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_documents, narrow, read_table, stored, text_or_empty

SURROGATE = re.compile("[\ud800-\udfff]")
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": float, "integer": int}


def encodable(text: str) -> str:
    """`text` with lone surrogates written as escapes."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return encodable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def checked(schema, at: str = "$") -> None:
    """Raises ValueError where `schema` says what `violations` can't judge; other keywords are ignored, as JSON schema wants."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema is an object or a boolean")
    kinds = schema.get("type", [])
    for kind in kinds if isinstance(kinds, list) else [kinds]:
        if kind not in TYPES:
            raise ValueError(f"{at}: unknown type {kind!r}")
    for key in ("minimum", "maximum"):
        if key in schema and (isinstance(schema[key], bool) or not isinstance(schema[key], (int, float))):
            raise ValueError(f"{at}: {key} is not a number")
    if not isinstance(schema.get("enum", []), list) or not isinstance(schema.get("required", []), list) or not isinstance(schema.get("properties", {}), dict):
        raise ValueError(f"{at}: enum and required are lists, properties an object")
    for k, v in schema.get("properties", {}).items():
        checked(v, f"{at}.{k}")
    for key in ("items", "additionalProperties"):
        if key in schema:
            checked(schema[key], f"{at}.{key}")


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and (kind == "number" or value == int(value))
    return isinstance(value, TYPES[kind])


def _same(a, b) -> bool:
    """Equality of JSON values: true is not 1, 1.0 is 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def violations(value, schema, at: str = "$") -> list[str]:
    """What in `value` breaks `schema` (an object, or true or false for anything or nothing), each as place and reason."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    found, kinds = [], schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(_is(value, kind) for kind in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if _is(value, "number") and ("minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]):
        found.append(f"{at}: out of range")
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            found += violations(v, known.get(k, others), f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += violations(v, schema["items"], f"{at}[{i}]")
    return found


def parsed(role: str | None, text: str, schemas: dict[str, dict]) -> tuple[str, list[dict], str | None]:
    """(canonical message, calls with id, name, arguments and problems, id of the call that a result answers)."""
    plain = (canonical({"role": role, "content": text}), [], None)
    if role not in ("assistant", "tool") or not text.lstrip().startswith("{"):
        return plain
    try:
        value = json.loads(text)
        if role == "tool":
            if not isinstance(value.get("tool_call_id"), str):
                return plain
            content = value.get("content", "")
            content = content if isinstance(content, str) else canonical(content)
            return canonical({"role": role, "tool_call_id": value["tool_call_id"], "content": content}), [], encodable(value["tool_call_id"])
        raw = value.get("tool_calls")
        if not isinstance(raw, list) or not all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in raw):
            return plain
        calls, shown = [], []
        for c in raw:
            arguments, problems = c.get("arguments", {}), []
            if isinstance(arguments, str):
                try:
                    arguments = json.loads(arguments)
                except ValueError:
                    problems = ["$: not JSON"]
            if not problems:
                problems = violations(arguments, schemas[c["name"]]) if c["name"] in schemas else ["unknown tool"]
            calls.append({"id": encodable(c["id"]), "name": encodable(c["name"]), "arguments": canonical(arguments), "problems": [encodable(p) for p in problems]})
            shown.append({"id": c["id"], "name": c["name"], "arguments": arguments})
        content = value.get("content") or ""
        return canonical({"role": role, "content": content if isinstance(content, str) else canonical(content), "tool_calls": shown}), calls, None
    except (ValueError, OverflowError, RecursionError):
        return plain


MESSAGE = "conv_id long, turn long, role string, message string, calls array<struct<id: string, name: string, arguments: string, problems: array<string>>>, answers string"


def messages(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Each turn parsed: conv_id, turn, role, message (canonical JSON), calls, answers."""
    known = dict(schemas or {})
    for name, schema in known.items():
        checked(schema, name)

    def run(columns):
        done = [parsed(r, t, known) for r, t in zip(columns["role"], columns["text"], strict=True)]
        return {k: columns[k] for k in ("conv_id", "turn", "role")} | {k: [d[i] for d in done] for i, k in enumerate(("message", "calls", "answers"))}

    rows = narrow(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text_or_empty().alias("text")
    )
    return map_documents(rows, run, MESSAGE)


def formatted(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row for each message with its links, validity and place in the topological order (order_turn, order_level, turn)."""
    parsed_turns = stored(messages(turns, schemas), "turns")  # six branches read it
    calls = parsed_turns.where(F.size("calls") > 0).select("conv_id", "turn", F.posexplode("calls").alias("place", "call"))
    first = calls.groupBy("conv_id", F.col("call.id").alias("answers")).agg(F.min(F.struct("turn", "place")).alias("f"))
    first = first.select("conv_id", "answers", F.col("f.turn").alias("call_turn"))
    answered = parsed_turns.where("answers IS NOT NULL").groupBy("conv_id", "answers").agg(F.count("*").alias("n_results"))
    linked = (
        calls.select("conv_id", "turn", F.col("call.id").alias("answers"))
        .distinct()
        .join(answered, ["conv_id", "answers"])
        .groupBy("conv_id", "turn")
        .agg(F.count("*").alias("n_linked"))
    )
    results = parsed_turns.where("answers IS NOT NULL").join(first, ["conv_id", "answers"], "left")
    others = parsed_turns.where("answers IS NULL").withColumn("call_turn", F.lit(None).cast("long"))
    rows = others.unionByName(results.select(others.columns))
    with_calls = rows.where(F.size("calls") > 0).join(linked, ["conv_id", "turn"], "left")
    without = rows.where(F.size("calls") == 0).withColumn("n_linked", F.lit(None).cast("long"))
    return without.unionByName(with_calls.select(without.columns)).select(
        "conv_id",
        "turn",
        "role",
        "message",
        F.size("calls").cast("long").alias("n_calls"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.expr("cast(size(filter(calls, c -> size(c.problems) > 0)) AS bigint)").alias("n_invalid"),
        F.col("answers").alias("answers_id"),
        "call_turn",
        F.expr("answers IS NOT NULL AND call_turn IS NULL").alias("orphan"),
        F.greatest("turn", "call_turn").alias("order_turn"),
        F.expr("CASE WHEN call_turn IS NULL THEN 0L ELSE 1L END").alias("order_level"),
    )


def assemble(rows: DataFrame) -> DataFrame:
    """conv_id and chat: the messages of each conversation, in order, as one canonical JSON array. A conversation is one value here."""
    ordered = F.sort_array(F.collect_list(F.struct("order_turn", "order_level", "turn", "message")))
    return rows.groupBy("conv_id").agg(ordered.alias("m")).select("conv_id", F.expr("concat('[', array_join(transform(m, x -> x.message), ','), ']')").alias("chat"))


#: Tools that the conversations may call, with the schemas of their arguments.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
}


def query(spark, sf_dir: str) -> DataFrame:
    return formatted(read_table(spark, sf_dir, "conversations"), TOOLS)


#: The synthetic conversations hold no tool calls, so in SQL every turn is a plain message.
ORACLE_SQL = """
SELECT conv_id, turn, role, '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' AS message,
       0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid, NULL::VARCHAR AS answers_id, NULL::BIGINT AS call_turn,
       false AS orphan, turn AS order_turn, 0::BIGINT AS order_level
FROM conversations
"""
