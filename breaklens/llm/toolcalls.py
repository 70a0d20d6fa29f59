"""Chat formatting by linking tool calls.

Calls and results are joined by conversation and call id, calls are put in topological order of what they
depend on, their arguments are checked against the tool's schema, and every call is written as canonical
JSON (sorted keys, no spaces, UTF-8).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.session import pin

DEPTH = 900  # levels of lists and objects
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[][{}]', re.S)
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """Canonical JSON; lone surrogates, which UTF-8 cannot hold, are escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = "".join(json.dumps(c)[1:-1] if "\ud800" <= c <= "\udfff" else c for c in text)
    return text


def _finite(text: str) -> float:
    number = float(text)
    if not math.isfinite(number):
        raise ValueError(f"{text} is no finite number")
    return number


def parsed(text: str):
    """The JSON value of a text; numbers beyond a double, NaN, infinities and texts nested too deeply raise ValueError.

    The depth is bounded here, since what the parser itself bears depends on the Python version.
    """
    if text.count("[") + text.count("{") > DEPTH:
        depth = 0
        for mark in _MARKS.findall(text):
            depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(mark, 0)
            if depth > DEPTH:
                raise ValueError("nested too deeply")
    try:
        return json.loads(text, parse_float=_finite, parse_constant=_finite)
    except RecursionError:
        raise ValueError("nested too deeply") from None


def _fits(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or value == int(value))
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def schema_errors(value, schema: dict, path: str = "$") -> list[str]:
    """What is wrong with a JSON value: type (one or a list; no value is of an unknown type), enum, minimum, maximum, minLength, required, properties, items."""
    kind, out = schema.get("type"), []
    kinds = kind if isinstance(kind, list) else [kind] if kind else []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kinds and not any(_fits(value, k) for k in kinds):
        return [f"{path} is not {' or '.join(map(str, kinds))}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path} is not allowed")
    if number and value < schema.get("minimum", value):
        out.append(f"{path} is too small")
    if number and value > schema.get("maximum", value):
        out.append(f"{path} is too large")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{path} is too short")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k} is missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k} is not known")
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            out += schema_errors(v, schema["items"], f"{path}[{k}]")
    return out


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of the calls (conv_id, id, after): 0 without a prerequisite, else one above the highest.

    Prerequisites that do not exist are ignored. A call on a cycle, or behind one, gets no row. One round per
    level, each a join of the calls that are left; a conversation is never gathered.
    """
    nodes = pin(calls.select("conv_id", "id").distinct(), "calls")
    raw = calls.select("conv_id", "id", F.explode("after").alias("need")).distinct()
    have = nodes.withColumnRenamed("id", "need")
    left = pin(raw.join(have, ["conv_id", "need"], "left_semi").select("conv_id", "id", "need"), "call-edges")
    waiting, done, level = nodes, [], 0
    while True:
        blocked = left.select("conv_id", "id").distinct()
        ready = pin(waiting.join(blocked, ["conv_id", "id"], "left_anti"), "calls-ready")
        if ready.isEmpty():
            break
        done.append(ready.withColumn("level", F.lit(level)))
        waiting = pin(waiting.join(ready, ["conv_id", "id"], "left_anti"), "calls-waiting")
        left = pin(left.join(ready.withColumnRenamed("id", "need"), ["conv_id", "need"], "left_anti").select("conv_id", "id", "need"), "call-edges")
        level += 1
    out = nodes.withColumn("level", F.lit(0)).limit(0)
    for d in done:
        out = out.unionByName(d)
    return out


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call of `messages` (conv_id, turn, text, calls, result_of).

    `calls` is array<struct<id, name, arguments, after>> with arguments as JSON text; `result_of` names the
    call whose result the text is. Returned: conv_id, id, turn, name, level, n_results, valid, errors, json.
    A repeated call id counts once, at its first turn; several results stand in turn order in `json`. Null
    ids are not linked. level is null for calls that wait for each other. Arguments that are not JSON, and
    tools without a schema, are not valid.
    """
    opened = messages.select("conv_id", "turn", F.inline("calls")).where("id IS NOT NULL AND conv_id IS NOT NULL")
    row = F.struct("turn", "name", "arguments", "after")
    calls = pin(opened.groupBy("conv_id", "id").agg(F.min(row).alias("c")).select("conv_id", "id", "c.*"), "tool-calls")
    results = messages.where("result_of IS NOT NULL").select("conv_id", F.col("result_of").alias("id"), F.struct("turn", "text").alias("r"))
    own = calls.select("conv_id", "id").join(results, ["conv_id", "id"])  # results that belong to a call
    gathered = own.groupBy("conv_id", "id").agg(F.sort_array(F.collect_list("r")).alias("results"))
    linked = calls.join(call_levels(calls), ["conv_id", "id"], "left").join(gathered, ["conv_id", "id"], "left")
    fixed = dict(schemas)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            valid, wrong, texts = [], [], []
            for r in rows:
                try:
                    given = parsed(r["arguments"] or "")
                    errors = schema_errors(given, fixed[r["name"]]) if r["name"] in fixed else ["unknown tool"]
                except ValueError:
                    given, errors = r["arguments"], ["not JSON"]
                valid.append(not errors)
                wrong.append("; ".join(errors))
                found = [{"turn": x["turn"], "text": x["text"]} for x in r["results"] or []]
                texts.append(canonical({"arguments": given, "id": r["id"], "level": r["level"], "name": r["name"], "results": found, "turn": r["turn"]}))
            n = [len(r["results"] or []) for r in rows]
            columns = [batch.column(c) for c in ("conv_id", "id", "turn", "name", "level")]
            extra = [pa.array(n, pa.int64()), pa.array(valid, pa.bool_()), pa.array(wrong, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=["conv_id", "id", "turn", "name", "level", "n_results", "valid", "errors", "json"])

    kinds = {f.name: f.dataType.simpleString() for f in linked.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("conv_id", "id", "turn", "name", "level"))
    return linked.mapInArrow(finish, schema + ", n_results bigint, valid boolean, errors string, json string")
