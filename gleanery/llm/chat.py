"""Chat formatting: link tool calls to results and serialise canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_rows, staged

CALL = "struct<call_id: string, name: string, arguments: string, json: boolean>"
TOOL = "struct<name: string, schema: string>"
PARSED = f"conv_id long, turn long, role string, content string, answers string, calls array<{CALL}>, tools array<{TOOL}>"


SURROGATE = re.compile("[\ud800-\udfff]")  # half of a pair, which UTF-8 cannot hold


def stored(text: str) -> str:
    """A string that a table can hold: lone surrogates as JSON escapes."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; numbers that JSON lacks are refused, lone surrogates escaped."""
    return stored(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def refused(name: str):
    raise ValueError(name)


def parsed_json(text: str):
    """The value of a JSON text; ValueError if it is none, holds NaN or an infinite number, or nests too deep to be written again."""
    try:
        value = json.loads(text, parse_constant=refused)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deep") from None
    return value


# JSON schema types and the Python types they admit.
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


# Keywords that problem() evaluates, and those that assert nothing.
CHECKED = frozenset("""type enum const properties required additionalProperties patternProperties propertyNames minProperties maxProperties dependentRequired items prefixItems contains minItems maxItems uniqueItems
minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern allOf anyOf oneOf not if then else $ref""".split())
NOTES = frozenset("title description default examples example deprecated readOnly writeOnly format $schema $id $comment $defs definitions contentMediaType contentEncoding strict".split())
DEEPEST = 64  # schemas within schemas, as $ref may turn in circles
STEPS, STEPS_A_CHARACTER = 20_000, 4  # what evaluating one call may cost, whatever its schema says


def same(a, b) -> bool:
    """Equality of JSON values: true is not 1, but 1.0 is."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def referred(root, ref: str):
    """The part of a schema that a local reference names; None if there is none."""
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        return None
    for part in ref.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(root, dict):
            root = root.get(part)
        else:
            root = root[int(part)] if isinstance(root, list) and part.isdigit() and int(part) < len(root) else None
    return root


class Unchecked(Exception):
    """A schema says what problem() does not evaluate."""


class Work:
    """The root schema of one call, results known so far and the steps that are left."""

    def __init__(self, root, steps: int):
        self.root, self.left, self.known = root, steps, {}

    def spend(self, steps: int) -> None:
        self.left -= steps
        if self.left < 0:
            raise Unchecked("too much work")

    def matches(self, pattern: str, text: str) -> bool:
        """Whether ``pattern`` is found, in time linear in the text; what that rules out (back references, looking around) is unchecked."""
        self.spend(1 + len(text) // 64)
        try:
            return pc.match_substring_regex(pa.array([text], pa.string()), pattern)[0].as_py()
        except (pa.ArrowInvalid, UnicodeEncodeError):
            raise Unchecked("pattern") from None


def problem(value, schema, at: str = "") -> str | None:
    """What is wrong with ``value`` under a JSON schema; None if nothing.

    A schema with a keyword that is neither evaluated nor a mere note, one that
    cannot be read, and one that takes more steps than the value's size
    allows, makes the value ``unchecked``, never valid.
    """
    try:
        return first_problem(value, schema, at, Work(schema, STEPS + STEPS_A_CHARACTER * len(json.dumps(value))), 0)
    except Unchecked as e:
        return f"{at or '/'}: unchecked, {e}"
    except (TypeError, ValueError, AttributeError, KeyError, ArithmeticError, RecursionError):
        return f"{at or '/'}: unchecked, schema cannot be read"


def mark(value):
    """A hashable that is equal where ``same`` is true."""
    if isinstance(value, list):
        return ("list", *map(mark, value))
    if isinstance(value, dict):
        return frozenset((k, mark(v)) for k, v in value.items())
    return (isinstance(value, bool), value)


def first_problem(value, schema, at: str, work: Work, depth: int) -> str | None:
    """The result for one (schema, value) is worked out once, however often ``$ref`` leads there."""
    key = (id(schema), id(value), at)
    if key not in work.known:
        work.known[key] = evaluated(value, schema, at, work, depth)
    return work.known[key]


def evaluated(value, schema, at: str, work: Work, depth: int) -> str | None:
    work.spend(1)
    if isinstance(schema, bool):
        return None if schema else f"{at or '/'}: not allowed"
    if not isinstance(schema, dict):
        raise Unchecked("schema is no object")
    if depth > DEEPEST:
        raise Unchecked("schemas too deep")
    if other := sorted(set(schema) - CHECKED - NOTES):
        raise Unchecked(other[0])
    if isinstance(schema.get("items"), list):
        raise Unchecked("items as a list")
    go = lambda v, s, to=at: first_problem(v, s, to, work, depth + 1)
    here = at or "/"
    if "$ref" in schema:
        target = referred(work.root, schema["$ref"])
        if target is None:
            raise Unchecked("$ref")
        if found := go(value, target):
            return found
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = any(isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) or k == "integer" and isinstance(value, float) and value.is_integer() for k in kinds)
        if not fits:
            return f"{here}: not {' or '.join(kinds)}"
    work.spend(len(schema.get("enum", ())) + len(schema.get("required", ())))
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        return f"{here}: not one of the allowed values"
    if "const" in schema and not same(value, schema["const"]):
        return f"{here}: not the allowed value"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"] or "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            return f"{here}: too small"
        if "maximum" in schema and value > schema["maximum"] or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            return f"{here}: too large"
        if "multipleOf" in schema and Decimal(str(value)) % Decimal(str(schema["multipleOf"])):
            return f"{here}: not a multiple"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"{here}: wrong length"
        if "pattern" in schema and not work.matches(schema["pattern"], value):
            return f"{here}: does not match the pattern"
    if isinstance(value, dict):
        known, patterns, other = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}/{name}: missing"
        for name, needed in schema.get("dependentRequired", {}).items():
            for n in needed if name in value else []:
                if n not in value:
                    return f"{at}/{n}: missing"
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            return f"{here}: wrong number of properties"
        for name, item in value.items():
            if "propertyNames" in schema and go(name, schema["propertyNames"]):
                return f"{at}/{name}: name not allowed"
            under = [known[name]] if name in known else []
            under += [s for p, s in patterns.items() if work.matches(p, name)]
            if not under and other is False:
                return f"{at}/{name}: unknown"
            for s in under or [other]:
                if found := go(item, s, f"{at}/{name}"):
                    return found
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{here}: wrong number of items"
        if schema.get("uniqueItems") and len(set(map(mark, value))) < len(value):
            return f"{here}: items repeat"
        heads = schema.get("prefixItems", [])
        for k, item in enumerate(value):
            if found := go(item, heads[k] if k < len(heads) else schema.get("items", True), f"{at}/{k}"):
                return found
        if "contains" in schema and all(go(x, schema["contains"]) for x in value):
            return f"{here}: holds no item that fits"
    for part in schema.get("allOf", []):
        if found := go(value, part):
            return found
    if "anyOf" in schema and all([go(value, p) for p in schema["anyOf"]]):
        return f"{here}: fits none of the schemas"
    if "oneOf" in schema and sum(go(value, p) is None for p in schema["oneOf"]) != 1:
        return f"{here}: does not fit exactly one of the schemas"
    if "not" in schema and go(value, schema["not"]) is None:
        return f"{here}: fits what it must not"
    if "if" in schema:
        part = "then" if go(value, schema["if"]) is None else "else"
        if part in schema and (found := go(value, schema[part])):
            return found
    return None


def declared(role: str | None, text: str | None) -> list[dict]:
    """Tools that a system or developer message declares: a JSON object with ``tools``, a list of ``{"name", "parameters"}``, or with both under ``function``."""
    if role not in ("system", "developer") or not (text or "").lstrip().startswith("{"):
        return []
    try:
        body = parsed_json(text)
    except ValueError:
        return []
    out = []
    tools = body.get("tools") if isinstance(body, dict) else None
    for tool in tools if isinstance(tools, list) else []:
        inner = tool.get("function") if isinstance(tool, dict) and isinstance(tool.get("function"), dict) else tool
        if isinstance(inner, dict) and isinstance(inner.get("name"), str):
            name = stored(inner["name"])
            schema = next((inner[k] for k in ("parameters", "input_schema", "inputSchema") if k in inner), {"type": "object"})
            out.append({"name": name, "schema": canonical(schema)})
    return out


def read_call(raw: dict) -> dict:
    """One call, ``{"id", "name", "arguments"}`` or with name and arguments under ``function``."""
    inner = raw.get("function") if isinstance(raw.get("function"), dict) else raw
    name, arguments = inner.get("name"), inner.get("arguments", {})
    is_json = True
    if isinstance(arguments, str):
        try:
            arguments = parsed_json(arguments)
        except ValueError:
            is_json = False
    call_id = raw.get("id")
    return {"call_id": None if call_id is None else named(call_id), "name": None if name is None else named(name), "arguments": canonical(arguments), "json": is_json}


def named(value) -> str:
    """An identifier or a name as a string; what is none is taken as its JSON."""
    return stored(value) if isinstance(value, str) else canonical(value)


def call_problem(call: dict, schemas: dict) -> str | None:
    """What is wrong with the arguments of a call, given the schemas by name."""
    if not call["json"]:
        return "/: not JSON"
    if call["name"] not in schemas:
        return f"no schema for {call['name']}"
    return problem(json.loads(call["arguments"]), schemas[call["name"]])


def read_message(role: str | None, text: str | None) -> tuple[str, str | None, list[dict]]:
    """content, the id that a tool result answers, and the calls of a message.

    A text that is a JSON object with ``tool_calls`` (a list) holds calls; one of
    role ``tool`` with ``tool_call_id`` is a result.  Anything else is content.
    """
    text = text or ""
    head = text.lstrip()[:1]
    if head == "{":
        try:
            body = parsed_json(text)
        except ValueError:
            body = None
        if isinstance(body, dict):
            content = body.get("content", "")
            content = content if isinstance(content, str) else canonical(content)
            if role == "tool" and body.get("tool_call_id") is not None:
                return content, named(body["tool_call_id"]), []
            calls = body.get("tool_calls")
            if isinstance(calls, list) and calls:
                return content, None, [read_call(c) for c in calls if isinstance(c, dict)]
    return text, None, []


def link_tools(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per message, with its place, its links and its canonical JSON.

    Returns conv_id, turn, role, anchor, step, n_calls, n_valid, n_answered,
    status, json.  Sorting a conversation by (anchor, step, turn) is a
    topological order: a message stands at (turn, 0), a result that answers a
    call right after the message of that call, in the order of its calls, even
    if it came earlier.  Calls and results meet in a hash join on
    (conv_id, call_id); no conversation is gathered in one task.

    status: ``message``, ``calls``, ``result`` (linked), ``orphan`` (a result
    without a call), ``repeat`` (a later result for an answered call).  The first
    of several calls with one id is the one answered.  Null turns come first;
    null roles are ``""``; null texts are empty content; repeated rows are
    rows of their own and rank alike.  A text that is not strict JSON (NaN, infinite
    numbers, nesting too deep to be written again) is plain content; lone
    surrogates stay JSON escapes.

    n_valid counts the calls whose arguments fit their schema: the one in
    ``schemas``, or else the one that the conversation declares (``declared``;
    of several for a name the first by turn).  A call without a schema is not valid.
    """
    registry = schemas or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"]):
                content, answers, calls = read_message(role, text)
                rows.append((conv, turn, role or "", canonical(content), answers, calls, declared(role, text)))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "content", "answers", "calls", "tools"])

    given = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = staged(map_rows(given, run, PARSED, ("conv_id", "turn")), "messages")  # parsed once
    calls = parsed.filter(F.size("calls") > 0).select("conv_id", "turn", F.posexplode("calls").alias("k", "call")).filter(F.col("call.call_id").isNotNull())
    first_call = calls.groupBy(F.col("conv_id").alias("of"), F.col("call.call_id").alias("call_id")).agg(F.min(F.struct("turn", "k")).alias("made"))
    results = parsed.filter(F.col("answers").isNotNull())
    first_result = results.groupBy(F.col("conv_id").alias("of_r"), F.col("answers").alias("answered")).agg(F.min(F.struct("turn", "content")).alias("given"))
    linked = first_call.join(first_result, F.col("of").eqNullSafe(F.col("of_r")) & (F.col("call_id") == F.col("answered"))).select("of", "call_id", "made", "given")
    answered = linked.groupBy(F.col("of").alias("of_a"), F.col("made.turn").alias("turn_a")).agg(F.count("*").alias("n_answered"), F.collect_set("call_id").alias("ids"))  # the calls of one message
    # most messages hold neither calls nor an answer: they go past the joins
    is_plain = (F.size("calls") == 0) & F.col("answers").isNull()
    plain = parsed.filter(is_plain)
    bound = parsed.filter(~is_plain)
    rows = bound.join(linked, bound["conv_id"].eqNullSafe(F.col("of")) & (bound["answers"] == F.col("call_id")), "left")
    rows = rows.join(answered, rows["conv_id"].eqNullSafe(F.col("of_a")) & rows["turn"].eqNullSafe(F.col("turn_a")) & (F.size("calls") > 0), "left")
    tools = parsed.filter(F.size("tools") > 0).select("conv_id", "turn", F.posexplode("tools").alias("k", "tool"))
    tools = tools.groupBy(F.col("conv_id").alias("of_t"), F.col("tool.name").alias("tool")).agg(F.min(F.struct("turn", "k", "tool.schema"))["schema"].alias("tool_schema"))
    tools = tools.groupBy("of_t").agg(F.collect_list(F.struct(F.col("tool").alias("name"), F.col("tool_schema").alias("schema"))).alias("known"))  # the tools of one conversation
    rows = rows.join(tools, rows["conv_id"].eqNullSafe(F.col("of_t")) & (F.size("calls") > 0), "left")
    is_result, is_linked = F.col("answers").isNotNull(), F.col("call_id").isNotNull()
    first = F.col("given").eqNullSafe(F.struct("turn", "content"))
    status = F.when(is_result & ~is_linked, "orphan").when(is_result & ~first, "repeat").when(is_result, "result").when(F.size("calls") > 0, "calls").otherwise("message")
    own_ids = F.transform("calls", lambda c: c["call_id"])
    rows = rows.select(
        "conv_id", "turn", "role", F.coalesce("made.turn", "turn").alias("anchor"), F.when(is_linked, F.col("made.k") + 1).otherwise(0).cast("int").alias("step"), F.size("calls").alias("n_calls"),
        F.coalesce(F.size(F.array_intersect(own_ids, F.col("ids"))), F.lit(0)).alias("n_answered"), status.alias("status"), "content", "answers", "calls", "known",
    )
    none = F.lit(0).cast("int")
    rows = plain.select(
        "conv_id", "turn", "role", F.col("turn").alias("anchor"), none.alias("step"), none.alias("n_calls"), none.alias("n_answered"), F.lit("message").alias("status"),
        "content", "answers", "calls", F.lit(None).cast(rows.schema["known"].dataType).alias("known"),
    ).unionByName(rows)
    schema = "conv_id long, turn long, role string, anchor long, step int, n_calls int, n_valid int, n_answered int, status string, json string"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines, valid = [], []
            for role, content, answers, calls, known in zip(batch["role"], batch["content"], batch["answers"], batch["calls"], batch["known"]):
                fits = 0
                if calls is not None and len(calls):
                    schemas_here = {t["name"]: json.loads(t["schema"]) for t in (known if known is not None else [])} | registry
                    fits = sum(call_problem(c, schemas_here) is None for c in calls)
                valid.append(fits)
                body: dict = {"role": role, "content": json.loads(content)}
                if answers is not None:
                    body["tool_call_id"] = answers
                if calls is not None and len(calls):
                    body["tool_calls"] = [{"id": c["call_id"], "type": "function", "function": {"name": c["name"], "arguments": c["arguments"]}} for c in calls]
                lines.append(canonical(body))
            out = batch.drop(columns=["content", "answers", "calls", "known"]).assign(json=lines)
            out.insert(6, "n_valid", valid)
            yield out

    return map_rows(rows, write, schema, ("conv_id", "turn", "anchor"))
