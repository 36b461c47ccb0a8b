"""Tool-call linking: calls joined to results, ordered, validated, as canonical JSON.

Calls and results are hash-joined by conversation and identifier. A call may
name earlier calls in its arguments (``{"$result": id}``); calls are ordered
topologically: a call's depth is one more than the deepest it names, found in
rounds of joins, so no conversation is gathered in one task. Arguments are
checked against the tool's schema. Each call and its results become one line of
canonical JSON: sorted keys, no spaces, shortest numbers.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.llm.common import map_batches, stage

STATUSES = ("linked", "invalid_arguments", "missing_result", "cyclic")


def canonical_json(value) -> str:
    """Keys sorted by code units, no spaces, integral numbers without a fraction; NaN and infinities are errors."""
    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(v[k]) for k in sorted(v, key=lambda s: s.encode("utf-16-be", "surrogatepass"))}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False, allow_nan=False)


_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (
            kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


# The words of JSON schemas that are checked, and those that state nothing to check.
CHECKED = {"type", "enum", "required", "properties", "additionalProperties", "items", "minLength", "maxLength", "minimum", "maximum"}
REMARKS = {"title", "description", "default", "examples", "$comment"}


def check_schema(schema: dict) -> None:
    """Raise ValueError if a schema has words that ``violations`` would pass over."""
    if unknown := set(schema) - CHECKED - REMARKS:
        raise ValueError(f"schema words that are not checked: {', '.join(sorted(unknown))}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError("additionalProperties must be true or false")
    for part in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        check_schema(part)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema (type, enum, required, properties, additionalProperties, items, bounds)."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []  # stands for a result that is not known yet
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and canonical_json(value) not in map(canonical_json, schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0))
        out += [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if _is(value, "number"):
        out += [f"{at}: too small"] * (value < schema.get("minimum", value))
        out += [f"{at}: too large"] * (value > schema.get("maximum", value))
    if isinstance(value, list) and "items" in schema:
        out += [v for k, x in enumerate(value) for v in violations(x, schema["items"], f"{at}[{k}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def named_calls(value) -> list[str]:
    """Identifiers that arguments name as ``{"$result": id}``, sorted."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return sorted({c for v in value.values() for c in named_calls(v)})
    return sorted({c for v in value for c in named_calls(v)}) if isinstance(value, list) else []


def _checked(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls with parsed arguments (canonical), the errors found and the calls they name."""

    def one(name, text):
        if name not in schemas:
            return None, ["$: unknown tool"], []
        try:
            value = json.loads(text or "")
            canonical_json(value).encode()  # half of a surrogate pair is no text
            return canonical_json(value), violations(value, schemas[name]), named_calls(value)
        except (ValueError, RecursionError):
            return None, ["$: not JSON"], []

    def run(batches):
        for b in batches:
            rows = [one(n, t) for n, t in zip(b.column("name").to_pylist(), b.column("arguments").to_pylist())]
            names = ("canonical", "errors", "needs")
            yield {n: b.column(n) for n in ("conv_id", "turn", "call_id", "name")} | (
                dict(zip(names, zip(*rows))) if rows else {n: [] for n in names})

    return map_batches(calls.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "call_id", "name", "arguments"),
                       run, "conv_id long, turn long, call_id string, name string, canonical string, errors array<string>, needs array<string>")


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of calls that can be ordered (needs: array of call_ids; unknown ones do not count)."""
    ids = calls.select("conv_id", "call_id").distinct()
    needs = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    needs = stage(needs.join(ids.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi"), "needs")
    done = stage(ids.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0)), "depths")
    fresh = done
    while True:
        reached = needs.join(fresh.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]).select("conv_id", "call_id").distinct()
        rest = (needs.join(reached, ["conv_id", "call_id"], "left_semi")
                .join(done.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left"))
        # Ready once all named calls have a depth.
        fresh = stage(rest.groupBy("conv_id", "call_id").agg(
            F.max("depth").alias("depth"), F.count("depth").alias("n"), F.count("*").alias("all_n"))
            .where("n = all_n").join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
            .select("conv_id", "call_id", (F.col("depth") + 1).alias("depth")), "depths")
        if fresh.isEmpty():
            return done
        done = done.unionByName(fresh)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, turn, depth, status, errors, n_results, record: one row per call.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON); ``results`` has
    conv_id, turn, call_id, content. status: invalid_arguments before cyclic (it
    needs itself, depth null) before missing_result before linked. Of several
    results the earliest turn counts (then the smallest content), n_results says
    how many there are. Of repeated calls with one identifier the earliest turn
    counts (then name and arguments). Rows with a null conv_id or call_id link to
    nothing and have no row; results without a call have none. Null arguments are
    not JSON. Other columns are ignored, whatever their names; empty tables give
    an empty table.
    """
    for schema in schemas.values():
        check_schema(schema)
    first = F.min(F.struct("turn", "name", "arguments")).alias("call")
    calls = (calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(first)
             .select("conv_id", "call_id", "call.*"))
    results = (results.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
               .groupBy(F.col("conv_id").cast("long").alias("conv_id"), "call_id")
               .agg(F.min(F.struct(F.col("turn").cast("long").alias("turn"), "content")).alias("result"), F.count("*").alias("n")))
    checked = stage(_checked(calls, schemas), "calls")
    joined = (checked.join(results, ["conv_id", "call_id"], "left").join(depths(checked), ["conv_id", "call_id"], "left"))

    def run(batches):
        for b in batches:
            rows = []
            for c in b.to_pylist():
                result = c["result"] or {}
                status = ("invalid_arguments" if c["errors"] else "cyclic" if c["depth"] is None
                          else "missing_result" if c["n"] is None else "linked")
                record = {"id": c["call_id"], "name": c["name"], "depth": c["depth"],
                          "arguments": json.loads(c["canonical"]) if c["canonical"] else None, "errors": c["errors"],
                          "result": None if c["n"] is None else {"content": result.get("content"), "turn": result.get("turn")}}
                rows.append((c["conv_id"], c["call_id"], c["turn"], c["depth"], status, c["errors"], c["n"] or 0, canonical_json(record)))
            names = ("conv_id", "call_id", "turn", "depth", "status", "errors", "n_results", "record")
            yield dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    return map_batches(joined, run, "conv_id long, call_id string, turn long, depth int, status string, errors array<string>, "
                                    "n_results long, record string")


def calls_from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results derived from chat turns (conv_id, turn, role, text).

    Every user turn calls ``search``, with the whole text as its query and the
    text's length as limit; from turn 2 on, it names the call of half its turn.
    The assistant's answer in the next turn is the result.
    """
    number = F.col("turn").cast("string")
    half = F.floor(F.col("turn") / 4).cast("long") * 2
    arguments = F.to_json(F.struct(
        F.col("text").alias("query"), F.length("text").alias("limit"),
        F.when(F.col("turn") >= 2, F.struct(F.concat(F.lit("call-"), half.cast("string")).alias("$result"))).alias("context")))
    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    calls = said.where("role = 'user'").select(
        "conv_id", "turn", F.concat(F.lit("call-"), number).alias("call_id"), F.lit("search").alias("name"), arguments.alias("arguments"))
    results = said.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


# The production schema of the derived calls.
SCHEMAS = {"search": {
    "type": "object", "required": ["query", "limit"], "additionalProperties": False,
    "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 20, "maximum": 400},
                   "context": {"type": "string"}},
}}
