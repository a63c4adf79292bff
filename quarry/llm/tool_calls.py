"""Chat formatting: link tool calls to results, order them, validate arguments and write canonical JSON.

Calls and results are joined on (conversation, call id). A call names the calls whose results it needs (``after``, a list); its depth is
the length of the longest path of such names to it. Calls that need one other are runs, whose depth within the run is found by
doubling pointers: about log2(length) joins over all calls. Calls that need several are taken in layers, once all that they
need are known; the number of layers is that of such calls on one path. No conversation is gathered in one task.
``place`` numbers the calls of a conversation by (depth, turn, call id), which is a topological order, from 0; the numbers are counted over
ranges of ``RANGE`` turns first.

Status: ``linked``; ``no_result``; ``orphan_result`` (no such call, or no id); ``repeated_call`` and ``repeated_result`` (of those with an
id, the first by turn and content counts); ``cycle`` (on or after a cycle: depth and place are null). Names of unknown calls are
ignored. Calls without an id are ``no_result``, stay apart and have no place. ``valid`` is null for results without a call. Arguments
that aren't JSON, can't be written as UTF-8 (lone surrogates) or hold numbers that JSON lacks are kept as a string and are
invalid, as are those of unknown tools. Of a repeated key in an object the last counts. Extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored, text_batches

#: Turns of a range that the places of calls are counted over.
RANGE = 256
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def fits(value, schema: dict) -> bool:
    """JSON Schema: type, enum, minimum, required, properties, additionalProperties and items."""
    kind = schema.get("type")
    if kind is not None and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if "minimum" in schema and isinstance(value, (int, float)) and value < schema["minimum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(fits(v, known[k]) for k, v in value.items() if k in known)
    if isinstance(value, list) and "items" in schema:
        return all(fits(v, schema["items"]) for v in value)
    return True


def canonical(value) -> str:
    """Keys sorted, no blanks, no escapes but the needed; numbers that JSON lacks are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of calls (conv_id, call_id, after), unique by id; depth is null on and after a cycle."""
    needs = calls.select("conv_id", "call_id", F.explode(F.array_distinct(F.coalesce("after", F.array().cast("array<string>")))).alias("to"))
    needs = stored(needs.join(calls.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_semi"))
    counts = needs.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("to").alias("to"))
    runs = calls.select("conv_id", "call_id").join(counts, ["conv_id", "call_id"], "left")
    # each call of a run points to the call it needs, all others are heads and point to themselves
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    runs = stored(runs.select("conv_id", "call_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(one, F.col("to")).otherwise(F.col("call_id")).alias("head"), one.cast("long").alias("steps"), one.alias("open")))
    for _ in range(max(1, runs.count()).bit_length() + 1):
        if runs.filter("open").isEmpty():
            break
        there = runs.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"), F.col("open").alias("on"))
        moved = runs.filter("open").join(there, ["conv_id", "head"]).select("conv_id", "call_id", "n", F.col("next").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), F.col("on").alias("open"))
        runs = stored(runs.filter("not open").unionByName(moved))
    runs = runs.filter("not open")  # what is left is on or after a cycle of runs
    done = runs.filter("n = 0").select("conv_id", "call_id", F.lit(0).cast("long").alias("depth"))
    several = runs.filter("n > 1").select("conv_id", "call_id", "n")
    if not several.isEmpty():
        ends = needs.join(several, ["conv_id", "call_id"]).join(runs.select("conv_id", F.col("call_id").alias("to"), "head", "steps"), ["conv_id", "to"])
        ends = stored(ends.select("conv_id", "call_id", "n", "head", (F.col("steps") + 1).alias("more")))
        while True:
            known = ends.join(done.withColumnRenamed("call_id", "head"), ["conv_id", "head"])
            ready = known.groupBy("conv_id", "call_id", "n").agg(F.count("*").alias("got"), F.max(F.col("depth") + F.col("more")).alias("depth")).filter("got = n")
            ready = stored(ready.select("conv_id", "call_id", "depth"))
            if ready.isEmpty():
                break
            done, ends = done.unionByName(ready), ends.join(ready, ["conv_id", "call_id"], "left_anti")
    depth = runs.join(done.select("conv_id", F.col("call_id").alias("head"), "depth"), ["conv_id", "head"])
    return calls.select("conv_id", "call_id").join(depth.select("conv_id", "call_id", (F.col("depth") + F.col("steps")).alias("depth")), ["conv_id", "call_id"], "left")


def places(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, place) of calls (conv_id, call_id, turn, depth)."""
    rows = stored(calls.filter("depth is not null").withColumn("range", F.floor(F.coalesce("turn", F.lit(-1)) / RANGE)))
    sums = rows.groupBy("conv_id", "depth", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("depth", "range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "depth", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("conv_id", "depth", "range").orderBy("turn", "call_id")
    return rows.withColumn("nth", F.row_number().over(inner)).join(sums, ["conv_id", "depth", "range"]).select("conv_id", "call_id", "depth", (F.col("before") + F.col("nth") - 1).alias("place"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, call_id, name, depth, place, status, valid, message) of every call and of every result without one.

    calls: (conv_id, turn, call_id, name, arguments, after); results: (conv_id, turn, call_id, content). schemas: by tool name.
    """
    key = Window.partitionBy("conv_id", "call_id")
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    results = results.select("conv_id", F.col("turn").alias("result_turn"), "call_id", "content")
    keyed = "conv_id is not null and call_id is not null"
    nth = calls.filter(keyed).withColumn("nth", F.row_number().over(key.orderBy("turn", "name", "arguments")))
    answers = results.filter(keyed).withColumn("nth", F.row_number().over(key.orderBy("result_turn", "content")))
    first = stored(nth.filter("nth = 1").drop("nth"))
    placed = places(first.select("conv_id", "call_id", "turn").join(depths(first), ["conv_id", "call_id"]))
    joined = first.withColumn("called", F.lit(True)).join(answers.filter("nth = 1").drop("nth").withColumn("answered", F.lit(True)), ["conv_id", "call_id"], "full").join(placed, ["conv_id", "call_id"], "left")
    status = F.when(F.col("called").isNull(), "orphan_result").when(F.col("depth").isNull(), "cycle").when(F.col("answered").isNull(), "no_result").otherwise("linked")
    none = {c: F.lit(None).cast(t) for c, t in (("name", "string"), ("arguments", "string"), ("content", "string"), ("depth", "long"), ("place", "long"))}

    def lone(rows: DataFrame, turn: str, what: str) -> DataFrame:
        given = {c: F.col(c) if c in rows.columns else null for c, null in none.items()}
        return rows.select("conv_id", F.col(turn).alias("turn"), "call_id", *[c.alias(n) for n, c in given.items()], F.lit(what).alias("status"))

    rows = joined.select("conv_id", F.coalesce("turn", "result_turn").alias("turn"), "call_id", *none, status.alias("status"))
    rows = rows.unionByName(lone(nth.filter("nth > 1"), "turn", "repeated_call")).unionByName(lone(answers.filter("nth > 1"), "result_turn", "repeated_result"))
    rows = rows.unionByName(lone(calls.filter(f"not ({keyed})"), "turn", "no_result")).unionByName(lone(results.filter(f"not ({keyed})"), "result_turn", "orphan_result"))

    def run(batches):
        for batch in batches:
            valid, messages = [], []
            for call, name, arguments, content, status in zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "content", "status")), strict=True):
                if status in ("orphan_result", "repeated_result"):
                    valid.append(None)
                    messages.append(canonical({"tool_result": {"id": call, "content": content}}))
                    continue
                try:
                    value = json.loads(arguments)
                    shown, ok = value, name in schemas and fits(value, schemas[name])
                    canonical(value).encode()
                except (TypeError, ValueError, RecursionError):
                    shown, ok = arguments, False
                message = {"tool_call": {"id": call, "name": name, "arguments": shown}}
                if status == "linked":
                    message["tool_result"] = {"id": call, "content": content}
                valid.append(ok)
                messages.append(canonical(message))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in SHOWN), pa.array(valid, pa.bool_()), pa.array(messages, pa.string())], [*SHOWN, "valid", "message"])

    text_batches(calls.sparkSession)
    return rows.mapInArrow(run, "conv_id long, turn long, call_id string, name string, depth long, place long, status string, valid boolean, message string")


SHOWN = ["conv_id", "turn", "call_id", "name", "depth", "place", "status"]


#: Tools of the query's calls.
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "measure": {"type": "object", "required": ["query", "n"], "properties": {"query": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}},
    "translate": {"type": "object", "required": ["query", "to"], "properties": {"to": {"enum": ["de", "en", "es", "fr"]}}},
}


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from turns (conv_id, turn, role, text): a user's turn is a call, the assistant's next turn its result.

    Of each 16 turns, a call needs the one two turns before, and some the first of the 16 as well. Its tool and arguments come from the
    text's length; some don't fit. Turns of other roles and of none are neither calls nor results.
    """
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    name = F.element_at(F.array(F.lit("search"), F.lit("measure"), F.lit("translate"), F.lit("other")), F.when(n % 29 == 0, 4).otherwise(n % 3 + 1))
    to = F.element_at(F.array(*map(F.lit, ["de", "en", "es", "fr", "xx"])), n % 5 + 1)
    arguments = F.to_json(F.struct(F.col("text").alias("query"), F.when(n % 3 != 2, n).alias("n"), F.when(n % 3 == 2, to).alias("to")))
    named = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    user = turns.filter("role = 'user'")
    calls = user.select("conv_id", "turn", named(F.col("turn")).alias("call_id"), name.alias("name"), F.when(n % 31 == 0, F.lit("{")).otherwise(arguments).alias("arguments"), F.filter(F.array(F.when(F.col("turn") % 16 >= 2, named(F.col("turn") - 2)), F.when((F.col("turn") % 16 >= 4) & (n % 5 == 0), named(F.col("turn") - F.col("turn") % 16))), lambda x: x.isNotNull()).alias("after"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", named(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
