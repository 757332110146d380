"""Tool calls of chats: linking with results, topological order, validation and canonical JSON.

Calls and results meet in a hash join on (conversation, call id). A call may wait
for the results of others; its level is one more than the highest level it waits
for, found by releasing calls level by level, so the number of rounds is the depth
of the dependencies and each round touches only what is released. Calls in or
behind a cycle are never released. (level, turn, call id) is a topological order;
positions in it come from counts per block of turns and ranks inside a block, so a
conversation of any length is never ordered in one task.

Everything is DataFrame expressions: arguments are parsed as variants, whose JSON
form has sorted keys and no blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docflow.llm.blocks import stored

BLOCK_TURNS = 2048
# JSON types of a schema and the variant types that satisfy them.
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN",
    "array": "ARRAY.*", "object": "OBJECT.*",
}
KEY = ["conv_id", "call_id"]


def argument_errors(name: Column, value: Column, schemas: dict[str, dict]) -> Column:
    """Sorted, comma-joined faults of parsed arguments (a variant) under the tool's schema; empty if there is none.

    ``schemas`` maps a tool to ``{"properties": {field: type}, "required": [...],
    "additional": bool}``. Faults: unknown_tool, bad_json, missing:field, type:field,
    extra:field. Null values count as missing.
    """
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    keys = F.json_object_keys(F.to_json(value))
    none = F.array().cast("array<string>")
    by_tool = []
    for tool, schema in sorted(schemas.items()):
        faults = []
        for field, kind in sorted(schema["properties"].items()):
            at = F.try_variant_get(value, f"$.{field}", "variant")
            there = F.schema_of_variant(at)
            absent = at.isNull() | F.is_variant_null(at)
            if field in schema.get("required", ()):
                faults.append(F.when(absent, F.lit(f"missing:{field}")))
            faults.append(F.when(~absent & ~F.rlike(there, F.lit(f"^({TYPES[kind]})$")), F.lit(f"type:{field}")))
        extra = F.array_except(keys, F.array(*map(F.lit, schema["properties"])))
        extra = F.transform(extra, lambda k: F.concat(F.lit("extra:"), k))
        listed = F.array_compact(F.array(*faults))
        faults = listed if schema.get("additional") else F.concat(listed, F.coalesce(extra, none))
        by_tool.append(F.when(name == tool, faults))
    found = F.coalesce(*by_tool, F.array(F.lit("unknown_tool")))
    return F.array_join(F.array_sort(F.when(is_object, found).otherwise(F.array(F.lit("bad_json")))), ",")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call that is in no cycle and behind none.

    ``calls`` holds conv_id, call_id (unique per conversation) and ``after``, ids it
    waits for; ids that are no call of the conversation, and the call's own, count
    for nothing.
    """
    wanted = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("before")).where("before != call_id")
    known = calls.select("conv_id", F.col("call_id").alias("before"))
    edges = stored(wanted.join(known, ["conv_id", "before"]), "edges")
    open_ = edges.groupBy(*KEY).agg(F.count("*").alias("left"))
    first = calls.select(*KEY).join(open_, KEY, "left_anti").withColumn("level", F.lit(0))
    done, waiting, level = stored(first, "level"), stored(open_, "waiting"), 0
    ready = done
    while not ready.isEmpty():
        met = edges.join(ready.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"])
        met = met.groupBy(*KEY).agg(F.count("*").alias("met"))
        waiting = stored(waiting.join(met, KEY, "left").select(*KEY, (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")), "waiting")
        level += 1
        ready = waiting.where("left = 0").select(*KEY).withColumn("level", F.lit(level))
        done, waiting = done.unionAll(ready), waiting.where("left > 0")
    return done


def positions(rows: DataFrame) -> DataFrame:
    """Add ``position`` from 0 inside each conversation, by (level, turn, call id); rows without a level have none."""
    ordered = rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    counts = ordered.where("level is not null").groupBy("conv_id", "level", "block").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv_id").orderBy("level", "block")) - F.col("n")
    offsets = counts.withColumn("ahead", ahead).drop("n")
    inside = F.row_number().over(Window.partitionBy("conv_id", "level", "block").orderBy("turn", "call_id"))
    placed = ordered.where("level is not null").withColumn("inside", inside).join(offsets, ["conv_id", "level", "block"])
    placed = placed.select(*rows.columns, (F.col("ahead") + F.col("inside") - 1).cast("long").alias("position"))
    return placed.unionAll(ordered.where("level is null").select(*rows.columns, F.lit(None).cast("long").alias("position")))


def canonical_text(value: Column) -> Column:
    """A text as JSON string."""
    as_json = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substring(as_json, F.lit(6), F.length(as_json) - 6))


def canonical(value: Column) -> Column:
    """JSON with sorted keys and no blanks; what is no JSON becomes a JSON string."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), canonical_text(value))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and one per result without a call.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after (ids).
    ``results``: conv_id, turn, call_id, content. Of calls that repeat an id in a
    conversation the first by (turn, name, arguments) counts, of results the first
    by (turn, content); ``copies`` tells how many rows there were. Rows without
    conversation or id can't be linked and are left out. ``status`` is the first
    that holds of orphan_result, cycle, invalid, no_result, early_result (its turn
    is not behind the call's), ok. ``json`` is the canonical line of the linked
    pair. Other columns are not read; empty tables give no rows.
    """
    there = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    asked = calls.where(there).groupBy(*KEY).agg(
        F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.count("*").alias("copies")
    ).select(*KEY, "c.*", "copies")
    asked = stored(asked, "calls")
    answers = results.where(there).groupBy(*KEY).agg(F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r")).select(*KEY, "r.*")
    ranked = asked.join(levels(asked.select(*KEY, F.coalesce("after", F.array().cast("array<string>")).alias("after"))), KEY, "left")
    linked = ranked.withColumn("is_call", F.lit(True)).hint("shuffle_hash").join(
        answers.withColumn("is_result", F.lit(True)), KEY, "full_outer"
    )
    errors = F.when(F.col("is_call"), argument_errors(F.col("name"), F.col("value"), schemas))
    judged = linked.withColumn("value", F.try_parse_json("arguments")).withColumn("errors", errors).withColumn(
        "status",
        F.when(F.col("is_call").isNull(), "orphan_result").when(F.col("level").isNull(), "cycle")
        .when(F.col("errors") != "", "invalid").when(F.col("is_result").isNull(), "no_result")
        .when(F.col("result_turn") <= F.col("turn"), "early_result").otherwise("ok"),
    )
    parts = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")),
        F.lit(',"id":'), canonical_text(F.col("call_id")),
        F.lit(',"name":'), F.coalesce(canonical_text(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.coalesce(canonical(F.col("content")), F.lit("null")), F.lit("}"),
    )
    columns = ["conv_id", "call_id", "turn", "result_turn", "name", "level", "copies", "errors", "status"]
    return positions(judged.select(*columns, parts.alias("json")))

