"""Chat formatting: tool calls linked to their results, checked, ordered and written as canonical JSON.

Messages are rows (conv_id, turn, role, text). An assistant's text may be a JSON object with tool_calls (each with
id, name and arguments, or a function holding the latter two) and content; a tool's text may be a JSON object with
tool_call_id and content. Calls and results are hash-joined by conversation and identifier; every result follows its
call directly, in the order of the calls, wherever it stood. Arguments are checked against a table of schemas
(name, parameter, type, required). The JSON is canonical: keys sorted, no white space, nothing else escaped than
JSON demands. There is one row a message, so that a conversation of any length is never gathered. Messages are parsed
once and written with row numbers; plain ones take no part in the joins.

Order: ascending (conv_id, at_turn, at_step): a topological order, since a call's message has at_step 0 of its own
turn and its results have steps 1, 2, ... of that turn. A result whose call is missing keeps its own turn.

Defined cases: null texts are empty contents; null roles are "user"; rows with a null conv_id or turn are kept and
sort first; of calls that repeat an identifier in a conversation the first (smallest turn, then place, then row) is
linked, and the others stay unanswered; of results that repeat one, also word for word, the first is linked, others are
"duplicate"; text that isn't such JSON is plain content; repeated rows are kept each; extra columns are ignored; an empty table gives an empty
result; without schemas no call is invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import _store

SCHEMA = "name string, parameter string, type string, required boolean"
#: JSON types by the names under which a variant tells them.
_TYPES = {"integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "string": ["STRING"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"], "null": ["VOID"]}

_MESSAGE = "struct<content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>>"


def no_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def canonical(text: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with kind (plain, call or result), role, content, tool_call_id and calls."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("user")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A parse is tried only where it can matter; from_json gives nulls for anything else.
    may = F.when(role.isin("assistant", "tool") & F.ltrim(text).startswith("{"), text)
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.from_json(may, _MESSAGE).alias("m"), F.try_parse_json(may).isNotNull().alias("json"))
    call = F.col("json") & (F.col("role") == "assistant") & (F.size(F.coalesce("m.tool_calls", F.array())) > 0)
    result = F.col("json") & (F.col("role") == "tool") & F.col("m.tool_call_id").isNotNull()
    calls = F.transform(
        "m.tool_calls",
        lambda c: F.struct(c["id"].alias("id"), F.coalesce(c["name"], c["function"]["name"], F.lit("")).alias("name"), F.coalesce(c["arguments"], c["function"]["arguments"], F.lit("{}")).alias("arguments")),
    )
    return rows.select(
        F.when(call, "call").when(result, "result").otherwise("plain").alias("kind"), "conv_id", "turn", "role",
        F.when(call | result, F.coalesce("m.content", F.lit(""))).otherwise(F.col("text")).alias("content"),
        F.when(result, F.col("m.tool_call_id")).alias("tool_call_id"),
        F.when(call, calls).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>")).alias("calls"),
    )


def calls_of(rows: DataFrame, row: str) -> DataFrame:
    """A row for each tool call of numbered, parsed messages: row, conv_id, turn, place (from 1), id, name, arguments."""
    found = rows.where("kind = 'call'").select(F.col(row).alias("row"), "conv_id", "turn", F.posexplode("calls").alias("place", "c"))
    return found.select("row", "conv_id", "turn", (F.col("place") + 1).alias("place"), F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with `errors`: sorted texts, empty where arguments meet the schema of the call's name (or it has none)."""
    schemas = schemas.select(F.col("name").cast("string").alias("name"), F.col("parameter").cast("string").alias("parameter"), F.lower(F.col("type").cast("string")).alias("type"), F.coalesce(F.col("required").cast("boolean"), F.lit(False)).alias("required"))
    schemas = schemas.where("name is not null and parameter is not null").groupBy("name", "parameter").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    variant = F.try_parse_json("arguments")
    shape = F.schema_of_variant(variant)
    own = calls.select("row", "place", "name", "arguments").withColumn("object", F.coalesce(shape.startswith("OBJECT"), F.lit(False)))
    keys = F.when(F.col("object"), F.json_object_keys(F.to_json(F.try_parse_json("arguments"))))
    values = F.from_json(F.when(F.col("object"), F.col("arguments")), "map<string,string>")
    # The type of each value: of its text in the object, where a string has lost its quotes, so the shape decides.
    given = own.withColumn("given", F.coalesce(keys, F.array().cast("array<string>"))).withColumn("values", values)
    shapes = F.from_json(F.when(F.col("object"), F.to_json(F.try_parse_json("arguments"))), "map<string,variant>")
    types = F.transform_values(shapes, lambda _, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))
    given = given.withColumn("types", types)
    wanted = given.join(schemas, "name")
    has = F.array_contains("given", F.col("parameter"))
    kind = F.regexp_extract(F.try_element_at("types", F.col("parameter")), "^[A-Z]+", 0)
    right = F.lit(False)
    for name, kinds in _TYPES.items():
        right = right | ((F.col("type") == name) & kind.isin(kinds))
    known = F.col("type").isin(list(_TYPES))
    error = (
        F.when(~F.col("object"), F.lit("arguments are no object"))
        .when(~has & F.col("required"), F.concat(F.lit("missing "), F.col("parameter")))
        .when(has & known & ~right, F.concat(F.col("parameter"), F.lit(" is no "), F.col("type")))
    )
    found = wanted.groupBy("row", "place", "given").agg(F.collect_set(error).alias("errors"), F.collect_set("parameter").alias("parameters"))
    extra = F.transform(F.array_except("given", "parameters"), lambda p: F.concat(F.lit("unknown "), p))
    found = found.select("row", "place", F.array_sort(F.concat("errors", extra)).alias("errors"))
    return calls.join(found, ["row", "place"], "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def link(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """A row for each message: conv_id, turn, role, at_turn, at_step, n_calls, call_id, status, errors, json.

    status: plain; of a call's message calls (all answered), unanswered or invalid; of a result linked, orphan (no
    call has its identifier) or duplicate.
    """
    spark = messages.sparkSession
    rows, row = _store.numbered(parsed(messages))
    calls = checked(calls_of(rows, row), schemas if schemas is not None else no_schemas(spark))
    calls = _store.written(calls)
    ends = calls.where(F.col("id").isNotNull()).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place", "row")).alias("call"))
    results = rows.where("kind = 'result'").groupBy("conv_id", "tool_call_id").agg(F.min(F.struct("turn", F.col(row).alias("row"))).alias("result"))
    results = results.select(F.col("conv_id").alias("r_conv"), F.col("tool_call_id").alias("r_id"), "result")
    linked = ends.join(results, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("id") == F.col("r_id")), "left").select("conv_id", "id", "call", "result")
    # What a call's message needs: how many of its calls have no result, and the errors.
    answered = linked.where(F.col("result").isNotNull()).select("call.row", "call.place", F.lit(0).alias("missing"))
    per_row = calls.join(answered, ["row", "place"], "left").groupBy("row").agg(F.sum(F.coalesce("missing", F.lit(1))).alias("open"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("errors")).withColumnRenamed("row", row)
    own = linked.select(F.col("conv_id").alias("o_conv"), F.col("id").alias("o_id"), "call", F.col("result.row").alias("first"))

    plain = rows.where("kind = 'plain'")
    asking = rows.where("kind = 'call'").join(per_row, row, "left")
    answers = rows.where("kind = 'result'").join(own, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("tool_call_id") == F.col("o_id")), "left")

    none = F.array().cast("array<string>")
    text = F.concat(F.lit('"content":'), _quoted(F.col("content")), F.lit(',"role":'), _quoted(F.col("role")))
    one = lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(canonical(c["arguments"]), _quoted(c["arguments"])), F.lit(',"id":'), F.coalesce(_quoted(c["id"]), F.lit("null")), F.lit(',"name":'), _quoted(c["name"]), F.lit("}"))
    out = lambda df, turn, step, n, call, status, errors, json: df.select("conv_id", "turn", "role", turn.alias("at_turn"), step.cast("int").alias("at_step"), n.cast("int").alias("n_calls"), call.cast("string").alias("call_id"), status.alias("status"), errors.alias("errors"), json.alias("json"))
    status = F.when(F.col("call").isNull(), F.lit("orphan")).when(F.col("first") == F.col(row), F.lit("linked")).otherwise(F.lit("duplicate"))
    return (
        out(plain, F.col("turn"), F.lit(0), F.lit(0), F.lit(None), F.lit("plain"), none, F.concat(F.lit("{"), text, F.lit("}")))
        .unionByName(out(asking, F.col("turn"), F.lit(0), F.size("calls"), F.lit(None), F.when(F.size("errors") > 0, "invalid").when(F.col("open") > 0, "unanswered").otherwise("calls"), F.coalesce("errors", none), F.concat(F.lit("{"), text, F.lit(',"tool_calls":['), F.array_join(F.transform("calls", one), ","), F.lit("]}"))))
        .unionByName(out(answers, F.coalesce("call.turn", "turn"), F.coalesce("call.place", F.lit(0)), F.lit(0), F.col("tool_call_id"), status, none, F.concat(F.lit("{"), text, F.lit(',"tool_call_id":'), _quoted(F.col("tool_call_id")), F.lit("}"))))
    )
