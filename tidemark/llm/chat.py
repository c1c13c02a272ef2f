"""Chat formatting with tool-call linking: calls and results are hash-joined by identifier, put into topological order,
checked against the tools' schemas and written as canonical JSON, a line for each message.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, read_table, whole, written

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_result>(.*?)</tool_result>"
#: Tables of schemas up to this many tools are broadcast; beyond, Spark joins by shuffle.
BROADCAST_TOOLS = 50_000

#: Characters below which op3 takes a turn for short, and from which on for long.
SHORT, LONG = 100, 300

#: Tools that op3 sees behind the plain turns of conversations.
TOOLS = [
    ("reply", json.dumps({"type": "object", "additionalProperties": False, "required": ["prompt", "about"], "properties": {"prompt": {"type": "string"}, "about": {
        "type": "object", "additionalProperties": False, "required": ["turn"], "properties": {"turn": {"type": "integer"}, "size": {"enum": ["short", "medium"]}}}}})),
    ("ask", json.dumps({"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": ["string", "null"]}, "lines": {"type": "array", "items": {"type": "string"}}}})),
]


def parse_calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, name, arguments, after of the <tool_call> blocks within messages.

    A block is an object with id, name, arguments and, if it needs results of other calls, after, a list of their ids.
    Blocks that are no JSON keep null fields, and so count as calls of no tool.
    """
    block = messages.select("conv_id", "turn", F.explode(F.regexp_extract_all(whole("text"), F.lit(CALL), F.lit(1))).alias("b"))
    after = F.from_json(F.get_json_object("b", "$.after"), "array<string>")
    return block.select("conv_id", "turn", F.get_json_object("b", "$.id").alias("call_id"), F.get_json_object("b", "$.name").alias("name"), F.coalesce(F.get_json_object("b", "$.arguments"), F.lit("null")).alias("arguments"), F.coalesce(after, F.array().cast("array<string>")).alias("after"))


def parse_results(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, content of the <tool_result> blocks within messages."""
    block = messages.select("conv_id", "turn", F.explode(F.regexp_extract_all(whole("text"), F.lit(RESULT), F.lit(1))).alias("b"))
    return block.select("conv_id", "turn", F.get_json_object("b", "$.id").alias("call_id"), F.get_json_object("b", "$.content").alias("content"))


def _kind(told: Column) -> Column:
    """The JSON Schema name of a variant's type, from what schema_of_variant says of it."""
    return (
        F.when(told == "STRING", "string").when(told == "BIGINT", "integer").when(told == "BOOLEAN", "boolean").when(told == "VOID", "null")
        .when(told.startswith("ARRAY"), "array").when(told.startswith("OBJECT"), "object").otherwise("number")
    )


def _fields(v: Column) -> Column:
    """The fields of a variant that is an object; else null."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.from_json(F.to_json(v), "map<string,variant>"))


def _strings(v: Column) -> Column:
    """A variant's strings: its own, or those of an array; null for anything else."""
    told = F.schema_of_variant(v)
    return F.when(told.startswith("ARRAY"), F.from_json(F.to_json(v), "array<string>")).when(told == "STRING", F.array(v.cast("string")))


_STRINGS, _VALUES = "array<string>", "array<struct<v:variant,s:variant,at:string>>"


def _value_errors(c: Column) -> Column:
    """What one value has against its schema's own keywords. c: v, at, rule, told, given, listed."""
    key = lambda name: F.try_element_at(c["rule"], F.lit(name))
    below = lambda name: F.when(c["at"] == "$", name).otherwise(F.concat(c["at"], F.lit("."), name))
    kind = _kind(c["told"])
    enum = F.when(F.schema_of_variant(key("enum")).startswith("ARRAY"), F.from_json(F.to_json(key("enum")), "array<variant>"))
    found = [
        F.when(~F.exists(_strings(key("type")), lambda t: (t == kind) | ((t == "number") & (kind == "integer"))), F.array(F.concat(F.lit("type of "), c["at"]))),
        F.when(~F.exists(enum, lambda e: F.to_json(e) == F.to_json(c["v"])), F.array(F.concat(F.lit("value of "), c["at"]))),
        F.transform(F.array_except(_strings(key("required")), F.map_keys(c["given"])), lambda k: F.concat(F.lit("missing "), below(k))),
        F.when(F.to_json(key("additionalProperties")) == "false", F.transform(F.array_except(F.map_keys(c["given"]), F.map_keys(c["listed"])), lambda k: F.concat(F.lit("unknown "), below(k)))),
    ]
    return F.concat(*[F.coalesce(x, F.array().cast(_STRINGS)) for x in found])


def _values_within(c: Column) -> Column:
    """The values within one that its schema speaks of, with their schemas and places."""
    key = lambda name: F.try_element_at(c["rule"], F.lit(name))
    below = lambda name: F.when(c["at"] == "$", name).otherwise(F.concat(c["at"], F.lit("."), name))
    one = lambda v, s, at: F.struct(v.alias("v"), s.alias("s"), at.alias("at"))
    rest = F.when(F.schema_of_variant(key("additionalProperties")).startswith("OBJECT"), F.array_except(F.map_keys(c["given"]), F.map_keys(c["listed"])))
    items = F.when(key("items").isNotNull() & c["told"].startswith("ARRAY"), F.from_json(F.to_json(c["v"]), "array<variant>"))
    found = [
        F.transform(F.array_intersect(F.map_keys(c["given"]), F.map_keys(c["listed"])), lambda k: one(F.try_element_at(c["given"], k), F.try_element_at(c["listed"], k), below(k))),
        F.transform(rest, lambda k: one(F.try_element_at(c["given"], k), key("additionalProperties"), below(k))),
        F.transform(items, lambda x, i: one(x, key("items"), F.concat(c["at"], F.lit("["), i.cast("string"), F.lit("]")))),
    ]
    return F.concat(*[F.coalesce(x, F.array().cast(_VALUES)) for x in found])


def with_schema_errors(rows: DataFrame, value: str, schema: str, depth: int) -> DataFrame:
    """rows with found: what the variant value has against the variant schema, down to a depth, each with its place.

    type (a name or a list of names; an integer is a number), enum (by canonical JSON), required, properties,
    additionalProperties (false, or a schema for what isn't listed) and items (a schema). Other keywords are not read. A
    level of values is one step over all rows, which hold the values still to be looked at in an array.
    """
    no_fields = F.create_map().cast("map<string,variant>")
    root = F.struct(F.col(value).alias("v"), F.col(schema).alias("s"), F.lit("$").alias("at"))
    rows = rows.withColumns({"_todo": F.array(root), "found": F.array().cast(_STRINGS)})
    for _ in range(depth):
        rows = rows.withColumn("_todo", F.transform("_todo", lambda c: F.struct(c["v"], c["at"], _fields(c["s"]).alias("rule"), F.schema_of_variant(c["v"]).alias("told"), _fields(c["v"]).alias("given"))))
        rows = rows.withColumn("_todo", F.transform("_todo", lambda c: c.withField("listed", F.coalesce(_fields(F.try_element_at(c["rule"], F.lit("properties"))), no_fields))))
        rows = rows.withColumns({"found": F.concat("found", F.flatten(F.transform("_todo", _value_errors))), "_todo": F.flatten(F.transform("_todo", _values_within))})
    return rows.drop("_todo")


def schema_depth(schema: Column) -> Column:
    """At least how many levels of values a schema speaks of.

    From the nesting of its braces: a level costs two of them by properties, one by items or additionalProperties.
    """
    bare = F.regexp_replace(schema, r'"(?:[^"\\]|\\.)*"', "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    nested = F.aggregate(F.split(F.regexp_replace(bare, r"[^{}]", ""), ""), start, step, lambda a: a["most"])
    single = F.regexp_count(schema, F.lit(r'"(?:items|additionalProperties)"'))
    return 1 + F.floor((F.greatest(nested, F.lit(1)) - 1 + F.least(single, nested)) / 2).cast("int")


def with_validation(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with errors: what their arguments have against the schema of the tool that they name, in sorted order.

    The tool must be known and arguments an object; then with_schema_errors, as deep as the schemas go. schemas: name, schema
    (JSON Schema of an object; one that is no JSON asks for nothing). Of repeated names the least schema holds.
    """
    schemas = schemas.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("schema").alias("_schema"))
    told = schemas.agg(F.count("*").alias("n"), F.max(schema_depth(F.col("_schema"))).alias("depth")).first()
    parsed = schemas.select(F.col("name").alias("_name"), F.try_parse_json("_schema").alias("_schema"))
    if told["n"] <= BROADCAST_TOOLS:
        parsed = F.broadcast(parsed)
    found = calls.join(parsed, F.col("name") == F.col("_name"), "left").withColumn("_given", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.schema_of_variant("_given").startswith("OBJECT"), F.lit(False))
    found = with_schema_errors(found.withColumn("_checked", F.when(is_object, F.col("_given"))), "_checked", "_schema", max(1, told["depth"] or 1))
    errors = F.when(F.col("_name").isNull(), F.array(F.lit("unknown tool"))).when(~is_object, F.array(F.lit("no object"))).otherwise(F.array_sort("found"))
    return found.withColumn("errors", errors).drop("_name", "_schema", "_given", "_checked", "found")


def with_levels(calls: DataFrame) -> DataFrame:
    """calls with level: how many calls the longest chain of those that it needs has; null in or behind a circle.

    So order by level is topological. Paths double in every round: the paths of so many links become those of twice as
    many, a row for each pair of ends, so a chain of a thousand calls takes ten rounds. A path of more links than its
    conversation has can only come from a circle. Of calls with one identifier all count.
    """
    named = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    wanted = named.select("conv_id", F.col("call_id").alias("id"), F.explode("after").alias("on_id")).where("on_id IS NOT NULL").distinct()
    links = wanted.join(named.select("conv_id", F.col("call_id").alias("on_id")).distinct(), ["conv_id", "on_id"], "left_semi")
    paths = written(links.select("conv_id", "id", "on_id"), "chat-paths")
    spark = calls.sparkSession
    n = (paths.groupBy("conv_id").count().agg(F.max("count")).first()[0]) or 0  # links of a conversation at most
    if not n:
        return calls.withColumn("level", F.lit(0).cast("bigint"))
    ends = paths.select("conv_id", "id").union(paths.select("conv_id", F.col("on_id").alias("id"))).distinct()
    levels, length = written(ends.withColumn("level", F.lit(0).cast("bigint")), "chat-levels"), 1
    while True:
        # levels holds the longest path of fewer than length links from each call, paths the ends of those of length links
        up = paths.join(levels.select("conv_id", F.col("id").alias("on_id"), F.col("level").alias("l")), ["conv_id", "on_id"]).groupBy("conv_id", "id").agg(F.max("l").alias("up"))
        new = written(levels.join(up, ["conv_id", "id"], "left").select("conv_id", "id", F.greatest("level", F.col("up") + length).alias("level")), "chat-levels")
        dropped(spark, levels)
        levels = new
        if 2 * length - 1 > n:
            break
        twice = paths.join(paths.select("conv_id", F.col("id").alias("on_id"), F.col("on_id").alias("far")), ["conv_id", "on_id"])
        further = written(twice.select("conv_id", "id", F.col("far").alias("on_id")).distinct(), "chat-paths")
        dropped(spark, paths)
        paths, length = further, 2 * length
        if paths.isEmpty():
            break
    # a path longer than all links together takes some link twice
    found = levels.select("conv_id", F.col("id").alias("call_id"), "level", (F.col("level") > n).alias("circle"))
    joined = calls.join(found, ["conv_id", "call_id"], "left")
    return joined.withColumn("level", F.when(F.coalesce("circle", F.lit(False)), F.lit(None)).otherwise(F.coalesce("level", F.lit(0)))).drop("circle")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each call and for each result without a call, in columns

    conv_id, turn, kind (call or result), call_id, name, result_turn, level, valid, errors, json. Calls and results meet by
    conversation and identifier. Of results with the same identifier the one of the least turn (then content) counts and
    the others stand alone; every call of a repeated identifier gets it. Null conversations or identifiers link to nothing.
    Order within a conversation: level, turn, call_id. An empty table of either kind gives the rows of the other.
    """
    calls = with_levels(with_validation(calls, schemas))
    answer = F.struct(F.col("turn"), F.col("content"))
    first = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(answer).alias("r"))
    ordered = F.transform(F.array_sort("after"), lambda x: x)
    linked = calls.join(first, ["conv_id", "call_id"], "left")
    call_json = F.to_json(F.struct(
        ordered.alias("after"), F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.to_json(F.struct(F.col("arguments").alias("text"))))).alias("arguments"), F.col("errors").alias("errors"),
        F.col("call_id").alias("id"), F.col("level").alias("level"), F.col("name").alias("name"),
        F.when(F.col("r").isNotNull(), F.struct(F.col("r.content").alias("content"), F.col("r.turn").alias("turn"))).alias("result"), F.lit("call").alias("role"), F.col("turn").alias("turn"),
    ), {"ignoreNullFields": "false"})
    call_rows = linked.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "name", F.col("r.turn").alias("result_turn"), "level", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), call_json.alias("json"))
    known = calls.select("conv_id", "call_id").distinct().withColumn("_known", F.lit(True))
    alone = results.join(known, ["conv_id", "call_id"], "left").join(first.select("conv_id", "call_id", "r"), ["conv_id", "call_id"], "left")
    alone = alone.where(F.col("_known").isNull() | ~F.col("r").eqNullSafe(answer))
    result_json = F.to_json(F.struct(F.col("content"), F.col("call_id").alias("id"), F.lit("result").alias("role"), F.col("turn")), {"ignoreNullFields": "false"})
    result_rows = alone.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast(results.schema["turn"].dataType).alias("result_turn"), F.lit(None).cast("bigint").alias("level"), F.lit(False).alias("valid"), F.lit("no call").alias("errors"), result_json.alias("json"))
    return call_rows.unionByName(result_rows)


def message_rows(messages: DataFrame) -> DataFrame:
    """A row of kind message, as link_calls has them, for each row of (conv_id, turn, role, text)."""
    null = lambda kind: F.lit(None).cast(kind)
    body = F.to_json(F.struct(F.col("text").alias("content"), F.col("role"), F.col("turn")), {"ignoreNullFields": "false"})
    return messages.select("conv_id", "turn", F.lit("message").alias("kind"), null("string").alias("call_id"), null("string").alias("name"), null(messages.schema["turn"].dataType).alias("result_turn"), null("bigint").alias("level"), F.lit(True).alias("valid"), F.lit("").alias("errors"), body.alias("json"))


def format_messages(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """link_calls over the tool blocks in messages, and a row of kind message for each message's text without them.

    Null roles and texts stay null in the JSON; messages that repeat each give their rows; extra columns are not read.
    """
    plain = messages.select("conv_id", "turn", "role", without_blocks(F.col("text")).alias("text"))
    return link_calls(parse_calls(messages), parse_results(messages), schemas).unionByName(message_rows(plain))


def without_blocks(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(text, CALL, ""), RESULT, ""))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns as calls and results of TOOLS.

    A user's turn is a call of ask, with its lines, if its text has several, else of reply, with its place and size. Calls
    are named by conversation and turn, but all those of less than SHORT characters by conversation alone, so identifiers
    repeat. A call needs those of the turn two before and of turn 0, as far as there are calls of that name. An assistant's
    turn is the result of the call named by the turn before it, which may not be there.
    """
    name = lambda at: F.concat_ws("-", F.col("conv_id").cast("string"), at.cast("string"))
    length, turn = F.char_length(whole("text")), F.col("turn")
    size = F.when(length < SHORT, "short").when(length < LONG, "medium").otherwise("long")
    asks, keep = F.contains(whole("text"), F.lit("\n")), {"ignoreNullFields": "false"}
    reply = F.to_json(F.struct(F.col("text").alias("prompt"), F.struct("turn", size.alias("size")).alias("about")), keep)
    ask = F.to_json(F.struct(F.col("text").alias("prompt"), F.split("text", "\n").alias("lines")), keep)
    needs = F.when(turn == 2, F.array(name(turn - 2))).when(turn > 2, F.array(name(turn - 2), name(F.lit(0)))).otherwise(F.array().cast("array<string>"))
    named = F.when(length < SHORT, name(F.lit("s"))).otherwise(name(turn))
    calls = messages.where("role = 'user'").select("conv_id", "turn", named.alias("call_id"), F.when(asks, "ask").otherwise("reply").alias("name"), F.when(asks, ask).otherwise(reply).alias("arguments"), needs.alias("after"))
    results = messages.where("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all conversations; tool blocks in any text, and of the other turns those of users and assistants as calls and results of TOOLS."""
    messages = read_table(spark, sf_dir, "conversations")
    blocks = F.coalesce(F.contains("text", F.lit("<tool_call>")) | F.contains("text", F.lit("<tool_result>")), F.lit(False))
    calls, results = turns_as_calls(messages.where(~blocks))
    calls, results = calls.unionByName(parse_calls(messages.where(blocks))), results.unionByName(parse_results(messages.where(blocks)))
    others = messages.where(blocks | F.col("role").isNull() | ~F.col("role").isin("user", "assistant")).withColumn("text", F.when(blocks, without_blocks(F.col("text"))).otherwise(F.col("text")))
    return link_calls(calls, results, spark.createDataFrame(TOOLS, "name string, schema string")).unionByName(message_rows(others))


OP3_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, text, conv_id || '-' || CASE WHEN length(coalesce(text, '')) < 100 THEN 's' ELSE turn::VARCHAR END AS call_id, contains(coalesce(text, ''), chr(10)) AS asks,
  CASE WHEN length(coalesce(text, '')) < 100 THEN 'short' WHEN length(text) < 300 THEN 'medium' ELSE 'long' END AS size,
  CASE WHEN turn = 2 THEN [conv_id || '-0'] WHEN turn > 2 THEN [conv_id || '-' || (turn - 2), conv_id || '-0'] ELSE [] END AS after FROM conversations WHERE role = 'user'),
d AS (SELECT DISTINCT x.conv_id, x.call_id, x.on_id FROM (SELECT conv_id, call_id, unnest(after) AS on_id FROM c) x JOIN c ON c.conv_id = x.conv_id AND c.call_id = x.on_id),
p AS (SELECT DISTINCT conv_id, call_id, 0::BIGINT AS n FROM c UNION SELECT d.conv_id, d.call_id, p.n + 1 FROM d JOIN p ON p.conv_id = d.conv_id AND p.call_id = d.on_id),
l AS (SELECT conv_id, call_id, max(n) AS level FROM p GROUP BY ALL),
r AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, call_id, arg_min(text, turn) AS text, min(turn) AS turn FROM r GROUP BY ALL),
e AS (SELECT c.*, l.level, CASE WHEN asks THEN 'ask' ELSE 'reply' END AS name,
  CASE WHEN asks THEN [] WHEN c.text IS NULL THEN ['type of prompt'] WHEN size = 'long' THEN ['value of about.size'] ELSE [] END AS errs, f.answer, f.result_turn
  FROM c JOIN l USING (conv_id, call_id) LEFT JOIN (SELECT conv_id, call_id, text AS answer, turn AS result_turn FROM f) f USING (conv_id, call_id))
SELECT conv_id, turn, 'call' AS kind, call_id, name, result_turn, level, len(errs) = 0 AS valid, array_to_string(errs, '; ') AS errors,
  '{"after":' || to_json(list_sort(after)) || ',"arguments":' || CASE WHEN asks THEN '{"lines":' || to_json(string_split(text, chr(10))) || ',"prompt":' || to_json(text) || '}'
    ELSE '{"about":{"size":"' || size || '","turn":' || turn || '},"prompt":' || coalesce(to_json(text), 'null') || '}' END || ',"errors":' || to_json(errs) || ',"id":"' || call_id || '","level":' || level || ',"name":"' || name || '","result":'
  || CASE WHEN result_turn IS NULL THEN 'null' ELSE '{"content":' || coalesce(to_json(answer), 'null') || ',"turn":' || result_turn || '}' END || ',"role":"call","turn":' || turn || '}' AS json
FROM e
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.call_id, NULL, NULL, NULL, false, 'no call',
  '{"content":' || coalesce(to_json(r.text), 'null') || ',"id":"' || r.call_id || '","role":"result","turn":' || r.turn || '}'
FROM r LEFT JOIN (SELECT DISTINCT conv_id, call_id FROM c) c ON r.conv_id = c.conv_id AND r.call_id = c.call_id WHERE c.call_id IS NULL
UNION ALL
SELECT conv_id, turn, 'message', NULL, NULL, NULL, NULL, true, '',
  '{"content":' || coalesce(to_json(text), 'null') || ',"role":' || coalesce(to_json(role), 'null') || ',"turn":' || turn || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
