"""Tool-call linking in chats, with DataFrame and SQL functions only.

Calls meet results in a hash join on their identifier, calls are put in topological order by peeling those whose
dependencies are placed, their arguments are checked against the schemas of the tools as rows (one per argument), and each
call with its result is written as canonical JSON: keys sorted, no white space (a variant keeps its keys sorted), one text
for each number, whose digits never pass through a floating-point value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pigeonhole.functions.arrays import block_positions
from pigeonhole.functions.json import let, parse

from .common import cut, salt_of

TOOL_SALTS = 16
NO_CHAT = -(2**63)  # calls without a conversation are one of their own
KINDS = [("BIGINT|TINYINT|SMALLINT|INT", "integer"), ("DECIMAL.*|DOUBLE|FLOAT", "number"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("ARRAY.*", "array"), ("OBJECT.*", "object"), ("VOID", "null")]


def one_per_id(rows: DataFrame, kind: str) -> DataFrame:
    """The earliest row of each identifier and how many there are; partial aggregates meet before the shuffle."""
    fields = [c for c in rows.columns if c != "call_id"]
    return rows.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct(*fields)).alias("r"), F.count(F.lit(1)).alias(f"{kind}s")).select("call_id", f"{kind}s", *[F.col(f"r.{c}").alias(c) for c in fields])


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``call_id, level``: 0 without dependencies, else one more than the highest of them; calls of or behind a cycle are missing."""
    left = cut(edges.distinct(), "dependencies")
    placed = [cut(calls.select("call_id").join(left.select(F.col("call_id")), "call_id", "left_anti").withColumn("level", F.lit(0)), "level")]
    while not left.isEmpty():
        done = placed[-1].select(F.col("call_id").alias("needs"))
        candidates = left.join(done, "needs", "left_semi").select("call_id").distinct()
        left = cut(left.join(done, "needs", "left_anti"), "dependencies")
        ready = cut(candidates.join(left, "call_id", "left_anti").withColumn("level", F.lit(len(placed))), "level")
        if ready.isEmpty():
            break
        placed.append(ready)
    found = placed[0]
    for level in placed[1:]:
        found = found.unionByName(level)
    return found


STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
PLAIN_DIGITS = 100  # longer whole numbers are written with an exponent; no digit is lost either way


def marked_numbers(text: Column, mark: Column) -> Column:
    """JSON text with every number outside strings as a string of its own that begins with ``mark``."""
    parted = F.regexp_replace(text, f"({STRING})|(-?[0-9][0-9.eE+-]*+)", "$1\ue001$2\ue002")
    return F.replace(F.replace(F.replace(parted, F.lit("\ue001\ue002"), F.lit("")), F.lit("\ue001"), F.concat(F.lit('"'), mark)), F.lit("\ue002"), F.lit('"'))


def canonical_number(text: Column) -> Column:
    """One text for each value: no exponent, leading or trailing zeros where the number is short enough; every digit is kept."""
    low = F.lower(F.ltrim(text, F.lit("-")))
    mantissa = F.substring_index(low, "e", 1)
    exponent = F.when(F.contains(low, F.lit("e")), F.substring_index(low, "e", -1).try_cast("int")).otherwise(F.lit(0)).cast("bigint")
    fraction = F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise(F.lit(""))

    def written(p: Column) -> Column:
        digits = F.ltrim(F.concat(F.substring_index(p["m"], ".", 1), p["f"]), F.lit("0"))
        return let(F.struct(digits.alias("all"), F.rtrim(digits, F.lit("0")).alias("d")), lambda q: let(F.struct(
            q["d"].alias("d"), F.length(q["d"]).alias("k"), (p["x"] - F.length(p["f"]) + F.length(q["all"])).alias("n")), shape))

    def shape(q: Column) -> Column:
        d, k, n = q["d"], q["k"], q["n"]
        whole = n.cast("int")
        science = F.concat(F.substring(d, 1, 1), F.when(k > 1, F.concat(F.lit("."), F.substring(d, 2, 1 << 30))).otherwise(F.lit("")), F.lit("e"), F.when(n > 0, F.lit("+")).otherwise(F.lit("")), (n - 1).cast("string"))
        return (F.when(k == 0, F.lit("0")).when((n >= k) & (n <= PLAIN_DIGITS), F.rpad(d, whole, "0"))
                .when((n > 0) & (n < k), F.concat(F.substr(d, F.lit(1), whole), F.lit("."), F.substr(d, whole + 1)))
                .when((n <= 0) & (n > -6), F.concat(F.lit("0."), F.repeat(F.lit("0"), -whole), d)).otherwise(science))

    parts = F.struct(mantissa.alias("m"), fraction.alias("f"), exponent.alias("x"))
    value = F.coalesce(let(parts, written), low)  # an exponent beyond 64 bits stays as it is
    return F.when(F.startswith(text, F.lit("-")) & (value != "0"), F.concat(F.lit("-"), value)).otherwise(value)


def is_whole(number: Column) -> Column:
    """A canonical number without a fraction: 1.0 and 1e3 are whole numbers, however they were written."""
    fraction = F.length(F.regexp_extract(number, r"[.]([0-9]*)", 1))
    return ~F.contains(number, F.lit(".")) & ~F.contains(number, F.lit("e-")) | F.coalesce(F.regexp_extract(number, r"e[+]([0-9]+)$", 1).try_cast("bigint") >= fraction, F.lit(False))


def plain_numbers(text: Column, mark: Column) -> Column:
    """The text of ``marked_numbers`` with canonical numbers again."""
    def piece(x: Column, i: Column) -> Column:
        return F.when(i == 0, x).otherwise(F.concat(canonical_number(F.substring_index(x, '"', 1)), F.substr(x, F.instr(x, '"') + 1)))
    return F.array_join(F.transform(F.split(text, F.concat(F.lit('"'), mark)), piece), "")


def colons(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(text, STRING, ""), "[^:]", ""))


def read_arguments(calls: DataFrame) -> DataFrame:
    """Adds ``mark``, ``args`` (variant with marked numbers; null for what isn't one JSON value or repeats a key) and ``args_json``,
    the canonical text. Nothing here depends on a session's settings."""
    rows = calls.withColumn("mark", F.concat(F.lit("n"), F.hex(F.xxhash64("arguments")), F.lit("_")))
    valid = F.when(parse(F.col("arguments")).isNotNull(), marked_numbers(F.col("arguments"), F.col("mark")))
    # A parser that lets keys repeat keeps one of them: then colons are missing from what it has read.
    read = let(valid, lambda v: let(F.try_parse_json(v), lambda a: let(F.to_json(a), lambda j: F.when(colons(j) == colons(v), F.struct(a.alias("a"), j.alias("j"))))))
    rows = rows.withColumn("_read", read)
    return rows.withColumns({"args": F.col("_read.a"), "args_json": plain_numbers(F.col("_read.j"), F.col("mark"))}).drop("_read")


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``call_id, errors`` (sorted) of the calls of ``read_arguments`` whose arguments don't fit the schema of their tool."""
    parsed = calls.select("call_id", "name", "mark", "args").withColumn("is_object", F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False)))
    whole = parsed.where("not is_object").select("call_id", F.lit("arguments: not an object").alias("error"))
    good = parsed.where("is_object")
    given = calls.sparkSession.sql("select call_id, mark, v.key as param, schema_of_variant(v.value) as kind, try_variant_get(v.value, '$', 'string') as text from {good}, lateral variant_explode(args) v", good=good)
    number = F.when((F.col("kind") == "STRING") & F.startswith("text", "mark"), canonical_number(F.substr("text", F.length("mark") + 1)))
    named = F.lit("other")
    for pattern, name in KINDS:
        named = F.when(F.col("kind").rlike(f"^({pattern})"), name).otherwise(named)
    named = F.when(F.col("number").isNull(), named).when(is_whole(F.col("number")), "integer").otherwise("number")
    given = given.withColumn("number", number).select("call_id", "param", named.alias("kind"))
    # Most calls may name one tool: its few rows are repeated under each salt of the calls.
    tools = schemas.where("name is not null and param is not null").groupBy("name", "param").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    tools = tools.select("*", F.explode(F.sequence(F.lit(0), F.lit(TOOL_SALTS - 1))).alias("salt"))
    salted = good.select("call_id", "name", salt_of("call_id", salts=TOOL_SALTS).alias("salt"))
    expected = salted.join(tools, ["name", "salt"]).select("call_id", "param", "type", "required")
    unknown = salted.join(tools.select("name", "salt").distinct(), ["name", "salt"], "left_anti").select("call_id", F.lit("name: unknown tool").alias("error"))
    both = given.join(expected, ["call_id", "param"], "full")
    fits = (F.col("kind") == F.col("type")) | ((F.col("kind") == "integer") & (F.col("type") == "number"))
    error = (F.when(F.col("kind").isNull() & F.col("required"), F.concat("param", F.lit(": missing")))
             .when(F.col("kind").isNotNull() & F.col("type").isNull(), F.concat("param", F.lit(": not expected")))
             .when(~fits, F.concat("param", F.lit(": "), "kind", F.lit(" for "), "type")))
    wrong = both.select("call_id", error.alias("error")).where("error is not null").join(unknown.select("call_id"), "call_id", "left_anti")
    return whole.unionByName(unknown).unionByName(wrong).groupBy("call_id").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call or result identifier, linked, ordered, checked and serialised.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), needs (array of call ids); ``results``: call_id, turn,
    content; ``schemas``: name, param, type, required. status: ``linked``, ``no_result`` or ``no_call``. level and position
    (from 1, per conversation, by level, turn and id) are null for a call of or behind a cycle. A needed id that no call has
    is an error of the call and doesn't delay it; so does a call that needs itself: it is a cycle. Of calls or results
    that repeat an id the earliest counts (ties: the smallest row) and ``calls`` and ``results`` tell how many there are.
    Null ids link nothing and are left out; a null name is an unknown tool, null arguments aren't an object, null content is
    left out of the message. A missing conversation is one of its own. No rows give none.
    """
    one = cut(read_arguments(one_per_id(calls.select("call_id", "turn", "conv_id", "name", "arguments", "needs"), "call")), "calls")
    answer = one_per_id(results.select("call_id", F.col("turn").alias("result_turn"), "content"), "result")
    wanted = one.select("call_id", F.explode("needs").alias("needs")).where("needs is not null").distinct()
    known = one.select(F.col("call_id").alias("needs"))
    dangling = wanted.join(known, "needs", "left_anti").groupBy("call_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("needs: no call "), "needs"))).alias("dangling"))
    placed = levels(one, wanted.join(known, "needs", "left_semi").select("call_id", "needs"))

    chat = F.coalesce("conv_id", F.lit(NO_CHAT))
    ordered = block_positions(placed.join(one.select("call_id", "turn", chat.alias("chat")), "call_id"), ["chat"],
                              F.struct("level", F.coalesce(F.expr("turn div 1000"), F.lit(-1))), ["level", "turn", "call_id"], "position")
    none = F.array().cast("array<string>")
    rows = (one.join(answer, "call_id", "full").join(ordered.select("call_id", "level", "position"), "call_id", "left")
            .join(argument_errors(one, schemas), "call_id", "left").join(dangling, "call_id", "left"))
    status = F.when(F.col("calls").isNull(), "no_call").when(F.col("results").isNull(), "no_result").otherwise("linked")
    plain = lambda c: F.substring(F.to_json(F.struct(F.col(c).alias("x"))), 6, 1 << 30)  # noqa: E731  the value and a brace
    text = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{k}":'), F.expr(f"substring({k}_json, 1, length({k}_json) - 1)")))
    rows = rows.withColumns({"id_json": plain("call_id"), "name_json": plain("name"), "result_json": plain("content"), "raw_json": plain("arguments")})
    arguments = F.when(F.col("args_json").isNotNull(), F.concat(F.lit('"arguments":'), "args_json")).when(F.col("arguments").isNotNull(), F.concat(F.lit('"arguments":'), F.expr("substring(raw_json, 1, length(raw_json) - 1)")))
    message = F.concat(F.lit("{"), F.concat_ws(",", arguments, text("id", "call_id"), text("name", "name"), text("result", "content")), F.lit("}"))
    return rows.select("conv_id", "call_id", "turn", "result_turn", "name", status.alias("status"), "level", "position", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("results", F.lit(0)).alias("results"),
                       F.concat_ws("; ", F.coalesce("errors", none), F.coalesce("dangling", none)).alias("errors"), message.alias("message"))


def chat_traffic(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as tool traffic: every assistant turn is a call (whole text among its arguments) that needs one earlier
    turn's call, and every later user turn is the result of the turn before it."""
    call_id = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    earlier = F.when(turn < 8, turn - 2).otherwise(F.expr("turn div 8"))
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    fields = [F.concat(F.lit('"query": '), F.expr("substring(to_json(named_struct('x', coalesce(text, ''))), 6, length(to_json(named_struct('x', coalesce(text, '')))) - 6)")),
              F.concat(F.lit('"limit" : '), F.when(turn % 7 == 5, F.concat(F.lit('"'), words.cast("string"), F.lit('"'))).otherwise(words.cast("string"))),
              F.when(turn % 5 == 4, F.lit('"extra":null')).otherwise(F.lit('"deep":{"z":[1,2], "a":true}'))]
    arguments = F.concat(F.lit("{ "), F.concat_ws(" , ", *fields), F.when(turn % 11 == 9, F.lit("")).otherwise(F.lit("}")))
    name = F.when(turn % 3 == 1, "search").when(turn % 3 == 2, "lookup").otherwise("draw")
    calls = turns.where("role = 'assistant'").select("conv_id", "turn", call_id(turn).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.when(turn > 1, F.array(call_id(earlier))).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = turns.where("role = 'user' and turn > 0").select(call_id(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


SCHEMAS = [("search", "query", "string", True), ("search", "limit", "integer", True), ("search", "deep", "object", False),
           ("lookup", "query", "string", True), ("lookup", "limit", "number", False), ("lookup", "page", "integer", True), ("lookup", "deep", "object", False), ("lookup", "extra", "null", False)]


def link_conversations(turns: DataFrame) -> DataFrame:
    calls, results = chat_traffic(turns)
    rows = ", ".join(f"('{n}', '{p}', '{t}', {str(r).lower()})" for n, p, t, r in SCHEMAS)
    return link_tool_calls(calls, results, turns.sparkSession.sql(f"select * from values {rows} as t(name, param, type, required)"))
