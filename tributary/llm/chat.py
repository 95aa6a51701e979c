"""Operator 8: chat formatting with linked tool calls, in DataFrame functions alone.

A turn of role `assistant` may be a JSON object with `tool_calls`, a list of {id, name, arguments, depends_on};
one of role `tool` a JSON object with `tool_call_id` and `content`; one of role `system` may carry `tools`, a list
of {name, parameters: {properties: {name: {type}}, required}}. Calls are joined to results by conversation and id
(hash join), ordered so that a call follows those it depends on, and their arguments checked against the schema that
their conversation gives. Each turn becomes one line of canonical JSON (sorted keys, no spaces), calls with their
results inside; the lines of a conversation, by turn, are its training record. Turns are not gathered by
conversation, so one of any length does no harm.

Any other text, null included, is content as it stands. Every call is in the line of its turn, with a status, the first
that holds: `no_id`; `repeated_id` (an earlier call by turn and place has its id); `unknown_tool`, `bad_arguments`,
`missing_dependency`, `cycle`, `no_result`, `ok`. Of results that share conversation and id the first by turn counts. Null
conversations count as one conversation, a null turn as the first of its conversation. Repeated turns each get a row
(the calls of the second are then repeated). An empty table gives no rows. Columns other than conv_id, turn, role and
text are ignored.

Conversations of up to IN_ROW_CALLS calls are put in order each inside one row; larger ones in rounds of joins over all
their calls, one for each step of their longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import materialise

#: Calls of a conversation that one row may hold; ids and dependencies alone.
IN_ROW_CALLS = 1_500


def _get(v, path: str, kind: str):
    return F.try_variant_get(v, path, kind)


def _json(role: str) -> Column:
    """The JSON of a turn of that role whose text begins as an object does, else null."""
    return F.when(F.col("text").startswith("{") & (F.col("role") == role), F.try_parse_json("text"))


def spoken(turns: DataFrame) -> DataFrame:
    """The turns that may hold calls, results or tools, each with a number of its own, written once so that numbers stay."""
    told = turns.where(F.col("text").startswith("{") & F.col("role").isin("assistant", "tool", "system"))
    return materialise(told.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", "text"), "spoken")


def calls(said: DataFrame) -> DataFrame:
    """row, conv_id, turn, place, id, name, arguments, needs of each call, first: whether it is the first of its id."""
    each = said.select("row", "conv_id", "turn", F.posexplode(_get(_json("assistant"), "$.tool_calls", "array<variant>")).alias("place", "c"))
    needs = F.coalesce(_get(F.col("c"), "$.depends_on", "array<string>"), F.array().cast("array<string>"))
    each = each.select("row", "conv_id", "turn", "place", _get(F.col("c"), "$.id", "string").alias("id"), _get(F.col("c"), "$.name", "string").alias("name"), F.to_json(_get(F.col("c"), "$.arguments", "variant")).alias("arguments"), needs.alias("needs"))
    each = materialise(each, "calls")
    place = F.struct("turn", "row", "place")
    first = each.where("id is not null").groupBy(F.col("conv_id").alias("_c"), F.col("id").alias("_i")).agg(F.min(place).alias("_p"))
    met = each.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i")), "left")
    return met.withColumn("first", place.eqNullSafe(F.col("_p"))).drop("_c", "_i", "_p")


def results(said: DataFrame) -> DataFrame:
    v = _json("tool")
    each = said.select("conv_id", "turn", _get(v, "$.tool_call_id", "string").alias("id"), F.to_json(_get(v, "$.content", "variant")).alias("result")).where("id is not null")
    return each.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "result")).alias("f")).select(F.col("conv_id").alias("r_conv"), F.col("id").alias("r_id"), F.col("f.result").alias("result"), F.col("f.turn").alias("result_turn"))


def tools(said: DataFrame) -> DataFrame:
    each = said.select("conv_id", "turn", "row", F.posexplode(_get(_json("system"), "$.tools", "array<variant>")).alias("place", "t"))
    each = each.select("conv_id", "turn", "row", "place", _get(F.col("t"), "$.name", "string").alias("name"), F.to_json(_get(F.col("t"), "$.parameters", "variant")).alias("schema")).where("name is not null")
    return each.groupBy("conv_id", "name").agg(F.min(F.struct("turn", "row", "place", "schema")).alias("f")).select(F.col("conv_id").alias("t_conv"), F.col("name").alias("t_name"), F.coalesce("f.schema", F.lit("{}")).alias("schema"))


def _type_fits(want, value):
    got = F.schema_of_variant(value)
    number = got.startswith("DECIMAL") | got.isin("DOUBLE", "FLOAT")
    return (
        F.when(want.isNull(), F.lit(True)).when(want == "string", got == "STRING").when(want == "integer", got == "BIGINT").when(want == "number", (got == "BIGINT") | number)
        .when(want == "boolean", got == "BOOLEAN").when(want == "array", got.startswith("ARRAY")).when(want == "object", got.startswith("OBJECT")).when(want == "null", got == "VOID").otherwise(F.lit(False))
    )


def valid_arguments():
    """Whether `arguments` (JSON) is an object with all that `schema` requires and nothing of another name or type."""
    given = F.coalesce(_get(F.try_parse_json("arguments"), "$", "map<string, variant>"), F.lit(None))
    schema = F.try_parse_json("schema")
    kinds = F.coalesce(_get(schema, "$.properties", "map<string, variant>"), F.create_map().cast("map<string, variant>"))
    needed = F.coalesce(_get(schema, "$.required", "array<string>"), F.array().cast("array<string>"))
    fits = F.forall(F.map_entries(given), lambda e: F.map_contains_key(kinds, e["key"]) & _type_fits(_get(F.element_at(kinds, e["key"]), "$.type", "string"), e["value"]))
    return F.coalesce(given.isNotNull() & F.forall(needed, lambda n: F.map_contains_key(given, n)) & fits, F.lit(False))


def _levels_in_row(nodes: DataFrame) -> DataFrame:
    """conv_id, id, level, lacks of conversations that fit into a row each."""
    held = nodes.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("id", "needs"))).alias("calls"))
    ids = F.col("calls.id")
    at = F.transform("calls", lambda c: F.transform(c["needs"], lambda n: F.array_position(ids, n)))
    held = held.withColumn("at", at).withColumn("known", F.transform("at", lambda xs: F.filter(xs, lambda i: i > 0)))
    start = F.transform("known", lambda xs: F.when(F.size(xs) == 0, 0))
    settled = lambda xs, level: F.transform(xs, lambda i: F.get(level, (i - 1).cast("int")))

    def again(level, _):
        # A round settles the calls all of whose dependencies are settled; a chain in the order of its calls takes one round a call.
        return F.zip_with(level, F.col("known"), lambda now, xs: F.coalesce(now, F.when(F.forall(settled(xs, level), lambda x: x.isNotNull()), F.array_max(settled(xs, level)) + 1)))

    deep = F.size(F.filter("known", lambda xs: F.size(xs) > 0))
    level = F.when(deep == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), start, again))
    held = held.withColumn("level", level)
    rows = F.zip_with(F.zip_with("calls", "level", lambda c, n: F.struct(c["id"].alias("id"), n.alias("level"))), F.col("at"), lambda x, xs: F.struct(x["id"].alias("id"), x["level"].alias("level"), F.exists(xs, lambda i: i == 0).alias("lacks")))
    return held.select("conv_id", F.inline(rows))


def _levels_by_rounds(nodes: DataFrame) -> DataFrame:
    """The same by joins, for conversations of any size."""
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    edges = nodes.select("conv_id", "id", F.explode("needs").alias("need")).alias("e")
    known = edges.join(nodes.alias("n"), same("e", "n") & (F.col("e.need") == F.col("n.id")), "left").select("e.conv_id", "e.id", "need", F.col("n.id").isNotNull().alias("known"))
    known = materialise(known, "call-edges")
    lacking = known.where("not known").select("conv_id", "id").distinct()
    edges = known.where("known")
    out = nodes.alias("n").join(edges.select("conv_id", "id").distinct().alias("e"), same("n", "e") & (F.col("n.id") == F.col("e.id")), "left_anti")
    done = materialise(out.select("conv_id", "id", F.lit(0).alias("level")), "call-levels")
    while edges.limit(1).count():
        at = edges.alias("e").join(done.alias("d"), same("e", "d") & (F.col("e.need") == F.col("d.id")), "left").groupBy("e.conv_id", "e.id").agg(F.max("level").alias("top"), F.count_if(F.col("level").isNull()).alias("left"))
        new = at.where("left = 0").alias("a").join(done.alias("d"), same("a", "d") & (F.col("a.id") == F.col("d.id")), "left_anti")
        new = materialise(new.select("conv_id", "id", (F.col("top") + 1).alias("level")), "call-levels")
        if not new.limit(1).count():
            break
        done = materialise(done.union(new), "call-levels")
    met = nodes.alias("n").join(done.alias("d"), same("n", "d") & (F.col("n.id") == F.col("d.id")), "left").select("n.conv_id", "n.id", "level").alias("m")
    met = met.join(lacking.withColumn("lack", F.lit(True)).alias("k"), same("m", "k") & (F.col("m.id") == F.col("k.id")), "left")
    return met.select("m.conv_id", "m.id", "level", F.coalesce("lack", F.lit(False)).alias("lacks"))


def levels(made: DataFrame) -> DataFrame:
    """conv_id, id, level (0: depends on no call), lacks (a dependency is no call of the conversation) of calls (conv_id, id, needs).

    Level is null on or behind a cycle.
    """
    nodes = materialise(made.select("conv_id", "id", F.array_distinct("needs").alias("needs")), "call-nodes")
    large = materialise(nodes.groupBy("conv_id").count().where(F.col("count") > IN_ROW_CALLS).select(F.col("conv_id").alias("large")), "large-conversations")
    if not large.limit(1).count():
        return _levels_in_row(nodes)
    here = F.col("conv_id").eqNullSafe(F.col("large"))
    return _levels_in_row(nodes.join(large, here, "left_anti")).union(_levels_by_rounds(materialise(nodes.join(large, here, "left_semi"), "large-nodes")))


def linked_calls(said: DataFrame) -> DataFrame:
    """One row for each call: its arguments, result, level and status."""
    made = materialise(calls(said), "calls")
    placed = levels(made.where("first").select("conv_id", "id", "needs")).select(F.col("conv_id").alias("l_conv"), F.col("id").alias("l_id"), "level", "lacks")
    own = made.where("first").join(results(said).hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("id") == F.col("r_id")), "left")
    own = own.join(tools(said), F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("name") == F.col("t_name")), "left")
    own = own.join(placed, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("id") == F.col("l_id")), "left")
    early = F.coalesce(F.col("result_turn") < F.col("turn"), F.lit(False))
    status = (
        F.when(F.col("schema").isNull(), "unknown_tool").when(~valid_arguments(), "bad_arguments").when(F.col("lacks"), "missing_dependency").when(F.col("level").isNull(), "cycle")
        .when(F.col("result").isNull() | early, "no_result").otherwise("ok")
    )
    out = ("row", "place", "id", "name", "arguments")
    spare = made.where("not first").select(*out, F.lit(None).cast("string").alias("result"), F.lit(None).cast("int").alias("level"), F.when(F.col("id").isNull(), "no_id").otherwise("repeated_id").alias("status"))
    return own.select(*out, "result", "level", status.alias("status")).union(spare)


def _member(name: str, value):
    return F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null")))


def _quoted(value):
    """A string as JSON."""
    made = F.to_json(F.struct(value.alias("s")))
    return F.when(value.isNotNull(), F.substring(made, F.lit(6), F.length(made) - 6))


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_calls, n_ok, message (canonical JSON) of each turn."""
    listed = _get(_json("assistant"), "$.tool_calls", "array<variant>")
    calling = F.coalesce((F.col("role") == "assistant") & listed.isNotNull(), F.lit(False))
    plain = F.concat(F.lit("{"), F.concat_ws(",", _member("content", _quoted(F.col("text"))), _member("role", _quoted(F.col("role")))), F.lit("}"))
    rest = turns.where(~calling).select("conv_id", "turn", "role", F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_ok"), plain.alias("message"))
    if not turns.where(calling).limit(1).count():
        return rest
    said = spoken(turns)
    one = F.concat(F.lit("{"), F.concat_ws(",", _member("arguments", F.col("arguments")), _member("id", _quoted(F.col("id"))), _member("name", _quoted(F.col("name"))), _member("result", F.col("result")), _member("status", _quoted(F.col("status")))), F.lit("}"))
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(1 << 30)).alias("level"), "place", one.alias("json"))))
    in_turn = linked_calls(said).groupBy(F.col("row").alias("_row")).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.concat_ws(",", F.transform(ordered, lambda x: x["json"])).alias("list"))
    content = F.to_json(_get(_json("assistant"), "$.content", "variant"))
    body = F.concat(F.lit("{"), F.concat_ws(",", _member("calls", F.concat(F.lit("["), F.coalesce("list", F.lit("")), F.lit("]"))), _member("content", content), _member("role", _quoted(F.col("role")))), F.lit("}"))
    full = said.where(calling).join(in_turn, F.col("row") == F.col("_row"), "left")
    return rest.union(full.select("conv_id", "turn", "role", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_ok", F.lit(0)).alias("n_ok"), body.alias("message")))


def op8_chat(spark: SparkSession, turns: DataFrame) -> DataFrame:
    return format_chat(turns)


ORACLE_SQL = """
SELECT conv_id, turn, role, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_ok,
       CAST(json_object('content', text, 'role', role) AS VARCHAR) AS message
FROM conversations
"""


def with_calls(conversations: DataFrame) -> DataFrame:
    """A table of the same conversations in which turns are made to declare tools, call them and give results.

    The first turn of each declares a tool; odd turns make two calls, the first dependent on the first call two turns
    before, the second on the first; even ones give the result of the turn before. By the number of the conversation,
    calls lack a result, an argument of the right type, a declared tool, an id, a dependency, or depend on each other.
    """
    c, t = F.col("conv_id"), F.col("turn")
    s = lambda x: x.cast("string")
    name = F.when(c % 5 == 1, "g").otherwise("f")
    x = F.when(c % 5 == 2, F.lit('"no"')).otherwise(s(t))
    needs = F.when(c % 5 == 3, F.lit('"zz"')).when((c % 5 == 4) & (c % 3 == 1), F.concat(F.lit('"d'), s(t), F.lit('"'))).when(t >= 3, F.concat(F.lit('"c'), s(t - 2), F.lit('"'))).otherwise(F.lit(""))
    first = F.concat(F.lit('{"arguments":{"x":'), x, F.lit('},"depends_on":['), needs, F.lit('],"id":"c'), s(t), F.lit('","name":"'), name, F.lit('"}'))
    second = F.concat(F.lit('{"arguments":{"x":1},"depends_on":["c'), s(t), F.lit('"],'), F.when(c % 7 == 3, "").otherwise(F.concat(F.lit('"id":"d'), s(t), F.lit('",'))), F.lit('"name":"f"}'))
    told = (
        F.when(t == 0, '{"tools":[{"name":"f","parameters":{"properties":{"x":{"type":"integer"}},"required":["x"]}}]}')
        .when(t % 2 == 1, F.concat(F.lit('{"content":"ask","tool_calls":['), second, F.lit(","), first, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"content":'), s(t), F.lit(',"tool_call_id":"'), F.when(c % 7 == 5, "z").otherwise(F.lit("c")), s(t - 1), F.lit('"}')))
    )
    return conversations.select("conv_id", "turn", F.when(t == 0, "system").when(t % 2 == 1, "assistant").otherwise("tool").alias("role"), told.alias("text"))


#: The same table's calls as relations, their levels by recursion.
CALLS_SQL = """
WITH RECURSIVE base AS (SELECT DISTINCT conv_id AS c, turn AS t FROM conversations),
tools AS (SELECT c FROM base WHERE t = 0),
calls AS (
  SELECT c, t, 1 AS place, 'c' || t AS id, CASE WHEN c % 5 = 1 THEN 'g' ELSE 'f' END AS name,
         '{"x":' || CASE WHEN c % 5 = 2 THEN '"no"' ELSE CAST(t AS VARCHAR) END || '}' AS arguments, c % 5 <> 2 AS fits,
         CASE WHEN c % 5 = 3 THEN 'zz' WHEN c % 5 = 4 AND c % 3 = 1 THEN 'd' || t WHEN t >= 3 THEN 'c' || (t - 2) END AS need
  FROM base WHERE t % 2 = 1
  UNION ALL SELECT c, t, 0, CASE WHEN c % 7 = 3 THEN NULL ELSE 'd' || t END, 'f', '{"x":1}', true, 'c' || t FROM base WHERE t % 2 = 1
),
lev AS (
  SELECT c, id, 0 AS level FROM calls a WHERE id IS NOT NULL AND (need IS NULL OR NOT EXISTS (SELECT 1 FROM calls b WHERE b.c = a.c AND b.id = a.need))
  UNION ALL SELECT a.c, a.id, lev.level + 1 FROM lev JOIN calls a ON a.c = lev.c AND a.need = lev.id WHERE a.id IS NOT NULL
),
res AS (SELECT c, CASE WHEN c % 7 = 5 THEN 'z' ELSE 'c' END || (t - 1) AS id, CAST(t AS VARCHAR) AS result FROM base WHERE t > 0 AND t % 2 = 0),
judged AS (
  SELECT a.*, lev.level, res.result, CASE WHEN a.id IS NULL THEN 'no_id' WHEN a.name = 'g' OR tools.c IS NULL THEN 'unknown_tool' WHEN NOT fits THEN 'bad_arguments'
    WHEN need IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls b WHERE b.c = a.c AND b.id = a.need) THEN 'missing_dependency' WHEN lev.level IS NULL THEN 'cycle' WHEN res.result IS NULL THEN 'no_result' ELSE 'ok' END AS status
  FROM calls a LEFT JOIN lev ON lev.c = a.c AND lev.id = a.id LEFT JOIN res ON res.c = a.c AND res.id = a.id LEFT JOIN tools ON tools.c = a.c
),
lines AS (
  SELECT c, t, count(*) AS n_calls, count(*) FILTER (status = 'ok') AS n_ok,
         string_agg('{"arguments":' || arguments || ',"id":' || coalesce('"' || id || '"', 'null') || ',"name":"' || name || '","result":' || coalesce(result, 'null') || ',"status":"' || status || '"}', ',' ORDER BY coalesce(level, 1073741824), place) AS list
  FROM judged GROUP BY 1, 2
)
SELECT b.c AS conv_id, b.t AS turn, CASE WHEN b.t = 0 THEN 'system' WHEN b.t % 2 = 1 THEN 'assistant' ELSE 'tool' END AS role, coalesce(n_calls, 0) AS n_calls, coalesce(n_ok, 0) AS n_ok,
  CASE WHEN b.t = 0 THEN '{"content":"{\\"tools\\":[{\\"name\\":\\"f\\",\\"parameters\\":{\\"properties\\":{\\"x\\":{\\"type\\":\\"integer\\"}},\\"required\\":[\\"x\\"]}}]}","role":"system"}'
    WHEN b.t % 2 = 1 THEN '{"calls":[' || list || '],"content":"ask","role":"assistant"}'
    ELSE '{"content":"{\\"content\\":' || b.t || ',\\"tool_call_id\\":\\"' || CASE WHEN b.c % 7 = 5 THEN 'z' ELSE 'c' END || (b.t - 1) || '\\"}","role":"tool"}' END AS message
FROM base b LEFT JOIN lines ON lines.c = b.c AND lines.t = b.t
"""
