"""Tool calls of conversations: linked with their results, checked against schemas, ordered and written as canonical JSON.

Calls and results are joined by conversation and identifier. Within a conversation, a call comes after every call that
it names in ``depends_on``; among calls that are free, the earlier place comes first. Where all calls name earlier ones,
that order is the order of places and needs no search. Otherwise a call that names a later one opens a stretch from its
own place to that one's; stretches that overlap are one, calls outside keep their places, and inside a stretch calls come
by level, one more than the highest level that they wait for. Stretches of up to LOCAL calls and dependencies are each
levelled by one task; longer ones in rounds over all of them at once, so no long conversation is gathered in one task.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_key, drop_written, table, written

#: Most calls and dependencies of a stretch that one task levels in memory.
LOCAL = 10_000


def canonical(value) -> str:
    """JSON with sorted keys, no white space, characters as they are, and whole numbers without a point.

    Keys are sorted by UTF-16 code units and numbers written as ECMAScript does, as RFC 8785 asks for: all numbers are
    doubles, so whole numbers beyond 2 ** 53 lose digits. Numbers beyond a double's range are refused (ValueError).
    """
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_string(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    try:
        return _number(float(value))
    except OverflowError as e:
        raise ValueError("a number out of range") from e


def _string(value: str) -> str:
    return json.dumps(value, ensure_ascii=False)


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("JSON has no such number")
    if x == 0:
        return "0"
    digits, exponent = f"{abs(x)!r}".lower(), 0
    if "e" in digits:
        digits, e = digits.split("e")
        exponent = int(e)
    whole, _, part = digits.partition(".")
    point = len(whole) + exponent
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = digits[0] + (f".{digits[1:]}" if n > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" + out if x < 0 else out


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def problems(value, schema, at: str = "$", root: dict | None = None) -> list[str]:
    """What a JSON Schema holds against a value, by path.

    Known: true and false, $ref within the schema, allOf, anyOf, oneOf, not; type, enum, const; required, properties,
    patternProperties, additionalProperties, minProperties, maxProperties; items, prefixItems, minItems, maxItems,
    uniqueItems; minLength, maxLength, pattern; minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf. Other
    keywords are annotations and hold nothing against a value. A $ref or pattern that can't be read is a problem.
    """
    if schema is True:
        return []
    if schema is False:
        return [f"{at}: not allowed"]
    root = schema if root is None else root
    out: list[str] = []
    inner = lambda s, v=value, a=at: problems(v, s, a, root)
    if "$ref" in schema:
        target = _target(schema["$ref"], root)
        out += [f"{at}: the schema's reference {schema['$ref']} leads nowhere"] if target is None else inner(target)
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return [*out, f"{at}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    if "enum" in schema and not any(canonical(value) == canonical(e) for e in schema["enum"]):
        out.append(f"{at}: not one of the listed values")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the one value")
    for s in schema.get("allOf", []):
        out += inner(s)
    if "anyOf" in schema and all(inner(s) for s in schema["anyOf"]):
        out.append(f"{at}: none of the alternatives")
    if "oneOf" in schema and (n := sum(not inner(s) for s in schema["oneOf"])) != 1:
        out.append(f"{at}: {n} of the alternatives")
    if "not" in schema and not inner(schema["not"]):
        out.append(f"{at}: what it must not be")
    if isinstance(value, dict):
        out += _of_object(value, schema, at, root)
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: {len(value)} items")
        if schema.get("uniqueItems") is True and len({canonical(v) for v in value}) < len(value):
            out.append(f"{at}: an item stands twice")
        first = schema.get("prefixItems", [])
        for i, v in enumerate(value):
            out += problems(v, first[i] if i < len(first) else schema.get("items", True), f"{at}[{i}]", root)
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: {len(value)} characters")
        if "pattern" in schema and not (m := _matches(schema["pattern"], value)):
            out.append(f"{at}: doesn't match" if m is False else f"{at}: the schema's pattern can't be read")
    elif _is(value, "number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value) or "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"] or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            out.append(f"{at}: out of range")
        if "multipleOf" in schema and Decimal(repr(value)) % Decimal(repr(schema["multipleOf"])):
            out.append(f"{at}: not a multiple")
    return out


def _of_object(value: dict, schema: dict, at: str, root: dict) -> list[str]:
    known, patterns, more = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
    out = [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
    if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
        out.append(f"{at}: {len(value)} properties")
    for k in sorted(value):
        own = [known[k]] if k in known else []
        own += [s for p, s in patterns.items() if _matches(p, k)]
        for s in own or [more]:
            out += problems(value[k], s, f"{at}.{k}", root)
    return out


def _matches(pattern: str, text: str) -> bool | None:
    """Whether the pattern is found in the text; null if it isn't one."""
    try:
        return re.search(pattern, text) is not None
    except re.error:
        return None


def _target(reference: str, root):
    """What a reference of the form #/a/b leads to; null if nothing."""
    if not reference.startswith("#"):
        return None
    out = root
    for part in [p.replace("~1", "/").replace("~0", "~") for p in reference[1:].split("/")[1:]]:
        out = out.get(part) if isinstance(out, dict) else None
    return out if isinstance(out, dict | bool) else None


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, str]:
    """Canonical arguments, null if they aren't JSON that can be written as UTF-8; and what is wrong with them, empty if
    nothing is."""
    try:
        # an object key given twice is an error, not the last one
        value = json.loads(arguments, object_pairs_hook=_pairs, parse_constant=_no_constant) if arguments is not None else None
        text = canonical(value) if arguments is not None else None
        (text or "").encode("utf-8")  # no half of a surrogate pair
    except (ValueError, RecursionError) as e:
        return None, f"$: {e.args[0] if isinstance(e, ValueError) and e.args and 'twice' in str(e.args[0]) else 'not JSON'}"
    if arguments is None:
        return None, "$: no arguments"
    if name not in schemas:
        return text, f"unknown tool {name}"
    try:
        return text, "; ".join(problems(value, schemas[name]))
    except RecursionError:
        return text, "$: the schema refers to itself without end"


def _pairs(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key stands twice")
    return out


def _no_constant(name):
    raise ValueError(name)


def _levelled(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, place, level) of the calls of short stretches, each stretch by one task; -1 in or behind a cycle."""
    import pyarrow as pa

    needs = edges.groupBy("conv", "place").agg(F.collect_list("needs").alias("needs"))
    rows = calls.join(needs, ["conv", "place"], "left").select(F.xxhash64("conv", "stretch").alias("key"), "conv", "place", "needs")

    def run(batches):
        for _, convs, places, needs in by_key(batches, 0):
            waits = {(c, p): {(c, n) for n in w or ()} for c, p, w in zip(convs, places, needs, strict=True)}
            after: dict = {}
            for call, own in waits.items():
                for n in own:
                    after.setdefault(n, []).append(call)
            left = {call: len(own) for call, own in waits.items()}
            level = {call: 0 for call, n in left.items() if not n}
            free = list(level)
            for call in free:  # grows as calls become free
                for other in after.get(call, ()):
                    left[other] -= 1
                    level[other] = max(level.get(other, 0), level[call] + 1)
                    if not left[other]:
                        free.append(other)
            done = [level[x] if not left[x] else -1 for x in waits]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in waits], conv_type), pa.array([p for _, p in waits], pa.int64()), pa.array(done, pa.int32())], names=["conv", "place", "level"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = calls.schema["conv"].dataType
    conv_type = to_arrow_type(kind)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"conv {kind.simpleString()}, place bigint, level int")


def order(calls: DataFrame) -> DataFrame:
    """``calls`` (conv, call, place, depends_on) with ``step`` (from 1 in each conversation) and ``in_cycle``.

    A dependency on a call that doesn't exist, on the call itself, or within a cycle orders nothing; calls in or behind a
    cycle of a stretch come last in it, by place, and are marked. Places are unique in a conversation.
    """
    edges = calls.select("conv", "place", F.explode("depends_on").alias("call")).join(calls.select("conv", "call", F.col("place").alias("needs")), ["conv", "call"]).where("needs <> place").select("conv", "place", "needs").distinct()
    edges = written(edges, "edges")
    reach = edges.where("needs > place").groupBy("conv", "place").agg(F.max("needs").alias("reach"))
    by_place = Window.partitionBy("conv").orderBy("place")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    ahead = calls.select("conv", "call", "place").join(reach, ["conv", "place"], "left")
    # a stretch begins where no earlier call reaches as far as here
    opened = ahead.withColumn("open", F.coalesce(F.max("reach").over(before) >= F.col("place"), F.lit(False)))
    start = F.last(F.when(~F.col("open"), F.col("place")), ignorenulls=True).over(by_place)
    placed = written(opened.withColumn("stretch", start).select("conv", "call", "place", "stretch"), "stretches")
    inside = edges.join(placed.select("conv", "place", "stretch"), ["conv", "place"])
    inside = inside.join(placed.select("conv", F.col("place").alias("needs"), F.col("stretch").alias("s2")), ["conv", "needs"]).where("stretch = s2").select("conv", "place", "needs")
    wide = reach.join(placed.select("conv", "place", "stretch"), ["conv", "place"]).select("conv", "stretch").distinct()
    waits = inside.groupBy("conv", "place").agg(F.count("*").alias("n"))
    todo = written(placed.join(wide, ["conv", "stretch"], "left_semi").join(waits, ["conv", "place"], "left").select("conv", "place", "stretch", F.coalesce("n", F.lit(0)).alias("n")), "todo")
    inside = written(inside.join(todo.select("conv", "place"), ["conv", "place"], "left_semi"), "inside")
    sizes = todo.groupBy("conv", "stretch").agg((F.count("*") + F.sum("n")).alias("size"))
    short = todo.join(sizes.where(F.col("size") <= LOCAL), ["conv", "stretch"], "left_semi").select("conv", "place", "stretch")
    levels = _levelled(short, inside)
    todo = written(todo.join(sizes.where(F.col("size") > LOCAL), ["conv", "stretch"], "left_semi").select("conv", "place"), "todo")
    level = 0
    while not todo.isEmpty():
        waits = inside.join(todo.select("conv", F.col("place").alias("needs")), ["conv", "needs"], "left_semi").select("conv", "place").distinct()
        ready = written(todo.join(waits, ["conv", "place"], "left_anti").withColumn("level", F.lit(level)), "ready")
        stuck = ready.isEmpty()
        levels = levels.unionByName(todo.withColumn("level", F.lit(-1)) if stuck else ready)
        if stuck:
            break
        last, todo = todo, written(todo.join(ready, ["conv", "place"], "left_anti").select("conv", "place"), "todo")
        drop_written(last)
        level += 1
    out = placed.join(levels, ["conv", "place"], "left")
    out = out.withColumn("in_cycle", F.coalesce(F.col("level") == -1, F.lit(False))).withColumn("level", F.when(F.col("level") == -1, 1 << 30).otherwise(F.coalesce("level", F.lit(0))))
    step = F.row_number().over(Window.partitionBy("conv").orderBy("stretch", "level", "place"))
    return out.select("conv", "call", "place", step.alias("step"), "in_cycle")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every call with its result, its order and its canonical JSON, and every result without a call.

    ``calls``: conv, call (identifier), place (order of appearance), name, arguments (JSON text), depends_on (array of
    identifiers, null: none). ``results``: conv, call, place, content. Other columns aren't read. ``schemas``: a JSON
    Schema for each tool's arguments.

    Returned: conv, call, step (null for an orphan result), status, problem, in_cycle, record. Status is ``linked``,
    ``no result``, ``invalid`` (linked or not, the arguments fail their schema: ``problem`` says why), ``repeated`` (an
    identifier that an earlier call of the conversation has; it takes no result), or ``no call`` (a result whose
    identifier no call has, or a later result of an identifier). Null conversations or identifiers are never equal: such
    calls have no result, such results no call. ``record`` is canonical JSON {"arguments", "id", "name", "result"};
    arguments that aren't JSON stand in it as a string.
    """
    import pyarrow as pa

    whole_key = F.col("conv").isNotNull() & F.col("call").isNotNull()
    # rows without a key are dealt out, for all of them would be one group
    by_call = Window.partitionBy("conv", "call", F.when(~whole_key, F.spark_partition_id())).orderBy("place")
    first = lambda df: df.withColumn("turn_of", F.when(whole_key, F.row_number().over(by_call))).withColumn("first", F.coalesce(F.col("turn_of") == 1, F.lit(False)))
    own = first(calls.select("conv", "call", "place", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")))
    got = first(results.select("conv", "call", "place", "content"))
    steps = order(own.where("first").select("conv", "call", "place", "depends_on"))
    answer = got.where("first").select(F.col("conv").alias("r_conv"), F.col("call").alias("r_call"), "content")
    joined = own.join(answer, own["first"] & (F.col("conv") == F.col("r_conv")) & (F.col("call") == F.col("r_call")), "left")
    joined = joined.join(steps.select(F.col("conv").alias("s_conv"), F.col("place").alias("s_place"), "step", "in_cycle"), own["first"] & (F.col("conv") == F.col("s_conv")) & (F.col("place") == F.col("s_place")), "left")
    known = own.where("first").select(F.col("conv").alias("k_conv"), F.col("call").alias("k_call"))
    with_call = got.join(known, F.col("first") & (F.col("conv") == F.col("k_conv")) & (F.col("call") == F.col("k_call")), "left_anti")
    kinds = {c: dict(calls.dtypes)[c] for c in ("conv", "call")}
    texts = joined.select("conv", "call", "step", F.col("in_cycle"), "name", "arguments", F.col("r_call").isNotNull().alias("has"), "content", (F.col("turn_of") > 1).alias("again"))

    def run(batches):
        for batch in batches:
            conv, call, step, cycle, name, arguments, has, content, again = batch.columns
            status, problem, record = [], [], []
            for i, n, a, h, c, r in zip(*[x.to_pylist() for x in (call, name, arguments, has, content, again)], strict=True):
                text, wrong = checked(n, a, schemas)
                status.append("repeated" if r else "invalid" if wrong else "linked" if h else "no result")
                problem.append(wrong or None)
                whole = text if text is not None else _string(a) if a is not None else "null"
                record.append(f'{{"arguments":{whole},"id":{canonical(i)},"name":{canonical(n)},"result":{canonical(c)}}}')
            yield pa.RecordBatch.from_arrays([conv, call, step, pa.array(status, pa.string()), pa.array(problem, pa.string()), cycle, pa.array(record, pa.string())], names=["conv", "call", "step", "status", "problem", "in_cycle", "record"])

    schema = f"conv {kinds['conv']}, call {kinds['call']}, step int, status string, problem string, in_cycle boolean, record string"
    linked = texts.mapInArrow(run, schema)
    orphan = with_call.select("conv", "call", F.lit(None).cast("int").alias("step"), F.lit("no call").alias("status"), F.lit(None).cast("string").alias("problem"), F.lit(None).cast("boolean").alias("in_cycle"), F.lit(None).cast("string").alias("record"))
    return linked.unionByName(orphan)


#: The tools of the conversations' calls: what a user says is a call of ``reply``, what the system says one of ``set_up``.
SCHEMAS = {
    "reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 40}, "turn": {"type": "integer", "minimum": 0}}},
    "set_up": {"type": "object", "required": ["prompt", "turn"], "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer", "minimum": 0, "maximum": 0}}},
}


def query(spark, sf_dir: str) -> DataFrame:
    """Every user's and system's turn is a call, which by the length of its text waits for the turn after the next, for the
    one before the last, or for both turns beside it, so that some wait for later ones, some for none that is a call, and
    some for each other; the assistant's turn right after a call is its result, and assistant's turns after none are
    results without a call."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    calls = turns.where("role in ('user', 'system')").select(
        F.col("conv_id").alias("conv"), name(F.col("turn")).alias("call"), F.col("turn").alias("place"),
        F.when(F.col("role") == "user", "reply").otherwise("set_up").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("prompt"))).alias("arguments"),
        F.when(F.length("text") % 3 == 0, F.array(name(F.col("turn") + 2))).when(F.length("text") % 3 == 1, F.array(name(F.col("turn") - 2))).otherwise(F.array(name(F.col("turn") - 1), name(F.col("turn") + 1))).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), name(F.col("turn") - 1).alias("call"), F.col("turn").alias("place"), F.col("text").alias("content"))
    out = link(calls, results, SCHEMAS)
    return out.select(F.col("conv").alias("conv_id"), F.col("call").alias("call_id"), "step", "status", "problem", "in_cycle", F.length("record").cast("bigint").alias("record_chars"), F.sha2("record", 256).alias("record_sha256"))


#: The same in DuckDB. JSON strings are escaped by to_json as canonical JSON has it for the characters that occur.
ORACLE = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, role, text, 'call_' || turn AS call_id FROM conversations WHERE role IN ('user', 'system')
), named AS (
  SELECT conv_id, turn, turn + unnest(CASE length(text) % 3 WHEN 0 THEN [2] WHEN 1 THEN [-2] ELSE [-1, 1] END) AS needs FROM calls
), edges AS (
  SELECT n.conv_id, n.turn, n.needs FROM named n JOIN calls c ON c.conv_id = n.conv_id AND c.turn = n.needs
), reach AS (
  SELECT conv_id, turn, max(needs) AS far FROM edges WHERE needs > turn GROUP BY 1, 2
), opened AS (
  SELECT c.conv_id, c.turn, r.far, coalesce(max(r.far) OVER (PARTITION BY c.conv_id ORDER BY c.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= c.turn, false) AS goes_on
  FROM calls c LEFT JOIN reach r ON r.conv_id = c.conv_id AND r.turn = c.turn
), placed AS (
  SELECT conv_id, turn, far, max(CASE WHEN goes_on THEN NULL ELSE turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS stretch FROM opened
), wide AS (
  SELECT DISTINCT conv_id, stretch FROM placed WHERE far IS NOT NULL
), inside AS (
  SELECT e.conv_id, e.turn, e.needs FROM edges e
  JOIN placed a ON a.conv_id = e.conv_id AND a.turn = e.turn JOIN placed b ON b.conv_id = e.conv_id AND b.turn = e.needs
  JOIN wide w ON w.conv_id = e.conv_id AND w.stretch = a.stretch WHERE a.stretch = b.stretch
), closure AS (
  SELECT conv_id, turn, needs FROM inside
  UNION
  SELECT c.conv_id, c.turn, i.needs FROM closure c JOIN inside i ON i.conv_id = c.conv_id AND i.turn = c.needs
), stuck AS (
  SELECT conv_id, turn FROM closure WHERE turn = needs
  UNION
  SELECT c.conv_id, c.turn FROM closure c JOIN closure d ON d.conv_id = c.conv_id AND d.turn = c.needs AND d.needs = d.turn
), depths AS (
  SELECT conv_id, turn, 0 AS depth FROM calls
  UNION
  SELECT i.conv_id, i.turn, d.depth + 1 FROM depths d JOIN inside i ON i.conv_id = d.conv_id AND i.needs = d.turn
  ANTI JOIN stuck s ON s.conv_id = i.conv_id AND s.turn = i.turn
), levels AS (
  SELECT conv_id, turn, max(depth) AS level FROM depths GROUP BY 1, 2
), steps AS (
  SELECT p.conv_id, p.turn, s.turn IS NOT NULL AS in_cycle,
         row_number() OVER (PARTITION BY p.conv_id ORDER BY p.stretch, s.turn IS NOT NULL, CASE WHEN s.turn IS NULL THEN l.level END, p.turn) AS step
  FROM placed p JOIN levels l ON l.conv_id = p.conv_id AND l.turn = p.turn LEFT JOIN stuck s ON s.conv_id = p.conv_id AND s.turn = p.turn
), results AS (
  SELECT conv_id, turn, text, 'call_' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'
), linked AS (
  SELECT c.conv_id, c.call_id, t.step, t.in_cycle, r.call_id IS NOT NULL AS has,
         CASE WHEN role = 'user' AND length(c.text) < 40 THEN '$.prompt: ' || length(c.text) || ' characters'
              WHEN role = 'system' AND c.turn > 0 THEN '$.turn: out of range' END AS problem,
         '{"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"'
           || CASE WHEN role = 'user' THEN 'reply' ELSE 'set_up' END || '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS record
  FROM calls c JOIN steps t ON t.conv_id = c.conv_id AND t.turn = c.turn LEFT JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
)
SELECT conv_id, call_id, CAST(step AS INTEGER) AS step,
       CASE WHEN problem IS NOT NULL THEN 'invalid' WHEN has THEN 'linked' ELSE 'no result' END AS status,
       problem, in_cycle, CAST(length(record) AS BIGINT) AS record_chars, sha256(record) AS record_sha256
FROM linked
UNION ALL
SELECT r.conv_id, r.call_id, NULL, 'no call', NULL, NULL, NULL, NULL
FROM results r ANTI JOIN calls c ON r.conv_id = c.conv_id AND r.call_id = c.call_id
"""
