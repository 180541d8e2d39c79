"""Tool-call linking: calls and results by identifier, in topological order, as canonical JSON.

* Calls and results are joined on the call id (a hash join that Spark may split).
* A call waits for the calls it depends on. Calls without open dependencies have depth 0,
  others one more than the deepest call they wait for. What never becomes free
  lies on a cycle or behind one, and has a null depth. (depth, call_id) is a
  topological order.
* Arguments are checked against the tool's schema: type, required, enum, minimum,
  maximum, maxLength, additionalProperties.
* The record is written as canonical JSON: sorted keys, no spaces, whole numbers without
  a fraction, no escapes beyond those JSON needs.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm.common import materialize
from roadspark.llm.mixing import word_count
from roadspark.operators.graph import weak_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TEXT = {"type": "string", "maxLength": 240}
#: Tools of the query below.
SCHEMAS = {
    "search": {"type": "object", "required": ["limit", "query"], "additionalProperties": False, "properties": {"query": _TEXT, "limit": {"type": "integer", "minimum": 1, "maximum": 40}}},
    "summarise": {"type": "object", "required": ["query"], "properties": {"query": _TEXT, "limit": {"type": "integer", "minimum": 10}}},
    "translate": {"type": "object", "required": ["query", "to"], "properties": {"query": _TEXT, "to": {"enum": ["de", "en", "fr"]}, "limit": {"type": "integer"}}},
}

#: Links of a group of calls that one task layers.
MOST_LINKS = 100_000

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _plain(value):
    """Whole floats as integers, all the way down."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return value


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def read(text: str | None, empty) -> tuple[object, bool]:
    """(value, broken): ``empty`` for null; text that is not JSON, holds numbers beyond doubles or half a character (a lone
    surrogate escape), or nests too deep stays a string."""
    if text is None:
        return empty, False
    try:
        value = _plain(json.loads(text, parse_float=_finite, parse_constant=_no_constant))
        if "\\u" in text:
            canonical(value).encode()
        return value, False
    except (ValueError, RecursionError):
        return text, True


def canonical(value) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def violations(value, schema: dict | None, at: str = "$") -> list[str]:
    """What breaks the schema, as 'path: rule', in path order."""
    if schema is None:
        return [f"{at}: unknown tool"]
    out, kind = [], schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer" and not (number and (isinstance(value, int) or value.is_integer())) or kind == "number" and not number or kind in _TYPES and not isinstance(value, _TYPES[kind]):
        return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: enum")
    if number and value < schema.get("minimum", value):
        out.append(f"{at}: minimum")
    if number and value > schema.get("maximum", value):
        out.append(f"{at}: maximum")
    if isinstance(value, str) and len(value) > schema.get("maxLength", len(value)):
        out.append(f"{at}: maxLength")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: additional")
    return out


def _peel(calls: DataFrame, links: DataFrame) -> DataFrame:
    """(call_id, depth) layer by layer: calls without open dependencies go, and their outgoing links with them."""
    left, open_, done, depth = calls, links, None, 0
    while True:
        free = materialize(left.join(open_.select(F.col("child").alias("call_id")).distinct(), "call_id", "left_anti"), "free-calls")
        if free.isEmpty():
            break
        layer = free.withColumn("depth", F.lit(depth).cast("long"))
        done = layer if done is None else done.union(layer)
        left = materialize(left.join(free, "call_id", "left_anti"), "calls")
        open_ = materialize(open_.join(free.withColumnRenamed("call_id", "parent"), "parent", "left_anti"), "call-links")
        depth += 1
    rest = left.withColumn("depth", F.lit(None).cast("long"))
    return rest if done is None else done.union(rest)


def depths(parents: list[str], children: list[str]) -> dict[str, int]:
    """Depth of every call that is not on a cycle or behind one."""
    waits, after = Counter(children), {}
    for p, k in zip(parents, children):
        after.setdefault(p, []).append(k)
    depth = dict.fromkeys((p for p in parents if p not in waits), 0)
    ready = list(depth)
    for p in ready:
        for k in after.get(p, ()):
            depth[k] = max(depth.get(k, 0), depth[p] + 1)
            waits[k] -= 1
            if not waits[k]:
                ready.append(k)
    return {k: depth[k] for k in ready}


def topological_depth(calls: DataFrame, links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(call_id, depth) from calls (call_id) and links (parent, child) between them; null depth on cycles.

    Calls that hang together are a group. Groups of up to ``most`` links are layered inside
    tasks, about as many links to a task; larger ones are peeled layer by layer as tables.
    """
    links = materialize(links.select("parent", "child").distinct(), "call-links")
    every = calls.select("call_id").distinct()
    # a call that depends on itself alone has no other link, and waits for ever
    group = weak_components(links.select(F.col("parent").alias("s"), F.col("child").alias("t"))).withColumnRenamed("node", "child")
    named = links.join(group, "child", "left").select("parent", "child", F.coalesce("component", "child").alias("component"))
    size = named.groupBy("component").agg((F.count("*") > most).alias("large"))
    named = materialize(named.join(size, "component"), "call-groups")

    def run(key, frame):
        known = depths(frame["parent"].tolist(), frame["child"].tolist())
        ids = pd.unique(pd.concat([frame["parent"], frame["child"]]))
        return pd.DataFrame({"call_id": ids, "depth": pd.array([known.get(i) for i in ids], "Int64")})

    # many groups to a task: what hangs together shares a bucket
    buckets = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-named.count() // most))
    small = named.filter("NOT large").groupBy(F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket")).applyInPandas(run, "call_id string, depth long")
    large = named.filter("large").select("parent", "child")
    peeled = materialize(small, "call-depths")
    if not large.isEmpty():
        ends = large.select(F.col("parent").alias("call_id")).union(large.select("child")).distinct()
        peeled = peeled.union(_peel(ends, large))
    return every.join(peeled.withColumn("linked", F.lit(True)), "call_id", "left").select("call_id", F.when(F.col("linked"), F.col("depth")).otherwise(F.lit(0).cast("long")).alias("depth"))


LINKED = "conv_id long, call_id string, name string, depth long, n_dangling long, has_result boolean, valid boolean, errors string, record string"


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row a call: its result, depth, errors and canonical record.

    ``calls``: conv_id, call_id, name, arguments (JSON text), depends_on (array of call ids).
    ``results``: call_id, payload (JSON text). Calls without an id are left as they are: no
    result, depth 0. Of repeated calls with one id the least row counts, and of several
    results for a call the least payload. Dependencies on unknown ids are counted and
    ignored. Arguments or payloads that are not JSON (or hold numbers beyond doubles, or nest
    too deep to read) are kept as strings, and the former are an error ('$: json'). Null
    arguments count as {}. Empty tables give an empty result.
    """
    known = calls.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min(F.struct("conv_id", "name", "arguments", "depends_on")).alias("c"))
    known = materialize(known.select("c.conv_id", "call_id", "c.name", "c.arguments", "c.depends_on"), "known-calls")
    wished = known.select(F.col("call_id").alias("child"), F.explode("depends_on").alias("parent")).filter(F.col("parent").isNotNull()).distinct()
    links = wished.join(known.select(F.col("call_id").alias("parent"), F.lit(1).alias("there")), "parent", "left")
    depth = topological_depth(known, links.filter("there = 1"))
    per_call = links.groupBy(F.col("child").alias("call_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("there") == 1, F.col("parent")))).alias("parents"), F.count_if(F.col("there").isNull()).alias("n_dangling")
    )
    answers = results.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min("payload").alias("payload"))
    joined = known.join(depth, "call_id").join(per_call, "call_id", "left").join(answers, "call_id", "left")
    without = calls.filter(F.col("call_id").isNull()).select("conv_id", "call_id", "name", "arguments", F.lit(0).cast("long").alias("depth"))
    rows = joined.select("conv_id", "call_id", "name", "arguments", "depth", "parents", "n_dangling", "payload").unionByName(without, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                arguments, broken = read(r["arguments"], {})
                result, _ = read(r["payload"], None)
                errors = ["$: json"] if broken else violations(arguments, schemas.get(r["name"]))
                record = {"arguments": arguments, "call_id": r["call_id"], "depends_on": r["parents"] or [], "name": r["name"], "result": result}
                out.append((r["conv_id"], r["call_id"], r["name"], r["depth"], r["n_dangling"] or 0, r["payload"] is not None, not errors, "; ".join(errors), canonical(record)))
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in LINKED.split(", ")])

    return rows.mapInArrow(run, LINKED)


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads plain conversations as tool use: a user turn calls, the assistant's next turn answers.

    The tool depends on the turn's number of words; turn t depends on turn t div 2, which
    may or may not be a call; the arguments are loosely written JSON. Turns of a null
    conversation, and null turns, have no id.
    """
    def named(turn):
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))

    words = word_count(F.col("text"))
    tool = F.element_at(F.array(*[F.lit(k) for k in sorted(SCHEMAS)]), (words % 3 + 1).cast("int"))
    extra = F.when(tool == "translate", F.concat(F.lit(', "to" : "'), F.element_at(F.array(*[F.lit(k) for k in ("de", "en", "es", "fr")]), (words % 4 + 1).cast("int")), F.lit('"'))).otherwise("")
    quoted = F.get_json_object(F.to_json(F.struct(F.array(F.coalesce("text", F.lit(""))).alias("a"))), "$.a")
    query = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    arguments = F.concat(F.lit('{ "query": '), query, extra, F.lit(', "limit": '), words.cast("string"), F.lit(".0 }"))
    turn = F.col("turn")
    calls = turns.filter("role = 'user'").select(
        "conv_id", named(turn).alias("call_id"), tool.alias("name"), arguments.alias("arguments"),
        F.when(turn > 1, F.array(named(F.floor(turn / 2)))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = turns.filter("role = 'assistant'").select(named(turn - 1).alias("call_id"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("payload"))
    return calls, results


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return link_tool_calls(*calls_of_conversations(turns), SCHEMAS)


OP2_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM conversations),
c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, ['search', 'summarise', 'translate'][n % 3 + 1] AS name, n, text,
             ['de', 'en', 'es', 'fr'][n % 4 + 1] AS lang, CASE WHEN turn > 1 THEN turn // 2 END AS parent FROM t WHERE role = 'user'),
p AS (SELECT c.*, x.turn AS known FROM c LEFT JOIN c x ON x.conv_id = c.conv_id AND x.turn = c.parent),
d AS (SELECT conv_id, turn, 0::BIGINT AS depth FROM p WHERE known IS NULL
      UNION ALL SELECT p.conv_id, p.turn, d.depth + 1 FROM d JOIN p ON p.conv_id = d.conv_id AND p.known = d.turn),
r AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM t WHERE role = 'assistant'),
v AS (SELECT p.*, d.depth, r.answer, concat_ws('; ',
        CASE WHEN name = 'search' AND n < 1 THEN '$.limit: minimum' WHEN name = 'search' AND n > 40 THEN '$.limit: maximum' WHEN name = 'summarise' AND n < 10 THEN '$.limit: minimum' END,
        CASE WHEN length(text) > 240 THEN '$.query: maxLength' END,
        CASE WHEN name = 'translate' AND lang = 'es' THEN '$.to: enum' END) AS errors
      FROM p JOIN d USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn))
SELECT conv_id, call_id, name, depth, (parent IS NOT NULL AND known IS NULL)::BIGINT AS n_dangling, answer IS NOT NULL AS has_result, errors = '' AS valid, errors,
       '{"arguments":{"limit":' || n || ',"query":' || to_json(text)::VARCHAR || CASE WHEN name = 'translate' THEN ',"to":"' || lang || '"' ELSE '' END
       || '},"call_id":"' || call_id || '","depends_on":[' || CASE WHEN known IS NOT NULL THEN '"' || conv_id || ':' || known || '"' ELSE '' END
       || '],"name":"' || name || '","result":' || CASE WHEN answer IS NULL THEN 'null' ELSE '{"text":' || to_json(answer)::VARCHAR || '}' END || '}' AS record
FROM v
"""
