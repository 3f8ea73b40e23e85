"""Chat payloads as JSON: their string leaves as rows, and payloads with leaves replaced.

A leaf is named by its path; tool-call arguments, JSON inside a string, are opened where they parse. Leaves go through
the same operators as any text, so that a payload is replaced and restored by joins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Request fields that are searched, by shape; a leaf below any of them counts. ``prompt`` belongs to plain completions.
REQUEST_FIELDS = ["system", "messages", "prompt"]
#: Keys that hold protocol words, no content.
FIXED_KEYS = {"role", "type", "id", "name", "model", "tool_use_id", "tool_call_id"}
ARGUMENTS = "arguments"


def _opened(value: str):
    """The object or list that a string of tool-call arguments holds, or None."""
    try:
        inner = json.loads(value)
    except ValueError:
        return None
    return inner if isinstance(inner, dict | list) else None


def walk(node, change: Callable[[str, str], str], path: str = "", fixed: bool = True):
    """The node with change(path, string) in place of each content string."""
    if isinstance(node, dict):
        return {k: v if fixed and k in FIXED_KEYS and isinstance(v, str) else walk(v, change, f"{path}/{k}", fixed) for k, v in node.items()}
    if isinstance(node, list):
        return [walk(v, change, f"{path}/{i}", fixed) for i, v in enumerate(node)]
    if isinstance(node, str):
        if path.rsplit("/", 1)[-1] == ARGUMENTS and (inner := _opened(node)) is not None:
            return json.dumps(walk(inner, change, f"{path}/$", False), ensure_ascii=False)
        return change(path, node) if node.strip() else node
    return node


def _request(body: dict, change: Callable[[str, str], str], whole: bool) -> dict:
    if whole:
        return walk(body, change)
    return {k: walk(v, change, f"/{k}") if k in REQUEST_FIELDS else v for k, v in body.items()}


def leaves(payloads: DataFrame, key: str, column: str = "payload", whole: bool = False) -> DataFrame:
    """(key, path, text) of the content strings of each payload: of the request fields, or of the whole payload.
    A payload that is no JSON object gives one leaf, itself, with an empty path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, raw in zip(batch.column("k").to_pylist(), batch.column("p").to_pylist(), strict=True):
                body = _opened(raw) if raw else None
                if isinstance(body, dict):
                    _request(body, lambda path, text, k=k: rows.append((k, path, text)) or text, whole)
                elif raw and raw.strip():
                    rows.append((k, "", raw))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("k").type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=[key, "path", "text"])

    kind = payloads.schema[key].dataType.simpleString()
    return payloads.select(F.col(key).alias("k"), F.col(column).alias("p")).mapInArrow(run, f"`{key}` {kind}, path string, text string")


def with_leaves(payloads: DataFrame, changed: DataFrame, key: str, column: str = "payload", whole: bool = False) -> DataFrame:
    """payloads with the leaves of ``changed`` (key, path, text) put in; others stay."""
    news = changed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("_new"))
    columns, kinds = payloads.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payloads.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, new in zip(batch.column(column).to_pylist(), batch.column("_new").to_pylist(), strict=True):
                new, body = dict(new or {}), _opened(raw) if raw else None
                if isinstance(body, dict):
                    out.append(json.dumps(_request(body, lambda path, text, new=new: new.get(path, text), whole), ensure_ascii=False) if new else raw)
                else:
                    out.append(new.get("", raw))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == column else batch.column(c) for c in columns], names=columns)

    return payloads.join(news, key, "left").mapInArrow(run, kinds)


def requests(conversations: DataFrame) -> DataFrame:
    """(conv_id, payload): each conversation as a chat request. Turns of the system are blocks of its ``system`` field; of
    the others every third content is a list of blocks, every fourth turn a tool call with its text in the arguments, and
    every fifth one a block that uses a tool with its text as input."""
    role, text = F.col("role"), F.col("text")
    listed = lambda block: F.to_json(F.struct(role, F.array(block).alias("content")))
    plain = F.struct(F.lit("text").alias("type"), text)
    use = F.struct(F.lit("tool_use").alias("type"), F.lit("c").alias("id"), F.lit("note").alias("name"), F.struct(text.alias("q")).alias("input"))
    function = F.struct(F.lit("note").alias("name"), F.to_json(F.struct(text)).alias("arguments"))
    call = F.to_json(F.struct(role, F.lit("").alias("content"), F.array(F.struct(F.lit("c").alias("id"), function.alias("function"))).alias("tool_calls")))
    message = F.when(role == "system", F.to_json(plain)).when(F.col("turn") % 4 == 3, call).when(F.col("turn") % 5 == 4, listed(use)).when(F.col("turn") % 3 == 2, listed(plain)).otherwise(F.to_json(F.struct(role, text.alias("content"))))
    turns = conversations.select("conv_id", F.struct("turn", message.alias("m"), role.eqNullSafe("system").alias("first")).alias("t"))
    listed_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    joined = lambda system: F.array_join(F.transform(F.filter("ts", lambda t: t["first"] == F.lit(system)), lambda t: t["m"]), ",")
    return listed_turns.select("conv_id", F.concat(F.lit('{"model":"m","system":['), joined(True), F.lit('],"messages":['), joined(False), F.lit("]}")).alias("payload"))


def parse_model_output(raw: DataFrame, key: str, column: str = "raw") -> DataFrame:
    """(key, value, entity_type) that a model's answer lists: a JSON list of objects, an object that holds one, a
    single object, or the first bracketed block of a text."""
    items = "array<struct<text:string,value:string,type:string,entity_type:string>>"
    text = F.trim(F.col(column))
    block = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    as_list = F.from_json(F.when(text.startswith("["), text).otherwise(block), items)
    single = F.from_json(F.concat(F.lit("["), text, F.lit("]")), items)
    found = F.when(text.startswith("{") & (block == ""), single).otherwise(as_list)
    one = raw.select(key, F.explode(found).alias("i"))
    value = F.trim(F.coalesce(F.when(F.col("i.text") != "", F.col("i.text")), F.col("i.value")))
    kind = F.coalesce(F.when(F.col("i.type") != "", F.col("i.type")), F.when(F.col("i.entity_type") != "", F.col("i.entity_type")), F.lit("OTHER"))
    return one.select(key, value.alias("value"), kind.alias("entity_type")).where("value <> ''")
