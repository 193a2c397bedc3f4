"""Operators of stream jobs: DataFrame of records in, DataFrame of records out.

A record has source, key, value, event_time_ms, tags, ts_ms, seq. The order of records is (ts_ms, seq).
Nothing here depends on batch or stream but the aggregates, whose streaming form is in streaming/.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_variant, json_at, json_kind, number_text, template_key
from .conditions import condition, parse_condition
from .ordered import ordinals, running

NO_TAGS = "cast(array() as array<string>)"
FUNCTIONS = ("sum", "count", "avg", "min", "max")


def parsed(df: DataFrame, value: Column | None = None) -> DataFrame:
    """With the value's document as the column _doc, parsed once for all that read it.

    A plain column would be merged into every expression that reads it, and be parsed there again; what a
    generator puts out isn't, nor is a filter on it pushed below.
    """
    return df.select("*", F.explode_outer(F.array(as_variant(F.col("value") if value is None else value))).alias("_doc"))


def _carried(df: DataFrame) -> list[str]:
    """The source point of a ts source, which goes through the chain with its record."""
    return ["src"] if "src" in df.columns else []


def filter_records(df: DataFrame, text: str) -> DataFrame:
    found = parse_condition(text)
    if not found.reads_json:
        return df.where(condition(found))
    return parsed(df).where(condition(found, F.col("_doc"))).drop("_doc")


def map_records(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """A new JSON object in the mapping's order: `$.path` or a text constant; non-JSON goes."""
    if not mapping:
        return df
    df, doc = parsed(df), F.col("_doc")
    node = lambda v: F.coalesce(F.to_json(json_at(doc, v, "variant")), F.lit("null")) if v.startswith("$.") else F.to_json(F.to_variant_object(F.array(F.lit(v)))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(F.lit(v))))) - 2)
    parts: list[Column] = []
    for i, (name, v) in enumerate(mapping.items()):
        parts += [F.lit(("," if i else "{") + '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '":'), node(v)]
    return df.where(doc.isNotNull()).withColumn("value", F.concat(*parts, F.lit("}"))).withColumn("tags", F.expr(NO_TAGS)).drop("_doc")


def key_by(df: DataFrame, path: str) -> DataFrame:
    """The key becomes the string, whole number or boolean at the path; all else keeps the old key."""
    df, doc = parsed(df), F.col("_doc")
    kind = json_kind(doc, path)
    whole = F.schema_of_variant(json_at(doc, path, "variant")).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))")
    found = F.when(kind == "STRING", json_at(doc, path, "string")).when((kind == "NUMBER") & whole, json_at(doc, path, "long").cast("string")).when(kind == "BOOLEAN", json_at(doc, path, "boolean").cast("string"))
    return df.withColumn("key", F.coalesce(found, F.col("key"))).withColumn("tags", F.expr(NO_TAGS)).drop("_doc")


def flat_map(df: DataFrame, path: str, element_key: str | None = None) -> DataFrame:
    """One record for each element of the array at the path, as JSON text."""
    out = parsed(df).withColumn("e", F.explode(json_at(F.col("_doc"), path, "array<variant>"))).drop("_doc").withColumn("value", F.to_json("e"))
    if element_key:
        kind = json_kind(F.col("e"), element_key)
        number = number_text(json_at(F.col("e"), element_key, "double"))
        key = F.when(kind == "STRING", json_at(F.col("e"), element_key, "string")).when(kind == "NUMBER", number).when(kind == "BOOLEAN", json_at(F.col("e"), element_key, "boolean").cast("string"))
        out = out.withColumn("key", F.coalesce(key, F.col("key")))
    return out.drop("e").withColumn("tags", F.expr(NO_TAGS))


def classify(df: DataFrame, rules: list[tuple[str, str]], default: str | None = None) -> DataFrame:
    """Every rule that holds adds its tag; the default only where none holds."""
    df = parsed(df)
    tags = F.array(*[F.when(condition(c, F.col("_doc")), F.lit(t)) for c, t in rules]).cast("array<string>")
    # bound to a name, so that the rules are tested once though their tags are looked at twice
    other = F.array().cast("array<string>") if default is None else F.array(F.lit(default))
    found = F.element_at(F.transform(F.array(F.array_compact(tags)), lambda f: F.when(F.size(f) == 0, other).otherwise(f)), 1)
    return df.withColumn("tags", F.array_union("tags", found)).drop("_doc")


def aggregate_input(df: DataFrame, function: str, path: str | None) -> DataFrame:
    """Accepted records with the number they add."""
    if function not in FUNCTIONS:
        raise ValueError(f"unknown function: {function}")
    if function == "count":
        return df.withColumn("x", F.lit(1.0))
    df, doc = parsed(df), F.col("_doc")
    # integers beyond 64 bits are no numbers here
    node = F.schema_of_variant(json_at(doc, path, "variant"))
    fits = (json_kind(doc, path) == "NUMBER") & ~(node.rlike(r"^DECIMAL\(\d+,0\)") & json_at(doc, path, "long").isNull())
    return df.withColumn("x", F.when(fits, json_at(doc, path, "double"))).drop("_doc").where("x is not null")


def _figures(function: str) -> dict[str, tuple[str, str]]:
    """What a function's value so far is made of."""
    parts = {"n": ("count", "x")}
    return parts | ({"v": ("sum" if function == "avg" else function, "x")} if function != "count" else {})


def running_aggregate(df: DataFrame, function: str, path: str | None = None) -> DataFrame:
    """Every accepted record emits its key's value so far; a hot key's records spread over stretches of time."""
    src = _carried(df)
    x = aggregate_input(df, function, path).select("source", "key", "x", "event_time_ms", "ts_ms", "seq", *src)
    out = running(x, ["source", "key"], ["ts_ms", "seq"], _figures(function), span=df)
    value = {"count": lambda: F.col("n").cast("double"), "avg": lambda: F.col("v") / F.col("n")}.get(function, lambda: F.col("v"))()
    return out.select("source", "key", value.alias("value"), F.col("n").alias("count"), "event_time_ms", "ts_ms", "seq", *src)


def count_window_aggregate(df: DataFrame, function: str, size: int, path: str | None = None) -> DataFrame:
    """Tumbling windows of so many accepted records per key; what isn't full isn't emitted."""
    src = _carried(df)
    x = aggregate_input(df, function, path).select("source", "key", "x", "event_time_ms", "ts_ms", "seq", *src)
    placed = ordinals(x, ["source", "key"], ["ts_ms", "seq"], span=df).withColumn("w", F.expr(f"(ordinal - 1) div {size}L"))
    how = F.count("x").cast("double") if function == "count" else getattr(F, function)("x")
    out = placed.groupBy("source", "key", "w").agg(how.alias("value"), F.count("x").alias("count"), F.max_by("event_time_ms", F.struct("ts_ms", "seq")).alias("event_time_ms"), F.max(F.struct("ts_ms", "seq")).alias("at"), *[F.max_by(c, F.struct("ts_ms", "seq")).alias(c) for c in src])
    return out.where(F.col("count") == size).select("source", "key", "value", "count", "event_time_ms", "at.ts_ms", "at.seq", *src)


def aggregate_json(df: DataFrame) -> DataFrame:
    """Aggregates as records: {"key":k,"value":v,"count":n}."""
    text = F.concat(F.lit('{"key":'), F.to_json(F.struct("key")).substr(F.lit(8), F.length(F.to_json(F.struct("key"))) - 8), F.lit(',"value":'), F.coalesce(number_text(F.col("value")), F.lit("null")), F.lit(',"count":'), F.col("count").cast("string"), F.lit("}"))
    return df.select("source", "key", text.alias("value"), "event_time_ms", F.expr(NO_TAGS).alias("tags"), "ts_ms", "seq", *_carried(df))


def lookup_filter(df: DataFrame, template: str, kv: DataFrame) -> DataFrame:
    """Records whose templated key is live in kv (key, value); the planner broadcasts a small kv by its size."""
    keyed = parsed(df).withColumn("lookup", template_key(F.col("_doc"), template)).drop("_doc")
    return keyed.join(kv.select(F.col("key").alias("lookup")), "lookup", "left_semi").drop("lookup")


def lookup_enrich(df: DataFrame, template: str, kv: DataFrame, field: str = "_kv") -> DataFrame:
    """A hit appends the KV value to the JSON object: itself if object or array, else as a string.

    The object's own text is kept but for white space around it.
    """
    keyed = parsed(df).withColumn("lookup", template_key(F.col("_doc"), template))
    keyed = keyed.withColumn("_shape", F.schema_of_variant("_doc")).drop("_doc")
    found = kv.select(F.col("key").alias("lookup"), F.col("value").alias("kv_value"))
    out = parsed(keyed.join(found, "lookup", "left"), F.col("kv_value"))
    space = F.lit(" \t\n\r")
    text, whole = F.trim("value", space), F.trim("kv_value", space)
    quoted = F.to_json(F.struct(F.col("kv_value").alias("v")))
    body = F.when(F.schema_of_variant("_doc").rlike("^(OBJECT|ARRAY)"), whole).otherwise(quoted.substr(F.lit(6), F.length(quoted) - 6))
    comma = F.when(F.col("_shape") == "OBJECT<>", F.lit("")).otherwise(F.lit(","))
    hit = F.col("kv_value").isNotNull() & F.col("_shape").startswith("OBJECT")
    spliced = F.concat(text.substr(F.lit(1), F.length(text) - 1), comma, F.lit(json.dumps(field, ensure_ascii=False) + ":"), body, F.lit("}"))
    return out.withColumn("value", F.when(hit, spliced).otherwise(F.col("value"))).withColumn("tags", F.when(hit, F.expr(NO_TAGS)).otherwise(F.col("tags"))).drop("lookup", "kv_value", "_doc", "_shape")


def route(df: DataFrame, required: list[str]) -> DataFrame:
    """What a sink with these tags gets: records that have all of them; no tags: everything."""
    out = df
    for tag in required:
        out = out.where(F.array_contains("tags", tag))
    return out
