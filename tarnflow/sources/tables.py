"""Given tables as points, streams, key-value versions and queues."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "measurement string, field string, tags map<string,string>, tag_key string, ts_ns bigint, pos bigint, value double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def tag_key(tags: Column) -> Column:
    """Trimmed, sorted `k=v` pairs joined by commas; empty for no tags."""
    pairs = F.transform(F.map_entries(tags), lambda e: F.concat(F.trim(e["key"]), F.lit("="), F.trim(e["value"])))
    return F.array_join(F.array_sort(pairs), ",")


def _between(df: DataFrame, ts: str, low_ns: int | None, high_ns: int | None) -> DataFrame:
    """A range on the stored column, so that it reaches the scan."""
    at = lambda us: F.lit(datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)).cast("timestamp_ntz")
    if low_ns is not None:
        df = df.where(F.col(ts).cast("timestamp_ntz") >= at(-(-low_ns // 1000)))
    if high_ns is not None:
        df = df.where(F.col(ts).cast("timestamp_ntz") <= at(high_ns // 1000))
    return df


def event_points(spark: SparkSession, sf_dir: str, low_ns: int | None = None, high_ns: int | None = None) -> DataFrame:
    """events: measurement = event type, tag user, one field."""
    df = _between(table(spark, sf_dir, "events"), "ts", low_ns, high_ns)
    user = F.col("user_id").cast("string")
    return df.select(F.col("event_type").alias("measurement"), F.lit("value").alias("field"), F.create_map(F.lit("user"), user).alias("tags"), F.concat(F.lit("user="), user).alias("tag_key"), (micros("ts") * 1000).alias("ts_ns"), F.col("event_id").alias("pos"), "value")


def lineitem_points(spark: SparkSession, sf_dir: str, low_ns: int | None = None, high_ns: int | None = None) -> DataFrame:
    """lineitem: four fields, tags flag and status, many equal times."""
    df = _between(table(spark, sf_dir, "lineitem"), "l_shipdate", low_ns, high_ns)
    fields = F.expr("stack(4, 'quantity', l_quantity, 'extendedprice', l_extendedprice, 'discount', l_discount, 'tax', l_tax) AS (field, value)")
    df = df.select("l_returnflag", "l_linestatus", "l_shipdate", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), fields)
    key = F.concat(F.lit("flag="), "l_returnflag", F.lit(",status="), "l_linestatus")
    return df.select(F.lit("lineitem").alias("measurement"), "field", F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus").alias("tags"), key.alias("tag_key"), (micros("l_shipdate") * 1000).alias("ts_ns"), F.col("pos").cast("long").alias("pos"), "value")


def _record(df: DataFrame, source: str, value: Column, ms: Column, seq: str) -> DataFrame:
    return df.select(F.lit(source).alias("source"), F.lit("").alias("key"), value.alias("value"), ms.alias("event_time_ms"), F.array().cast("array<string>").alias("tags"), ms.alias("ts_ms"), F.col(seq).alias("seq"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct("event_id", F.concat(F.lit("u"), F.col("user_id")).alias("user"), F.col("event_type").alias("type"), F.col("value").alias("amount"), (F.col("value") > 50).alias("large")))
    return _record(table(spark, sf_dir, "events"), "events", body, F.floor(micros("ts") / 1000), "event_id")


def order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority")))
    return _record(table(spark, sf_dir, "orders"), "orders", body, F.floor(micros("o_orderdate") / 1000), "o_orderkey")


def nested_order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an array of their items."""
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_partkey").cast("string").alias("part"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    df = table(spark, sf_dir, "orders").join(items, "o_orderkey")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("order"), "items"))
    return _record(df, "orders", body, F.floor(micros("o_orderdate") / 1000), "o_orderkey")


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record(table(spark, sf_dir, "documents"), "documents", F.col("text"), F.col("doc_id"), "doc_id")


def customer_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys `customer:<id>` with a JSON document."""
    body = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), body.alias("value"))


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of `customer:<id>`: each order sets its total; F orders delete the key."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey")).alias("key"), (F.col("o_orderkey") + 1).alias("version"), F.col("o_totalprice").cast("string").alias("value"), (micros("o_orderdate") * 1000).alias("written_ns"), F.lit(None).cast("long").alias("expiry_ns"), (F.col("o_orderstatus") == "F").alias("tombstone"))


def order_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue message for each order."""
    status = F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "P", "leased").otherwise("dead")
    return table(spark, sf_dir, "orders").select(F.lit("orders").alias("queue"), F.col("o_orderkey").alias("seq"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), status.alias("status"), (micros("o_orderdate") * 1000).alias("due_ns"))
