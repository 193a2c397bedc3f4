"""Named things that are created, altered and deleted: streams, namespaces and consumer groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_catalog(ops: DataFrame) -> DataFrame:
    """ops (scope, name, seq, op, settings map<string,string>) -> each with applied, exists and its settings then.

    op is create, alter or delete. A create of what exists and an alter or delete of what doesn't are refused; any other
    op is refused too. An alter overlays the settings that it names. A name's operations are ordered by seq; existence
    only depends on the last create or delete before, so windows by name are enough.
    """
    before = Window.partitionBy("scope", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("scope", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("op") == "create", True).when(F.col("op") == "delete", False)
    there = F.coalesce(F.last(turn, ignorenulls=True).over(before), F.lit(False))
    applied = F.when(F.col("op") == "create", ~F.col("there")).when(F.col("op").isin("alter", "delete"), F.col("there")).otherwise(F.lit(False))
    out = ops.withColumn("there", there).withColumn("applied", applied)
    out = out.withColumn("exists", F.coalesce(F.when(F.col("applied"), F.col("op") != "delete"), F.col("there")))
    born = F.max(F.when(F.col("applied") & (F.col("op") == "create"), F.col("seq"))).over(upto)
    out = out.withColumn("born", born)
    given = F.when(F.col("applied") & F.col("op").isin("create", "alter"), F.struct(F.col("seq"), F.col("settings")))
    held = F.filter(F.collect_list(given).over(upto), lambda x: x["seq"] >= F.col("born"))
    merged = F.aggregate(held, F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: ~F.coalesce(F.map_contains_key(x["settings"], k), F.lit(False))), F.coalesce(x["settings"], F.create_map().cast("map<string,string>"))))
    return out.select("scope", "name", "seq", "op", "applied", "exists", F.when(F.col("exists"), merged).alias("settings"))


def current_catalog(ops: DataFrame) -> DataFrame:
    """What exists after all operations: scope, name, settings."""
    at: Column = F.struct("exists", "settings")
    last = fold_catalog(ops).groupBy("scope", "name").agg(F.max_by(at, "seq").alias("s"))
    return last.where("s.exists").select("scope", "name", "s.settings")
