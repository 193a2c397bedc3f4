"""Line protocol text -> points and errors, in SQL functions.

`measurement[,tag=value...] field=value[,field=value...] [time]`; numbers may end in i or u, true and false
are 1 and 0, strings are refused. Blank lines and # lines are skipped; a bad line is reported whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import tag_key

_SCALE = {"ns": 1, "us": 1000, "ms": 1_000_000, "s": 1_000_000_000}
_NAME = r"[^,=\s\"\\]+"
_LINE = rf"^({_NAME})((?:,{_NAME}={_NAME})*) +({_NAME}=[^,\s]+(?:,{_NAME}=[^,\s]+)*)(?: +(\d+))?$"
_NUMBER = r"^(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?\d+i|\d+u|true|false|t|f|T|F|True|False|TRUE|FALSE)$"


def parse_lines(lines: DataFrame, precision: str = "ms", now_ns: int | None = None) -> tuple[DataFrame, DataFrame]:
    """lines (line_no, text) -> (points, errors(line_no, message)).

    A line is matched once: the pattern's groups come out of one replacement, joined by a character that no line
    that matches can hold twice (a line break), and every name and number is taken from there.
    """
    scale = _SCALE[precision]
    rows = lines.select("line_no", F.trim("text").alias("text")).where("text <> '' and not startswith(text, '#')")
    # a line of several rows matches nothing, so four parts are the pattern's own
    parts = F.when(~F.contains("text", F.lit("\n")), F.split(F.regexp_replace("text", _LINE, "$1\n$2\n$3\n$4"), "\n", -1))
    cut = rows.select("line_no", F.explode_outer(F.array(parts)).alias("p")).withColumn("ok", F.size("p") == 4)
    part = lambda k: F.when(F.col("ok"), F.get("p", F.lit(k)))
    pairs = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.split_part(x, F.lit("="), F.lit(2)).alias("v")))
    # each field with its number, or null where it is none; big: an integer beyond 2^53
    number = lambda p: F.struct(p["k"].alias("k"), F.when(p["v"].rlike(_NUMBER), _number(p["v"])).alias("v"), F.coalesce(p["v"].rlike(r"^[+-]?\d+[iu]$") & (F.abs(F.regexp_replace(p["v"], "[+iu]", "").try_cast("decimal(38,0)")) > 2**53), F.lit(False)).alias("big"), p["v"].rlike(_NUMBER).alias("fine"))
    given = F.struct(part(0).alias("measurement"), pairs(part(1)).alias("tags"), F.transform(pairs(part(2)), number).alias("fields"), part(3).alias("at"))
    read = cut.select("line_no", "ok", F.explode_outer(F.array(given)).alias("g")).select("line_no", "ok", "g.*")
    stamp = F.when(F.col("at") == "", F.lit(now_ns).cast("long")).otherwise(F.try_multiply(F.col("at").try_cast("long"), F.lit(scale)))
    names = lambda c: F.transform(c, lambda p: p["k"])
    twice = lambda c: F.size(F.array_distinct(names(c))) < F.size(names(c))
    message = F.when(~F.col("ok"), "malformed line").when(twice("tags"), "duplicate tag").when(twice("fields"), "duplicate field").when(F.exists("fields", lambda p: ~p["fine"]), "field is not a number").when(F.exists("fields", lambda p: p["big"]), "integer beyond 2^53").when(stamp.isNull() | (stamp <= 0), "time is out of range")
    judged = read.withColumn("ts_ns", stamp).withColumn("message", message)
    errors = judged.where("message is not null").select("line_no", "message")
    good = judged.where("message is null").withColumn("tag_map", F.map_from_entries("tags"))
    points = good.select("line_no", "measurement", "tag_map", tag_key(F.col("tag_map")).alias("tag_key"), "ts_ns", F.explode("fields").alias("f"))
    return points.select("measurement", F.col("f.k").alias("field"), F.col("tag_map").alias("tags"), "tag_key", "ts_ns", F.col("line_no").cast("long").alias("pos"), F.col("f.v").alias("value")), errors


def _number(text: Column) -> Column:
    raw = F.regexp_replace(text, "[iu]$", "").try_cast("double")
    return F.when(F.lower(text).isin("t", "true"), 1.0).when(F.lower(text).isin("f", "false"), 0.0).otherwise(raw)
