"""Typed operations on points: bucket queries, pages, listings, retention, late points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running

#: Edges of the late-point histogram in milliseconds (fixed values).
LATE_EDGES_MS = (0, 1000, 5000, 15_000, 30_000, 60_000, 300_000, 3_600_000)
#: The order in which points came. Points of one position came in time order, so that what is late depends on the points
#: alone, not on where a shuffle puts them; points that share both are late together or not at all.
ARRIVAL = ["pos", "ts_ns"]
_AGG = {"avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def has_tags(filters: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in filters.items():
        out = out & F.coalesce(F.element_at("tags", F.lit(k)) == v, F.lit(False))
    return out


def exact_tags(tags: dict[str, str]) -> Column:
    """Exactly these tags and no others."""
    return has_tags(tags) & (F.size("tags") == len(tags))


def bucket_query(points: DataFrame, measurement: str, field: str = "value", tags: dict[str, str] | None = None, agg: str = "avg", window_ns: int = 60_000_000_000, low_ns: int = 0, high_ns: int = 0) -> DataFrame:
    """Buckets aligned to the epoch over all matching series; 0 leaves a bound open."""
    if agg not in _AGG:
        raise ValueError(f"unknown aggregation: {agg}")
    if window_ns <= 0:
        raise ValueError("window must be positive")
    df = points.where((F.col("measurement") == measurement) & (F.col("field") == field) & has_tags(tags or {}))
    if low_ns:
        df = df.where(F.col("ts_ns") >= low_ns)
    if high_ns:
        df = df.where(F.col("ts_ns") <= high_ns)
    start = F.col("ts_ns") - F.col("ts_ns") % F.lit(window_ns)
    return df.groupBy("measurement", start.alias("start_ns")).agg(_AGG[agg]("value").cast("double").alias("value"))


def read_page(points: DataFrame, measurement: str, field: str = "value", tags: dict[str, str] | None = None, low_ns: int | None = None, high_ns: int | None = None, limit: int = 100, descending: bool = False, after: tuple[int, int] | None = None) -> DataFrame:
    """A page of points by (time, position), behind an exclusive cursor; limit is the page's size."""
    if not 1 <= limit <= 4096:
        raise ValueError("limit must be 1 to 4096")
    df = points.where((F.col("measurement") == measurement) & (F.col("field") == field) & has_tags(tags or {}))
    if low_ns is not None:
        df = df.where(F.col("ts_ns") >= low_ns)
    if high_ns is not None:
        df = df.where(F.col("ts_ns") <= high_ns)
    if after is not None:
        t, p = F.col("ts_ns"), F.col("pos")
        df = df.where((t < after[0]) | ((t == after[0]) & (p < after[1])) if descending else (t > after[0]) | ((t == after[0]) & (p > after[1])))
    order = [F.desc("ts_ns"), F.desc("pos")] if descending else ["ts_ns", "pos"]
    return df.orderBy(*order).limit(limit).select("ts_ns", "pos", "value")


def next_cursor(page: DataFrame, limit: int, at: tuple[str, str] = ("ts_ns", "pos"), descending: bool = False) -> tuple[int, int] | None:
    """Where the page after this one begins (exclusive), of a page of points or, with at, of records; None once a
    page isn't full. The driver sees one row."""
    place = F.struct(*at)
    row = page.agg(F.count(F.lit(1)).alias("n"), (F.min if descending else F.max)(place).alias("p")).first()
    return tuple(row["p"]) if row["n"] >= limit else None


def page_status(points: DataFrame, measurement: str, field: str = "value") -> DataFrame:
    """One row: found is false where the measurement has no such field at all, which an empty page doesn't tell."""
    here = points.where((F.col("measurement") == measurement) & (F.col("field") == field)).limit(1)
    return here.agg((F.count(F.lit(1)) > 0).alias("found"))


def dashboard_page(points: DataFrame, measurement: str, window: str | None = None, aggregation: str | None = None, **page) -> DataFrame:
    """A page as a dashboard asks for it: window and aggregation are given back beside the points and not applied."""
    out = read_page(points, measurement, **page)
    return out.select(F.lit(measurement).alias("measurement"), F.lit(window).cast("string").alias("window"), F.lit(aggregation).cast("string").alias("aggregation"), "ts_ns", "pos", "value")


def names_page(df: DataFrame, column: str, after: str | None = None, prefix: str = "", limit: int = 100) -> DataFrame:
    """A page of a column's distinct names in order, behind an exclusive name; limit is the page's size."""
    names = df.select(F.col(column).alias("name")).where(F.col("name").startswith(prefix))
    if after is not None:
        names = names.where(F.col("name") > after)
    return names.distinct().orderBy("name").limit(limit)


def guarded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, or an error once it is run where it has more rows than allowed; it is counted first, by one subquery."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.withColumn("_n", n).where(F.when(F.col("_n") > most, F.raise_error(F.concat(F.lit(f"{what}: more than {most} points, "), F.col("_n").cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def list_measurements(points: DataFrame) -> DataFrame:
    return points.groupBy("measurement").agg(F.countDistinct("tag_key").alias("series"), F.countDistinct("field").alias("fields"), F.count(F.lit(1)).alias("points"))


def measurement_info(points: DataFrame, measurement: str) -> DataFrame:
    df = points.where(F.col("measurement") == measurement)
    return df.agg(F.countDistinct("tag_key").alias("series"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"), F.count(F.lit(1)).alias("points"), F.min("ts_ns").alias("oldest_ns"), F.max("ts_ns").alias("newest_ns"))


def summary(points: DataFrame, measurement: str, field: str = "value") -> DataFrame:
    """Whole-range figures; null where there is nothing."""
    df = points.where((F.col("measurement") == measurement) & (F.col("field") == field))
    return df.agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count("value").alias("count"))


def retain(points: DataFrame, now_ns: int, keep_ns: int) -> DataFrame:
    """What is strictly older than now - keep goes."""
    return points.where(F.col("ts_ns") >= now_ns - keep_ns)


def delete_series(points: DataFrame, measurement: str, tags: dict[str, str] | None = None) -> DataFrame:
    """Without the measurement's series whose tags hold the filter."""
    return points.where(~((F.col("measurement") == measurement) & has_tags(tags or {})))


def late_histogram(points: DataFrame) -> DataFrame:
    """Per measurement and field, points later than each edge behind the newest seen before, by ARRIVAL."""
    seen = running(points.select("measurement", "field", "ts_ns", "pos"), ["measurement", "field"], ARRIVAL, {"newest": ("max", "ts_ns")}, before=True)
    behind = F.col("newest") - F.col("ts_ns")
    return seen.groupBy("measurement", "field").agg(*[F.count_if(behind > e * 1_000_000).alias(f"late_{e}") for e in LATE_EDGES_MS])


def append(points: DataFrame, more: DataFrame) -> DataFrame:
    """Two writes at one time are two points; what isn't finite is refused by dropping it."""
    return points.unionByName(more.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))))
