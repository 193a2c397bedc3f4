"""Points of a ts source in time order: what comes too late is told apart, what may still be overtaken is held back.

A point is late when it is more than the source's lateness behind the newest point that came before it, by arrival
(the long column pos; points that share one came in time order, see ARRIVAL). That depends on the order of arrival
alone, not on how a stream is cut into batches, so a batch and a stream of the same points agree, unless a batch ends
between points of one position. A stream holds each point until the newest is its lateness ahead, or
until its field has had no write for that long.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import running
from ..operators.points import ARRIVAL

_MS = 1_000_000


def mark_late(points: DataFrame, lateness_ms: int) -> DataFrame:
    """A finished table of points with the boolean column late. Without lateness all points that go back are late."""
    seen = running(points, ["measurement", "field"], ARRIVAL, {"_newest": ("max", "ts_ns")}, before=True)
    return seen.withColumn("late", F.coalesce(F.col("_newest") - F.col("ts_ns") > lateness_ms * _MS, F.lit(False))).drop("_newest")


def ready_points(points: DataFrame, lateness_ms: int) -> DataFrame:
    """Of a finished table, the points that a stream would have read without its idle release: neither late nor held."""
    newest = points.groupBy("measurement", "field").agg(F.max("ts_ns").alias("_newest"))
    marked = mark_late(points, lateness_ms).where("not late").drop("late")
    other = newest.select(F.col("measurement").alias("_m"), F.col("field").alias("_f"), "_newest")
    same = F.col("measurement").eqNullSafe(F.col("_m")) & F.col("field").eqNullSafe(F.col("_f"))
    return marked.join(other, same).where(F.col("ts_ns") <= F.col("_newest") - lateness_ms * _MS).select(*points.columns)


def _packed(pdf: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def hold_back(points: DataFrame, lateness_ms: int, idle: bool = True) -> DataFrame:
    """A stream of points in time order within each field, each with late; late ones come at once. With idle, a field
    without a write for its lateness lets go of what it holds; a stream that ends by itself must do without, as its
    clock would keep it running, and what it holds waits in its checkpoint.

    The state of a field is its newest time and what it holds, which the lateness bounds. Its points share a task,
    as they share one newest point; fields are spread.
    """
    names = points.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    edge = lateness_ms * _MS
    tags = "tags" in names

    def of(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, held = (state.get[0], _unpacked(state.get[1])) if state.exists else (None, None)
        if idle and state.hasTimedOut:  # no write for the lateness: all that is held is free
            state.update((newest, _packed(held.iloc[:0])))
            if len(held):
                yield _shaped(held.assign(late=False))
            return
        new = pd.concat(list(pdfs)).sort_values(ARRIVAL, kind="stable")
        if tags:
            new["tags"] = [sorted(t.items()) if isinstance(t, dict) else [] for t in new["tags"]]
        before = new["ts_ns"].cummax().shift(1)
        if newest is not None:
            before = before.fillna(newest).clip(lower=newest)
        late = (before - new["ts_ns"] > edge).to_numpy()
        newest = int(new["ts_ns"].max()) if newest is None else max(newest, int(new["ts_ns"].max()))
        kept = new[~late] if held is None or not len(held) else pd.concat([held, new[~late]])
        kept = kept.sort_values(["ts_ns", "pos"], kind="stable")
        free = (kept["ts_ns"] <= newest - edge).to_numpy()
        state.update((newest, _packed(kept[~free])))
        if idle:
            state.setTimeoutDuration(max(1, lateness_ms))
        out = pd.concat([kept[free].assign(late=False), new[late].assign(late=True)])
        if len(out):
            yield _shaped(out)

    def _shaped(pdf: pd.DataFrame) -> pd.DataFrame:
        if tags:
            pdf = pdf.assign(tags=[{k: v for k, v in t} for t in pdf["tags"]])
        return pdf[[*names, "late"]]

    return points.groupBy("measurement", "field").applyInPandasWithState(of, schema + ", late boolean", "newest long, held binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
