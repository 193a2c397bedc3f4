"""User functions as steps of a chain: a function of a pandas frame of records, by name, with tags and state.

A function gets records as a frame with key, value, event_time_ms, tags, ts_ms and seq, and returns such a frame: fewer
or more records, other values, keys or tags. A stateful one is called with a key's records in order and a dict that
it may change, which a stream keeps between batches; in a batch every key starts with an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD = "source string, key string, value string, event_time_ms long, tags array<string>, ts_ms long, seq long"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_functions: dict[str, UserFunction] = {}


@dataclass(frozen=True)
class UserFunction:
    """run(frame) or, with state, run(frame, state)."""

    name: str
    run: Callable
    stateful: bool = False


def register(name: str, stateful: bool = False) -> Callable:
    """Registers a function under a name, for steps of kind `function`."""

    def keep(run: Callable) -> Callable:
        if name in _functions:
            raise ValueError(f"function {name!r} is registered already")
        _functions[name] = UserFunction(name, run, stateful)
        return run

    return keep


def unregister(name: str) -> None:
    _functions.pop(name, None)


def _shaped(pdf: pd.DataFrame) -> pd.DataFrame:
    missing = set(_NAMES) - set(pdf.columns)
    if missing:
        raise ValueError(f"a user function must return the columns {', '.join(sorted(missing))}")
    return pdf[_NAMES].astype({"tags": object, "value": object, "key": object})  # whatever an empty frame was left with


def apply_function(df: DataFrame, name: str) -> DataFrame:
    """Records through a registered function: in Arrow batches, or by source and key in order if it keeps state."""
    if name not in _functions:
        raise ValueError(f"no function {name!r}")
    run, rows = _functions[name].run, df.select(*_NAMES)

    def plain(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield _shaped(run(pdf))

    def keyed(pdf: pd.DataFrame) -> pd.DataFrame:
        return _shaped(run(pdf.sort_values(["ts_ms", "seq"], kind="stable"), {}))

    def kept(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = json.loads(state.get[0]) if state.exists else {}
        out = _shaped(run(pd.concat(list(pdfs)).sort_values(["ts_ms", "seq"], kind="stable"), memory))
        state.update((json.dumps(memory),))
        yield out

    if not _functions[name].stateful:
        return rows.mapInPandas(plain, RECORD)
    if df.isStreaming:
        return rows.groupBy("source", "key").applyInPandasWithState(kept, RECORD, "memory string", "append", GroupStateTimeout.NoTimeout)
    return rows.groupBy("source", "key").applyInPandas(keyed, RECORD)
