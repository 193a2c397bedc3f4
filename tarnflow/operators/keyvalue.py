"""Key-value versions: views, listings and the fold of operations."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import variant_path

#: Versions that a key keeps (fixed value).
MOST_HISTORY = 64

def current(versions: DataFrame, now_ns: int | None = None) -> DataFrame:
    """The latest version of each key that isn't deleted or expired."""
    top = versions.groupBy("key").agg(F.max_by(F.struct("version", "value", "expiry_ns", "tombstone"), "version").alias("v")).select("key", "v.*").where("not tombstone")
    if now_ns is not None:
        top = top.where(F.col("expiry_ns").isNull() | (F.col("expiry_ns") > now_ns))
    return top.select("key", "version", "value")


def history(versions: DataFrame, most: int = 64) -> DataFrame:
    """Up to so many versions of each key, newest first; a delete hides what was before it.

    The rank is cut first, so each task passes on so many rows of a key at most.
    """
    newest_first = Window.partitionBy("key").orderBy(F.desc("version"))
    top = versions.withColumn("n", F.row_number().over(newest_first)).where(F.col("n") <= most)
    newer = F.sum(F.col("tombstone").cast("int")).over(newest_first.rowsBetween(Window.unboundedPreceding, -1))
    return top.withColumn("newer_deletes", F.coalesce(newer, F.lit(0))).where("newer_deletes = 0").select("key", "version", "value", "tombstone", F.col("n").cast("long").alias("rank"))


def namespace_summary(versions: DataFrame) -> DataFrame:
    """Per namespace: keys that are live, versions held and bytes of values."""
    top = versions.groupBy("ns", "key").agg(F.max_by("tombstone", "version").alias("gone"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes"))
    return top.groupBy("ns").agg(F.count_if(~F.col("gone")).alias("keys"), F.sum("n").alias("versions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def history_page(versions: DataFrame, key: str, before_version: int | None = None, most: int = 64, most_bytes: int | None = None) -> DataFrame:
    """A page of a key's versions, newest first, behind an exclusive version; it ends before the version with which
    its values would take more than most_bytes, but holds one at least."""
    page = history(versions.where(F.col("key") == key), MOST_HISTORY)
    if before_version is not None:
        page = page.where(F.col("version") < before_version)
    page = page.orderBy(F.desc("version")).limit(most).drop("rank")
    if most_bytes is None:
        return page
    so_far = F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).over(Window.orderBy(F.desc("version")))  # most rows at most
    placed = page.withColumn("_bytes", so_far).withColumn("_n", F.row_number().over(Window.orderBy(F.desc("version"))))
    return placed.where((F.col("_bytes") <= most_bytes) | (F.col("_n") == 1)).drop("_bytes", "_n")


def json_get(live: DataFrame, path: str) -> DataFrame:
    """What is at the path of each live value as JSON text; null where the value isn't JSON or nothing is there."""
    doc = F.try_parse_json("value")
    return live.select("key", F.to_json(F.try_variant_get(doc, variant_path(path, True), "variant")).alias("found"))


def prefix_scan(live: DataFrame, prefix: str, after: str | None = None, limit: int = 1024) -> DataFrame:
    df = live.where(F.col("key").startswith(prefix))
    if after is not None:
        df = df.where(F.col("key") > after)
    return df.select("key").orderBy("key").limit(limit)


def multi_get(live: DataFrame, keys: list[str]) -> DataFrame:
    """Asked keys in their order; a miss has found = false."""
    asked = live.sparkSession.createDataFrame(list(enumerate(keys)), "ask long, key string")
    return asked.join(live.select("key", "value"), "key", "left").select("ask", "key", "value", F.col("value").isNotNull().alias("found"))


def json_steps(path: str) -> list[str | int]:
    """`$`, `$.a.b`, `$.a[0]` -> steps."""
    if not re.fullmatch(r"\$(\.[^.\[\]]+|\[\d+\])*", path):
        raise ValueError(f"bad path: {path!r}")
    return [int(i) if i else n for n, i in re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", path)]


def json_set(text: str, path: str, value: str | None) -> str | None:
    """Sets (or with None deletes) at a path whose parent exists; null where it can't, as with what isn't JSON."""
    try:
        steps, new = json_steps(path), None if value is None else json.loads(value)
        if not steps:
            return value
        doc = json.loads(text)
    except (ValueError, TypeError):
        return None
    at = doc
    try:
        for s in steps[:-1]:
            at = at[s]
        last = steps[-1]
        if isinstance(at, dict) and isinstance(last, str):
            if value is None:
                del at[last]
            else:
                at[last] = new
        elif isinstance(at, list) and isinstance(last, int):
            if value is None:
                del at[last]
            elif last == len(at):
                at.append(new)
            else:
                at[last] = new
        else:
            return None
    except (KeyError, IndexError, TypeError):
        return None
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)


_GONE = {"value": None, "counter": False, "version": 0, "expiry": None}


def _applied(now: dict, r) -> dict | None:
    """A key's state after an operation, or None where it is refused."""
    live = now["value"] is not None
    if getattr(r, "cas", None) is not None and not pd.isna(r.cas) and int(r.cas) != (now["version"] if live else 0):
        return None
    value, counter, ttl = None, False, None if pd.isna(r.ttl_ns) else r.at_ns + int(r.ttl_ns)
    match r.op:
        case "set" | "set_if_absent" | "set_if_present":
            if r.arg is None or r.op != "set" and live == (r.op == "set_if_absent"):
                return None
            value = r.arg
        case "incr":
            if live and not now["counter"] or not re.fullmatch(r"[+-]?\d+", r.arg or ""):
                return None
            n = int(r.arg) + (int(now["value"]) if live else 0)
            if not -(2**63) <= n < 2**63:
                return None
            value, counter, ttl = str(n), True, None
        case "json_set":
            value = json_set(now["value"], r.path, r.arg) if live else r.arg if r.path == "$" and json_set("0", "$", r.arg) else None
            if value is None or r.arg is None:
                return None
        case "json_del":
            value = json_set(now["value"], r.path, None) if live else None
            if value is None:
                return None
        case "expire":
            return {**now, "expiry": ttl} if live and ttl is not None else None
        case "delete":
            if not live:
                return None
        case _:
            return None
    return {"value": value, "counter": counter, "version": now["version"] + 1, "expiry": ttl}


def _at(state: dict, r) -> dict:
    """The state when an operation comes: what has expired is gone."""
    if state["expiry"] is not None and state["expiry"] <= r.at_ns:
        return {**state, "value": None, "counter": False, "expiry": None}
    return state


_OPS = ("key", "seq", "op", "arg", "path", "ttl_ns", "at_ns")
_FOLDED = "key string, seq long, op string, applied boolean, version long, value string"


def fold_operations(ops: DataFrame) -> DataFrame:
    """ops (key, seq, op, arg, path, ttl_ns, at_ns[, cas]) in order per key -> versions with their outcome.

    op is set, set_if_absent, set_if_present, incr, delete, expire, json_set or json_del. cas, if there is one, must
    be the key's version, 0 for an absent key. An increment starts at 0, is refused on a text or past 64 bits and
    clears the time to live; expire makes no new version. What can't be done, as with a null key, an unknown op, a bad
    number or what isn't JSON, has applied = false.
    """
    cols = [*_OPS, *(c for c in ("cas",) if c in ops.columns)]

    def of(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, _GONE
        for pdf in pdfs:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.key != key:
                    key, state = r.key, _GONE
                state = _at(state, r)
                after = None if r.key is None else _applied(state, r)
                state = after or state
                rows.append((r.key, r.seq, r.op, after is not None, state["version"], state["value"]))
            yield pd.DataFrame(rows, columns=["key", "seq", "op", "applied", "version", "value"])

    # keys stay whole and in order within a partition, and stream through: no key is held in memory
    ordered = ops.repartition("key").sortWithinPartitions("key", "seq")
    return ordered.select(*cols).mapInPandas(of, _FOLDED)


def fold_transactions(ops: DataFrame) -> DataFrame:
    """ops with ns and txn besides: operations of one txn of a namespace apply all or none, in the order of seq.

    Each sees what those before it in the txn did; the first that is refused takes the others back, and all have
    applied = false. Without a txn an operation is one of its own. A namespace is one sequence, in one task that
    holds its keys' states; namespaces are spread.
    """
    cols = ["ns", "txn", *_OPS, *(c for c in ("cas",) if c in ops.columns)]

    def of(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns, states, group, held = None, {}, None, []

        def ended() -> list[tuple]:
            tried, steps = {}, []
            for r in held:
                before = _at(tried.get(r.key, states.get(r.key, _GONE)), r)
                after = None if r.key is None else _applied(before, r)
                if after is None:
                    steps = None
                    break
                tried[r.key] = after
                steps.append((after["version"], after["value"]))
            if steps is not None:
                states.update(tried)
                return [(r.ns, r.txn, r.key, r.seq, r.op, True, *step) for r, step in zip(held, steps, strict=True)]
            now = [_at(states.get(r.key, _GONE), r) for r in held]
            return [(r.ns, r.txn, r.key, r.seq, r.op, False, s["version"], s["value"]) for r, s in zip(held, now, strict=True)]

        names = ["ns", "txn", "key", "seq", "op", "applied", "version", "value"]
        for pdf in pdfs:
            rows = []
            for r in pdf.itertuples(index=False):
                mark = (r.ns, r.txn) if r.txn is not None else object()
                if mark != group:
                    rows += ended()
                    group, held = mark, []
                if r.ns != ns:
                    ns, states = r.ns, {}
                held.append(r)
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(ended(), columns=names)

    ordered = ops.repartition("ns").sortWithinPartitions("ns", "seq")
    return ordered.select(*cols).mapInPandas(of, "ns string, txn string, " + _FOLDED)
