"""Leased delivery: queues and consumer groups as a fold of their operations, in order.

A message is ready, leased or dead. A delivery leases it to a holder; the holder completes it, fails it or extends
the lease, and a lease that runs out counts as a failure. The fifth failure makes it dead.

A scope (a queue, or a group of a stream) is one sequence of operations by nature. It streams through one task in
order, and the task holds what the scope holds, which MOST_HELD bounds; payloads stay in their table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordinals, running

# The delivery rules.
LEASE_MS = 30_000
MOST_ATTEMPTS = 5
MOST_BATCH = 100
MOST_HELD = 100_000
MOST_HELD_BYTES = 256 * 1024 * 1024
MOST_MESSAGE_BYTES = 64 * 1024
LONGEST_HOLD_MS = 12 * 60 * 60 * 1000
GROUP_PRIORITY = 0

OPERATIONS = "scope string, seq long, op string, at_ms long, holder string, msg long, delivery int, count int, priority int, delay_ms long, lease_ms long, bytes long, dead boolean, available long"
OUTCOMES = "scope string, seq long, op string, msg long, outcome string, delivery int, until_ms long, holder string"


@dataclass(slots=True)
class Message:
    priority: int
    due: int
    size: int
    status: str = "ready"
    delivery: int = 0
    failures: int = 0
    holder: str = ""
    lease: int = 0
    taken: int = 0
    touched: int = 0
    expiry: int = 0
    ended: str = "not_held"


class Scope:
    """What one queue or group holds, and the operations on it."""

    def __init__(self) -> None:
        self.held: dict[int, Message] = {}
        self.ready: dict[int, list] = {}  # priority -> heap of (due, id); stale entries are passed over
        self.deadlines: list = []
        self.size, self.next, self.cursor = 0, 1, 0

    def _make_ready(self, i: int, m: Message, due: int) -> None:
        m.status, m.due = "ready", due
        heapq.heappush(self.ready.setdefault(m.priority, []), (due, i))

    def _fail(self, i: int, m: Message, due: int, dead: bool) -> str:
        m.failures += 1
        if dead or m.failures >= MOST_ATTEMPTS:
            m.status = "dead"
            return "dead"
        self._make_ready(i, m, due)
        return "ready"

    def expire(self, now: int) -> Iterator[tuple]:
        """Leases that ran out by now end at their own time, in order."""
        while self.deadlines and self.deadlines[0][0] <= now:
            expiry, i = heapq.heappop(self.deadlines)
            m = self.held.get(i)
            if m is not None and m.status == "leased" and m.expiry == expiry:
                m.ended = "expired"
                yield i, f"expired_{self._fail(i, m, expiry, False)}", m.delivery, expiry

    def _lease(self, i: int, m: Message, r, now: int) -> tuple:
        lease = LEASE_MS if pd.isna(r.lease_ms) else int(r.lease_ms)
        m.status, m.delivery, m.holder, m.lease, m.taken, m.touched, m.ended = "leased", m.delivery + 1, r.holder, lease, now, now, "not_held"
        m.expiry = now + lease
        heapq.heappush(self.deadlines, (m.expiry, i))
        return i, "leased", m.delivery, m.expiry

    def _take_ready(self, now: int, count: int) -> list[int]:
        out = []
        for p in sorted(self.ready):
            level = self.ready[p]
            while level and len(out) < count and level[0][0] <= now:
                due, i = heapq.heappop(level)
                m = self.held.get(i)
                if m is not None and m.status == "ready" and m.due == due and i not in out:
                    out.append(i)
            if not level:
                del self.ready[p]
        return out

    def _drop(self, i: int) -> None:
        self.size -= self.held.pop(i).size

    def _refusal(self, m: Message | None, r) -> str | None:
        if m is None:
            return "gone"
        if m.delivery != r.delivery:
            return "delivered_again"
        if m.holder != r.holder:
            return "other_holder"
        return None if m.status == "leased" else m.ended

    def apply(self, r) -> Iterator[tuple]:
        now, i = int(r.at_ms), None if pd.isna(r.msg) else int(r.msg)
        yield from self.expire(now)
        m = self.held.get(i)
        delay = 0 if pd.isna(r.delay_ms) else int(r.delay_ms)
        if r.op == "enqueue":
            size = 0 if pd.isna(r.bytes) else int(r.bytes)
            if size > MOST_MESSAGE_BYTES:
                yield None, "too_large", None, None
            elif len(self.held) >= MOST_HELD or self.size + size > MOST_HELD_BYTES:
                yield None, "full", None, None
            else:
                i, self.next, self.size = self.next, self.next + 1, self.size + size
                self.held[i] = m = Message(0 if pd.isna(r.priority) else int(r.priority), 0, size)
                self._make_ready(i, m, now + delay)
                yield i, "enqueued", 0, m.due
        elif r.op in ("deliver", "read"):
            count = 1 if pd.isna(r.count) else min(int(r.count), MOST_BATCH)
            taken = self._take_ready(now, count)
            upto = self.cursor if pd.isna(r.available) else int(r.available)
            while r.op == "read" and len(taken) < count and self.cursor < upto and len(self.held) < MOST_HELD:
                self.cursor += 1
                self.held[self.cursor] = Message(GROUP_PRIORITY, now, 0)
                taken.append(self.cursor)
            if not taken:
                yield None, "full" if r.op == "read" and self.cursor < upto and count > 0 else "nothing", None, None
            for j in taken:
                yield self._lease(j, self.held[j], r, now)
        elif r.op in ("complete", "fail", "extend"):
            no = self._refusal(m, r)
            if no == "released" and r.op == "fail":
                yield i, "failed_before", m.delivery, None  # the same report again
            elif no:
                yield i, no, None, None
            elif r.op == "complete":
                self._drop(i)
                yield i, "completed", m.delivery, None
            elif r.op == "fail":
                m.ended = "released"
                state = self._fail(i, m, now + delay, not pd.isna(r.dead) and bool(r.dead))
                yield i, f"failed_{state}", m.delivery, m.due if state == "ready" else None
            else:
                m.touched = now
                to = min(now + m.lease, m.taken + LONGEST_HOLD_MS)
                if 2 * (m.expiry - now) <= m.lease and to > m.expiry:
                    m.expiry = to
                    heapq.heappush(self.deadlines, (to, i))
                yield i, "extended", m.delivery, m.expiry
        elif r.op == "steal":
            # delay_ms is the least time without a sign of life
            if m is None:
                yield i, "gone", None, None
            elif m.delivery != r.delivery:
                yield i, "delivered_again", None, None
            elif m.status != "leased":
                yield i, m.ended, None, None
            elif now - m.touched < delay:
                yield i, "not_idle", None, None
            else:
                yield self._lease(i, m, r, now)
        elif r.op in ("requeue", "discard"):
            if m is None or m.status != "dead":
                yield i, "gone" if m is None else "not_dead", None, None
            elif r.op == "requeue":
                m.failures = 0
                self._make_ready(i, m, now)
                yield i, "requeued", m.delivery, now
            else:
                self._drop(i)
                yield i, "discarded", m.delivery, None
        elif r.op == "purge":
            n = len(self.held)
            self.held, self.ready, self.deadlines, self.size = {}, {}, [], 0
            yield n, "purged", None, None
        elif r.op == "tick":
            return
        else:
            yield i, "unknown_operation", None, None


def _fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    name, scope = None, Scope()
    for pdf in pdfs:
        rows = []
        for r in pdf.itertuples(index=False):
            if name is None or r.scope != name[0]:
                name, scope = (r.scope,), Scope()
            rows += [(r.scope, r.seq, r.op, *got, r.holder if got[1] in ("leased", "extended") else None) for got in scope.apply(r)]
        out = pd.DataFrame(rows, columns=["scope", "seq", "op", "msg", "outcome", "delivery", "until_ms", "holder"])
        yield out.astype({"msg": "Int64", "delivery": "Int32", "until_ms": "Int64"})


def fold_deliveries(operations: DataFrame) -> DataFrame:
    """What every operation did, one row for each message that it touched, leases that ran out before it included.

    operations has OPERATIONS' columns; those that are missing are null. Per scope they apply by seq, and at_ms must
    not fall. A queue takes enqueue, deliver (count, holder, lease_ms), complete, fail (delay_ms, dead), extend,
    requeue, discard, purge and tick (which only lets leases run out); a group takes read in place of enqueue and
    deliver, and steal, whose delay_ms is the least idle time.
    """
    have = set(operations.columns)
    full = operations.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in OPERATIONS.split(", "))])
    return full.repartition("scope").sortWithinPartitions("scope", "seq").mapInPandas(_fold, OUTCOMES)


def _state():
    o = F.col("outcome")
    return F.when(o.isin("enqueued", "requeued") | o.endswith("_ready"), "ready").when(o.isin("leased", "extended"), "leased").when(o.endswith("_dead"), "dead").when(o.isin("completed", "discarded"), "gone")


def _last(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """The last thing that happened to each message; at one operation, a lease runs out before what it does."""
    changed = outcomes.where("msg is not null and op <> 'purge'").withColumn("state", _state()).where("state is not null")
    order = F.struct("seq", F.when(F.col("outcome").startswith("expired"), 0).otherwise(1))
    return changed.groupBy(*keys, "msg").agg(F.max_by(F.struct("seq", "state", "delivery", "until_ms", "holder"), order).alias("l")).select(*keys, "msg", "l.*")


def message_states(outcomes: DataFrame) -> DataFrame:
    """Where each message stands after all operations: ready, leased, dead or gone."""
    purged = outcomes.where("outcome = 'purged'").groupBy(F.col("scope").alias("_scope")).agg(F.max("seq").alias("_purge"))
    last = _last(outcomes, ["scope"]).join(purged, F.col("scope").eqNullSafe(F.col("_scope")), "left")
    return last.withColumn("state", F.when(F.col("_purge") > F.col("seq"), "gone").otherwise(F.col("state"))).drop("_scope", "_purge", "seq")


def with_available(reads: DataFrame, records: DataFrame) -> DataFrame:
    """Group operations (stream, at_ms, seq, ...) with how many of their stream's records were there by then."""
    cols = reads.columns
    ops = reads.select("stream", F.col("at_ms").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_one"), F.struct(*cols).alias("_op"))
    kind = ops.schema["_op"].dataType
    there = records.select(F.col("source").alias("stream"), F.col("ts_ms").alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_one"), F.lit(None).cast(kind).alias("_op"))
    counted = running(ops.unionByName(there), ["stream"], ["_at", "_kind"], {"available": ("count", "_one")})
    return counted.where("_op is not null").select("_op.*", "available")


def group_deliveries(operations: DataFrame, records: DataFrame) -> DataFrame:
    """A group's outcomes with the records' ids; operations has stream, group and the columns of fold_deliveries.

    A read takes due records that were handed back first, then the stream's next past the cursor. Reports name a
    record by its place in the stream (from 1), as the outcomes of reads do in msg.
    """
    scoped = with_available(operations, records).withColumn("scope", F.to_json(F.struct("stream", "group")))
    out = fold_deliveries(scoped).withColumn("stream", F.get_json_object("scope", "$.stream")).withColumn("group", F.get_json_object("scope", "$.group"))
    placed = ordinals(records, ["source"], ["ts_ms", "seq"], "msg").select(F.col("source").alias("stream"), "msg", "ts_ms", F.col("seq").alias("record_seq"))
    return out.join(placed, ["stream", "msg"], "left").select("stream", "group", "seq", "op", "msg", "ts_ms", "record_seq", "outcome", "delivery", "until_ms", "holder")


def pending(outcomes: DataFrame) -> DataFrame:
    """A group's records that are leased after all operations."""
    return _last(outcomes, ["stream", "group"]).where("state = 'leased'").drop("state", "seq")


def members(outcomes: DataFrame) -> DataFrame:
    """Who holds how many of a group's records."""
    return pending(outcomes).groupBy("stream", "group", "holder").agg(F.count(F.lit(1)).alias("held"))
