"""Five-field schedules in UTC: minute, hour, day of month, month, day of week (0 or 7 is Sunday)."""

from __future__ import annotations

import datetime
import functools
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_EPOCH = datetime.date(1970, 1, 1)
#: How many days back a fire is looked for: four years.
LOOK_BACK_DAYS = 4 * 366


def _values(field: str, low: int, high: int) -> frozenset[int]:
    """`*`, `*/n`, `a`, `a-b` and `a-b/n`, joined by commas."""
    out: set[int] = set()
    for token in field.removesuffix(",").split(","):
        m = re.fullmatch(r"\*(?:/(\d+))?|(\d+)(?:-(\d+)(?:/(\d+))?)?", token)
        if not m:
            raise ValueError(f"bad schedule field: {field!r}")
        first = low if m[2] is None else int(m[2])
        last = high if m[2] is None else int(m[3] or m[2])
        step = int(m[1] or m[4] or 1)
        if step == 0 or not low <= first <= last <= high:
            raise ValueError(f"bad schedule field: {field!r}")
        out.update(range(first, last + 1, step))
    return frozenset(out)


@dataclass(frozen=True)
class Schedule:
    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]
    any_day: bool
    any_weekday: bool

    def fires_on(self, day: datetime.date) -> bool:
        """With both day fields restricted, either is enough."""
        if day.month not in self.months:
            return False
        by_month, by_week = day.day in self.days, day.isoweekday() % 7 in self.weekdays
        if self.any_day:
            return self.any_weekday or by_week
        return by_month if self.any_weekday else by_month or by_week


@functools.lru_cache(maxsize=256)
def parse_schedule(text: str) -> Schedule:
    fields = re.split(r"[ \t]+", text.strip(" \t"))
    if len(fields) != 5:
        raise ValueError(f"a schedule has five fields: {text!r}")
    sets = [_values(f, low, high) for f, (low, high) in zip(fields, _RANGES, strict=True)]
    weekdays = sets[4] | ({0} if 7 in sets[4] else set())
    return Schedule(tuple(sorted(sets[0])), tuple(sorted(sets[1])), sets[2], sets[3], weekdays, fields[2][0] == "*", fields[4][0] == "*")


@functools.lru_cache(maxsize=65536)
def _last_day(schedule: Schedule, day: int) -> int | None:
    """The last firing day at or before a day, both as days since 1970."""
    return next((d for d in range(day, day - LOOK_BACK_DAYS - 1, -1) if schedule.fires_on(_EPOCH + datetime.timedelta(d))), None)


def latest_fire_ms(text: str, now_ms: int) -> int | None:
    """The latest fire at or before now, or None where there is none in four years; times before 1970 count as 1970."""
    schedule, (day, rest) = parse_schedule(text), divmod(max(now_ms, 0), 86_400_000)
    minute = rest // 60_000
    if schedule.fires_on(_EPOCH + datetime.timedelta(day)):
        today = [h * 60 + m for h in schedule.hours for m in schedule.minutes if h * 60 + m <= minute]
        if today:
            return day * 86_400_000 + today[-1] * 60_000
    before = _last_day(schedule, day - 1)
    return None if before is None or before < day - LOOK_BACK_DAYS else before * 86_400_000 + (schedule.hours[-1] * 60 + schedule.minutes[-1]) * 60_000


def latest_fire(ms: Column, text: str) -> Column:
    """latest_fire_ms over a column of epoch milliseconds."""
    parse_schedule(text)

    @F.pandas_udf("long")
    def of(batch: pd.Series) -> pd.Series:
        minutes = batch // 60_000
        known = {m: latest_fire_ms(text, int(m) * 60_000) for m in minutes.dropna().unique()}
        return minutes.map(known).astype("Int64")

    return of(ms)
