"""Parser of the pipe language: `cpu{host=~web-*}[1h] | window(5m) | avg() | math(* 100)`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import pipe_duration_ms

AGGREGATES = ("avg", "sum", "count", "min", "max")
_YEAR_3000_MS = 32_503_680_000_000
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")
_COMPARE = (">=", "<=", "==", "!=", ">", "<")


class PipeError(ValueError):
    """A query that is refused."""


@dataclass(frozen=True)
class TagFilter:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Stage:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class PipeQuery:
    measurement: str
    filters: tuple[TagFilter, ...]
    low_ms: int | None
    high_ms: int | None
    stages: tuple[Stage, ...]

    @property
    def field(self) -> str:
        return next((s.args[0] for s in self.stages if s.name == "field"), "value")


class _Cursor:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, token: str) -> bool:
        self.space()
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            raise PipeError(f"expected {token!r} at {self.at}")

    def ident(self) -> str:
        self.space()
        m = _IDENT.match(self.text, self.at)
        if not m:
            raise PipeError(f"expected a name at {self.at}")
        self.at = m.end()
        return m[0]

    def until(self, stops: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops:
            self.at += 1
        return self.text[start : self.at]

    def word(self) -> str:
        """A quoted text without escapes, or a bare one."""
        self.space()
        quote = self.text[self.at : self.at + 1]
        if quote in ('"', "'"):
            self.at += 1
            out = self.until(quote)
            self.need(quote)
            return out
        out = self.until(",}])| ")
        if not out:
            raise PipeError(f"expected a value at {self.at}")
        return out


def _number(text: str) -> float:
    if not re.fullmatch(r"-?\d+(\.\d+)?", text):
        raise PipeError(f"bad number: {text!r}")
    return float(text)


def _duration(text: str) -> int:
    try:
        return pipe_duration_ms(text)
    except ValueError as e:
        raise PipeError(str(e)) from None


def _range(text: str, now_ms: int) -> tuple[int | None, int | None]:
    ends = [e.strip() for e in text.split("..")]
    if len(ends) > 2 or not all(ends):
        raise PipeError(f"bad range: {text!r}")
    if all(re.fullmatch(r"-?\d+", e) for e in ends):
        ms = [int(e) for e in ends]
        if any(m < 0 or m > _YEAR_3000_MS for m in ms):
            raise PipeError("time is out of range")
        low, high = ms[0], ms[1] if len(ms) == 2 else None
    else:
        back = [now_ms - _duration(e) for e in ends]
        low, high = back[0], back[1] if len(back) == 2 else now_ms
    if high is not None and low > high:
        raise PipeError("range starts after its end")
    return low, high


def _stage(name: str, raw: str) -> Stage:
    raw = raw.strip()
    if name in (*AGGREGATES, "first", "last", "delta", "abs", "ceil", "floor"):
        if raw:
            raise PipeError(f"{name} takes no arguments")
        return Stage(name)
    if name in ("window", "rate"):
        return Stage(name, (_duration(raw),))
    if name in ("topk", "bottomk"):
        if not re.fullmatch(r"\d+", raw):
            raise PipeError(f"{name} needs a whole number")
        return Stage(name, (int(raw),))
    if name == "percentile":
        p = _number(raw)
        if not 0 <= p <= 100:
            raise PipeError("percentile must be 0 to 100")
        return Stage(name, (p,))
    if name == "round":
        if raw and not re.fullmatch(r"\d+", raw):
            raise PipeError("round needs a whole number")
        return Stage(name, (int(raw or 0),))
    if name in ("group_by", "field", "alias"):
        c = _Cursor(raw)
        value = c.word() if raw else ""
        c.space()
        if not value or c.at != len(raw):
            raise PipeError(f"{name} needs one name")
        return Stage(name, (value,))
    if name == "where":
        m = re.fullmatch(r"(?:value\s*)?(>=|<=|==|!=|>|<)\s*(\S+)", raw)
        if not m:
            raise PipeError(f"bad where: {raw!r}")
        return Stage(name, (m[1], _number(m[2])))
    if name == "math":
        m = re.fullmatch(r"(?:value\s*)?([-+*/%])\s*(\S+)", raw)
        if not m:
            raise PipeError(f"bad math: {raw!r}")
        if m[1] == "%" and _number(m[2]) < 0:
            raise PipeError("math % needs a divisor that isn't negative")
        return Stage(name, (m[1], _number(m[2])))
    raise PipeError(f"unknown stage: {name}")


def parse(text: str, now_ms: int) -> PipeQuery:
    """Text after the last stage that doesn't start with | is ignored."""
    c = _Cursor(text)
    measurement, filters = c.ident(), []
    if c.take("{"):
        while True:
            name = c.ident()
            op = next((o for o in ("!~", "!=", "=~", "=") if c.take(o)), None)
            if op is None:
                raise PipeError(f"expected a tag operator at {c.at}")
            filters.append(TagFilter(name, op, c.word()))
            if not c.take(","):
                break
        c.need("}")
    low, high = now_ms - 3_600_000, now_ms
    if c.take("["):
        low, high = _range(c.until("]"), now_ms)
        c.need("]")
    stages = []
    while c.take("|"):
        name = c.ident()
        c.need("(")
        raw = c.until(")")
        c.need(")")
        stages.append(_stage(name, raw))
    return PipeQuery(measurement, tuple(filters), low, high, tuple(stages))
