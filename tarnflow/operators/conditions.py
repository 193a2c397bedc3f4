"""Filter conditions of jobs: parsed to plain data, then compiled to Columns on key, value and the parsed document."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import as_variant, is_number, json_at

_JSON = re.compile(r"^json:(.*?)(!\^=|!\*=|\^=|\*=|!=|>=|<=|=|>|<)(.*)$", re.S)
_TEXT = {"value_contains": ("value", "contains"), "key_contains": ("key", "contains"), "key_prefix": ("key", "startswith"), "value_prefix": ("value", "startswith")}


class ConditionError(ValueError):
    """A condition that is refused."""


def _json(path: str, op: str, want: str, doc: Column) -> Column:
    """By type: text operators on strings, numeric ones on numbers, = and != on booleans; all else is false.

    Only the types that the operator and its operand can meet are looked at.
    """
    kind = F.schema_of_variant(json_at(doc, path, "variant"))
    text = lambda: json_at(doc, path, "string")
    on_text = {"=": lambda: text() == want, "!=": lambda: text() != want, "^=": lambda: text().startswith(want), "*=": lambda: text().contains(want), "!^=": lambda: ~text().startswith(want), "!*=": lambda: ~text().contains(want)}
    tests = [(kind == "STRING") & on_text[op]()] if op in on_text else []
    if op in ("=", "!=", ">", ">=", "<", "<=") and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", want):
        v, n = json_at(doc, path, "double"), F.lit(float(want))
        holds = {"=": v == n, "!=": v != n, ">": v > n, ">=": v >= n, "<": v < n, "<=": v <= n}[op]
        tests.append(holds & is_number(kind))
    if op in ("=", "!=") and want in ("true", "false"):
        flag = json_at(doc, path, "boolean")
        tests.append((kind == "BOOLEAN") & (flag == ((want == "true") == (op == "="))))
    return F.coalesce(functools.reduce(operator.or_, [F.coalesce(x, F.lit(False)) for x in tests], F.lit(False)), F.lit(False))


@dataclass(frozen=True)
class Part:
    """One test: a json path with operator and operand, or a named test with its argument."""

    test: str
    arg: str = ""
    path: str = ""
    op: str = ""


@dataclass(frozen=True)
class Condition:
    parts: tuple[Part, ...]
    every: bool

    @property
    def reads_json(self) -> bool:
        return any(p.test == "json" for p in self.parts)


def _part(text: str) -> Part:
    text = text.strip()
    if text in ("not_empty", "key_not_empty"):
        return Part(text)
    if m := _JSON.match(text):
        if not m[1].strip():
            raise ConditionError(f"no path in {text!r}")
        return Part("json", m[3].strip(), m[1].strip(), m[2])
    name, colon, arg = text.partition(":")
    if colon and (name in _TEXT or name == "key_equals" or name == "min_length" and re.fullmatch(r"\d{1,9}", arg)):
        return Part(name, arg)
    raise ConditionError(f"unknown condition: {text!r}")


def parse_condition(text: str) -> Condition:
    """One test, or up to eight joined by AND or by OR, not both. Plain data: no session is needed."""
    if not isinstance(text, str):
        raise ConditionError(f"must be a text, not {text!r}")
    if " AND " in text and " OR " in text:
        raise ConditionError("AND and OR can't be mixed")
    every = " OR " not in text
    parts = text.split(" AND " if every else " OR ")
    if len(parts) > 8:
        raise ConditionError("more than 8 parts")
    return Condition(tuple(_part(p) for p in parts), every)


def _one(part: Part, doc: Column) -> Column:
    if part.test == "json":
        return _json(part.path, part.op, part.arg, doc)
    if part.test in _TEXT:
        col, how = _TEXT[part.test]
        return getattr(F.col(col), how)(part.arg)
    if part.test == "key_equals":
        return F.col("key") == part.arg
    if part.test == "min_length":
        return F.octet_length("value") >= int(part.arg)
    return F.octet_length("key" if part.test == "key_not_empty" else "value") > 0


def condition(text: str | Condition, doc: Column | None = None) -> Column:
    """A condition as a Column; doc: the parsed value, if there is one."""
    parsed = parse_condition(text) if not isinstance(text, Condition) else text
    doc = as_variant(F.col("value")) if doc is None else doc
    return F.coalesce(functools.reduce(operator.and_ if parsed.every else operator.or_, [_one(p, doc) for p in parsed.parts]), F.lit(False))
