"""Plan-time text helpers: durations, globs, JSON paths, lookup templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_MAX = 2**63 - 1


def pipe_duration_ms(text: str) -> int:
    """`5m` in the pipe language: a positive whole number and s, m, h or d."""
    m = re.fullmatch(r"(\d+)([smhd])", text)
    if not m or int(m[1]) <= 0:
        raise ValueError(f"bad duration: {text!r}")
    out = int(m[1]) * _UNITS[m[2]]
    if out * 1_000_000 > _MAX:
        raise ValueError(f"duration is too long: {text!r}")
    return out


def person_duration_ms(text: str) -> int:
    """A duration as people write it: whole number with ms, s, m, h or d, or a bare 0."""
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)?", text)
    if not m or (m[2] is None and int(m[1]) != 0):
        raise ValueError(f"bad duration: {text!r}")
    out = int(m[1]) * _UNITS[m[2] or "ms"]
    if out > _MAX:
        raise ValueError(f"duration is too long: {text!r}")
    return out


def glob_regex(glob: str) -> str:
    """An anchored regex for a glob of * and ?."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w])", r"\\\1", c) for c in glob)
    return f"(?s)^{body}$"


def glob_match(col: Column, glob: str) -> Column:
    return col.rlike(glob_regex(glob))


def path_segments(path: str) -> list[str]:
    """`$.a.b`, `$a` or `a.b` -> names; `$` is the whole document."""
    if path.startswith("$"):
        path = path[1:].removeprefix(".")
    return [p for p in path.split(".") if p]


def variant_path(path: str, indexes: bool = False) -> str:
    """A path for variant_get with quoted names; indexes also takes [i]."""
    out = "$"
    for name in path_segments(path):
        parts = re.fullmatch(r"([^\[\]]*)((?:\[\d+\])*)", name) if indexes else None
        key, rest = (parts[1], parts[2]) if parts else (name, "")
        if "'" in key or "\\" in key:
            raise ValueError(f"unsupported name in a path: {key!r}")
        out += (f"['{key}']" if key else "") + rest
    return out


def as_variant(value: Column) -> Column:
    """The JSON document, or null where the text isn't JSON or repeats a key."""
    return F.try_parse_json(value)


def json_at(doc: Column, path: str, kind: str, indexes: bool = False) -> Column:
    return F.try_variant_get(doc, variant_path(path, indexes), kind)


def is_number(kind: Column) -> Column:
    """Of the type that schema_of_variant tells."""
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def json_kind(doc: Column, path: str) -> Column:
    """STRING, NUMBER, BOOLEAN, NULL, OTHER, or null where nothing is there."""
    node = F.schema_of_variant(json_at(doc, path, "variant"))
    return F.when(node.isNull(), None).when(node == "STRING", "STRING").when(is_number(node), "NUMBER").when(node == "BOOLEAN", "BOOLEAN").when(node == "VOID", "NULL").otherwise("OTHER")


def number_text(col: Column) -> Column:
    """Shortest decimal text: 10, not 10.0; null for what isn't finite."""
    whole = (F.floor(col) == col) & (F.abs(col) < 1e15)
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).when(whole, F.try_to_number(col.cast("decimal(18,0)").cast("string"), F.lit("S999999999999999999")).cast("string")).otherwise(col.cast("string"))


def template_key(doc: Column, template: str) -> Column:
    """`lit${$.path}lit`: null unless every placeholder is a JSON string; an unclosed one is literal."""
    parts, at = [], 0
    for m in re.finditer(r"\$\{([^}]*)\}", template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append(F.when(json_kind(doc, m[1]) == "STRING", json_at(doc, m[1], "string")))
        at = m.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    key = F.concat(*parts)
    return F.when(F.octet_length(key) <= 1024, key)
