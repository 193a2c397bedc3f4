"""Job definitions: a YAML or JSON text -> checked dataclasses. Every refusal names the setting and its place.

Nothing here needs a Spark session: conditions are parsed to plain data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from ..operators.conditions import ConditionError, parse_condition


class JobError(ValueError):
    """A definition that is refused; its text begins with the setting's path."""


#: Settings by operator type and those it needs; `map` takes any other setting as an output field (fixed values of
#: the definition format).
OPERATORS = {
    "filter": (("condition",), ("condition",)),
    "map": (None, ()),
    "passthrough": ((), ()),
    "keyby": (("key_expression",), ("key_expression",)),
    "flatmap": (("array_field", "element_key"), ("array_field",)),
    "classify": (("rules", "default_tag"), ("rules",)),
    "aggregate": (("function", "field", "window", "window_size", "window_count"), ("function",)),
    "kv_lookup": (("lookup_key", "namespace", "mode", "enrich_field"), ("lookup_key",)),
}
RESERVED = ("join", "dedup", "no_event_for", "wasm")
LATER = ("event_time_field", "max_delay_ms", "window_type")
FUNCTIONS = ("sum", "count", "avg", "min", "max")
TOP = ("kind", "name", "description", "namespace", "batch_size", "sources", "sinks", "operators")
SOURCES = {"stream": ("name", "namespace", "partitions", "batch_size", "poll_interval_ms"), "ts": ("measurement", "namespace", "field", "tags", "batch_size", "poll_interval_ms", "lateness_ms")}
SINKS = {"kv": ("namespace", "key_prefix", "separator", "ttl_ms"), "queue": ("name", "namespace", "priority"), "ts": ("measurement", "namespace", "value_field", "tags", "fields"), "stream": ("name", "namespace")}
MOST = {"sources": 64, "sinks": 64, "operators": 256}
MOST_TAGS, MOST_NAME, MOST_KEY, MOST_LATENESS_MS = 32, 255, 1024, 86_400_000
LATENESS_MS, POLL_MS, BATCH = 30_000, 1000, 100


@dataclass(frozen=True)
class Endpoint:
    """A source or sink: kind, its settings with defaults filled in, its own name, and a sink's tags."""

    kind: str
    settings: dict
    name: str = ""
    match: tuple[str, ...] = ()

    @property
    def reads(self) -> str:
        """What it reads or writes: a stream or queue by name, a measurement."""
        return self.settings.get("name") or self.settings.get("measurement", "")


@dataclass(frozen=True)
class Step:
    kind: str
    settings: dict
    name: str = ""


@dataclass(frozen=True)
class Job:
    name: str
    namespace: str
    sources: tuple[Endpoint, ...]
    operators: tuple[Step, ...]
    sinks: tuple[Endpoint, ...]
    batch_size: int = BATCH
    description: str = ""


def _pairs(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise JobError(f"{k}: given twice")
        out[k] = v
    return out


def load(text: str) -> dict:
    """JSON where it parses, else YAML."""
    if text.lstrip().startswith("{"):
        try:
            return json.loads(text, object_pairs_hook=_pairs)
        except json.JSONDecodeError as e:
            raise JobError(f"not JSON: {e}") from None
    try:
        import yaml
    except ImportError:
        raise JobError("YAML needs PyYAML; give JSON") from None

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        return _pairs([(loader.construct_object(k, True), loader.construct_object(v, True)) for k, v in node.value])

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        return yaml.load(text, Loader)
    except yaml.YAMLError as e:
        raise JobError(f"not YAML: {e}") from None


class Settings:
    """A mapping of the definition with its place, which every refusal names."""

    def __init__(self, value, at: str, allowed: tuple[str, ...] | None = None):
        if not isinstance(value, dict) or not all(isinstance(k, str) for k in value):
            raise JobError(f"{at}: must be a mapping, not {value!r}")
        self.value, self.at = value, at
        for k in value:
            if k in LATER:
                raise JobError(f"{at}.{k}: not supported")
            if allowed is not None and k not in allowed:
                raise JobError(f"{at}.{k}: unknown setting")

    def _of(self, key: str, kind: type, said: str, default):
        if key not in self.value:
            return default
        v = self.value[key]
        if not isinstance(v, kind) or kind is int and isinstance(v, bool):
            raise JobError(f"{self.at}.{key}: must be {said}, not {v!r}")
        return v

    def text(self, key: str, default: str | None = "", needed: bool = False) -> str:
        if needed and key not in self.value:
            raise JobError(f"{self.at}.{key}: is required")
        return self._of(key, str, "a text", default)

    def number(self, key: str, low: int, high: int, default):
        n = self._of(key, int, "a whole number", default)
        if key in self.value and not low <= n <= high:
            raise JobError(f"{self.at}.{key}: must be {low} to {high}, not {n}")
        return n

    def list(self, key: str) -> list:
        return self._of(key, list, "a list", [])

    def texts(self, key: str) -> dict[str, str]:
        """A mapping of texts to texts."""
        found = Settings(self._of(key, dict, "a mapping", {}), f"{self.at}.{key}", None)
        return {k: found.text(k) for k in found.value}

    def choice(self, key: str, among: tuple[str, ...], default: str | None = None):
        v = self.text(key, default)
        if v is not None and v not in among:
            raise JobError(f"{self.at}.{key}: must be one of {', '.join(among)}, not {v!r}")
        return v

    def condition(self, key: str) -> str:
        text = self.text(key, needed=True)
        try:
            parse_condition(text)
        except ConditionError as e:
            raise JobError(f"{self.at}.{key}: bad condition: {e}") from None
        return text


def _items(doc: Settings, key: str) -> list[tuple[dict, str]]:
    items = doc.list(key)
    if len(items) > MOST[key]:
        raise JobError(f"{key}: more than {MOST[key]}")
    return [(x, f"{key}[{i}]") for i, x in enumerate(items)]


def _kind(item: Settings, kinds: dict[str, tuple[str, ...]]) -> tuple[str, Settings]:
    given = [k for k in kinds if k in item.value]
    if len(given) != 1:
        raise JobError(f"{item.at}: needs exactly one of {', '.join(kinds)}")
    return given[0], Settings(item.value[given[0]], f"{item.at}.{given[0]}", kinds[given[0]])


def _source(value, at: str, index: int, job_batch: int, namespace: str) -> Endpoint:
    item = Settings(value, at, (*SOURCES, "name"))
    kind, s = _kind(item, SOURCES)
    whole = 2**32 - 1
    shared = {"namespace": s.text("namespace", namespace), "batch_size": s.number("batch_size", 1, whole, job_batch), "poll_interval_ms": s.number("poll_interval_ms", 1, whole, POLL_MS)}
    if kind == "stream":
        if s.text("partitions", "all") != "all":
            raise JobError(f"{s.at}.partitions: must be all")
        own = {"name": s.text("name", needed=True)}
    else:
        own = {"measurement": s.text("measurement", needed=True), "field": s.text("field"), "tags": s.texts("tags"), "lateness_ms": s.number("lateness_ms", 0, MOST_LATENESS_MS, LATENESS_MS)}
    return Endpoint(kind, {**own, **shared}, item.text("name", f"default-source-{index}"))


def _match(item: Settings) -> tuple[str, ...]:
    given = item.value.get("match", [])
    tags = [given] if isinstance(given, str) else item.list("match")
    for i, tag in enumerate(tags):
        if not isinstance(tag, str):
            raise JobError(f"{item.at}.match[{i}]: must be a text, not {tag!r}")
    return tuple(tags)


def _sink(value, at: str, index: int, namespace: str) -> Endpoint:
    item = Settings(value, at, (*SINKS, "name", "match"))
    kind, s = _kind(item, SINKS)
    name = item.text("name", f"default-sink-{index}")
    if kind == "kv":
        own = {"key_prefix": s.text("key_prefix"), "separator": s.text("separator", ":"), "ttl_ms": s.number("ttl_ms", 1, (2**63 - 1) // 1_000_000, None)}
        if own["key_prefix"] and len((own["key_prefix"] + own["separator"]).encode()) >= MOST_KEY:
            raise JobError(f"{s.at}.key_prefix: leaves no room for a key of at most {MOST_KEY} bytes")
    elif kind == "queue":
        own = {"name": s.text("name", name), "priority": s.number("priority", 0, 255, 0)}
    elif kind == "ts":
        own = {"measurement": s.text("measurement", name), "value_field": s.text("value_field", "value"), "tags": s.texts("tags"), "fields": s.texts("fields")}
    else:
        own = {"name": s.text("name", needed=True)}
    return Endpoint(kind, {**own, "namespace": s.text("namespace", namespace)}, name, _match(item))


def _scalar(item: Settings, key: str) -> str:
    v = item.value[key]
    if isinstance(v, bool):
        return "true" if v else "false"
    if not isinstance(v, (str, int, float)):
        raise JobError(f"{item.at}.{key}: must be a text, number or boolean, not {v!r}")
    return str(v)


def _rules(item: Settings) -> list[dict[str, str]]:
    made = []
    for i, rule in enumerate(item.list("rules")):
        r = Settings(rule, f"{item.at}.rules[{i}]", ("condition", "tag"))
        made.append({"condition": r.condition("condition"), "tag": r.text("tag", needed=True)})
    return made


def _count_window(item: Settings) -> int | None:
    sizes = [k for k in ("window_size", "window_count") if k in item.value]
    if "window" not in item.value:
        if sizes:
            raise JobError(f"{item.at}.{sizes[0]}: needs window: count")
        return None
    if item.text("window") in ("tumbling", "sliding", "session"):
        raise JobError(f"{item.at}.window: {item.text('window')} is not supported")
    item.choice("window", ("count",))
    if len(sizes) != 1:
        raise JobError(f"{item.at}.window: a count window takes window_count or window_size, one of them")
    return item.number(sizes[0], 1, 2**63 - 1, None)


def _step(value, at: str, namespace: str) -> Step:
    item = Settings(value, at, None)
    kind = item.text("type", needed=True)
    if kind in RESERVED:
        raise JobError(f"{at}.type: {kind} is reserved and not supported")
    if kind not in OPERATORS:
        raise JobError(f"{at}.type: unknown operator {kind!r}")
    allowed, needed = OPERATORS[kind]
    if allowed is not None:
        item = Settings(value, at, (*allowed, "type", "name"))
    for k in needed:
        if k not in item.value:
            raise JobError(f"{at}.{k}: is required")
    name = item.text("name", kind)
    if kind == "map":
        return Step(kind, {"mapping": {k: _scalar(item, k) for k in item.value if k not in ("type", "name")}}, name)
    if kind == "classify":
        rules, other = _rules(item), item.text("default_tag", None)
        if len({r["tag"] for r in rules} | ({other} - {None})) > MOST_TAGS:
            raise JobError(f"{at}.rules: more than {MOST_TAGS} tags")
        return Step(kind, {"rules": rules, "default_tag": other}, name)
    if kind == "filter":
        return Step(kind, {"condition": item.condition("condition")}, name)
    if kind == "aggregate":
        function = item.choice("function", FUNCTIONS)
        return Step(kind, {"function": function, "field": item.text("field", None, needed=function != "count"), "window_size": _count_window(item)}, name)
    if kind == "kv_lookup":
        item.choice("mode", ("filter", "enrich"))
    made = {k: item.text(k) for k in allowed if k in item.value}
    return Step(kind, {"namespace": namespace, **made} if kind == "kv_lookup" else made, name)


def parse_job(text: str, namespace: str = "default") -> Job:
    doc = Settings(load(text), "job", TOP)
    if doc.text("kind", needed=True) != "Processing":
        raise JobError("job.kind: must be Processing")
    name, ns = doc.text("name", "unnamed-job"), doc.text("namespace", namespace)
    if len(name.encode()) > MOST_NAME:
        raise JobError(f"job.name: more than {MOST_NAME} bytes")
    batch = doc.number("batch_size", 1, 2**32 - 1, BATCH)
    sources = tuple(_source(x, at, i, batch, ns) for i, (x, at) in enumerate(_items(doc, "sources")))
    sinks = tuple(_sink(x, at, i, ns) for i, (x, at) in enumerate(_items(doc, "sinks")))
    steps = tuple(_step(x, at, ns) for x, at in _items(doc, "operators"))
    for what, some in (("sources", sources), ("sinks", sinks)):
        if not some:
            raise JobError(f"{what}: needs at least one")
        names = [s.name for s in some]
        if len(set(names)) < len(names):
            raise JobError(f"{what}: a name may appear once")
    read = [(s.reads, s.settings["namespace"]) for s in sources if s.kind == "stream"]
    if len(set(read)) < len(read):
        raise JobError("sources: a stream may appear once")
    for i, s in enumerate(sinks):
        if s.settings["namespace"] != ns:
            raise JobError(f"sinks[{i}].{s.kind}.namespace: must be the job's")
        if s.kind == "kv" and any(x.kind == "ts" for x in sources):
            raise JobError(f"sinks[{i}].kv: not with a ts source")
    if len({t for s in sinks for t in s.match}) > MOST_TAGS:
        raise JobError(f"sinks: more than {MOST_TAGS} tags to match")
    return Job(name, ns, sources, steps, sinks, batch, doc.text("description"))
