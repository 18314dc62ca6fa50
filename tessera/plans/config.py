"""Configuration of stores: pods, cardinality, specifications, data sources and the log, checked when it is read."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from tessera.functions.scalars import SpecError
from tessera.functions.uri import Namespaces
from tessera.plans import specs

KINDS = ("view", "table", "search")
#: The members of a store that hold the specifications of each kind.
MEMBERS = {"view": "view_specifications", "table": "table_specifications", "search": "search_config"}
#: How many composites are made at once where nothing else is configured.
BATCHES = {"view": 25, "table": 100, "search": 100}


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass
class StoreConfig:
    """One store: its pods with their cardinality, and its specifications by kind and id."""

    name: str
    pods: dict[str, dict]
    specifications: dict[str, dict[str, dict]]
    search_provider: str | None = None
    batches: dict[str, int] = field(default_factory=dict)

    def pod(self, name: str) -> dict:
        if name not in self.pods:
            raise ConfigError(f"store {self.name} has no pod {name}; it has {', '.join(sorted(self.pods))}")
        return self.pods[name]

    def single(self, pod: str) -> list[str]:
        """The predicates that may have one value in a pod."""
        return sorted(p for p, n in self.pod(pod).get("cardinality", {}).items() if n == 1)

    def specification(self, kind: str, name: str) -> dict:
        if name not in self.specifications[kind]:
            raise ConfigError(f"store {self.name} has no {kind} specification {name}")
        return self.specifications[kind][name]

    def of_type(self, kind: str, wanted: str, ns: Namespaces) -> list[dict]:
        """The specifications of a kind for a type, written either way."""
        return [s for s in self.specifications[kind].values() if ns.full(wanted) in {ns.full(t) for t in specs.types(s)}]

    def types(self, kind: str, pod: str | None = None) -> list[str]:
        """The types that the specifications of a kind are for, each once, in order of appearance; of one pod or all."""
        found = [t for s in self.specifications[kind].values() if pod in (None, s["from"]) for t in specs.types(s)]
        return list(dict.fromkeys(found))

    def reading(self, kind: str, pod: str) -> list[dict]:
        """The specifications of a kind that read a pod anywhere in their tree."""
        return [s for s in self.specifications[kind].values() if pod in sources(s)]

    def batch(self, kind: str) -> int:
        return self.batches.get(kind, BATCHES[kind])


def sources(spec: dict) -> set[str]:
    """The pods that a specification reads."""
    out = {spec["from"]}
    for part in specs.parts(spec):
        out.update(joined.get("from", spec["from"]) for joined in part.get("joins", {}).values())
        rules = part.get("filter", [])
        out.update(rule["from"] for rule in rules if isinstance(rule, dict) and "from" in rule) if isinstance(rules, list) else None
        counts = part.get("counts", {})
        out.update(c["from"] for c in counts.values() if "from" in c) if isinstance(counts, dict) else None
    return out


@dataclass
class Config:
    """A whole configuration. level: `min` checks what is needed to run, `max` also the insides of fields and functions."""

    stores: dict[str, StoreConfig]
    ns: Namespaces
    default_context: str | None
    data_sources: dict[str, dict]
    log: dict
    raw: dict

    @staticmethod
    def of(raw: dict | str | Path | Callable[[], dict], level: str = "min") -> Config:
        """From a dict, the path of a JSON file, or a function that gives a dict."""
        if callable(raw):
            raw = raw()
        if not isinstance(raw, dict):
            raw = json.loads(Path(raw).read_text(encoding="utf-8"))
        if level not in ("min", "max"):
            raise ConfigError("the level of validation is min or max")
        for member in ("defaultContext", "data_sources", "transaction_log", "stores"):
            if member not in raw:
                raise ConfigError(f"the configuration lacks the member {member}")
        if not raw["data_sources"]:
            raise ConfigError("at least one data source has to be declared")
        known = set(raw["data_sources"])
        named = [("transaction_log", raw["transaction_log"].get("data_source"))]
        stores = {}
        for name, body in raw["stores"].items():
            named.append((f"store {name}", body.get("data_source")))
            named += [(f"pod {p} of store {name}", pod["data_source"]) for p, pod in body.get("pods", {}).items() if "data_source" in pod]
            stores[name] = _store(name, body, level)
            named += [(f"specification {s['_id']}", s["to_data_source"]) for group in stores[name].specifications.values() for s in group.values() if "to_data_source" in s]
        for where, source in named:
            if source not in known:
                raise ConfigError(f"{where} names the data source {source}, which isn't declared")
        return Config(stores, Namespaces(dict(raw.get("namespaces", {}))), raw["defaultContext"], dict(raw["data_sources"]), dict(raw["transaction_log"]), raw)

    def store(self, name: str) -> StoreConfig:
        if name not in self.stores:
            raise ConfigError(f"no store is called {name}")
        return self.stores[name]

    def serialised(self) -> str:
        """The configuration as JSON, from which of() makes it again."""
        return json.dumps(self.raw, sort_keys=True)


def _store(name: str, body: dict, level: str) -> StoreConfig:
    pods = dict(body.get("pods", {}))
    for pod, declared in pods.items():
        for predicate, most in declared.get("cardinality", {}).items():
            if most != 1 or ":" not in predicate:
                raise ConfigError(f"the cardinality of {predicate} in pod {pod} is {most}; prefixed predicates can be limited to 1")
    search = body.get("search_config", {})
    lists = {"view": body.get("view_specifications", []), "table": body.get("table_specifications", []), "search": search.get("search_specifications", [])}
    found: dict[str, dict[str, dict]] = {}
    for kind, several in lists.items():
        found[kind] = {}
        for spec in several:
            try:
                specs.validate(spec, kind, set(pods), whole=level == "max")
            except SpecError as e:
                raise ConfigError(f"store {name}: {e}") from e
            if spec["_id"] in found[kind]:
                raise ConfigError(f"store {name} has two {kind} specifications {spec['_id']}")
            found[kind][spec["_id"]] = spec
    return StoreConfig(name, pods, found, search.get("search_provider"), dict(body.get("batch_sizes", {})))
