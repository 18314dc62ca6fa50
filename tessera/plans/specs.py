"""Validation of view, table and search specifications, and what they mention."""

from __future__ import annotations

import re
from collections.abc import Iterator

from tessera.functions.scalars import ARITHMETIC, COMPARISONS, FUNCTIONS, MODIFIERS, SpecError


def validate(spec: dict, kind: str, pods: set[str] | None = None, whole: bool = True) -> None:
    """Raises SpecError where spec (kind: view, table or search) can't be used. Not `whole`: the insides of a table's fields and
    functions aren't looked at."""
    for needed in ("_id", "from", "type"):
        if not spec.get(needed):
            raise SpecError(f"a {kind} has no {needed}: {spec.get('_id', spec)}")
    if pods is not None and spec["from"] not in pods:
        raise SpecError(f"{spec['_id']} reads the pod {spec['from']}, which isn't declared")
    if kind == "view":
        if "joins" not in spec:
            raise SpecError(f"the view {spec['_id']} has no joins; an empty member is allowed")
        for part in parts(spec):
            if "counts" in part and "ttl" not in spec:
                raise SpecError(f"the view {spec['_id']} counts, so it needs a ttl")
    elif kind == "search":
        if "filter" not in spec:
            raise SpecError(f"{spec['_id']} doesn't say by a filter which descriptions are searched")
        if not spec.get("fields") and not spec.get("joins"):
            raise SpecError(f"{spec['_id']} has neither fields nor joins, so nothing would be found")
    else:
        if not any(spec.get(k) for k in ("fields", "counts", "joins", "computed_fields")):
            raise SpecError(f"the table {spec['_id']} has no column of any kind")
        if not whole:
            return
        for part in parts(spec):
            for field in part.get("fields", []):
                _validate_field(field)
            for count in part.get("counts", []):
                if "fieldName" not in count or "property" not in count:
                    raise SpecError(f"a count of {spec['_id']} lacks its fieldName or property")
            if part is not spec and "computed_fields" in part:
                raise SpecError(f"computed fields of {spec['_id']} stand below a join; only the root can have them")
        known = set(field_names(spec))
        for field in spec.get("computed_fields", []):
            if "fieldName" not in field or len(field.get("value", {})) != 1:
                raise SpecError(f"a computed field of {spec['_id']} needs a fieldName and exactly one function")
            _validate_function(field["value"], known)


def _validate_field(field: dict) -> None:
    if "fieldName" not in field:
        raise SpecError(f"a field has no fieldName: {field}")
    if "predicates" not in field and "value" not in field:
        raise SpecError(f"nothing says what the field {field['fieldName']} holds: predicates or a value")
    if field.get("value") not in (None, "link", "_link_"):
        raise SpecError(f"the field {field['fieldName']} has the value {field['value']}; only link is known")
    for predicate in field.get("predicates", []):
        _validate_predicate(predicate)


def _validate_predicate(predicate: object) -> None:
    if isinstance(predicate, dict):
        for name, inner in predicate.items():
            if name not in MODIFIERS:
                raise SpecError(f"{name} is no modifier; there are {', '.join(MODIFIERS)}")
            for one in inner.get("predicates", []):
                _validate_predicate(one)
            nested = {k: v for k, v in inner.items() if k in MODIFIERS}
            if nested:
                _validate_predicate(nested)


def _validate_function(function: dict, known: set[str]) -> None:
    name, body = next(iter(function.items()))
    if name not in FUNCTIONS:
        raise SpecError(f"{name} is no function of computed fields; there are {', '.join(FUNCTIONS)}")
    if name == "conditional":
        test = body.get("if")
        if not isinstance(test, list) or len(test) not in (1, 3) or ("then" not in body and "else" not in body):
            raise SpecError("a conditional needs one or three items in `if`, and at least one branch")
        if len(test) == 3 and test[1] not in COMPARISONS:
            raise SpecError(f"{test[1]} compares nothing; use one of {' '.join(COMPARISONS)}")
    if name == "arithmetic" and (len(body) != 3 or body[1] not in ARITHMETIC):
        raise SpecError(f"arithmetic takes left, one of {' '.join(ARITHMETIC)}, and right")
    if name == "replace" and not {"search", "replace", "subject"} <= set(body):
        raise SpecError("a replacement needs search, replace and subject")
    for inner in body.values() if isinstance(body, dict) else body:
        for one in inner if isinstance(inner, list) else [inner]:
            if isinstance(one, str) and one.startswith("$") and one.replace("$", "") not in known:
                raise SpecError(f"{one} is no field of this table")
            if isinstance(one, dict) and len(one) == 1 and next(iter(one)) in FUNCTIONS:
                _validate_function(one, known)


def parts(spec: dict) -> Iterator[dict]:
    """spec and everything joined to it, at any depth."""
    yield spec
    for joined in spec.get("joins", {}).values():
        yield from parts(joined)


def field_names(spec: dict) -> list[str]:
    """The names of all fields, in order of appearance."""
    names = [f["fieldName"] for part in parts(spec) for key in ("fields", "counts", "indices", "computed_fields") for f in part.get(key, []) if isinstance(f, dict)]
    return list(dict.fromkeys(names))


def temporary_fields(spec: dict) -> set[str]:
    """Fields that are there for computed fields only."""
    return {f["fieldName"] for part in parts(spec) for key in ("fields", "counts", "computed_fields") for f in part.get(key, []) if isinstance(f, dict) and f.get("temporary")}


def types(spec: dict) -> list[str]:
    """The types of a spec, as a list."""
    return spec["type"] if isinstance(spec["type"], list) else [spec["type"]]


def _names(predicate: object) -> Iterator[str]:
    if isinstance(predicate, str):
        yield predicate
    elif isinstance(predicate, dict):
        for name, inner in predicate.items():
            if name == "predicates":
                for one in inner:
                    yield from _names(one)
            elif isinstance(inner, dict):
                yield from _names(inner)


def _in_condition(condition: object) -> Iterator[str]:
    """Predicates named before .u or .l in a condition, at any depth."""
    if isinstance(condition, dict):
        for key, inner in condition.items():
            found = re.fullmatch(r"([\w-]+:[\w-]+)\.[ul]", key)
            if found:
                yield found[1]
            elif re.fullmatch(r"[\w-]+:[\w-]+", key):
                yield key
            yield from _in_condition(inner)
    elif isinstance(condition, list):
        for inner in condition:
            yield from _in_condition(inner)
    elif isinstance(condition, str):
        yield from re.findall(r"([\w-]+:[\w-]+)\.[ul]\b", condition)


def predicates(spec: dict) -> set[str]:
    """Every predicate that spec depends on: of type, filters, fields, indices, counts and joins."""
    out = {"rdf:type"}
    for part in parts(spec):
        for field in [*part.get("fields", []), *part.get("indices", [])]:
            for predicate in field.get("predicates", []):
                out.update(_names(predicate))
        for count in part.get("counts", []) if isinstance(part.get("counts"), list) else part.get("counts", {}).values():
            if "property" in count:
                out.add(count["property"])
            out.update(_in_condition(count.get("filter", {})))
        for rule in part.get("filter", []) if isinstance(part.get("filter"), list) else [{"condition": part.get("filter", {})}]:
            out.update(_in_condition(rule.get("condition", {})))
        out.update(_in_condition(part.get("condition", {})))
        out.update(p for p in part.get("include", []) if p != "_seq_")
        out.update(p for p in part.get("joins", {}) if p not in ("_id", "followSequence"))
    return {p for p in out if not p.startswith("_")}
