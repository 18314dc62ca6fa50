"""Document-style queries to boolean columns.

{path: value, path: {$op: operand}, $or: [...], ...}; a path is `predicate.u`, `predicate.l`, `predicate`, `_id.r`, `_id.c`,
`_id` or the name of a field. A path with several values matches if any of them does.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.pods import Pod, WidePod

Resolve = Callable[[str], Column]
_COMPARE = {"$lt": "__lt__", "$lte": "__le__", "$gt": "__gt__", "$gte": "__ge__"}
_FLAGS = "imsx"


class FilterError(ValueError):
    """A query that can't be compiled."""


def document_scope(pod: Pod) -> Resolve:
    """Paths of descriptions, each to an array<string> or, where one value is declared, to a string column."""

    def resolve(path: str) -> Column:
        if path in ("_id.r", "_id.c", "_version", "_uts", "_cts"):
            return F.col(path.rpartition(".")[2])
        if path.endswith((".u", ".l")):
            predicate, kind = path[:-2], path[-1]
            if isinstance(pod, WidePod) and pod.scalar(predicate) is not None:
                return pod.scalar(predicate) if pod.columns[predicate][0] == kind else F.lit(None).cast("string")
            return pod.texts(predicate, kind)
        return pod.texts(path)

    return resolve


def row_scope(columns: dict[str, Column]) -> Resolve:
    """Fields of rows; `value.` before a field may be left out."""

    def resolve(path: str) -> Column:
        name = path.removeprefix("value.").removeprefix("_id.")
        if name not in columns:
            raise FilterError(f"unknown field {path}")
        return columns[name]

    return resolve


def java_regex(pattern: str) -> str:
    """A pattern, with or without delimiters and flags (/x/i), as a Java pattern."""
    found = re.fullmatch(r"([/#~])(.*)\1([a-z]*)", pattern, re.DOTALL)
    if not found:
        return pattern
    flags = "".join(x for x in found[3] if x in _FLAGS)
    return (f"(?{flags})" if flags else "") + found[2].replace("\\" + found[1], found[1])


def compile_filter(query: dict, resolve: Resolve, is_array: Callable[[str], bool]) -> Column:
    """The boolean column of query; an empty query is true. A missing path fails every test but $exists: false, $ne and $nin."""
    parts = [_member(path, test, resolve, is_array) for path, test in query.items()]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _member(path: str, test: object, resolve: Resolve, is_array: Callable[[str], bool]) -> Column:
    if path in ("$or", "$and", "$nor"):
        if not isinstance(test, list) or not test:
            raise FilterError(f"{path} needs a list")
        several = [compile_filter(q, resolve, is_array) for q in test]
        if path == "$and":
            return reduce(lambda a, b: a & b, several)
        either = reduce(lambda a, b: a | b, several)
        return ~either if path == "$nor" else either
    if path.startswith("$"):
        raise FilterError(f"unsupported operator {path}")
    if path == "_id" and isinstance(test, dict) and not any(k.startswith("$") for k in test):
        return compile_filter({f"_id.{k}": v for k, v in test.items()}, resolve, is_array)
    if isinstance(test, dict) and len(test) == 1 and next(iter(test)) in ("u", "l"):
        kind, value = next(iter(test.items()))
        return _member(f"{path}.{kind}", value, resolve, is_array)
    values = resolve(path)
    many = is_array(path)
    some = (lambda f: F.coalesce(F.exists(values, f), F.lit(False))) if many else (lambda f: F.coalesce(f(values), F.lit(False)))
    if not isinstance(test, dict):
        return some(_equals(test))
    out = []
    for op, operand in test.items():
        if op == "$in":
            out.append(_any_in(values, operand) if many else F.coalesce(values.isin(list(operand)), F.lit(False)))
        elif op == "$nin":
            out.append(~_any_in(values, operand) if many else ~F.coalesce(values.isin(list(operand)), F.lit(False)))
        elif op == "$ne":
            out.append(~some(_equals(operand)))
        elif op == "$exists":
            there = (F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0) if many else values.isNotNull()
            out.append(there if operand else ~there)
        elif op in _COMPARE:
            out.append(some(_comparison(op, operand)))
        elif op == "$regex":
            pattern = (f"(?{test['$options']})" if test.get("$options") else "") + java_regex(operand)
            out.append(some(_matches(pattern)))
        elif op == "$options":
            continue
        elif op == "$all":
            out += [some(_matches(java_regex(w["$regex"]))) if isinstance(w, dict) and "$regex" in w else some(_equals(w)) for w in operand]
        elif op == "$not":
            out.append(~_member(path, operand, resolve, is_array))
        else:
            raise FilterError(f"unsupported operator {op}")
    return reduce(lambda a, b: a & b, out) if out else F.lit(True)


def _any_in(values: Column, wanted: list) -> Column:
    return F.coalesce(F.exists(values, lambda x: x.isin(list(wanted))), F.lit(False))


def _equals(wanted: object) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(wanted)


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def _comparison(op: str, operand: object) -> Callable[[Column], Column]:
    """Numbers compare with numbers: a text that is none fails."""
    if isinstance(operand, (int, float)) and not isinstance(operand, bool):
        return lambda x: getattr(x.try_cast("double"), _COMPARE[op])(F.lit(float(operand)))
    return lambda x: getattr(x, _COMPARE[op])(F.lit(operand))


def document_filter(pod: Pod, query: dict) -> Column:
    """The column of query on the descriptions of pod."""
    fixed = {"_id.r", "_id.c", "_version", "_uts", "_cts"}

    def is_array(path: str) -> bool:
        predicate = path[:-2] if path.endswith((".u", ".l")) else path
        return path not in fixed and not (path.endswith((".u", ".l")) and isinstance(pod, WidePod) and pod.scalar(predicate) is not None)

    return compile_filter(query, document_scope(pod), is_array)


def with_context(query: dict, context: str | None) -> dict:
    """query restricted to one graph: added where no _id is named, and to an _id with r and without c, also inside lists of operators."""
    if context is None:
        return query
    if any(k.startswith("$") for k in query):
        plain = {k: v for k, v in query.items() if not k.startswith("$")}
        lists = {k: [with_context(q, context) for q in v] if isinstance(v, list) else v for k, v in query.items() if k.startswith("$")}
        return {**(with_context(plain, context) if plain else {}), **lists}
    if "_id" in query:
        named = query["_id"]
        if isinstance(named, dict) and "r" in named and "c" not in named:
            return {**query, "_id": {**named, "c": context}}
        return query
    if "_id.c" in query:
        return query
    return {**query, "_id.c": context}
