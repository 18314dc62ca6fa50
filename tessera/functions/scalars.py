"""Modifiers of field values and computed fields, as columns.

A field is an array<string> of its values; a modifier or a computed field may turn it into a single text, number, date or
truth value. Missing fields are null and never fail.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.filters import java_regex

MODIFIERS = ["lowercase", "join", "date"]
#: Modifiers that a program has added, each from a value and its attributes to a value.
_ADDED: dict[str, Callable] = {}
FUNCTIONS = ("conditional", "replace", "arithmetic")
COMPARISONS = (">", "<", ">=", "<=", "==", "!=", "contains", "not contains", "~=", "!~")
ARITHMETIC = ("+", "-", "*", "/", "%")


class SpecError(ValueError):
    """A specification that can't be compiled."""


@dataclass(frozen=True)
class Value:
    """A column and what it holds: `texts` (array<string>), `text`, `number` (double), `whole` (bigint), `date`, `truth`."""

    column: Column
    kind: str

    def text(self) -> Column:
        """As one text: the only value of a list, dates as milliseconds since 1970, truth as 1 or ''."""
        if self.kind == "texts":
            return F.when(F.size(self.column) == 1, F.get(self.column, F.lit(0)))
        if self.kind == "date":
            return F.unix_millis(self.column).cast("string")
        if self.kind == "truth":
            return F.when(self.column, "1").otherwise("")
        if self.kind == "number":
            return F.when(self.column == F.floor(self.column), F.floor(self.column).cast("string")).otherwise(self.column.cast("string"))
        return self.column.cast("string")

    def number(self) -> Column:
        """As a double; null for what is no number."""
        return self.text().try_cast("double") if self.kind != "number" else self.column

    def true(self) -> Column:
        """0, '0', '', an empty list and null are false."""
        if self.kind == "truth":
            return F.coalesce(self.column, F.lit(False))
        if self.kind == "texts":
            size = F.size(F.coalesce(self.column, F.array().cast("array<string>")))
            first = F.get(self.column, F.lit(0))
            return (size > 1) | ((size == 1) & F.coalesce(~first.isin("", "0"), F.lit(False)))
        return F.coalesce(~self.text().isin("", "0"), F.lit(False))


def lowercase(value: Value) -> Value:
    """Every text in lower case; a date becomes its milliseconds."""
    if value.kind == "texts":
        return Value(F.transform(value.column, F.lower), "texts")
    return Value(F.lower(value.text()), "text")


def join(value: Value, glue: str) -> Value:
    """The texts of a list with glue between them; a list without texts stays missing."""
    if value.kind == "texts":
        return Value(F.when(F.size(value.column) > 0, F.array(F.array_join(value.column, glue))).otherwise(F.array().cast("array<string>")), "texts")
    return value


def date(value: Value) -> Value:
    """A single text as a date; what can't be read is 1970-01-01, missing stays missing, lists of several stay as they are."""
    epoch = F.timestamp_millis(F.lit(0))
    return Value(F.when(value.text().isNotNull(), F.coalesce(F.try_to_timestamp(value.text()), epoch)), "date")


def register_modifier(name: str, function: Callable) -> None:
    """Adds a modifier: function(Value, attributes) -> Value, of columns only."""
    if name in MODIFIERS:
        raise SpecError(f"there is a modifier {name} already")
    MODIFIERS.append(name)
    _ADDED[name] = function


def modify(name: str, value: Value, attributes: dict) -> Value:
    """One modifier by name."""
    if name == "lowercase":
        return lowercase(value)
    if name == "join":
        return join(value, attributes.get("glue", ""))
    if name == "date":
        return date(value)
    if name in _ADDED:
        return _ADDED[name](value, attributes)
    raise SpecError(f"{name} is no modifier; there are {', '.join(MODIFIERS)}")


def literal(value: object) -> Value:
    """A constant of a specification."""
    if value is None:
        return Value(F.lit(None).cast("string"), "text")
    if isinstance(value, bool):
        return Value(F.lit(value), "truth")
    if isinstance(value, int):
        return Value(F.lit(value).cast("bigint"), "whole")
    if isinstance(value, float):
        return Value(F.lit(value), "number")
    if isinstance(value, list):
        return Value(F.array(*[F.lit(str(x)) for x in value]).cast("array<string>"), "texts")
    return Value(F.lit(str(value)), "text")


def operand(spec: object, fields: dict[str, Value]) -> Value:
    """A `$field`, an embedded function or a constant; a field that isn't there is null."""
    if isinstance(spec, str) and spec.startswith("$"):
        return fields.get(spec.replace("$", ""), literal(None))
    if isinstance(spec, dict) and len(spec) == 1 and next(iter(spec)) in FUNCTIONS:
        return compute(spec, fields)
    if isinstance(spec, list) and any(isinstance(x, str) and x.startswith("$") for x in spec):
        parts = [F.coalesce(v.column if v.kind == "texts" else F.array_compact(F.array(v.text())), F.array().cast("array<string>")) for v in (operand(x, fields) for x in spec)]
        return Value(F.concat(*parts), "texts")
    return literal(spec)


def compute(spec: dict, fields: dict[str, Value]) -> Value:
    """A computed field: one function and its arguments."""
    name, arguments = next(iter(spec.items()))
    if name == "conditional":
        return conditional(arguments, fields)
    if name == "replace":
        return replace(arguments, fields)
    if name == "arithmetic":
        return arithmetic(arguments, fields)
    raise SpecError(f"unknown function {name}")


def conditional(spec: dict, fields: dict[str, Value]) -> Value:
    """then where `if` holds, else otherwise; a branch that is left out is null."""
    test = spec.get("if")
    if not isinstance(test, list) or len(test) not in (1, 3):
        raise SpecError("'if' needs one or three items")
    holds = operand(test[0], fields).true() if len(test) == 1 else compare(operand(test[0], fields), test[1], operand(test[2], fields), test[2] if isinstance(test[2], str) else None)
    yes, no = operand(spec.get("then"), fields), operand(spec.get("else"), fields)
    if yes.kind == no.kind:
        return Value(F.when(holds, yes.column).otherwise(no.column), yes.kind)
    for branch, given in ((yes, spec.get("then")), (no, spec.get("else"))):
        if given is None:
            other = no if branch is yes else yes
            return Value(F.when(holds if other is yes else ~holds, other.column), other.kind)
    if {yes.kind, no.kind} <= {"whole", "number"}:
        return Value(F.when(holds, yes.number()).otherwise(no.number()), "number")
    return Value(F.when(holds, yes.text()).otherwise(no.text()), "text")


def compare(left: Value, operator: str, right: Value, pattern: str | None = None) -> Column:
    """Numbers compare as numbers where both sides are numbers, else as texts; a comparison with null is false, but != and the
    negations are true. pattern: the constant of a regular expression, with or without delimiters."""
    if operator not in COMPARISONS:
        raise SpecError(f"{operator} compares nothing; use one of {' '.join(COMPARISONS)}")
    if operator in ("contains", "not contains"):
        if left.kind == "texts":
            found = F.array_contains(left.column, right.text()) | ((F.size(left.column) == 1) & F.get(left.column, F.lit(0)).contains(right.text()))
        else:
            found = left.text().contains(right.text())
        found = F.coalesce(found, F.lit(False))
        return ~found if operator.startswith("not") else found
    if operator in ("~=", "!~"):
        subject = left.text() if left.kind != "texts" else F.array_join(left.column, "\n")
        found = F.coalesce(F.regexp_like(subject, F.lit(java_regex(pattern or ""))), F.lit(False))
        return ~found if operator == "!~" else found
    a, b = left.number(), right.number()
    x, y = left.text(), right.text()
    if left.kind == "date" or right.kind == "date":
        a, b = _millis(left), _millis(right)
    both = a.isNotNull() & b.isNotNull()
    ops = {">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}
    result = F.when(both, getattr(a, ops[operator])(b)).otherwise(getattr(x, ops[operator])(y))
    if operator in ("==", "!="):
        same = F.when(both, a == b).otherwise(x.eqNullSafe(y))
        return same if operator == "==" else ~same
    return F.coalesce(result, F.lit(False))


def _millis(value: Value) -> Column:
    if value.kind == "date":
        return F.unix_millis(value.column).cast("double")
    return F.coalesce(F.unix_millis(F.try_to_timestamp(value.text())).cast("double"), value.number())


def replace(spec: dict, fields: dict[str, Value]) -> Value:
    """Texts of subject with each search replaced in turn; a list of replacements goes with a list of searches."""
    subject = operand(spec["subject"], fields)
    searches = spec["search"] if isinstance(spec["search"], list) else [spec["search"]]
    given = spec["replace"]
    replacements = given if isinstance(given, list) else [given] * len(searches)
    replacements = replacements + [""] * (len(searches) - len(replacements))

    def apply(text: Column) -> Column:
        for one, other in zip(searches, replacements, strict=False):
            text = F.replace(text, operand(one, fields).text(), F.coalesce(operand(other, fields).text(), F.lit("")))
        return text

    if subject.kind == "texts":
        return Value(F.transform(subject.column, apply), "texts")
    return Value(apply(subject.text()), "text")


def arithmetic(spec: list, fields: dict[str, Value]) -> Value:
    """[left, operator, right], either side nested; % is of whole numbers, a division by zero or of what is no number is null."""
    if len(spec) != 3 or spec[1] not in ARITHMETIC:
        raise SpecError(f"arithmetic takes left, one of {' '.join(ARITHMETIC)}, and right")
    side = lambda x: arithmetic(x, fields) if isinstance(x, list) else operand(x, fields)
    a, b = side(spec[0]).number(), side(spec[2]).number()
    if spec[1] == "%":
        return Value(F.try_mod(a.cast("bigint"), b.cast("bigint")).cast("double"), "number")
    if spec[1] == "/":
        return Value(F.try_divide(a, b), "number")
    return Value({"+": a + b, "-": a - b, "*": a * b}[spec[1]], "number")
