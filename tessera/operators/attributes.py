"""Entity, attribute and value rows into one wide typed row per entity.

The entity-by-attribute grid is completed, the values are left-joined to it, the cells of an entity are collected as an
array sorted by attribute position, and fixed places of that array are projected through try casts of each type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import not_blank, strip
from tessera.functions.uri import Namespaces

#: Most declared attributes, as each becomes a column and a cell of every entity.
MAX_ATTRIBUTES = 2_000
#: How a text of each type is written.
FORMS = {"integer": r"^[+-]?[0-9]+$", "decimal": r"^[+-]?[0-9]+(\.[0-9]+)?$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "boolean": r"(?i)^(true|false|1|0)$"}

#: The typed texts that the columns of these types hold unchanged.
HELD = {"integer": r"^-?[0-9]{1,38}$", "decimal": r"^-?[0-9]{1,26}(\.[0-9]{1,12})?$"}


@dataclass(frozen=True)
class Attribute:
    """A declared attribute; its place is the index of its column."""

    name: str
    data_type: str
    many: bool
    place: int

    @property
    def column(self) -> str:
        return re.sub(r"\W", "_", self.name)


def declared(predicates: DataFrame) -> list[Attribute]:
    """The declared attributes in the order of their names; null names are left out, of repeated ones the smallest row counts."""
    rows = predicates.where("p IS NOT NULL").groupBy("p").agg(F.min(F.struct("data_type", "multiplicity")).alias("d")).limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    return [Attribute(r["p"], r["d"]["data_type"] or "string", r["d"]["multiplicity"] == "many", k) for k, r in enumerate(sorted(rows, key=lambda r: r["p"]))]


def typed_text(value: Column, data_type: Column) -> Column:
    """A text that is equal for equal typed values, exact at any length; null where value isn't of the type.

    value has no outer white space. integer and decimal lose sign `+`, leading and trailing zeros; a boolean is true or
    false; a date must exist; a string stays as it is.
    """
    sign = F.when(value.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_replace(F.regexp_replace(value, r"^[+-]|\..*$", ""), r"^0+", "")
    part = F.regexp_replace(F.regexp_replace(value, r"^[^.]*\.?", ""), r"0+$", "")
    number = F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")))
    number = F.when(number == "0", number).otherwise(F.concat(sign, number))
    date = value.try_cast("date")
    return (
        F.when(data_type == "integer", F.when(value.rlike(FORMS["integer"]), number))
        .when(data_type == "decimal", F.when(value.rlike(FORMS["decimal"]), number))
        .when(data_type == "date", F.when(value.rlike(FORMS["date"]) & date.isNotNull(), value))
        .when(data_type == "boolean", F.when(value.rlike(FORMS["boolean"]), F.lower(value).isin("true", "1").cast("string")))
        .otherwise(value)
    )


def cells(triples: DataFrame, attributes: list[Attribute], ns: Namespaces) -> DataFrame:
    """The completed grid: s, c, place and the summary of the values of that cell (n, bad, low, high, values).

    Entities are all (canonical s, c); rows with a null s or c belong to none and are left out. Attributes that aren't
    declared have no cell, their entities stay. Null and blank values count as none. `values` holds the distinct typed
    values of attributes of multiplicity `many` in the order of their first position.
    """
    names = {ns.full(a.name): a for a in attributes}
    spelled = F.create_map(*[F.lit(x) for full, a in names.items() for x in (full, a.place)]) if names else F.lit(None)
    kinds = F.array(*[F.struct(F.lit(a.data_type).alias("t"), F.lit(a.many).alias("m")) for a in attributes])
    rows = triples.where(F.col("s").isNotNull() & F.col("c").isNotNull()).select(
        ns.canonical(F.col("s")).alias("s"), "c", F.try_element_at(spelled, ns.canonical(F.col("p"))).alias("place"), F.col("pos").alias("at"),
        F.when(not_blank(F.col("o")), strip(F.col("o"))).alias("o"),
    )
    kind = F.get(kinds, F.col("place"))
    typed = rows.withColumn("t", F.when(F.col("o").isNotNull(), typed_text(F.col("o"), kind["t"]))).withColumn("many", F.coalesce(kind["m"], F.lit(False)))
    # Equal values of a cell fall together here, before the shuffle already; what is left grows with the distinct values.
    distinct = typed.groupBy("s", "c", "place", "many", "t").agg(
        F.sum(F.when(F.col("o").isNotNull(), 1).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("o").isNotNull() & F.col("t").isNull(), 1).otherwise(0)).alias("bad"),
        F.min("at").alias("at"),
    )
    summary = distinct.groupBy("s", "c", "place").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("t").alias("low"), F.max("t").alias("high"),
        F.collect_list(F.when(F.col("many") & F.col("t").isNotNull(), F.struct("at", "t"))).alias("listed"),
    )
    grid = summary.select("s", "c").distinct().select("s", "c", F.explode(F.array(*[F.lit(a.place) for a in attributes]).cast("array<int>")).alias("place"))
    return grid.join(summary.where(F.col("place").isNotNull()), ["s", "c", "place"], "left").select(
        "s", "c", "place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"), "low", "high",
        F.transform(F.array_sort("listed"), lambda x: x["t"]).alias("values"),
    )


def wide(grid: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """One row per entity: s, c, a typed column per attribute, and `unheld`, the attributes of multiplicity one whose
    values don't fit one typed column (a value that isn't of the type, or two that differ), and `beyond`, the attributes with
    a value that is of the type but has more digits than its column.

    The column of the unheld is null, as is that of an attribute without values; integers are decimal(38,0), decimals
    decimal(38,12) (26 digits before and 12 behind the point), null beyond that and never rounded. Attributes of multiplicity
    `many` give arrays of the values that are of the type, with null for those beyond.
    """
    row = F.array_sort(F.collect_list(F.struct("place", "n", "bad", "low", "high", "values")))
    rows = grid.groupBy("s", "c").agg(row.alias("cells"))
    casts = {"integer": "decimal(38,0)", "decimal": "decimal(38,12)", "date": "date", "boolean": "boolean"}
    columns, unheld, beyond = [], [], []
    for a in attributes:
        cell = F.col("cells")[a.place]
        to = casts.get(a.data_type, "string")
        if a.many:
            columns.append(_casts(cell["values"], a.data_type, to).alias(a.column))
            if a.data_type in HELD:
                beyond.append(F.when(_any_beyond(cell["values"], a.data_type), F.lit(a.name)))
        else:
            misfit = (cell["bad"] > 0) | F.coalesce(cell["low"] != cell["high"], F.lit(False))
            columns.append(F.when(~misfit & _held(cell["low"], a.data_type), cell["low"].try_cast(to)).alias(a.column))
            if a.data_type in HELD:
                beyond.append(F.when(~misfit & ~_held(cell["low"], a.data_type), F.lit(a.name)))
            unheld.append(F.when(misfit, F.lit(a.name)))
    listed = {n: F.array_compact(F.array(*names).cast("array<string>")).alias(n) for n, names in (("unheld", unheld), ("beyond", beyond))}
    return rows.select("s", "c", *columns, *listed.values())


def _held(text: Column, data_type: str) -> Column:
    return text.rlike(HELD[data_type]) if data_type in HELD else F.lit(True)


def _any_beyond(values: Column, data_type: str) -> Column:
    return F.exists(values, lambda x: ~_held(x, data_type))


def _casts(values: Column, data_type: str, to: str) -> Column:
    return F.transform(values, lambda x: F.when(_held(x, data_type), x.try_cast(to)))


def unheld_values(rows: DataFrame) -> DataFrame:
    """s, c, p of the cells that wide() can't hold."""
    return rows.select("s", "c", F.explode("unheld").alias("p"))
