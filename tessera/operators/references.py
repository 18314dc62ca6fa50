"""References to records that do not exist.

Distributed left anti-join of the distinct foreign keys against the parent keys; only what it leaves over is joined back
to the referring rows, for the cases and for the counts per table and period.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import not_blank
from tessera.functions.uri import Namespaces
from tessera.operators.records import current_rows, with_record_key
from tessera.session import written

#: Which table the values of a predicate refer to.
TARGETS = {"dct:isVersionOf": "works", "acorn:listReferences": "lists", "dct:source": "resources"}
_KEY = ["p", "target_r", "c"]
#: A target is hot if it holds more than one link in so many; there are no more hot targets than that.
HOT_ONE_IN = 10_000


def links(resources: DataFrame, ns: Namespaces, predicates: list[str]) -> DataFrame:
    """r, c, p, target_r, arrived_at, period: each distinct reference of the current rows that are not deleted.

    Only values of kind `u` that are not blank refer to anything; null props, null entries and literals give nothing.
    The period is the month of _cts, null where that is null.
    """
    wanted = F.filter("props", lambda x: x["p"].isin(predicates) & (x["k"] == "u") & not_blank(x["v"]))
    refs = F.transform(wanted, lambda x: F.struct(x["p"].alias("p"), x["v"].alias("v")))
    now = current_rows(
        with_record_key(resources, ns),
        {"deleted_at": F.col("deleted_at"), "arrived_at": F.col("arrived_at"), "_cts": F.col("_cts"), "refs": refs},
    ).where(F.col("deleted_at").isNull())
    flat = now.select("_r", "_c", "arrived_at", "_cts", F.explode("refs").alias("ref"))
    named = flat.select(
        F.col("_r").alias("r"), F.col("_c").alias("c"), F.col("ref.p").alias("p"), ns.canonical(F.col("ref.v")).alias("target_r"),
        "arrived_at", F.date_format("_cts", "yyyy-MM").alias("period"),
    )
    # A record has one current row, so repeated references agree in everything.
    return named.distinct()


def parents(tables: dict[str, DataFrame], ns: Namespaces) -> DataFrame:
    """p, target_r, c, first_arrived of each record that exists and isn't deleted, for each predicate that refers to it."""

    def one(predicate: str, table: DataFrame) -> DataFrame:
        keyed = with_record_key(table.select("row_id", "id", "_version", "deleted_at", "arrived_at"), ns)
        rows = current_rows(keyed, {"deleted_at": F.col("deleted_at")}, {"first_arrived": F.min("arrived_at")})
        return rows.where(F.col("deleted_at").isNull()).select(F.lit(predicate).alias("p"), F.col("_r").alias("target_r"), F.col("_c").alias("c"), "first_arrived")

    return reduce(DataFrame.unionByName, [one(p, t) for p, t in tables.items()])


def dangling_references(resources: DataFrame, tables: dict[str, DataFrame], ns: Namespaces) -> tuple[DataFrame, DataFrame]:
    """(all links, dangling links); tables has the parent table of each predicate.

    A link dangles if its target doesn't exist, is deleted, or came first after the referring row. A null arrived_at on
    either side proves no late arrival. An empty parent table leaves every link to it dangling; an empty `resources`
    gives two empty results.
    """
    every = written(links(resources, ns, list(tables)), "links")
    there = parents(tables, ns)
    keys = every.groupBy(*_KEY).agg(F.min("arrived_at").alias("first_link"), F.count(F.lit(1)).alias("n"))
    held = there.select(*[F.col(k).alias(f"h_{k}") for k in _KEY], F.col("first_arrived").alias("h_first"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"h_{k}") for k in _KEY])
    in_time = F.coalesce(F.col("h_first") <= F.col("first_link"), F.lit(True))
    suspects = keys.join(held, same & in_time, "left_anti").select(*_KEY, "n")
    suspects = written(suspects.join(there, _KEY, "left").select(*_KEY, "n", "first_arrived"), "suspects")
    # A suspect without first_arrived has no living target, as one with a null arrival passes the anti-join. Where it has
    # one, only the links before its arrival dangle.
    # At most HOT_ONE_IN targets hold so large a share of all links each; they go to the links, all others meet theirs by key.
    hot_share = F.col("n") * F.lit(HOT_ONE_IN) > keys.agg(F.sum("n").alias("n")).scalar()
    hot = F.broadcast(suspects.where(hot_share))
    cold = every.join(hot.select(*_KEY), _KEY, "left_anti").join(suspects.where(~hot_share), _KEY, "inner")
    both = cold.unionByName(every.join(hot, _KEY, "inner"))
    found = both.where(F.col("first_arrived").isNull() | (F.col("first_arrived") > F.col("arrived_at")))
    return every, found.select("r", "c", "p", "target_r", "period")


def dangling_by_period(every: DataFrame, found: DataFrame) -> DataFrame:
    """p, period, links, dangling: how many references there are and how many dangle, per predicate and month."""
    total = every.groupBy("p", "period").agg(F.count(F.lit(1)).alias("links"))
    bad = found.groupBy("p", "period").agg(F.count(F.lit(1)).alias("dangling"))
    same = (F.col("t.p") == F.col("b.p")) & F.col("t.period").eqNullSafe(F.col("b.period"))
    return total.alias("t").join(bad.alias("b"), same, "left").select("t.p", "t.period", "links", F.coalesce("dangling", F.lit(0)).cast("bigint").alias("dangling"))
