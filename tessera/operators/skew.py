"""Per-key results where a few keys hold most records, by value-frequency compression.

Rows are grouped by key and value before they are grouped by key; all results are then derived from weighted values. The
first aggregation is partial on the map side, so a hot key sends one row per value and task, never its records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import not_blank
from tessera.functions.uri import Namespaces
from tessera.session import written


def compress(rows: DataFrame, keys: list[str], value: str, latest: str) -> DataFrame:
    """keys, value, weight, latest: the frequency of each value of each key. Null keys and values are groups of their own."""
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("weight"), F.max(latest).alias(latest))


def per_key(compressed: DataFrame, keys: list[str], value: str, latest: str) -> DataFrame:
    """keys, rows, latest, distinct_values, mode: exact, from weighted values. Null values count as rows, not as values.

    Of values that are equally frequent the smallest is the mode.
    """
    known = F.col(value).isNotNull()
    return compressed.groupBy(*keys).agg(
        F.sum("weight").alias("rows"),
        F.max(latest).alias(latest),
        F.sum(F.when(known, 1).otherwise(0)).alias("distinct_values"),
        F.min_by(value, F.when(known, F.struct(-F.col("weight"), F.col(value)))).alias("mode"),
    )


def weighted_percentile(compressed: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys, value: the smallest value that at least `share` of the key's values don't exceed, exact.

    The weighted values are range-partitioned by key and value, so a key with many different values lies in many tasks. Each task
    sums its part of every key it holds; what comes before a task is the sum of the parts of earlier ones, and only the
    part in which the share is reached is looked at value by value.
    """
    known = compressed.where(F.col(value).isNotNull()).select(*keys, value, "weight")
    # Written once, so that every look at it sees the same parts.
    ordered = written(known.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "weights")
    parts = ordered.groupBy(*keys, "_part").agg(F.sum("weight").alias("_here"))
    # One row per key and part: as many as there are keys, and tasks at most for each.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = parts.select(*keys, "_part", "_here", F.sum("_here").over(earlier).alias("_upto"), F.sum("_here").over(Window.partitionBy(*keys)).alias("_all"))
    wanted = F.lit(share) * F.col("_all")
    hit = sums.where((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_here") < wanted))
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*keys, "_part"]])
    near = ordered.alias("o").join(hit.alias("h"), same).select(*[F.col(f"o.{k}") for k in [*keys, value, "weight"]], (F.col("h._upto") - F.col("h._here")).alias("_before"), F.col("h._all").alias("_all"))
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = near.withColumn("_run", F.col("_before") + F.sum("weight").over(inside)).where(F.col("_run") >= F.lit(share) * F.col("_all"))
    return reached.groupBy(*keys).agg(F.min(value).alias(value))


def key_rows(resources: DataFrame, ns: Namespaces) -> DataFrame:
    """field, key_value, day, _cts: one row for each row of resources and key it counts for.

    The keys are id.c as stored (field id.c) and the distinct canonical values of kind `u` of rdf:type that aren't blank
    (field rdf:type). A null graph is a key of its own; null props have no types. day is the date of _cts.
    """
    typed = F.filter("props", lambda x: (x["p"] == "rdf:type") & (x["k"] == "u") & not_blank(x["v"]))
    types = F.array_distinct(F.transform(typed, lambda x: ns.canonical(x["v"])))
    pair = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("key_value"))
    both = F.concat(F.array(pair("id.c", F.col("id.c"))), F.coalesce(F.transform(types, lambda t: pair("rdf:type", t)), F.array().cast("array<struct<field:string,key_value:string>>")))
    return resources.select(F.explode(both).alias("x"), F.to_date("_cts").alias("day"), "_cts").select("x.field", "x.key_value", "day", "_cts")


def key_statistics(resources: DataFrame, ns: Namespaces) -> DataFrame:
    """field, key_value, rows, _cts (latest), distinct_values and mode of the days of _cts, for each graph and type."""
    keys = ["field", "key_value"]
    return per_key(compress(key_rows(resources, ns), keys, "day", "_cts"), keys, "day", "_cts")


def heavy_keys(statistics: DataFrame, one_in: int) -> DataFrame:
    """field, key_value of the keys that hold at least one row in `one_in`; an empty table has none.

    Every row has exactly one graph, null included, so the rows of all graphs are all rows.
    """
    statistics = written(statistics.select("field", "key_value", "rows"), "statistics")
    total = statistics.where("field = 'id.c'").agg(F.sum("rows").alias("n")).scalar()
    return statistics.where(F.col("key_value").isNotNull() & (F.col("rows") * F.lit(one_in) >= total)).select("field", "key_value")
