"""Which composites a change touches, and their refresh.

A change is c, s, p: the predicates changed of each subject. Composites carry the impact index of all subjects that have a
part in them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.uri import Namespaces
from tessera.operators import composites
from tessera.plans import specs
from tessera.plans.compiler import of_type
from tessera.sources.pods import Pod


def indexed(rows: DataFrame, r: str = "r", c: str = "c") -> DataFrame:
    """root_r, root_c, s, c: one row for each subject in the impact index of each composite."""
    return rows.select(F.col(r).alias("root_r"), F.col(c).alias("root_c"), F.explode("impact_index").alias("x")).select("root_r", "root_c", F.col("x.r").alias("s"), F.col("x.c").alias("c"))


def impacted(rows: DataFrame, change: DataFrame, spec: dict | None = None) -> DataFrame:
    """root_r, root_c of the composites that have a changed subject in their impact index.

    With a spec only changes of predicates it mentions count (tables and search documents); without one all do (views). A
    null predicate stands for the whole subject.
    """
    if spec is not None:
        change = change.where(F.col("p").isNull() | F.col("p").isin(sorted(specs.predicates(spec))))
    keys = change.select("s", "c").distinct()
    return indexed(rows).join(keys, ["s", "c"], "left_semi").select("root_r", "root_c").distinct()


def triggered(pod: Pod, change: DataFrame, spec: dict, ns: Namespaces | None = None) -> DataFrame:
    """root_r, root_c of changed subjects that are of the spec's type and whose type changed (or all of them did): they may
    need a composite they don't have yet."""
    keys = change.where("p IS NULL OR p = 'rdf:type'").select(F.col("s").alias("root_r"), F.col("c").alias("root_c")).distinct()
    mine = pod.frame.where(of_type(pod, specs.types(spec), ns)).select("r", "c")
    return keys.join(mine, (F.col("root_r") == F.col("r")) & (F.col("root_c") == F.col("c")), "left_semi")


def to_refresh(rows: DataFrame, pod: Pod, change: DataFrame, spec: dict, ns: Namespaces | None = None) -> DataFrame:
    """root_r, root_c of every composite that has to be made anew or made at all."""
    return impacted(rows, change, spec).unionByName(triggered(pod, change, spec, ns)).distinct()


def refresh(rows: DataFrame, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the composites of keys made anew by make(keys); a subject that isn't there any more loses its composite."""
    named = keys.select(F.col("root_r").alias("r"), F.col("root_c").alias("c"))
    return composites.replace(rows, make(keys), named)


def subjects_by_spec(changes: dict[str, DataFrame]) -> DataFrame:
    """root_r, root_c, specs: each composite's subject once, with the ids of all specs to refresh. changes: keys by spec id."""
    every = reduce(DataFrame.unionByName, [k.select("root_r", "root_c", F.lit(s).alias("spec")) for s, k in changes.items()])
    return every.groupBy("root_r", "root_c").agg(F.array_sort(F.collect_set("spec")).alias("specs"))
