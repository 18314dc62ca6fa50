"""Ad-hoc queries on pods: select, describe, graph, counts, distinct values, etags."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.filters import document_filter, with_context
from tessera.sources.pods import Pod


@dataclass
class Page:
    """A page of rows and what its head says."""

    count: int
    offset: int
    limit: int | None
    results: DataFrame


def select(pod: Pod, query: dict, fields: list[str], sort: dict[str, int] | None = None, limit: int | None = None, offset: int = 0, context: str | None = None) -> DataFrame:
    """r, c and for each field an array of its values, literals before URIs of the same place.

    `_version` stays a number. The rows are sorted by the paths of `sort` (1 ascending by the least value, -1 descending by
    the greatest; missing values first when ascending), then by r and c. An offset counts only with a limit; a limit of 0
    means none.
    """
    rows = pod.frame.where(document_filter(pod, with_context(query, context)))
    out = [F.col(f).alias(f) if f in ("_version", "_uts") else pod.texts(f).alias(f) for f in fields if f not in ("_id", "r", "c")]
    keys = [_sort_key(pod, p, d) for p, d in (sort or {}).items()]
    if keys or limit:
        rows = rows.orderBy(*keys, "r", "c")
    if limit:
        rows = rows.offset(offset).limit(limit)
    return rows.select("r", "c", *out)


def _sort_key(pod: Pod, path: str, direction: int) -> Column:
    if path in ("_id.r", "_id.c", "_version", "_uts"):
        key = F.col(path.rpartition(".")[2])
    else:
        kind = path[-1] if path.endswith((".u", ".l")) else None
        values = pod.texts(path[:-2] if kind else path, kind)
        key = F.array_min(values) if direction > 0 else F.array_max(values)
    return key.asc_nulls_first() if direction > 0 else key.desc_nulls_last()


def page(pod: Pod, query: dict, fields: list[str], sort: dict[str, int] | None = None, limit: int | None = None, offset: int = 0, context: str | None = None) -> Page:
    """select() with the number of all rows that match."""
    total = pod.frame.where(document_filter(pod, with_context(query, context))).count()
    return Page(total, offset, limit, select(pod, query, fields, sort, limit, offset, context))


def describe(pod: Pod, query: dict) -> DataFrame:
    """All triples (c, s, p, pos, k, o) of the descriptions that match; no graph is added to the query."""
    return pod.only(document_filter(pod, query)).triples()


def describe_resources(pod: Pod, subjects: list[str], context: str | None = None) -> DataFrame:
    """All triples of the subjects named; those that aren't there give none."""
    return describe(pod, {"_id.r": {"$in": list(subjects)}, **({"_id.c": context} if context else {})})


def graph(pod: Pod, query: dict, include: list[str]) -> DataFrame:
    """describe() of the predicates in include; an empty list means all."""
    found = describe(pod, query)
    return found.where(F.col("p").isin(include)) if include else found


def count(pod: Pod, query: dict) -> DataFrame:
    """One row: count, the number of descriptions that match."""
    return pod.frame.where(document_filter(pod, query)).agg(F.count(F.lit(1)).alias("count"))


def count_by(pod: Pod, query: dict, path: str) -> DataFrame:
    """key, count: descriptions by the values of one path, joined by `;`; missing values are the key ''."""
    kind = path[-1] if path.endswith((".u", ".l")) else None
    key = F.array_join(pod.texts(path[:-2] if kind else path, kind), ";")
    return pod.frame.where(document_filter(pod, query)).groupBy(F.coalesce(key, F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def distinct_values(pod: Pod, path: str, query: dict | None = None) -> DataFrame:
    """value: the distinct values of a path, lists flattened, null left out."""
    kind = path[-1] if path.endswith((".u", ".l")) else None
    values = pod.frame.where(document_filter(pod, query or {})).select(F.explode(pod.texts(path[:-2] if kind else path, kind)).alias("value"))
    return values.where("value IS NOT NULL").distinct()


def etag(pod: Pod) -> DataFrame:
    """r, c, etag: `0.mmmmmm00 seconds` of _uts, '' where there is none."""
    micros = F.unix_micros(F.col("_uts").cast("timestamp"))
    text = F.format_string("0.%06d00 %d", F.pmod(micros, F.lit(1_000_000)), F.floor(micros / 1_000_000))
    return pod.frame.select("r", "c", F.when(micros.isNull(), F.lit("")).otherwise(text).alias("etag"))


class CountCache:
    """Counts kept for a time, by query and grouping; a count of nothing is taken anew."""

    #: Most groups that are held.
    MOST = 100_000

    def __init__(self, clock=time.time) -> None:
        self._kept: dict[str, tuple[float, object]] = {}
        self._clock = clock

    def get(self, pod: Pod, query: dict, group: str | None, ttl: float) -> object:
        """The number, or a dict by key with a grouping, as counted at most ttl seconds ago."""
        key = json.dumps([query, group], sort_keys=True, default=str)
        held = self._kept.get(key)
        if held and held[0] + ttl > self._clock() and held[1]:
            return held[1]
        if group:
            rows = count_by(pod, query, group).limit(self.MOST + 1).collect()
            if len(rows) > self.MOST:
                raise ValueError(f"more than {self.MOST} groups; count_by() gives them as a frame")
        found = {r["key"]: r["count"] for r in rows} if group else count(pod, query).first()["count"]
        self._kept[key] = (self._clock(), found)
        return found
