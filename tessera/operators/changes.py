"""Saves: cardinality, change sets applied to descriptions, versions, the transaction log and its replay, locks."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graphs

KEY = ["c", "s"]


class CardinalityError(ValueError):
    """A predicate that may have one value has several."""


class ChangeError(ValueError):
    """A removal of a triple that isn't there."""


def cardinality_violations(triples: DataFrame, single: list[str]) -> DataFrame:
    """c, s, p, values: predicates declared single that have several distinct values."""
    counted = triples.where(F.col("p").isin(single)).groupBy("c", "s", "p").agg(F.count_distinct("k", "o").alias("values"))
    return counted.where("values > 1")


def check_cardinality(triples: DataFrame, single: list[str]) -> None:
    """Raises CardinalityError for the first violation."""
    found = cardinality_violations(triples, single).orderBy("c", "s", "p").first()
    if found:
        raise CardinalityError(f"{found['s']} would have {found['values']} different values of {found['p']}, which may have one")


def group_changes(change: DataFrame) -> DataFrame:
    """c, s, p, additions, removals: the values to add and remove, as sorted arrays of kind and value."""
    pick = lambda op: F.array_sort(F.collect_set(F.when(F.col("op") == op, F.concat_ws(" ", "k", "o"))))
    return change.groupBy(*KEY, "p").agg(pick("add").alias("additions"), pick("remove").alias("removals"))


def missing_removals(triples: DataFrame, change: DataFrame) -> DataFrame:
    """The removals of triples that are neither there nor added by the same change."""
    keys = [*KEY, "p", "k", "o"]
    there = triples.select(*keys).union(change.where("op = 'add'").select(*keys))
    return change.where("op = 'remove'").join(there, keys, "left_anti")


def apply_changes(triples: DataFrame, change: DataFrame, strict: bool = True) -> DataFrame:
    """triples (c, s, p, pos, k, o) with change (c, s, p, k, o, op) applied: additions come after the values there, equal values
    count once. strict: a removal of what isn't there raises ChangeError."""
    keys = [*KEY, "p", "k", "o"]
    if strict and not missing_removals(triples, change).isEmpty():
        raise ChangeError("a removal isn't in the description")
    added = change.where("op = 'add'").select(*keys, F.lit(1_000_000).alias("pos"))
    removed = change.where("op = 'remove'").select(*keys)
    every = triples.select(*keys, "pos").unionByName(added).groupBy(*keys).agg(F.min("pos").alias("pos"))
    return every.join(removed, keys, "left_anti")


def next_versions(versions: DataFrame, change: DataFrame, now: datetime) -> DataFrame:
    """c, s, _version, _cts, _uts after change: a new subject gets version 0, a changed one the next; others stay."""
    touched = change.select(*KEY).distinct().withColumn("_touched", F.lit(True))
    joined = versions.join(touched, KEY, "full")
    return joined.select(
        *KEY,
        F.when(F.col("_touched").isNull(), F.col("_version")).otherwise(F.coalesce(F.col("_version") + 1, F.lit(0))).alias("_version"),
        F.coalesce("_cts", F.lit(now)).alias("_cts"),
        F.when(F.col("_touched").isNull(), F.col("_uts")).otherwise(F.lit(now)).alias("_uts"),
    )


def save(before: DataFrame, after: DataFrame, store: DataFrame, context: str, single: list[str]) -> tuple[DataFrame, DataFrame]:
    """(store after the change from before to after in one graph, the change): cardinality is checked first, and a removal of
    what the store lacks raises, so a failed save changes nothing."""
    check_cardinality(after.withColumn("c", F.lit(context)), single)
    change = graphs.changes(before, after).withColumn("c", F.lit(context))
    return apply_changes(store, change), change


def completed(log: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The completed transactions of a period (both ends included); in_order() sorts them by their end."""
    tests = [F.col("status") == "completed"]
    tests += [F.col("end_time") >= F.lit(since)] if since else []
    tests += [F.col("end_time") <= F.lit(until)] if until else []
    return log.where(reduce(lambda a, b: a & b, tests))


def in_order(log: DataFrame) -> DataFrame:
    """Transactions by their end, those that ended together by their id."""
    return log.orderBy("end_time", "id")


def replay(log: DataFrame, since: datetime | None = None, until: datetime | None = None, into: DataFrame | None = None) -> DataFrame:
    """r, c, document: the last written description of each subject of the completed transactions (id, end_time, status, r, c,
    document), put over those of `into`. Of transactions that ended together the greatest id counts. A null document is a
    deletion."""
    last = completed(log, since, until).groupBy("r", "c").agg(F.max_by(F.struct("document"), F.struct("end_time", "id")).alias("x")).select("r", "c", "x.document")
    if into is None:
        return last.where("document IS NOT NULL")
    rest = into.select("r", "c", "document").join(last, ["r", "c"], "left_anti")
    return rest.unionByName(last.where("document IS NOT NULL"))


def transaction_counts(log: DataFrame) -> DataFrame:
    """status, transactions: how many transactions are in each state."""
    return log.groupBy("status").agg(F.count_distinct("id").alias("transactions"))


def purge(log: DataFrame, before: datetime) -> DataFrame:
    """The log without completed transactions that ended before a time."""
    return log.where(~F.coalesce((F.col("status") == "completed") & (F.col("end_time") < F.lit(before)), F.lit(False)))


def locks_between(locks: DataFrame, since: datetime | None, until: datetime | None) -> DataFrame:
    """The locks (r, c, transaction_id, locked_at) set in a period, both ends included, by transaction."""
    tests = ([F.col("locked_at") >= F.lit(since)] if since else []) + ([F.col("locked_at") <= F.lit(until)] if until else [])
    return (locks.where(reduce(lambda a, b: a & b, tests)) if tests else locks).orderBy("transaction_id", "r", "c")


def remove_locks(locks: DataFrame, transaction_id: str, reason: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(the other locks, audit rows of those removed)."""
    mine = F.coalesce(F.col("transaction_id") == transaction_id, F.lit(False))
    audit = locks.where(mine).select(F.lit("REMOVE_INERT_LOCKS").alias("type"), F.lit("completed").alias("status"), F.lit(reason).alias("reason"), "transaction_id", "r", "c", F.lit(now).alias("_cts"))
    return locks.where(~mine), audit
