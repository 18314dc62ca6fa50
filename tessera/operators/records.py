"""Records and their current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.uri import Namespaces


def with_record_key(df: DataFrame, ns: Namespaces) -> DataFrame:
    """df with the columns `_r` (canonical id.r) and `_c` (id.c).

    Rows whose id, id.r or id.c is null name no record and are left out.
    """
    return df.where(F.col("id.r").isNotNull() & F.col("id.c").isNotNull()).withColumn("_r", ns.canonical(F.col("id.r"))).withColumn("_c", F.col("id.c"))


def current_rows(keyed: DataFrame, payload: dict[str, Column], extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per record (_r, _c): the payload of its current row, and aggregates `extra` over all its rows.

    The current row has the highest _version (null is lowest), then the highest row_id; rows equal in both count once.
    The aggregation is partial before the shuffle, so a record that holds a third of all rows is no hot spot.
    """
    best = F.max_by(F.struct(*[c.alias(n) for n, c in payload.items()]), F.struct(F.col("_version"), F.col("row_id")))
    aggregates = [best.alias("_row"), *[c.alias(n) for n, c in (extra or {}).items()]]
    out = keyed.groupBy("_r", "_c").agg(*aggregates)
    return out.select("_r", "_c", *[F.col(f"_row.{n}").alias(n) for n in payload], *(extra or {}))


def current_rows_sql(table: str, columns: list[str]) -> str:
    """DuckDB's text for the current row of each record: r, c and the named columns of the table."""
    from tessera.functions.uri import canonical_of_sql

    wanted = ", ".join(columns)
    return (
        f"SELECT r, c, {wanted} FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY _version DESC NULLS LAST, row_id DESC) AS nth "
        f"FROM (SELECT {canonical_of_sql('id.r')} AS r, id.c AS c, * FROM {table} WHERE id.r IS NOT NULL AND id.c IS NOT NULL)) WHERE nth = 1"
    )
