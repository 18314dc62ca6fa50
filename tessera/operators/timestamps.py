"""Mixed timestamp notations to one instant in UTC.

An ordered cascade of anchored patterns rewrites each notation to one layout of fields; the fields are then read strictly.
A date that does not exist gives null, never a neighbouring date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip

#: Offsets of the abbreviations of zones.
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00",
    "CET": "+01:00", "MEZ": "+01:00", "CEST": "+02:00", "MESZ": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00",
    "IST": "+05:30", "JST": "+09:00", "KST": "+09:00", "AWST": "+08:00", "ACST": "+09:30", "ACDT": "+10:30",
    "AEST": "+10:00", "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00", "NST": "-03:30", "NDT": "-02:30",
    "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00",
}
#: The English names of the months begin so.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = (
    "(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:\s*(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5}|[A-Za-z]+/[A-Za-z_+\-/0-9]+))?(?:\s*(\[[^\]]+\]|\([^)]+\)))?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"


@dataclass(frozen=True)
class Notation:
    """An anchored pattern and where its groups go in the layout year|month|day|hour|minute|second|fraction|half|zone."""

    pattern: str
    layout: str


#: In this order; the first that matches decides. Slashed dates with the year last have a layout for either order.
NOTATIONS = (
    Notation(rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:[Tt]|\s+){_TIME}{_HALF}{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10$11"),
    Notation(rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8$9"),
    Notation(rf"^(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9$10"),
    Notation(rf"^(?i:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+)?(\d{{1,2}})\s+(?i:{_MONTH})\.?,?\s+(\d{{4}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9$10"),
    Notation(rf"^(?i:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+)?(?i:{_MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9$10"),
)
SLASHED = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?$"
SLASHED_LAYOUTS = {"dmy": "$3|$2|$1|$4|$5|$6|$7|$8|$9$10", "mdy": "$3|$1|$2|$4|$5|$6|$7|$8|$9$10"}
_OFFSET = r"^[+-](?:(?:0[0-9]|1[0-7]):[0-5][0-9]|18:00)$"
_DAY = r"^(\d{4})(\d{2})(\d{2})$"


def _pairs(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def known_zones(spark: SparkSession) -> list[str]:
    """The names of zones that the session's runtime can read."""
    return sorted(str(x) for x in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


def with_instant(rows: DataFrame, value: str, zone: str, order: str) -> DataFrame:
    """rows with `_micros`, the microseconds since 1970 that `value` denotes in the zone and date order of its row.

    Null for null and blank values, words and dates or times that do not exist. An offset in the value decides, else a
    zone name or abbreviation in it, else `zone`. A local time that occurs twice means the earlier instant; one that is
    skipped moves on by the length of the gap. A date alone is 00:00 local time, missing seconds are 0, digits beyond the
    sixth are cut off. A slashed date with the year last follows `order` (`dmy`, `mdy`); without one it can't be read.
    8 digits are a date, 10 seconds, 13 milliseconds. Without any zone a local time can't be read. Names that the runtime
    doesn't know and offsets beyond 18 hours are no zones.

    Each step is a column of its own, so that no expression is evaluated for each of its uses.
    """
    text = F.col("_text")
    layout = F.lit(None).cast("string")
    steps = [(text.rlike(n.pattern), F.regexp_replace(text, n.pattern, n.layout)) for n in NOTATIONS]
    steps.append((text.rlike(_DAY), F.regexp_replace(text, _DAY, "$1|$2|$3||||||")))
    steps += [(text.rlike(SLASHED) & (F.col(order) == o), F.regexp_replace(text, SLASHED, lay)) for o, lay in SLASHED_LAYOUTS.items()]
    for test, fields in reversed(steps):
        layout = F.when(test, fields).otherwise(layout)
    fields = rows.withColumn("_text", strip(F.col(value))).withColumn("_f", F.split(layout, r"\|"))
    parsed = _read(fields, zone, known_zones(rows.sparkSession))
    return parsed.withColumn(
        "_micros",
        F.when(text.rlike(r"^\d{10}$"), F.try_multiply(text.try_cast("bigint"), F.lit(1_000_000)))
        .when(text.rlike(r"^\d{13}$"), F.try_multiply(text.try_cast("bigint"), F.lit(1_000)))
        .otherwise(F.col("_local")),
    ).drop("_text", "_f", "_zone", "_local")


def _read(fields: DataFrame, default_zone: str, zones: list[str]) -> DataFrame:
    """fields with `_local`, the instant of the layout `_f`."""
    f = F.col("_f")
    number = lambda k: f[k].try_cast("int")
    month = F.coalesce(number(1), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(f[1], 1, 3))).cast("int"))
    hour = F.coalesce(number(3), F.lit(0))
    half = F.lower(f[7])
    full = (
        F.when(half == "", hour)
        .when(~hour.between(1, 12), F.lit(None))
        .when(half == "p", F.when(hour == 12, 12).otherwise(hour + 12))
        .otherwise(F.when(hour == 12, 0).otherwise(hour))
    )
    whole = F.coalesce(number(5), F.lit(0))
    minute = F.coalesce(number(4), F.lit(0))
    sensible = full.between(0, 23) & minute.between(0, 59) & whole.between(0, 59)
    micros = F.coalesce(F.rpad(F.substring(f[6], 1, 6), 6, "0").try_cast("int"), F.lit(0))
    # A zone, then one in brackets: the first that is there decides.
    named = F.regexp_extract(f[8], r"^[\[(]?([^\[\]()]+)", 1)
    zone = (
        F.when(named == "", F.col(default_zone))
        .when(named.rlike(r"^[+-]\d{2}$"), F.concat(named, F.lit(":00")))
        .when(named.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(named, 1, 3), F.lit(":"), F.substring(named, 4, 2)))
        .when(named.rlike(r"^[+-]") | named.contains("/"), named)
        .otherwise(F.try_element_at(_pairs(ABBREVIATIONS), named))
    )
    valid = F.when(F.col("_zone").rlike(_OFFSET) | F.col("_zone").isin(zones), F.col("_zone"))
    at = F.try_make_timestamp(number(0), month, number(2), full, minute, whole.cast("decimal(16,6)"), F.col("_zone"))
    return fields.withColumn("_zone", zone).withColumn("_zone", valid).withColumn("_local", F.when(sensible & F.col("_zone").isNotNull(), F.unix_micros(at) + micros))


def utc_text(micros: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSSSSZ of microseconds since 1970, whatever the session's zone."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)"))
    text = at.cast("string")
    return F.concat(F.regexp_replace(F.substring(text, 1, 19), " ", "T"), F.lit("."), F.rpad(F.coalesce(F.substring(text, 21, 6), F.lit("")), 6, "0"), F.lit("Z"))


def normalise_timestamps(dates: DataFrame, contexts: DataFrame, fields: dict[str, str]) -> DataFrame:
    """row_id, field, utc: one row for each row and field that denotes a point in time. fields: column by name of field.

    `contexts` (c, tz, date_order) has one row per graph; repeated rows of a graph count as one, the smallest. A graph
    that isn't listed has no zone: its values need one of their own. Empty tables give an empty result.
    """
    rule = contexts.groupBy(F.col("c").alias("_graph")).agg(F.min(F.struct("tz", "date_order")).alias("_rule"))
    rows = dates.select("row_id", F.col("id.c").alias("_c"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("value")) for n, c in fields.items()])).alias("x"))
    rows = rows.where(F.col("x.value").isNotNull())
    joined = rows.join(rule, F.col("_c") == F.col("_graph"), "left")
    read = with_instant(joined.select("row_id", "x.field", "x.value", "_rule.tz", "_rule.date_order"), "value", "tz", "date_order")
    # A generator drops the values without an instant: a filter would be pushed down and evaluate everything twice.
    return read.select("row_id", "field", F.explode(F.array_compact(F.array("_micros"))).alias("_micros")).select("row_id", "field", utc_text(F.col("_micros")).alias("utc"))
