"""White space as Unicode defines it, in JVM expressions and in DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: The same set for regular expressions without Unicode properties.
SQL_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(value: Column) -> Column:
    """value without outer white space; null stays null."""
    return F.regexp_replace(value, f"^{_SPACE}+|{_SPACE}+$", "")


def not_blank(value: Column) -> Column:
    """True for texts with a character that is no white space; false for null."""
    return F.coalesce(value.rlike(rf"[^\p{{IsWhite_Space}}\x1c-\x1f]"), F.lit(False))


def strip_sql(value: str) -> str:
    """strip() in DuckDB's dialect."""
    return f"regexp_replace({value}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def not_blank_sql(value: str) -> str:
    """not_blank() in DuckDB's dialect."""
    return f"coalesce(length({strip_sql(value)}) > 0, false)"
