"""Canonical URIs, prefixed names and namespaces as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip, strip_sql

#: Most prefixes that are turned into literals of a plan. A namespace table is configuration; a larger one is an error,
#: as nobody declares so many names by hand.
MAX_PREFIXES = 10_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


@dataclass(frozen=True)
class Namespaces:
    """Declared prefixes and their URIs."""

    uris: dict[str, str]

    @staticmethod
    def of(prefixes: DataFrame) -> Namespaces:
        """From a table (prefix, uri); null prefixes are left out, of repeated ones the smallest URI counts."""
        rows = prefixes.where("prefix IS NOT NULL AND uri IS NOT NULL").groupBy("prefix").agg(F.min("uri").alias("uri")).limit(MAX_PREFIXES + 1).collect()
        if len(rows) > MAX_PREFIXES:
            raise ValueError(f"more than {MAX_PREFIXES} prefixes")
        return Namespaces({r["prefix"]: r["uri"] for r in sorted(rows)})

    def _lookup(self, key: Column, table: dict[str, str]) -> Column:
        if not table:
            return F.lit(None).cast("string")
        pairs = [F.lit(x) for pair in table.items() for x in pair]
        return F.try_element_at(F.create_map(*pairs), key)

    def expand(self, name: Column) -> Column:
        """The full URI of a prefixed name; anything else unchanged."""
        found = self._lookup(F.substring_index(name, ":", 1), self.uris)
        return F.when(name.contains(":") & found.isNotNull(), F.concat(found, F.regexp_replace(name, r"^[^:]*:", ""))).otherwise(name)

    def canonical(self, uri: Column) -> Column:
        """Canonical form: no outer white space, known prefix replaced, scheme http, host in lower case, no slash at the end."""

        def normal(full: Column) -> Column:
            host = F.lower(F.regexp_extract(full, r"(?is)^https?://([^/]*)", 1))
            path = F.regexp_replace(full, r"(?is)^https?://[^/]*", "")
            return F.when(full.rlike(r"(?is)^https?://"), F.concat(F.lit("http://"), host, path)).otherwise(full)

        return F.regexp_replace(let(let(strip(uri), self.expand), normal), "/+$", "")

    def alias(self, uri: Column) -> Column:
        """The prefixed name of a full URI whose namespace (up to its last / or #) is declared; anything else unchanged."""
        by_uri: dict[str, str] = {}
        for prefix, full in sorted(self.uris.items(), reverse=True):
            by_uri[full] = prefix

        def short(full: Column) -> Column:
            space = F.regexp_extract(full, r"(?i)^(.*[/#])[a-z0-9\-_:]+$", 1)
            found = self._lookup(space, by_uri)
            return F.when(found.isNotNull(), F.concat(found, F.lit(":"), F.substring(full, F.length(space) + 1, F.length(full)))).otherwise(full)

        return let(uri, short)

    def matcher(self, column: Column, names: list[str]) -> Column:
        """True where column is one of names, prefixed or in full."""
        forms = sorted({x for n in names for x in (n, self.full(n))})
        return column.isin(forms)

    def full(self, name: str) -> str:
        """expand() of a Python string."""
        prefix, colon, rest = name.partition(":")
        return self.uris[prefix] + rest if colon and prefix in self.uris else name


def canonical_sql(full: str) -> str:
    """canonical() in DuckDB's dialect, of a value whose prefix is already expanded."""
    host = f"lower(regexp_extract({full}, '(?is)^https?://([^/]*)', 1))"
    path = f"regexp_replace({full}, '(?is)^https?://[^/]*', '')"
    return f"regexp_replace(CASE WHEN regexp_matches({full}, '(?is)^https?://') THEN 'http://' || {host} || {path} ELSE {full} END, '/+$', '')"


def expand_sql(value: str) -> str:
    """The expanded form of value by a scalar subquery on the view prefixes."""
    bare = strip_sql(value)
    return f"coalesce((SELECT any_value(x.uri) FROM prefixes x WHERE starts_with({bare}, x.prefix || ':')) || regexp_replace({bare}, '^[^:]*:', ''), {bare})"


def canonical_of_sql(value: str) -> str:
    """The whole canonical form of value in DuckDB's dialect."""
    return canonical_sql(expand_sql(value))
