"""Stored composites (table rows, views, search documents): reading, paging, searching, deleting and replacing them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.adhoc import Page
from tessera.plans.filters import compile_filter, java_regex, row_scope
from tessera.sources.pods import PropsPod

#: Words that a search leaves out.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be", "because",
    "been", "before", "being", "below", "between", "both", "but", "by", "can't", "cannot", "could", "couldn't", "did", "didn't", "do",
    "does", "doesn't", "doing", "don't", "down", "during", "each", "few", "for", "from", "further", "had", "hadn't", "has", "hasn't",
    "have", "haven't", "having", "he", "he'd", "he'll", "he's", "her", "here", "here's", "hers", "herself", "him", "himself", "his",
    "how", "how's", "i", "i'd", "i'll", "i'm", "i've", "if", "in", "into", "is", "isn't", "it", "it's", "its", "itself", "let's", "me",
    "more", "most", "mustn't", "my", "myself", "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other", "ought", "our",
    "ours", "ourselves", "out", "over", "own", "same", "shan't", "she", "she'd", "she'll", "she's", "should", "shouldn't", "so", "some",
    "such", "than", "that", "that's", "the", "their", "theirs", "them", "themselves", "then", "there", "there's", "these", "they",
    "they'd", "they'll", "they're", "they've", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "wasn't",
    "we", "we'd", "we'll", "we're", "we've", "were", "weren't", "what", "what's", "when", "when's", "where", "where's", "which", "while",
    "who", "who's", "whom", "why", "why's", "with", "won't", "would", "wouldn't", "you", "you'd", "you'll", "you're", "you've", "your",
    "yours", "yourself", "yourselves",
)


class SearchError(ValueError):
    """A search that can't be run."""


def row_filter(rows: DataFrame, query: dict) -> Column:
    """A document-style query on the columns of rows."""
    kinds = dict(rows.dtypes)
    plain = lambda path: path.removeprefix("value.").removeprefix("_id.")
    return compile_filter(query, row_scope({n: F.col(n) for n in rows.columns}), lambda path: kinds.get(plain(path), "").startswith("array"))


def table_rows(rows: DataFrame, query: dict | None = None, sort: dict[str, int] | None = None, offset: int = 0, limit: int = 10) -> DataFrame:
    """A page of table rows without their impact index; an array sorts by its least or greatest value, r and c break ties. A
    limit of 0 means all rows, and no offset."""
    kinds = dict(rows.dtypes)
    out = rows.where(row_filter(rows, query or {}))
    keys = []
    for path, direction in (sort or {}).items():
        name = path.removeprefix("value.").removeprefix("_id.")
        column = F.col(name)
        if kinds[name].startswith("array"):
            column = F.array_min(column) if direction > 0 else F.array_max(column)
        keys.append(column.asc_nulls_first() if direction > 0 else column.desc_nulls_last())
    if keys or limit:
        out = out.orderBy(*keys, "r", "c")
    if limit:
        out = out.offset(offset).limit(limit)
    return out.drop("impact_index")


def table_page(rows: DataFrame, query: dict | None = None, sort: dict[str, int] | None = None, offset: int = 0, limit: int = 10, include_count: bool = True) -> Page:
    """table_rows() with the number of all matching rows, or -1 where it isn't wanted."""
    total = rows.where(row_filter(rows, query or {})).count() if include_count else -1
    return Page(total, offset, limit, table_rows(rows, query, sort, offset, limit))


def distinct_column_values(rows: DataFrame, field: str, query: dict | None = None) -> DataFrame:
    """value: the distinct values of a field, lists flattened, null left out; an unknown field has none."""
    name = field.removeprefix("value.")
    if name not in rows.columns:
        return rows.select(F.lit(None).cast("string").alias("value")).where(F.lit(False))
    values = F.explode(name) if dict(rows.dtypes)[name].startswith("array") else F.col(name)
    return rows.where(row_filter(rows, query or {})).select(values.alias("value")).where("value IS NOT NULL").distinct()


def count_rows(rows: DataFrame, query: dict | None = None) -> DataFrame:
    """One row: count, the composites that match."""
    return rows.where(row_filter(rows, query or {})).agg(F.count(F.lit(1)).alias("count"))


def scalars_where_single(rows: DataFrame) -> DataFrame:
    """Arrays of texts as one text each: null, the only value, or the values as JSON."""
    one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0))).when(F.size(c) > 1, F.to_json(F.col(c)))
    return rows.select(*[one(c).alias(c) if t == "array<string>" else F.col(c) for c, t in rows.dtypes])


def query_views(views: DataFrame, query: dict) -> DataFrame:
    """The views of which some graph matches query."""
    from tessera.plans.filters import document_filter

    flat = views.select(F.col("r").alias("view_r"), F.col("c").alias("view_c"), F.posexplode("graphs").alias("place", "g")).select("view_r", "view_c", "g.r", "g.c", "g.props")
    pod = PropsPod(flat)
    keys = flat.where(document_filter(pod, query)).select(F.col("view_r").alias("r"), F.col("view_c").alias("c")).distinct()
    return views.join(keys, ["r", "c"], "left_semi")


def missing_views(wanted: DataFrame, views: DataFrame, now: datetime | None = None) -> DataFrame:
    """r, c of wanted subjects without a view, or with one that has expired."""
    at = F.lit(now) if now else F.current_timestamp()
    fresh = views.where(F.col("expires").isNull() | (F.col("expires") > at))
    return wanted.select("r", "c").distinct().join(fresh.select("r", "c"), ["r", "c"], "left_anti")


def delete_by_keys(stored: DataFrame, keys: DataFrame, kind: str | None = None) -> DataFrame:
    """stored without the composites of keys (r, c), of one type or of all."""
    if kind is not None:
        keys = keys.withColumn("type", F.lit(kind))
    return stored.join(keys.distinct(), keys.columns, "left_anti")


def delete_by_type(stored: DataFrame, kind: str, before: datetime | None = None) -> DataFrame:
    """stored without the composites of a type; with `before` only those that were made earlier or at no known time."""
    doomed = F.col("type") == kind
    if before is not None:
        doomed &= F.col("_cts").isNull() | (F.col("_cts") < F.lit(before))
    return stored.where(~F.coalesce(doomed, F.lit(False)))


def replace(stored: DataFrame, made: DataFrame, keys: DataFrame) -> DataFrame:
    """stored with the composites of keys taken out and those of made put in: every replaced row is replaced whole."""
    return delete_by_keys(stored, keys).unionByName(made)


def search_terms(text: str) -> list[str]:
    """The words of a search in lower case without stop words; all of them where only stop words are left."""
    words = [w for w in text.lower().strip().split(" ") if w]
    kept = [w for w in words if w not in STOP_WORDS]
    return kept or words


def search(documents: DataFrame, text: str, kind: str, indices: list[str], fields: list[str], limit: int = 10, offset: int = 0, raw: bool = False) -> DataFrame:
    """Documents of a type of which one index has every term of text (as a part of any of its values), in the order of r and c.

    Terms are taken literally; with raw as regular expressions. Missing fields are ''. A limit of 0 means all.
    """
    if not text or not kind or not indices or not fields:
        raise SearchError("a search needs a text, a type, indices and fields")
    for n in (limit, offset):
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise SearchError("limit and offset are whole numbers of 0 or more")
    terms = search_terms(text)
    within = lambda i: _all(F.coalesce(F.exists(i, _has(t, raw)), F.lit(False)) for t in terms)
    some = None
    for i in indices:
        some = within(i) if some is None else some | within(i)
    rows = documents.where((F.col("type") == kind) & some).orderBy("r", "c")
    rows = rows.offset(offset) if offset else rows
    rows = rows.limit(limit) if limit else rows
    kinds = dict(documents.dtypes)
    shown = lambda f: F.coalesce(F.array_join(f, ";") if kinds[f].startswith("array") else F.col(f).cast("string"), F.lit("")) if f in kinds else F.lit("")
    return rows.select("r", "c", *[shown(f).alias(f) for f in fields])


def _has(term: str, raw: bool):
    return (lambda x: x.rlike(java_regex(term))) if raw else (lambda x: x.contains(term))


def _all(tests) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out if out is not None else F.lit(True)
