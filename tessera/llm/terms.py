"""Frequency of every distinct term, by last-seen counters.

Tokens are hash-partitioned by term and ordered by record. Each term keeps its occurrences, its records and the last record
seen; a record is counted where it differs from the last. No set of records is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import not_blank
from tessera.functions.uri import Namespaces
from tessera.operators.records import current_rows, with_record_key

#: A term is split over so many counters by record, so that one term in a third of all records is no hot spot.
SALTS = 32


def tokens(title: Column) -> Column:
    """The longest runs of Unicode letters and digits of the lower-cased title, as stored; null for null."""
    return F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def titles(resources: DataFrame, searchdata: DataFrame, ns: Namespaces) -> DataFrame:
    """source, record, titles: the titles that aren't blank of the current rows that aren't deleted, of records that have any.

    Of resources all values of searchterms:title, of searchdata dct_title. record is the row_id of the current row.
    """
    named = F.transform(F.filter("props", lambda x: (x["p"] == "searchterms:title") & not_blank(x["v"])), lambda x: x["v"])
    first = current_rows(with_record_key(resources, ns), {"record": F.col("row_id"), "gone": F.col("deleted_at").isNotNull(), "titles": named}).where("NOT gone")
    second = current_rows(with_record_key(searchdata, ns), {"record": F.col("row_id"), "titles": F.when(not_blank(F.col("dct_title")), F.array("dct_title"))})
    both = first.select(F.lit(0).alias("source"), "record", "titles").unionByName(second.select(F.lit(1).alias("source"), "record", "titles"))
    return both.where(F.size(F.coalesce("titles", F.array().cast("array<string>"))) > 0)


def term_counts(documents: DataFrame, salts: int = SALTS) -> DataFrame:
    """term, occurrences, records of each distinct term of documents (source, record, titles).

    salts: into how many counters by record each term is split. Null titles hold no terms; an empty table has none. Equal in content to grouping all (term, record) pairs.
    """
    words = documents.select("source", "record", F.explode("titles").alias("title")).select("source", "record", F.explode(tokens(F.col("title"))).alias("term"))
    salted = words.withColumn("salt", F.pmod(F.hash("source", "record"), F.lit(salts)))
    seen = Window.partitionBy("term", "salt").orderBy("source", "record")
    here = F.struct("source", "record")
    new = F.when(F.lag(here).over(seen).eqNullSafe(here), 0).otherwise(1)
    counters = salted.select("term", "salt", new.alias("new")).groupBy("term", "salt").agg(F.count(F.lit(1)).alias("occurrences"), F.sum("new").alias("records"))
    return counters.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, documents: DataFrame, common_above: float) -> DataFrame:
    """counts with `mark`: rare for terms of exactly one record, else common above that share of all records, else null."""
    total = documents.agg(F.count(F.lit(1))).scalar()
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > F.lit(common_above).cast("decimal(10,6)") * total, "common")
    return counts.withColumn("mark", mark)
