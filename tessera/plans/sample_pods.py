"""Pods over the relational tables: a subject for each row, a predicate for each column, foreign keys as URIs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.uri import Namespaces
from tessera.sources.pods import Pod, PropsPod, WidePod, stored
from tessera.sources.tables import read

GRAPH = "ex:graph"
NS = Namespaces({"ex": "http://example.org/ns/", "foaf": "http://xmlns.com/foaf/0.1/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"})


def _uri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"ex:{kind}/"), F.col(key).cast("string"))


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(15,2)").cast("string")


class Pods(dict):
    """The pods by name, built when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__()
        self.spark, self.folder = spark, folder

    def __missing__(self, name: str) -> Pod:
        self[name] = getattr(self, f"_{name}")()
        return self[name]

    def __contains__(self, name: object) -> bool:
        return name in _NAMES

    def __iter__(self):
        return iter(sorted(_NAMES))

    def _read(self, table: str) -> DataFrame:
        return read(self.spark, self.folder, table)

    def _wide(self, table: DataFrame, subject: Column, kind: str, predicates: dict, keep: list | None = None) -> WidePod:
        return WidePod.of(table, subject, F.lit(GRAPH), {"rdf:type": ("u", F.lit(kind)), **predicates}, keep)

    def _customers(self) -> Pod:
        columns = {"foaf:name": ("l", F.col("c_name")), "ex:segment": ("l", F.col("c_mktsegment")), "ex:balance": ("l", _money("c_acctbal")), "ex:nation": ("u", _uri("nation", "c_nationkey"))}
        return self._wide(self._read("customer"), _uri("customer", "c_custkey"), "foaf:Person", columns)

    def _nations(self) -> Pod:
        return self._wide(self._read("nation"), _uri("nation", "n_nationkey"), "ex:Nation", {"ex:name": ("l", F.col("n_name")), "ex:region": ("u", _uri("region", "n_regionkey"))})

    def _regions(self) -> Pod:
        return self._wide(self._read("region"), _uri("region", "r_regionkey"), "ex:Region", {"ex:name": ("l", F.col("r_name"))})

    def _parts(self) -> Pod:
        columns = {"ex:name": ("l", F.col("p_name")), "ex:brand": ("l", F.col("p_brand")), "ex:kind": ("l", F.col("p_type")), "ex:size": ("l", F.col("p_size").cast("string"))}
        return self._wide(self._read("part"), _uri("part", "p_partkey"), "ex:Part", columns)

    def _suppliers(self) -> Pod:
        return self._wide(self._read("supplier"), _uri("supplier", "s_suppkey"), "ex:Supplier", {"foaf:name": ("l", F.col("s_name")), "ex:nation": ("u", _uri("nation", "s_nationkey"))})

    @cached_property
    def _order_columns(self) -> dict:
        return {
            "ex:customer": ("u", _uri("customer", "o_custkey")), "ex:total": ("l", _money("o_totalprice")), "ex:status": ("l", F.col("o_orderstatus")),
            "ex:priority": ("l", F.col("o_orderpriority")), "ex:date": ("l", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")),
        }

    def _orders(self) -> Pod:
        """Orders without their parts."""
        return self._wide(self._read("orders"), _uri("order", "o_orderkey"), "ex:Order", self._order_columns, [F.col("o_orderdate").alias("_uts")])

    def _baskets(self) -> Pod:
        """Orders with the parts of their lines, in the order of the lines."""
        lines = self._read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
        joined = self._read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        parts = F.transform("lines", lambda x: F.concat(F.lit("ex:part/"), x["l_partkey"].cast("string")))
        return self._wide(joined, _uri("order", "o_orderkey"), "ex:Order", {**self._order_columns, "ex:part": ("u", parts)})

    def _shipments(self) -> Pod:
        """What was shipped of each order: the same subjects as orders."""
        last = self._read("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.sum("l_quantity").alias("quantity"))
        return self._wide(last, _uri("order", "l_orderkey"), "ex:Shipment", {"ex:shipped": ("l", F.date_format("last", "yyyy-MM-dd")), "ex:quantity": ("l", F.col("quantity").cast("bigint").cast("string"))})

    def _sequences(self) -> Pod:
        """The lines of each order as an rdf:Seq of parts, stored as props."""
        item = F.struct(F.concat(F.lit("rdf:_"), F.col("l_linenumber").cast("string")).alias("p"), F.lit(0).alias("pos"), F.lit("u").alias("k"), _uri("part", "l_partkey").alias("v"))
        kind = F.struct(F.lit("rdf:type").alias("p"), F.lit(0).alias("pos"), F.lit("u").alias("k"), F.lit("rdf:Seq").alias("v"))
        rows = self._read("lineitem").groupBy(_uri("order", "l_orderkey").alias("r")).agg(F.array_append(F.array_sort(F.collect_list(item)), kind).alias("props"))
        return PropsPod(rows.select("r", F.lit(GRAPH).alias("c"), "props"))

    def _events(self) -> Pod:
        return self._wide(self._read("events"), _uri("event", "event_id"), "ex:Event", {"ex:kind": ("l", F.col("event_type")), "ex:customer": ("u", _uri("customer", "user_id"))})

    def _resources(self) -> Pod:
        """The stored descriptions of the table resources."""
        return stored(self._read("resources"), Namespaces.of(self._read("prefixes")))


_NAMES = {"customers", "nations", "regions", "parts", "suppliers", "orders", "baskets", "shipments", "sequences", "events", "resources"}
