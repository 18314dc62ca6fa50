"""Queries of the engine's own operators over the relational pods and the stored descriptions, and their text for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import not_blank_sql
from tessera.functions.uri import Namespaces, canonical_of_sql
from tessera.operators import adhoc, changes, composites, graphs, impact
from tessera.operators.records import current_rows_sql
from tessera.plans import compiler
from tessera.plans.sample_pods import GRAPH, NS, Pods
from tessera.session import written
from tessera.sources import rdf
from tessera.sources.pods import from_json, from_triples, to_json
from tessera.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Pods], DataFrame]) -> Callable:
        QUERIES[f"q_{f.__name__}"] = lambda spark, d: f(Pods(spark, d))
        if sql:
            SQL[f"q_{f.__name__}"] = sql
        return f

    return add


def flat(df: DataFrame) -> DataFrame:
    """Arrays of texts as one text each, so that columns are flat."""
    return df.select(*[F.array_join(c, ";").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes if not t.startswith("array<struct")])


# The pods in DuckDB's dialect.
_M = "CAST(CAST({} AS DECIMAL(15,2)) AS VARCHAR)".format
_CUSTOMERS = f"SELECT 'ex:customer/' || c_custkey AS r, c_name AS name, c_mktsegment AS segment, {_M('c_acctbal')} AS balance, 'ex:nation/' || c_nationkey AS nation FROM customer"
_ORDERS = f"SELECT 'ex:order/' || o_orderkey AS r, 'ex:customer/' || o_custkey AS customer, {_M('o_totalprice')} AS total, o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date, o_orderkey FROM orders"
_LINES = "SELECT 'ex:order/' || l_orderkey AS r, 'ex:part/' || l_partkey AS part, l_partkey, l_linenumber AS n FROM lineitem"
_ORDER_PARTS = f"SELECT r, string_agg(part, ';' ORDER BY n, l_partkey) AS parts, count(*) AS n FROM ({_LINES}) GROUP BY r"


def _triples_sql(table: str, subject: str, kind: str, columns: dict[str, tuple[str, str]]) -> str:
    parts = [f"SELECT 'ex:graph' AS c, {subject} AS s, 'rdf:type' AS p, 'u' AS k, '{kind}' AS o FROM {table}"]
    parts += [f"SELECT 'ex:graph', {subject}, '{p}', '{k}', {c} FROM {table} WHERE {c} IS NOT NULL" for p, (k, c) in columns.items()]
    return " UNION ALL ".join(parts)


_NATION_TRIPLES = _triples_sql("nation", "'ex:nation/' || n_nationkey", "ex:Nation", {"ex:name": ("l", "n_name"), "ex:region": ("u", "'ex:region/' || n_regionkey")})
_CUSTOMER_TRIPLES = _triples_sql("customer", "'ex:customer/' || c_custkey", "foaf:Person", {"foaf:name": ("l", "c_name"), "ex:segment": ("l", "c_mktsegment"), "ex:balance": ("l", _M("c_acctbal")), "ex:nation": ("u", "'ex:nation/' || c_nationkey")})
_SUPPLIER_TRIPLES = _triples_sql("supplier", "'ex:supplier/' || s_suppkey", "ex:Supplier", {"foaf:name": ("l", "s_name"), "ex:nation": ("u", "'ex:nation/' || s_nationkey")})


# Ad-hoc queries.


@query(f"SELECT r, 'ex:graph' AS c, name AS \"foaf:name\", segment AS \"ex:segment\" FROM ({_CUSTOMERS}) WHERE segment = 'BUILDING'")
def select_single(pods):
    return flat(adhoc.select(pods["customers"], {"ex:segment.l": "BUILDING"}, ["foaf:name", "ex:segment"]))


@query(f"SELECT o.r AS r, 'ex:graph' AS c, coalesce(p.parts, '') AS \"ex:part\" FROM ({_ORDERS}) o LEFT JOIN ({_ORDER_PARTS}) p ON o.r = p.r WHERE o.status = 'F'")
def select_multi(pods):
    return flat(adhoc.select(pods["baskets"], {"ex:status.l": "F"}, ["ex:part"], context=GRAPH))


@query(f"SELECT r, 'ex:graph' AS c, total AS \"ex:total\" FROM ({_ORDERS}) WHERE priority = '1-URGENT' ORDER BY total DESC, r LIMIT 50 OFFSET 10")
def select_sort_page(pods):
    return flat(adhoc.select(pods["orders"], {"ex:priority.l": "1-URGENT"}, ["ex:total"], {"ex:total.l": -1}, 50, 10))


@query(f"SELECT * FROM ({_NATION_TRIPLES})")
def describe(pods):
    return adhoc.describe(pods["nations"], {}).drop("pos")


@query(f"SELECT * FROM ({_CUSTOMER_TRIPLES}) WHERE s IN ('ex:customer/1', 'ex:customer/7')")
def describe_resources(pods):
    return adhoc.describe_resources(pods["customers"], ["ex:customer/1", "ex:customer/7", "ex:customer/none"]).drop("pos")


@query(f"SELECT t.* FROM ({_CUSTOMER_TRIPLES}) t JOIN ({_CUSTOMERS}) k ON t.s = k.r WHERE k.segment = 'MACHINERY' AND t.p IN ('foaf:name', 'ex:nation')")
def graph_include(pods):
    return adhoc.graph(pods["customers"], {"ex:segment": {"l": "MACHINERY"}}, ["foaf:name", "ex:nation"]).drop("pos")


@query(f"SELECT r FROM ({_CUSTOMERS}) WHERE (segment IN ('BUILDING', 'FURNITURE') OR TRY_CAST(balance AS DOUBLE) < 0) AND nation IS NOT NULL")
def filter_in_or_exists(pods):
    query = {"$or": [{"ex:segment.l": {"$in": ["BUILDING", "FURNITURE"]}}, {"ex:balance.l": {"$lt": 0}}], "ex:nation.u": {"$exists": True}, "ex:none": {"$exists": False}}
    return adhoc.select(pods["customers"], query, []).select("r")


@query(f"SELECT r FROM ({_ORDERS}) WHERE CAST(total AS DOUBLE) >= 100000 AND CAST(total AS DOUBLE) <= 150000 AND date < '1996-01-01'")
def filter_range(pods):
    return adhoc.select(pods["orders"], {"ex:total.l": {"$gte": 100000, "$lte": 150000}, "ex:date.l": {"$lt": "1996-01-01"}}, []).select("r")


@query("SELECT 'ex:part/' || p_partkey AS r FROM part WHERE regexp_matches(p_name, '(?i)A') AND regexp_matches(p_name, 'e')")
def filter_regex_all(pods):
    return adhoc.select(pods["parts"], {"ex:name.l": {"$all": [{"$regex": "/A/i"}, {"$regex": "e"}]}}, []).select("r")


@query(f"SELECT r FROM ({_CUSTOMERS}) WHERE segment <> 'BUILDING' AND segment NOT IN ('FURNITURE') AND NOT (nation = 'ex:nation/3' OR nation = 'ex:nation/4') AND NOT starts_with(name, 'Customer#00000001')")
def filter_negations(pods):
    query = {"ex:segment.l": {"$ne": "BUILDING", "$nin": ["FURNITURE"]}, "$nor": [{"ex:nation.u": "ex:nation/3"}, {"ex:nation.u": "ex:nation/4"}], "foaf:name.l": {"$not": {"$regex": "^Customer#00000001"}}}
    return adhoc.select(pods["customers"], query, []).select("r")


@query(f"SELECT o.r AS r FROM ({_ORDERS}) o WHERE EXISTS (SELECT 1 FROM ({_LINES}) l WHERE l.r = o.r AND l.part IN ('ex:part/5', 'ex:part/17'))")
def filter_any_value(pods):
    return adhoc.select(pods["baskets"], {"ex:part.u": {"$in": ["ex:part/5", "ex:part/17"]}}, []).select("r")


@query("SELECT count(*) AS count FROM customer WHERE c_mktsegment = 'BUILDING'")
def count(pods):
    return adhoc.count(pods["customers"], {"ex:segment.l": "BUILDING"})


@query("SELECT o_orderpriority AS key, count(*) AS count FROM orders GROUP BY 1")
def count_group(pods):
    return adhoc.count_by(pods["orders"], {}, "ex:priority.l")


@query(f"SELECT coalesce(p.parts, '') AS key, count(*) AS count FROM ({_ORDERS}) o LEFT JOIN ({_ORDER_PARTS}) p ON o.r = p.r GROUP BY 1")
def count_group_multi(pods):
    return adhoc.count_by(pods["baskets"], {}, "ex:part")


@query(f"SELECT DISTINCT part AS value FROM ({_LINES}) l JOIN ({_ORDERS}) o USING (r) WHERE o.status = 'O'")
def distinct_filtered(pods):
    return adhoc.distinct_values(pods["baskets"], "ex:part.u", {"ex:status.l": "O"})


@query("SELECT 'ex:order/' || o_orderkey AS r, 'ex:graph' AS c, '0.' || lpad(CAST(epoch_us(o_orderdate) % 1000000 AS VARCHAR), 6, '0') || '00 ' || CAST(epoch_us(o_orderdate) // 1000000 AS VARCHAR) AS etag FROM orders")
def etag(pods):
    return adhoc.etag(pods["orders"])


_STORED = f"""
WITH now AS ({current_rows_sql("resources", ["deleted_at", "props"])}),
v AS (SELECT r, c, x.p AS p, x.k AS k, x.v AS v FROM (SELECT r, c, unnest(props) AS x FROM now WHERE deleted_at IS NULL) WHERE {not_blank_sql("x.v")}),
canon AS (SELECT r, c, p, k, CASE WHEN k = 'u' THEN {canonical_of_sql("v")} ELSE v END AS v FROM v),
t AS (SELECT a.r, a.c, a.p, a.k, CASE WHEN a.k = 'u' AND n.prefix IS NOT NULL THEN n.prefix || ':' || substr(a.v, length(n.uri) + 1) ELSE a.v END AS v
  FROM canon a LEFT JOIN prefixes n ON regexp_extract(a.v, '(?i)^(.*[/#])[a-z0-9\\-_:]+$', 1) = n.uri)"""


@query(_STORED + " SELECT v AS value, count(DISTINCT (r, c)) AS subjects FROM t WHERE p = 'rdf:type' AND k = 'u' AND c = 'http://huxjun.example/' GROUP BY v")
def stored_types_in_context(pods):
    rows = adhoc.select(pods["resources"], {}, ["rdf:type"], context="http://huxjun.example/")
    typed = adhoc.describe(pods["resources"], {"_id.c": "http://huxjun.example/"}).where("p = 'rdf:type' AND k = 'u'")
    return typed.join(rows.select(F.col("r").alias("s")), "s", "left_semi").groupBy(F.col("o").alias("value")).agg(F.count_distinct("s").alias("subjects"))


@query(_STORED + " SELECT count(DISTINCT (r, c)) AS count FROM t WHERE p = 'rdf:type' AND k = 'u' AND v = 'bibo:Book' AND EXISTS (SELECT 1 FROM t u WHERE u.r = t.r AND u.c = t.c AND u.p = 'dct:source')")
def stored_filter(pods):
    return adhoc.count(pods["resources"], {"rdf:type": {"u": "bibo:Book"}, "dct:source": {"$exists": True}})


# Tables.

T_ORDERS = {
    "_id": "t_orders", "type": "ex:Order", "from": "baskets",
    "fields": [{"fieldName": "total", "predicates": ["ex:total"]}, {"fieldName": "status", "predicates": ["ex:status"]}],
    "counts": [{"fieldName": "items", "property": "ex:part"}],
    "joins": {"ex:customer": {
        "from": "customers",
        "fields": [{"fieldName": "customer", "predicates": ["foaf:name"]}, {"fieldName": "segment", "predicates": ["ex:segment"]}],
        "joins": {"ex:nation": {"from": "nations", "fields": [{"fieldName": "nation", "predicates": ["ex:name"]}]}},
    }},
    "computed_fields": [{"fieldName": "size", "value": {"conditional": {"if": ["$total", ">", 150000], "then": "big", "else": "small"}}}],
}
_T_ORDERS = f"""SELECT o.r AS r, 'ex:graph' AS c, o.total AS total, o.status AS status, k.name AS customer, k.segment AS segment, n.n_name AS nation,
coalesce(p.n, 0) AS items, CASE WHEN CAST(o.total AS DOUBLE) > 150000 THEN 'big' ELSE 'small' END AS size
FROM ({_ORDERS}) o LEFT JOIN ({_CUSTOMERS}) k ON o.customer = k.r LEFT JOIN nation n ON k.nation = 'ex:nation/' || n.n_nationkey LEFT JOIN ({_ORDER_PARTS}) p ON p.r = o.r"""


def t_orders(pods: Pods, only: DataFrame | None = None) -> DataFrame:
    return compiler.table(T_ORDERS, pods, NS, only)


@query(f"SELECT r, c, coalesce(total, '') AS total, coalesce(status, '') AS status, coalesce(customer, '') AS customer, coalesce(segment, '') AS segment, coalesce(nation, '') AS nation, items, size FROM ({_T_ORDERS})")
def table_orders(pods):
    return flat(t_orders(pods))


@query(f"SELECT r, customer, total, size FROM ({_T_ORDERS}) WHERE segment = 'BUILDING' AND size = 'big' ORDER BY total DESC, r LIMIT 25 OFFSET 5")
def table_sort_page(pods):
    return flat(composites.table_rows(t_orders(pods), {"value.segment": "BUILDING", "value.size": "big"}, {"value.total": -1}, 5, 25)).select("r", "customer", "total", "size")


@query(f"SELECT count(*) AS count FROM ({_T_ORDERS}) WHERE nation = 'NATION_7' OR items >= 6")
def table_count(pods):
    return composites.count_rows(t_orders(pods), {"$or": [{"value.nation": "NATION_7"}, {"value.items": {"$gte": 6}}]})


@query(f"SELECT DISTINCT nation AS value FROM ({_T_ORDERS}) WHERE size = 'big' AND nation IS NOT NULL")
def table_distinct(pods):
    return composites.distinct_column_values(t_orders(pods), "value.nation", {"value.size": "big"})


def _spec(pod: str, kind: str, **rest: object) -> dict:
    return {"_id": "spec", "type": kind, "from": pod, **rest}


def _field(name: str, *predicates: object, **rest: object) -> dict:
    return {"fieldName": name, "predicates": list(predicates), **rest}


@query(f"SELECT o.r AS r, o.status AS status, coalesce(strftime(s.last, '%Y-%m-%d'), '') AS shipped, coalesce(CAST(CAST(s.q AS BIGINT) AS VARCHAR), '') AS quantity FROM ({_ORDERS}) o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last, sum(l_quantity) AS q FROM lineitem GROUP BY 1) s ON s.l_orderkey = o.o_orderkey")
def table_id_join(pods):
    joined = {"_id": {"from": "shipments", "fields": [_field("shipped", "ex:shipped"), _field("quantity", "ex:quantity")]}}
    return flat(compiler.table(_spec("orders", "ex:Order", fields=[_field("status", "ex:status")], joins=joined), pods, NS)).select("r", "status", "shipped", "quantity")


_FIRST_LINES = f"SELECT r, part, l_partkey, min(n) AS n FROM ({_LINES}) GROUP BY r, part, l_partkey"


@query(f"SELECT o.r AS r, coalesce(string_agg(p.p_brand, ';' ORDER BY l.n, l.l_partkey), '') AS brands FROM ({_ORDERS}) o LEFT JOIN ({_FIRST_LINES}) l ON o.r = l.r LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY o.r")
def table_multi_join(pods):
    spec = _spec("baskets", "ex:Order", joins={"ex:part": {"from": "parts", "fields": [_field("brands", "ex:brand")]}})
    return flat(compiler.table(spec, pods, NS)).select("r", "brands")


@query(f"SELECT o.r AS r, coalesce(string_agg(p.p_brand, ';' ORDER BY l.n, l.l_partkey), '') AS brands FROM ({_ORDERS}) o LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n, l_partkey) AS nth FROM ({_FIRST_LINES})) WHERE nth <= 2) l ON o.r = l.r LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY o.r")
def table_max_joins(pods):
    spec = _spec("baskets", "ex:Order", joins={"ex:part": {"from": "parts", "maxJoins": 2, "fields": [_field("brands", "ex:brand")]}})
    return flat(compiler.table(spec, pods, NS)).select("r", "brands")


@query(f"SELECT r, coalesce(string_agg(p.p_name, ';' ORDER BY n, part), '') AS names FROM (SELECT r, l_partkey, part, min(n) AS n FROM ({_LINES}) WHERE n <= 3 GROUP BY ALL) l LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY r UNION ALL SELECT DISTINCT r, '' FROM ({_LINES}) a WHERE NOT EXISTS (SELECT 1 FROM ({_LINES}) b WHERE a.r = b.r AND b.n <= 3)")
def table_sequence_join(pods):
    spec = _spec("sequences", "rdf:Seq", joins={"followSequence": {"maxJoins": 3, "from": "parts", "fields": [_field("names", "ex:name")]}})
    return flat(compiler.table(spec, pods, NS)).select("r", "names")


@query(f"SELECT o.r AS r, count(*) FILTER (regexp_matches(l.part, '[05]$')) AS round, count(DISTINCT l.part) FILTER (p.p_brand LIKE '%1') AS brands FROM ({_ORDERS}) o LEFT JOIN ({_LINES}) l ON o.r = l.r LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY o.r")
def table_counts_regex(pods):
    spec = _spec("baskets", "ex:Order", counts=[{"fieldName": "round", "property": "ex:part", "regex": "/[05]$/"}], joins={"ex:part": {"from": "parts", "counts": [{"fieldName": "brands", "property": "ex:brand", "regex": "/1$/"}]}})
    return compiler.table(spec, pods, NS).select("r", "round", "brands")


@query(f"SELECT r, lower(name) AS lower_name, name || '|' || segment AS joined, lower(name || '-' || segment) AS nested, 'http://example.org/ns/' || substr(r, 4) AS link FROM ({_CUSTOMERS})")
def table_modifiers(pods):
    fields = [
        _field("lower_name", {"lowercase": {"predicates": ["foaf:name"]}}),
        _field("joined", {"join": {"glue": "|", "predicates": ["foaf:name", "ex:segment"]}}),
        _field("nested", {"lowercase": {"join": {"glue": "-", "predicates": ["foaf:name", "ex:segment"]}}}),
        {"fieldName": "link", "value": "link"},
        _field("hidden", "ex:balance", temporary=True),
    ]
    return flat(compiler.table(_spec("customers", "foaf:Person", fields=fields), pods, NS)).drop("c")


@query(f"SELECT r, date || '.000' AS ordered, CAST(epoch_ms(CAST(date AS TIMESTAMP)) AS VARCHAR) AS millis, '1970-01-01 00:00:00.000' AS unreadable FROM ({_ORDERS})")
def table_dates(pods):
    fields = [_field("ordered", {"date": {"predicates": ["ex:date"]}}), _field("millis", {"lowercase": {"date": {"predicates": ["ex:date"]}}}), _field("unreadable", {"date": {"predicates": ["ex:priority"]}})]
    return flat(compiler.table(_spec("orders", "ex:Order", fields=fields), pods, NS)).drop("c")


@query(f"""SELECT r, CASE WHEN status = 'F' THEN CASE WHEN CAST(total AS DOUBLE) >= 100000 THEN 'F+' ELSE 'F-' END ELSE 'open' END AS nested,
replace(replace(priority, '-', ' '), 'URGENT', 'NOW') AS replaced, round((CAST(total AS DOUBLE) + 100) * 2 / 3, 4) AS arithmetic, CAST(trunc(CAST(total AS DOUBLE)) AS BIGINT) % 7 AS rest,
contains(priority, 'HIGH') AS has_high, NOT contains(priority, 'LOW') AS no_low, regexp_matches(priority, '(?i)^[12]-') AS early, NOT regexp_matches(priority, '^5') AS not_five,
date > '1995-06-01 00:00:00' AS late FROM (SELECT *, total AS t FROM ({_ORDERS}))""")
def table_computed(pods):
    test = lambda *x: {"conditional": {"if": list(x), "then": True, "else": False}}
    fields = [_field("status", "ex:status", temporary=True), _field("total", "ex:total", temporary=True), _field("priority", "ex:priority", temporary=True), _field("date", "ex:date", temporary=True)]
    computed = {
        "nested": {"conditional": {"if": ["$status", "==", "F"], "then": {"conditional": {"if": ["$total", ">=", 100000], "then": "F+", "else": "F-"}}, "else": "open"}},
        "replaced": {"replace": {"search": ["-", "URGENT"], "replace": [" ", "NOW"], "subject": "$priority"}},
        "arithmetic": {"arithmetic": [[["$total", "+", 100], "*", 2], "/", 3]}, "rest": {"arithmetic": ["$total", "%", 7]},
        "has_high": test("$priority", "contains", "HIGH"), "no_low": test("$priority", "not contains", "LOW"), "early": test("$priority", "~=", "/^[12]-/i"), "not_five": test("$priority", "!~", "/^5/"),
        "late": test("$date", ">", "1995-06-01 00:00:00"),
    }
    spec = _spec("orders", "ex:Order", fields=fields, computed_fields=[{"fieldName": n, "value": v} for n, v in computed.items()])
    rows = flat(compiler.table(spec, pods, NS)).drop("c")
    return rows.withColumn("arithmetic", F.round("arithmetic", 4)).withColumn("rest", F.col("rest").cast("bigint"))


@query(f"SELECT DISTINCT r, CAST(unnest([r, customer, nation]) AS VARCHAR) AS part FROM (SELECT o.r AS r, o.customer AS customer, coalesce(k.nation, o.r) AS nation FROM ({_ORDERS}) o LEFT JOIN ({_CUSTOMERS}) k ON o.customer = k.r)")
def impact_index(pods):
    return impact.indexed(t_orders(pods)).select(F.col("root_r").alias("r"), F.col("s").alias("part"))


# Views.

V_CUSTOMER = {"_id": "v_customer", "type": "foaf:Person", "from": "customers", "include": ["foaf:name"], "joins": {"ex:nation": {"from": "nations", "joins": {"ex:region": {"from": "regions"}}}}}


def _view_triples(rows: DataFrame) -> DataFrame:
    return rows.select("root_r", F.col("r").alias("s"), F.explode("props").alias("x")).select("root_r", "s", "x.p", "x.k", F.col("x.v").alias("o"))


_REGION_TRIPLES = "SELECT 'ex:region/' || r_regionkey AS s, 'rdf:type' AS p, 'u' AS k, 'ex:Region' AS o, r_regionkey FROM region UNION ALL SELECT 'ex:region/' || r_regionkey, 'ex:name', 'l', r_name, r_regionkey FROM region"


@query(f"""SELECT s AS root_r, s, p, k, o FROM ({_CUSTOMER_TRIPLES}) WHERE p IN ('foaf:name', 'ex:nation')
UNION ALL SELECT k.r, t.s, t.p, t.k, t.o FROM ({_CUSTOMERS}) k JOIN ({_NATION_TRIPLES}) t ON t.s = k.nation
UNION ALL SELECT k.r, t.s, t.p, t.k, t.o FROM ({_CUSTOMERS}) k JOIN nation n ON k.nation = 'ex:nation/' || n.n_nationkey JOIN ({_REGION_TRIPLES}) t ON t.r_regionkey = n.n_regionkey""")
def view_triples(pods):
    return _view_triples(compiler.view(V_CUSTOMER, pods, NS))


@query(f"SELECT k.r AS root_r, count(n.n_nationkey) + count(g.r_regionkey) + 1 AS graphs FROM ({_CUSTOMERS}) k LEFT JOIN nation m ON k.nation = 'ex:nation/' || m.n_nationkey LEFT JOIN nation n ON n.n_nationkey = m.n_nationkey AND n.n_name IN ('NATION_7', 'NATION_3') LEFT JOIN region g ON g.r_regionkey = m.n_regionkey GROUP BY k.r")
def view_filter(pods):
    spec = {**V_CUSTOMER, "joins": {"ex:nation": {"from": "nations", "filter": {"ex:name": {"$in": ["NATION_7", "NATION_3"]}}, "joins": {"ex:region": {"from": "regions"}}}}}
    return compiler.view(spec, pods, NS).groupBy("root_r").agg(F.count(F.lit(1)).alias("graphs"))


@query(f"""WITH l AS ({_LINES}), seq AS (SELECT r, n, part FROM (SELECT *, dense_rank() OVER (PARTITION BY r ORDER BY n) AS place FROM l) WHERE n = place)
SELECT r AS root_r, r AS s, 'rdf:_' || n AS p, 'u' AS k, part AS o FROM seq UNION ALL SELECT DISTINCT r, r, 'rdf:type', 'u', 'rdf:Seq' FROM l""")
def view_sequence(pods):
    return _view_triples(compiler.view(_spec("sequences", "rdf:Seq", include=["rdf:type", "_seq_"], joins={}), pods, NS))


@query("SELECT 'ex:nation/' || n_nationkey AS r, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING') AS VARCHAR) AS builders, '1' AS names FROM nation")
def view_counts(pods):
    counts = {"ex:builders": {"property": "ex:nation", "filter": {"ex:segment": {"l": "BUILDING"}}, "from": "customers"}, "ex:names": {"property": "ex:name"}}
    rows = compiler.view(_spec("nations", "ex:Nation", include=[], joins={}, ttl=300, counts=counts), pods, NS)
    value = lambda p: F.get(F.transform(F.filter("props", lambda x: x["p"] == p), lambda x: x["v"]), F.lit(0))
    return rows.select("r", value("ex:builders").alias("builders"), value("ex:names").alias("names"))


def _nested(pods: Pods) -> DataFrame:
    return compiler.nested_view(compiler.view(V_CUSTOMER, pods, NS), compiler.impact_index(V_CUSTOMER, pods, NS), "v_customer")


@query(f"SELECT k.r AS r, 3 AS graphs, k.r AS last, 3 AS impact FROM ({_CUSTOMERS}) k JOIN nation n ON k.nation = 'ex:nation/' || n.n_nationkey WHERE n.n_name = 'NATION_7'")
def view_query(pods):
    found = composites.query_views(_nested(pods), {"ex:name.l": "NATION_7"})
    return found.select("r", F.size("graphs").alias("graphs"), F.element_at("graphs", -1)["r"].alias("last"), F.size("impact_index").alias("impact"))


@query("SELECT 'ex:customer/' || c_custkey AS r, 'ex:graph' AS c FROM customer WHERE c_mktsegment <> 'BUILDING'")
def missing_views(pods):
    some = compiler.view(V_CUSTOMER, {**{n: pods[n] for n in ("nations", "regions")}, "customers": pods["customers"].only(pods["customers"].scalar("ex:segment") == "BUILDING")}, NS)
    views = compiler.nested_view(some, None, "v_customer", ttl=0)
    return composites.missing_views(pods["customers"].frame, views)


# Graph algebra.


@query(f"SELECT s, p, k, o FROM ({_NATION_TRIPLES}) UNION SELECT s, p, k, o FROM ({_SUPPLIER_TRIPLES})")
def graph_union(pods):
    return graphs.union(pods["nations"].triples(), pods["suppliers"].triples(), pods["nations"].triples())


@query(f"SELECT s, p, k, o FROM ({_SUPPLIER_TRIPLES}) EXCEPT SELECT s, p, k, o FROM ({_SUPPLIER_TRIPLES}) WHERE p = 'ex:nation'")
def graph_difference(pods):
    return graphs.difference(pods["suppliers"].triples(), adhoc.graph(pods["suppliers"], {}, ["ex:nation"]))


def _renamed(pods: Pods) -> DataFrame:
    """The nations after a change: those of one region are renamed and lose it."""
    t = pods["nations"].triples()
    moved = t.where("p = 'ex:region' AND o = 'ex:region/1'").select(F.col("s").alias("m"))
    joined = t.join(moved, F.col("s") == F.col("m"), "left")
    kept = joined.where(~((F.col("p") == "ex:region") & F.col("m").isNotNull()))
    return kept.withColumn("o", F.when(F.col("m").isNotNull() & (F.col("p") == "ex:name"), F.lower("o")).otherwise(F.col("o"))).drop("m")


_CHANGE = """SELECT 'ex:nation/' || n_nationkey AS s, 'ex:name' AS p, 'l' AS k, lower(n_name) AS o, 'add' AS op FROM nation WHERE n_regionkey = 1 AND lower(n_name) <> n_name
UNION ALL SELECT 'ex:nation/' || n_nationkey, 'ex:name', 'l', n_name, 'remove' FROM nation WHERE n_regionkey = 1 AND lower(n_name) <> n_name
UNION ALL SELECT 'ex:nation/' || n_nationkey, 'ex:region', 'u', 'ex:region/1', 'remove' FROM nation WHERE n_regionkey = 1"""


@query(_CHANGE)
def change_set(pods):
    return graphs.changes(pods["nations"].triples(), _renamed(pods))


@query(f"SELECT s, count(*) FILTER (op = 'add') AS additions, count(*) FILTER (op = 'remove') AS removals FROM ({_CHANGE}) GROUP BY s")
def change_subjects(pods):
    return graphs.subjects_of_change(graphs.changes(pods["nations"].triples(), _renamed(pods)))


@query(f"SELECT s, p, CAST(coalesce(string_agg(k || ' ' || o, ';' ORDER BY k || ' ' || o) FILTER (op = 'add'), '') AS VARCHAR) AS additions, coalesce(string_agg(k || ' ' || o, ';' ORDER BY k || ' ' || o) FILTER (op = 'remove'), '') AS removals FROM ({_CHANGE}) GROUP BY s, p")
def change_groups(pods):
    change = graphs.changes(pods["nations"].triples(), _renamed(pods)).withColumn("c", F.lit(GRAPH))
    return flat(changes.group_changes(change)).drop("c")


@query(f"SELECT 'ex:graph' AS c, s, p, k, o FROM ({_NATION_TRIPLES}) t WHERE NOT EXISTS (SELECT 1 FROM ({_CHANGE}) d WHERE d.op = 'remove' AND d.s = t.s AND d.p = t.p AND d.o = t.o) UNION ALL SELECT 'ex:graph', s, p, k, o FROM ({_CHANGE}) WHERE op = 'add'")
def apply_changes(pods):
    before = pods["nations"].triples()
    return changes.save(before, _renamed(pods), before, GRAPH, ["ex:name", "ex:region"])[0].drop("pos")


@query("SELECT 'ex:nation/' || n_nationkey AS s, CAST(CASE WHEN n_regionkey = 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 0 END ELSE 3 END AS BIGINT) AS _version FROM nation WHERE n_regionkey = 1 OR n_nationkey % 2 = 0")
def next_versions(pods):
    t = pods["nations"].triples()
    even = t.where((F.substring_index("s", "/", -1).cast("int") % 2) == 0).select("c", "s").distinct()
    old = even.select("c", "s", F.lit(3).cast("bigint").alias("_version"), F.lit(datetime(2020, 1, 1)).alias("_cts"), F.lit(datetime(2020, 1, 1)).alias("_uts"))
    change = graphs.changes(t, _renamed(pods)).withColumn("c", F.lit(GRAPH))
    return changes.next_versions(old, change, datetime(2021, 1, 1)).select("s", F.col("_version").cast("bigint").alias("_version"))


@query(f"SELECT * FROM (SELECT 'ex:graph' AS c, r AS s, 'ex:part' AS p, count(DISTINCT part) AS values FROM ({_LINES}) GROUP BY r) WHERE values > 1")
def cardinality_violations(pods):
    return changes.cardinality_violations(pods["baskets"].triples(), ["ex:part", "ex:status"])


@query("SELECT count(*) * 4 AS triples, count(*) AS statements, count(DISTINCT n_name) AS objects FROM (SELECT n_name FROM nation UNION ALL SELECT 'ex:Nation' FROM nation UNION ALL SELECT 'ex:region/' || n_regionkey FROM nation)")
def reify(pods):
    t = graphs.reify(pods["nations"].triples())
    return t.agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("statements"), F.count_distinct(F.when(F.col("p") == "rdf:object", F.col("o"))).alias("objects"))


@query("SELECT 'ex:nation/' || n_nationkey AS r, 'ex:customer/' || c_custkey AS s, 'ex:nation' AS p FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'ex:region/' || r_regionkey, 'ex:nation/' || n_nationkey, 'ex:region' FROM nation JOIN region ON n_regionkey = r_regionkey")
def backlinks(pods):
    return graphs.backlinks(pods["nations"].triples().unionByName(pods["regions"].triples()).unionByName(pods["customers"].triples()))


@query("SELECT count(*) AS count FROM customer WHERE c_nationkey = 5")
def triple_count(pods):
    return graphs.triple_count(pods["customers"].triples(), p="ex:nation", o="ex:nation/5")


@query(f"SELECT r AS s, CAST(n AS BIGINT) AS n, 'u' AS k, part AS o FROM ({_LINES})")
def sequence_values(pods):
    return graphs.sequence_values(pods["sequences"].triples())


@query(f"SELECT r AS s, 'rdf:_' || (max(n) + 1) AS p FROM ({_LINES}) GROUP BY r")
def sequence_next(pods):
    return graphs.next_in_sequence(pods["sequences"].triples())


@query(f"SELECT r AS s, 'rdf:_' || row_number() OVER (PARTITION BY r ORDER BY n, part) AS p, part AS o FROM ({_LINES}) WHERE n > 1")
def sequence_renumbered(pods):
    t = pods["sequences"].triples().where("p NOT IN ('rdf:_1', 'rdf:type')")
    return graphs.renumber_sequences(t).select("s", "p", "o")


@query(f"SELECT CASE WHEN s = 'ex:nation/3' THEN 'ex:nation/other' ELSE s END AS s, p, k, CASE WHEN o = 'ex:region/1' AND k = 'u' THEN 'ex:region/one' ELSE o END AS o FROM ({_NATION_TRIPLES})")
def replace_uri(pods):
    t = graphs.replace_uri(pods["nations"].triples(), "ex:nation/3", "ex:nation/other")
    return graphs.replace_uri(t, "ex:region/1", "ex:region/one").select("s", "p", "k", "o")


@query("SELECT 'ex:customer/' || c_custkey AS s, 'ex:segment' AS p, c_mktsegment AS o FROM customer")
def first_literal(pods):
    return graphs.first_literal(pods["customers"].triples(), ["ex:none", "ex:segment", "foaf:name"])


@query("SELECT 'ex:customer/' || c_custkey AS r, c_name AS label FROM customer UNION ALL SELECT 'ex:region/' || r_regionkey, CAST(r_regionkey AS VARCHAR) FROM region")
def labels(pods):
    return graphs.label(pods["customers"].triples().unionByName(pods["regions"].triples()), ["foaf:name"])


@query(f"SELECT s, p, k, o FROM ({_SUPPLIER_TRIPLES}) WHERE p <> 'foaf:name' AND s <> 'ex:supplier/1'")
def remove_properties(pods):
    t = graphs.remove(graphs.remove(pods["suppliers"].triples(), p=["foaf:name"]), s="ex:supplier/1")
    return graphs.remove_subjects_of_type(t.unionByName(pods["regions"].triples()), "ex:Region").select("s", "p", "k", "o")


@query("SELECT 'ex:nation/' || n_nationkey AS r FROM nation UNION SELECT 'ex:region/' || n_regionkey FROM nation UNION SELECT 'ex:Nation'")
def graph_resources(pods):
    return graphs.resources(pods["nations"].triples())


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS n, n_name AS o FROM nation")
def list_values(pods):
    nation = read(pods.spark, pods.folder, "nation").withColumn("k", F.col("n_nationkey"))
    top = nation.agg(F.max("k")).scalar()
    node = lambda k: F.concat(F.lit("_:l"), k.cast("string"))
    first = nation.select(node(F.col("k")).alias("s"), F.lit("rdf:first").alias("p"), F.lit("l").alias("kind"), F.col("n_name").alias("o"))
    rest = nation.select(node(F.col("k")).alias("s"), F.lit("rdf:rest").alias("p"), F.lit("b").alias("kind"), F.when(F.col("k") == top, "rdf:nil").otherwise(node(F.col("k") + 1)).alias("o"))
    return graphs.list_values(first.unionByName(rest), "_:l0").select(F.col("n").cast("bigint").alias("n"), "o")


# Search.

S_PART = {
    "_id": "i_part", "type": "ex:Part", "from": "parts",
    "filter": [{"condition": {"ex:size.l": {"$lte": 40}}}],
    "fields": [_field("result.name", "ex:name"), _field("brand", "ex:brand", limit=1)],
    "indices": [_field("terms", "ex:name", "ex:kind"), _field("brands", "ex:brand")],
}
_S_PART = "SELECT 'ex:part/' || p_partkey AS r, 'ex:graph' AS c, trim(p_name) AS result_name, trim(p_brand) AS brand, lower(p_name) AS t1, lower(p_type) AS t2, lower(p_brand) AS brands FROM part WHERE p_size <= 40"


@query(f"SELECT r, c, 'i_part' AS type, result_name, brand, t1 || ';' || t2 AS terms, brands FROM ({_S_PART})")
def search_documents(pods):
    return flat(compiler.search_documents(S_PART, pods, NS))


@query(f"SELECT r, c, result_name, brand FROM ({_S_PART}) WHERE contains(t1, 'st') OR contains(t2, 'st') OR contains(brands, 'st')")
def search(pods):
    return composites.search(compiler.search_documents(S_PART, pods, NS), "ST", "i_part", ["terms", "brands"], ["result_name", "brand"], 0)


@query(f"SELECT r, c, brand FROM ({_S_PART}) WHERE (contains(t1, 'brand') OR contains(t2, 'brand')) AND (contains(t1, '#3') OR contains(t2, '#3')) OR contains(brands, 'brand') AND contains(brands, '#3')")
def search_stop_words(pods):
    return composites.search(compiler.search_documents(S_PART, pods, NS), "the Brand of #3", "i_part", ["terms", "brands"], ["brand"], 0)


@query("SELECT 'ex:supplier/' || s_suppkey AS r, s_name AS name, coalesce((SELECT lower(n_name) FROM nation WHERE n_nationkey = s_nationkey), '') AS nation FROM supplier")
def search_join(pods):
    spec = {"_id": "i_supplier", "type": "ex:Supplier", "from": "suppliers", "filter": [{"condition": {}}], "fields": [_field("name", "foaf:name")], "joins": {"ex:nation": {"from": "nations", "indices": [_field("nation", "ex:name")]}}}
    return flat(compiler.search_documents(spec, pods, NS)).select("r", "name", "nation")


# Impact and refresh.


def _change_of(pods: Pods, predicate: str) -> DataFrame:
    """Customers of one segment change a predicate."""
    return pods["customers"].only(pods["customers"].scalar("ex:segment") == "MACHINERY").frame.select("c", F.col("r").alias("s"), F.lit(predicate).alias("p"))


@query(f"SELECT o.r AS r FROM ({_ORDERS}) o JOIN ({_CUSTOMERS}) k ON o.customer = k.r WHERE k.segment = 'MACHINERY'")
def impacted_tables(pods):
    return impact.impacted(t_orders(pods), _change_of(pods, "foaf:name"), T_ORDERS).select(F.col("root_r").alias("r"))


@query(f"SELECT o.r AS r FROM ({_ORDERS}) o JOIN ({_CUSTOMERS}) k ON o.customer = k.r WHERE k.segment = 'BUILDING'")
def impacted_tables_other_predicate(pods):
    """New balances of one segment touch nothing, new names of another do."""
    named = pods["customers"].only(pods["customers"].scalar("ex:segment") == "BUILDING").frame.select("c", F.col("r").alias("s"), F.lit("foaf:name").alias("p"))
    return impact.impacted(t_orders(pods), _change_of(pods, "ex:balance").unionByName(named), T_ORDERS).select(F.col("root_r").alias("r"))


@query(f"SELECT r, CAST(total AS DOUBLE) * 2 AS doubled, CASE WHEN CAST(total AS DOUBLE) * 2 > 300000 THEN 'big' ELSE 'small' END AS size, true AS open_or_done FROM ({_ORDERS})")
def table_chained(pods):
    """A computed field in another, and a condition of one item."""
    computed = {"doubled": {"arithmetic": ["$total", "*", 2]}, "size": {"conditional": {"if": ["$doubled", ">", 300000], "then": "big", "else": "small"}}, "open_or_done": {"conditional": {"if": ["$status"], "then": True, "else": False}}}
    fields = [_field("total", "ex:total", temporary=True), _field("status", "ex:status", temporary=True)]
    return compiler.table(_spec("orders", "ex:Order", fields=fields, computed_fields=[{"fieldName": n, "value": v} for n, v in computed.items()]), pods, NS).drop("c", "impact_index")


@query(f"SELECT k.r AS root_r, count(n.n_nationkey) + 1 AS graphs FROM ({_CUSTOMERS}) k LEFT JOIN nation n ON k.nation = 'ex:nation/' || n.n_nationkey AND n.n_name < 'NATION_5' GROUP BY k.r")
def view_condition(pods):
    spec = {**V_CUSTOMER, "joins": {"ex:nation": {"from": "nations", "condition": {"ex:name.l": {"$lt": "NATION_5"}}}}}
    return compiler.view(spec, pods, NS).groupBy("root_r").agg(F.count(F.lit(1)).alias("graphs"))


@query(_STORED + """, subjects AS (SELECT DISTINCT r, c FROM now WHERE deleted_at IS NULL),
books AS (SELECT DISTINCT r, c FROM t WHERE p = 'rdf:type' AND k = 'u' AND v = 'bibo:Book'),
links AS (SELECT DISTINCT b.r, b.c, x.v FROM books b JOIN canon x ON x.r = b.r AND x.c = b.c AND x.p = 'dct:source' AND x.k = 'u'),
titles AS (SELECT r, c, count(*) AS n FROM canon WHERE p = 'dct:title' GROUP BY r, c)
SELECT b.c AS c, count(DISTINCT b.r) AS books, count(l.v) AS sources, count(s.r) AS found, CAST(coalesce(sum(q.n), 0) AS BIGINT) AS titles
FROM books b LEFT JOIN links l ON l.r = b.r AND l.c = b.c LEFT JOIN subjects s ON s.r = l.v AND s.c = l.c LEFT JOIN titles q ON q.r = s.r AND q.c = s.c GROUP BY b.c""")
def table_graph_join(pods):
    """A join within each of many graphs: a target of the same name in another graph is another subject."""
    spec = _spec("resources", "bibo:Book", counts=[{"fieldName": "sources", "property": "none:none"}], joins={"dct:source": {"from": "resources", "counts": [{"fieldName": "titles", "property": "dct:title"}], "fields": [_field("there", "_id")]}})
    rows = compiler.table(spec, pods, Namespaces.of(read(pods.spark, pods.folder, "prefixes")))
    total = lambda c: F.sum(c).cast("bigint")
    return rows.groupBy("c").agg(F.count("r").alias("books"), total(F.size("impact_index") - 1).alias("sources"), total(F.size("there")).alias("found"), total("titles").alias("titles"))


@query(f"SELECT r FROM ({_CUSTOMERS}) WHERE segment = 'MACHINERY'")
def impacted_views(pods):
    return impact.impacted(_nested(pods), _change_of(pods, "ex:balance")).select(F.col("root_r").alias("r"))


@query(f"SELECT r, c, total, status, CASE WHEN segment = 'MACHINERY' THEN lower(customer) ELSE coalesce(customer, '') END AS customer, items FROM ({_T_ORDERS})")
def refresh(pods):
    """The rows after the names of some customers changed: only what the change touches is made anew."""
    old = written(t_orders(pods), "t_orders")
    after = Pods(pods.spark, pods.folder)
    people = pods["customers"]
    name = people.columns["foaf:name"][1]
    hit = people.scalar("ex:segment") == "MACHINERY"
    after["customers"] = type(people)(people.frame.withColumn(name, F.when(hit, F.lower(name)).otherwise(F.col(name))), people.columns)
    keys = written(impact.to_refresh(old, pods["baskets"], _change_of(pods, "foaf:name"), T_ORDERS, NS), "impacted")
    return flat(impact.refresh(old, keys, lambda k: t_orders(after, k))).select("r", "c", "total", "status", "customer", "items")


@query(f"SELECT o.r AS r, CASE WHEN k.segment = 'MACHINERY' THEN 't_orders;v_orders' ELSE 't_orders' END AS specs FROM ({_ORDERS}) o JOIN ({_CUSTOMERS}) k ON o.customer = k.r WHERE k.segment IN ('MACHINERY', 'BUILDING')")
def subjects_by_spec(pods):
    rows = t_orders(pods)
    both = pods["customers"].only(pods["customers"].scalar("ex:segment").isin("MACHINERY", "BUILDING")).frame.select("c", F.col("r").alias("s"), F.lit("foaf:name").alias("p"))
    found = impact.subjects_by_spec({"t_orders": impact.impacted(rows, both, T_ORDERS), "v_orders": impact.impacted(rows, _change_of(pods, "foaf:name"))})
    return flat(found.select(F.col("root_r").alias("r"), "specs"))


# The transaction log, made from events: a transaction per event, of the description of its user.


def _log(pods: Pods) -> DataFrame:
    events = read(pods.spark, pods.folder, "events")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    return events.select(F.col("event_id").alias("id"), F.col("ts").alias("end_time"), status.alias("status"), F.concat(F.lit("ex:user/"), F.col("user_id").cast("string")).alias("r"), F.lit(GRAPH).alias("c"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("document"))


_LAST = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE event_type <> 'error' GROUP BY user_id"


@query(f"SELECT 'ex:user/' || user_id AS r, 'ex:graph' AS c, last AS document FROM ({_LAST}) WHERE last <> 'signup'")
def replay(pods):
    return changes.replay(_log(pods))


@query("SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, count(*) AS transactions FROM events GROUP BY 1")
def transaction_counts(pods):
    return changes.transaction_counts(_log(pods))


@query("SELECT event_id AS transaction_id FROM events WHERE event_type = 'click' AND ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND ts <= (SELECT min(ts) FROM events) + INTERVAL 2 DAY")
def locks(pods):
    events = read(pods.spark, pods.folder, "events")
    first = events.agg(F.min("ts").alias("t")).first()["t"]
    held = events.where("event_type = 'click'").select(F.col("user_id").alias("r"), F.lit(GRAPH).alias("c"), F.col("event_id").alias("transaction_id"), F.col("ts").alias("locked_at"))
    return changes.locks_between(held, first + timedelta(days=1), first + timedelta(days=2)).select("transaction_id")


# RDF text and documents.


@query(f"""SELECT '<http://example.org/ns/' || substr(s, 4) || '> <' || replace(replace(p, 'ex:', 'http://example.org/ns/'), 'rdf:', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#') || '> '
|| CASE WHEN k = 'u' THEN '<http://example.org/ns/' || substr(o, 4) || '>' ELSE '"' || o || '"' END || ' <http://example.org/ns/graph> .' AS value FROM ({_NATION_TRIPLES})""")
def nquads(pods):
    return rdf.to_lines(pods["nations"].triples(), NS, quads=True)


@query(f"""SELECT 'http://example.org/ns/' || substr(s, 4) AS s, k, CASE WHEN k = 'u' THEN replace(replace(o, 'foaf:', 'http://xmlns.com/foaf/0.1/'), 'ex:', 'http://example.org/ns/') ELSE o END AS o FROM ({_CUSTOMER_TRIPLES})""")
def ntriples_round_trip(pods):
    return rdf.parse_lines(rdf.to_lines(pods["customers"].triples(), NS)).select("s", "k", "o")


@query(f"SELECT c, s, p, k, o FROM ({_CUSTOMER_TRIPLES})")
def json_round_trip(pods):
    return from_json(to_json(pods["customers"]), "document").triples().select("c", "s", "p", "k", "o")


@query("SELECT DISTINCT c, s, p, k, o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
def documents_of_triples(pods):
    return from_triples(read(pods.spark, pods.folder, "triples")).triples().select("c", "s", "p", "k", "o")


_SPACE = "regexp_extract({}, '(?i)^(https?://.*[/#])[^/#]*$', 1)".format


@query(f"""SELECT part, namespace, count(*) AS uses FROM (SELECT 'predicate' AS part, {_SPACE('p')} AS namespace FROM triples UNION ALL SELECT 'object', {_SPACE('o')} FROM triples WHERE k = 'u')
WHERE namespace <> '' GROUP BY ALL HAVING part = 'predicate' OR count(*) > 500""")
def namespace_report(pods):
    return rdf.namespace_report(read(pods.spark, pods.folder, "triples"), NS)


@query("SELECT part, uri, count(*) AS uses FROM (SELECT 'subject' AS part, s AS uri FROM triples UNION ALL SELECT 'object', o FROM triples WHERE k = 'u') WHERE regexp_matches(uri, '^https?://') GROUP BY ALL")
def full_uri_report(pods):
    return rdf.full_uri_report(read(pods.spark, pods.folder, "triples"))
