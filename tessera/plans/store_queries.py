"""Queries of a configured store: saves, generation on demand, propagation, queue, log; and their text for DuckDB.

Each query sets up a store of its own below the shared folder: customers are stored, the other pods are only read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graphs
from tessera.operators.store import Store, maintain
from tessera.plans.config import Config
from tessera.plans.engine_queries import _CUSTOMER_TRIPLES, _CUSTOMERS, _ORDERS, _field, flat
from tessera.plans.sample_pods import GRAPH, NS, Pods
from tessera.session import shared_folder, written
from tessera.sources import rdf
from tessera.sources.pods import WidePod

NOW = datetime(2024, 5, 1)
CONFIG = {
    "defaultContext": GRAPH, "namespaces": NS.uris, "data_sources": {"here": {"type": "folder"}}, "transaction_log": {"data_source": "here"},
    "stores": {"shop": {
        "data_source": "here",
        "pods": {"customers": {"cardinality": {"foaf:name": 1, "ex:nation": 1}}, "orders": {}, "nations": {}, "regions": {}},
        "table_specifications": [
            {"_id": "t_customers", "type": "foaf:Person", "from": "customers", "fields": [_field("name", "foaf:name"), _field("segment", "ex:segment")], "joins": {"ex:nation": {"from": "nations", "fields": [_field("nation", "ex:name")]}}},
            {"_id": "t_sales", "type": "ex:Order", "from": "orders", "fields": [_field("total", "ex:total")], "joins": {"ex:customer": {"from": "customers", "fields": [_field("customer", "foaf:name")]}}},
        ],
        "view_specifications": [{"_id": "v_customer", "type": "foaf:Person", "from": "customers", "include": ["foaf:name"], "joins": {"ex:nation": {"from": "nations", "joins": {"ex:region": {"from": "regions"}}}}}],
        "search_config": {"search_specifications": [{
            "_id": "i_customer", "type": "foaf:Person", "from": "customers", "filter": [{"condition": {"ex:segment.l": {"$in": ["MACHINERY", "BUILDING"]}}}],
            "fields": [_field("name", "foaf:name")], "indices": [_field("terms", "foaf:name", "ex:segment")],
        }]},
    }},
}


def shop(pods: Pods, *made: tuple[str, str]) -> Store:
    """A store with all customers, and the composites named."""
    given = {n: pods[n] for n in ("orders", "nations", "regions")}
    store = Store(pods.spark, Config.of(CONFIG, "max"), "shop", shared_folder(pods.spark, "shop"), given)
    none = F.lit(None)
    people = pods["customers"]
    rows = people.frame.select("r", "c", people.all_values().alias("props"), F.lit(0).cast("bigint").alias("_version"), F.lit(NOW).cast("timestamp").alias("_cts"), none.cast("timestamp").alias("_uts"))
    store.descriptions("customers").create(rows)
    for kind, name in made:
        store.generate(kind, name)
    return store


def _machinists(store: Store) -> tuple[DataFrame, DataFrame]:
    """What is stored of the customers of one segment, and what shall be: names in lower case."""
    t = store.pod("customers").triples()
    before = t.join(graphs.subjects(t, p="ex:segment", o="MACHINERY"), "s", "left_semi")
    return before, before.withColumn("o", F.when(F.col("p") == "foaf:name", F.lower("o")).otherwise(F.col("o")))


def _saved(pods: Pods, *made: tuple[str, str], queued: tuple[str, ...] = ()) -> Store:
    store = shop(pods, *made)
    before, after = _machinists(store)
    store.save("customers", before, after, description="lower", now=NOW, queued=queued)
    return store


def save_descriptions(pods):
    return _saved(pods)._keyed("pods", "customers").read().select(F.col("r").alias("s"), "_version", F.explode("props").alias("x")).select("s", "_version", "x.p", "x.k", F.col("x.v").alias("o"))


def save_table_rows(pods):
    """A table that starts in the pod that changes, after the save."""
    return flat(_saved(pods, ("table", "t_customers")).table("table", "t_customers").read())


def save_joined_rows(pods):
    """A table of another pod that joins what changes, after the save."""
    return flat(_saved(pods, ("table", "t_sales")).table("table", "t_sales").read())


def save_queued(pods):
    """The same, handed on to the queue and applied by its reader."""
    store = _saved(pods, ("table", "t_sales"), queued=("table", "view", "search"))
    maintain(store, shared_folder(pods.spark, "queue")).awaitTermination()
    return flat(store.table("table", "t_sales").read())


def save_log(pods):
    return _saved(pods).log().groupBy("status", "description").agg(F.count("r").alias("subjects"), F.count("document").alias("documents"))


def save_rolled_back(pods):
    """A second name for every customer is refused: nothing changes, nothing stays in progress."""
    from tessera.operators.store import SaveError

    store = shop(pods, ("table", "t_customers"))
    before, after = _machinists(store)
    names = before.where("p = 'foaf:name'").withColumn("o", F.concat("o", F.lit(" II")))
    try:
        store.save("customers", before, after.unionByName(names), now=NOW)
    except SaveError:
        return flat(store.table("table", "t_customers").read())
    raise AssertionError("a second name was saved")


def save_conflicting_removal(pods):
    """A removal of what isn't there fails after the transaction has begun: its last state is failed."""
    from tessera.operators.store import SaveError

    store = shop(pods)
    before, after = _machinists(store)
    try:
        store.save("customers", before.withColumn("o", F.concat("o", F.lit("?"))), after, description="lost", now=NOW)
    except SaveError:
        return store.transactions().select("status", "description", "pod")
    raise AssertionError("a removal of what isn't there was saved")


def replay_log(pods):
    """The changed descriptions put from the log over an older state."""
    store = _saved(pods)
    store.descriptions("customers").create(store.descriptions("customers").read(below=1))
    store.replay("customers")
    return store.pod("customers").triples().select("s", "p", "k", "o")


def view_for_resource(pods):
    """Views on demand: customers of one segment are generated, then those of two are asked for, one of them twice and one unknown."""
    store = shop(pods)
    frame = store.pod("customers")
    of = lambda *segments: frame.frame.where(F.exists(frame.texts("ex:segment"), lambda x: x.isin(*segments))).select("r", "c")
    store.generate("view", "v_customer", of("BUILDING"))
    wanted = of("BUILDING", "FURNITURE").unionByName(of("FURNITURE")).unionByName(pods.spark.createDataFrame([("ex:customer/none", GRAPH)], "r string, c string"))
    return store.views("v_customer", wanted).select("r", F.size("graphs").alias("graphs"), F.size("impact_index").alias("impact"))


def expired_views(pods):
    """Views that have expired are made anew: all of them, as they lived a second and are asked for an hour later."""
    raw = {**CONFIG, "stores": {"shop": {**CONFIG["stores"]["shop"], "view_specifications": [{**CONFIG["stores"]["shop"]["view_specifications"][0], "ttl": 1}]}}}
    store = shop(pods)
    store.config = Config.of(raw).store("shop")
    store.generate("view", "v_customer")
    some = store.pod("customers").frame.where(F.col("r").endswith("7")).select("r", "c")
    before = store.table("view", "v_customer").newest()
    rows = store.views("v_customer", some, datetime(2100, 1, 1))
    return rows.select("r", F.lit(store.table("view", "v_customer").newest() - before).cast("bigint").alias("made"), F.col("impact_index").isNull().alias("without_index"))


def generate_by_type(pods):
    store = shop(pods)
    done = store.generate_for_type("http://xmlns.com/foaf/0.1/Person")
    rows = [store.read(kind, [name]).select(F.lit(kind).alias("kind"), "spec", "r") for kind, name in done]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("kind", "spec").agg(F.count("r").alias("composites"))


def regenerate_and_delete(pods):
    """Search documents of some subjects are deleted, and of half of them made again."""
    store = shop(pods, ("search", "i_customer"))
    keys = store.table("search", "i_customer").read().where(F.col("r").endswith("3") | F.col("r").endswith("4")).select("r", "c")
    store.composites["search"].delete(store, keys)
    store.regenerate("search", keys.where(F.col("r").endswith("3")), "customers")
    return flat(store.composites["search"].search(store, "customer#0", "i_customer", ["terms"], ["name"], 0))


def search_pages(pods):
    """The second page of a search by two terms, in the order of the subjects."""
    store = shop(pods, ("search", "i_customer"))
    return store.composites["search"].search(store, "MACHINERY customer", "i_customer", ["terms"], ["name"], 7, 7)


def impacted_search(pods):
    store = shop(pods, ("search", "i_customer"))
    hit = store.pod("customers").triples().where("p = 'ex:segment' AND o IN ('MACHINERY', 'FURNITURE')").select("c", "s", F.lit("ex:segment").alias("p"))
    return store.composites["search"].impacted(store, store.config.specification("search", "i_customer"), hit, "customers").select(F.col("root_r").alias("r"))


def impacted_subjects(pods):
    """Everything that new names of some customers touch, over all specifications and pods."""
    store = shop(pods, ("table", "t_customers"), ("table", "t_sales"), ("view", "v_customer"), ("search", "i_customer"))
    hit = store.pod("customers").triples().where("p = 'ex:segment' AND o = 'MACHINERY'").select("c", "s", F.lit("foaf:name").alias("p"))
    return flat(store.impacted_subjects(hit, "customers").select(F.col("root_r").alias("r"), "specs"))


def load_lines(pods):
    """N-Triples into a pod that has some of them: customers, and suppliers that the list of types keeps out; loaded twice, so merged."""
    store = shop(pods)
    flat_names = lambda t: t.withColumn("s", F.replace("s", F.lit("r/"), F.lit("r-")))
    # A small file makes many lines: its rows are dealt out first, and the lines written once for both loads.
    spread = lambda pod: WidePod(pod.frame.repartition("r"), pod.columns)
    people = flat_names(spread(pods["customers"]).triples())
    lines = written(rdf.to_lines(people.unionByName(flat_names(spread(pods["suppliers"]).triples())), NS), "n-triples")
    store.descriptions("customers").create(store.pod("customers").frame.where(F.lit(False)))
    store.merge("customers", people.where("p = 'ex:segment'"))
    store.load("customers", lines, ["http://xmlns.com/foaf/0.1/Person"])
    store.load("customers", lines, ["foaf:Person"])
    return store.pod("customers").triples().select("c", F.replace("s", F.lit("r-"), F.lit("r/")).alias("s"), "p", "k", "o")


def types_in_specifications(pods):
    store = Config.of(CONFIG).store("shop")
    rows = [(kind, t) for kind in store.specifications for t in store.types(kind)]
    return pods.spark.createDataFrame(rows, "kind string, type string")


_LOWER = f"SELECT r, CASE WHEN segment = 'MACHINERY' THEN lower(name) ELSE name END AS name, segment, balance, nation FROM ({_CUSTOMERS})"
_NATION = "(SELECT n_name FROM nation WHERE 'ex:nation/' || n_nationkey = k.nation)"
_T_SALES = f"SELECT o.r AS r, 'ex:graph' AS c, o.total AS total, coalesce(k.name, '') AS customer FROM ({_ORDERS}) o LEFT JOIN ({_LOWER}) k ON o.customer = k.r"
_LOWERED_TRIPLES = f"SELECT t.s AS s, t.p AS p, t.k AS k, CASE WHEN t.p = 'foaf:name' AND n.segment = 'MACHINERY' THEN lower(t.o) ELSE t.o END AS o FROM ({_CUSTOMER_TRIPLES}) t JOIN ({_CUSTOMERS}) n ON n.r = t.s"
_SEARCHED = f"SELECT r, 'ex:graph' AS c, name FROM ({_CUSTOMERS}) WHERE segment IN ('MACHINERY', 'BUILDING')"

_ALL = (
    save_descriptions, save_table_rows, save_joined_rows, save_queued, save_log, save_rolled_back, save_conflicting_removal, replay_log, view_for_resource, expired_views,
    generate_by_type, regenerate_and_delete, search_pages, impacted_search, impacted_subjects, load_lines, types_in_specifications,
)
QUERIES = {f"q_{f.__name__}": (lambda f: lambda spark, d: f(Pods(spark, d)))(f) for f in _ALL}
SQL = {
    "q_save_descriptions": f"SELECT s, p, k, o, CAST(CASE WHEN n.segment = 'MACHINERY' THEN 1 ELSE 0 END AS BIGINT) AS _version FROM ({_LOWERED_TRIPLES}) JOIN ({_CUSTOMERS}) n ON n.r = s",
    "q_save_table_rows": f"SELECT r, 'ex:graph' AS c, name, segment, coalesce({_NATION}, '') AS nation FROM ({_LOWER}) k",
    "q_save_joined_rows": _T_SALES,
    "q_save_queued": _T_SALES,
    "q_save_log": f"SELECT 'in_progress' AS status, 'lower' AS description, 0 AS subjects, 0 AS documents UNION ALL SELECT 'completed', 'lower', count(*), count(*) FROM ({_CUSTOMERS}) WHERE segment = 'MACHINERY'",
    "q_save_rolled_back": f"SELECT r, 'ex:graph' AS c, name, segment, coalesce({_NATION}, '') AS nation FROM ({_CUSTOMERS}) k",
    "q_save_conflicting_removal": "SELECT 'failed' AS status, 'lost' AS description, 'customers' AS pod",
    "q_replay_log": _LOWERED_TRIPLES,
    "q_view_for_resource": f"SELECT r, 3 AS graphs, 3 AS impact FROM ({_CUSTOMERS}) WHERE segment IN ('BUILDING', 'FURNITURE')",
    "q_expired_views": f"SELECT r, CAST(1 AS BIGINT) AS made, true AS without_index FROM ({_CUSTOMERS}) WHERE r LIKE '%7'",
    "q_generate_by_type": f"SELECT 'table' AS kind, 't_customers' AS spec, count(*) AS composites FROM customer UNION ALL SELECT 'view', 'v_customer', count(*) FROM customer UNION ALL SELECT 'search', 'i_customer', count(*) FROM ({_SEARCHED})",
    "q_regenerate_and_delete": f"SELECT r, c, name FROM ({_SEARCHED}) WHERE r NOT LIKE '%4'",
    "q_search_pages": f"SELECT r, 'ex:graph' AS c, name FROM ({_CUSTOMERS}) WHERE segment = 'MACHINERY' ORDER BY r LIMIT 7 OFFSET 7",
    "q_impacted_search": f"SELECT r FROM ({_CUSTOMERS}) WHERE segment = 'MACHINERY'",
    "q_impacted_subjects": f"SELECT r, 'i_customer;t_customers;v_customer' AS specs FROM ({_CUSTOMERS}) WHERE segment = 'MACHINERY' UNION ALL SELECT o.r, 't_sales' FROM ({_ORDERS}) o JOIN ({_CUSTOMERS}) k ON o.customer = k.r WHERE k.segment = 'MACHINERY'",
    "q_load_lines": f"SELECT c, s, p, k, CASE WHEN p = 'ex:nation' THEN replace(o, 'ex:', 'http://example.org/ns/') ELSE o END AS o FROM ({_CUSTOMER_TRIPLES})",
    "q_types_in_specifications": "SELECT * FROM (VALUES ('view', 'foaf:Person'), ('table', 'foaf:Person'), ('table', 'ex:Order'), ('search', 'foaf:Person')) v(kind, type)",
}
