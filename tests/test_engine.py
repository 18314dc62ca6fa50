"""The engine's operators on small pods: golden rows, quirks, refusals, and refresh against full recomputation."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions.scalars import SpecError, Value
from tessera.operators import adhoc, changes, composites, graphs, impact
from tessera.plans import compiler, specs
from tessera.plans.filters import FilterError, document_filter, with_context
from tessera.operators.store import Hook, SaveError, Store
from tessera.plans.config import Config, ConfigError
from tessera.sources import rdf
from tessera.sources.keyed import ConflictError, KeyedTable
from tessera.sources.pods import PROPS, PropsPod, from_json, to_json
from tessera.streaming.maintain import maintain

G = "g"


def pod(spark, **subjects):
    """subject=[(p, k, v), ...]; places are counted per predicate."""
    rows = []
    for r, values in subjects.items():
        seen: dict = {}
        props = []
        for p, k, v in values:
            props.append((p, seen.get(p, 0), k, v))
            seen[p] = seen.get(p, 0) + 1
        rows.append((f"ex:{r}", G, props))
    return PropsPod(spark.createDataFrame(rows, f"r string, c string, props {PROPS}"))


@pytest.fixture(scope="module")
def pods(spark):
    books = pod(
        spark,
        b1=[("rdf:type", "u", "ex:Book"), ("ex:title", "l", "Moon"), ("ex:title", "l", "Luna"), ("ex:by", "u", "ex:p2"), ("ex:by", "u", "ex:p1"), ("ex:by", "u", "ex:p2"), ("ex:by", "u", "ex:gone"), ("ex:by", "l", "ex:p1"), ("ex:made", "l", "2020-01-02 03:04:05")],
        b2=[("rdf:type", "u", "ex:Book"), ("rdf:type", "u", "ex:Rare"), ("ex:title", "l", "Sun"), ("ex:pages", "l", "0")],
        s1=[("rdf:type", "u", "rdf:Seq"), ("rdf:_1", "u", "ex:b2"), ("rdf:_2", "u", "ex:b1"), ("rdf:_10", "u", "ex:b2"), ("rdf:_4", "u", "ex:b1")],
    )
    people = pod(spark, p1=[("rdf:type", "u", "ex:Person"), ("ex:name", "l", "Ann"), ("ex:knows", "u", "ex:p2")], p2=[("rdf:type", "u", "ex:Person"), ("ex:name", "l", "Bo")])
    return {"books": books, "people": people}


TABLE = {
    "_id": "t", "type": ["ex:Book"], "from": "books",
    "fields": [{"fieldName": "title", "predicates": ["ex:title"]}, {"fieldName": "made", "predicates": [{"date": {"predicates": ["ex:made"]}}], "temporary": True}],
    "joins": {"ex:by": {"from": "people", "fields": [{"fieldName": "names", "predicates": ["ex:name"]}], "counts": [{"fieldName": "friends", "property": "ex:knows"}],
                        "joins": {"ex:knows": {"from": "people", "fields": [{"fieldName": "names", "predicates": ["ex:name"]}]}}}},
    "computed_fields": [{"fieldName": "old", "value": {"conditional": {"if": ["$made", "<", "2021-01-01"], "then": "yes", "else": "no"}}}],
}


def test_table_rows_accumulate_in_order(pods, ns):
    rows = {r.r: r for r in compiler.table(TABLE, pods, ns).collect()}
    assert rows["ex:b1"].names == ["Bo", "Ann", "Bo"] and rows["ex:b1"].title == ["Moon", "Luna"] and rows["ex:b1"].friends == 1 and rows["ex:b1"].old == "yes"
    assert [x.r for x in rows["ex:b1"].impact_index] == ["ex:b1", "ex:gone", "ex:p1", "ex:p2"]
    assert rows["ex:b2"].names == [] and rows["ex:b2"].friends == 0 and rows["ex:b2"].old == "no" and "made" not in rows["ex:b2"]
    single = {r.r: r for r in composites.scalars_where_single(compiler.table(TABLE, pods, ns)).collect()}
    assert single["ex:b2"].title == "Sun" and single["ex:b2"].names is None and single["ex:b1"].title == '["Moon","Luna"]'


def test_table_pages(pods, ns):
    rows = compiler.table(TABLE, pods, ns)
    page = composites.table_page(rows, {"value.friends": {"$gte": 0}}, {"value.title": 1}, 1, 1)
    assert page.count == 2 and [r.r for r in page.results.collect()] == ["ex:b2"] and "impact_index" not in page.results.columns
    assert composites.table_rows(rows, limit=0, offset=1).count() == 2 and composites.table_page(rows, include_count=False).count == -1
    assert sorted(r.value for r in composites.distinct_column_values(rows, "title").collect()) == ["Luna", "Moon", "Sun"]
    assert composites.distinct_column_values(rows, "none").count() == 0
    with pytest.raises(FilterError):
        composites.table_rows(rows, {"value.none": 1})


def test_sequences_and_views(pods, ns):
    spec = {"_id": "v", "type": "rdf:Seq", "from": "books", "include": ["rdf:type", "_seq_"], "joins": {"followSequence": {"maxJoins": 4, "include": ["ex:title"]}}}
    graphs_ = compiler.view(spec, pods, ns)
    rows = {r.r: r for r in graphs_.collect()}
    assert sorted(p.p for p in rows["ex:s1"].props) == ["rdf:_1", "rdf:_2", "rdf:type"] and set(rows) == {"ex:s1", "ex:b1", "ex:b2"}
    view = compiler.nested_view(graphs_, compiler.impact_index(spec, pods, ns), "v").first()
    assert [g.r for g in view.graphs] == ["ex:b2", "ex:b1", "ex:s1"] and [x.r for x in view.impact_index] == ["ex:b1", "ex:b2", "ex:s1"] and view.expires is None
    short = compiler.nested_view(graphs_, None, "v", ttl=60)
    assert short.first().expires is not None and short.first().impact_index is None
    later = datetime(2999, 1, 1)
    assert composites.missing_views(short, short, later).count() == 1 and composites.missing_views(short, short, datetime(2000, 1, 1)).count() == 0
    assert composites.query_views(short, {"ex:title.l": "Sun"}).count() == 1 and composites.query_views(short, {"ex:title.l": "Mars"}).count() == 0


def test_filters(pods):
    books = pods["books"]
    names = lambda q: sorted(r.r for r in adhoc.select(books, q, []).collect())
    assert names({"ex:title.l": "Luna"}) == ["ex:b1"] and names({"ex:title": {"l": "Luna"}}) == ["ex:b1"] and names({"ex:by.l": "ex:p1", "ex:by.u": "ex:p2"}) == ["ex:b1"]
    assert names({"ex:pages.l": {"$lt": 1}}) == ["ex:b2"] and names({"ex:none": {"$exists": False}, "_id": {"r": "ex:s1"}}) == ["ex:s1"]
    assert names({"ex:title.l": {"$nin": ["Moon"]}}) == ["ex:b2", "ex:s1"] and names({"ex:title.l": {"$all": [{"$regex": "^M"}, "Luna"]}}) == ["ex:b1"]
    assert with_context({"_id": {"r": "x"}}, "g") == {"_id": {"r": "x", "c": "g"}} and with_context({"$or": [{"a": 1}]}, "g") == {"$or": [{"a": 1, "_id.c": "g"}]}
    for bad in ({"$where": "x"}, {"a": {"$near": 1}}, {"$or": []}):
        with pytest.raises(FilterError):
            document_filter(books, bad)


def test_adhoc(pods):
    books = pods["books"]
    assert {r.key: r["count"] for r in adhoc.count_by(books, {}, "ex:title").collect()} == {"Moon;Luna": 1, "Sun": 1, "": 1}
    page = adhoc.page(books, {}, ["ex:title"], {"ex:title.l": 1}, 1, 1)
    assert page.count == 3 and [r.r for r in page.results.collect()] == ["ex:b1"]
    now = [0.0]
    cache = adhoc.CountCache(lambda: now[0])
    assert cache.get(books, {}, None, 5) == 3 and cache.get(books, {}, "ex:title", 5)["Sun"] == 1
    smaller = books.only(F.col("r") == "ex:b1")
    assert cache.get(smaller, {}, None, 5) == 3
    now[0] = 6
    assert cache.get(smaller, {}, None, 5) == 1


def test_search(pods, ns):
    spec = {"_id": "s", "type": "ex:Book", "from": "books", "filter": [{"condition": {"ex:name.l": "x"}, "from": "people"}, {"condition": {"ex:title": {"$exists": True}}}],
            "fields": [{"fieldName": "title", "predicates": ["ex:title"], "limit": 1}], "indices": [{"fieldName": "terms", "predicates": ["ex:title"]}], "joins": {"ex:by": {"from": "people", "indices": [{"fieldName": "terms", "predicates": ["ex:name"]}]}}}
    rows = compiler.search_documents(spec, pods, ns)
    assert {r.r: (r.title, r.terms) for r in rows.collect()} == {"ex:b1": (["Moon"], ["moon", "luna", "bo", "ann"]), "ex:b2": (["Sun"], ["sun"])}
    assert [r.r for r in composites.search(rows, "the LUNA and Bo", "s", ["terms"], ["title"]).collect()] == ["ex:b1"]
    assert composites.search(rows, "l(una", "s", ["terms"], ["title", "none"]).count() == 0 and composites.search(rows, "l.na", "s", ["terms"], ["title"], raw=True).count() == 1
    assert composites.search_terms("the of") == ["the", "of"]
    for bad in (("", "s", ["t"], ["t"]), ("x", "s", [], ["t"]), ("x", "s", ["t"], ["t"], -1)):
        with pytest.raises(composites.SearchError):
            composites.search(rows, *bad)


def test_scalars(spark):
    row = spark.range(1)
    fields = {"n": scalars.literal("7"), "z": scalars.literal("0"), "many": scalars.literal(["a", "b"]), "t": scalars.literal("ab")}
    value = lambda spec: row.select(scalars.compute(spec, fields).column.alias("x")).first()["x"]
    if_ = lambda *x: value({"conditional": {"if": list(x), "then": True, "else": False}})
    assert value({"arithmetic": ["$n", "/", 0]}) is None and value({"arithmetic": ["$t", "+", 1]}) is None and value({"arithmetic": [["$n", "*", 2], "%", 4]}) == 2
    assert [if_("$z"), if_("$n"), if_("$none"), if_("$many"), if_("$n", ">", 10), if_("$n", "==", "7.0"), if_("$many", "contains", "b"), if_("$t", "not contains", "b"), if_("$t", "!~", "/B/i"), if_("$none", "!=", "x")] == [False, True, False, True, False, True, True, False, False, True]
    assert value({"replace": {"search": ["a", "x"], "replace": ["x", "y"], "subject": "$t"}}) == "yb" and value({"conditional": {"if": ["$z"], "then": "x"}}) is None
    bad_date = scalars.date(Value(F.array(F.lit("nonsense")), "texts")).column
    assert row.select(F.unix_millis(bad_date)).first()[0] == 0 and row.select(scalars.date(Value(F.array().cast("array<string>"), "texts")).column).first()[0] is None


@pytest.mark.parametrize(("kind", "change"), [
    ("table", {"_id": None}), ("table", {"fields": [], "joins": {}, "computed_fields": []}), ("table", {"fields": [{"predicates": ["a"]}]}), ("table", {"fields": [{"fieldName": "a", "predicates": [{"upper": {}}]}]}),
    ("table", {"computed_fields": [{"fieldName": "x", "value": {"conditional": {"if": ["$none"], "then": 1}}}]}), ("table", {"computed_fields": [{"fieldName": "x", "value": {"arithmetic": [1, "^", 2]}}]}),
    ("view", {"joins": None, "from": "nowhere"}), ("search", {}), ("table", {"joins": {"ex:by": {"computed_fields": []}}}),
])
def test_bad_specs(kind, change):
    with pytest.raises(SpecError):
        specs.validate({**TABLE, **change}, kind, {"books", "people"})


def test_mentioned_predicates():
    assert specs.predicates(TABLE) == {"rdf:type", "ex:title", "ex:made", "ex:by", "ex:name", "ex:knows"} and specs.temporary_fields(TABLE) == {"made"}
    assert "ex:deep" in specs.predicates({"type": "x", "filter": [{"condition": {"$or": [{"ex:deep.l": 1}]}}]})


def test_graphs(spark, pods):
    t = pods["people"].triples()
    other = t.where("o <> 'Bo'")
    assert graphs.difference(t, other).count() == 1 and not graphs.equal(t, other) and graphs.equal(t, t.unionByName(t)) and graphs.changes(t, other).first()["op"] == "remove"
    blank = spark.createDataFrame([("_:a", "ex:p", "b", "_:a"), ("ex:x", "ex:p", "l", "_:a")], "s string, p string, k string, o string")
    assert graphs.merge(blank, blank).count() == 3 and graphs.union(blank, blank).count() == 2
    assert graphs.has(t, p="ex:name", o="Ann") and not graphs.has(t, o="none") and graphs.reify(t).count() == 4 * t.count()
    seq = graphs.remove_from_sequence(pods["books"].triples(), "ex:s1", "ex:b1")
    assert [(r.n, r.o) for r in graphs.sequence_values(seq).orderBy("n").collect()] == [(1, "ex:b2"), (2, "ex:b2")]
    assert graphs.next_in_sequence(pods["books"].triples()).first()["p"] == "rdf:_11" and graphs.remove(t).count() == 0
    assert graphs.first_resource(t, "ex:knows").first()["o"] == "ex:p2" and graphs.subjects(t, p="rdf:type", o="ex:Person").count() == 2


def test_changes(pods, at):
    t = pods["people"].triples()
    after = t.withColumn("o", F.when(F.col("o") == "Ann", "Anna").otherwise(F.col("o")))
    saved, change = changes.save(t, after, t, G, ["ex:name"])
    assert graphs.equal(saved, after) and change.count() == 2
    with pytest.raises(changes.ChangeError):
        changes.apply_changes(saved, change)
    with pytest.raises(changes.CardinalityError):
        changes.check_cardinality(t.unionByName(after), ["ex:name"])
    log = t.sparkSession.createDataFrame([(1, at(1), "completed", "a", G, "x"), (2, at(2), "completed", "a", G, "y"), (3, at(2), "completed", "a", G, "z"), (4, at(3), "failed", "a", G, "w"), (5, at(3), "completed", "b", G, None)], "id int, end_time timestamp, status string, r string, c string, document string")
    assert [r.document for r in changes.replay(log).collect()] == ["z"] and [r.document for r in changes.replay(log, until=at(1)).collect()] == ["x"]
    into = t.sparkSession.createDataFrame([("b", G, "old"), ("c", G, "kept")], "r string, c string, document string")
    assert sorted(r.document for r in changes.replay(log, into=into).collect()) == ["kept", "z"] and changes.purge(log, at(2)).count() == 4
    locks = log.select("r", "c", F.col("id").cast("string").alias("transaction_id"), F.col("end_time").alias("locked_at"))
    left, audit = changes.remove_locks(locks, "1", "stuck", at(9))
    assert left.count() == 4 and audit.first()["reason"] == "stuck" and changes.locks_between(locks, at(2), None).count() == 4


def test_rdf_text(spark, ns):
    lines = ['<http://x.example/ns#a> <http://p> "q\\"\\u00e9\\n"@en .', "_:b <http://p> _:c <http://g> . # note", '<a> <p> "5"^^<http://t> .', "# nothing", "", "broken", None]
    rows = {r.s: r for r in rdf.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert (rows["http://x.example/ns#a"].o, rows["http://x.example/ns#a"].lang) == ('q"é\n', "en") and rows["_:b"].k == "b" and rows["_:b"].g == "http://g" and rows["a"].dt == "http://t" and len(rows) == 3
    turtle = '@prefix ex: <http://x.example/ns#> . ex:a a ex:T ; ex:p "one"@en , "2"^^ex:int . # end\n<http://b> ex:q _:n .'
    got = {(r.s, r.p, r.o, r.lang, r.dt) for r in rdf.parse_turtle(spark.createDataFrame([(turtle,)], "value string")).collect()}
    x = "http://x.example/ns#"
    assert got == {(x + "a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", x + "T", None, None), (x + "a", x + "p", "one", "en", None), (x + "a", x + "p", "2", None, x + "int"), ("http://b", x + "q", "_:n", None, None)}
    rdf_json = '{"s": {"p": [{"type": "uri", "value": "o"}, {"type": "literal", "value": "l", "lang": "en"}]}}'
    assert {(r.o, r.k, r.lang) for r in rdf.parse_rdf_json(spark.createDataFrame([(rdf_json,), ("{",)], "value string")).collect()} == {("o", "u", None), ("l", "l", "en")}


def test_json_documents(spark, pods):
    round_trip = from_json(to_json(pods["books"]), "document").triples()
    assert graphs.equal(round_trip, pods["books"].triples())
    odd = from_json(spark.createDataFrame([('{"_id":{"r":"a","c":"g"},"_version":3,"p":[{"u":"x"},{"z":1},{"l":"y"}],"q":{"l":"0"}}',), ("{",), (None,), ('{"p":1}',)], "d string"), "d")
    assert sorted((r.p, r.k, r.o) for r in odd.triples().collect()) == [("p", "l", "y"), ("p", "u", "x"), ("q", "l", "0")]


def test_refresh_from_a_stream(spark, pods, ns, tmp_path):
    """Batches of changes leave the store as a full recomputation would."""
    store = KeyedTable(spark, str(tmp_path / "store"), 4)
    store.create(compiler.table(TABLE, pods, ns))
    renamed = pod(spark, p1=[("rdf:type", "u", "ex:Person"), ("ex:name", "l", "Anna"), ("ex:knows", "u", "ex:p2")], p2=[("rdf:type", "u", "ex:Person"), ("ex:name", "l", "Bo")])
    after = {**pods, "people": renamed}
    spark.createDataFrame([(G, "ex:p1", "ex:name"), (G, "ex:b2", "ex:other")], "c string, s string, p string").write.parquet(str(tmp_path / "changes"))
    stream = spark.readStream.schema("c string, s string, p string").parquet(str(tmp_path / "changes"))
    keys = []

    def keys_of(rows, batch):
        found = impact.to_refresh(rows, after["books"], batch, TABLE, ns)
        keys.extend(r.root_r for r in found.collect())
        return found

    maintain(stream, store, keys_of, lambda k: compiler.table(TABLE, after, ns, only=k), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert set(keys) == {"ex:b1"} and sorted(map(str, store.read().collect())) == sorted(map(str, compiler.table(TABLE, after, ns).collect()))
    assert composites.delete_by_keys(store.read(), spark.createDataFrame([("ex:b1", G)], "r string, c string")).count() == 1


def test_entry_points_agree():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries()) and {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found"} <= set(contract.queries())


def test_list_values_of_a_long_list(spark):
    def triples(count, end):
        node = lambda k: f"_:l{k}"
        rows = [(node(k), "rdf:first", f"v{k}") for k in range(count)] + [(node(k), "rdf:rest", node(k + 1) if k + 1 < count else end) for k in range(count)]
        return spark.createDataFrame(rows + [("_:x", "rdf:rest", "_:x")], "s string, p string, o string")

    for count in (1, 2, 150, 3000):
        got = sorted((r.n, r.o) for r in graphs.list_values(triples(count, "rdf:nil"), "_:l0").collect())
        assert got == [(k + 1, f"v{k}") for k in range(count)]
    with pytest.raises(ValueError, match="tail"):
        graphs.list_values(triples(20, "_:l5"), "_:l0")


def test_keyed_tables(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "r string, c string, v int")
    table = KeyedTable(spark, str(tmp_path / "t"), 4)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.create(rows(*[(f"s{n}", G, n) for n in range(20)]))
    assert table.replace(rows(("s1", G, 100), ("new", G, 7)), rows(("s1", G, 0), ("s2", G, 0)).select("r", "c"), expected=0) == 1
    got = {r.r: r.v for r in table.read().collect()}
    assert got == {f"s{n}": n for n in range(20) if n != 2} | {"s1": 100, "new": 7} and table.read(below=1).count() == 20
    with pytest.raises(ConflictError):
        table.replace(rows(("s3", G, 1)), rows(("s3", G, 1)).select("r", "c"), expected=0)
    # The same batch again gives the same version.
    for _ in range(2):
        table.replace(rows(("s4", G, 44)), rows(("s4", G, 1)).select("r", "c"), version=5)
    assert table.versions() == [0, 1, 5] and {r.r: r.v for r in table.read().collect()} == got | {"s4": 44}
    table.replace(rows().limit(0) if False else spark.createDataFrame([], "r string, c string, v int"), table.read().select("r", "c"))
    assert table.read().count() == 0 and table.read(below=6).count() == 20
    table.expire(1)
    assert table.versions() == [6] and table.read().columns == ["r", "c", "v"]


def test_configurations():
    good = {"defaultContext": G, "data_sources": {"d": {}}, "transaction_log": {"data_source": "d"}, "stores": {"s": {"data_source": "d", "pods": {"books": {"cardinality": {"ex:by": 1}}}, "table_specifications": [{**TABLE, "_id": "t"}]}}}
    good["stores"]["s"]["pods"]["people"] = {}
    config = Config.of(good, "max")
    assert Config.of(config.serialised() and good).store("s").single("books") == ["ex:by"] and config.store("s").types("table") == ["ex:Book"]
    for member in good:
        with pytest.raises(ConfigError, match=member):
            Config.of({k: v for k, v in good.items() if k != member})
    store = good["stores"]["s"]
    bad = ({"data_source": "none"}, {"pods": {"books": {"cardinality": {"ex:by": 2}}, "people": {}}}, {"table_specifications": [store["table_specifications"][0]] * 2}, {"table_specifications": [{"_id": "t", "type": "ex:Book", "from": "nowhere", "fields": []}]})
    for change in bad:
        with pytest.raises(ConfigError):
            Config.of({**good, "stores": {"s": {**store, **change}}})
    inside = {**good, "stores": {"s": {**store, "table_specifications": [{"_id": "t", "type": "ex:Book", "from": "books", "fields": [{"fieldName": "x"}]}]}}}
    assert Config.of(inside)
    with pytest.raises(ConfigError):
        Config.of(inside, "max")


def test_hooks_that_fail_are_counted(spark, tmp_path):
    class Bad(Hook):
        def pre(self, save):
            raise ValueError("no")

        def success(self, save):
            told.append(save["description"])

        def failure(self, save, error):
            told.append(str(error))

    told = []
    config = Config.of({"defaultContext": G, "data_sources": {"d": {}}, "transaction_log": {"data_source": "d"}, "stores": {"s": {"data_source": "d", "pods": {"books": {"cardinality": {"ex:by": 1}}}}}})
    store = Store(spark, config, "s", str(tmp_path / "s"), hooks=[Bad()], buckets=2)
    triples = lambda *x: spark.createDataFrame(x, "s string, p string, k string, o string")
    none = spark.createDataFrame([], "s string, p string, k string, o string")
    store.save("books", none, triples(("ex:a", "ex:by", "u", "ex:p1")), description="first")
    assert store.pod("books").triples().count() == 1 and store.statistics.counts["hook.pre.failed"] == 1
    with pytest.raises(SaveError):
        store.save("books", none, triples(("ex:a", "ex:by", "u", "ex:p1"), ("ex:a", "ex:by", "u", "ex:p2")), description="second")
    assert told[0] == "first" and "ex:by" in told[1] and store.pod("books").triples().count() == 1


def test_load_reads_its_lines_once(spark, tmp_path):
    ex, kind = "http://example.org/ns/", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    config = Config.of({"defaultContext": G, "namespaces": {"ex": ex, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}, "data_sources": {"d": {}}, "transaction_log": {"data_source": "d"}, "stores": {"s": {"data_source": "d", "pods": {"books": {}}}}})
    store = Store(spark, config, "s", str(tmp_path / "s"), buckets=2)
    texts = [f"<{ex}a> {kind} <{ex}Book> .", f'<{ex}a> <{ex}name> "A" .', f"<{ex}b> {kind} <{ex}Map> .", f'<{ex}b> <{ex}name> "B" .', f"<{ex}a> <{ex}by> _:x <{ex}g> .", "# none"]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    given = lambda rows, schema: spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    lines = given([(x,) for x in texts], "value string")
    store.load("books", lines, ["ex:Book"])
    assert read.value == len(texts)
    store.load("books", lines, [ex + "Book"])
    assert read.value == 2 * len(texts)
    a = {("ex:a", "rdf:type", "u", "ex:Book"), ("ex:a", "ex:name", "l", "A")}
    held = lambda: sorted((r.s, r.p, r.k, r.o) for r in store.pod("books").triples().collect())
    assert held() == sorted(a) and [r._version for r in store.descriptions("books").read().collect()] == [1]
    store.load("books", lines)
    b = {("ex:b", "rdf:type", "u", "ex:Map"), ("ex:b", "ex:name", "l", "B")}
    assert read.value == 3 * len(texts) and held() == sorted(a | b | {("ex:a", "ex:by", "u", "_:x")})
    store.merge("books", given([(G, "ex:c", "ex:name", 0, "l", "C")], "c string, s string, p string, pos int, k string, o string"))
    assert read.value == 3 * len(texts) + 1 and ("ex:c", "ex:name", "l", "C") in held()


def test_graph_additions(spark):
    rows = spark.createDataFrame([("ex:q", "rdf:_1", 0, "u", "ex:a"), ("ex:q", "rdf:_3", 0, "u", "ex:b"), ("ex:a", "ex:name", 0, "l", "city"), ("ex:a", "ex:name", 1, "l", "Ort")], "s string, p string, pos int, k string, o string")
    new = spark.createDataFrame([("ex:a", "ex:name", 0, "l", "city"), ("ex:a", "ex:see", 0, "u", ""), ("ex:a", "ex:see", 0, "u", "ex:b")], "s string, p string, pos int, k string, o string")
    assert graphs.add(rows, new).count() == 5
    with pytest.raises(graphs.TripleError):
        graphs.add(rows, new.withColumn("s", graphs.F.lit("no name")))
    got = graphs.insert_in_sequence(rows, "ex:q", 2, "u", "ex:new").where("s = 'ex:q'").orderBy("p").collect()
    assert [(r.p, r.o) for r in got] == [("rdf:_1", "ex:a"), ("rdf:_2", "ex:new"), ("rdf:_3", "ex:b")]
    assert sorted(r.o for r in graphs.replace_values(rows, "ex:a", "ex:name", "l", ["town"]).where("p = 'ex:name'").collect()) == ["town"]
    assert sorted(r.o for r in graphs.replace_literal(rows, "ex:a", "ex:name", "Ort", "lieu").where("p = 'ex:name'").collect()) == ["city", "lieu"]
    assert [r.label for r in graphs.plural_label(rows, ["ex:name"], []).where("r = 'ex:a'").collect()] == ["cities"]


def test_text_of_graphs(spark, ns):
    rows = spark.createDataFrame([("g", "ex:a", "ex:n", "l", "é \u0001 \U0001f600 \"q\" \\ \n<&"), ("g", "ex:a", "ex:m", "u", "ex:b"), ("g", "just text", "ex:m", "u", "ex:b")], "c string, s string, p string, k string, o string")
    lines = [r.value for r in rdf.to_lines(rows, ns, quads=True, ascii_only=True).collect()]
    assert len(lines) == 2 and '"\\u00E9 \\u0001 \\U0001F600 \\"q\\" \\\\ \\n<&"' in lines[0], lines
    back = rdf.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).where("k = 'l'").first()
    assert back.o.startswith("é ") and "\U0001f600" in back.o
    turtle = "\n".join(r.value for r in rdf.to_turtle(rows.where("s = 'ex:a'"), ns).collect())
    again = rdf.parse_turtle(spark.createDataFrame([(turtle,)], "value string"))
    assert again.count() == 2 and {r.k for r in again.collect()} == {"u", "l"}
    import xml.dom.minidom

    xml_text = "\n".join(r.value for r in rdf.to_rdf_xml(rows.where("s = 'ex:a'").withColumn("o", graphs.F.regexp_replace("o", "\u0001", "")), ns).orderBy("place").collect())
    assert len(xml.dom.minidom.parseString(xml_text).getElementsByTagName("rdf:Description")) == 1
    assert [r.prefix for r in rdf.suggest_prefixes(spark.createDataFrame([("http://a.example/terms/",), ("http://b.example/ns#",), ("http://c.example/ex/",)], "namespace string"), ns).orderBy("namespace").collect()] == ["terms", "ns", "ex1"]
