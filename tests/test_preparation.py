"""The corpus-preparation operators of the core on small tables: nulls, blanks, ties, repeats, empty tables, further columns."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import attributes, nested, references, skew, timestamps
from tessera.plans import problem_queries

RES = "row_id bigint, id struct<r:string,c:string>, props array<struct<p:string,pos:int,k:string,v:string>>, _version bigint, _cts timestamp, arrived_at timestamp, deleted_at timestamp, r string, c string, target_r string"
PARENT = "row_id bigint, id struct<r:string,c:string>, _version bigint, arrived_at timestamp, deleted_at timestamp, p string"
WORKS = "dct:isVersionOf"


def refs(*values):
    return [(WORKS, n, "u", v) for n, v in enumerate(values)]


def test_references(spark, ns, at):
    x = ("clash",) * 3
    rows = [
        (1, ("res:1", "g"), refs("works:there", "works:gone", "http://W.example/id/none/", "works:none", " ", None, "works:late"), None, at(1), at(5), None, *x),
        (2, ("res:2", "g"), refs("works:none"), 1, at(1), at(5), None, *x),
        (3, ("http://a.example/items/2", "g"), refs("works:there"), 2, at(1), at(5), None, *x),  # the current row of res:2
        (4, ("res:3", "g"), refs("works:none"), 1, at(1), at(5), at(6), *x),  # deleted
        (5, ("res:4", "h"), refs("works:there"), 1, None, None, None, *x),  # another graph
        (6, (None, "g"), refs("works:none"), 1, at(1), at(5), None, *x), (7, None, None, None, None, None, None, *x),
        (8, ("res:5", "g"), None, 1, at(1), at(5), None, *x), (9, ("res:6", "g"), [None, (WORKS, 0, "l", "works:none")], 1, at(1), at(5), None, *x),
        (9, ("res:6", "g"), [None, (WORKS, 0, "l", "works:none")], 1, at(1), at(5), None, *x),
        (10, ("res:7", "g"), refs("works:late"), 1, at(1), at(9), None, *x),
    ]
    parents = [
        (1, ("works:there", "g"), 0, at(9), None, "p"), (2, ("works:there", "g"), 1, at(3), None, "p"),
        (3, ("works:gone", "g"), None, at(1), None, "p"), (4, ("works:gone", "g"), 0, at(1), at(2), "p"), (5, ("works:late", "g"), 1, at(8), None, "p"),
    ]
    every, found = references.dangling_references(spark.createDataFrame(rows, RES), {WORKS: spark.createDataFrame(parents, PARENT)}, ns)
    got = sorted((r.r[-1], r.c, r.target_r[-5:]) for r in found.collect())
    assert got == [("1", "g", "/gone"), ("1", "g", "/late"), ("1", "g", "/none"), ("4", "h", "there")]
    periods = {(r.p, r.period): (r.links, r.dangling) for r in references.dangling_by_period(every, found).collect()}
    assert periods == {(WORKS, "2020-01"): (6, 3), (WORKS, None): (1, 1)}


def test_references_of_empty_tables(spark, ns, at):
    none, some = spark.createDataFrame([], RES), spark.createDataFrame([(1, ("res:1", "g"), refs("works:a"), 1, at(1), at(1), None, "", "", "")], RES)
    parents = spark.createDataFrame([], PARENT)
    assert references.dangling_references(none, {WORKS: parents}, ns)[1].count() == 0
    assert references.dangling_references(some, {WORKS: parents}, ns)[1].count() == 1


DATES = [
    ("2020-03-29 02:30:00", "2020-03-29T01:30:00.000000Z"),  # skipped in Berlin: an hour on
    ("2020-10-25 02:30:00", "2020-10-25T00:30:00.000000Z"),  # twice in Berlin: the earlier
    ("2020-01-02T03:04:05.123456789+05:30", "2020-01-01T21:34:05.123456Z"), ("2020-01-02T03:04:05-0330", "2020-01-02T06:34:05.000000Z"),
    ("20200102T030405Z", "2020-01-02T03:04:05.000000Z"), ("20200102", "2020-01-01T23:00:00.000000Z"), ("1577934245", "2020-01-02T03:04:05.000000Z"), ("1577934245678", "2020-01-02T03:04:05.678000Z"),
    (" 3/4/2020 12:05 AM\n", "2020-04-02T22:05:00.000000Z"), ("Thu, 02 Jan 2020 03:04:05 +0000", "2020-01-02T03:04:05.000000Z"), ("Jan 2, 2020 12:04:05 PM", "2020-01-02T11:04:05.000000Z"),
    ("2 January 2020", "2020-01-01T23:00:00.000000Z"), ("2020-07-02 03:04:05 CEST", "2020-07-02T01:04:05.000000Z"), ("2020-07-02T03:04:05 America/New_York", "2020-07-02T07:04:05.000000Z"),
    ("2020-07-02T03:04:05+02:00[Europe/Helsinki]", "2020-07-02T01:04:05.000000Z"), ("2020/07/02 03:04", "2020-07-02T01:04:00.000000Z"), ("2020-07-02T03:04:05[Asia/Tokyo]", "2020-07-01T18:04:05.000000Z"),
    ("2019-02-30 12:00:00", None), ("0000-00-00T00:00:00Z", None), ("2017-13-45T10:00:00Z", None), ("2020-01-01T24:10:00Z", None), ("2020-01-01T10:00:00+19:00", None), ("2020-01-01T10:00:00 Mars/Phobos", None),
    ("2020-01-01 10:00:00 XYZ", None), ("13:00 PM", None), ("2020-01-01 13:00:00 PM", None), ("pending", None), ("", None), (" ", None), (None, None), ("123456789", None), ("9" * 5000, None),
]


def test_timestamps(spark):
    rows = [(n, (None, "berlin"), v, None) for n, (v, _) in enumerate(DATES)]
    rows += [(100, (None, "nowhere"), "2020-01-01 10:00:00", "2020-01-01 10:00:00Z"), (101, None, "2020-01-01T10:00:00Z", None), (102, (None, "us"), "3/4/2020 00:00", "2020-03-08 02:30:00")]
    dates = spark.createDataFrame(rows, "row_id bigint, id struct<r:string,c:string>, a string, b string")
    contexts = spark.createDataFrame([("berlin", "Europe/Berlin", "dmy"), ("berlin", "Europe/Berlin", "dmy"), ("us", "America/New_York", "mdy"), ("bad", "No/Where", None), (None, None, None)], "c string, tz string, date_order string")
    got = {(r.row_id, r.field): r.utc for r in timestamps.normalise_timestamps(dates, contexts, {"A": "a", "B": "b"}).collect()}
    assert {v: got.get((n, "A")) for n, (v, _) in enumerate(DATES)} == dict(DATES)
    assert (100, "A") not in got and got[100, "B"] == "2020-01-01T10:00:00.000000Z" and got[101, "A"] == "2020-01-01T10:00:00.000000Z"
    assert got[102, "A"] == "2020-03-04T05:00:00.000000Z" and got[102, "B"] == "2020-03-08T07:30:00.000000Z"
    assert timestamps.normalise_timestamps(dates.limit(0), contexts, {"A": "a"}).count() == 0


@pytest.fixture(scope="module")
def wide(spark, ns):
    declared = [("ex:n", "integer", "one"), ("ex:d", "decimal", "one"), ("ex:day", "date", "one"), ("ex:b", "boolean", "one"), ("ex:s", "string", "one"), ("ex:m", "integer", "many"), (None, "string", "one")]
    listed = attributes.declared(spark.createDataFrame(declared, "p string, data_type string, multiplicity string"))
    rows = [
        ("g", "res:1", "ex:n", 0, "+007"), ("g", "http://A.example/items/1", "http://x.example/ns#n", 1, " 7 "), ("g", "res:1", "ex:n", 0, None), ("g", "res:1", "ex:n", 0, "  "),
        ("g", "res:1", "ex:d", 0, "1.50"), ("g", "res:1", "ex:d", 0, "1.5"), ("g", "res:1", "ex:day", 0, "2020-02-29"), ("g", "res:1", "ex:b", 0, "TRUE"), ("g", "res:1", "ex:b", 1, "1"),
        ("g", "res:1", "ex:s", 0, "x" * 9000), ("g", "res:1", "ex:m", 2, "2"), ("g", "res:1", "ex:m", 1, "3"), ("g", "res:1", "ex:m", 1, "3"), ("g", "res:1", "ex:m", 0, "none"),
        ("g", "res:2", "ex:n", 0, "7.0"), ("g", "res:2", "ex:d", 0, "1."), ("g", "res:2", "ex:day", 0, "2021-02-29"), ("g", "res:2", "ex:b", 0, "yes"), ("g", "res:2", "ex:s", 0, "a"), ("g", "res:2", "ex:s", 0, "A"),
        ("g", "res:3", "ex:unknown", 0, "1"), ("h", "res:1", "ex:n", 0, "9" * 60), ("h", "res:1", "ex:d", 0, "-0.0"), ("h", "res:1", "ex:d", 0, "0"), (None, "res:1", "ex:n", 0, "x"), ("g", None, "ex:n", 0, "x"),
    ]
    triples = spark.createDataFrame(rows, "c string, s string, p string, pos int, o string")
    return attributes.wide(attributes.cells(triples, listed, ns), listed)


def test_wide_rows(wide):
    rows = {(r.s[-1], r.c): r for r in wide.collect()}
    one = rows["1", "g"]
    assert len(rows) == 4 and (int(one.ex_n), float(one.ex_d), str(one.ex_day), one.ex_b, len(one.ex_s)) == (7, 1.5, "2020-02-29", True, 9000)
    assert [int(x) for x in one.ex_m] == [3, 2] and one.unheld == []
    assert rows["2", "g"].unheld == ["ex:b", "ex:d", "ex:day", "ex:n", "ex:s"] and rows["3", "g"].ex_n is None
    assert rows["1", "h"].ex_n is None and rows["1", "h"].unheld == [] and float(rows["1", "h"].ex_d) == 0


def test_unheld_values(wide):
    assert sorted(r.p for r in attributes.unheld_values(wide).collect()) == ["ex:b", "ex:d", "ex:day", "ex:n", "ex:s"]


def test_digits_beyond_the_columns_are_reported_and_not_rounded(spark, ns):
    listed = attributes.declared(spark.createDataFrame([("ex:d", "decimal", "one"), ("ex:n", "integer", "one"), ("ex:m", "decimal", "many")], "p string, data_type string, multiplicity string"))
    texts = ["1.1234567890125", "1.123456789012000", "9" * 27, "-" + "9" * 26 + ".5", "0" * 30 + "7"]
    rows = [("g", f"res:{k}", p, 0, x) for k, x in enumerate(texts) for p in ("ex:d", "ex:m")] + [("g", "res:5", "ex:n", 0, "9" * 39), ("g", "res:6", "ex:n", 0, "9" * 38)]
    triples = spark.createDataFrame(rows, "c string, s string, p string, pos int, o string")
    got = {int(r.s[-1]): r for r in attributes.wide(attributes.cells(triples, listed, ns), listed).collect()}
    assert [got[k].ex_d for k in (0, 2)] == [None, None] and [got[k].ex_m for k in (0, 2)] == [[None], [None]] and got[5].ex_n is None
    assert [str(got[k].ex_d) for k in (1, 3, 4)] == ["1.123456789012", "-" + "9" * 26 + ".500000000000", "7.000000000000"] and got[6].ex_n == int("9" * 38)
    assert [got[k].beyond for k in range(7)] == [["ex:d", "ex:m"], [], ["ex:d", "ex:m"], [], [], ["ex:n"], []] and all(r.unheld == [] for r in got.values())


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4), max_leaves=12)


def leaves(value, path=(), places=()):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", type(None): "null"}[type(value)]
    yield path, places, kind
    for k, x in enumerate(value) if isinstance(value, list) else ():
        yield from leaves(x, (*path, nested.ITEM), (*places, k))
    for k, x in value.items() if isinstance(value, dict) else ():
        yield from leaves(x, (*path, "\\" + k if k[:1] in ("[", "\\") else k), places)


@settings(max_examples=150, deadline=None)
@given(values, st.booleans(), st.integers(1, 30))
def test_stream_parser_reads_json(value, plain, cut):
    text = json.dumps(value, ensure_ascii=plain, indent=1 if plain else None)
    assert [(tuple(p), tuple(o), k) for p, o, k, _ in nested.parse(text)] == list(leaves(value))
    shorter = text[:-cut]
    try:
        json.loads(shorter)
        valid = True
    except ValueError:
        valid = False
    assert (nested.parse(shorter) is not None) == valid


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", '{"a":}', "{} x", "nul", "[1 2]", '{"a" 1}', "01", '"\n"', "NaN", ",", "]", None])
def test_stream_parser_refuses(text):
    assert nested.parse(text) is None


def test_stream_parser_has_no_depth_limit():
    assert len(nested.parse("[" * 20000 + "]" * 20000)) == 20000


def test_view_tables(spark, ns):
    graph = {"_id": {"r": "res:1", "c": "g"}, "acorn:bookmarkReferences": [{"u": "res:2"}, {"u": "res:2"}], "ex:a": {"l": "x"}}
    docs = {
        1: {"_id": {"r": "res:1", "c": "g", "type": "v"}, "value": {"_graphs": [graph], "_impactIndex": [{"r": "http://A.example/items/1/", "c": "g"}, {"r": "res:9", "c": "g"}]}},
        2: {"_id": {"r": "res:1", "c": "g"}, "value": {"_graphs": [graph]}},
        3: {"_id": {"r": "res:1", "c": "g"}, "value": {"_graphs": graph, "_impactIndex": {"r": "res:1", "c": "G"}}},
        4: {"value": {"_graphs": [], "_impactIndex": [{"r": "res:1", "c": "g"}]}}, 7: [1], 8: {"value": {"_graphs": [{"ex:a": 3, "_id": None}, None], "_impactIndex": [{}]}},
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [(5, None), (6, json.dumps(docs[1])[:-1])]
    tables = nested.view_tables(spark.createDataFrame(rows, "view_id bigint, doc string"), ns)
    found = sorted((r.view_id, r.r[-1], r.c) for r in nested.index_mismatches(tables).collect())
    assert found == [(1, "2", "g"), (1, "9", "g"), (3, "1", "G"), (3, "1", "g"), (3, "2", "g")]
    views = {r.view_id: r for r in tables["views"].collect()}
    assert len(views) == 8 and not views[5].valid and not views[6].valid and views[1].graphs == 1 and views[1].index_entries == 2 and views[2].index_entries == 0
    assert sorted((r.view_id, r.graph_no, r.value_no) for r in tables["bookmarks"].collect()) == [(1, 0, 0), (1, 0, 1), (2, 0, 0), (2, 0, 1), (3, 0, 0), (3, 0, 1)]
    assert {r.value for r in tables["values"].where("view_id = 1 AND predicate = 'ex:a'").collect()} == {"x"}
    empty = nested.view_tables(spark.createDataFrame([], "view_id bigint, doc string"), ns)
    assert nested.index_mismatches(empty).count() == 0


def test_bookmarks_of_resources(spark, ns):
    mark = "acorn:bookmarkReferences"
    props = {1: [("dct:title", 0, "l", "x"), (mark, 0, "u", "res:2"), (mark, 1, "u", "http://A.example/items/2/"), (mark, 2, "l", "res:3"), (mark, 3, "u", None)], 2: None, 3: [], 4: [(mark, None, "u", "res:2"), None]}
    resources = spark.createDataFrame(list(props.items()), "row_id bigint, props array<struct<p:string,pos:int,k:string,v:string>>")
    got = sorted((r.row_id, r.prop_no, r.value_no, r.target_r) for r in nested.resource_bookmarks(resources, ns).collect())
    target = got[0][3]
    assert got == [(1, 1, 0, target), (1, 2, 1, target), (4, 0, None, target)] and target.endswith("/items/2")
    assert {"p4_graphs", "p4_resource_bookmarks"} <= problem_queries.QUERIES.keys()


def test_skewed_keys(spark, ns, at):
    def row(n, graph, *types, k="u", day=1):
        return (n, ("res:1", graph) if graph else None, [("rdf:type", i, k, t) for i, t in enumerate(types)] if types else None, 1, at(day), at(1), None, "", "", "")

    rows = [row(n, "hot", "ex:A", "http://X.example/ns#A", day=1 + n % 3) for n in range(60)] + [row(90 + n, f"g{n}", "ex:B", k="l") for n in range(20)] + [row(200, None, " "), row(200, None)]
    stats = skew.key_statistics(spark.createDataFrame(rows, RES), ns)
    got = {(r.field, r.key_value): (r.rows, r.distinct_values, str(r.mode)) for r in stats.collect()}
    assert got["id.c", "hot"] == (60, 3, "2020-01-01") and got["rdf:type", "http://x.example/ns#A"][0] == 60 and got["id.c", None][0] == 2 and len(got) == 23
    assert sorted(r.field for r in skew.heavy_keys(stats, 20).collect()) == ["id.c", "rdf:type"]
    median = skew.weighted_percentile(skew.compress(skew.key_rows(spark.createDataFrame(rows, RES), ns), ["field", "key_value"], "day", "_cts"), ["field", "key_value"], "day", 0.5)
    assert str(median.where("key_value = 'hot'").first()["day"]) == "2020-01-02"
    assert skew.heavy_keys(skew.key_statistics(spark.createDataFrame([], RES), ns), 20).count() == 0
