"""Deeply nested records into related flat tables.

Each record is stream-parsed into path, value and ordinals; paths are grouped by their repeated ancestor, and each group is
pivoted into one table whose rows keep the keys of their parents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.uri import Namespaces
from tessera.session import written

#: A step into an array. A member name that begins with [ or \ is written with a \ before it, so none is mistaken for it.
ITEM = "[]"
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_ESCAPE = re.compile(r"\\(u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", re.DOTALL)
#: The short escapes of JSON.
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
#: Most different paths: they are the schema of the records.
MAX_PATHS = 10_000
TRIPLES = "path array<string>, ordinals array<int>, kind string, value string, seq int"


def _unescape(match: re.Match) -> str:
    body = match[1]
    if body[0] != "u":
        return _SHORT.get(body, body)
    first = int(body[1:5], 16)
    if len(body) > 5:
        return chr(0x10000 + ((first - 0xD800) << 10) + int(body[7:11], 16) - 0xDC00)
    return chr(first) if not 0xD800 <= first <= 0xDFFF else "�"


def parse(text: str | None) -> list[tuple[list[str], list[int], str, str | None]] | None:
    """(path, ordinals, kind, value) of every scalar and every object and array, in order; None if text is no JSON.

    One pass with a stack of its own, so neither depth nor length of the record is limited by recursion. A lone surrogate
    becomes U+FFFD.
    """
    if text is None:
        return None
    out: list[tuple[list[str], list[int], str, str | None]] = []
    path: list[str] = []
    places: list[int] = []
    stack: list[str] = []
    at, end, state = 0, len(text), "value"
    match = _TOKEN.match
    while True:
        if state == "done":
            return out if not text[at:].strip(" \t\n\r") else None
        token = match(text, at)
        if token is None:
            return None
        at = token.end()
        mark, group = token[1], token.lastindex
        if state in ("value", "value or ]"):
            if mark == "]" and state == "value or ]":
                path.pop()
                places.pop()
                stack.pop()
            elif mark == "{":
                out.append((path[:], places[:], "object", None))
                stack.append("{")
                state = "name or }"
                continue
            elif mark == "[":
                out.append((path[:], places[:], "array", None))
                stack.append("[")
                path.append(ITEM)
                places.append(0)
                state = "value or ]"
                continue
            elif mark is not None:
                return None
            else:
                raw = token[0].lstrip(" \t\n\r")
                if raw[0] == '"':
                    body = raw[1:-1]
                    out.append((path[:], places[:], "string", _ESCAPE.sub(_unescape, body) if "\\" in body else body))
                elif group == 3:
                    out.append((path[:], places[:], "number", raw))
                else:
                    out.append((path[:], places[:], "null" if raw == "null" else "boolean", None if raw == "null" else raw))
        elif state in ("name", "name or }"):
            if mark == "}" and state == "name or }":
                stack.pop()
            elif mark is None and token[0].endswith('"'):
                body = token[0].lstrip(" \t\n\r")[1:-1]
                name = _ESCAPE.sub(_unescape, body) if "\\" in body else body
                path.append("\\" + name if name[:1] in ("[", "\\") else name)
                colon = match(text, at)
                if colon is None or colon[1] != ":":
                    return None
                at = colon.end()
                state = "value"
                continue
            else:
                return None
        elif mark == "," and stack[-1] == "{":
            state = "name"
            continue
        elif mark == "," and stack[-1] == "[":
            places[-1] += 1
            state = "value"
            continue
        elif mark == "}" and stack[-1] == "{":
            stack.pop()
        elif mark == "]" and stack[-1] == "[":
            stack.pop()
            path.pop()
            places.pop()
        else:
            return None
        # A value has ended: a member leaves its name, an item waits for the next.
        if not stack:
            state = "done"
        else:
            if stack[-1] == "{":
                path.pop()
            state = "more"


def flatten(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, ordinals, kind, value, seq: the values of each record; a record that is no JSON (null, empty, cut off)
    gives one row of kind `invalid`."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                rows: list[list] = [[], [], [], [], [], []]
                for name, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = parse(body)
                    for seq, one in enumerate([([], [], "invalid", None)] if found is None else found):
                        for column, x in zip(rows, (name, *one, seq), strict=True):
                            column.append(x)
                types = [part.schema.field(0).type, pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int32()]
                arrays = [pa.array(x, t) for x, t in zip(rows, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "path", "ordinals", "kind", "value", "seq"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {TRIPLES}")


def pivot(rows: DataFrame, keys: list[str], names: dict[str, Column]) -> DataFrame:
    """One row per keys: for each name the value of the last row of that name (of members written twice the last counts)."""
    return rows.groupBy(*keys).agg(*[F.max_by(F.when(test, F.col("value")), F.when(test, F.col("seq"))).alias(n) for n, test in names.items()])


def paths_of(flat: DataFrame) -> list[tuple[tuple[str, ...], bool]]:
    """The distinct paths and whether an object stands there, on the driver: the schema of the records, at most MAX_PATHS."""
    rows = flat.where("kind <> 'invalid'").select("path", (F.col("kind") == "object").alias("object")).distinct().limit(MAX_PATHS + 1).collect()
    if len(rows) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} paths")
    return sorted((tuple(r["path"]), r["object"]) for r in rows)


def normal_paths(paths: list[tuple[tuple[str, ...], bool]], repeated: set[tuple[str, ...]]) -> dict[tuple[tuple[str, ...], bool], tuple[list[str], list[int]]]:
    """For each path its form with a step [] wherever an array stands in any record (or that `repeated` names), and at which places
    among its ordinals a 0 has to go in. So a single object in place of an array is an array of one."""
    arrays, before = set(repeated), None
    while arrays != before:
        before, found = set(arrays), {}
        for path, is_object in paths:
            out, places = [], []
            for k, step in enumerate(path):
                out.append(step)
                following = path[k + 1] if k + 1 < len(path) else None
                if following == ITEM:
                    arrays.add(tuple(out))
                elif step != ITEM and tuple(out) in arrays and (following is not None or is_object):
                    places.append(out.count(ITEM))
                    out.append(ITEM)
            found[path, is_object] = out, places
    return found


def grouped(flat: DataFrame, repeated: Callable[[list[tuple[str, ...]]], set[tuple[str, ...]]] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """(the rows of flat with `ancestor`, `ordinals` of it, and `member`; the members of each ancestor).

    The ancestor is a path up to its last repeated step, written with dots, the member what follows, and '' for the element itself.
    repeated: paths, of those that occur, where arrays may stand although none does.
    """
    paths = paths_of(flat)
    found = normal_paths(paths, repeated([p for p, _ in paths]) if repeated else set())
    rows, members = [], {}
    for (path, is_object), (out, places) in found.items():
        last = len(out) - out[::-1].index(ITEM) if ITEM in out else 0
        ancestor, member = ".".join(out[:last]), ".".join(out[last:])
        rows.append((list(path), is_object, ancestor, member, places))
        members.setdefault(ancestor, set()).add(member)
    table = flat.sparkSession.createDataFrame(rows, "path array<string>, _object boolean, ancestor string, member string, _places array<int>")
    # The table has MAX_PATHS rows at most.
    joined = flat.withColumn("_object", F.col("kind") == "object").join(F.broadcast(table), ["path", "_object"])
    put = lambda a, p: F.concat(F.slice(a, F.lit(1), p), F.array(F.lit(0)), F.slice(a, p + 1, F.greatest(F.size(a) - p, F.lit(0))))
    ordinals = F.when(F.size("_places") == 0, F.col("ordinals")).otherwise(F.aggregate("_places", F.col("ordinals"), put))
    return joined.withColumn("ordinals", ordinals).drop("_object", "_places", "path"), {a: sorted(m) for a, m in members.items()}


def group_table(rows: DataFrame, key: str, ancestor: str, members: list[str]) -> DataFrame:
    """The table of one ancestor: key, no_1, no_2 and so on (its ordinals, which are the keys of its parents too), and a column for
    each member, its dots as written. Of members written twice the last counts."""
    depth = ancestor.split(".").count(ITEM)
    mine = rows.where(F.col("ancestor") == ancestor)
    keys = [F.get("ordinals", F.lit(k)).alias(f"no_{k + 1}") for k in range(depth)]
    names = {m: F.col("member") == m for m in members if m}
    flat = mine.select(key, *keys, "member", "value", "seq")
    return pivot(flat, [key, *[f"no_{k + 1}" for k in range(depth)]], names)


def all_tables(docs: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """One flat table for each repeated ancestor that occurs in the records, '' for the records themselves; ordinals join a table to
    that of any ancestor above it."""
    rows, members = grouped(written(flatten(docs, key, text), "nested"))
    return {a: group_table(rows, key, a, m) for a, m in members.items()}


_GRAPHS, _INDEX = ("value", "_graphs"), ("value", "_impactIndex")


def _repeated_in_views(paths: list[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Graphs, index entries and the values of each predicate of a graph, which may all be written as a single object."""
    out = {_GRAPHS, _INDEX}
    for path in paths:
        if path[:2] == _GRAPHS:
            rest = path[3:] if path[2:3] == (ITEM,) else path[2:]
            if rest and rest[0] != "_id":
                out.add((*_GRAPHS, ITEM, rest[0]))
    return out


def view_tables(docs: DataFrame, ns: Namespaces) -> dict[str, DataFrame]:
    """The flat tables of stored views, joined by keys:

    views: view_id, valid, r, c, type, cts, expires, graphs, index_entries (how many items each array has).
    graphs: view_id, graph_no, r, c. values: view_id, graph_no, predicate, value_no, kind (u, l or the names of the members down to
    the value, null for a bare scalar), value. bookmarks: view_id, graph_no, value_no, target_r. impact_index: view_id, entry_no,
    r, c. A single object where an array may stand counts as an array of one. r and target_r are canonical. Values that are
    neither object nor array in `_graphs` or `_impactIndex` are counted in views but give no row; missing parts are null, nulls give
    no value.

    The records are parsed once: their paths and values are written to the shared folder, and all tables read that.
    """
    flat = written(flatten(docs, "view_id", "doc"), "nested")
    rows, members = grouped(flat, _repeated_in_views)
    graph, entry = ".".join((*_GRAPHS, ITEM)), ".".join((*_INDEX, ITEM))
    table = lambda a, *names: group_table(rows, "view_id", a, list(names))

    valid = flat.groupBy("view_id").agg(F.max(F.col("kind") != "invalid").alias("valid"))
    root = table("", "_id.r", "_id.c", "_id.type", "_cts", "value._expires").toDF("view_id", "r", "c", "type", "cts", "expires")
    count = lambda a: F.count_distinct(F.when((F.col("ancestor") == a) & (F.col("member") == ""), F.get("ordinals", F.lit(0))))
    counts = rows.where((F.col("ancestor").isin(graph, entry)) & (F.col("member") == "")).groupBy("view_id").agg(count(graph).alias("graphs"), count(entry).alias("index_entries"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    views = valid.join(root, "view_id", "left").join(counts, "view_id", "left").select("view_id", "valid", ns.canonical(F.col("r")).alias("r"), "c", "type", "cts", "expires", zero("graphs"), zero("index_entries"))

    named = lambda df, no: df.toDF("view_id", no, "r", "c").where("r IS NOT NULL OR c IS NOT NULL").withColumn("r", ns.canonical(F.col("r")))
    graphs, entries = named(table(graph, "_id.r", "_id.c"), "graph_no"), named(table(entry, "r", "c"), "entry_no")

    # The values of all predicates in one long table: of a predicate's own group, or bare beside the graph's _id.
    scalar = rows.where(~F.col("kind").isin("object", "array", "null") & F.col("ancestor").startswith(graph))
    below = F.regexp_replace(F.substring(F.col("ancestor"), len(graph) + 2, 1_000_000_000), r"\.\[\]$", "")
    own = F.col("ancestor") != graph
    plain = scalar.where(own | (F.regexp_extract("member", r"^([^.]*)", 1) != "_id"))
    values = plain.select(
        "view_id", F.get("ordinals", F.lit(0)).alias("graph_no"), F.when(own, below).otherwise(F.col("member")).alias("predicate"),
        F.when(own, F.element_at("ordinals", -1)).otherwise(0).alias("value_no"), F.when(own & (F.col("member") != ""), F.col("member")).alias("kind"), "value", "seq",
    )
    values = values.groupBy("view_id", "graph_no", "predicate", "value_no", "kind").agg(F.max_by("value", "seq").alias("value"))
    marks = ".".join((*_GRAPHS, ITEM, "acorn:bookmarkReferences", ITEM))
    bookmarks = table(marks, "u").toDF("view_id", "graph_no", "value_no", "u").where("u IS NOT NULL").select("view_id", "graph_no", "value_no", ns.canonical(F.col("u")).alias("target_r"))
    return {"views": views, "graphs": graphs, "values": values, "bookmarks": bookmarks, "impact_index": entries}


def flatten_props(resources: DataFrame) -> DataFrame:
    """row_id, path, ordinals, kind, value, seq of the members of `props`, as flatten() gives them for JSON."""
    members = ("p", "pos", "k", "v")
    fields = F.array(*[F.struct(F.lit(m).alias("m"), F.col("x")[m].cast("string").alias("value")) for m in members])
    items = resources.select("row_id", F.posexplode("props").alias("no", "x")).select("row_id", "no", F.posexplode(fields).alias("at", "f"))
    path = F.array(F.lit("props"), F.lit(ITEM), F.col("f.m"))
    kind = F.when(F.col("f.value").isNull(), "null").when(F.col("f.m") == "pos", "number").otherwise("string")
    return items.select("row_id", path.alias("path"), F.array("no").alias("ordinals"), kind.alias("kind"), F.col("f.value").alias("value"), (F.col("no") * len(members) + F.col("at")).alias("seq"))


def resource_bookmarks(resources: DataFrame, ns: Namespaces) -> DataFrame:
    """row_id, prop_no, value_no, target_r: the acorn:bookmarkReferences of each row of resources that are URIs, prop_no their
    place in `props` and value_no among the values of the predicate."""
    name = F.get("path", F.lit(2))
    flat = flatten_props(resources).withColumn("prop_no", F.get("ordinals", F.lit(0)))
    rows = pivot(flat, ["row_id", "prop_no"], {m: name == m for m in ("p", "pos", "k", "v")})
    rows = rows.where("p = 'acorn:bookmarkReferences' AND k = 'u' AND v IS NOT NULL")
    return rows.select("row_id", "prop_no", F.col("pos").cast("int").alias("value_no"), ns.canonical(F.col("v")).alias("target_r"))


def index_mismatches(tables: dict[str, DataFrame]) -> DataFrame:
    """view_id, r, c: graphs and bookmark targets that the impact index lacks, and index entries that no graph has.

    Views that are no JSON, or without graphs or index entries, have none. Keys with a null r or c match nothing and are
    left out.
    """
    graphs = tables["graphs"].select("view_id", "graph_no", "r", "c")
    marks = tables["bookmarks"].join(graphs.select("view_id", "graph_no", "c"), ["view_id", "graph_no"]).select("view_id", F.col("target_r").alias("r"), "c", F.lit("bookmark").alias("part"))
    every = graphs.select("view_id", "r", "c", F.lit("graph").alias("part")).unionByName(marks)
    every = every.unionByName(tables["impact_index"].select("view_id", "r", "c", F.lit("index").alias("part"))).where("r IS NOT NULL AND c IS NOT NULL")
    has = lambda p: F.max(F.col("part") == p)
    keys = every.groupBy("view_id", "r", "c").agg(has("graph").alias("graph"), has("bookmark").alias("bookmark"), has("index").alias("index"))
    odd = keys.where(((F.col("graph") | F.col("bookmark")) & ~F.col("index")) | (F.col("index") & ~F.col("graph")))
    whole = tables["views"].where("valid AND graphs > 0 AND index_entries > 0").select("view_id")
    return odd.join(whole, "view_id", "left_semi").select("view_id", "r", "c")
