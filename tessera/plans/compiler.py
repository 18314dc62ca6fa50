"""Specifications to Catalyst plans.

The join tree of a spec has a fixed depth. Each of its nodes is one equi-join by subject and graph. Edges with one value stay on
the row of their root (the spine), as left joins in a chain; what comes over edges with several values is united with the
spine and aggregated once by the root's key, so sibling joins never multiply rows. Without such edges nothing is aggregated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions.scalars import Value
from tessera.functions.uri import Namespaces
from tessera.plans import specs
from tessera.plans.filters import document_filter
from tessera.sources.pods import Pod, PropsPod, WidePod

KEY = ["root_r", "root_c"]
ID = "struct<r:string,c:string>"
TEXTS = "array<string>"


@dataclass
class Node:
    """A part of a spec, and the descriptions that take part in it for each root: root_r, root_c, ord and the pod's columns.

    A joined node also has `to` and `to_c`, the key it followed; r and everything else is null where nothing is there.
    """

    part: dict
    pod: Pod
    root: bool
    #: The names of the key it followed.
    to: tuple[str, str] = ("to", "to_c")

    def ids(self) -> Column:
        """The subject of each row, whether it is there or not; on the spine null where no key was followed."""
        if self.root:
            return F.struct(F.col(self.pod.r).alias("r"), F.col(self.pod.c).alias("c")).cast(ID)
        r, c = self.to
        return F.when(F.col(r).isNotNull(), F.struct(F.col(r).alias("r"), F.col(c).alias("c")).cast(ID))


def _at(pod: Pod, frame: DataFrame) -> Pod:
    """pod with another frame that has its columns."""
    other = WidePod(frame, pod.columns) if isinstance(pod, WidePod) else PropsPod(frame)
    other.r, other.c = pod.r, pod.c
    return other


def of_type(pod: Pod, types: list[str], ns: Namespaces | None) -> Column:
    """Whether a description has one of the types, written either way."""
    forms = sorted({x for t in types for x in ((t, ns.full(t)) if ns else (t,))})
    scalar = pod.scalar("rdf:type") if isinstance(pod, WidePod) else None
    if scalar is not None:
        return scalar.isin(forms)
    return F.exists(pod.texts("rdf:type", "u"), lambda x: x.isin(forms))


def walk(spec: dict, pods: dict[str, Pod], ns: Namespaces | None = None, only: DataFrame | None = None, context: str | None = None) -> Iterator[Node]:
    """The nodes of the join tree, root first. only: root_r, root_c of the roots wanted, a semi-join before anything else.

    A join follows the values of kind `u` of its predicate (`_id`: the subject itself; `followSequence`: rdf:_1, rdf:_2 and so
    on) to the description of that subject in the graph of the source, or in `context`. Repeated values are followed once,
    missing targets give rows without values.
    """
    root = _root(spec, pods, ns, only)
    yield root
    yield from _children(root, spec, pods, spec["from"], context, prefix=None)


def _root(spec: dict, pods: dict[str, Pod], ns: Namespaces | None, only: DataFrame | None, pod: Pod | None = None) -> Node:
    pod = pod or pods[spec["from"]]
    frame = pod.frame.where(of_type(pod, specs.types(spec), ns))
    if only is not None:
        frame = frame.join(only, (F.col("r") == F.col("root_r")) & (F.col("c") == F.col("root_c")), "left_semi")
    frame = frame.withColumn("root_r", F.col("r")).withColumn("root_c", F.col("c")).withColumn("ord", F.array(F.lit(0)))
    return Node(spec, _at(pod, frame), True)


@dataclass
class Tree:
    """A join tree: the nodes on the spine, all in one frame with a row per root and each with its place in the order, and the
    others, each in a frame of its own."""

    frame: DataFrame
    spine: list[tuple[list[int], Node]]
    others: list[Node]


def tree(spec: dict, pods: dict[str, Pod], ns: Namespaces | None = None, only: DataFrame | None = None, context: str | None = None, pod: Pod | None = None) -> Tree:
    """The nodes of walk(), those reached over single values from root to node in one frame. pod: in place of the spec's own."""
    root = _root(spec, pods, ns, only, pod)
    found = Tree(root.pod.frame, [([0], root)], [])
    _grow(found, root, spec, pods, spec["from"], context, [])
    # Every node of the spine sees the whole frame.
    for _, node in found.spine:
        node.pod = _at(node.pod, found.frame)
    return found


def _grow(found: Tree, parent: Node, part: dict, pods: dict[str, Pod], default_from: str, context: str | None, below: list[int]) -> None:
    for n, (predicate, joined) in enumerate(part.get("joins", {}).items()):
        base = [*below, 1 + n]
        target = pods[joined.get("from", default_from)]
        key = F.col(parent.pod.r) if predicate == "_id" else _single(parent.pod, predicate)
        if key is None or not isinstance(target, WidePod):
            single = {**part, "joins": {predicate: joined}}
            found.others += _children(parent, single, pods, default_from, context, prefix=F.array(*[F.lit(x) for x in below]) if below else None, first=n)
            continue
        prefix = f"n{len(found.spine)}_"
        frame, columns = target.renamed(prefix)
        to = (prefix + "to", prefix + "to_c")

        def joined_to(left: DataFrame, parent: Node = parent, frame: DataFrame = frame, key: Column = key, to: tuple[str, str] = to, prefix: str = prefix) -> DataFrame:
            keyed = left.withColumn(to[0], key).withColumn(to[1], F.lit(context) if context else F.col(parent.pod.c if parent.root else parent.to[1]))
            return keyed.join(frame, (F.col(to[0]) == F.col(prefix + "r")) & (F.col(to[1]) == F.col(prefix + "c")), "left")

        found.frame = joined_to(found.frame)
        node = Node(joined, target.within(joined_to(parent.pod.frame), columns, prefix), False, to)
        found.spine.append(([*base, 0, 0], node))
        _grow(found, node, joined, pods, default_from, context, [*base, 1, 0])


def _single(pod: Pod, predicate: str) -> Column | None:
    """The column of a predicate that has one URI at most."""
    if isinstance(pod, WidePod) and predicate in pod.columns and pod.columns[predicate][0] == "u":
        return pod.scalar(predicate)
    return None


def _children(parent: Node, part: dict, pods: dict[str, Pod], default_from: str, context: str | None, prefix: Column | None, first: int = 0) -> Iterator[Node]:
    for n, (predicate, joined) in enumerate(part.get("joins", {}).items(), first):
        keys = _keys(parent.pod, predicate, joined)
        # Matches come in the order of their keys, all before what is joined to any of them.
        base = F.array(F.lit(1 + n)) if prefix is None else F.concat(prefix, F.array(F.lit(1 + n)))
        graph = F.col(parent.pod.c if parent.root else parent.to[1])
        links = parent.pod.frame.select(*KEY, base.alias("base"), graph.alias("c"), F.posexplode(keys).alias("at", "to"))
        links = links.withColumn("to_c", F.lit(context) if context else F.col("c")).drop("c")
        target = pods[joined.get("from", default_from)]
        here = links.select(*KEY, F.concat("base", F.array(F.lit(0), F.col("at"))).alias("ord"), F.concat("base", F.array(F.lit(1), F.col("at"))).alias("below"), "to", "to_c")
        found = here.join(target.frame, (F.col("to") == F.col("r")) & (F.col("to_c") == F.col("c")), "left")
        node = Node(joined, _at(target, found), False)
        yield node
        yield from _children(node, joined, pods, default_from, context, F.col("below"))


def _keys(pod: Pod, predicate: str, joined: dict) -> Column:
    if predicate == "_id":
        return F.array_compact(F.array(pod.r))
    if predicate == "followSequence":
        return sequence(pod, joined.get("maxJoins", 1000))
    keys = F.array_distinct(pod.texts(predicate, "u"))
    return F.slice(keys, 1, joined["maxJoins"]) if joined.get("maxJoins") else keys


def sequence(pod: Pod, most: int) -> Column:
    """The URIs of rdf:_1, rdf:_2 and so on up to `most`, in that order."""
    members = F.filter(pod.all_values(), lambda x: x["p"].rlike("^rdf:_[0-9]{1,18}$") & (x["k"] == "u"))
    numbered = F.transform(members, lambda x: F.struct(F.substring(x["p"], 6, 18).cast("bigint").alias("n"), x["pos"].alias("pos"), x["v"].alias("v")))
    return F.array_distinct(F.transform(F.array_sort(F.filter(numbered, lambda x: (x["n"] >= 1) & (x["n"] <= most))), lambda x: x["v"]))


def field_value(pod: Pod, predicate: object) -> Value:
    """The values of a predicate, or of modifiers around predicates, innermost first. '' counts as no value."""
    if isinstance(predicate, str):
        return Value(F.filter(pod.texts(predicate), lambda x: x.isNotNull() & (x != "")), "texts")
    name, body = next(iter(predicate.items()))
    inner = {k: v for k, v in body.items() if k in scalars.MODIFIERS}
    values = [field_value(pod, p) for p in body.get("predicates", [])] + ([field_value(pod, inner)] if inner else [])
    value = values[0] if len(values) == 1 else Value(F.concat(*[v.column if v.kind == "texts" else F.array_compact(F.array(v.text())) for v in values]), "texts")
    return scalars.modify(name, value, body)


def _link(ns: Namespaces | None, pod: Pod) -> Column:
    """The full URI of the subject at hand."""
    return F.array_compact(F.array(ns.expand(F.col(pod.r)) if ns else F.col(pod.r)))


def _as_texts(value: Value) -> Column:
    if value.kind == "texts":
        return value.column
    if value.kind == "date":
        return F.array_compact(F.array(F.date_format(value.column, "yyyy-MM-dd HH:mm:ss.SSS")))
    return F.array_compact(F.array(value.text()))


def contributions(found: Tree, fields_of: Callable[[Node], dict[str, Column]], counts_of: Callable[[Node], dict[str, Column]], names: list[str], counts: list[str]) -> DataFrame:
    """root_r, root_c and each field as the values of all nodes in their order, each count as the sum over all nodes,
    and `impact`, every subject that has a part in the row, missing targets included."""
    spine = sorted(found.spine, key=lambda x: x[0])
    fields, numbers = [fields_of(node) for _, node in spine], [counts_of(node) for _, node in spine]
    ids = F.array_compact(F.array(*[node.ids() for _, node in spine]))
    none = F.array().cast(TEXTS)
    plain = lambda f: F.concat(none, *[x[f] for x in fields if f in x])
    total = lambda c: reduce(lambda a, b: a + b, [F.coalesce(x[c], F.lit(0)) for x in numbers if c in x], F.lit(0).cast("bigint"))
    if not found.others:
        return found.frame.select(
            *KEY, F.array_sort(F.array_distinct(ids)).alias("impact"),
            *[plain(f).alias(f"f_{k}") for k, f in enumerate(names)],
            *[total(c).alias(f"n_{k}") for k, c in enumerate(counts)],
        )
    # A field of the spine is a list of the values of each of its nodes, with their places; one of another node is one such value.
    kind = "array<struct<ord:array<int>,v:array<string>>>"
    placed = lambda f: F.array(*[F.struct(F.array(*[F.lit(x) for x in place]).alias("ord"), x[f].alias("v")) for (place, _), x in zip(spine, fields, strict=True) if f in x]).cast(kind)
    frames = [found.frame.select(*KEY, ids.alias("ids"), *[placed(f).alias(f"f_{k}") for k, f in enumerate(names)], *[total(c).alias(f"n_{k}") for k, c in enumerate(counts)])]
    for node in found.others:
        mine, number = fields_of(node), counts_of(node)
        one = lambda f: F.array(F.struct(F.col("ord"), mine[f].alias("v"))).cast(kind) if f in mine else F.array().cast(kind)  # noqa: B023, E731
        frames.append(
            node.pod.frame.select(
                *KEY, F.array(node.ids()).alias("ids"), *[one(f).alias(f"f_{k}") for k, f in enumerate(names)],
                *[(number[c] if c in number else F.lit(None).cast("bigint")).alias(f"n_{k}") for k, c in enumerate(counts)],
            )
        )
    every = reduce(DataFrame.unionByName, frames)
    listed = lambda c: F.filter(F.flatten(F.collect_list(F.when(F.size(c) > 0, F.col(c)))), lambda x: F.size(x["v"]) > 0)
    gathered = lambda c: F.flatten(F.transform(F.array_sort(listed(c)), lambda x: x["v"]))
    return every.groupBy(*KEY).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("impact"),
        *[gathered(f"f_{k}").alias(f"f_{k}") for k in range(len(names))],
        *[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in range(len(counts))],
    )


def table(spec: dict, pods: dict[str, Pod], ns: Namespaces | None = None, only: DataFrame | None = None, context: str | None = None) -> DataFrame:
    """The rows of a table spec: r, c, its fields and `impact_index`.

    A field is an array of all its values: of the root, then of what is joined, in order; a computed field is a single value.
    Counts are sums, 0 where nothing is counted. Temporary fields are dropped at the end.
    """
    specs.validate(spec, "table", set(pods))
    found = tree(spec, pods, ns, only, context)
    names = list(dict.fromkeys(f["fieldName"] for p in specs.parts(spec) for f in p.get("fields", [])))
    counts = list(dict.fromkeys(c["fieldName"] for p in specs.parts(spec) for c in p.get("counts", [])))

    def fields_of(node: Node) -> dict[str, Column]:
        out: dict[str, list[Column]] = {}
        for f in node.part.get("fields", []):
            out.setdefault(f["fieldName"], []).extend(_as_texts(field_value(node.pod, p)) for p in f.get("predicates", []))
            if f.get("value") in ("link", "_link_"):
                out[f["fieldName"]].append(_link(ns, node.pod))
        return {k: F.concat(*v) for k, v in out.items()}

    def counts_of(node: Node) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in node.part.get("counts", []):
            values = node.pod.texts(c["property"])
            if c.get("regex"):
                values = F.filter(values, _regex(c["regex"]))
            number = F.size(values).cast("bigint")
            out[c["fieldName"]] = out[c["fieldName"]] + number if c["fieldName"] in out else number
        return out

    rows = contributions(found, fields_of, counts_of, names, counts)
    values = {f: Value(F.col(f"f_{k}"), "texts") for k, f in enumerate(names)}
    values |= {c: Value(F.col(f"n_{k}"), "whole") for k, c in enumerate(counts)}
    for number, computed in enumerate(spec.get("computed_fields", [])):
        value = scalars.compute(computed["value"], values)
        rows = rows.withColumn(f"x_{number}", value.column)
        values[computed["fieldName"]] = Value(F.col(f"x_{number}"), value.kind)
    hidden = specs.temporary_fields(spec)
    out = [v.column.alias(n) for n, v in values.items() if n not in hidden]
    return rows.select(F.col("root_r").alias("r"), F.col("root_c").alias("c"), *out, F.col("impact").alias("impact_index"))


def _regex(pattern: str) -> Callable[[Column], Column]:
    from tessera.plans.filters import java_regex

    return lambda x: x.rlike(java_regex(pattern))


def view(spec: dict, pods: dict[str, Pod], ns: Namespaces | None = None, only: DataFrame | None = None, context: str | None = None) -> DataFrame:
    """The graphs of a view spec, one row each: root_r, root_c, ord, r, c, props.

    A graph is in a view once; the root comes last. `include` keeps those predicates and the ones joined on, without it all are
    kept; `_seq_` adds rdf:_1, rdf:_2 and so on up to the first gap, of an rdf:Seq. A join `filter` or `condition` keeps the
    targets that match; what is joined to the others is still there. Counts are literals of the graph they stand at.
    """
    specs.validate(spec, "view", set(pods))
    out = []
    for node in walk(spec, pods, ns, only, context):
        shown = node.pod if node.root else node.pod.only(F.col("r").isNotNull())
        if not node.root and node.part.get("filter"):
            shown = shown.only(_any_of(shown, node.part["filter"]))
        if not node.root and node.part.get("condition"):
            shown = shown.only(document_filter(shown, node.part["condition"]))
        props = included(shown, node.part)
        frame = shown.frame
        for name, count in node.part.get("counts", {}).items():
            frame, number = _view_count(shown, frame, count, pods, spec["from"])
            item = F.struct(F.lit(name).alias("p"), F.lit(0).alias("pos"), F.lit("l").alias("k"), number.cast("string").alias("v"))
            props = F.concat(props, F.array(item))
            shown = _at(shown, frame)
        last = F.array(F.lit(1_000_000)) if node.root else F.col("ord")
        out.append(frame.select(*KEY, last.alias("ord"), "r", "c", props.alias("props")))
    every = reduce(DataFrame.unionByName, out)
    return every.groupBy(*KEY, "r", "c").agg(F.max("ord").alias("ord"), F.min_by("props", "ord").alias("props"))


def _any_of(pod: Pod, wanted: dict) -> Column:
    return reduce(lambda a, b: a | b, [document_filter(pod, {p: v}) for p, v in wanted.items()])


def included(pod: Pod, part: dict) -> Column:
    """What `include` leaves of the descriptions."""
    names = part.get("include")
    if names is None:
        return pod.all_values()
    kept = [n for n in [*names, *part.get("joins", {})] if n not in ("_seq_", "_id", "followSequence")]
    props = F.filter(pod.all_values(), lambda x: x["p"].isin(kept))
    if "_seq_" not in names:
        return props
    members = F.filter(pod.all_values(), lambda x: x["p"].rlike("^rdf:_[0-9]{1,18}$"))
    numbers = F.array_sort(F.array_distinct(F.transform(members, lambda x: F.substring(x["p"], 6, 18).cast("bigint"))))
    # Sorted distinct numbers from 1 on equal their places up to the first gap.
    unbroken = F.filter(F.transform(numbers, lambda n, i: F.when(n == i + 1, n)), lambda n: n.isNotNull())
    sequenced = F.filter(members, lambda x: F.array_contains(unbroken, F.substring(x["p"], 6, 18).cast("bigint")))
    is_sequence = F.exists(pod.texts("rdf:type"), lambda t: t == "rdf:Seq")
    return F.when(is_sequence, F.concat(props, sequenced)).otherwise(props)


def _view_count(shown: Pod, frame: DataFrame, count: dict, pods: dict[str, Pod], default_from: str) -> tuple[DataFrame, Column]:
    """The number of values of a property, or of descriptions that point here and match a filter."""
    if "filter" not in count:
        return frame, F.size(shown.texts(count["property"]))
    others = pods[count.get("from", default_from)]
    others = others.only(document_filter(others, count["filter"]))
    pointing = others.frame.select("c", F.explode(F.array_distinct(others.texts(count["property"], "u"))).alias("to"))
    number = pointing.groupBy(F.col("to").alias("to_r"), F.col("c").alias("to_c")).agg(F.count(F.lit(1)).alias("pointing"))
    if "pointing" in frame.columns:
        frame = frame.drop("pointing")
    counted = frame.join(number, (F.col("r") == F.col("to_r")) & (F.col("c") == F.col("to_c")), "left").drop("to_r", "to_c")
    return counted, F.coalesce(F.col("pointing"), F.lit(0))


def nested_view(graphs: DataFrame, impact: DataFrame, kind: str, ttl: int | None = None) -> DataFrame:
    """One row per view: r, c, type, graphs (root last), impact_index, expires. With a ttl a view has no impact index, and it
    expires so many seconds from now; a ttl of 0 or less never does."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "r", "c", "props"))), lambda g: F.struct(g["r"].alias("r"), g["c"].alias("c"), g["props"].alias("props")))
    views = graphs.groupBy(*KEY).agg(listed.alias("graphs"))
    if ttl is not None:
        expires = F.current_timestamp() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl)) if ttl > 0 else F.lit(None).cast("timestamp")
        views = views.withColumn("impact_index", F.lit(None).cast(f"array<{ID}>")).withColumn("expires", expires)
    else:
        views = views.join(impact, KEY, "left").withColumn("expires", F.lit(None).cast("timestamp"))
    return views.select(F.col("root_r").alias("r"), F.col("root_c").alias("c"), F.lit(kind).alias("type"), "graphs", "impact_index", "expires")


def impact_index(spec: dict, pods: dict[str, Pod], ns: Namespaces | None = None, only: DataFrame | None = None, context: str | None = None) -> DataFrame:
    """root_r, root_c, impact_index: every subject of each composite, missing and filtered targets included."""
    keys = []
    for node in walk(spec, pods, ns, only, context):
        keys.append(node.pod.frame.select(*KEY, node.ids().alias("id")).select(*KEY, "id.r", "id.c"))
    every = reduce(DataFrame.unionByName, keys).distinct()
    return every.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("r", "c").cast(ID))).alias("impact_index"))


def search_documents(spec: dict, pods: dict[str, Pod], ns: Namespaces | None = None, only: DataFrame | None = None, context: str | None = None) -> DataFrame:
    """The documents of a search spec: r, c, its fields (case kept) and indices (lower case), `impact_index`.

    A description has a document if any filter rule matches; a rule without condition always does, one with `from` asks the
    description of the same subject in another pod. A dotted name `a.b` is the column `a_b`. `limit` keeps the first values.
    """
    specs.validate(spec, "search", set(pods))
    pod = pods[spec["from"]]
    rules, frame = [], pod.frame
    for n, rule in enumerate(spec["filter"]):
        if not rule.get("condition"):
            rules.append(F.lit(True))
        elif rule.get("from", spec["from"]) == spec["from"]:
            rules.append(document_filter(pod, rule["condition"]))
        else:
            other = pods[rule["from"]]
            keys = other.only(document_filter(other, rule["condition"])).frame.select(F.col("r").alias(f"rule{n}_r"), F.col("c").alias(f"rule{n}_c"))
            frame = frame.join(keys, (F.col("r") == F.col(f"rule{n}_r")) & (F.col("c") == F.col(f"rule{n}_c")), "left").drop(f"rule{n}_c")
            rules.append(F.col(f"rule{n}_r").isNotNull())
    matching = frame.where(reduce(lambda a, b: a | b, rules)).drop(*[f"rule{n}_r" for n in range(len(rules))])
    # What doesn't match is gone before anything is joined.
    found = tree(spec, pods, ns, only, context, _at(pod, matching))
    entries = lambda part: [(f, False) for f in part.get("fields", [])] + [(f, True) for f in part.get("indices", [])]
    names = list(dict.fromkeys(f["fieldName"] for p in specs.parts(spec) for f, _ in entries(p)))

    def fields_of(node: Node) -> dict[str, Column]:
        out: dict[str, list[Column]] = {}
        for f, index in entries(node.part):
            for p in f.get("predicates", []):
                values = _trimmed(field_value(node.pod, p).column, index)
                out.setdefault(f["fieldName"], []).append(F.slice(values, 1, f["limit"]) if f.get("limit") else values)
            if f.get("value") in ("link", "_link_"):
                out.setdefault(f["fieldName"], []).append(_link(ns, node.pod))
        return {k: F.concat(*v) for k, v in out.items()}

    rows = contributions(found, fields_of, lambda _: {}, names, [])
    return rows.select(F.col("root_r").alias("r"), F.col("root_c").alias("c"), F.lit(spec["_id"]).alias("type"), *[F.col(f"f_{k}").alias(n.replace(".", "_")) for k, n in enumerate(names)], F.col("impact").alias("impact_index"))


def _trimmed(values: Column, lower: bool) -> Column:
    return F.transform(values, lambda x: F.lower(F.trim(x))) if lower else F.transform(values, lambda x: F.trim(x))
