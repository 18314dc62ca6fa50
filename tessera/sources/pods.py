"""Pods: sets of subject descriptions, one row per subject and graph.

A description holds for each predicate a list of values of kind `u` (URI) or `l` (literal), in their order. PropsPod keeps
them in one array, as they are stored; WidePod has native columns for declared predicates, so that Catalyst prunes and
pushes down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.uri import Namespaces

PAIR = "array<struct<k:string,v:string>>"
PROPS = "array<struct<p:string,pos:int,k:string,v:string>>"


def empty(kind: str) -> Column:
    """An empty array of the type."""
    return F.array().cast(kind)


class Pod:
    """A frame with r and c, and the values of its predicates. Beside others in one frame, r and c may have other names."""

    r, c = "r", "c"

    def __init__(self, frame: DataFrame) -> None:
        self.frame = frame

    def values(self, predicate: str) -> Column:
        """array<struct<k,v>> of the predicate, empty where there is none."""
        raise NotImplementedError

    def all_values(self) -> Column:
        """The whole description as array<struct<p,pos,k,v>>."""
        raise NotImplementedError

    def only(self, test: Column) -> Pod:
        """The pod without the descriptions that fail test."""
        raise NotImplementedError

    def texts(self, predicate: str, kind: str | None = None) -> Column:
        """The values of one kind, or of both, as array<string>. `_id` is the subject."""
        if predicate == "_id":
            return F.array(F.col(self.r))
        found = self.values(predicate)
        if kind:
            found = F.filter(found, lambda x: x["k"] == kind)
        return F.transform(found, lambda x: x["v"])

    def triples(self) -> DataFrame:
        """c, s, p, pos, k, o."""
        flat = self.frame.select("r", "c", F.explode(self.all_values()).alias("x"))
        return flat.select("c", F.col("r").alias("s"), "x.p", "x.pos", "x.k", F.col("x.v").alias("o"))


class PropsPod(Pod):
    """Descriptions as stored: the column props."""

    def values(self, predicate: str) -> Column:
        mine = F.filter("props", lambda x: x["p"] == predicate)
        return F.coalesce(F.transform(F.array_sort(mine), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))), empty(PAIR))

    def all_values(self) -> Column:
        return F.coalesce(F.col("props"), empty(PROPS))

    def only(self, test: Column) -> PropsPod:
        return PropsPod(self.frame.where(test))


class WidePod(Pod):
    """Descriptions of declared predicates: a text column for one value, an array column for several."""

    def __init__(self, frame: DataFrame, columns: dict[str, tuple[str, str]]) -> None:
        super().__init__(frame)
        self.columns = columns

    @staticmethod
    def of(df: DataFrame, subject: Column, graph: Column, predicates: dict[str, tuple[str, Column]], keep: list[str] | None = None) -> WidePod:
        """predicates: kind and column by predicate; text columns are single values, array<string> columns several, null none."""
        named = {p: (k, f"v{n}") for n, (p, (k, _)) in enumerate(predicates.items())}
        columns = [c.alias(named[p][1]) for p, (_, c) in predicates.items()]
        return WidePod(df.select(subject.alias("r"), graph.alias("c"), *columns, *(keep or [])), named)

    def renamed(self, prefix: str) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
        """The frame and the columns with a prefix before every name."""
        return self.frame.select(*[F.col(n).alias(prefix + n) for n in self.frame.columns]), {p: (k, prefix + n) for p, (k, n) in self.columns.items()}

    def within(self, frame: DataFrame, columns: dict[str, tuple[str, str]], prefix: str = "") -> WidePod:
        """The pod in a frame that has its columns with a prefix before every name."""
        pod = WidePod(frame, columns)
        pod.r, pod.c = prefix + "r", prefix + "c"
        return pod

    def scalar(self, predicate: str) -> Column | None:
        """The plain column of a single-valued predicate, for comparisons without arrays."""
        if predicate in self.columns and dict(self.frame.dtypes)[self.columns[predicate][1]] == "string":
            return F.col(self.columns[predicate][1])
        return None

    def values(self, predicate: str) -> Column:
        if predicate not in self.columns:
            return empty(PAIR)
        kind, name = self.columns[predicate]
        pair = lambda v: F.struct(F.lit(kind).alias("k"), v.alias("v"))
        if self.scalar(predicate) is not None:
            return F.when(F.col(name).isNull(), empty(PAIR)).otherwise(F.array(pair(F.col(name))))
        return F.coalesce(F.transform(F.filter(name, lambda v: v.isNotNull()), pair), empty(PAIR))

    def all_values(self) -> Column:
        parts = []
        for p in self.columns:
            parts.append(F.transform(self.values(p), _with_place(p)))
        return F.concat(*parts) if parts else empty(PROPS)

    def only(self, test: Column) -> WidePod:
        return WidePod(self.frame.where(test), self.columns)


def _with_place(predicate: str):
    return lambda x, n: F.struct(F.lit(predicate).alias("p"), n.alias("pos"), x["k"].alias("k"), x["v"].alias("v"))


def from_triples(triples: DataFrame) -> PropsPod:
    """One description per (s, c) of triples (c, s, p, pos, k, o); equal triples count once, null subjects give none.

    pos orders the values of a predicate; ties are ordered by value.
    """
    rows = triples.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").groupBy("c", "s", "p", "k", "o").agg(F.min("pos").alias("pos"))
    listed = F.array_sort(F.collect_list(F.struct("p", "pos", "k", F.col("o").alias("v"))))
    return PropsPod(rows.groupBy(F.col("s").alias("r"), "c").agg(listed.alias("props")))


def from_json(documents: DataFrame, column: str) -> PropsPod:
    """Descriptions of JSON documents {_id: {r, c}, predicate: {u or l} or a list of them}; what is no JSON gives none.

    Members that begin with _ and values without u or l are left out, as are documents without _id.r.
    """
    parsed = documents.select(F.try_parse_json(F.col(column)).alias("d")).where("d IS NOT NULL")
    text = lambda path: F.try_variant_get("d", path, "string")
    members = parsed.select(text("$._id.r").alias("r"), text("$._id.c").alias("c"), F.try_variant_get("d", "$", "map<string,variant>").alias("m")).where("r IS NOT NULL")
    flat = members.select("r", "c", F.explode("m").alias("p", "x")).where(~F.col("p").startswith("_"))
    listed = flat.withColumn("many", F.coalesce(F.try_variant_get("x", "$", "array<variant>"), F.array("x"))).select("r", "c", "p", F.posexplode("many").alias("pos", "x"))
    get = lambda m: F.try_variant_get("x", f"$.{m}", "string")
    values = listed.select("c", F.col("r").alias("s"), "p", "pos", F.when(get("u").isNotNull(), "u").when(get("l").isNotNull(), "l").alias("k"), F.coalesce(get("u"), get("l")).alias("o"))
    return from_triples(values)


def to_json(pod: Pod) -> DataFrame:
    """document: each description as JSON; a single value is written bare, several as a list."""
    grouped = pod.triples().groupBy("c", "s", "p").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "o"))).alias("v"))
    one = lambda x: F.when(x["k"] == "u", F.to_json(F.struct(x["o"].alias("u")))).otherwise(F.to_json(F.struct(x["o"].alias("l"))))
    texts = F.transform("v", one)
    body = F.when(F.size("v") == 1, texts[0]).otherwise(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))
    member = F.concat(F.regexp_extract(F.to_json(F.struct(F.col("p").alias("x"))), r"^\{\"x\":(.*)\}$", 1), F.lit(":"), body)
    listed = grouped.groupBy("s", "c").agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("rest"))
    head = F.regexp_extract(F.to_json(F.struct(F.struct(F.col("s").alias("r"), F.col("c").alias("c")).alias("_id"))), r"^\{(.*)\}$", 1)
    return listed.select(F.concat(F.lit("{"), head, F.lit(","), F.col("rest"), F.lit("}")).alias("document"))


def stored(table: DataFrame, ns: Namespaces) -> PropsPod:
    """The pod of a table of descriptions (row_id, id, props, _version, deleted_at): current rows that aren't deleted, with
    canonical subjects and canonical values of kind `u`, written as prefixed names; blank values are left out."""
    from tessera.functions.text import not_blank
    from tessera.operators.records import current_rows, with_record_key

    now = current_rows(with_record_key(table, ns), {"deleted_at": F.col("deleted_at"), "props": F.col("props"), "_version": F.col("_version"), "_uts": F.col("_uts")})
    value = lambda x: F.when(x["k"] == "u", ns.alias(ns.canonical(x["v"]))).otherwise(x["v"])
    clean = F.transform(F.filter("props", lambda x: not_blank(x["v"])), lambda x: F.struct(x["p"].alias("p"), x["pos"].alias("pos"), x["k"].alias("k"), value(x).alias("v")))
    return PropsPod(now.where("deleted_at IS NULL").select(ns.alias(F.col("_r")).alias("r"), F.col("_c").alias("c"), clean.alias("props"), "_version", "_uts"))
