"""RDF text: N-Triples, N-Quads, RDF/JSON and a line-wise subset of Turtle, parsed and written as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.uri import Namespaces, let

_TERM = r"(<[^>]*>|_:\S+)"
_OBJECT = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
_LINE = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_OBJECT}\s*{_TERM}?\s*\.\s*(?:#.*)?$"


def _unescape(text: Column) -> Column:
    """The escapes of N-Triples; \\uXXXX and \\UXXXXXXXX through the JSON reader, so all in the JVM."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)(\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))
    one = lambda t: F.when(t.rlike(r"^\\U[0-9A-Fa-f]{8}$"), F.decode(F.unhex(F.substring(t, 3, 8)), "UTF-32")).otherwise(t)
    wide = F.when(text.contains("\\U"), F.array_join(F.transform(tokens, one), "")).otherwise(text)
    body = F.concat(F.lit('{"x":"'), F.regexp_replace(F.regexp_replace(wide, r"\\'", "'"), "[\\x00-\\x1f]", " "), F.lit('"}'))
    return F.when(text.contains("\\"), F.coalesce(F.get_json_object(body, "$.x"), text)).otherwise(text)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """s, p, k, o, lang, dt, g of N-Triples or N-Quads lines; comments, blank lines and lines that don't parse give nothing.

    k is u, b (blank node) or l; datatype and language stand beside a literal, null where there is none.
    """
    part = lambda k: F.regexp_extract(column, _LINE, k)
    rows = lines.where(F.col(column).rlike(_LINE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("g"))
    bare = lambda c: F.when(c.startswith("<"), _unescape(F.substring(c, 2, F.length(c) - 2))).otherwise(c)
    o = F.col("o")
    literal = o.startswith('"')
    tail = F.regexp_extract(o, r'(?s)^"(?:[^"\\]|\\.)*"(.*)$', 1)
    text = F.substring(o, F.lit(2), F.length(o) - F.length(tail) - 2)
    return rows.select(
        bare(F.col("s")).alias("s"), bare(F.col("p")).alias("p"),
        F.when(literal, "l").when(o.startswith("_:"), "b").otherwise("u").alias("k"),
        F.when(literal, _unescape(text)).otherwise(bare(o)).alias("o"),
        F.when(tail.startswith("@"), F.regexp_replace(tail, "^@", "")).alias("lang"),
        F.when(tail.startswith("^^"), F.substring(tail, F.lit(4), F.length(tail) - 4)).alias("dt"),
        F.when(F.col("g") != "", bare(F.col("g"))).alias("g"),
    )


def escape(text: Column) -> Column:
    """Backslash, quote, tab and line ends escaped; other characters stay as they are, in UTF-8."""
    for one, other in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(one), F.lit(other))
    return text


def escape_ascii(text: Column) -> Column:
    """escape() with \\uXXXX and \\UXXXXXXXX for control characters and all that isn't ASCII."""

    def code(x: Column) -> Column:
        point = F.ascii(x)
        wide = lambda mark, n: F.concat(F.lit(mark), F.lpad(F.hex(point.cast("bigint")), n, "0"))
        return F.when(point.between(32, 126), x).when(point < 65536, wide("\\u", 4)).otherwise(wide("\\U", 8))

    made = let(escape(text), lambda t: F.when(t.rlike("[^ -~]"), F.array_join(F.transform(F.split(t, ""), code), "")).otherwise(t))
    return F.when(text.isNotNull(), made)


def term(kind: Column, value: Column, lang: Column | None = None, dt: Column | None = None, escaped: Callable[[Column], Column] = escape) -> Column:
    """A term as N-Triples writes it."""
    tail = F.lit("")
    if lang is not None:
        tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).otherwise(tail)
    if dt is not None:
        tail = F.when(dt.isNotNull(), F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise(tail)
    return F.when(kind == "l", F.concat(F.lit('"'), escaped(value), F.lit('"'), tail)).when(value.startswith("_:"), value).otherwise(F.concat(F.lit("<"), escaped(value), F.lit(">")))


def to_lines(triples: DataFrame, ns: Namespaces, quads: bool = False, ascii_only: bool = False) -> DataFrame:
    """value: one N-Triples line for each triple (c, s, p, k, o), or with quads one N-Quads line; names are written in full.

    Subjects that are no names give none. ascii_only: other characters as escapes.
    """
    escaped = escape_ascii if ascii_only else escape
    triples = triples.where(F.col("s").contains(":"))
    full = lambda c: ns.expand(F.col(c))
    get = lambda c: F.col(c) if c in triples.columns else None
    kind = F.lit("u")
    o = F.when(F.col("k") == "l", F.col("o")).otherwise(full("o"))
    parts = [term(kind, full("s"), escaped=escaped), term(kind, full("p"), escaped=escaped), term(F.col("k"), o, get("lang"), get("dt"), escaped)]
    parts += [term(kind, full("c"), escaped=escaped)] if quads else []
    return triples.select(F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


def to_turtle(triples: DataFrame, ns: Namespaces) -> DataFrame:
    """value: one Turtle statement for each subject, with its predicates and their values; names are written in full, so that every
    line can be read alone."""
    full = lambda c: ns.expand(F.col(c))
    get = lambda c: F.col(c) if c in triples.columns else None
    o = term(F.col("k"), F.when(F.col("k") == "l", F.col("o")).otherwise(full("o")), get("lang"), get("dt"))
    flat = triples.where(F.col("s").contains(":")).select(term(F.lit("u"), full("s")).alias("s"), term(F.lit("u"), full("p")).alias("p"), o.alias("o"))
    values = flat.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("o"))
    return values.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))), " ; ").alias("po")).select(F.concat_ws(" ", "s", "po", F.lit(".")).alias("value"))


def to_rdf_xml(triples: DataFrame, ns: Namespaces) -> DataFrame:
    """place, value: RDF/XML: the head (place 0), an element for each subject (1) and the end (2).

    A predicate is written with the namespace up to its last / or #, or the last part of a name it can't be written with is left
    out: such triples have no form in RDF/XML.
    """
    mark = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    full = lambda c: ns.expand(F.col(c))
    split = r"^(.*[/#])([A-Za-z_][\w.-]*)$"
    flat = triples.where(F.col("s").contains(":") & full("p").rlike(split)).select(full("s").alias("s"), F.regexp_extract(full("p"), split, 1).alias("space"), F.regexp_extract(full("p"), split, 2).alias("name"), "k", F.when(F.col("k") == "l", F.col("o")).otherwise(full("o")).alias("o"))
    named = lambda c, attribute: F.when(c.startswith("_:"), F.concat(F.lit(' rdf:nodeID="'), mark(F.regexp_replace(c, "^_:", "")), F.lit('"'))).otherwise(F.concat(F.lit(f' rdf:{attribute}="'), mark(c), F.lit('"')))
    inner = F.when(F.col("k") == "l", F.concat(F.lit(">"), mark(F.col("o")), F.lit("</x:"), "name", F.lit(">"))).otherwise(F.concat(named(F.col("o"), "resource"), F.lit("/>")))
    element = F.concat(F.lit("<x:"), "name", F.lit(' xmlns:x="'), mark(F.col("space")), F.lit('"'), inner)
    bodies = flat.select("s", element.alias("e")).groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("e")), "").alias("e"))
    rows = bodies.select(F.lit(1).alias("place"), F.concat(F.lit("<rdf:Description"), named(F.col("s"), "about"), F.lit(">"), "e", F.lit("</rdf:Description>")).alias("value"))
    ends = [(0, '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'), (2, "</rdf:RDF>")]
    return rows.unionByName(triples.sparkSession.createDataFrame(ends, "place int, value string"))


def suggest_prefixes(namespaces: DataFrame, ns: Namespaces) -> DataFrame:
    """namespace, prefix: a prefix for each namespace, its last part that has letters; numbered where it is taken already."""
    word = F.lower(F.regexp_extract("namespace", r"([A-Za-z][A-Za-z0-9]*)[^A-Za-z]*$", 1))
    taken = F.when(word.isin(sorted(ns.uris)), 1).otherwise(0)
    order = Window.partitionBy("word").orderBy("namespace")
    rows = namespaces.select("namespace").distinct().select("namespace", word.alias("word"), taken.alias("taken")).withColumn("nth", F.row_number().over(order) - 1 + F.col("taken"))
    return rows.select("namespace", F.concat("word", F.when(F.col("nth") > 0, F.col("nth").cast("string")).otherwise(F.lit(""))).alias("prefix"))


def parse_rdf_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """s, p, pos, k, o, lang, dt of RDF/JSON: {subject: {predicate: [{type, value, lang, datatype}]}}; what is no JSON gives nothing."""
    shape = "map<string,map<string,array<struct<type:string,value:string,lang:string,datatype:string>>>>"
    flat = documents.select(F.explode(F.from_json(column, shape)).alias("s", "ps")).select("s", F.explode("ps").alias("p", "os")).select("s", "p", F.posexplode("os").alias("pos", "x"))
    kind = F.when(F.col("x.type") == "uri", "u").when(F.col("x.type") == "bnode", "b").when(F.col("x.type") == "literal", "l")
    return flat.select("s", "p", "pos", kind.alias("k"), F.col("x.value").alias("o"), F.col("x.lang").alias("lang"), F.col("x.datatype").alias("dt")).where("k IS NOT NULL AND o IS NOT NULL")


def parse_turtle(documents: DataFrame, column: str = "value") -> DataFrame:
    """s, p, k, o, lang, dt of Turtle texts, one row per text: @prefix, `a`, `;` and `,`; no nested blank nodes or collections.

    Statements are cut in the JVM; prefixes are those that the text declares, an undeclared one stays as it is.
    """
    tokens = F.regexp_extract_all(
        F.col(column), F.lit(r'(<[^>]*>|"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|@prefix|@[A-Za-z-]+|\^\^|_:[\w.-]*[\w-]|[\w-]*:[\w./#-]*[\w/#-]|[\w-]*:|\ba\b|[;,.])|#[^\n]*'), F.lit(1)
    )
    rows = documents.select(F.monotonically_increasing_id().alias("doc"), F.filter(tokens, lambda t: t != "").alias("t"))
    # Folded over the tokens: the state is the open subject and predicate, what is declared, and the triples so far.
    blank = F.lit(None).cast("string")
    state = F.struct(
        blank.alias("s"), blank.alias("p"), F.lit("").alias("mode"), blank.alias("prefix"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("ns"),
        F.array().cast("array<struct<s:string,p:string,o:string,tail:string>>").alias("out"),
    )

    def step(a: Column, t: Column) -> Column:
        triple = F.struct(a["s"].alias("s"), a["p"].alias("p"), t.alias("o"), F.lit("").alias("tail"))
        last = F.element_at(a["out"], -1)
        tailed = F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), last["p"].alias("p"), last["o"].alias("o"), F.concat(F.when(a["mode"] == "dt", F.lit("^^")).otherwise(F.lit("")), t).alias("tail"))))
        make = lambda s, p, mode, prefix, ns, out: F.struct(s.alias("s"), p.alias("p"), mode.alias("mode"), prefix.alias("prefix"), ns.alias("ns"), out.alias("out"))
        mode = a["mode"]
        known = lambda m: F.lit(m)
        return (
            F.when(t == "@prefix", make(blank, blank, known("prefix"), blank, a["ns"], a["out"]))
            .when(mode == "prefix", make(blank, blank, known("uri"), F.regexp_replace(t, ":$", ""), a["ns"], a["out"]))
            .when(mode == "uri", make(blank, blank, known("dot"), blank, F.map_concat(F.map_filter(a["ns"], lambda k, _: k != a["prefix"]), F.map_from_arrays(F.array(a["prefix"]), F.array(F.substring(t, F.lit(2), F.length(t) - 2)))), a["out"]))
            .when(t == ".", make(blank, blank, known(""), blank, a["ns"], a["out"]))
            .when(t == ";", make(a["s"], blank, known(""), blank, a["ns"], a["out"]))
            .when(t == ",", make(a["s"], a["p"], known(""), blank, a["ns"], a["out"]))
            .when(t == "^^", make(a["s"], a["p"], known("dt"), blank, a["ns"], a["out"]))
            .when((mode == "dt") | t.startswith("@"), make(a["s"], a["p"], known(""), blank, a["ns"], tailed))
            .when(a["s"].isNull(), make(t, blank, known(""), blank, a["ns"], a["out"]))
            .when(a["p"].isNull(), make(a["s"], t, known(""), blank, a["ns"], a["out"]))
            .otherwise(make(a["s"], a["p"], known(""), blank, a["ns"], F.concat(a["out"], F.array(triple))))
        )

    folded = rows.select("doc", F.aggregate("t", state, step).alias("x"))
    flat = folded.select("doc", F.col("x.ns").alias("ns"), F.explode("x.out").alias("y")).select("ns", "y.*")

    def name(c: Column) -> Column:
        space = F.try_element_at("ns", F.substring_index(c, ":", 1))
        return (
            F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).when(c.startswith("_:"), c)
            .when(c == "a", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type"))
            .otherwise(F.coalesce(F.concat(space, F.regexp_replace(c, "^[^:]*:", "")), c))
        )

    o = F.col("o")
    literal = o.startswith('"')
    text = F.regexp_replace(F.regexp_replace(o, '(?s)^"""(.*)"""$', "$1"), '(?s)^"(.*)"$', "$1")
    return flat.select(
        name(F.col("s")).alias("s"), name(F.col("p")).alias("p"), F.when(literal, "l").when(o.startswith("_:"), "b").otherwise("u").alias("k"),
        F.when(literal, _unescape(text)).otherwise(name(o)).alias("o"),
        F.when(F.col("tail").startswith("@"), F.regexp_replace("tail", "^@", "")).alias("lang"),
        F.when(F.col("tail").startswith("^^"), name(F.regexp_replace("tail", r"^\^\^", ""))).alias("dt"),
    )


def namespace_report(triples: DataFrame, ns: Namespaces, objects_above: int = 500) -> DataFrame:
    """part, namespace, uses: namespaces of full URIs that aren't declared; of predicates always, of objects above a number of uses."""
    space = lambda c: F.regexp_extract(c, r"(?i)^(https?://.*[/#])[^/#]*$", 1)
    rows = triples.select(F.lit("predicate").alias("part"), space("p").alias("namespace")).unionAll(triples.where("k = 'u'").select(F.lit("object"), space("o")))
    counted = rows.where(F.col("namespace") != "").groupBy("part", "namespace").agg(F.count(F.lit(1)).alias("uses"))
    return counted.where(~F.col("namespace").isin(sorted(ns.uris.values())) & ((F.col("part") == "predicate") | (F.col("uses") > objects_above)))


def full_uri_report(triples: DataFrame) -> DataFrame:
    """part, uri, uses: subjects and objects written as full http or https URIs."""
    rows = triples.select(F.lit("subject").alias("part"), F.col("s").alias("uri")).unionAll(triples.where("k = 'u'").select(F.lit("object"), "o"))
    return rows.where(F.col("uri").rlike("^https?://")).groupBy("part", "uri").agg(F.count(F.lit(1)).alias("uses"))
