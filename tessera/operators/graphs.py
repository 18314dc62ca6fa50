"""Algebra of graphs: triples as rows c, s, p, pos, k, o (k: u URI, l literal, b blank node); lang and dt where they are there.

A graph is a set: pos plays no part in whether triples are equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

TRIPLE = ["s", "p", "k", "o"]


def _set(triples: DataFrame) -> DataFrame:
    return triples.select(*TRIPLE, *[c for c in ("lang", "dt") if c in triples.columns])


def _keys(*graphs: DataFrame) -> list[str]:
    return [c for c in (*TRIPLE, "lang", "dt") if all(c in g.columns for g in graphs)]


def union(*graphs: DataFrame) -> DataFrame:
    """Every triple of any graph, once."""
    return reduce(DataFrame.unionByName, [g.select(*_keys(*graphs)) for g in graphs]).distinct()


def merge(*graphs: DataFrame) -> DataFrame:
    """union() with blank nodes kept apart: those of graph n are renamed with n in front."""

    def own(g: DataFrame, n: int) -> DataFrame:
        mark = lambda c: F.when(c.startswith("_:"), F.concat(F.lit(f"_:g{n}."), F.substring(c, 3, 1_000_000_000))).otherwise(c)
        return g.withColumn("s", mark(F.col("s"))).withColumn("o", F.when(F.col("k") == "l", F.col("o")).otherwise(mark(F.col("o"))))

    return union(*[own(g, n) for n, g in enumerate(graphs)])


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """The triples of first that second lacks; kinds, languages and datatypes tell triples apart. Nulls equal nulls."""
    keys = _keys(first, second)
    return first.select(*keys).subtract(second.select(*keys))


def equal(first: DataFrame, second: DataFrame) -> bool:
    """Whether both graphs have the same triples."""
    return difference(first, second).isEmpty() and difference(second, first).isEmpty()


def changes(before: DataFrame, after: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """s, p, k, o, op: what to `add` to and `remove` from before to get after; predicates in ignored don't count."""
    kept = lambda g: g.where(~F.col("p").isin(list(ignored))) if ignored else g
    added = difference(kept(after), kept(before)).withColumn("op", F.lit("add"))
    removed = difference(kept(before), kept(after)).withColumn("op", F.lit("remove"))
    return added.unionByName(removed)


def subjects_of_change(change: DataFrame) -> DataFrame:
    """s, additions, removals of each subject that changes."""
    tally = lambda op: F.count_if(F.col("op") == op)
    return change.groupBy("s").agg(tally("add").alias("additions"), tally("remove").alias("removals"))


def has_changes(change: DataFrame) -> bool:
    return not change.isEmpty()


class TripleError(ValueError):
    """A triple whose subject or predicate is no name."""


def _is_name(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(_:\S+|[^\s<>\"]+:[^\s<>\"]*)$"), F.lit(False))


def add(triples: DataFrame, new: DataFrame) -> DataFrame:
    """triples with those of new, each once. A subject or predicate that is no name raises TripleError; an object that is no name
    is left out, as is a null literal."""
    wrong = new.where(~_is_name(F.col("s")) | ~_is_name(F.col("p"))).first()
    if wrong:
        raise TripleError(f"subject or predicate is no name: {wrong['s']} {wrong['p']}")
    good = new.where(F.when(F.col("k") == "l", F.col("o").isNotNull()).otherwise(_is_name(F.col("o"))))
    return union(triples, good)


def replace_literal(triples: DataFrame, s: str, p: str, old: str, new: str) -> DataFrame:
    """One literal of a subject and predicate in place of another."""
    hit = (F.col("s") == s) & (F.col("p") == p) & (F.col("k") == "l") & (F.col("o") == old)
    return triples.withColumn("o", F.when(hit, F.lit(new)).otherwise(F.col("o"))).dropDuplicates(_keys(triples))


def replace_values(triples: DataFrame, s: str, p: str, kind: str, values: list[str]) -> DataFrame:
    """The values of one kind of a subject and predicate replaced by others."""
    kept = triples.where(~F.coalesce((F.col("s") == s) & (F.col("p") == p) & ((F.col("k") == "l") == F.lit(kind == "l")), F.lit(False)))
    rows = [(s, p, n, kind, v) for n, v in enumerate(dict.fromkeys(values))]
    return kept.unionByName(triples.sparkSession.createDataFrame(rows, "s string, p string, pos int, k string, o string"), allowMissingColumns=True)


def reify(triples: DataFrame, prefix: str = "_:r") -> DataFrame:
    """Four triples for each triple: a statement and its subject, predicate and object. Its name is a hash of the triple."""
    name = F.concat(F.lit(prefix), F.sha1(F.concat_ws("\u0000", "s", "p", "k", "o")))
    part = lambda p, k, o: F.struct(F.lit(p).alias("p"), k.alias("k"), o.alias("o"))
    parts = F.array(
        part("rdf:type", F.lit("u"), F.lit("rdf:Statement")), part("rdf:subject", F.lit("u"), F.col("s")),
        part("rdf:predicate", F.lit("u"), F.col("p")), part("rdf:object", F.col("k"), F.col("o")),
    )
    return triples.select(name.alias("s"), F.explode(parts).alias("x")).select("s", "x.p", "x.k", "x.o")


def matching(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, k: str | None = None) -> DataFrame:
    """The triples of a pattern; None stands for anything."""
    tests = [F.col(n) == v for n, v in (("s", s), ("p", p), ("o", o), ("k", k)) if v is not None]
    return triples.where(reduce(lambda a, b: a & b, tests)) if tests else triples


def has(triples: DataFrame, **pattern: str) -> bool:
    """Whether any triple matches the pattern."""
    return not matching(triples, **pattern).isEmpty()


def triple_count(triples: DataFrame, **pattern: str) -> DataFrame:
    """One row: count, the triples that match the pattern."""
    return matching(triples, **pattern).agg(F.count(F.lit(1)).alias("count"))


def subjects(triples: DataFrame, **pattern: str) -> DataFrame:
    """s: the distinct subjects of a pattern (of a type: p='rdf:type', o=the type)."""
    return matching(triples, **pattern).select("s").distinct()


def resources(triples: DataFrame) -> DataFrame:
    """r: every subject, and every object that is no literal, once."""
    return triples.select(F.col("s").alias("r")).union(triples.where("k <> 'l'").select("o")).distinct()


def backlinks(triples: DataFrame) -> DataFrame:
    """r, s, p: the subjects that refer to each subject of the graph, and by which predicate."""
    known = triples.select(F.col("s").alias("r")).distinct()
    return triples.where("k <> 'l'").join(known, F.col("o") == F.col("r")).select("r", "s", "p").distinct()


def first_literal(triples: DataFrame, predicates: list[str], languages: list[str] | None = None) -> DataFrame:
    """s, p, o: for each subject the first literal, by the order of predicates, then of languages, then of pos."""
    rank = lambda c, wanted: F.array_position(F.array(*[F.lit(w) for w in wanted]), c)
    order = [rank(F.col("p"), predicates)]
    if languages and "lang" in triples.columns:
        order.append(F.when(rank(F.col("lang"), languages) > 0, rank(F.col("lang"), languages)).otherwise(len(languages) + 1))
    found = triples.where(F.col("p").isin(predicates) & (F.col("k") == "l"))
    return found.groupBy("s").agg(F.min_by(F.struct("p", "o"), F.struct(*order, "pos", "o")).alias("x")).select("s", "x.p", "x.o")


def first_resource(triples: DataFrame, predicate: str) -> DataFrame:
    """s, o: for each subject the first URI of a predicate."""
    return triples.where((F.col("p") == predicate) & (F.col("k") != "l")).groupBy("s").agg(F.min_by("o", F.struct("pos", "o")).alias("o"))


def remove(triples: DataFrame, s: str | None = None, p: list[str] | None = None, o: str | None = None) -> DataFrame:
    """triples without those of a subject, of predicates, with an object, or all that is named together; nothing named removes all."""
    tests = [F.col("s") == s if s is not None else None, F.col("p").isin(p) if p is not None else None, F.col("o") == o if o is not None else None]
    tests = [t for t in tests if t is not None]
    return triples.where(~F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))) if tests else triples.where(F.lit(False))


def remove_subjects_of_type(triples: DataFrame, kind: str) -> DataFrame:
    """triples without the subjects that have the type."""
    return triples.join(subjects(triples, p="rdf:type", o=kind), "s", "left_anti")


def replace_uri(triples: DataFrame, old: str, new: str) -> DataFrame:
    """One URI in place of another, as subject, predicate and object; triples that become equal count once."""
    swap = lambda c: F.when(c == old, F.lit(new)).otherwise(c)
    return triples.withColumn("s", swap(F.col("s"))).withColumn("p", swap(F.col("p"))).withColumn("o", F.when(F.col("k") == "l", F.col("o")).otherwise(swap(F.col("o")))).dropDuplicates(_keys(triples))


def sequence_number(predicate: Column) -> Column:
    """n of rdf:_n; null for other predicates."""
    return F.when(predicate.rlike("^rdf:_[0-9]{1,18}$"), F.substring(predicate, 6, 18).cast("bigint"))


def sequence_values(triples: DataFrame) -> DataFrame:
    """s, n, o: the members of each sequence in numeric order of rdf:_n."""
    return triples.select("s", sequence_number(F.col("p")).alias("n"), "k", "o").where("n IS NOT NULL").select("s", "n", "k", "o")


def next_in_sequence(triples: DataFrame) -> DataFrame:
    """s, p: the predicate that the next member of each sequence gets."""
    top = sequence_values(triples).groupBy("s").agg(F.max("n").alias("n"))
    return top.select("s", F.concat(F.lit("rdf:_"), (F.col("n") + 1).cast("string")).alias("p"))


def renumber_sequences(triples: DataFrame) -> DataFrame:
    """The members of each sequence numbered 1, 2 and so on without gaps; everything else unchanged.

    Sequences are numbered in their own partition: one sequence is the unit that its definition orders.
    """
    members = triples.where(sequence_number(F.col("p")).isNotNull())
    order = Window.partitionBy("s").orderBy(sequence_number(F.col("p")), "k", "o")
    numbered = members.withColumn("p", F.concat(F.lit("rdf:_"), F.row_number().over(order).cast("string")))
    return triples.where(sequence_number(F.col("p")).isNull()).unionByName(numbered)


def insert_in_sequence(triples: DataFrame, sequence: str, position: int, kind: str, value: str) -> DataFrame:
    """A member put at a position of a sequence: those from there on whose numbers follow without a gap move up by one."""
    number = sequence_number(F.col("p"))
    mine = (F.col("s") == sequence) & number.isNotNull()
    taken = triples.where(mine & (number >= position)).select(number.alias("n")).distinct()
    # n - (how many are taken below it) stays the same along an unbroken run from `position` on.
    order = Window.partitionBy(F.lit(sequence)).orderBy("n")
    run = taken.withColumn("k", F.row_number().over(order)).where(F.col("n") == F.col("k") + position - 1).agg(F.max("n").alias("top")).first()["top"]
    top = position - 1 if run is None else int(run)
    moved = triples.withColumn("p", F.when(mine & number.between(position, top), F.concat(F.lit("rdf:_"), (number + 1).cast("string"))).otherwise(F.col("p")))
    row = triples.sparkSession.createDataFrame([(sequence, f"rdf:_{position}", 0, kind, value)], "s string, p string, pos int, k string, o string")
    return moved.unionByName(row, allowMissingColumns=True)


def remove_from_sequence(triples: DataFrame, sequence: str, value: str) -> DataFrame:
    """The sequence without a member, numbered anew."""
    gone = (F.col("s") == sequence) & (F.col("o") == value) & sequence_number(F.col("p")).isNotNull()
    return renumber_sequences(triples.where(~gone))


def list_values(triples: DataFrame, head: str) -> DataFrame:
    """n, o: the values of an rdf:first / rdf:rest list from its head on, whatever its length, by pointer doubling: every round
    doubles the places that are known and the length of the jumps. A list that bites its own tail is an error."""
    rest = triples.where("p = 'rdf:rest' AND o <> 'rdf:nil'").select("s", "o").distinct()
    jump = cut(rest)
    most = jump.select("s").distinct().count() + 1
    known = triples.sparkSession.range(1).select(F.lit(1).alias("n"), F.lit(head).alias("node"))
    step = 1
    while True:
        further = cut(known.join(jump, F.col("node") == F.col("s")).select((F.col("n") + step).alias("n"), F.col("o").alias("node")).distinct())
        top = further.agg(F.max("n")).first()[0]
        if top is None:
            break
        if top > most:
            raise ValueError(f"the list {head} bites its own tail")
        known = known.unionByName(further)
        jump = cut(jump.join(jump.select(F.col("s").alias("_s"), F.col("o").alias("_o")), F.col("o") == F.col("_s")).select("s", F.col("_o").alias("o")).distinct())
        step *= 2
    first = triples.where("p = 'rdf:first'").select("s", "o").distinct()
    return known.join(first, F.col("node") == F.col("s")).select("n", "o")


def label(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """r, label: of every subject the first literal of predicates, else the last part of its name with capitals parted."""
    found = first_literal(triples, predicates).select(F.col("s").alias("_s"), "o")
    plain = F.lower(F.regexp_replace(F.regexp_extract("s", r"([^/#:]*)$", 1), r"([a-z])([A-Z])", "$1 $2"))
    return triples.select("s").distinct().join(found, F.col("s") == F.col("_s"), "left").select(F.col("s").alias("r"), F.coalesce("o", plain).alias("label"))


def plural_label(triples: DataFrame, predicates: list[str], plurals: list[str]) -> DataFrame:
    """r, label: the first literal of `plurals`, else the label of label() as English forms its plural."""
    one = F.col("label")
    many = (
        F.when(one.rlike("(?i)[^aeiou]y$"), F.regexp_replace(one, "(?i)y$", "ies"))
        .when(one.rlike("(?i)(s|x|z|ch|sh)$"), F.concat(one, F.lit("es"))).otherwise(F.concat(one, F.lit("s")))
    )
    return _labelled(triples, plurals, label(triples, predicates).select("r", many.alias("label")))


def inverse_label(triples: DataFrame, predicates: list[str], inverses: list[str]) -> DataFrame:
    """r, label: the first literal of `inverses`, else `is (label) of`."""
    return _labelled(triples, inverses, label(triples, predicates).select("r", F.concat(F.lit("is "), "label", F.lit(" of")).alias("label")))


def _labelled(triples: DataFrame, predicates: list[str], otherwise: DataFrame) -> DataFrame:
    if not predicates:
        return otherwise
    found = first_literal(triples, predicates).select(F.col("s").alias("_s"), "o")
    return otherwise.join(found, F.col("r") == F.col("_s"), "left").select("r", F.coalesce("o", "label").alias("label"))


def label_graph(triples: DataFrame, predicates: list[str], as_predicate: str = "rdfs:label") -> DataFrame:
    """triples with a label for every subject that has none of the predicates."""
    made = label(triples, predicates).join(triples.where(F.col("p").isin([*predicates, as_predicate])).select(F.col("s").alias("r")).distinct(), "r", "left_anti")
    return union(triples, made.select(F.col("r").alias("s"), F.lit(as_predicate).alias("p"), F.lit("l").alias("k"), F.col("label").alias("o")))
