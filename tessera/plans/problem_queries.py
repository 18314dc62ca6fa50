"""The queries of the corpus-preparation operators of the core, and their text for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import not_blank_sql, strip_sql
from tessera.functions.uri import Namespaces, canonical_of_sql
from tessera.operators import attributes, nested, references, skew, timestamps
from tessera.operators.records import current_rows_sql
from tessera.sources.tables import read

FIELDS = {"dct:updated": "dct_updated", "dct:published": "dct_published"}
#: A key is heavy if it holds one row in so many.
HEAVY_ONE_IN = 20


def _ns(spark: SparkSession, d: str) -> Namespaces:
    return Namespaces.of(read(spark, d, "prefixes"))


def _dangling(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    resources = read(spark, d, "resources")
    tables = {p: read(spark, d, t) for p, t in references.TARGETS.items()}
    return references.dangling_references(resources, tables, _ns(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d)[1].select("r", "c", "p", "target_r")


def p1_by_period(spark: SparkSession, d: str) -> DataFrame:
    return references.dangling_by_period(*_dangling(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise_timestamps(read(spark, d, "dates"), read(spark, d, "contexts"), FIELDS)


def _wide(spark: SparkSession, d: str) -> DataFrame:
    ns, declared = _ns(spark, d), attributes.declared(read(spark, d, "predicates"))
    return attributes.wide(attributes.cells(read(spark, d, "triples"), declared, ns), declared)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return attributes.unheld_values(_wide(spark, d))


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide rows; arrays are written as JSON, so that the columns are flat."""
    rows = _wide(spark, d)
    return rows.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c).cast("string").alias(c) for c, t in rows.dtypes])


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the wide rows that hold a value, one row each: numbers and dates as they are written, lists as JSON."""
    rows, declared = p3_wide(spark, d), attributes.declared(read(spark, d, "predicates"))
    value = lambda a: F.when(F.col(a.column) != "[]", F.col(a.column)) if a.many else F.col(a.column)
    cells = F.array(*[F.struct(F.lit(a.name).alias("p"), value(a).alias("value")) for a in declared])
    return rows.select("s", "c", F.explode(cells).alias("x")).select("s", "c", "x.p", "x.value").where("value IS NOT NULL")


def _views(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return nested.view_tables(read(spark, d, "view_docs"), _ns(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """The repeated ancestors that occur, the columns of the table of each, and its rows."""
    tables = nested.all_tables(read(spark, d, "view_docs"), "view_id", "doc")
    one = lambda a, t: t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(a).alias("ancestor"), F.lit(",".join(t.columns)).alias("columns"), "rows")
    return reduce(DataFrame.unionByName, [one(a, t) for a, t in tables.items()])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.index_mismatches(_views(spark, d))


def p4_views(spark: SparkSession, d: str) -> DataFrame:
    return _views(spark, d)["views"]


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    return _views(spark, d)["values"]


def p4_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    return _views(spark, d)["bookmarks"]


def p4_graphs(spark: SparkSession, d: str) -> DataFrame:
    return _views(spark, d)["graphs"]


def p4_resource_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    return nested.resource_bookmarks(read(spark, d, "resources"), _ns(spark, d))


def p4_impact_index(spark: SparkSession, d: str) -> DataFrame:
    return _views(spark, d)["impact_index"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(skew.key_statistics(read(spark, d, "resources"), _ns(spark, d)), HEAVY_ONE_IN)


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    found = skew.key_statistics(read(spark, d, "resources"), _ns(spark, d))
    return found.select("field", "key_value", "rows", F.col("_cts").alias("latest_cts"), "distinct_values", F.col("mode").cast("string").alias("mode_day"))


def p5_median_day(spark: SparkSession, d: str) -> DataFrame:
    keys = ["field", "key_value"]
    rows = skew.compress(skew.key_rows(read(spark, d, "resources"), _ns(spark, d)), keys, "day", "_cts")
    return skew.weighted_percentile(rows, keys, "day", 0.5).select(*keys, F.col("day").cast("string").alias("median_day"))


QUERIES = {f.__name__: f for f in (p1_found, p1_by_period, p2_found, p3_found, p3_wide, p3_values, p4_found, p4_groups, p4_views, p4_values, p4_bookmarks, p4_graphs, p4_resource_bookmarks, p4_impact_index, p5_found, p5_statistics, p5_median_day)}


def _p1_sql(tail: str) -> str:
    names = ", ".join(f"'{p}'" for p in references.TARGETS)
    parents = " UNION ALL ".join(
        f"SELECT '{p}' AS p, k.r AS target_r, k.c AS c, f.first_arrived FROM ({current_rows_sql(t, ['deleted_at'])}) k "
        f"JOIN (SELECT {canonical_of_sql('id.r')} AS r, id.c AS c, min(arrived_at) AS first_arrived FROM {t} GROUP BY ALL) f ON k.r = f.r AND k.c = f.c WHERE k.deleted_at IS NULL"
        for p, t in references.TARGETS.items()
    )
    return f"""
WITH now AS ({current_rows_sql("resources", ["deleted_at", "arrived_at", "_cts", "props"])}),
raw AS (SELECT r, c, arrived_at, _cts, unnest(props) AS x FROM now WHERE deleted_at IS NULL),
picked AS (SELECT r, c, arrived_at, _cts, x.p AS p, x.v AS v FROM raw WHERE x.p IN ({names}) AND x.k = 'u' AND {not_blank_sql("x.v")}),
links AS (SELECT DISTINCT r, c, p, {canonical_of_sql("v")} AS target_r, arrived_at, strftime(_cts, '%Y-%m') AS period FROM picked),
parents AS ({parents}),
found AS (SELECT l.* FROM links l LEFT JOIN parents q ON q.p = l.p AND q.c = l.c AND q.target_r = l.target_r WHERE q.p IS NULL OR q.first_arrived > l.arrived_at)
{tail}"""


def _p3_sql() -> str:
    v = strip_sql("t.o")
    number = "regexp_replace(regexp_replace(v, '^([+-]?)0*([0-9])', '\\1\\2'), '^[+]', '')"
    return f"""
WITH known AS (SELECT p, data_type, {canonical_of_sql("p")} AS full_p FROM predicates WHERE multiplicity = 'one'),
t AS (SELECT {canonical_of_sql("t.s")} AS s, t.c AS c, {canonical_of_sql("t.p")} AS full_p, {v} AS v FROM triples t WHERE t.s IS NOT NULL AND t.c IS NOT NULL AND {not_blank_sql("t.o")}),
typed AS (SELECT s, c, p, CASE data_type
  WHEN 'integer' THEN CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN CAST(CAST(v AS HUGEINT) AS VARCHAR) END
  WHEN 'decimal' THEN CASE WHEN regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?') THEN CAST(CAST(v AS DECIMAL(38,12)) AS VARCHAR) END
  WHEN 'date' THEN CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(TRY_CAST(v AS DATE) AS VARCHAR) END
  WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', '1') THEN 'true' WHEN lower(v) IN ('false', '0') THEN 'false' END
  ELSE v END AS tv FROM t JOIN known USING (full_p))
SELECT s, c, p FROM typed GROUP BY s, c, p HAVING count(*) > count(tv) OR min(tv) <> max(tv)"""


_P5_ROWS = f"""
WITH rows AS (SELECT row_id, id.c AS c, _cts, props FROM resources),
types AS (SELECT DISTINCT row_id, _cts, {canonical_of_sql("x.v")} AS key_value FROM (SELECT row_id, _cts, unnest(props) AS x FROM rows) WHERE x.p = 'rdf:type' AND x.k = 'u' AND {not_blank_sql("x.v")}),
every AS (SELECT 'id.c' AS field, c AS key_value, _cts FROM rows UNION ALL SELECT 'rdf:type', key_value, _cts FROM types)"""

_VIEW_JSON = "SELECT view_id, CAST(doc AS JSON) AS j FROM view_docs WHERE doc IS NOT NULL AND json_valid(doc)"


def _p4_sql() -> str:
    return f"""
WITH docs AS ({_VIEW_JSON}),
g AS (SELECT view_id, unnest(CAST(j->'value'->'_graphs' AS JSON[])) AS g FROM docs WHERE json_type(j->'value'->'_graphs') = 'ARRAY'),
i AS (SELECT view_id, unnest(CAST(j->'value'->'_impactIndex' AS JSON[])) AS e FROM docs WHERE json_type(j->'value'->'_impactIndex') = 'ARRAY'),
b AS (SELECT view_id, g->'_id'->>'c' AS c, unnest(CASE WHEN json_type(g->'acorn:bookmarkReferences') = 'ARRAY' THEN CAST(g->'acorn:bookmarkReferences' AS JSON[]) ELSE [g->'acorn:bookmarkReferences'] END)->>'u' AS u FROM g),
keys AS (SELECT view_id, {canonical_of_sql("raw")} AS r, c, part FROM (
  SELECT view_id, g->'_id'->>'r' AS raw, g->'_id'->>'c' AS c, 'graph' AS part FROM g
  UNION ALL SELECT view_id, u, c, 'bookmark' FROM b UNION ALL SELECT view_id, e->>'r', e->>'c', 'index' FROM i) WHERE raw IS NOT NULL AND c IS NOT NULL)
SELECT view_id, r, c FROM keys WHERE view_id IN (SELECT view_id FROM g) AND view_id IN (SELECT view_id FROM i) GROUP BY view_id, r, c
HAVING (bool_or(part <> 'index') AND NOT bool_or(part = 'index')) OR (bool_or(part = 'index') AND NOT bool_or(part = 'graph'))"""


_VIEW_PARTS = f"""
WITH docs AS ({_VIEW_JSON}),
listed AS (SELECT view_id, CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] END AS gs, CASE json_type(y) WHEN 'ARRAY' THEN CAST(y AS JSON[]) WHEN 'OBJECT' THEN [y] END AS es
  FROM (SELECT view_id, j->'value'->'_graphs' AS x, j->'value'->'_impactIndex' AS y FROM docs)),
g AS (SELECT view_id, CAST(unnest(range(len(gs))) AS INTEGER) AS graph_no, unnest(gs) AS g FROM listed),
e AS (SELECT view_id, CAST(unnest(range(len(es))) AS INTEGER) AS entry_no, unnest(es) AS e FROM listed),
m AS (SELECT view_id, graph_no, predicate, json_extract(g, '$."' || predicate || '"') AS x FROM (SELECT view_id, graph_no, g, unnest(json_keys(g)) AS predicate FROM g) WHERE predicate <> '_id'),
n AS (SELECT view_id, graph_no, predicate, CAST(unnest(range(len(xs))) AS INTEGER) AS value_no, unnest(xs) AS x FROM (SELECT view_id, graph_no, predicate, CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) ELSE [x] END AS xs FROM m)),
v AS (SELECT view_id, graph_no, predicate, value_no, unnest(CASE WHEN json_type(x) = 'OBJECT' THEN json_keys(x) ELSE [NULL] END) AS kind, x FROM n),
vals AS (SELECT view_id, graph_no, predicate, value_no, kind, CASE WHEN kind IS NULL THEN x->>'$' ELSE json_extract_string(x, '$."' || kind || '"') END AS value FROM v)
"""


def _p3_wide_sql() -> str:
    """The wide rows by DuckDB, whose columns are those of the declared attributes of these tables."""
    v = strip_sql("t.o")
    plain = "regexp_replace(regexp_replace(regexp_replace(v, '^[+]', ''), '^(-?)0+([0-9])', '\\1\\2'), '^-0$', '0')"
    return f"""
WITH t AS (SELECT {canonical_of_sql("t.s")} AS s, t.c AS c, {canonical_of_sql("t.p")} AS full_p, t.pos AS pos, CASE WHEN {not_blank_sql("t.o")} THEN {v} END AS v FROM triples t WHERE t.s IS NOT NULL AND t.c IS NOT NULL),
known AS (SELECT p, data_type, multiplicity, {canonical_of_sql("p")} AS full_p FROM predicates),
typed AS (SELECT s, c, p, data_type, multiplicity, v, pos, CASE data_type
  WHEN 'integer' THEN CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN {plain} END
  WHEN 'decimal' THEN CASE WHEN regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?') THEN CAST(CAST(v AS DECIMAL(38,12)) AS VARCHAR) END
  WHEN 'date' THEN CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(TRY_CAST(v AS DATE) AS VARCHAR) END
  WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', '1') THEN 'true' WHEN lower(v) IN ('false', '0') THEN 'false' END
  ELSE v END AS tv FROM t JOIN known USING (full_p) WHERE v IS NOT NULL),
cells AS (SELECT s, c, p, CASE WHEN count(*) = count(tv) AND min(tv) = max(tv) THEN min(tv) END AS value, count(*) > count(tv) OR min(tv) <> max(tv) AS bad FROM typed WHERE multiplicity = 'one' GROUP BY s, c, p),
lists AS (SELECT s, c, p, to_json(list(tv ORDER BY pos, tv)) AS value FROM (SELECT s, c, p, tv, min(pos) AS pos FROM typed WHERE multiplicity = 'many' AND tv IS NOT NULL GROUP BY s, c, p, tv) GROUP BY s, c, p)
SELECT s, c, p, CAST(value AS VARCHAR) AS value FROM cells WHERE value IS NOT NULL UNION ALL SELECT s, c, p, CAST(value AS VARCHAR) FROM lists"""


SQL = {
    "p1_found": _p1_sql("SELECT r, c, p, target_r FROM found"),
    "p1_by_period": _p1_sql("SELECT l.p, l.period, count(*) AS links, count(f.p) AS dangling FROM links l LEFT JOIN (SELECT DISTINCT r, c, p, target_r FROM found) f USING (r, c, p, target_r) GROUP BY l.p, l.period").replace("SELECT l.p, l.period", "SELECT l.p AS p, l.period AS period"),
    "p3_found": _p3_sql(),
    "p3_values": _p3_wide_sql(),
    "p4_found": _p4_sql(),
    "p4_views": _VIEW_PARTS + f"""SELECT view_id, doc IS NOT NULL AND json_valid(doc) AS valid, CASE WHEN j IS NULL THEN NULL ELSE {canonical_of_sql("j->'_id'->>'r'")} END AS r, j->'_id'->>'c' AS c, j->'_id'->>'type' AS type, j->>'_cts' AS cts, j->'value'->>'_expires' AS expires,
CAST(coalesce(len(gs), 0) AS BIGINT) AS graphs, CAST(coalesce(len(es), 0) AS BIGINT) AS index_entries FROM view_docs LEFT JOIN docs USING (view_id) LEFT JOIN listed USING (view_id)""",
    "p4_graphs": _VIEW_PARTS + f"SELECT view_id, graph_no, {canonical_of_sql("g->'_id'->>'r'")} AS r, g->'_id'->>'c' AS c FROM g WHERE coalesce(g->'_id'->>'r', g->'_id'->>'c') IS NOT NULL",
    "p4_impact_index": _VIEW_PARTS + f"SELECT view_id, entry_no, {canonical_of_sql("e->>'r'")} AS r, e->>'c' AS c FROM e WHERE coalesce(e->>'r', e->>'c') IS NOT NULL",
    "p4_values": _VIEW_PARTS + "SELECT * FROM vals WHERE value IS NOT NULL",
    "p4_bookmarks": _VIEW_PARTS + f"SELECT view_id, graph_no, value_no, {canonical_of_sql('value')} AS target_r FROM vals WHERE predicate = 'acorn:bookmarkReferences' AND kind = 'u' AND value IS NOT NULL",
    "p4_resource_bookmarks": f"""SELECT row_id, CAST(prop_no AS INTEGER) AS prop_no, x.pos AS value_no, {canonical_of_sql("x.v")} AS target_r FROM (SELECT row_id, unnest(range(len(props))) AS prop_no, unnest(props) AS x FROM resources)
WHERE x.p = 'acorn:bookmarkReferences' AND x.k = 'u' AND x.v IS NOT NULL""",
    "p5_found": _P5_ROWS + f" SELECT field, key_value FROM every GROUP BY field, key_value HAVING key_value IS NOT NULL AND count(*) * {HEAVY_ONE_IN} >= (SELECT count(*) FROM resources)",
    "p5_statistics": _P5_ROWS + """, per AS (SELECT field, key_value, CAST(_cts AS DATE) AS day, count(*) AS w, max(_cts) AS latest FROM every GROUP BY ALL)
SELECT field, key_value, CAST(sum(w) AS BIGINT) AS rows, max(latest) AS latest_cts, count(day) AS distinct_values, CAST(arg_min(day, (-w, day)) FILTER (day IS NOT NULL) AS VARCHAR) AS mode_day FROM per GROUP BY field, key_value""",
    "p5_median_day": _P5_ROWS + " SELECT field, key_value, CAST(CAST(quantile_disc(CAST(_cts AS DATE), 0.5) AS DATE) AS VARCHAR) AS median_day FROM every WHERE _cts IS NOT NULL GROUP BY field, key_value",
}
