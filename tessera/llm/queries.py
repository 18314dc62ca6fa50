"""The queries of the text operators, and their text for DuckDB."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import not_blank_sql
from tessera.functions.uri import Namespaces
from tessera.llm import leakage, lookalike, terms, tokenize
from tessera.operators.records import current_rows_sql
from tessera.sources.tables import read

#: Folder of the public tokenizers' files; the same on every worker.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
#: A term of more than this share of all records is common.
COMMON_ABOVE = 0.1


def _terms(spark: SparkSession, d: str) -> DataFrame:
    documents = terms.titles(read(spark, d, "resources"), read(spark, d, "searchdata"), Namespaces.of(read(spark, d, "prefixes")))
    return terms.marked(terms.term_counts(documents), documents, COMMON_ABOVE)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(read(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it and its longest passage."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("words").alias("longest"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold no passage of any item; those with a null doc_id are kept."""
    return read(spark, d, "documents").join(_leaks(spark, d).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(*lookalike.classes(read(spark, d, "documents")))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.sized(*lookalike.classes(read(spark, d, "documents")))


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    documents = read(spark, d, "documents")
    return lookalike.canonical_texts(documents, lookalike.classes(documents)[0])


QUERIES = {f.__name__: f for f in (p6_found, p6_terms, p7_ids, p8_found, p8_passages, p8_items, p8_kept, p9_found, p9_classes, p9_texts)}

_P6 = f"""
WITH res AS ({current_rows_sql("resources", ["row_id", "deleted_at", "props"])}),
sea AS ({current_rows_sql("searchdata", ["row_id", "dct_title"])}),
titles AS (SELECT 0 AS source, row_id, x.v AS title FROM (SELECT row_id, unnest(props) AS x FROM res WHERE deleted_at IS NULL) WHERE x.p = 'searchterms:title'
  UNION ALL SELECT 1, row_id, dct_title FROM sea),
kept AS (SELECT * FROM titles WHERE {not_blank_sql("title")}),
words AS (SELECT source, row_id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{Nd}}]+')) AS term FROM kept),
counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT (source, row_id)) AS records FROM words GROUP BY term),
marked AS (SELECT *, CASE WHEN records = 1 THEN 'rare' WHEN records > {COMMON_ABOVE} * (SELECT count(DISTINCT (source, row_id)) FROM kept) THEN 'common' END AS mark FROM counts)
"""


#: How letters of other scripts are drawn, in pairs; written down by hand, so that the SQL shares no table with the
#: operator.
_DRAWN_ALIKE = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv"
)
_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t"
_PRINTS_NOTHING = "\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff"


def _p9_sql(result: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    drawn = [pair[0] for pair in _DRAWN_ALIKE.split()], [pair[1] for pair in _DRAWN_ALIKE.split()]
    wide = [chr(p) for p in range(0xFF01, 0xFF5F)], [chr(p) for p in range(0x21, 0x7F)]
    one, other = "".join([*drawn[0], *wide[0], *_BLANKS]), "".join([*drawn[1], *wide[1]]) + " " * len(_BLANKS)
    form = "text"
    for joined, letters in {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "\u017ft", "\ufb06": "st", "\u0132": "IJ", "\u0133": "ij"}.items():
        form = f"replace({form}, '{joined}', '{letters}')"
    # Separate accents are joined before and after letters are replaced.
    form = f"nfd(regexp_replace({form}, '[{_PRINTS_NOTHING}]+', '', 'g'))".replace("nfd(", "nfc_normalize(")
    accents = "áàâäãåéèêëíìîïóòôöõúùûüýÿñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÑÇ"
    import unicodedata

    composed = {}
    for pair in _DRAWN_ALIKE.split():
        for letter in accents:
            parts = unicodedata.normalize("NFD", letter)
            if parts[0] == pair[1]:
                made = unicodedata.normalize("NFC", pair[0] + parts[1:])
                if len(made) == 1:
                    composed[made] = letter
    form = f"translate({form}, {quote(one + ''.join(composed))}, {quote(other + ''.join(composed.values()))})"
    form = f"nfc_normalize({form})"
    return f"WITH forms AS (SELECT doc_id, text, {form} AS form FROM documents WHERE text <> '') {result}"


_P9_CLASSES = """, classes AS (SELECT form, arg_min(doc_id, (strlen(text), text, doc_id)) AS class_id, count(*) AS documents, count(DISTINCT text) AS texts
FROM forms GROUP BY form HAVING count(DISTINCT text) > 1)"""


SQL = {
    "p6_found": _P6 + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p6_terms": _P6 + "SELECT * FROM marked",
    "p9_found": _p9_sql("SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"),
    "p9_classes": _p9_sql(_P9_CLASSES + " SELECT doc_id, class_id, documents, texts FROM forms JOIN classes USING (form)"),
}
