"""Texts that look the same and differ in their characters.

Look-alike characters are mapped, the mapped values are grouped under an accent-sensitive Unicode collation in SQL, each
class takes one member as canonical, and that is joined back to all its members.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.uri import let
from tessera.session import written

#: Characters that print nothing.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: The collation that tells letters, accents and case apart, and neither composed from separate accents nor invisible characters.
COLLATION = "UNICODE"


#: Scripts whose letters are compared with Latin ones: those that have capital and small letters, and Lisu, whose letters are
#: drawn like Latin capitals.
SCRIPTS = ("GREEK", "CYRILLIC", "ARMENIAN", "COPTIC", "CHEROKEE", "DESERET", "LISU", "OSAGE", "GLAGOLITIC", "WARANG CITI", "MEDEFAIDRIN")
#: Letters whose signature is themselves: those without a decomposition in the main blocks of Greek, Cyrillic, Armenian, Hebrew,
#: Arabic, Georgian, first consonants of Hangul, Hiragana, Katakana, and Han. No two of them are equal under the collation.
_OWN = ((0x370, 0x4FF), (0x531, 0x587), (0x5D0, 0x5EA), (0x620, 0x64A), (0x10D0, 0x10FF), (0x1100, 0x1112), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF))
_POINTS = 0x110000


def _kinds(first: int = 0x80) -> list[tuple[str, str, str]]:
    """(character, name, category) of all assigned characters that aren't ASCII."""
    every = (chr(p) for p in range(first, _POINTS))
    return [(x, unicodedata.name(x, ""), kind) for x in every if (kind := unicodedata.category(x)) not in ("Cn", "Co", "Cs")]


_FOUND: dict[str, dict[str, str]] = {}


def alike(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts and the ASCII letters they are drawn like, by the public table of confusable characters
    (Unicode Technical Standard 39) in the library of the runtime.

    A letter is drawn like a Latin one of the same case with the same skeleton. Letters with accents follow their base.
    """
    if not _FOUND:
        ascii_letters = [chr(p) for p in range(0x41, 0x7B) if chr(p).isalpha()]
        letters = [x for x, name, kind in _kinds() if kind in ("Lu", "Ll", "Lo") and name.startswith(SCRIPTS)]
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeletons = checker.getSkeleton("\n".join(ascii_letters + letters)).split("\n")
        latin = {(s, x.isupper()): x for x, s in zip(ascii_letters, skeletons, strict=False)}
        others = zip(letters, skeletons[len(ascii_letters) :], strict=True)
        table = {x: latin[s, not x.islower()] for x, s in others if (s, not x.islower()) in latin}
        for x in letters:
            base, *marks = unicodedata.normalize("NFD", x)
            if marks and base in table:
                made = unicodedata.normalize("NFC", table[base] + "".join(marks))
                if len(made) == 1:
                    table[x] = made
        _FOUND["alike"] = table
    return _FOUND["alike"]


@cache
def _widths() -> dict[str, str]:
    """Characters of another width and kinds of blank, each for one other character; single glyph shapes of joined scripts."""
    out = {"\t": " "}
    for x, _, kind in _kinds():
        tag, *parts = unicodedata.decomposition(x).split() or [""]
        plain = "".join(chr(int(p, 16)) for p in parts) if tag.startswith("<") else ""
        if kind == "Zs":
            out[x] = " "
        elif tag in ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>") and len(plain) == 1:
            out[x] = plain
    return out


@cache
def _joined() -> tuple[dict[str, str], dict[str, str]]:
    """Joined letters and what they print as: of scripts that join by rule (many), and others (few)."""
    few, many = {}, {}
    for x, _, kind in _kinds():
        tag, *parts = unicodedata.decomposition(x).split() or [""]
        plain = unicodedata.normalize("NFKC", x)
        if tag in ("<isolated>", "<initial>", "<medial>", "<final>") and len(parts) > 1:
            many[x] = plain
        elif tag == "<compat>" and ((kind[0] == "L" and len(plain) > 1) or (kind == "Nl" and plain.isalpha())) and all(unicodedata.category(p)[0] in "LM" for p in plain):
            few[x] = plain
    return few, many


def _apart(text: Column, table: dict[str, str], one_by_one: bool) -> Column:
    """text with the characters of table replaced by several each; texts without any are left alone."""

    def replaced(x: Column) -> Column:
        if one_by_one:
            pairs = F.create_map(*[F.lit(y) for pair in table.items() for y in pair])
            made = F.array_join(F.transform(F.split(x, ""), lambda y: F.coalesce(F.try_element_at(pairs, y), y)), "")
        else:
            made = x
            for joined, letters in table.items():
                made = F.replace(made, F.lit(joined), F.lit(letters))
        return F.when(x.rlike(f"(?=[^\\x00-\\xff])[{_ranges(map(ord, table))}]"), made).otherwise(x)

    return let(text, replaced)


def _mapped(text: Column, single: dict[str, str]) -> Column:
    few, many = _joined()
    return _apart(_apart(F.translate(text, "".join(single), "".join(single.values())), few, False), many, True)


def mapped(text: Column, alike: dict[str, str]) -> Column:
    """text with look-alike letters, widths, blanks and joined letters in one form; accents and invisible characters stay."""
    return _mapped(text, {**_widths(), **alike})


def _bare(alike: dict[str, str]) -> dict[str, str]:
    """The character that stands for each other one in a signature: its base by canonical decomposition, of what it is mapped to."""
    single, out = {**_widths(), **alike}, {}
    for x, _, _ in _kinds():
        base = unicodedata.normalize("NFD", single.get(x, x))[0]
        base = single.get(base, base)
        if base != x and not "\uac00" <= x < "\ud7a4":
            out[x] = base
    return out


@cache
def _kept() -> str:
    """A regular expression of the characters that don't count in a signature: all but ASCII and the letters of some scripts."""
    inside = lambda x: any(a <= ord(x) <= b for a, b in _OWN)
    own = [ord(x) for x, _, kind in _kinds() if kind in ("Lo", "Ll", "Lu") and inside(x) and not unicodedata.decomposition(x)]
    # What is ASCII is told apart first.
    return f"(?:(?=[^\\n\\r -~])[^\\n\\r -~{_ranges(own)}])+"


def _ranges(points: Iterable[int]) -> str:
    """The inside of a character class of a regular expression."""
    points, out, first = sorted(points), "", 0
    for k, p in enumerate(points):
        if k + 1 == len(points) or points[k + 1] != p + 1:
            out += f"\\x{{{points[first]:x}}}-\\x{{{p:x}}}"
            first = k + 1
    return out


def signature(text: Column, alike: dict[str, str]) -> Column:
    """A hash that is equal for texts whose mapped() forms are equal under the collation: of ASCII characters and letters of the
    scripts in _OWN, with accents taken off. It only says which texts have to be compared."""
    bare = _bare(alike)
    plain = lambda x: "".join(bare.get(y, y) for y in unicodedata.normalize("NFD", x))
    few, many = ({x: plain(y) for x, y in table.items()} for table in _joined())
    leads = F.translate(_syllables(text), *_as_translation(bare))
    return F.xxhash64(F.regexp_replace(_apart(_apart(leads, few, False), many, True), _kept(), ""))


def _as_translation(table: dict[str, str]) -> tuple[str, str]:
    return "".join(table), "".join(table.values())


def _syllables(text: Column) -> Column:
    """Each Hangul syllable as its first consonant, which is what is kept of separate ones."""

    def replaced(x: Column) -> Column:
        made = x
        for k in range(19):
            first = 0xAC00 + 588 * k
            made = F.regexp_replace(made, f"[{chr(first)}-{chr(first + 587)}]", chr(0x1100 + k))
        return F.when(x.rlike("[\uac00-\ud7a3]"), made).otherwise(x)

    return let(text, replaced)


def consistent(text: Column, alike: dict[str, str]) -> Column:
    """text without invisible characters, with widths, blanks and joined letters in one form, and with look-alike letters as Latin
    ones in words that have Latin letters; words of another script stay in it."""
    inside = f"(?=[^\\x00-\\xff])[{_ranges(map(ord, alike))}]"
    word = F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)")
    one = lambda t: F.when(t.rlike("[A-Za-z]"), F.translate(t, *_as_translation(alike))).otherwise(t)
    words = lambda x: F.when(x.rlike(inside), F.array_join(F.transform(F.regexp_extract_all(x, word, F.lit(1)), one), "")).otherwise(x)
    return let(F.regexp_replace(_mapped(text, _widths()), f"[{INVISIBLE}]+", ""), words)


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, variants) of the classes that have more than one text.

    members: key, sig, exact, class_id of each document; variants: sig, exact, class_id of each distinct text. class_id is the
    smallest key of the canonical text: the shortest in bytes, of equally short ones the first in binary order. Null and empty
    texts and null keys belong to no class. Copies of a text are one variant and never meet each other.

    The signatures are written once; whole texts move only where their signature is that of another text.
    """
    letters = alike(documents.sparkSession)
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key IS NOT NULL AND _text <> ''")
    narrow = written(rows.select("_key", signature(F.col("_text"), letters).alias("sig"), F.md5("_text").alias("exact")), "signatures")
    variants = narrow.groupBy("sig", "exact").agg(F.min("_key").alias("_key"))
    several = variants.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig")
    candidates = written(variants.join(several, "sig", "left_semi"), "candidates")
    texts = written(candidates.join(rows, "_key").select("sig", "exact", "_key", "_text"), "texts")
    texts = texts.withColumn("form", F.collate(mapped(F.col("_text"), letters), COLLATION))
    best = F.min_by("_key", F.struct(F.octet_length("_text"), F.col("_text")))
    canonical = texts.groupBy("sig", "form").agg(best.alias("class_id"), F.count_distinct("exact").alias("n")).where("n > 1").select("sig", "form", "class_id")
    of_variant = written(texts.join(canonical, ["sig", "form"]).select("sig", "exact", "class_id"), "variants")
    return narrow.join(of_variant, ["sig", "exact"]).select(F.col("_key").alias(key), "sig", "exact", "class_id"), of_variant


def sized(members: DataFrame, variants: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, class_id, documents, texts: each member with how many documents and how many different texts its class has. All that
    pairs() tells is in here, in one row per document."""
    texts = variants.groupBy("class_id").agg(F.count(F.lit(1)).alias("texts"))
    counted = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("documents")).join(texts, "class_id")
    return members.select(key, "class_id").join(counted, "class_id").select(key, "class_id", "documents", "texts")


def pairs(members: DataFrame, variants: DataFrame, key: str = "doc_id") -> DataFrame:
    """key_a < key_b of documents of one class whose texts differ.

    First the pairs of differing texts, then their documents: the cost is that of the result, and copies don't meet. Where pairs
    aren't asked for, sized() holds the same in one row per document.
    """
    a = variants.select("class_id", F.col("sig").alias("sig_a"), F.col("exact").alias("exact_a"))
    b = variants.select("class_id", F.col("exact").alias("exact_b"))
    both = a.join(b, "class_id").where("exact_a < exact_b").drop("class_id")
    left = members.select(F.col("sig").alias("sig_a"), F.col("exact").alias("exact_a"), F.col(key).alias("one"))
    right = members.select(F.col("sig").alias("sig_a"), F.col("exact").alias("exact_b"), F.col(key).alias("other"))
    every = both.join(left, ["sig_a", "exact_a"]).join(right, ["sig_a", "exact_b"])
    return every.select(F.least("one", "other").alias(f"{key}_a"), F.greatest("one", "other").alias(f"{key}_b")).where(f"{key}_a < {key}_b")


def canonical_texts(documents: DataFrame, members: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, text of every document: the canonical text of its class, made consistent; class_id is null without one.

    Only members of classes are joined by class; all others, and those with a null key, go straight through.
    """
    letters = alike(documents.sparkSession)
    rows = documents.select(key, F.col(text).alias("text"))
    keyed = rows.where(F.col(key).isNotNull())
    alone = keyed.join(members.select(key), key, "left_anti").unionByName(rows.where(F.col(key).isNull()))
    held = keyed.join(members.select(F.col("class_id").alias(key)).distinct(), key, "left_semi").select(F.col(key).alias("class_id"), F.col("text").alias("_canonical"))
    classed = keyed.join(members.select(key, "class_id"), key).join(held, "class_id", "left").select(key, "class_id", F.coalesce("_canonical", "text").alias("text"))
    every = classed.unionByName(alone.select(key, F.lit(None).cast(members.schema["class_id"].dataType).alias("class_id"), "text"))
    return every.select(key, "class_id", consistent(F.col("text"), letters).alias("text"))
