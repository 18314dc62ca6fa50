"""The text operators against brute force: nulls, empty and very long texts, ties, repeats, empty tables, further columns."""

import random
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, leakage, lookalike, terms, tokenize
from tessera.llm.queries import TOKENIZERS

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"
needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no tokenizer files")
ODD = ["", None, "a", "  ", "\n\n a", "it's 's  's\n's''s don't'll 'LL", "x" * 5000, "ab" * 300 + " " * 90 + "\t\tz", "\u00bd \u2167 \u00e9 e\u0301 \u200b", "'re've", "<|endoftext|> hi", "　　a", "日本語 テキスト" * 40]


@needs_vocabulary
def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(VOCABULARY)
    reference.encode_special_tokens = True
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice("ab 's'tre\n\t 1é½…ﬁ vlmd") for _ in range(draw.randint(1, 80))) for _ in range(2000)]
    texts += ["".join(draw.choice("abcdeè日") for _ in range(n)) for n in (63, 64, 65, 66, 200, 3000, 100_000)] + ["a" * 101, "the" * 40_000, "=" * 70_001]
    offsets, ids = bpe.merges(VOCABULARY).encode(texts)
    want = [e.ids for e in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want


@needs_vocabulary
def test_encode_a_table(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "PART_CHARS", 100)
    rows = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(ODD)] + [(None, "a", "clash"), (0, "", "again")], "doc_id bigint, text string, ids string")
    got = tokenize.encode(rows, "doc_id", "text", VOCABULARY).collect()
    assert len(got) == len(ODD) + 2 and {tuple(r.ids) for r in got if r.doc_id in (0, 1)} == {()} and [r.ids for r in got if r.doc_id is None] == [[64]]
    assert tokenize.encode(rows.limit(0), "doc_id", "text", VOCABULARY).count() == 0


TABLES = []


@pytest.fixture(autouse=True, scope="module")
def letters(spark):
    TABLES[:] = [leakage.Letters(lookalike.alike(spark))]


def test_terms(spark):
    rows = [(0, 1, ["The the théorie", "the x2"]), (0, 2, ["the"]), (1, 1, ["THE: x2", None]), (0, 3, ["..."]), (0, 4, ["z" * 30000])] + [(1, 100 + n, ["hot"]) for n in range(200)]
    documents = spark.createDataFrame(rows, "source int, record bigint, titles array<string>")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.marked(terms.term_counts(documents), documents, 0.1).collect()}
    assert got == {"the": (5, 3, None), "théorie": (1, 1, "rare"), "x2": (2, 2, None), "z" * 30000: (1, 1, "rare"), "hot": (200, 200, "common")}
    assert terms.term_counts(documents.limit(0)).count() == 0


def test_current_titles_only(spark, ns, at):
    props = lambda *t: [("searchterms:title", n, "l", x) for n, x in enumerate(t)]
    res = [(1, ("res:1", "g"), props("old"), 1, None), (2, ("http://A.example/items/1", "g"), props("new", " ", None), 2, None), (3, ("res:2", "g"), props("gone"), 1, at(1)), (4, ("res:3", "g"), None, None, None)]
    resources = spark.createDataFrame(res, "row_id bigint, id struct<r:string,c:string>, props array<struct<p:string,pos:int,k:string,v:string>>, _version bigint, deleted_at timestamp")
    sea = spark.createDataFrame([(1, ("res:1", "g"), "sea", None), (2, ("res:9", "g"), "  ", 1), (3, None, "none", 1)], "row_id bigint, id struct<r:string,c:string>, dct_title string, _version bigint")
    assert sorted((r.source, r.titles[0]) for r in terms.titles(resources, sea, ns).collect()) == [(0, "new"), (1, "sea")]


def printed(x):
    """What a character prints as, by the operator's tables."""
    few, many = lookalike._joined()
    return {**lookalike._widths(), **TABLES[0].alike, **few, **many}.get(x, x)


def plain_form(text):
    """By hand: accents joined, a few letters of other scripts, full and half width, joined letters, blanks, what prints nothing."""
    hand = dict(zip("сМοаＡＢﾊﾟア\u3000\u00a0\u2009\tᎪꓐ", ["c", "M", "o", "a", "A", "B", "ハ", "\u309a", "ア", " ", " ", " ", " ", "A", "B"], strict=False))
    text = "".join({**hand, "ｱ": "ア", "ﬁ": "fi", "ﾡ": "ᄀ", "Ⅷ": "VIII", "Ё": "Ë"}.get(x, x) for x in text)
    text = "".join(chr(ord(x) - 0xFEE0) if "\uff01" <= x <= "\uff5e" else x for x in text)
    return unicodedata.normalize("NFC", "".join(x for x in text if x not in "\u200b\u00ad\u200d\ufeff\u2060"))


LOOKS = [
    "café Max", "café Max", "сafé Мax", "ｃａｆé　Ｍax", "ca​fé Max", "cafe Max", "Café Max", "café  Max", "café\nMax",
    "ﬁne", "fine", "ﬁne", "Ёж", "Ëж", "​", "­", " ", " ", "x…", "x...", None, "", "long " * 4000, "long " * 4000,
]


def test_lookalikes_equal_brute_force(spark):
    rows = spark.createDataFrame([(n, t, "clash", 1) for n, t in enumerate(LOOKS)] + [(None, "fine", "", 0)], "doc_id bigint, text string, sig string, class_id int")
    members, variants = lookalike.classes(rows)
    want = {(a, b) for a in range(len(LOOKS)) for b in range(a + 1, len(LOOKS)) if LOOKS[a] and LOOKS[b] and LOOKS[a] != LOOKS[b] and plain_form(LOOKS[a]) == plain_form(LOOKS[b])}
    assert {(r.doc_id_a, r.doc_id_b) for r in lookalike.pairs(members, variants).collect()} == want and (0, 1) in want and (0, 5) not in want
    classes = {r.doc_id: r.class_id for r in members.collect()}
    assert len({classes[n] for n in range(5)}) == 1, classes
    assert {5, 6, 20, 21, 24, 25}.isdisjoint(classes) and classes[22] == classes[23], classes
    texts = {r.doc_id: r.text for r in lookalike.canonical_texts(rows.where("doc_id IS NOT NULL"), members).collect()}
    assert len(texts) == len(LOOKS) and len({texts[n] for n in range(5)}) == 1 and texts[20] is None
    kept = spark.createDataFrame([(1, "Ο καιρός, сafé\u200b ｘ\ufb01 Мoscow и Москва"), (None, "ﬁ")], "doc_id bigint, text string")
    assert {r.text for r in lookalike.canonical_texts(kept, members).collect()} == {"Ο καιρός, café xfi Moscow и Москва", "fi"}
    empty = lookalike.classes(rows.limit(0))
    assert lookalike.pairs(*empty).count() == 0


def test_signatures_are_equal_where_the_collation_is(spark):
    """Every character that has a canonical decomposition or another printed form, against that form."""
    form = lambda x: unicodedata.normalize("NFD", printed(x))
    points = [x for x, *_ in lookalike._kinds()]
    rows = spark.createDataFrame([(x, f"a{x}b", f"a{form(x)}b") for x in points if form(x) != x], "x string, one string, other string")
    alike = TABLES[0].alike
    mapped = lambda c: F.collate(lookalike.mapped(F.col(c), alike), lookalike.COLLATION)
    sign = lambda c: lookalike.signature(F.col(c), alike)
    found = rows.select("x", (mapped("one") == mapped("other")).alias("equal"), (sign("one") == sign("other")).alias("same")).where("equal").collect()
    assert {"\u2260", "\u226e", "\u226f", "\u037e", "\u1fef", "\u00e9", "\uffe3"} <= {r.x for r in found}
    assert [r.x for r in found if not r.same] == []


def test_letters_that_count_in_a_signature_differ_under_the_collation(spark):
    """Every kept letter between two others, by its collation key: none equals another, so a signature parts no equal texts."""
    import re

    drop = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), lookalike._kept()))
    kept = [x for x, *_ in lookalike._kinds() if not drop.match(x)]
    assert len(kept) > 27_000
    rows = spark.createDataFrame([(x, f"a{x}b") for x in kept], "x string, t string")
    alike = TABLES[0].alike
    form = F.collate(lookalike.mapped(F.col("t"), alike), lookalike.COLLATION)
    groups = rows.select("x", form.alias("form"), lookalike.signature(F.col("t"), alike).alias("sig")).groupBy("form").agg(F.count_distinct("sig").alias("n"), F.collect_list("x").alias("xs")).where("n > 1").select("n", "xs").collect()
    assert groups == []


def test_texts_without_class_and_without_ascii_are_spread(spark):
    """10,000 unclassed texts and 10,000 texts of other scripts: no task gets more than twice its share."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10_000, F.concat(F.lit("text "), "id")).otherwise(F.expr("concat(chr(0), translate(cast(id as string), '0123456789', '中文字日本語漢仮名交'))")).alias("text"))
    letters = TABLES[0].alike
    sigs = rows.select(lookalike.signature(F.col("text"), letters).alias("sig")).distinct().count()
    assert sigs == 20_000
    out = lookalike.canonical_texts(rows, lookalike.classes(rows)[0])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / len(sizes)


def test_only_what_prints_the_same_is_mapped(spark):
    alike = TABLES[0].alike
    assert {"а": "a", "Е": "E", "ѕ": "s", "ο": "o", "Η": "H", "Ꭺ": "A", "ꓐ": "B", "ё": "ë"}.items() <= alike.items()
    assert not {"ж", "я", "Ω", "λ", "ß", "æ", "ı"} & alike.keys() and all(x not in alike for x in "éüñ")


WORDS = [f"w{chr(97 + n % 26)}{chr(97 + n // 26)}ord" for n in range(400)]
ITEM = WORDS[:60]


def leaked(text, spark=None):
    items = leakage.Items(TABLES[0], [7], [" ".join(ITEM)], leakage.Rule().least_run)
    return [(i, n) for _, i, n, *_ in leakage.search(items, [text], leakage.Rule())]


def test_leaks():
    around = lambda body: " ".join(WORDS[100:130]) + " " + body + " " + " ".join(WORDS[130:160])
    whole = " ".join(ITEM)
    assert leaked(around(whole)) == [(0, 60)]
    assert leaked(around(" ".join(ITEM[10:35]))) == [(0, 25)] and leaked(around(" ".join(ITEM[10:34]))) == []
    changed = ITEM[5:45]
    for k in (4, 13, 25, 33):
        changed = changed[:k] + ["█████" if k % 2 else "[redacted]"] + changed[k + 1 :]
    assert leaked(around(" ".join(changed))) == [(0, 40)]
    assert leaked(around(" ".join("other" if k % 5 == 2 else w for k, w in enumerate(ITEM)))) == []
    assert leaked(around(whole.upper().replace("W", "\uff37").replace(" ", ", ").replace("O", "\u041e"))) == [(0, 60)]
    broken = " ".join(w if k % 7 else w[:3] + "-\n" + w[3:] for k, w in enumerate(ITEM))
    assert leaked(around(broken)) == [(0, 60)]
    paged = " ".join(ITEM[:20]) + "\nHIGH COURT — HC/2020/1 — page 2\n" + " ".join(ITEM[20:40]) + "\n[31] " + " ".join(ITEM[40:])
    assert leaked(around(paged)) == [(0, 60)]
    assert leaked(around(" ".join(ITEM[:12]) + " " + " ".join(WORDS[200:212]) + " " + " ".join(ITEM[20:32]))) == []


def test_leaks_of_tables(spark, monkeypatch):
    text = " ".join(ITEM)
    rows = [(1, text, "clash"), (1, text, "clash"), (2, None, ""), (3, "", ""), (4, "word " * 300_000 + text, ""), (None, text, ""), (5, "x", "")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, text), (8, None), (9, "short one"), (10, " ".join(WORDS[300:360]))], "item_id bigint, text string")
    want = {(1, 7, 60), (4, 7, 60), (None, 7, 60)}
    assert {(r.doc_id, r.item_id, r.words) for r in leakage.leaks(documents, items).collect()} == want
    monkeypatch.setattr(leakage, "ITEM_CHARS", 300)
    assert {(r.doc_id, r.item_id, r.words) for r in leakage.leaks(documents, items).collect()} == want
    assert leakage.leaks(documents, items.limit(0)).count() == 0 and leakage.leaks(documents.limit(0), items).count() == 0


def test_leaks_equal_a_plain_search():
    """Random passages of random lengths without changes: found from 25 words on, with their length."""
    draw = random.Random(5)
    items = [[draw.choice(WORDS) for _ in range(80)] for _ in range(10)]
    held = leakage.Items(TABLES[0], list(range(10)), [" ".join(i) for i in items], leakage.Rule().least_run)
    for _ in range(60):
        which, size = draw.randrange(10), draw.randint(15, 60)
        start = draw.randrange(80 - size + 1)
        text = " ".join(["before"] * 20 + items[which][start : start + size] + ["after"] * 20)
        got = [(i, n, first) for _, i, n, _, first, *_ in leakage.search(held, [text], leakage.Rule())]
        assert got == ([(which, size, start)] if size >= 25 else [])


def brute_force(item, text, rule):
    """(verbatim words, words) of the best leak, over every chain of equal words; between two of them at most 2 words for each
    altered one, and one more."""
    same = [(i, j) for i, w in enumerate(item) for j, v in enumerate(text) if w == v]
    least, best = {p: {p[0]: 0} for p in same}, (0, 0)
    for n, (i, j) in enumerate(same):
        here = least[i, j]
        for first, altered in here.items():
            if i + 1 - first >= rule.words and altered * rule.altered_in <= i + 1 - first:
                best = max(best, (i + 1 - first - altered, i + 1 - first))
        for i2, j2 in same[n + 1 :]:
            if i2 > i and j2 > j and j2 - j - 1 <= 2 * (i2 - i - 1) + 1:
                for first, altered in here.items():
                    least[i2, j2][first] = min(least[i2, j2].get(first, 999), altered + i2 - i - 1)
    return best


def test_leaks_with_altered_words_equal_brute_force():
    rule, draw = leakage.Rule(), random.Random(8)
    gone = lambda body, at: " ".join("█████" if k in at else w for k, w in enumerate(body))
    assert leaked(gone(ITEM[:40], range(18, 22))) == [(0, 40)]
    assert leaked(" ".join([*ITEM[:15], "other", "of", "the", "another", *ITEM[19:40]])) == [(0, 40)]
    assert leaked(gone(ITEM[:40], range(18, 23))) == []
    seen = 0
    for _ in range(80):
        item = [draw.choice(["of", "the", "a"]) if draw.random() < 0.3 else w for w in draw.sample(WORDS, 60)]
        size = draw.randint(25, 60)
        start, some = draw.randrange(60 - size + 1), draw.randint(0, size // 10 + 1)
        body = [[w] for w in item[start : start + size]]
        cluster = draw.randrange(1, size - some)
        for k in range(cluster, cluster + some) if draw.random() < 0.5 else draw.sample(range(1, size - 1), some):
            body[k] = draw.choice([[], ["the"], ["x" * 30], ["of", "y" * 40]])
        text = ["the", "of"] * 5 + [w for words in body for w in words] + ["a", "the"] * 5
        held = leakage.Items(TABLES[0], [0], [" ".join(item)], rule.least_run)
        got = [(n - altered, n) for _, _, n, altered, *_ in leakage.search(held, [" ".join(text)], rule)]
        want = brute_force(item, text, rule)
        seen += want > (0, 0)
        assert got == ([want] if want > (0, 0) else []), (item, text)
    assert 40 < seen < 80


def test_leaks_in_words_that_the_text_parts_otherwise():
    """A word is the same wherever the text parts it, and no part of a longer word."""
    item = [f"{w}'s" if k % 4 == 0 else w for k, w in enumerate(ITEM)]
    items = leakage.Items(TABLES[0], [0], [" ".join(item)], leakage.Rule().least_run)
    found = lambda text: [n for _, _, n, *_ in leakage.search(items, [text], leakage.Rule())]
    assert found(" ".join(item[:30])) == [30]
    assert found(" ".join(w[:3] + "\n" + w[3:] for w in item[:30])) == [30]
    assert found(" ".join(item[:25])[:-2] + "longer") == [] and found(" ".join(item[1:26]) + "longer") == []
    assert found("x" + " ".join(item[:25])) == [] and found("x" + " ".join(item[:26])) == [25]


def test_suffix_array_is_in_the_order_of_the_letters():
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choice("ab") for _ in range(draw.randint(1, 4))) for _ in range(60)) for _ in range(20)]
    stream = leakage.stream(TABLES[0], texts, furniture=False)
    for depth in (7, 10, 17, 20):
        order, keys = leakage.suffix_array(stream, stream.begins, depth)
        prefixes = [stream.letters[p : p + depth].tobytes() for p in stream.begins[order]]
        assert prefixes == sorted(prefixes)
        low, high = leakage.bounds(keys, keys)
        assert [(prefixes.index(x), prefixes.index(x) + prefixes.count(x)) for x in prefixes] == list(zip(low, high, strict=True))
    nothing = leakage.bounds(keys, (keys[0] + np.uint64(1), keys[1] + np.uint64(1)))
    assert all(a == b or (keys[0][a], keys[1][a]) == (k + 1, m + 1) for a, b, k, m in zip(*nothing, *keys, strict=True))


def test_leaks_with_gaps_that_a_window_would_lose():
    gone = lambda n: ["█████"] * n
    item = [f"{w}{k}x" for k, w in enumerate(WORDS)]
    assert found_in(item[:48], " ".join([*item[:22], *gone(4), *item[26:48]])) == [(48, 4)]
    assert found_in(item[:60], " ".join([*item[:28], *gone(4), *item[32:60]])) == [(60, 4)]
    assert found_in(item[:49], " ".join([*item[:24], "y" * 45, *item[25:49]])) == [(49, 1)]
    assert found_in(item[:400], " ".join("█" if k % 11 == 10 else w for k, w in enumerate(item[:400]))) == [(400, 36)]
    assert found_in(item[:40], "".join(item[:20]) + " other " + " ".join(w[:3] + " " + w[3:] for w in item[21:40])) == [(40, 1)]


def found_in(item, text):
    items = leakage.Items(TABLES[0], [0], [" ".join(item)], leakage.Rule().least_run)
    return [(n, a) for _, _, n, a, *_ in leakage.search(items, [text], leakage.Rule())]


def test_leaks_in_other_scripts_and_where_they_stand():
    draw = random.Random(4)
    word = lambda first, many: "".join(chr(first + draw.randrange(many)) for _ in range(draw.randint(2, 5)))
    for first, many in ((0x4E00, 6000), (0xAC00, 11000), (0x0431, 30), (0x0905, 50), (0x05D0, 27)):
        item = [word(first, many) for _ in range(60)]
        other = [word(first, many) for _ in range(60)]
        assert found_in(item, " ".join(other)) == [] and found_in(item, " ".join(other + item[5:45] + other)) == [(40, 0)]
    # Equal in the last places of the numbers of their letters only.
    item = [chr(0x4E00 + 3 * k) * 2 for k in range(60)]
    assert found_in(item, " ".join(chr(0x4E00 + 3 * k + 300) * 2 for k in range(60))) == []
    text = " ".join(other) + "\nGericht — LO/2011/0001 — Seite 7\n" + " ".join(ITEM[:20]) + "\nGericht — LO/2011/0001 — Seite 8\n" + " ".join(ITEM[20:41]) + " end"
    items = leakage.Items(TABLES[0], [0], [" ".join(ITEM)], leakage.Rule().least_run)
    ((_, _, words, altered, first, verbatim, begins_at, ends_at),) = leakage.search(items, [text], leakage.Rule())
    assert (words, altered, first, verbatim) == (41, 0, 0, 41) and text[begins_at:ends_at].startswith(ITEM[0] + " " + ITEM[1]) and text[begins_at:ends_at].endswith(ITEM[40])


def test_leaks_of_very_short_words():
    item = [chr(97 + k) for k in range(25)] + [f"z{chr(97 + k)}" for k in range(15)]
    items = leakage.Items(TABLES[0], [0], [" ".join(item)], leakage.Rule().least_run)
    text = " ".join("█" if k in (8, 17) else w for k, w in enumerate(item[:25]))
    assert [(n, a) for _, _, n, a, *_ in leakage.search(items, [text], leakage.Rule())] == [(25, 2)]
