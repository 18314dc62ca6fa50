from pyspark.sql import functions as F

from tessera.functions.text import not_blank, strip


def column(spark, values, use):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(use(F.col("v"))).collect()]


def test_canonical_forms(spark, ns):
    given = ["res:aB1", " http://A.Example/items/aB1/ ", "https://a.example/items/aB1", "\thttp://A.EXAMPLE/items/aB1//\n", "unknown", None, "", "zz:1", "http://A.example"]
    want = ["http://a.example/items/aB1"] * 4 + ["unknown", None, "", "zz:1", "http://a.example"]
    assert column(spark, given, ns.canonical) == want


def test_alias_and_expand_are_inverse(spark, ns):
    assert column(spark, ["http://x.example/ns#ab", "http://x.example/other/ab", None], ns.alias) == ["ex:ab", "http://x.example/other/ab", None]
    assert column(spark, ["ex:ab", "yy:ab", "ab", None], ns.expand) == ["http://x.example/ns#ab", "yy:ab", "ab", None]


def test_white_space_is_unicode(spark):
    assert column(spark, ["　 a b \t", None, "  "], strip) == ["a b", None, ""]
    assert column(spark, ["　", "", None, " x"], not_blank) == [False, False, False, True]
