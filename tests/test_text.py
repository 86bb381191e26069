"""Text functions: one table of inputs and results each."""

import pytest
from pyspark.sql import functions as F

from tindra.functions import text as X
from tindra.functions.python import fold_any, jaro_winkler, maybe_unescape


def one(spark, make, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make("x").alias("y")).collect()]


CASES = [
    (X.name_norm, ["Eternal (áður Love Odyssey)", "Ö-hæð  & Þ!", None, "äü x"], ["eternal", "ö hæð þ", "", "x"]),
    (X.company_norm, ["Mynd ehf.", "HF Ljós (sf)", "sfx slf", None], ["mynd", "ljós", "sfx", ""]),
    (X.loose_norm, ["A (b) C", None], ["a b c", ""]),
    (X.fold, ["Þórður ÆÖ", "ﬁlm É", "éa", None], ["þorður æo", "film e", "ea", ""]),
    (X.clean_entity, ["Reykjavík Films Styrkur", "Grímur Vilyrði styrkur", "Wonder (vilyrði skilað)", "Ferðastyrkur á hátíð", "Félag 3", "Styrkur", "", None, " - Ab/ "], ["Reykjavík Films", "Grímur", "Wonder", None, None, None, "", None, "Ab"]),
    (X.is_support, ["x" * 50, "y" * 40 + " festival á vegum", "festival"], [False, True, False]),
    (X.people, ["A, B & C/D og E", "vilyrði, F", None], [["A", "B", "C", "D", "E"], ["F"], []]),
    (X.dossier_names, ["Jón Jónsson og Al", None], [["jón jónsson"], []]),
    (X.money, ["1.234 kr", "kr", None], [1234, None, None]),
    (X.money_values, ["a 1.000 b 12.345.678 2024 3.5", ""], [[1000, 12345678], []]),
    (X.leading_int, ["16,116 (14,293)", "90.954.270 kr.", "x", None], [16116, 90954270, None, None]),
    (X.admissions, ["500.000", "500.001", "x"], [500000, None, None]),
    (X.percent, ["31,5 %", "7", "x"], [31.5, 7.0, None]),
    (X.plain_ligatures, ["ﬁ  ﬂ ﬀ"], ["fi fl ff"]),
    (X.strip_wikitext, ["[[A|B]] [[C]] ''d'' <br/>e"], ["B C d e"]),
    (X.iso_date, ["gefið út 05.03.2021 x", "x"], ["2021-03-05", ""]),
    (X.section, ["frettir_a", "um_x", "zzz"], ["frettir", "um", "other"]),
    (X.review_outlet, ["Mbl um Hrút: gott", "ekkert"], ["Mbl", None]),
    (X.award_word, ["vann edduna; Edda 2020 og Cannes", "x"], ["Edda", None]),
    (X.name_candidates, ["Jóhann Jóhannsson hlaut verðlaun með Ólafi Darra Ólafssyni"], [["Jóhann Jóhannsson", "Ólafi Darra Ólafssyni"]]),
    (X.headline_subjects, ["„Hross í oss“ og HROSS Í OSS á RIFF, „hross í oss“"], [["Hross í oss"]]),
    (X.tokens, ["Ég er 12 á-b", None], [["ég", "er", "12"], []]),
    (X.first_company, ["A / B", None], ["A", "—"]),
    (X.isk, [1234567, 0, None], ["1.234.567 ISK", "—", "—"]),
    (X.is_junk_row, ["* skýring", "Meðaltal", "Mynd", "x" * 61, None], [True, True, False, True, True]),
    (X.article_text, ["<p>Halló&nbsp;þú&amp;ég</p><figcaption>m</figcaption>[x]<table><tr><td>a</td><td>b</td></tr></table><p>Mynd: Jón</p>", None], ["Halló þú&ég\na | b", ""]),
    (maybe_unescape if False else X.squash, [" a  b\n"], ["a b"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_functions(spark, case):
    make, values, want = CASES[case]
    assert one(spark, make, values, "bigint" if isinstance(values[0], int) else "string") == want


def test_titles(spark):
    got = one(spark, X.clean_title, ["Eternal (áður Love Odyssey)", "X (áður: Y", "– Z –", "A (áður B", None])
    assert [(r.title, r.former) for r in got] == [("Eternal", ["Love Odyssey"]), ("X", []), ("Z", []), ("A", []), ("", [])]


def test_amounts_and_labels(spark):
    got = one(spark, X.amounts, ["65.000.000/72.800.000", "2) 1.500", "x", None])
    assert [tuple(r) for r in got] == [(65000000, 72800000), (1500, None), (None, None), (None, None)]
    assert one(spark, lambda x: X.relabel(x, {"a": "b"}), ["a", "c"]) == ["b", "c"]
    assert one(spark, lambda x: X.truthy(x, F.lit(7)), [0, 5, None], "bigint") == [7, 5, 7]
    assert one(spark, lambda x: X.slug(x, F.lit(4)), ["https://A.is/b?c", "///"]) == ["https_a_is_b_c", "4"]


def test_chunks(spark):
    text = " ".join(f"Setning númer {i} er hér." for i in range(120)) + "\n\nLok"
    got = one(spark, lambda x: X.chunks(x, 200, 30), [text, "", None, "stutt"])
    assert got[1:] == [[""], [""], ["stutt"]]
    assert all(len(c) <= 260 for c in got[0]) and got[0][0].startswith("Setning númer 0") and got[0][-1].endswith("Lok")
    for a, b in zip(got[0], got[0][1:]):
        assert b[:20].strip() and a[-20:] in b


def test_python_functions(spark):
    assert one(spark, lambda x: fold_any(F.col(x)), ["Ǻ", None]) == ["a", ""]
    assert one(spark, lambda x: maybe_unescape(F.col(x)), ["a &lt; b", "c", None]) == ["a < b", "c", None]
    assert abs(jaro_winkler("martha", "marhta") - 0.9611) < 1e-4 and jaro_winkler("", "a") == 0.0 and jaro_winkler("a", "a") == 1.0
    assert abs(jaro_winkler("dixon", "dicksonx") - 0.8133) < 1e-4
