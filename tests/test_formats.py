"""Number formats, references in formulas, and conversion reports, by examples."""

import pytest

from tessera.functions import numfmt, refs
from tessera.operators import convert


@pytest.mark.parametrize(
    ("x", "code", "want"),
    [
        (1234567.0, "#,##0", "1,234,567"), (-5.0, "0;(0)", "(5)"), (0.0, "0;-0;\"none\"", "none"), (0.5, "0%", "50%"), (12345.678, "0.00E+00", "1.23E+04"), (1.25, "# ?/?", "1 1/4"), (0.333, "?/?", "1/3"), (1500000.0, "0.0,,", "1.5"), (2.0, '0" days"', "2 days"),
        (1.0, "[>=1]\"big\";\"small\"", "big"), (0.0, "[>=1]\"big\";\"small\"", "small"), (45292.0, "yyyy-mm-dd", "2024-01-01"), (60.0, "yyyy-mm-dd", "1900-02-29"), (45292.5, "d-mmm-yy h:mm AM/PM", "1-Jan-24 12:00 PM"), (1.5, "[h]:mm:ss", "36:00:00"), (0.0208333333333333, "h:mm", "0:30"),
        (-1.0, "yyyy", "#"), (12345678901.0, "General", "12345678901"), (123456789012.0, "General", "1.23457E+11"), (0.1, "General", "0.1"), (0.00001, "General", "0.00001"), (-0.4, "0", "0"), (1.005, "0.00", "1.01"), (3.0, "#.##", "3."), (45292.0, "dddd", "Monday"),
    ],
)
def test_shown(x, code, want):
    assert numfmt.shown(x, code) == want


def test_translate_and_shift():
    t = refs.translated
    assert t("=A1+$B$2*C$3", 2, 1) == "=B3+$B$2*D$3" and t("=A1", -1, 0) == "=#REF!" and t('="A1"&Sheet2!A1', 1, 0) == '="A1"&Sheet2!A2' and t("=SUM(A1:B2)+LOG10(A1)+T[A1]", 1, 1) == "=SUM(B2:C3)+LOG10(B2)+T[A1]"
    assert t("=[book.xlsx]S!A1+A1", 1, 0) == "=[book.xlsx]S!A1+A2"
    s = refs.shifted
    assert s("=A10+S!A10+A9", True, "S", (1, 6), 10, 2) == "=A12+S!A12+A9" and s("=A10+'S'!A10", False, "S", (1, 6), 10, 2) == "=A10+'S'!A12"
    assert s("=A10+SUM(A5:A20)+SUM(A10:A11)", True, "S", (1, 6), 10, -2) == "=#REF!+SUM(A5:A18)+SUM(#REF!)" and s("=H10", True, "S", (1, 6), 10, 2) == "=H10"


def test_reports(spark):
    props = spark.createDataFrame([(1, n, "shade", "x") for n in range(12)] + [(1, 3, "bold", "on"), (2, 1, "bold", "on")], "doc_id long, line int, key string, value string")
    can = spark.createDataFrame([("bold",)], "key string")
    keeps = spark.createDataFrame([(1, 5, "chart"), (1, 5, "chart")], "doc_id long, line int, kind string")
    report = convert.loss_report(props, can, keeps)
    assert sorted((r.what, r.n, r.places) for r in report.collect()) == [("placeholder chart", 2, "5"), ("property shade", 12, "0,1,2,3,4,5,6,7")]
    assert sorted(tuple(r) for r in convert.lossless(report, props.select("doc_id").distinct()).collect()) == [(1, False), (2, True)]
    fates = convert.style_fates(spark.createDataFrame([(1, "Body"), (1, "Mine")], "doc_id long, name string"), spark.createDataFrame([("body",), ("BODY",)], "name string"))
    assert sorted(r.fate for r in fates.collect()) == ["created", "replaced"]


def test_columns_of_formats_and_formulas(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.5, "0%", "=A1"), (None, "0", None), (1.0, None, "=$A$1")], "x double, code string, f string")
    got = df.select(numfmt.display("x", "code").alias("s"), refs.translate("f", F.lit(1), F.lit(1)).alias("t")).collect()
    assert [tuple(r) for r in got] == [("50%", "=B2"), (None, None), ("1", "=$A$1")]
