"""Inline marks: units, problems, plain text, and that what is written is read back."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import inline

ALPHABET = st.text(st.sampled_from("ab *~<>[]$\\^(){}/u1"), max_size=12)


def test_units():
    got, bad = inline.parsed(r"a **b *c*** ~~d~~ <u>e</u> \*f [g **h**](http://x)[^1]<br/>$x+1$ costs $5<comment>hi</comment><keep id=\"k1\"/>".replace('\\"', '"'))
    assert bad == []
    assert got == [
        ("text", "a ", "", None), ("text", "b ", "bold", None), ("text", "c", "bold,italic", None), ("text", " ", "", None), ("text", "d", "strike", None), ("text", " ", "", None), ("text", "e", "underline", None),
        ("text", " *f ", "", None), ("text", "g ", "", "http://x"), ("text", "h", "bold", "http://x"), ("note", "1", "", None), ("break", "", "", None), ("math", "x+1", "", None), ("text", " costs $5", "", None), ("comment", "hi", "", None), ("keep", "k1", "", None),
    ]


def test_problems():
    assert inline.parsed("a **b")[1] == [(3, "bold is not closed")] and inline.parsed("x</u>")[1] == [(2, "</u> closes nothing")]
    assert inline.parsed("2 * 3")[0] == [("text", "2 * 3", "", None)] and inline.parsed(None) == ([], []) and inline.plain("a<br>**b**$x$") == "a\nb"


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_text_comes_back(text):
    assert inline.parsed(inline.written([("text", text, "", None)]))[0] == ([("text", text, "", None)] if text else [])


def test_columns(spark):
    row = spark.createDataFrame([("**a** b",), (None,)], "t string").select(inline.units("t").alias("u"), inline.problems("t").alias("p"), inline.plain_text(F.col("t")).alias("s")).collect()
    assert [tuple(x)[:3] for x in row[0].u] == [("text", "a", "bold"), ("text", " b", "")] and row[0].p == [] and row[0].s == "a b" and row[1].u == []
