"""Units, matches, entries and package writers on small rows made by hand."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import units
from tessera.operators import entries, matching
from tessera.sources import office, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_lengths_and_angles(spark):
    assert [one(spark, units.length_text(F.lit(h))) for h in (34, 2000, -5896, 50, 5, 0, 120)] == ["0.34pt", "20pt", "-58.96pt", "0.5pt", "0.05pt", "0pt", "1.2pt"]
    assert [one(spark, units.parse_length(F.lit(t))) for t in ("12pt", " 0.345 pt", "7", ".5pt", "1.", "-1pt", "x", "10000000")] == [1200, 35, 700, None, None, None, None, None]
    assert one(spark, units.parse_length(F.lit("-1pt"), True)) == -100
    assert [one(spark, units.kept_emu(F.lit(12_701), F.lit(w))) for w in (12_700, 25_400)] == [12_701, 25_400]
    assert one(spark, units.same_turn(F.lit(-5_400_000), F.lit(16_200_000)))


def test_colours(spark):
    got = [one(spark, units.colour(F.lit(t))) for t in ("#1f4E79/50%", "accent1+40%", "tx1", "#12345", "accent1+0%", "bg1/100%")]
    assert [tuple(c) if c else None for c in got] == [("#1F4E79", 0, 50), ("accent1", 40, None), ("tx1", 0, None), None, None, ("bg1", 0, None)]
    assert [units.tinted_of("#808080", t) for t in (0.0, 1.0, -1.0)] == ["#808080", "#FFFFFF", "#000000"]


def test_attributes(spark):
    assert [tuple(a) for a in one(spark, units.attributes(F.lit('a=1 b="x y &quot;z&quot; &lt;" flag c=\'q\'')))] == [("a", "1"), ("b", 'x y "z" <'), ("flag", None), ("c", "q")]
    assert one(spark, units.attributes(F.lit("a=1 =2"))) is None and one(spark, units.attributes(F.lit(" "))) == []
    for v in ("plain", "", 'a "b" <c> & d', "x:y"):
        assert one(spark, units.attributes(F.concat(F.lit("k="), units.quoted(F.lit(v)))))[0].value == v


def test_scripts_lines_and_escapes(spark):
    assert [one(spark, units.script(F.lit(t))) for t in ("abc é", "가 b", "漢字", "", "漢 가")] == ["latin", "hangul", "cjk", "latin", "hangul"]
    assert one(spark, units.script_runs(F.lit("ab漢字c"))) == ["ab", "漢字", "c"]
    assert [one(spark, units.line_of(F.lit("é\nb\nc"), F.lit(n))) for n in (0, 1, 2, 3, 5)] == [1, 1, 1, 2, 3]
    assert units.xml_plain("&lt;&#65;&#x42;&amp;lt;&nbsp;&#xD800;") == "<AB&lt;&nbsp;&#xD800;"
    assert units.excel_plain("_xD83D__xDE00__x000D__xD83D_") == "😀\r�"
    for t in ("a\x01b", "_x0041_", "_x_", "plain"):
        assert units.excel_plain(units.excel_escaped(t)) == t
    assert one(spark, units.xml_unescape(F.lit("&gt;"))) == ">" and one(spark, units.excel_unescape(F.lit(None).cast("string"))) is None


def test_pictures(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (3).to_bytes(4, "big") + (5).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x07\0\x09\x01\0\0\0"
    data = spark.createDataFrame([(1, png), (2, jpeg), (3, b"GIF89a\x01\0\x02\0"), (4, b"no"), (5, None), (6, b"<svg/>")], "id int, data binary")
    assert [tuple(r.p) for r in data.select("id", units.picture("data").alias("p")).orderBy("id").collect()] == [("png", 3, 5), ("jpeg", 9, 7), ("gif", 1, 2), (None, None, None), (None, None, None), ("svg", None, None)]


def test_touched_areas(spark):
    areas = spark.createDataFrame([(1, "s", 1, 1, 1, 1), (2, "s", 1, 1000, 3, 3000), (3, "s", 5, 1, 9, 5000), (4, "t", 1, 1, 9, 9)], "id int, sheet string, c0 int, r0 int, c1 int, r1 int")
    cells = spark.createDataFrame([("s", 1, 1), ("s", 2048, 2), ("s", 2048, 2)], "sheet string, row int, col int")
    assert rows(matching.touched(areas, cells), "id") == [(1,), (2,)]
    assert matching.touched(areas, cells.limit(0)).count() == 0


def test_shared_formulas(spark):
    cells = spark.createDataFrame([("s", 1, 1, "A2+$B$1", 0), ("s", 2, 1, None, 0), ("s", 3, 3, "1+1", None), ("s", 4, 1, None, 7), ("s", 5, 1, "A1", 8), ("s", 6, 1, "A2", 8)], "sheet string, row int, col int, formula string, si int")
    assert rows(matching.unshared(cells), "row", "formula", "error") == [(1, "A2+$B$1", None), (2, "A3+$B$1", None), (3, "1+1", None), (4, None, "no master"), (5, "A1", "two masters"), (6, "A2", "two masters")]


def test_placeholders_and_slots(spark):
    uses = spark.createDataFrame([(1, "k1"), (1, "k1"), (1, "k2"), (1, "k9")], "doc_id int, id string")
    registry = spark.createDataFrame([(1, "k1"), (1, "k2")], "doc_id int, id string")
    assert rows(matching.placeholder_errors(uses, registry), "id", "error") == [("k1", "repeated"), ("k9", "unknown")]
    layout = spark.createDataFrame([("L", "a", "title", 0), ("L", "b", "body", 1), ("L", "c", "body", 2)], "layout string, slot string, type string, idx int")
    shapes = spark.createDataFrame([("L", 1, "body", 2), ("L", 2, "pic", 1), ("L", 3, "body", 9), ("L", 4, "pic", 9)], "layout string, shape int, type string, idx int")
    assert rows(matching.slots(shapes, layout), "shape", "slot") == [(1, "c"), (2, "b"), (3, "b"), (4, None)]


def test_packages_compare(spark):
    parts = lambda *p: spark.createDataFrame([*p], "name string, data binary")
    old = parts(("a.xml", b'<a x="1" y="2"/>'), ("b.bin", b"1"), ("c.xml", b"<c/>"))
    new = parts(("a.xml", b'<a y="2"  x="1"></a>'), ("b.bin", b"2"), ("d.xml", b"<d/>"))
    assert rows(matching.package_diff(old, new), "name", "how") == [("b.bin", "changed"), ("c.xml", "removed"), ("d.xml", "added")]


def test_keep_ids(spark):
    got = rows(entries.keep_ids(spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y"), (2, 1, "x")], "doc_id int, seq int, fp string")), "doc_id", "seq", "keep_id")
    x, y = entries.short_id("x"), entries.short_id("y")
    assert x != y and len(x) == 5 and [r[2] for r in got] == [x, x + "-2", y, x]


@pytest.mark.parametrize(
    ("old", "new", "span", "want"),
    [
        ("a b c", "a X b c", (2, 3), ("placed", 4, 5)),
        ("a b c", "a c", (2, 3), ("removed", None, None)),
        ("a b c", "a b c d", (0, 5), ("placed", 0, 5)),
        ("a b c", "z a b c", (0, 5), ("placed", 2, 7)),
        ("a b c", "a b c", (2, 2), ("placed", 2, 2)),
        ("", "new", (0, 0), ("placed", 3, 3)),
    ],
)
def test_placement(spark, old, new, span, want):
    e = spark.createDataFrame([(1, 1, *span)], "doc_id int, id int, start int, end int")
    v = spark.createDataFrame([(1, old, new)], "doc_id int, old string, new string")
    assert rows(entries.placed(e, v), "status", "start", "end") == [want]


def test_place_entries_takes_every_document(spark, tmp_path):
    from tessera.queries import QUERIES

    texts = [None, "", "short", "one two " * 20, "word and word " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in enumerate(texts):
        n, by = len(t or ""), len("Again: ")
        want += [(i, 1, "placed", by, by + min(100, n)), (i, 2, "placed", by + max(0, n - 100), by + n)]
    assert rows(QUERIES["place_entries"](spark, str(tmp_path)), "doc_id", "id", "status", "start", "end") == sorted(want, key=repr)


def test_trims_and_near_misses(spark):
    assert entries.trim_of("the big house", "the small house") == (4, "big", "small")
    assert entries.trim_of("a  b", "a b") == (2, " ", "") and entries.trim_of(None, "x") == (0, "", "x") and entries.trim_of("a a", "a") == (1, " a", "")
    text = "one\ntwo three​ four\nfive"
    assert [entries.near_miss_of(text, p) for p in ("two three four", "two three", "twothree", "six", "", "three four\nfive")] == [2, None, 2, None, None, 2]
    assert tuple(one(spark, entries.trimmed(F.lit("x y"), F.lit("x z")))) == (2, "y", "z") and one(spark, entries.near_miss(F.lit("a b"), F.lit("a b"))) == 1


def test_tracked_changes(spark):
    v = spark.createDataFrame([(1, "a b c", "a x c"), (2, "a", "a"), (3, None, "n")], "doc_id int, old string, new string")
    assert rows(entries.tracked(v, "me"), "doc_id", "op", "at", "text", "author") == [(1, "del", 2, "b", "me"), (1, "ins", 2, "x", "me"), (3, "ins", 0, "n", "me")]


TEXTS = [(1, "Title"), (0, "A plain one & <more>"), (0, "two\nlines\tand tabs"), (0, "")]


@pytest.mark.parametrize("kind", ["docx", "hwpx"])
def test_documents_come_back(kind):
    data = writers.document(TEXTS, kind)
    assert [b["text"] for b in office.document_blocks(data)] == [t for _, t in TEXTS]
    assert writers.edited(data, {}) == data and writers.edited(data, {0: "Title"}) == data
    new = writers.edited(data, {0: "New title", 1: "A plain <two> & ", 2: "two\nmore lines\tand tabs"})
    assert [b["text"] for b in office.document_blocks(new)] == ["New title", "A plain <two> & ", "two\nmore lines\tand tabs", ""]
    same = {n: d for n, d in office.unzip(data)}
    assert [n for n, d in office.unzip(new) if d != same[n]] == writers.text_parts(list(same))
    for bad in ({9: "x"}, {2: "two lines\tand tabs"}, {1: "a\nb"}, {3: "text"}):
        with pytest.raises(ValueError):
            writers.edited(data, bad)
    other = "hwpx" if kind == "docx" else "docx"
    moved, lost = writers.converted(data, other)
    assert [b["text"] for b in office.document_blocks(moved)] == [t for _, t in TEXTS] and lost == []


def test_runs_keep_their_marks():
    part = b'<w:document xmlns:w="w"><w:p><w:pPr><w:tabs><w:tab w:val="1"/></w:tabs></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>bold </w:t></w:r><w:r><w:t a=">">plain</w:t></w:r><w:r><w:t/></w:r></w:p></w:document>'
    assert writers.edited_part(part, {0: "bold pain"}) == part.replace(b">plain<", b">pain<")
    assert writers.edited_part(part, {0: "bald plain"}) == part.replace(b"<w:t>bold ", b'<w:t xml:space="preserve">bald ')
    assert writers.edited_part(part, {0: "box"}) == part.replace(b"<w:t>bold ", b"<w:t>box").replace(b">plain<", b"><")
    mixed = b'<s xmlns:hp="h"><hp:p><hp:run><hp:t>a<hp:tab/>b<hp:lineBreak/></hp:t></hp:run></hp:p></s>'
    assert writers.edited_part(mixed, {0: "a\tcb\n"}) == mixed.replace(b"/>b<", b"/>cb<") and writers.edited_part(mixed, {0: "a\tb\nend"}) == mixed.replace(b"<hp:lineBreak/>", b"<hp:lineBreak/>end")


def test_edits_by_file(spark):
    files = spark.createDataFrame([("a", writers.document(TEXTS)), ("b", writers.document(TEXTS)), ("c", b"no zip")], "path string, content binary")
    edits = spark.createDataFrame([("a", 0, "Other"), ("b", 7, "x"), ("c", 0, "y")], "path string, block int, text string")
    got = {r.path: r for r in writers.write_edits(files, edits).collect()}
    assert next(office.document_blocks(bytes(got["a"].content)))["text"] == "Other" and "not there" in got["b"].error and got["b"].content is None and "BadZipFile" in got["c"].error
    back = {r.path: r for r in writers.convert(files, "hwpx").collect()}
    assert back["a"].error is None and back["c"].content is None


def test_parts_go_with_their_types():
    data = writers.replaced(writers.document(TEXTS), {"word/styles.xml": None, "x/new.bin": b"1"})
    parts = dict(office.unzip(data))
    assert "word/styles.xml" not in parts and b"styles.xml" not in parts["[Content_Types].xml"] and parts["x/new.bin"] == b"1"
    assert zipfile.is_zipfile(__import__("io").BytesIO(data))
