"""Recalculation, readings, checks, stores, grammars, drawings and package parts, by small examples."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import chars, values
from tessera.operators import checks, drawing, grammar, lookups, recalc, store, tables, views, windows
from tessera.sources import props

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_training_operators(tmp_path):
    """In a copy without both folders, the entry point gives all other queries; the pipeline's file may stay or go."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "tessera"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif src.exists():
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [x for x in q if x.startswith('op') or x == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def cells_of(spark, rows):
    return spark.createDataFrame([("s", r, c, v if isinstance(v, float) else None, v if isinstance(v, str) and not v.startswith("#") else None, v if isinstance(v, str) and v.startswith("#") else None) for (r, c), v in rows.items()], "sheet string, row int, col int, num double, text string, err string")


def test_recompute_by_rounds_with_circles_errors_and_texts(spark):
    texts = {1: "=A1+1", 2: "=B1*2", 3: "=B2/0", 4: "=SUM(B1:B3)", 5: "=C6", 6: "=B6", 7: "=A2&\"x\"", 8: "=IFERROR(B3,7)", 9: "=NOSUCH(A1)", 10: "=AVERAGE(A1:A3)", 11: "=Other!A1+1"}
    formulas = spark.createDataFrame([(k, "s", k, 2, t) for k, t in texts.items()] + [(99, "s", 6, 3, "=B5")], "id long, sheet string, row int, col int, formula string").withColumn("row", F.when(F.col("id") == 6, 6).otherwise(F.col("row")))
    cells = cells_of(spark, {(1, 1): 4.0, (2, 1): "t", (3, 1): 8.0, (1, 2): 5.0, (2, 2): 9.0})
    changed = spark.createDataFrame([("s", 1, 1), ("s", 2, 1), ("s", 6, 3), ("s", 6, 2)], "sheet string, row int, col int")
    got = {r.id: r for r in recalc.recompute(formulas, cells, changed).collect()}
    assert (got[1].num, got[1].state) == (5.0, "same") and (got[2].num, got[2].state) == (10.0, "written")
    assert got[3].err == "#DIV/0!" and got[4].err == "#DIV/0!" and got[8].num == 7.0 and got[10].num == 6.0
    assert {got[k].why for k in (5, 6, 99)} == {"circular"}
    assert got[7].why == "reads text" and got[9].why.startswith("unknown function") and 11 not in got
    assert recalc.recompute(formulas, cells, changed.limit(0)).count() == 0


def test_short_and_file_forms():
    for short, file in (("=[@net]*2", "=T[[#This Row],[net]]*2"), ('="[@net]"&[@[a b]]', '="[@net]"&T[[#This Row],[a b]]'), ("=SUM([@[a]:[c d]])", "=SUM(T[[#This Row],[a]:[c d]])")):
        assert recalc.file_form(short, "T") == file and recalc.short_form(file, "t") == short


def test_changes_follow_a_shift(spark):
    from tessera.functions import a1

    rows = spark.createDataFrame([("s", 1, 5, 2, 6), ("s", 1, 10, 1, 12)], "sheet string, c0 int, r0 int, c1 int, r1 int")
    got = recalc.follow(rows, *a1.shift_delete(F.col("r"), (1, 3), 10, 12)).collect()
    assert [tuple(r) for r in got] == [("s", 1, 5, 2, 6)]
    with pytest.raises(Exception, match="tears"):
        recalc.follow(rows, *a1.shift_insert(F.col("r"), (2, 3), 1, 2)).collect()


def test_readings_refuse_what_is_not_there(spark):
    book = views.Book(spark.createDataFrame([(1, "a", "work"), (2, "c", "chart")], "sheet_no int, sheet string, kind string"), spark.createDataFrame([], "sheet string, name string, c0 int, r0 int, c1 int, r1 int, header boolean, totals boolean"), spark.createDataFrame([], "table string, ord int, name string, type string, format string, formula string"), spark.createDataFrame([("a", 3, 2, "x|y")], "sheet string, row int, col int, shown string"))
    assert [tuple(r) for r in views.read(book=book).collect()] == [(3, "x|y")]
    head = views.window_text(spark, '<data sheet="a" range="B3">', views.read(book=book, sheet="a", range="B3")).orderBy("part", "at").collect()
    assert [r.content for r in head] == ['<data sheet="a" range="B3">', "| row | B |", "|---|---|", "| 3 | x\\|y |", "</data>"]
    for bad in ({"range": "A1"}, {"range": "b!A1"}, {"range": "c!A1"}, {"range": "a!A1:A501"}, {"range": "a!A1:BZ1"}, {"table": "t"}, {"rows": "1:2"}, {"sheet": "a"}, {"table": "t", "range": "a!A1"}, {"lines": "1", "section": "x"}):
        with pytest.raises(windows.WindowError):
            views.read(book=book, **bad)


def test_slides_after_front_matter(spark):
    docs = spark.createDataFrame([(1, "---\ntitle: x\n---\n# One\na\n---\n# Two\n<shape id=\"s1\" x=\"3\"/>\ntext\nmore\n"), (2, None)], "doc_id int, text string")
    assert [(r.slide, r.content) for r in views.slide_window(docs, 2, 2).orderBy("line").collect()] == [(2, "# Two"), (2, '<shape id="s1" x="3"/>'), (2, "text"), (2, "more")]
    model = grammar.presentation(docs)
    got = [(r.slide, r.kind, r.attrs, r.text) for r in model.orderBy("slide", "ord").collect()]
    assert got == [(1, "head", {}, "One"), (1, "body", {}, "a"), (2, "head", {}, "Two"), (2, "shape", {"id": "s1", "x": "3"}, "text\nmore")]
    again = grammar.presentation(grammar.presentation_text(model))
    assert sorted(map(str, again.drop("ord").collect())) == sorted(map(str, model.drop("ord").collect()))


def test_canonical_form(spark):
    docs = spark.createDataFrame([(1, "#  Head  \npara \nline\n\n\n* a\n+ b\n3) c\n|x|y \\| z|\n|-|-|\n---  "), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in grammar.canonical(docs).collect()}
    assert got[1] == "# Head\n\npara\nline\n\n- a\n- b\n3. c\n\n| x | y \\| z |\n| - | - |\n\n---\n" and got[2] == got[3] == ""


def test_text_diagnostics(spark):
    docs = spark.createDataFrame([(1, "ok\n####### deep\na\x01b\n<ins>x\n</del>\n```\ncode"), (2, "<ins>a</ins>\n# fine")], "doc_id int, text string")
    assert sorted((r.doc_id, r.line, r.col, r.code) for r in checks.text_diagnostics(docs).collect()) == [(1, 2, 1, "heading"), (1, 3, 2, "control"), (1, 4, 1, "not closed"), (1, 5, 1, "closes nothing"), (1, 6, 1, "fence")]


def test_parts_that_go_with_an_object(spark):
    edges = spark.createDataFrame([("root", "a"), ("root", "b"), ("a", "x"), ("b", "x"), ("a", "y"), ("y", "a")], "src string, dst string")
    parts = spark.createDataFrame([(p,) for p in ("root", "a", "b", "x", "y")], "name string")
    assert sorted(r.name for r in checks.dropped_parts(parts, edges, "root", "a").collect()) == ["a", "y"]


def test_long_chains_and_circles_are_followed(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(41)] + [(3, 0), (5, 5), (None, 1)], "src int, dst int")
    got = {r.node: r.depth for r in lookups.reachable(spark, edges, spark.createDataFrame([(0,), (None,)], "node int")).collect()}
    assert got == {i: i for i in range(42)}


def test_overlaps_of_all_sizes(spark):
    import numpy as np

    draw = np.random.default_rng(6)
    rows = []
    for i in range(300):
        r0, c0 = int(draw.integers(1, 900)), int(draw.integers(1, 120))
        rows.append((f"s{i % 2}", i, r0, c0, r0 + int(2 ** draw.integers(0, 10)) - 1, c0 + int(2 ** draw.integers(0, 7)) - 1))
    df = spark.createDataFrame(rows, "sheet string, id int, r0 int, c0 int, r1 int, c1 int")
    got = sorted((r.a, r.b) for r in lookups.overlaps(df.select("sheet", "id", F.struct("c0", "r0", "c1", "r1").alias("r"))).collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5])
    assert got == want and len(got) == len(set(got))
    assert lookups.overlaps(df.limit(0).select("sheet", "id", F.struct("c0", "r0", "c1", "r1").alias("r"))).count() == 0


def test_long_vectors_are_merged(spark):
    bands = spark.createDataFrame([(float(k * 3), f"v{k}") for k in range(500)], "k double, v string")
    left = spark.createDataFrame([(float(x) / 2,) for x in range(-4, 3200, 7)] + [(None,)], "x double")
    want = {r.x: None if r.x is None or r.x < 0 else f"v{min(499, int(r.x // 3))}" for r in left.collect()}
    for limit in (10_000, 100):
        assert {r.x: r.found for r in lookups.vlookup_approximate(left, bands, "x", "k", "v", limit).collect()} == want


def test_store_checks_its_writes(spark, tmp_path):
    s = store.RevisionStore(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("A b.md", "one\ntwo\n"), ("a-b.docx", "x"), ("pic.gif", "y")], "name string, text string")
    got = {r["name"]: (r.doc_id, r.rev) for r in s.open(files).collect()}
    assert got == {"A b.md": ("a-b", 1), "a-b.docx": ("a-b-2", 1), "pic.gif": ("pic", None)}
    write = lambda *rows: s.commit(spark.createDataFrame(rows, "doc_id string, base long, op string, text string")).collect()
    assert [(r.state, r.rev) for r in write(("a-b", 1, "reimport", "one\ntwo\nthree\n"))] == [("committed", 2)]
    assert [(r.state, r.rev, r.text) for r in write(("a-b", 1, "edit", "ONE\ntwo\n"))] == [("rebased", 3, "ONE\ntwo\nthree\n")]
    assert {(r.doc_id, r.base, r.state) for r in write(("a-b", 1, "edit", "late"), ("a-b", 3, "ops", "?"), ("no", 1, "edit", "z"), ("a-b-2", 1, "edit", "x"))} == {("a-b", 1, "stale"), ("a-b", 3, "stale"), ("no", 1, "unknown"), ("a-b-2", 1, "unchanged")}
    seen = len(s.records())
    row = s.log().limit(1)
    s.append(row, seen)
    with pytest.raises(store.Stale):
        s.append(row, seen)
    diff = store.diff_revisions(s.log(), spark.createDataFrame([("a-b", 1, 2)], "doc_id string, a long, b long")).first().diff
    assert diff.endswith(" two\n+three\n")


def test_books_fill_formulas_down_and_keep_to_a_budget(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, None)], "pos long, a double, b double")
    book = tables.Book({"T": (df, {"a": "number", "b": "number"})}).apply([{"op": "fill_formula", "table": "T", "column": "b", "formula": "=[@a]*10"}, {"op": "append_rows", "table": "t", "rows": [{"a": 4}]}])
    assert [tuple(r) for r in book.tables["T"][0].orderBy("pos").select("pos", "a", "b").collect()] == [(1, 2.0, 20.0), (2, 3.0, 30.0), (3, 4.0, 40.0)]
    for ops in ([{"op": "append_rows", "table": "T", "rows": [{"b": 1}]}], [{"op": "append_rows", "table": "T", "rows": [{"a": 1}] * 51}], [{"op": "set", "table": "T", "range": [0, 1], "values": {"a": 1}}]):
        with pytest.raises(tables.Refused):
            book.apply(ops)


def test_borders_and_outlines(spark):
    grid = spark.range(9).select((F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"), F.create_map(F.lit("bold"), F.lit("true")).alias("style"))
    got = {(r.row, r.col): r.style for r in tables.format_range(grid, (1, 0, 2, 1), {"outline": "thin", "fill": "red"}).collect()}
    assert got[(2, 2)] == {"bold": "true"} and got[(0, 1)] == {"bold": "true", "fill": "red", "border-top": "thin", "border-left": "thin"}
    assert got[(1, 2)] == {"bold": "true", "fill": "red", "border-bottom": "thin", "border-right": "thin"}
    assert len(tables.format_range(grid, (0, 0, 0, 0), {"border": "x"}).filter("row = 0 and col = 0").first().style) == 5


def test_sorting_a_whole_table_by_ranges(spark):
    df = spark.range(1000).select((F.col("id") + 1).alias("pos"), values.cell(F.col("id") * 7919 % 1000).alias("c"))
    got = tables.sort_rows(df, [("c", False)]).select("pos", "c.num").collect()
    assert sorted((r.pos, int(r.num)) for r in got) == [(i + 1, i) for i in range(1000)]


def test_unusual_characters_are_named(spark):
    text = "a b\tc\U000e0001﷐\U0001fffe\nd\x7f"
    row = spark.createDataFrame([(text,)], "t string").select(chars.shown(F.col("t")).alias("s"), F.size(chars.unusual(F.col("t"))).alias("n")).first()
    assert row.n == 7 and row.s == "a⟨U+2007 FIGURE SPACE⟩b⟨U+0009 CHARACTER TABULATION⟩c⟨U+E000 private use⟩⟨U+E0001 tag⟩⟨U+FDD0 noncharacter⟩⟨U+1FFFE noncharacter⟩\nd⟨U+007F control⟩"


def test_occurrences_overlap(spark):
    row = spark.createDataFrame([("anana ana", "xyz", None, "")], "a string, b string, c string, d string").select(*[values.occurrences(F.col(c), "ana").alias(c) for c in "abcd"]).first()
    assert tuple(row) == ([0, 2, 6], [], None, [])


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_runs_numbering_and_comments(spark):
    doc = f"""<w:document {W}><w:body><w:p><w:r><w:rPr><w:b/><w:sz w:val="21"/><w:color w:val="ff0000"/></w:rPr><w:t>a</w:t></w:r><w:ins><w:r><w:t>b</w:t></w:r></w:ins><w:del><w:r><w:delText>c</w:delText></w:r></w:del>
      <w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:hyperlink><w:r><w:t>l</w:t></w:r></w:hyperlink><w:sdt><w:sdtContent><w:r><w:t>s</w:t></w:r></w:sdtContent></w:sdt>
      <w:commentRangeStart w:id="1"/><w:r><w:commentReference w:id="1"/></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p></w:body></w:document>""".encode()
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerRoman"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="1"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>'.encode()
    comments = f'<w:comments {W}><w:comment w:id="1" w:author="me"><w:p><w:r><w:t>hm</w:t></w:r></w:p></w:comment><w:comment w:id="9"><w:p/></w:comment></w:comments>'.encode()
    parts = spark.createDataFrame([(doc, numbering, comments)], "d binary, n binary, c binary")
    runs = parts.select(F.explode(props.docx_runs("d")).alias("r")).select("r.*").collect()
    assert [(r.text, r.role) for r in runs] == [("a", "text"), ("b", "inserted"), ("c", "deleted"), ("", "field"), ("PAGE", "field"), ("", "field"), ("l", "link"), ("s", "control"), ("", "comment"), ("", "note")]
    assert runs[0].props == {"bold": "true", "size": "10.5pt", "color": "#FF0000"}
    import xml.etree.ElementTree as ET

    assert props.run_props(ET.fromstring(f"<w:rPr {W}>{props.props_xml(runs[0].props)}</w:rPr>")) == runs[0].props
    assert [tuple(r.x) for r in parts.select(F.explode(props.docx_numbering("n")).alias("x")).collect()] == [(3, 0, "bullet", 1), (3, 1, "decimal", 5)]
    marks = parts.select(F.explode(F.concat(props.docx_comments("c"), props.docx_comments("d"))).alias("m")).select(F.lit("p").alias("path"), "m.*")
    assert {(r.id, r.error) for r in props.comment_balloons(marks).collect()} == {("1", "open"), ("9", "orphan")}
    assert parts.select(props.xml_query("n", "num/abstractNumId/@val").alias("x")).first().x == ["0"]


def test_styles_shapes_and_raw_rows(spark):
    styles = b'<s xmlns="x"><numFmts><numFmt numFmtId="164" formatCode="0.0%"/></numFmts><fonts><font/><font><b/><sz val="12"/><color rgb="FF00FF00"/></font></fonts><fills><fill/><fill><patternFill><fgColor rgb="FFAABBCC"/></patternFill></fill></fills><cellXfs><xf numFmtId="0"/><xf numFmtId="164" fontId="1" fillId="1"><alignment horizontal="center"/></xf></cellXfs></s>'
    slide = b'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree><p:grpSp><p:nvGrpSpPr><p:cNvPr id="2" name="g"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="10" y="20"/><a:ext cx="100" cy="50"/><a:chOff x="0" y="0"/><a:chExt cx="50" cy="50"/></a:xfrm></p:grpSpPr><p:sp><p:nvSpPr><p:cNvPr id="3" name="s"/><p:nvPr><p:ph type="title" idx="1"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="5" y="5"/><a:ext cx="10" cy="10"/></a:xfrm><a:solidFill><a:srgbClr val="ff00aa"/></a:solidFill></p:spPr><p:txBody><a:p><a:r><a:t>hi</a:t></a:r></a:p></p:txBody></p:sp></p:grpSp></p:spTree></p:cSld></p:sld>'
    sheet = b'<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="7"><c r="B7" s="2"><f>A1+1</f><v>3</v></c><c r="C7"/></row><row r="9"/></sheetData>'
    df = spark.createDataFrame([(styles, slide, sheet)], "a binary, b binary, c binary")
    assert [(r.x.numfmt, r.x.code, r.x.props) for r in df.select(F.explode(props.xlsx_styles("a")).alias("x")).collect()][1] == (164, "0.0%", {"bold": "true", "size": "12pt", "color": "#00FF00", "fill": "#AABBCC", "align": "center"})
    shapes = df.select(F.explode(props.pptx_shapes("b")).alias("x")).select(F.lit(1).alias("doc_id"), F.lit(1).alias("slide"), "x.*")
    placed = {r.id: tuple(r)[4:] for r in drawing.frames(shapes).collect()}
    assert placed == {"2": (10, 20, 100, 50), "3": (20, 25, 20, 10)} and shapes.filter("id = '3'").select("type", "fill", "text").first() == ("title", "#FF00AA", "hi")
    rows = df.select(F.explode(F.filter(props.raw_rows(F.col("c")), lambda x: props.may_hold(x["xml"], ("<f",)))).alias("r"))
    assert [(r.row, [tuple(c) for c in r.cells]) for r in rows.select("r.row", props.row_cells(F.col("r.xml")).alias("cells")).collect()] == [(7, [(2, None, 2, "A1+1", "3"), (3, None, None, None, None)])]
    entries = spark.createDataFrame([(1, 0, "part", "a.bin", bytes(range(256)))], "doc_id int, seq long, kind string, name string, data binary")
    assert props.remainder_entries(props.remainder_json(entries)).collect() == entries.collect()


def test_series_and_slides(spark):
    series = spark.createDataFrame([("c", 1, "Data!$A$2:$A$9"), ("c", 2, "Other!A5")], "chart string, seq int, formula string")
    assert [r.formula for r in drawing.series_shifted(series, "data", (1, 3), 5, 2).orderBy("seq").collect()] == ["Data!$A$2:$A$11", "Other!A5"]
    slides = spark.createDataFrame([(1, f"s{k}", k) for k in range(1, 6)], "doc_id int, id string, pos int")
    moves = spark.createDataFrame([(1, "s2", "delete", None), (1, "s4", "delete", None), (1, "s5", "move", 1), (1, "new", "add", 3)], "doc_id int, id string, op string, to int")
    got = drawing.reordered(slides, moves, spark.createDataFrame([(1, "s4")], "doc_id int, target string")).orderBy("pos").collect()
    assert [(r.id, r.error) for r in got] == [("s5", None), ("s1", None), ("new", None), ("s3", None), ("s4", "a link refers to it")]
