"""Operators on small rows made by hand: tables, formulas, windows, merges, packages and streams."""

import difflib

import pytest
from pyspark.sql import functions as F

from tessera.functions import a1, chars, values
from tessera.operators import blocks, diffs, lookups, revisions, safety, tables, windows
from tessera.plans import formula
from tessera.sources import office


def one(spark, column, kind="long"):
    return spark.range(1).select(column.alias("x")).first().x


def test_letters_and_ranges(spark):
    got = [one(spark, a1.print_range(a1.parse_range(F.lit(t)))) for t in ("$B$2", "c3:a1", "XFD1048576", "XFE1", "A0", "A1:")]
    assert got == ["B2", "A1:C3", "XFD1048576", None, None, None]
    assert one(spark, a1.col_letters(F.lit(0))) is None and one(spark, a1.col_index(F.lit("aa"))) == 27


def test_shifts(spark):
    def shifted(text, shift):
        df = spark.createDataFrame([(text,)], "t string").select(a1.parse_range(F.col("t")).alias("r"))
        moved, to = shift(F.col("r"))
        return list(df.select(moved.alias("m"), to.alias("to")).select("m", a1.print_range(F.col("to"))).first())

    insert = lambda t: shifted(t, lambda r: a1.shift_insert(r, (1, 6), 10, 2))
    delete = lambda t: shifted(t, lambda r: a1.shift_delete(r, (1, 6), 10, 12))
    assert insert("A1:B9") == ["same", "A1:B9"] and insert("A10:B12") == ["to", "A12:B14"] and insert("A5:B12") == ["to", "A5:B14"] and insert("A5:G12")[0] == "split" and insert("H1:I20") == ["same", "H1:I20"]
    assert delete("A10:B12")[0] == "gone" and delete("A9:B13") == ["to", "A9:B10"] and delete("A11:B20") == ["to", "A10:B17"] and delete("A1:B11") == ["to", "A1:B9"] and delete("F11:G11")[0] == "split"


def test_dates(spark):
    assert [one(spark, values.date_text(F.lit(float(n)))) for n in (1, 59, 60, 61, 2958465, 2958466)] == ["1900-01-01", "1900-02-28", "1900-02-29", "1900-03-01", "9999-12-31", None]
    assert [one(spark, values.serial_of(F.lit(d).cast("date"))) for d in ("1900-01-01", "1900-02-28", "1900-03-01")] == [1, 59, 61]
    assert one(spark, values.date_text(F.lit(0.0), True)) == "1904-01-01"
    assert [one(spark, values.iso_date(F.lit(t))) is not None for t in ("2024-02-29", "2024-02", "2023-02-29", "24-1-1", "1899-01-01")] == [True, True, False, False, False]


def test_display_and_numbers(spark):
    shown = lambda x, code: one(spark, values.display(F.lit(x), code))
    assert [shown(1234567.891, "#,##0.0"), shown(2.5, "0"), shown(-2.5, "0"), shown(0.1234, "0.0%"), shown(42.0, "00000"), shown(3.0, "@")] == ["1,234,567.9", "3", "-3", "12.3%", "00042", "3"]
    assert one(spark, values.round15(F.lit(1.005), 2)) == 1.01 and one(spark, values.round15(F.lit(-0.5), 0)) == -1
    assert [one(spark, values.number_of(F.lit(t))) for t in ("1,234", "50%", "00417", "x", "1.5.2")] == [1234, 0.5, 417, None, None]
    assert [one(spark, values.format_kind(F.lit(c))) for c in ("General", "@", "yyyy-mm-dd", "#,##0", '0" days"')] == ["General", "Text", "Date", "Number", "Number"]
    assert [one(spark, values.slug(F.lit(n))) for n in ("Q1 Report (final).xlsx", "매출.docx", "***")] == ["q1-report-final", "매출", "doc"]
    assert one(spark, values.occurrences(F.lit("aaaa"), "aa")) == [0, 1, 2]


def test_unusual_characters(spark):
    assert one(spark, chars.unusual(F.lit("a b​c\td\ne"))) == [" ", "​", "\t"]
    assert one(spark, chars.folded(F.lit("a b​c"))) == "a bc"


def people(spark):
    return spark.createDataFrame([(1, "ann", 3.0, None), (2, "bob", 0.0, "x"), (3, None, 12.5, "7")], "pos long, name string, amount double, note string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("=-2^2", [4.0] * 3), ("=1+2*3%", [1.06] * 3), ("=[@amount]/[@amount]", [1.0, None, 1.0]), ("=IFERROR([@amount]/[@amount],9)", [1.0, 9.0, 1.0]), ('=[@name]&"!"', ["ann!", "bob!", "!"]), ('=IF([@amount]>2,"big")', ["big", "FALSE", "big"]),
        ("=[@note]+1", [1.0, None, 8.0]), ("=SUM(T[amount],1)", [16.5] * 3), ("=MAX(T[amount])", [12.5] * 3), ("=AVERAGE(T[name])", [None] * 3), ('=COUNTIFS(T[amount],">=3")', [2.0] * 3), ("=SUMIFS(T[amount],T[name],[@name])", [3.0, 0.0, 12.5]), ("=ROUND([@amount]/2,0)", [2.0, 0.0, 6.0]),
        ('="A"="a"', [True] * 3), ("=#N/A", [None] * 3), ("=ABS(-[@[amount]])", [3.0, 0.0, 12.5]),
    ],
)
def test_formulas(spark, text, want):
    df = people(spark)
    assert [r.v for r in formula.fill(df, "v", text, {"T": df}).orderBy("pos").collect()] == want


def test_formula_errors(spark):
    df = people(spark)
    errs = lambda t: [r.v_err for r in formula.fill(df, "v", t, {"T": df}).orderBy("pos").collect()]
    assert errs("=1/[@amount]") == [None, "#DIV/0!", None] and errs("=[@note]*2") == [None, "#VALUE!", None] and errs("=AVERAGE(T[name])") == ["#DIV/0!"] * 3 and errs("=1+#REF!") == ["#REF!"] * 3
    for bad in ("1+1", "=A1+1", "=WEBSERVICE(1)", "=FOO(1)", "=(1", "=1 1", "=[@nope]", "=X[y]+1", "=T[amount]"):
        with pytest.raises(formula.FormulaError):
            formula.fill(df, "v", bad, {"T": df})


def test_recompute_touches_what_changed(spark):
    df = people(spark).withColumn("twice", F.lit(-1.0)).withColumn("four", F.lit(-1.0)).withColumn("other", F.lit(-1.0))
    out = formula.recompute(df, {"four": "=[@twice]*2", "twice": "=[@amount]*2", "other": "=[@note]&1"}, {"amount"}).orderBy("pos").first()
    assert (out.twice, out.four, out.other) == (6.0, 12.0, -1.0)
    with pytest.raises(formula.FormulaError, match="circular"):
        formula.order({"a": "=[@b]", "b": "=[@a]"})


def test_book_applies_all_or_nothing(spark):
    book = tables.Book({"T": (people(spark).drop("note"), {"name": "text", "amount": "number"})})
    ops = [
        {"op": "append_rows", "table": "t", "rows": [{"name": "zoe", "amount": 1}]}, {"op": "insert_rows", "table": "T", "before": 1, "rows": [{"name": "first"}]}, {"op": "delete_rows", "table": "T", "range": [3, 3]},
        {"op": "set", "table": "T", "range": [2, 2], "values": {"amount": 8}}, {"op": "add_column", "table": "T", "column": "double"}, {"op": "fill_formula", "table": "T", "column": "double", "formula": "=[@amount]*2"}, {"op": "sort", "table": "T", "keys": [["amount", True]]},
        {"op": "add_sheet", "sheet": "New"}, {"op": "add_table", "sheet": "New", "name": "U", "columns": [["k", "text"]]},
    ]
    out = book.apply(ops)
    assert [(r.name, r.amount, r.double) for r in out.tables["T"][0].orderBy("pos").collect()] == [(None, 12.5, 25.0), ("ann", 8.0, 16.0), ("zoe", 1.0, 2.0), ("first", None, 0.0)]
    assert out.tables["U"][0].count() == 1
    with pytest.raises(tables.Refused) as e:
        book.apply([{"op": "set", "table": "T", "range": [1, 1], "values": {"amount": "x"}}, ops[3], {"op": "nope"}, {"op": "fill_formula", "table": "T", "column": "amount", "formula": "=A1"}])
    assert [i for i, _ in e.value.problems] == [0, 2, 3]


def test_delete_all_leaves_an_empty_row(spark):
    assert [tuple(r) for r in tables.delete_rows(people(spark), 1, 3).collect()] == [(1, None, None, None)]


def test_set_type_refuses(spark):
    assert [r.note for r in tables.set_type(people(spark).filter("pos <> 2"), "note", "number").orderBy("pos").collect()] == [None, 7.0]
    with pytest.raises(Exception, match="not a number"):
        tables.set_type(people(spark), "note", "number").collect()


def test_sort_keeps_empties_last_both_ways(spark):
    c = [values.cell(F.lit(2.0)), values.cell(None, F.lit("b")), values.cell(), values.cell(None, None, F.lit(True)), values.cell(None, None, None, F.lit("#N/A")), values.cell(F.lit(1.0))]
    df = spark.range(1).select(F.posexplode(F.array(*c)).alias("pos", "c"))
    order = lambda desc: [r.old for r in tables.sort_rows(df.withColumn("old", F.col("pos")), [("c", desc)]).orderBy("pos").collect()]
    assert order(False) == [5, 0, 1, 3, 4, 2] and order(True) == [4, 3, 1, 0, 5, 2]


def test_windows(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\none\n## A1\ntwo\n# B\nthree"), (2, "# A\nx\n# A\ny"), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.line, r.content) for r in windows.section_window(docs, "A").orderBy("doc_id", "line").collect()]
    assert got == [(1, 2, "# A"), (1, 3, "one"), (1, 4, "## A1"), (1, 5, "two"), (2, 0, "ambiguous")]
    long = spark.createDataFrame([(1, "\n\n".join(["x" * 10] * 100))], "doc_id long, text string")
    r = windows.clip(long, 300).first()
    assert r.next_line == r.last_line + 1 and r.last_line % 2 == 0
    deck = spark.createDataFrame([(1, "a\n---\nb\nc\n---\nd")], "doc_id long, text string")
    assert [(r.slide, r.content) for r in windows.slides(deck).orderBy("line").collect()] == [(1, "a"), (2, "b"), (2, "c"), (3, "d")]
    with pytest.raises(windows.WindowError):
        windows.row_window(people(spark), 1, 501)
    assert windows.row_window(people(spark), 2, 5).count() == 4
    spans = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("a", 9, 9), ("a", 2, 2)], "k string, first int, last int")
    assert sorted(tuple(r) for r in windows.merged_spans(spans, ["k"]).collect()) == [("a", 1, 6), ("a", 9, 9)]


def test_blocks(spark):
    docs = spark.createDataFrame([(1, "# T\n\npara\nmore\n- a\n  1. b\n| x | y\\|z |\n| ^^ | w |\n---\nend")], "doc_id long, text string")
    rows = blocks.blocks(docs).orderBy("first").collect()
    assert [r.kind for r in rows] == ["heading", "para", "item", "item", "row", "break", "para"] and rows[1].content == "para\nmore"
    cells = {(r.row, r.col): (r.content, r.owner) for r in blocks.table_cells(blocks.blocks(docs)).collect()}
    assert cells == {(0, 0): ("x", 0), (0, 1): ("y|z", 0), (1, 0): ("^^", 0), (1, 1): ("w", 1)}
    assert [(r.level, r.numbered, r.item) for r in blocks.list_levels(blocks.blocks(docs)).orderBy("first").collect()] == [(0, False, "a"), (1, True, "b")]


def test_merges_and_edits():
    base, theirs = "a\n\nb\n\nc\n\nd\n", "a\n\nB\n\nc\n\nd\n"
    assert diffs.merge_of(base, "a\n\nb\n\nc\n\nD!\n", theirs) == ("a\n\nB\n\nc\n\nD!\n", [])
    assert diffs.merge_of(base, "a\n\nx\n\nc\n\nd\n", theirs) == (None, ["3:3"])
    assert diffs.merge_of(base, theirs, theirs) == (theirs, [])
    assert diffs.merge_of("1\n2\n", "1\nx\n", "y\n2\n")[0] is None
    assert diffs.unified_of("a\n", "a\n") == "" and "\\ No newline at end of file" in diffs.unified_of("a", "b")
    assert diffs.edit_of("one two", [("one", "1"), ("1 two", "x")]) == "x"
    for bad in ([("zz", "")], [("a", "b")]):
        with pytest.raises(ValueError, match="edit 0"):
            diffs.edit_of("aa", bad)
    assert diffs.align_blocks(["a", "b", "c"], ["c", "a", "b"]) == [(0, 1, "same"), (1, 2, "same"), (2, 0, "moved")]
    ops = difflib.SequenceMatcher(None, "abcd", "abXd", autojunk=False).get_opcodes()
    assert [diffs.map_position(k, ops) for k in range(5)] == [0, 1, 2, 3, 4]


def test_cell_diff_counts_rows_of_one_side(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, None)], "k int, x double, y string")
    new = spark.createDataFrame([(1, 1.0, "b"), (3, None, "c")], "k int, x double, y string")
    got = sorted(tuple(r) for r in diffs.cell_diff(old, new, ["k"], ["x", "y"]).collect())
    assert got == [(1, "y", "a", "b"), (2, "x", "2.0", None), (3, "y", None, "c")]


def test_lookups(spark):
    vector = spark.range(10_000).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("k"))
    assert lookups.is_sorted(vector, "k", "pos").first().is_sorted
    assert not lookups.is_sorted(vector.withColumn("k", F.when(F.col("pos") == 4096, 8190).otherwise(F.col("k"))), "k", "pos").first().is_sorted
    bands = spark.createDataFrame([(0.0, "lo"), (10.0, "hi")], "k double, v string")
    left = spark.createDataFrame([(-1.0,), (0.0,), (9.9,), (10.0,)], "x double")
    assert [r.found for r in lookups.vlookup_approximate(left, bands, "x", "k", "v").orderBy("x").collect()] == [None, "lo", "lo", "hi"]


def test_stale_and_digest(spark):
    log = spark.createDataFrame([(1, 1, "open"), (1, 2, "edit"), (1, 3, "reimport"), (2, 1, "open"), (2, 2, "reimport")], "doc_id long, rev long, op string")
    base = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, base long")
    assert sorted((r.doc_id, r.base, r.stale) for r in revisions.stale(log, base).collect()) == [(1, 1, True), (1, 2, False), (2, 1, False)]
    assert revisions.fnv1a(b"") == 0xCBF29CE484222325 and revisions.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_safety(spark):
    page = spark.createDataFrame([(1, '<IMG src="http://x/y"><p onclick="f()">'), (2, "plain"), (3, None)], "id long, html string")
    assert sorted((r.id, r.kind) for r in safety.notices(page, "id", "html").collect()) == [(1, "event_handler"), (1, "remote_image")]
    rels = spark.createDataFrame([("d", "1", "oleObject", "x", False), ("d", "2", "hyperlink", "http://x", True), ("d", "3", "image", "http://x", True)], "part string, id string, type string, target string, external boolean")
    assert [r.notice for r in safety.relationship_notices(rels).orderBy("id").collect()] == ["ole", None, "external"]


def test_packages_round_trip(spark, tmp_path):
    sheets = {"Sales & more": [["month", "n"], ["<a>", 1.5], [None, ("=B2*2", 3.0)], [True, "x_y"]], "Two": [[7]]}
    data = office.workbook(sheets)
    assert office.rezip(office.unzip(data)) == data
    (tmp_path / "a.xlsx").write_bytes(data)
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    rows = office.read_cells(spark, str(tmp_path)).collect()
    assert [r.error.split(":")[0] for r in rows if r.path.endswith("bad.xlsx")] == ["BadZipFile"]
    got = {(r.sheet, r.row, r.col): (r.value.num if r.value.tag == "number" else r.value.str if r.value.tag == "text" else r.value.bool, r.formula) for r in rows if r.error is None}
    assert got == {("Sales & more", 1, 1): ("month", None), ("Sales & more", 1, 2): ("n", None), ("Sales & more", 2, 1): ("<a>", None), ("Sales & more", 2, 2): (1.5, None), ("Sales & more", 3, 2): (3.0, "B2*2"), ("Sales & more", 4, 1): (True, None), ("Sales & more", 4, 2): ("x_y", None), ("Two", 1, 1): (7.0, None)}
    rels = office.read_relationships(spark, str(tmp_path), "a.xlsx").collect()
    assert {(r.part, r.target) for r in rels} == {("", "xl/workbook.xml"), ("xl/workbook.xml", "xl/worksheets/sheet1.xml"), ("xl/workbook.xml", "xl/worksheets/sheet2.xml")}
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "d.docx").write_bytes(office.rezip([("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>'.encode())]))
    assert [(r.kind, r.level, r.text) for r in office.read_blocks(spark, str(tmp_path)).orderBy("block").collect()] == [("heading", 2, "Title"), ("para", 0, "a\tb")]
    with pytest.raises(ValueError, match="unpacks"):
        office.unzip(office.rezip([("x", b"0" * 5000)]), 4999)


def test_streams(spark, tmp_path):
    from tessera.streaming import revlog

    spark.createDataFrame([(1, 1, 0, "open"), (1, 2, 1, "edit"), (1, 3, 1, "edit"), (1, 4, 2, "reimport"), (1, 5, 2, "edit")], "doc_id long, seq long, base long, op string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, seq long, base long, op string").parquet(str(tmp_path / "in"))
    q = revlog.accept(stream).writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.accepted, r.head) for r in spark.table("accepted").collect()] == [(True, 1), (True, 2), (False, 2), (True, 3), (True, 4)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert revlog.activity(events).agg(F.sum("n")).first()[0] == events.count()
