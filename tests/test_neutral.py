"""Packages made safe: what goes, what is told, and what keeps its bytes."""

from tessera.sources import neutral, office, writers

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(*rows):
    body = "".join(f'<Relationship Id="{i}" Type="{R}/{kind}" Target="{to}"{" TargetMode=\"External\"" if out else ""}/>' for i, kind, to, out in rows)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'.encode()


def told(notices):
    return sorted((phase, kind, detail) for phase, kind, _, detail in notices)


def test_a_clean_package_keeps_its_bytes():
    for data in (writers.document([(0, "text")]), writers.document([(0, "text")], "hwpx"), office.workbook({"S": [[1, ("=A1*2", 2)]]})):
        assert neutral.neutralised(data) == (data, [])


def test_documents():
    data = writers.document([(0, "text")])
    old = dict(office.unzip(data))["word/document.xml"].decode()
    new = old.replace("<w:document ", f'<w:document xmlns:r="{R}" ').replace(
        "</w:body>",
        '<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>unseen</w:t></w:r><w:del w:author="Ann"><w:r><w:delText>gone</w:delText></w:r></w:del>'
        '<w:r><w:instrText>INCLUDETEXT "http://x"</w:instrText></w:r><w:fldSimple w:instr="DDE a b"><w:r><w:t>shown</w:t></w:r></w:fldSimple><w:fldSimple w:instr="PAGE"/>'
        '<w:object><o:OLEObject xmlns:o="o" r:id="rId7"/></w:object><w:hyperlink r:id="rId8"/></w:p></w:body>',
    )
    data = writers.replaced(data, {
        "word/document.xml": new.encode(), "word/vbaProject.bin": b"macro", "word/embeddings/o.bin": b"ole", "docProps/core.xml": b"<c><creator>Ann</creator></c>",
        "word/_rels/document.xml.rels": rels(("rId1", "styles", "styles.xml", False), ("rId6", "vbaProject", "vbaProject.bin", False), ("rId7", "oleObject", "embeddings/o.bin", False), ("rId8", "hyperlink", "http://x", True), ("rId9", "image", "http://y", True)),
    })
    safe, notices = neutral.neutralised(data)
    assert told(notices) == [
        ("neutralised", "fetching-field", "DDE a b"), ("neutralised", "fetching-field", 'INCLUDETEXT "http://x"'), ("neutralised", "linked-image", "http://y"), ("neutralised", "macros", "word/vbaProject.bin"),
        ("neutralised", "ole-object", "word/embeddings/o.bin"), ("surfaced", "hidden-text", "unseen"), ("surfaced", "metadata", "Ann"), ("surfaced", "tracked-deletion", "gone"),
    ]
    parts = dict(office.unzip(safe))
    assert "word/vbaProject.bin" not in parts and "word/embeddings/o.bin" not in parts and "word/styles.xml" in parts
    body = parts["word/document.xml"].decode()
    assert "OLEObject" not in body and "shown" in body and 'w:instr="PAGE"' in body and "rId8" in body and "INCLUDETEXT" not in body
    assert [n for n in neutral.neutralised(safe)[1] if n[0] == "neutralised"] == []


def test_workbooks():
    data = office.workbook({"S": [[1, ('=WEBSERVICE("http://x")', 7), ("=A1&\"RTD(\"", "t")], [("=[1]Sheet1!A1", 3)]], "H": [[1]]})
    book = dict(office.unzip(data))["xl/workbook.xml"].replace(b'name="H"', b'name="H" state="hidden"')
    safe, notices = neutral.neutralised(writers.replaced(data, {"xl/workbook.xml": book}))
    assert told(notices) == [("neutralised", "fetching-formula", 'WEBSERVICE("http://x")'), ("neutralised", "fetching-formula", "[1]Sheet1!A1"), ("surfaced", "hidden-sheet", "H")]
    got = {(c["row"], c["col"]): (c["formula"], c["value"]["num"]) for c in office.sheet_cells(safe) if c["sheet"] == "S"}
    assert got[1, 2] == (None, 7.0) and got[2, 1] == (None, 3.0) and got[1, 3][0] == 'A1&"RTD("'


def test_hwpx():
    data = writers.document([(0, "text")], "hwpx")
    parts = dict(office.unzip(data))
    section = parts["Contents/section0.xml"].replace(b"</hs:sec>", b'<hp:p><hp:run><hp:ole binaryItemIDRef="ole1"/><hp:t>a<hp:deleteBegin Id="1"/>old<hp:deleteEnd Id="1"/>b</hp:t></hp:run></hp:p></hs:sec>')
    hpf = parts["Contents/content.hpf"].replace(b"</opf:manifest>", b'<opf:item id="ole1" href="BinData/o.ole" media-type="x"/><opf:item id="js" href="Scripts/a.js" media-type="text/javascript"/></opf:manifest>')
    safe, notices = neutral.neutralised(writers.replaced(data, {"Contents/section0.xml": section, "Contents/content.hpf": hpf, "BinData/o.ole": b"1", "Scripts/a.js": b"2", "Preview/PrvText.txt": b"peek"}))
    assert told(notices) == [("neutralised", "macros", "Scripts/a.js"), ("neutralised", "ole-object", "ole1"), ("surfaced", "preview-text", "peek"), ("surfaced", "tracked-deletion", "old")]
    left = dict(office.unzip(safe))
    assert not {"BinData/o.ole", "Scripts/a.js"} & set(left) and b"ole1" not in left["Contents/content.hpf"] + left["Contents/section0.xml"]


def test_files(spark):
    files = spark.createDataFrame([("a", writers.document([(0, "x")])), ("b", b"no")], "path string, content binary")
    got = {r.path: r for r in neutral.neutralise(files).collect()}
    assert got["a"].error is None and got["a"].notices == [] and got["b"].content is None
