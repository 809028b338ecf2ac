"""Office packages: zip parts, relationships, worksheets' cells and documents' paragraphs, and a writer of worksheets.

A package is one file, so it is read inside a task; files are dealt out by Spark's binaryFile source.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed value: bytes that a package may unpack to.
MAX_UNPACKED = 1 << 30

CELLS = "path string, sheet string, row int, col int, value struct<tag:string,num:double,str:string,bool:boolean,err:string>, formula string, error string"
PARTS = "path string, part_no int, name string, data binary, error string"
RELS = "path string, part string, id string, type string, target string, external boolean"
PARAS = "path string, block int, kind string, level int, text string, error string"


def unzip(data: bytes, limit: int = MAX_UNPACKED) -> list[tuple[str, bytes]]:
    """Parts in order; ValueError beyond the limit, which is held while reading, whatever sizes the package states."""
    out, total = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            with z.open(info) as f:
                part = f.read(limit - total + 1)
            total += len(part)
            if total > limit:
                raise ValueError(f"unpacks to over {limit} bytes")
            out.append((info.filename, part))
    return out


def rezip(parts: list[tuple[str, bytes]]) -> bytes:
    """The same bytes for the same parts: fixed times and attributes."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in parts:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return buf.getvalue()


def tree(data: bytes) -> ET.Element:
    """Refuses document type declarations, by which a small part could grow without bound."""
    if b"<!DOCTYPE" in data[:4096]:
        raise ValueError("a document type declaration")
    return ET.fromstring(data)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def relationships(parts: dict[str, bytes]) -> list[tuple[str, str, str, str, bool]]:
    """(part, id, short type, resolved target, external)"""
    out = []
    for name, data in parts.items():
        m = re.fullmatch(r"(.*?)_rels/([^/]*)\.rels", name)
        if m:
            for r in tree(data):
                external = r.get("TargetMode") == "External"
                target = r.get("Target", "")
                resolved = target if external else posixpath.normpath(posixpath.join("/" + m[1], target)).lstrip("/")
                out.append((m[1] + m[2], r.get("Id", ""), r.get("Type", "").rpartition("/")[2], resolved, external))
    return out


def unescaped(text: str) -> str:
    """_xHHHH_ escapes of strings."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def runs(e: ET.Element) -> str:
    return unescaped("".join(t.text or "" for t in e.iter() if local(t.tag) == "t"))


def column_number(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]{1,3})([0-9]+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def sheet_cells(data: bytes) -> Iterator[dict]:
    """Cells of a workbook: sheet, row, col, value, formula."""
    parts = dict(unzip(data))
    rels = {(p, i): t for p, i, _, t, x in relationships(parts) if not x}
    main = next((t for (p, _), t in rels.items() if p == "" and t.endswith("workbook.xml")), "xl/workbook.xml")
    strings = [runs(si) for si in tree(parts["xl/sharedStrings.xml"])] if "xl/sharedStrings.xml" in parts else []
    for sheet in (e for e in tree(parts[main]).iter() if local(e.tag) == "sheet"):
        rid = next(v for k, v in sheet.attrib.items() if local(k) == "id" and k != "id")
        at = 0
        for c in (e for e in tree(parts[rels[main, rid]]).iter() if local(e.tag) in ("c", "row")):
            if local(c.tag) == "row":
                at, col = int(c.get("r", at + 1)), 0
                continue
            row, col = column_number(c.get("r")) if c.get("r") else (at, col + 1)
            kids = {local(k.tag): k for k in c}
            raw, kind = kids["v"].text if "v" in kids else None, c.get("t", "n")
            v = dict.fromkeys(("num", "str", "bool", "err")) | {"tag": "empty"}
            if kind == "inlineStr":
                v |= {"tag": "text", "str": runs(c)}
            elif raw is not None:
                v |= {"s": lambda: {"tag": "text", "str": strings[int(raw)]}, "str": lambda: {"tag": "text", "str": unescaped(raw)}, "b": lambda: {"tag": "boolean", "bool": raw == "1"}, "e": lambda: {"tag": "error", "err": raw}}.get(kind, lambda: {"tag": "number", "num": float(raw)})()
            yield {"sheet": sheet.get("name"), "row": row, "col": col, "value": v, "formula": kids["f"].text if "f" in kids else None, "error": None}


def paragraph_text(p: ET.Element) -> str:
    """Text, line breaks and tabs of a paragraph in order; what properties hold (tab stops, say) is no text."""
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        kind = local(e.tag)
        if kind.endswith("Pr"):
            return
        out.append((e.text or "") if kind == "t" else "\n" if kind in ("br", "lineBreak") else "\t" if kind == "tab" else "")
        for c in e:
            walk(c)
            if kind == "t":
                out.append(c.tail or "")

    walk(p)
    return "".join(out)


def document_blocks(data: bytes) -> Iterator[dict]:
    """Paragraphs and table cells of a word-processing document (docx, hwpx), in order."""
    parts = dict(unzip(data))
    mains = ["word/document.xml"] if "word/document.xml" in parts else sorted((n for n in parts if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if not mains:
        raise ValueError("no document part")
    block = 0
    for main in mains:
        for p in (e for e in tree(parts[main]).iter() if local(e.tag) == "p"):
            style = next((next(iter(s.attrib.values()), "") for s in p.iter() if local(s.tag) == "pStyle"), "")
            level = int(re.sub(r"\D", "", style) or 0) if style.lower().startswith("heading") else 0
            yield {"block": block, "kind": "heading" if level else "para", "level": level, "text": paragraph_text(p), "error": None}
            block += 1


def slide_blocks(data: bytes) -> Iterator[dict]:
    """Paragraphs of a presentation's slides in number order; level is the slide's number."""
    parts = dict(unzip(data))
    block = 0
    for n in sorted(int(m[1]) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", x) for x in parts) if m):
        for p in (e for e in tree(parts[f"ppt/slides/slide{n}.xml"]).iter() if local(e.tag) == "p"):
            yield {"block": block, "kind": "slide", "level": n, "text": paragraph_text(p), "error": None}
            block += 1


def _each(files: DataFrame, schema: str, rows_of, columns: list[str]) -> DataFrame:
    """A file that can't be read gives one row that says why; the others are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = list(rows_of(bytes(content)))
                except (ValueError, KeyError, StopIteration, IndexError, TypeError, zipfile.BadZipFile, ET.ParseError) as e:
                    rows = [dict.fromkeys(columns) | {"error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pd.DataFrame([{"path": path, **r} for r in rows], columns=["path", *columns], dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read_parts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return _each(files(spark, path, glob), PARTS, lambda b: [{"part_no": i, "name": n, "data": d, "error": None} for i, (n, d) in enumerate(unzip(b))], ["part_no", "name", "data", "error"])


def read_relationships(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    rows = lambda b: [dict(zip(("part", "id", "type", "target", "external"), r, strict=True)) for r in relationships(dict(unzip(b)))]
    return _each(files(spark, path, glob), RELS, rows, ["part", "id", "type", "target", "external"])


def read_cells(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """(path, sheet, row, col, value, formula, error) of all workbooks below a path."""
    return _each(files(spark, path, glob), CELLS, sheet_cells, ["sheet", "row", "col", "value", "formula", "error"])


def read_blocks(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """(path, block, kind, level, text, error) of docx or hwpx files; of pptx ones with that glob."""
    return _each(files(spark, path, glob), PARAS, slide_blocks if glob.endswith(".pptx") else document_blocks, ["block", "kind", "level", "text", "error"])


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook's bytes from rows of numbers, texts, booleans, None, and '=formula' texts given as ('=...', cached)."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def letters(n: int) -> str:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    def one(r: int, c: int, v) -> str:
        at, f = f'r="{letters(c)}{r}"', ""
        if isinstance(v, tuple):
            f, v = f"<f>{esc(v[0][1:])}</f>", v[1]
        if v is None:
            return f"<c {at}>{f}</c>" if f else ""
        if isinstance(v, bool):
            return f'<c {at} t="b">{f}<v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f"<c {at}>{f}<v>{v!r}</v></c>"
        return f'<c {at} t="str">{f}<v>{esc(v)}</v></c>' if f else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{esc(v)}</t></is></c>'

    ns, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = lambda body: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'
    parts = [("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")]
    parts.append(("_rels/.rels", rels(f'<Relationship Id="rId1" Type="{r}/officeDocument" Target="xl/workbook.xml"/>')))
    parts.append(("xl/workbook.xml", f'<workbook {ns} xmlns:r="{r}"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>"))
    parts.append(("xl/_rels/workbook.xml.rels", rels("".join(f'<Relationship Id="rId{i}" Type="{r}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)))))
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{y}">' + "".join(one(y, x, v) for x, v in enumerate(row, 1)) + "</row>" for y, row in enumerate(rows, 1))
        parts.append((f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"))
    return rezip([(n, d.encode()) for n, d in parts])
