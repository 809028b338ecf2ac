"""Parts of packages as rows: run properties, numbering, comments, fields, styles of workbooks, slides' shapes; remainders as JSON."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lazy import arrow_udf

# Flags of runs, and number formats of lists that aren't bullets.
FLAGS = {"b": "bold", "i": "italic", "strike": "strike"}
SCHEMES = ("decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "ganada", "chosung", "decimalEnclosedCircle")
OFF = ("0", "false", "off", "none")


def local(name: str) -> str:
    return name.rpartition("}")[2]


def attrs_of(e: ET.Element) -> dict[str, str]:
    return {local(k): v for k, v in e.attrib.items()}


def children(e: ET.Element, *path: str) -> Iterator[ET.Element]:
    """Elements at a path of local names, in any namespace."""
    if not path:
        yield e
        return
    for c in e:
        if local(c.tag) == path[0]:
            yield from children(c, *path[1:])


def run_props(e: ET.Element) -> dict[str, str]:
    """The direct formatting of a run's rPr as a map: flags as true or false, size in points, colour and fill as #RRGGBB, fonts."""
    out = {}
    for c in e:
        name, a = local(c.tag), attrs_of(c)
        val = a.get("val")
        if name in FLAGS:
            out[FLAGS[name]] = "false" if val in OFF else "true"
        elif name == "u":
            out["underline"] = "false" if val in OFF else "true"
        elif name == "sz" and val and val.isdigit():
            out["size"] = f"{int(val) / 2:g}pt"
        elif name == "color" and val and re.fullmatch(r"[0-9A-Fa-f]{6}", val):
            out["color"] = f"#{val.upper()}"
        elif name == "shd" and re.fullmatch(r"[0-9A-Fa-f]{6}", a.get("fill", "")):
            out["fill"] = f"#{a['fill'].upper()}"
        elif name == "rFonts" and (font := a.get("ascii") or a.get("eastAsia")):
            out["font"] = font
    return out


def props_xml(props: dict[str, str]) -> str:
    """A map of run_props as the inside of an rPr, in the schema's order."""
    out = []
    if font := props.get("font"):
        from xml.sax.saxutils import quoteattr

        out.append(f"<w:rFonts w:ascii={quoteattr(font)} w:hAnsi={quoteattr(font)}/>")
    for tag, name in (("b", "bold"), ("i", "italic"), ("strike", "strike")):
        if name in props:
            out.append(f"<w:{tag}/>" if props[name] == "true" else f'<w:{tag} w:val="0"/>')
    if "color" in props:
        out.append(f'<w:color w:val="{props["color"][1:]}"/>')
    if "size" in props:
        out.append(f'<w:sz w:val="{round(float(props["size"][:-2]) * 2)}"/>')
    if "underline" in props:
        out.append(f'<w:u w:val="{"single" if props["underline"] == "true" else "none"}"/>')
    if "fill" in props:
        out.append(f'<w:shd w:val="clear" w:fill="{props["fill"][1:]}"/>')
    return "".join(out)


def runs_of(data: bytes) -> list[dict]:
    """A document part's runs (para, run, text, props, role): role says whether text is shown and edited (text, link,
    inserted, control) or kept (deleted, field, note, comment, symbol, box)."""
    out: list[dict] = []
    paras = 0

    def walk(e: ET.Element, role: str, state: dict) -> None:
        nonlocal paras
        for c in e:
            name = local(c.tag)
            if name == "p":
                paras += 1
                walk(c, role, {"run": 0, "field": 0})
            elif name == "r":
                kinds = {local(x.tag) for x in c}
                marks = [attrs_of(x).get("fldCharType") for x in c if local(x.tag) == "fldChar"]
                state["field"] += marks.count("begin")
                now = "field" if state["field"] else "note" if kinds & {"footnoteReference", "endnoteReference"} else "comment" if "commentReference" in kinds else "symbol" if "sym" in kinds else "box" if kinds & {"pict", "drawing", "AlternateContent"} else role
                state["field"] -= marks.count("end")
                text = "".join("\n" if local(x.tag) == "br" else "\t" if local(x.tag) == "tab" else (x.text or "") for x in c if local(x.tag) in ("t", "delText", "br", "tab", "instrText"))
                props = next((run_props(x) for x in c if local(x.tag) == "rPr"), {})
                out.append({"para": paras, "run": state["run"], "text": text, "props": props, "role": now})
                state["run"] += 1
            elif name in ("ins", "moveTo"):
                walk(c, "inserted", state)
            elif name in ("del", "moveFrom"):
                walk(c, "deleted", state)
            elif name == "hyperlink":
                walk(c, "link", state)
            elif name == "fldSimple":
                walk(c, "field", state)
            elif name == "sdt":
                for inner in children(c, "sdtContent"):
                    walk(inner, "control", state)
            elif name not in ("pPr", "tblPr", "trPr", "tcPr", "sectPr"):
                walk(c, role, state)

    walk(ET.fromstring(data), "text", {"run": 0, "field": 0})
    return out


def numbering_of(data: bytes) -> list[dict]:
    """numbering.xml as (num, level, kind, start): bullet or decimal lists, a number's own overrides before its abstract's."""
    root = ET.fromstring(data)
    abstract: dict[str, dict[str, tuple[str, int]]] = {}

    def level(e: ET.Element) -> tuple[str, tuple[str, int]]:
        fmt = next((attrs_of(x).get("val", "") for x in children(e, "numFmt")), "")
        start = next((attrs_of(x).get("val", "1") for x in children(e, "start")), "1")
        return attrs_of(e)["ilvl"], ("decimal" if fmt in SCHEMES else "bullet", int(start))

    for a in children(root, "abstractNum"):
        abstract[attrs_of(a)["abstractNumId"]] = dict(level(x) for x in children(a, "lvl"))
    out = []
    for n in children(root, "num"):
        link = next((attrs_of(x).get("val") for x in children(n, "abstractNumId")), None)
        levels = dict(abstract.get(link or "", {}))
        for o in children(n, "lvlOverride"):
            levels |= dict(level(x) for x in children(o, "lvl"))
            for s in children(o, "startOverride"):
                at = attrs_of(o)["ilvl"]
                levels[at] = (levels.get(at, ("decimal", 1))[0], int(attrs_of(s)["val"]))
        out += [{"num": int(attrs_of(n)["numId"]), "level": int(k), "kind": kind, "start": start} for k, (kind, start) in sorted(levels.items())]
    return out


def comments_of(data: bytes) -> list[dict]:
    """comments.xml as (id, author, date, text), and a document's ranges as (id, kind: start, end or reference)."""
    root = ET.fromstring(data)
    if local(root.tag) == "comments":
        return [{"id": attrs_of(c).get("id"), "kind": "comment", "author": attrs_of(c).get("author"), "date": attrs_of(c).get("date"), "text": "\n".join("".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for p in children(c, "p"))} for c in children(root, "comment")]
    kinds = {"commentRangeStart": "start", "commentRangeEnd": "end", "commentReference": "reference"}
    return [{"id": attrs_of(e).get("id"), "kind": kinds[local(e.tag)], "author": None, "date": None, "text": None} for e in root.iter() if local(e.tag) in kinds]


def comment_balloons(marks: DataFrame, by: str = "path") -> DataFrame:
    """marks (by, id, kind, text), of comments and of the document's ranges -> (by, id, error): a range or reference without
    a comment (no comment), a comment that nothing refers to (orphan), a range that isn't opened or closed (open)."""
    n = marks.groupBy(by, "id").pivot("kind", ["comment", "start", "end", "reference"]).count().na.fill(0)
    error = F.when(F.col("comment") == 0, "no comment").when((F.col("reference") + F.col("start")) == 0, "orphan").when(F.col("start") != F.col("end"), "open")
    return n.select(by, "id", error.alias("error")).filter("error is not null")


def cell_styles_of(data: bytes) -> list[dict]:
    """styles.xml of a workbook as (xf, numfmt, props): a cell format's number format, font, fill and alignment."""
    root = ET.fromstring(data)
    codes = {int(attrs_of(e)["numFmtId"]): attrs_of(e)["formatCode"] for e in children(root, "numFmts", "numFmt")}

    def font(e: ET.Element) -> dict[str, str]:
        out = {}
        for c in e:
            name, a = local(c.tag), attrs_of(c)
            if name in FLAGS:
                out[FLAGS[name]] = "false" if a.get("val") in OFF else "true"
            elif name == "name":
                out["font"] = a.get("val", "")
            elif name == "sz":
                out["size"] = f"{float(a['val']):g}pt"
            elif name == "color" and len(a.get("rgb", "")) == 8:
                out["color"] = f"#{a['rgb'][2:].upper()}"
        return out

    fonts = [font(e) for e in children(root, "fonts", "font")]
    fills = [next((f"#{attrs_of(c)['rgb'][2:].upper()}" for c in children(e, "patternFill", "fgColor") if len(attrs_of(c).get("rgb", "")) == 8), None) for e in children(root, "fills", "fill")]
    out = []
    for k, e in enumerate(children(root, "cellXfs", "xf")):
        a = attrs_of(e)
        props = dict(fonts[int(a.get("fontId", 0))]) if fonts else {}
        if fills and fills[int(a.get("fillId", 0))]:
            props["fill"] = fills[int(a.get("fillId", 0))]
        for al in children(e, "alignment"):
            props |= {{"horizontal": "align", "vertical": "valign"}.get(n, n): v for n, v in attrs_of(al).items()}
        n = int(a.get("numFmtId", 0))
        out.append({"xf": k, "numfmt": n, "code": codes.get(n), "props": props})
    return out


def shapes_of(data: bytes) -> list[dict]:
    """A slide's objects (id, name, parent, kind, type, idx, x, y, w, h, cx, cy, cw, ch, fill, text): places in EMU, null
    where they are inherited; a group's own frame in cx to ch."""
    out: list[dict] = []

    def numbers(e: ET.Element | None, names: tuple[str, str]) -> list[int | None]:
        return [int(attrs_of(e)[n]) if e is not None and n in attrs_of(e) else None for n in names]

    def walk(e: ET.Element, parent: str | None) -> None:
        for c in e:
            kind = {"sp": "shape", "cxnSp": "line", "pic": "picture", "grpSp": "group", "graphicFrame": "frame"}.get(local(c.tag))
            if kind is None:
                continue
            own = next((x for x in c.iter() if local(x.tag) == "cNvPr"), None)
            ph = next((attrs_of(x) for x in c.iter() if local(x.tag) == "ph"), {}) if kind != "group" else {}
            props = next((x for x in c if local(x.tag) in ("spPr", "grpSpPr")), c)
            frame = next((x for x in props if local(x.tag) == "xfrm"), None)
            part = lambda n, f=frame: next((x for x in f if local(x.tag) == n), None) if f is not None else None
            fill = next((attrs_of(x).get("val") for s in props if local(s.tag) == "solidFill" for x in s if local(x.tag) == "srgbClr"), None)
            text = "\n".join("".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for b in c if local(b.tag) == "txBody" for p in children(b, "p"))
            place = dict(zip(("x", "y", "w", "h", "cx", "cy", "cw", "ch"), [*numbers(part("off"), ("x", "y")), *numbers(part("ext"), ("cx", "cy")), *numbers(part("chOff"), ("x", "y")), *numbers(part("chExt"), ("cx", "cy"))], strict=True))
            a = attrs_of(own) if own is not None else {}
            out.append({"id": a.get("id"), "name": a.get("name"), "parent": parent, "kind": kind, "type": ph.get("type"), "idx": ph.get("idx"), **place, "fill": f"#{fill.upper()}" if fill else None, "text": text})
            if kind == "group":
                walk(c, a.get("id"))

    root = ET.fromstring(data)
    for tree in root.iter():
        if local(tree.tag) == "spTree":
            walk(tree, None)
    return out


def found(data: bytes, path: str) -> list[str]:
    """Texts of the elements at a path of local names (a/b/c, * for any) below the root, or of an attribute (a/@x)."""
    steps = path.split("/")
    key = steps.pop()[1:] if steps[-1].startswith("@") else None
    here = [ET.fromstring(data)]
    for s in steps:
        here = [c for e in here for c in e if s in ("*", local(c.tag))]
    return ["".join(e.itertext()) for e in here] if key is None else [attrs_of(e)[key] for e in here if key in attrs_of(e)]


def rows_of(f, kind: str):
    """A parser of one part as a column: an array of its rows, null for what isn't XML."""

    @arrow_udf(f"array<struct<{kind}>>")
    def use(data: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else f(bytes(x))
            except ET.ParseError:
                return None

        return pd.Series([one(x) for x in data], dtype=object)

    return use


docx_runs = rows_of(runs_of, "para:int,run:int,text:string,props:map<string,string>,role:string")
docx_numbering = rows_of(numbering_of, "num:int,level:int,kind:string,start:int")
docx_comments = rows_of(comments_of, "id:string,kind:string,author:string,date:string,text:string")
xlsx_styles = rows_of(cell_styles_of, "xf:int,numfmt:int,code:string,props:map<string,string>")
pptx_shapes = rows_of(shapes_of, "id:string,name:string,parent:string,kind:string,type:string,idx:string,x:long,y:long,w:long,h:long,cx:long,cy:long,cw:long,ch:long,fill:string,text:string")


def xml_query(data: Column | str, path: str) -> Column:
    @arrow_udf("array<string>")
    def use(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else found(bytes(v), path) for v in x], dtype=object)

    return use(data)


def may_hold(data: Column, words: tuple[str, ...]) -> Column:
    """Whether a part's bytes hold one of the words: a test before parsing, in no Python. What it leaves out holds none."""
    text = data.cast("string")
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def raw_rows(data: Column) -> Column:
    """array<struct<row, xml>> of a sheet part's rows, unparsed: single rows are then chosen by number or by words (see
    may_hold) and only those are parsed."""
    whole = F.regexp_extract_all(data.cast("string"), F.lit(r"(?s)(<row\b[^>]*?(?:/>|>.*?</row>))"), F.lit(1))
    return F.transform(whole, lambda x: F.struct(F.regexp_extract(x, r'\br="(\d+)"', 1).try_cast("int").alias("row"), x.alias("xml")))


def row_cells(xml: Column) -> Column:
    """array<struct<col, type, style, formula, value>> of one raw row, natively."""
    from tessera.functions.a1 import col_index

    cells = F.regexp_extract_all(xml, F.lit(r"(?s)(<c\b[^>]*?(?:/>|>.*?</c>))"), F.lit(1))
    part = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))

    def cell(x: Column) -> Column:
        return F.struct(
            col_index(F.regexp_extract(x, r'\br="([A-Z]+)\d+"', 1)).alias("col"), part(x, r'^<c\b[^>]*\bt="([^"]*)"').alias("type"), part(x, r'^<c\b[^>]*\bs="(\d+)"').try_cast("int").alias("style"),
            part(x, r"(?s)<f\b[^>]*>(.*?)</f>").alias("formula"), part(x, r"(?s)<v>(.*?)</v>").alias("value"),
        )

    return F.transform(cells, cell)


def remainder_json(entries: DataFrame, by: str = "doc_id") -> DataFrame:
    """entries (by, seq, kind, name, data: bytes) -> (by, line): each entry as a line of JSON, its bytes in base64."""
    return entries.select(by, "seq", F.to_json(F.struct("seq", "kind", "name", F.base64("data").alias("data"))).alias("line"))


def remainder_entries(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """remainder_json() back."""
    own = lines.select(by, F.from_json("line", "seq bigint, kind string, name string, data string").alias("e"))
    return own.select(by, "e.seq", "e.kind", "e.name", F.unbase64("e.data").alias("data"))
