"""Packages made safe: what runs or fetches is taken out and told, what hides is told; all else keeps its bytes.

A package is one file, so it is scanned inside a task. Rules are a table, one for all formats.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame

from tessera.plans.formula import FETCH
from tessera.sources.office import local, relationships, tree, unzip
from tessera.sources.writers import TAG, replaced

NOTICES = "path string, content binary, notices array<struct<phase:string,kind:string,place:string,detail:string>>, error string"
# What relationships of a type are, wherever they point.
ACTIVE = {
    "vbaProject": "macros", "vbaProjectSignature": "macros", "wordVbaData": "macros", "vbaData": "macros", "keyMapCustomizations": "macros",
    "xlMacrosheet": "macro-sheet", "xlIntlMacrosheet": "macro-sheet", "dialogsheet": "macro-sheet",
    "control": "activex-control", "activeXControl": "activex-control", "activeXControlBinary": "activex-control", "ctrlProp": "activex-control",
    "externalLink": "external-link", "externalLinkPath": "external-link", "xlPathMissing": "external-link", "connections": "data-connection", "queryTable": "query-table",
    "oleObject": "ole-object",
}
# What relationships to the outside are, by type; others are external relationships. Links are text.
OUTSIDE = {"attachedTemplate": "remote-template", "image": "linked-image", "oleObject": "linked-object", "video": "linked-media", "audio": "linked-media", "media": "linked-media"}
# Fields that fetch or run something.
FIELDS = ("DDE", "DDEAUTO", "INCLUDEPICTURE", "INCLUDETEXT", "LINK", "IMPORT", "RD")
# Main parts with macros, and what they become.
PLAIN_MAINS = (
    (b"application/vnd.ms-word.document.macroEnabled.main+xml", b"application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"),
    (b"application/vnd.ms-word.template.macroEnabledTemplate.main+xml", b"application/vnd.openxmlformats-officedocument.wordprocessingml.template.main+xml"),
    (b"application/vnd.ms-powerpoint.presentation.macroEnabled.main+xml", b"application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"),
    (b"application/vnd.ms-excel.sheet.macroEnabled.main+xml", b"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"),
    (b"application/vnd.ms-excel.template.macroEnabled.main+xml", b"application/vnd.openxmlformats-officedocument.spreadsheetml.template.main+xml"),
)
# Elements with a person's or a firm's name, by part.
PEOPLE = {"docProps/core.xml": ("creator", "lastModifiedBy"), "docProps/app.xml": ("Company", "Manager")}
UNSAFE = re.compile(r"(?i)(?:^|[^A-Z0-9_.])(?:" + "|".join(re.escape(n) for n in sorted(FETCH, key=len, reverse=True)) + r")\s*\(|\[\d+\]|[A-Z]+\|'?[^!]+'?!")


def clip(text: str, n: int = 60) -> str:
    text = " ".join(text.split())
    return text if len(text) <= n else text[: n - 1] + "…"


def cut(part: bytes, gone: Callable[[str, dict[str, str], str], bool]) -> bytes:
    """A part without the elements for which gone(name, attributes, own text) holds, and all within them."""
    spans, stack = [], []
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name: str, attrs: dict) -> None:
        tag = TAG.match(part, parser.CurrentByteIndex)
        stack.append([name.rpartition(":")[2], attrs, "", tag.start(), tag.end() if tag[0].endswith(b"/>") else None])

    def end(_: str) -> None:
        name, attrs, text, at, to = stack.pop()
        if gone(name, attrs, text):
            spans.append((at, to or TAG.match(part, parser.CurrentByteIndex).end()))

    def chars(text: str) -> None:
        if stack:
            stack[-1][2] += text

    def refuse(*_) -> None:
        raise ValueError("a document type declaration")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, chars, refuse
    parser.Parse(part, True)
    for at, to in sorted(spans, reverse=True):  # of nested ones the outermost alone
        if not any(a <= at and to <= b and (a, b) != (at, to) for a, b in spans):
            part = part[:at] + part[to:]
    return part


def reached(parts: dict[str, bytes]) -> set[str]:
    """Parts that relationships lead to from the package itself."""
    to: dict[str, set[str]] = {}
    for source, _, _, target, external in relationships(parts):
        if not external:
            to.setdefault(source, set()).add(target)
    seen, open_ = set(), [""]
    while open_:
        for t in to.get(open_.pop(), ()):
            if t in parts and t not in seen:
                seen.add(t)
                open_.append(t)
    return seen


def verdict(kind: str, external: bool, source: str) -> str | None:
    if kind == "hyperlink":
        return None
    if external:
        return OUTSIDE.get(kind, ACTIVE.get(kind, "external-relationship"))
    if kind == "package" and re.match(r"word/|ppt/slide|xl/worksheets/", source):
        return "ole-object"
    return ACTIVE.get(kind)


def neutralised(data: bytes) -> tuple[bytes, list[tuple[str, str, str, str]]]:
    """(package, notices): docx, pptx, xlsx and hwpx packages. A package with nothing to take out keeps its bytes."""
    parts = dict(unzip(data))
    new, notices = dict(parts), []
    before = reached(parts)

    removed: dict[str, dict[str, str]] = {}
    for source, rid, kind, target, external in relationships(parts):
        what = verdict(kind, external, source)
        if what:
            removed.setdefault(source, {})[rid] = what
            notices.append(("neutralised", what, f"{source or 'package'} {rid}", clip(target)))
    for source, ids in removed.items():
        folder, _, name = source.rpartition("/")
        rels = f"{folder}/_rels/{name}.rels".lstrip("/")
        new[rels] = cut(new[rels], lambda n, a, _, ids=ids: n == "Relationship" and a.get("Id") in ids)
        if source.endswith(".xml") and source in new:
            pointing = lambda n, a, _, ids=ids: n != "blip" and any(v in ids for k, v in a.items() if k.startswith("r:"))
            body = cut(new[source], pointing)
            new[source] = re.sub(rb'(<(?:\w+:)?blip\b[^>]*?)\s+r:link="(' + b"|".join(re.escape(i.encode()) for i in ids) + rb')"', rb"\1", body)
    now = reached(new)
    for name in sorted(before - now):
        folder, _, own = name.rpartition("/")
        for gone in (name, f"{folder}/_rels/{own}.rels".lstrip("/")):
            if gone in new:
                new[gone] = None
    if "[Content_Types].xml" in new and removed:
        for macro, plain in PLAIN_MAINS:
            new["[Content_Types].xml"] = new["[Content_Types].xml"].replace(macro, plain)

    for name in [n for n, d in new.items() if d is not None and n.endswith(".xml")]:
        body = new[name]
        if name.startswith("word/"):
            body = _fields(body, name, notices)
        elif name.startswith("xl/worksheets/"):
            body = _formulas(body, name, notices)
        new[name] = body
    _hwpx(new, notices)
    _surfaced({n: d for n, d in new.items() if d is not None}, notices)
    changed = {n: d for n, d in new.items() if d != parts.get(n)}
    return (replaced(data, changed) if changed else data), notices


def _fields(body: bytes, name: str, notices: list) -> bytes:
    """Fields that fetch lose their instruction and keep the result they show."""
    fetching = re.compile(r"\s*(?:" + "|".join(FIELDS) + r")\b", re.I)
    if not any(f.encode() in body.upper() for f in FIELDS):
        return body

    def instruction(n: str, a: dict, text: str) -> bool:
        hit = n == "instrText" and fetching.match(text) is not None
        if hit:
            notices.append(("neutralised", "fetching-field", name, clip(text)))
        return hit

    body = cut(body, instruction)

    def simple(m: re.Match) -> bytes:
        if not fetching.match(m[2].decode()):
            return m[0]
        notices.append(("neutralised", "fetching-field", name, clip(m[2].decode())))
        return m[1] + m[3]

    return re.sub(rb'(<w:fldSimple\b[^>]*?w:instr=")([^"]*)(")', simple, body)


def _formulas(body: bytes, name: str, notices: list) -> bytes:
    """Formulas that fetch, run or read another workbook go; their cells keep the value they show."""
    masters: set[str] = set()

    def unsafe(n: str, a: dict, text: str) -> bool:
        if n != "f":
            return False
        hit = UNSAFE.search(re.sub(r'"(?:[^"]|"")*"', '""', text)) is not None
        if hit:
            notices.append(("neutralised", "fetching-formula", name, clip(text)))
            if a.get("t") == "shared":
                masters.add(a.get("si"))
        return hit or (not text and a.get("si") in masters)

    return cut(body, unsafe) if b"<f" in body or b":f" in body else body


def _hwpx(new: dict[str, bytes | None], notices: list) -> None:
    """Scripts and objects of hwpx packages, with their entries of the manifest."""
    manifest = "Contents/content.hpf"
    if new.get(manifest) is None:
        return
    items: set[str] = set()
    for name in [n for n, d in new.items() if d is not None and re.fullmatch(r"Contents/\w+\.xml", n)]:

        def ole(n: str, a: dict, _: str, name=name) -> bool:
            if n == "ole":
                items.add(a.get("binaryItemIDRef", ""))
                notices.append(("neutralised", "ole-object", name, a.get("binaryItemIDRef", "")))
            return n == "ole"

        new[name] = cut(new[name], ole)
    gone: set[str] = set()

    def item(n: str, a: dict, _: str) -> bool:
        if n == "itemref":
            return a.get("idref") in gone
        href, media, outside = a.get("href", ""), a.get("media-type", ""), a.get("isEmbeded") == "0"
        hit = n == "item" and (href.startswith("Scripts/") or "javascript" in media or outside or a.get("id") in items)
        if hit:
            gone.add(a.get("id"))
            if not outside and href in new:
                new[href] = None
            if a.get("id") not in items:
                notices.append(("neutralised", ("linked-image" if media.startswith("image/") else "linked-object") if outside else "macros", manifest, href))
        return hit

    new[manifest] = cut(new[manifest], item)
    for name in [n for n, d in new.items() if n.startswith("Scripts/") and d is not None]:
        notices.append(("neutralised", "macros", name, "script part"))
        new[name] = None


def _surfaced(parts: dict[str, bytes], notices: list) -> None:
    """What a reader doesn't see: hidden text, sheets, rows, columns, slides and shapes, deletions, comments, names."""

    def tell(kind: str, place: str, detail: str) -> None:
        if detail:
            notices.append(("surfaced", kind, place, clip(detail)))

    said = lambda e, *tags: "".join(t.text or "" for t in e.iter() if local(t.tag) in tags)
    attr = lambda e, key: next((v for k, v in e.attrib.items() if local(k) == key), None)
    for name, data in parts.items():
        if name == "Preview/PrvText.txt":
            tell("preview-text", name, data.decode("utf-8", "replace"))
        if not (name.endswith((".xml", ".hpf")) and re.match(r"word/|ppt/|xl/|docProps/|Contents/", name)):
            continue
        root = tree(data)
        for e in root.iter():
            kind = local(e.tag)
            if kind == "r" and name.startswith("word/") and any(local(v.tag) == "vanish" and attr(v, "val") not in ("0", "false") for p in e if local(p.tag) == "rPr" for v in p):
                tell("hidden-text", name, said(e, "t"))
            elif kind in ("del", "moveFrom") and name.startswith("word/"):
                tell("tracked-deletion", f"{name} {attr(e, 'author') or '?'}", said(e, "delText", "t"))
            elif kind in ("comment", "threadedComment", "cm", "hiddenComment"):
                tell("comment", f"{name} {attr(e, 'id') or attr(e, 'ref') or ''}".strip(), said(e, "t", "text"))
            elif kind == "fieldBegin" and attr(e, "type") == "MEMO":
                tell("comment", name, said(e, "t"))
            elif kind == "sheet" and attr(e, "state") in ("hidden", "veryHidden"):
                tell("hidden-sheet", name, attr(e, "name") or "?")
            elif kind in ("row", "col") and name.startswith("xl/worksheets/") and attr(e, "hidden") in ("1", "true") and (kind == "col" or len(e)):
                tell(f"hidden-{'row' if kind == 'row' else 'column'}", name, attr(e, "r") or f"{attr(e, 'min')}:{attr(e, 'max')}")
            elif kind == "f" and re.search(r"(?i)\bHYPERLINK\s*\(", e.text or ""):
                tell("link-formula", name, e.text)
            elif kind == "sld" and attr(e, "show") in ("0", "false"):
                tell("hidden-slide", name, said(e, "t") or "empty")
            elif kind == "cNvPr" and attr(e, "hidden") in ("1", "true"):
                tell("hidden-shape", name, attr(e, "name") or "?")
            elif kind in PEOPLE.get(name, ()) or kind == "meta" and attr(e, "name") in ("creator", "lastsaveby"):
                tell("metadata", f"{name} {attr(e, 'name') or kind}", e.text or "")
        if name.startswith("Contents/"):
            _deleted(root, name, tell)


def _deleted(root: ET.Element, name: str, tell: Callable) -> None:
    """Text of hwpx between the marks of a tracked deletion."""
    open_, text = 0, ""
    for t in (e for e in root.iter() if local(e.tag) == "t"):
        for e, piece in [(None, t.text), *((c, c.tail) for c in t)]:
            mark = local(e.tag) if e is not None else ""
            open_ += (mark == "deleteBegin") - (mark == "deleteEnd")
            text += (piece or "") if open_ > 0 else ""
            if mark == "deleteEnd":
                tell("tracked-deletion", name, text)
                text = ""


def neutralise(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, content, notices, error), a row a file; one that can't be read has no content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    body, notices = neutralised(bytes(content))
                    row = (path, body, [dict(zip(("phase", "kind", "place", "detail"), n, strict=True)) for n in notices], None)
                except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError, expat.ExpatError) as e:
                    row = (path, None, [], f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["path", "content", "notices", "error"], dtype=object)

    return files.select("path", "content").mapInPandas(run, NOTICES)
