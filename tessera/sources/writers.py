"""Writers of packages: texts put back into docx, hwpx and pptx files without touching anything else, and new documents.

A package is one file, so it is written inside a task; files and their edits are dealt out by path.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.office import document_blocks, rezip, unzip

WRITTEN = "path string, content binary, error string"
TAG = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def replaced(data: bytes, parts: dict[str, bytes | None]) -> bytes:
    """A package with some parts' bytes replaced, added or (None) taken out; order, times and attributes of the others
    stay, and the declared content types follow what was added or taken out."""
    buf = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(buf, "w") as out:
        names = {i.filename for i in z.infolist()}
        types = parts.get("[Content_Types].xml") or (z.read("[Content_Types].xml") if "[Content_Types].xml" in names else None)
        gone = {n for n, d in parts.items() if d is None}
        if types is not None and gone:
            drop = lambda m: b"" if m[1].decode().lstrip("/") in gone else m[0]
            parts = parts | {"[Content_Types].xml": re.sub(rb'<Override\b[^>]*\bPartName="([^"]*)"[^>]*/>', drop, types)}
        for info in z.infolist():
            body = parts.get(info.filename, z.read(info.filename)) if not info.is_dir() else b""
            if body is not None:
                out.writestr(info, body, info.compress_type)
        for name in (n for n in parts if n not in names and parts[n] is not None):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            out.writestr(info, parts[name])
    return buf.getvalue()


def paragraph_pieces(part: bytes) -> list[list[list]]:
    """For each paragraph of a part, in the order of its start: [kind, text, begin, end, shell] of its pieces, where kind
    t has text between the bytes begin and end (shell is the tag of an empty element, which holds no text yet), and
    others are a line break or a tab."""
    out, open_, current, stack, props = [], [], None, [], 0
    parser = expat.ParserCreate()

    def piece(kind: str, text: str, begin: int, end: int, shell: bytes | None = None) -> list:
        new = [kind, text, begin, end, shell]
        for p in open_:
            p.append(new)
        return new

    def start(name: str, _: dict) -> None:
        nonlocal current, props
        kind, at = name.rpartition(":")[2], parser.CurrentByteIndex
        if current is not None:  # a mark inside a run's text divides it
            current[3] = at
            current = None
        tag = TAG.match(part, at)
        empty = tag[0].endswith(b"/>")
        stack.append((kind, tag.end() if empty else None))
        props += kind.endswith("Pr")
        if props:
            return
        if kind == "p":
            out.append([])
            open_.append(out[-1])
        elif kind == "t":
            current = piece("t", "", at if empty else tag.end(), tag.end(), tag[0] if empty else None)
        elif kind in ("br", "lineBreak", "tab"):
            piece(kind, "\t" if kind == "tab" else "\n", at, at)

    def end(_: str) -> None:
        nonlocal current, props
        (kind, after), at = stack.pop(), parser.CurrentByteIndex
        props -= kind.endswith("Pr")
        if props:
            return
        if kind == "p":
            open_.pop()
        elif kind == "t" and current is not None:
            if current[4] is None:
                current[3] = at
            current = None
        elif stack and stack[-1][0] == "t":
            after = after or TAG.match(part, at).end()
            current = piece("t", "", after, after)

    def chars(text: str) -> None:
        if current is not None and stack[-1][0] == "t":
            current[1] += text

    def refuse(*_) -> None:
        raise ValueError("a document type declaration")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, chars, refuse
    parser.Parse(part, True)
    return out


def edited_part(part: bytes, edits: dict[int, str]) -> bytes:
    """A part with the texts of some paragraphs (by their number in it) replaced. Only what differs is put in, into the
    run where the difference begins, so formats and all other marks stay; without edits the bytes are the same.

    Breaks and tabs can't be edited, nor can a paragraph without a run take text; two edits of one run are refused.
    """
    paragraphs = paragraph_pieces(part)
    puts: dict[int, tuple[list, str]] = {}
    for k, new in sorted(edits.items()):
        if not 0 <= k < len(paragraphs):
            raise ValueError(f"block {k}: not there")
        pieces = paragraphs[k]
        old = "".join(p[1] for p in pieces)
        if old == new:
            continue
        lo, n = 0, min(len(old), len(new))
        while lo < n and old[lo] == new[lo]:
            lo += 1
        hi = 0
        while hi < n - lo and old[-1 - hi] == new[-1 - hi]:
            hi += 1
        end, put, at, done = len(old) - hi, new[lo : len(new) - hi], 0, False
        if "\n" in put or "\t" in put:
            raise ValueError(f"block {k}: a break or a tab can't be written")
        for p in pieces:
            a, b = at, at + len(p[1])
            at = b
            first, last = max(a, lo), min(b, end)
            if p[0] != "t":
                if first < last:
                    raise ValueError(f"block {k}: a break or a tab can't be taken out")
                continue
            here = not done and a <= lo <= b
            if first < last or here:
                if p[2] in puts:
                    raise ValueError(f"block {k}: a run is edited twice")
                puts[p[2]] = (p, p[1][: max(0, lo - a)] + (put if here else "") + p[1][max(0, min(end, b) - a) :])
                done = done or here
        if not done:
            raise ValueError(f"block {k}: no run takes the text")
    for begin in sorted(puts, reverse=True):
        (_, _, lo, hi, shell), text = puts[begin]
        body = escaped(text).encode()
        if shell is not None:
            name = re.match(rb"<([^\s/>]+)", shell)[1]
            body = shell[:-2].rstrip() + b">" + body + b"</" + name + b">"
        elif text != text.strip():
            # Spaces at an end count only where the element says so.
            tag = list(TAG.finditer(part, max(0, part.rfind(b"<", 0, lo)), lo))[-1]
            if tag[0].startswith(b"<w:t") and b"xml:space" not in tag[0]:
                lo, body = tag.start(), tag[0][:-1] + b' xml:space="preserve">' + body
        part = part[:lo] + body + part[hi:]
    return part


def text_parts(names: list[str]) -> list[str]:
    """The parts whose paragraphs readers number one after another."""
    if "word/document.xml" in names:
        return ["word/document.xml"]
    pattern = r"Contents/section(\d+)\.xml" if any(n.startswith("Contents/section") for n in names) else r"ppt/slides/slide(\d+)\.xml"
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.fullmatch(pattern, n)[1]))


def edited(data: bytes, edits: dict[int, str]) -> bytes:
    """A docx, hwpx or pptx package with the texts of some blocks (as readers number them) replaced."""
    if not edits:
        return data
    parts, first, new, left = dict(unzip(data)), 0, {}, dict(edits)
    for name in text_parts(list(parts)):
        n = len(paragraph_pieces(parts[name]))
        own = {k - first: left.pop(k) for k in list(left) if first <= k < first + n}
        body = edited_part(parts[name], own) if own else parts[name]
        if body != parts[name]:
            new[name] = body
        first += n
    if left:
        raise ValueError(f"block {min(left)}: not there")
    return replaced(data, new) if new else data


def write_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (path, content), edits (path, block, text) -> (path, content, error), a row a file. A file whose edits can't
    all be done has none done: content is null and error says why. Of two edits of a block the last by text counts."""
    own = edits.groupBy("path", "block").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("block", "text"))).alias("edits"))
    both = files.select("path", "content").join(own, "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, todo in zip(batch["path"], batch["content"], batch["edits"], strict=True):
                try:
                    row = (path, edited(bytes(content), dict(todo) if todo is not None else {}), None)
                except (ValueError, KeyError, zipfile.BadZipFile, expat.ExpatError) as e:
                    row = (path, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["path", "content", "error"], dtype=object)

    return both.mapInPandas(run, WRITTEN)


# Namespaces of word-processing markup and of paragraph lists in open document packages.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
HP, HS = "http://www.hancom.co.kr/hwpml/2011/paragraph", "http://www.hancom.co.kr/hwpml/2011/section"


def document(blocks: list[tuple[int, str]], kind: str = "docx") -> bytes:
    """A new docx or hwpx package of paragraphs (heading level or 0, text); line ends in a text are breaks, tabs are tabs."""

    def pieces(text: str, t: str, br: str, tab: str) -> str:
        marks = {"\n": br, "\t": tab}
        return "".join(marks.get(x) or f"{t}{escaped(x)}</{t[1:].split()[0].rstrip('>')}>" for x in re.split(r"([\n\t])", text) if x)

    if kind == "docx":
        run = lambda s: f"<w:r>{s}</w:r>" if s else ""
        style = lambda n: f'<w:pPr><w:pStyle w:val="Heading{n}"/></w:pPr>' if n else ""
        body = "".join(f"<w:p>{style(n)}{run(pieces(text, '<w:t xml:space=\"preserve\">', '<w:br/>', '<w:tab/>'))}</w:p>" for n, text in blocks)
        heads = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:pPr><w:outlineLvl w:val="{n - 1}"/></w:pPr></w:style>' for n in range(1, 7))
        base = "application/vnd.openxmlformats-officedocument.wordprocessingml"
        rel = lambda k, kind, to: f'<Relationship Id="rId{k}" Type="{R}/{kind}" Target="{to}"/>'
        rels = lambda x: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{x}</Relationships>'
        parts = {
            "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{base}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{base}.styles+xml"/></Types>',
            "_rels/.rels": rels(rel(1, "officeDocument", "word/document.xml")),
            "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>',
            "word/_rels/document.xml.rels": rels(rel(1, "styles", "styles.xml")),
            "word/styles.xml": f'<w:styles xmlns:w="{W}">{heads}</w:styles>',
        }
    elif kind == "hwpx":
        body = "".join(f'<hp:p styleIDRef="{n}"><hp:run charPrIDRef="0">{pieces(text, "<hp:t>", "<hp:lineBreak/>", "<hp:tab/>")}</hp:run></hp:p>' for n, text in blocks)
        parts = {
            "mimetype": "application/hwp+zip",
            "META-INF/container.xml": '<ocf:container xmlns:ocf="urn:oasis:names:tc:opendocument:xmlns:container"><ocf:rootfiles><ocf:rootfile full-path="Contents/content.hpf" media-type="application/hwpml-package+xml"/></ocf:rootfiles></ocf:container>',
            "Contents/content.hpf": '<opf:package xmlns:opf="http://www.idpf.org/2007/opf/"><opf:manifest><opf:item id="section0" href="Contents/section0.xml" media-type="application/xml"/></opf:manifest><opf:spine><opf:itemref idref="section0"/></opf:spine></opf:package>',
            "Contents/section0.xml": f'<hs:sec xmlns:hs="{HS}" xmlns:hp="{HP}">{body}</hs:sec>',
        }
    else:
        raise ValueError(f"no document format: {kind}")
    return rezip([(n, d.encode()) for n, d in parts.items()])


def converted(data: bytes, kind: str) -> tuple[bytes, list[str]]:
    """A docx or hwpx package as one of the other kind, and what is lost, by name: paragraphs, headings (in docx) and
    breaks are carried over; tables come as their cells' paragraphs, and other objects' parts are named."""
    parts = dict(unzip(data))
    if not any(n == "word/document.xml" or n.startswith("Contents/section") for n in parts):
        raise ValueError("only documents convert")
    blocks = [(b["level"], b["text"]) for b in document_blocks(data)]
    lost = [f"part {n}" for n in sorted(parts) if re.search(r"/(?:media|embeddings|charts|BinData)/", n)]
    tables = sum(len(re.findall(rb"<\w+:tbl\b", parts[n])) for n in text_parts(list(parts)))
    return document(blocks, kind), lost + [f"tables {tables}"] * (tables > 0)


def convert(files: DataFrame, kind: str) -> DataFrame:
    """files (path, content) -> (path, content, lost, error): see converted()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    row = (path, *converted(bytes(content), kind), None)
                except (ValueError, KeyError, zipfile.BadZipFile, SyntaxError) as e:
                    row = (path, None, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["path", "content", "lost", "error"], dtype=object)

    return files.select("path", "content").mapInPandas(run, "path string, content binary, lost array<string>, error string")

