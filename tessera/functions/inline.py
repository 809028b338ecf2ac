"""Inline marks of a paragraph: bold, italic, struck and underlined text, links, notes, math, breaks, comments, placeholders."""

from __future__ import annotations

import re

import pandas as pd

from tessera.functions.lazy import arrow_udf

# The marks of canonical text.
MARKS = {"**": "bold", "*": "italic", "~~": "strike", "<u>": "underline", "</u>": "underline"}
NAMES = ("bold", "italic", "strike", "underline")
TOKEN = re.compile(
    r"""\\(?P<escaped>[!-/:-@\[-`{-~])|(?P<mark>\*\*|\*|~~|</?u>)|(?P<br><br\s*/?>)|<(?P<tag>comment|ins|del|math)\b[^>]*>(?P<body>.*?)</(?P=tag)>"""
    r"""|<b?keep\b[^>]*?\bid="(?P<keep>[^"]*)"[^>]*/>|\[\^(?P<note>[^\]\s]+)\]|\$(?P<math>(?=\S)(?:\\.|[^\\$])*?(?:\\.|[^\\$\s]))\$(?!\d)"""
    r"""|\[(?P<label>(?:\\.|[^\\\[\]])*)\]\((?P<url>[^()\s]*)\)|(?P<plain>[^\\*~<\[$]+|.)""",
    re.S,
)
UNITS = "array<struct<kind:string,text:string,marks:string,url:string>>"


def parsed(text: str | None) -> tuple[list[tuple[str, str, str, str | None]], list[tuple[int, str]]]:
    """(units, problems). A unit is (kind, text, marks, url): text with equal marks as one unit, or an atom (break, note,
    math, comment, ins, del, keep). marks are names, comma-joined. A mark that nothing closes is a problem, at its
    column from 1, as is a closing tag that nothing opened. An asterisk between spaces is itself."""
    text = text or ""
    units: list[tuple[str, str, str, str | None]] = []
    problems: list[tuple[int, str]] = []

    def put(kind: str, body: str, on: dict[str, int], url: str | None) -> None:
        marks = ",".join(n for n in NAMES if n in on)
        if kind == "text" and units and units[-1][0] == "text" and units[-1][2:] == (marks, url):
            body = units.pop()[1] + body
        if body or kind != "text":
            units.append((kind, body, marks, url))

    def walk(source: str, base: int, on: dict[str, int], url: str | None) -> None:
        for m in TOKEN.finditer(source):
            at, kind = base + m.start() + 1, m.lastgroup
            if kind == "mark":
                token, name = m["mark"], MARKS[m["mark"]]
                alone = token[0] in "*~" and source[m.start() - 1 : m.start()].strip() == "" and source[m.end() : m.end() + 1].strip() == ""
                if alone:
                    put("text", token, on, url)
                elif token == "</u>" and name not in on:
                    problems.append((at, "</u> closes nothing"))
                elif name in on and token != "<u>":
                    del on[name]
                else:
                    on[name] = at
            elif kind == "body":
                put(m["tag"], m["body"], on, url)
            elif kind == "url":
                walk(m["label"], base + m.start("label"), on, m["url"])
            elif kind == "br":
                put("break", "", on, url)
            elif kind in ("note", "math", "keep"):
                put(kind, m[kind], on, url)
            else:
                put("text", m["escaped"] or m["plain"], on, url)

    open_: dict[str, int] = {}
    walk(text, 0, open_, None)
    problems += [(at, f"{name} is not closed") for name, at in open_.items()]
    return units, sorted(problems)


def written(units: list[tuple[str, str, str, str | None]]) -> str:
    """Canonical text of units; parsed() gives them back."""
    out, on = [], []
    shown = {"bold": ("**", "**"), "italic": ("*", "*"), "strike": ("~~", "~~"), "underline": ("<u>", "</u>")}

    def turn(want: list[str]) -> None:
        while on and (on[-1] not in want or any(n not in want for n in on)):
            out.append(shown[on.pop()][1])
        for n in want:
            if n not in on:
                on.append(n)
                out.append(shown[n][0])

    for kind, body, marks, url in units:
        turn([n for n in NAMES if n in marks.split(",")])
        atom = {"break": "<br/>", "note": f"[^{body}]", "math": f"${body}$", "keep": f'<keep id="{body}"/>'}.get(kind) or f"<{kind}>{body}</{kind}>"
        piece = re.sub(r"([\\*~<\[\]$])", r"\\\1", body) if kind == "text" else atom
        out.append(f"[{piece}]({url})" if url is not None else piece)
    turn([])
    return "".join(out)


@arrow_udf(UNITS)
def units(text: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "text", "marks", "url"), u, strict=True)) for u in parsed(x)[0]] for x in text])


@arrow_udf("array<struct<column:int,problem:string>>")
def problems(text: pd.Series) -> pd.Series:
    return pd.Series([[{"column": c, "problem": p} for c, p in parsed(x)[1]] for x in text])


def plain(text: str | None) -> str:
    """The text of units without marks and atoms; a break is a line end."""
    return "".join(body if kind == "text" else "\n" if kind == "break" else "" for kind, body, _, _ in parsed(text)[0])


@arrow_udf("string")
def plain_text(text: pd.Series) -> pd.Series:
    return pd.Series([plain(x) for x in text])
