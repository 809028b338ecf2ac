"""Lengths, angles, colours, attribute lists, scripts, escapes and pictures' kinds."""

from __future__ import annotations

import colorsys
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lazy import arrow_udf

# English metric units of a point, and 60,000ths of a degree in a full turn.
EMU_PER_PT, FULL_TURN = 12_700, 21_600_000
# Theme colours by name.
THEME = "tx1|bg1|tx2|bg2|accent1|accent2|accent3|accent4|accent5|accent6|hlink|folHlink|dk1|lt1|dk2|lt2"
# Hangul syllables, letters and their extensions; further East Asian letters, marks and full-width forms.
HANGUL = r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}"
EAST_ASIAN = HANGUL + r"\x{2E80}-\x{312F}\x{3190}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}"


def length_text(hundredths: Column) -> Column:
    """Hundredths of a point as 0.34pt, 20pt, -58.9pt."""
    a = F.abs(hundredths)
    shown = F.format_string("%d.%02d", F.floor(a / 100), F.pmod(a, F.lit(100)))
    return F.concat(F.when(hundredths < 0, "-").otherwise(""), F.regexp_replace(shown, r"\.00\z|(?<=\.\d)0\z", ""), F.lit("pt"))


def parse_length(text: Column, negative: bool = False) -> Column:
    """A length in hundredths of a point, rounded; null if it is none, or negative where that isn't allowed."""
    ok = text.rlike(rf"^\s*{'-?' if negative else ''}\d+(?:\.\d+)?\s*(?:pt)?\s*\z")
    x = F.regexp_extract(text, r"(-?[\d.]+)", 1).try_cast("double")
    return F.when(ok & (F.abs(x) < 1e7), F.round(x * 100).cast("long"))


def points(emu: Column) -> Column:
    """Whole points, halves away from zero."""
    return F.round(emu / EMU_PER_PT).cast("long")


def kept_emu(stored: Column, written: Column) -> Column:
    """written, unless it is just how stored is shown: then stored keeps its exact value."""
    return F.when(points(stored) * EMU_PER_PT == written, stored).otherwise(written)


def same_turn(a: Column, b: Column) -> Column:
    return F.pmod(a - b, F.lit(FULL_TURN)) == 0


def colour(text: Column) -> Column:
    """struct<base, tint, alpha> of #RRGGBB, or of a theme colour lighter (+) or darker (-) by a percent, each with an
    opacity after a slash; alpha is null if opaque. Null if it is no colour."""
    t = F.trim(text)
    shape = rf"^(?:#([0-9A-Fa-f]{{6}})|({THEME})(?:([+-][1-9]\d?)%)?)(?:/(100|\d\d?)%)?\z"
    part = lambda k: F.regexp_extract(t, shape, k)
    alpha = F.when((part(4) != "") & (part(4) != "100"), part(4).try_cast("int"))
    base = F.when(part(1) != "", F.concat(F.lit("#"), F.upper(part(1)))).otherwise(part(2))
    return F.when(t.rlike(shape), F.struct(base.alias("base"), F.coalesce(part(3).try_cast("int"), F.lit(0)).alias("tint"), alpha.alias("alpha")))


def tinted_of(rgb: str, tint: float) -> str:
    """#RRGGBB with its luminance moved towards white by a share (above 0) or towards black (below)."""
    h, light, s = colorsys.rgb_to_hls(*(int(rgb[k : k + 2], 16) / 255 for k in (1, 3, 5)))
    light = light + (1 - light) * tint if tint > 0 else light * (1 + tint)
    return "#" + "".join(f"{int(c * 255 + 0.5):02X}" for c in colorsys.hls_to_rgb(h, light, s))


@arrow_udf("string")
def tinted(rgb: pd.Series, tint: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or t is None else tinted_of(c, t) for c, t in zip(rgb, tint, strict=True)], dtype=object)


#: A key with its value, bare or in quotes, or a flag alone.
ATTRIBUTE = r"""([A-Za-z0-9_-]+)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"']+))|(?=\s|\z))"""


def attributes(text: Column) -> Column:
    """array<struct<key, value>> of key=value pairs and flags (value null); null if the text is something else."""
    part = lambda k: F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(k))
    plain = lambda v: F.replace(F.replace(F.replace(v, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    pairs = F.transform(
        F.arrays_zip(part(0).alias("all"), part(1).alias("key"), part(2).alias("a"), part(3).alias("b"), part(4).alias("c")),
        lambda x: F.struct(x["key"].alias("key"), F.when(F.contains(x["all"], F.lit("=")), plain(F.concat(x["a"], x["b"], x["c"]))).alias("value")),
    )
    return F.when(text.rlike(rf"^\s*(?:{ATTRIBUTE}\s*)*\z"), pairs)


def quoted(value: Column) -> Column:
    """A value as attributes() reads it back."""
    esc = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    return F.when((value == "") | value.rlike(r"[\s{}\"'<>:]"), F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(value)


def script(text: Column) -> Column:
    """latin, or hangul where East Asian text holds any, or cjk."""
    return F.when(~text.rlike(f"[{EAST_ASIAN}]"), "latin").when(text.rlike(f"[{HANGUL}]"), "hangul").otherwise("cjk")


def script_runs(text: Column) -> Column:
    """array<string>: runs of East Asian letters and of all else, in order."""
    return F.regexp_extract_all(text, F.lit(f"[{EAST_ASIAN}]+|[^{EAST_ASIAN}]+"), F.lit(0))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of an offset in bytes."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int"))
    return F.regexp_count(head.cast("string"), F.lit("\n")) + 1


# The entities of XML.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def xml_plain(text: str) -> str:
    """The five named entities and numeric references; others stay as they are."""

    def one(m: re.Match) -> str:
        if m[1]:
            return NAMED[m[1]]
        code = int(m[2], 16) if m[2] else int(m[3])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&(?:(amp|lt|gt|quot|apos)|#x([0-9A-Fa-f]{1,6})|#([0-9]{1,7}));", one, text)


def excel_plain(text: str) -> str:
    """_xHHHH_ escapes decoded, two halves of a pair as one letter, half a pair alone as U+FFFD."""
    units = re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def excel_escaped(text: str) -> str:
    """Control characters, and what would read as an escape, as _xHHHH_."""
    safe = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return re.sub(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", safe)


def _by_row(f, kind: str):
    return arrow_udf(kind)(lambda s: pd.Series([None if x is None else f(x) for x in s], dtype=object))


xml_unescape, excel_unescape, excel_escape = (_by_row(f, "string") for f in (xml_plain, excel_plain, excel_escaped))


def picture_of(data: bytes) -> dict | None:
    """Kind, width and height of a picture, from its first bytes; a JPEG's frame header is looked for."""
    out = lambda kind, w=None, h=None: {"kind": kind, "width": w, "height": h}
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return out("png", *struct.unpack(">II", data[16:24])) if len(data) >= 24 else out("png")
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return out("gif", *struct.unpack("<HH", data[6:10])) if len(data) >= 10 else out("gif")
    if data[:2] == b"BM":
        return out("bmp", *(abs(x) for x in struct.unpack("<ii", data[18:26]))) if len(data) >= 26 else out("bmp")
    if data[:4] in (b"II*\0", b"MM\0*"):
        return out("tiff")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return out("webp")
    if data[:4] == b"\x01\0\0\0" and data[40:44] == b" EMF":
        return out("emf")
    if data[:4] == b"\xd7\xcd\xc6\x9a":
        return out("wmf")
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return out("jpeg", w, h)
            at += 2 + size
        return out("jpeg")
    return out("svg") if re.match(rb"\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<svg\b", data[:1024], re.S) else None


@arrow_udf("struct<kind:string,width:long,height:long>")
def picture(data: pd.Series) -> pd.DataFrame:
    rows = [picture_of(bytes(x)) if x is not None else None for x in data]
    return pd.DataFrame([r or dict.fromkeys(("kind", "width", "height")) for r in rows], columns=["kind", "width", "height"]).astype({"kind": object, "width": "Int64", "height": "Int64"})
