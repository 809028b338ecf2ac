"""Characters a reader can't see or tell apart."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that are told by a word for their kind.
KINDS = (
    ("control", ((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F))),
    ("format", ((0x206A, 0x206F),)),
    ("interlinear annotation", ((0xFFF9, 0xFFFB),)),
    ("noncharacter", ((0xFDD0, 0xFDEF), *((p << 16 | 0xFFFE, p << 16 | 0xFFFF) for p in range(17)))),
    ("private use", ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))),
    ("tag", ((0xE0000, 0xE007F),)),
    ("variation selector", ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))),
)
# Code points that are told by their own names, which the Unicode database has but for three controls.
NAMED = ((0x09, 0x09), (0x0D, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x2066, 0x2069), (0x3000, 0x3000), (0x3164, 0x3164), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFFC, 0xFFFD))
CONTROLS = {0x09: "CHARACTER TABULATION", 0x0D: "CARRIAGE RETURN", 0x85: "NEXT LINE"}


def _usual() -> str:
    """The class of all other characters. Those that texts are made of come first, so that most are told by one test."""
    out, at = [], 0
    for a, b in sorted([*NAMED, *(r for _, ranges in KINDS for r in ranges)]):
        if at < a:
            out.append((at, a - 1))
        at = b + 1
    out.sort(key=lambda r: (r[0] != 0x20, r))
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


PATTERN = f"[^{_usual()}]"


def name_of(char: str) -> str | None:
    """What an unusual character is called; null for any other."""
    code = ord(char)
    for kind, ranges in KINDS:
        if any(a <= code <= b for a, b in ranges):
            return kind
    if any(a <= code <= b for a, b in NAMED):
        return CONTROLS.get(code) or unicodedata.name(char)
    return None


def unusual(text: Column) -> Column:
    """The unusual characters of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))


def shown(text: Column) -> Column:
    """A text with each unusual character as its code point and name between angle brackets."""
    named = [chr(c) for a, b in NAMED for c in range(a, b + 1)]
    names = F.create_map(*[F.lit(x) for c in named for x in (c, name_of(c))])

    def label(c: Column) -> Column:
        code = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 16)
        kinds = [F.when(c.rlike("^[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + r"]\z"), F.lit(kind)) for kind, ranges in KINDS]
        return F.concat(F.lit("\u27e8U+"), F.when(F.length(code) < 4, F.lpad(code, 4, "0")).otherwise(code), F.lit(" "), F.coalesce(F.try_element_at(names, c), *kinds), F.lit("\u27e9"))

    between = F.split(text, PATTERN, -1)
    pieces = F.transform(between, lambda x, i: F.concat(F.when(i > 0, label(F.get(unusual(text), i - 1))).otherwise(""), x))
    return F.when(text.rlike(PATTERN), F.array_join(pieces, "")).otherwise(text)


def folded(text: Column) -> Column:
    """A text with unusual spaces as spaces and other unusual characters taken out, for a second search."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\t]", " "), PATTERN, "")
