"""Number formats beyond the common ones, in Arrow batches: sections, conditions, scaling, exponents, fractions, dates
and elapsed time. Common codes are shown by functions.values.display without Python."""

from __future__ import annotations

import re
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd

from tessera.functions.lazy import arrow_udf

# Built-in formats by id.
BUILTIN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 5: '"$"#,##0_);("$"#,##0)', 6: '"$"#,##0_);[Red]("$"#,##0)', 7: '"$"#,##0.00_);("$"#,##0.00)', 8: '"$"#,##0.00_);[Red]("$"#,##0.00)', 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss",
    22: "m/d/yyyy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 42: '_("$"* #,##0_);_("$"* (#,##0);_("$"* "-"_);_(@_)', 43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)',
    44: '_("$"* #,##0.00_);_("$"* (#,##0.00);_("$"* "-"??_);_(@_)', 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
LITERAL = re.compile(r'"([^"]*)"|\\(.)|_(.)|\*(.)|\[([^\]]*)\]|(General)|(AM/PM|A/P)|([yYmMdDhHsS]+(?:\.0+)?)|([0#?][0#?,.]*(?:[eE][+-][0#?]+)?|\.[0#?]+)|(%)|(.)', re.S)


def decimal15(x: float) -> Decimal:
    """A double's decimal of 15 significant digits."""
    return Decimal(f"{x:.14e}")


def rounded(x: Decimal, places: int) -> Decimal:
    return x.quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)


def general(x: float) -> str:
    """Ten digits at most from 10^-9 to 10^11, else an exponent of two digits."""
    if x == 0:
        return "0"
    d = decimal15(x)
    e = d.adjusted()
    if -9 <= e < 11:
        s = f"{rounded(d, max(0, 9 - max(e, 0))):f}"
        s = s.rstrip("0").rstrip(".") if "." in s else s
        return "0" if s == "-0" else s
    m = f"{rounded(d.scaleb(-e), 5):f}".rstrip("0").rstrip(".")
    return f"{m}E{'+' if e >= 0 else '-'}{abs(e):02d}"


def sections(code: str) -> list[str]:
    out, now, quoted, k = [], "", False, 0
    while k < len(code):
        c = code[k]
        if c == "\\" and not quoted:
            now += code[k : k + 2]
            k += 2
            continue
        quoted ^= c == '"'
        if c == ";" and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
        k += 1
    return [*out, now]


def chosen(parts: list[str], x: float) -> tuple[str, float]:
    """The section for a number, and the number as that section shows it."""
    conds = [re.search(r"\[(<=|>=|<>|<|>|=)(-?[\d.]+)\]", p) for p in parts]
    if any(conds):
        for p, c in zip(parts, conds, strict=True):
            if c is None or {"<": x < float(c[2]), ">": x > float(c[2]), "<=": x <= float(c[2]), ">=": x >= float(c[2]), "=": x == float(c[2]), "<>": x != float(c[2])}[c[1]]:
                return p, x
        return parts[-1], x
    if x < 0 and len(parts) > 1:
        return parts[1], -x
    if x == 0 and len(parts) > 2:
        return parts[2], x
    return parts[0], x


def digits(x: Decimal, pattern: str) -> str:
    """A non-negative decimal in a pattern of 0, #, ?, commas and a point."""
    scale = len(pattern) - len(pattern.rstrip(","))
    pattern = pattern.rstrip(",")
    body, _, frac = pattern.partition(".")
    x = rounded(x.scaleb(-3 * scale), len(frac))
    a, _, b = f"{x:f}".partition(".")
    least = body.count("0") + body.count("?")
    a = "" if a == "0" and least == 0 else a.rjust(least, "0" if "0" in body else " ")
    if "," in body:
        a = re.sub(r"(?<=\d)(?=(?:\d{3})+\Z)", ",", a)
    keep = len(frac.rstrip("#"))
    b = b[:keep] + b[keep:].rstrip("0")
    return a + ("." + b if "." in pattern else "")


def fraction(x: float, code: str) -> str:
    """# ?/? and the like: the nearest fraction with a denominator of so many digits, or the given one."""
    m = re.search(r"([0#?]+)\s*/\s*([0#?]+|\d+)", code)
    whole = int(x) if re.match(r"\s*[#0?]+\s", code) else 0
    rest = x - whole
    fixed = int(m[2]) if m[2].isdigit() and int(m[2]) else None
    n, d = min(((round(rest * k), k) for k in ([fixed] if fixed else range(1, 10 ** len(m[2])))), key=lambda f: (abs(f[0] / f[1] - rest), f[1]))
    if n == d and re.match(r"\s*[#0?]+\s", code):
        whole, n = whole + 1, 0
    top = f"{n}/{d}" if n or not whole else ""
    return " ".join(x for x in (str(whole) if whole else "", top) if x) or "0"


def clock(x: float, section: str, epoch_1904: bool) -> str:
    places = max([len(m) - 1 for m in re.findall(r"\.0+", section)], default=0)
    elapsed = re.search(r"\[([hms]+)\]", section, re.I)
    unit = 86400 * 10**places
    ticks = int(rounded(decimal15(x) * unit, 0))
    day, rest = divmod(ticks, unit)
    secs, part = divmod(rest, 10**places)
    h, mi, s = secs // 3600, secs // 60 % 60, secs % 60
    if epoch_1904:
        civil = date(1904, 1, 1) + timedelta(days=day)
        y, mo, d = civil.year, civil.month, civil.day
    elif day == 60:
        civil, (y, mo, d) = date(1900, 2, 28), (1900, 2, 29)
    else:
        civil = date(1899, 12, 30) + timedelta(days=day + (day < 60))
        y, mo, d = (1900, 1, 0) if day == 0 else (civil.year, civil.month, civil.day)
    half = re.search("AM/PM|A/P", section, re.I)
    items = [m for m in LITERAL.finditer(section)]
    names = [(m[8] or m[5] or "").lower() for m in items]
    out = []
    for k, m in enumerate(items):
        token = m[8].lower() if m[8] else None
        if m[1] is not None or m[2] or m[11] or m[10]:
            out.append(m[1] or m[2] or m[11] or m[10] or "")
        elif m[3]:
            out.append(" ")
        elif m[7]:
            out.append(("AM", "PM")[h >= 12] if len(m[7]) > 3 else ("A", "P")[h >= 12])
        elif m[5] and elapsed and m[5].lower() == elapsed[1].lower():
            total = {"h": ticks // (3600 * 10**places), "m": ticks // (60 * 10**places), "s": ticks // 10**places}[m[5][0].lower()]
            out.append(str(total).zfill(len(m[5])))
        elif token:
            before = next((n for n in reversed(names[:k]) if n and n[0] in "hmsyd"), "")
            after = next((n for n in names[k + 1 :] if n and n[0] in "hmsyd"), "")
            letter = token[0]
            if letter == "m" and (before.startswith("h") or after.startswith("s")):
                out.append(str(mi).zfill(min(2, len(token))))
            elif letter == "m":
                out.append({1: str(mo), 2: f"{mo:02d}", 3: MONTHS[mo - 1][:3], 5: MONTHS[mo - 1][0]}.get(len(token), MONTHS[mo - 1]))
            elif letter == "y":
                out.append(f"{y % 100:02d}" if len(token) <= 2 else str(y))
            elif letter == "d":
                name = DAYS[(day + 5 + (day < 60 and not epoch_1904) * 0) % 7] if not epoch_1904 else DAYS[civil.weekday()]
                out.append({1: str(d), 2: f"{d:02d}", 3: name[:3]}.get(len(token), name))
            elif letter == "h":
                out.append(str((h % 12 or 12) if half else h).zfill(min(2, len(token))))
            else:
                body = token.partition(".")[0]
                out.append(str(s).zfill(min(2, len(body))) + (f".{part:0{places}d}" if "." in token else ""))
    return "".join(out)


def shown(x: float | None, code: str, epoch_1904: bool = False) -> str | None:
    """A number as a format shows it; dates before the epoch or after 9999 show as #."""
    if x is None or x != x:
        return None
    if not code or code.lower() == "general":
        return general(x)
    section, y = chosen(sections(code), x)
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.', "", section)
    if re.search(r"[ymdhs]", re.sub(r"\[(?![hms]+\])[^\]]*\]", "", bare, flags=re.I), re.I) and not re.search("General", bare, re.I):
        return "#" if y < 0 or y >= (2957004 if epoch_1904 else 2958466) else clock(y, section, epoch_1904)
    if "/" in bare and re.search(r"[0#?]\s*/\s*[0-9#?]", bare):
        return ("-" if y < 0 else "") + fraction(abs(y), bare.strip())
    sign, d, percent, out, used = ("-" if y < 0 else ""), abs(decimal15(y)), bare.count("%"), [], False
    d = d.scaleb(2 * percent)
    for m in LITERAL.finditer(section):
        if m[1] is not None or m[2]:
            out.append(m[1] if m[1] is not None else m[2])
        elif m[3]:
            out.append(" ")
        elif m[6]:
            out.append(general(abs(y)))
            used = True
        elif m[9]:
            if used:
                continue
            used = True
            if e := re.search(r"[eE]([+-])([0#?]+)$", m[9]):
                mantissa = m[9][: e.start()]
                step = max(1, len(mantissa.partition(".")[0].replace(",", "")))
                power = 0 if d == 0 else d.adjusted() // step * step
                if d and rounded(d.scaleb(-power), len(mantissa.partition(".")[2])) >= Decimal(10) ** step:
                    power += step
                out.append(f"{digits(d.scaleb(-power), mantissa)}E{'-' if power < 0 else '+' if e[1] == '+' else ''}{abs(power):0{len(e[2])}d}")
            else:
                out.append(digits(d, m[9]))
        elif m[10] or m[11]:
            out.append(m[10] or m[11].replace("@", general(abs(y))))
    text = "".join(out)
    return sign + text if re.search(r"[1-9]", text) or not used else text


@arrow_udf("string")
def display(x: pd.Series, code: pd.Series) -> pd.Series:
    """Numbers shown by a column of format codes."""
    return pd.Series([shown(None if pd.isna(v) else float(v), c or "General") for v, c in zip(x, code, strict=True)])
