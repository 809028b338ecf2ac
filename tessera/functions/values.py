"""Cell values, dates as serials, display formats and codecs, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cell of a mixed column. tag is number, text, boolean, error or empty.
CELL = "struct<tag:string,num:double,str:string,bool:boolean,err:string>"

# Error literals of cells.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA", "#SPILL!", "#CALC!", "#FIELD!")


def cell(num: Column | None = None, text: Column | None = None, flag: Column | None = None, err: Column | None = None) -> Column:
    """A cell of the first argument that isn't null."""
    num, text, flag, err = (F.lit(None) if x is None else x for x in (num, text, flag, err))
    tag = F.when(err.isNotNull(), "error").when(num.isNotNull(), "number").when(text.isNotNull(), "text").when(flag.isNotNull(), "boolean").otherwise("empty")
    return F.struct(tag.alias("tag"), num.cast("double").alias("num"), text.cast("string").alias("str"), flag.cast("boolean").alias("bool"), err.cast("string").alias("err"))


def to_number(c: Column) -> Column:
    """A cell as struct<num, err>: empty is 0, booleans 0 or 1, numeric text converts, other text is #VALUE!."""
    num = F.when(c["tag"] == "empty", 0.0).when(c["tag"] == "boolean", c["bool"].cast("double")).when(c["tag"] == "number", c["num"]).when(c["tag"] == "text", c["str"].try_cast("double"))
    return F.struct(num.alias("num"), F.when(c["tag"] == "error", c["err"]).when(num.isNull(), "#VALUE!").alias("err"))


def sort_keys(c: Column, descending: bool = False) -> list[Column]:
    """Order of cells: numbers, texts (lower case), booleans, errors, reversed by descending; empties last either way."""
    rank = F.when(c["tag"] == "number", 0).when(c["tag"] == "text", 1).when(c["tag"] == "boolean", 2).otherwise(3)
    keys = [rank, c["num"], F.lower(c["str"]), c["bool"]]
    return [F.when(c["tag"] == "empty", 1).otherwise(0).asc(), *(k.desc() if descending else k.asc() for k in keys)]


def serial_of(day: Column, epoch_1904: bool = False) -> Column:
    """A date's serial. The 1900 system counts a 29 February 1900 that never was, so serials below 61 are one less."""
    if epoch_1904:
        return F.datediff(day, F.lit("1904-01-01").cast("date")).cast("double")
    n = F.datediff(day, F.lit("1899-12-30").cast("date"))
    return F.when(n < 61, n - 1).otherwise(n).cast("double")


def date_text(serial: Column, epoch_1904: bool = False) -> Column:
    """yyyy-mm-dd of a serial; serial 60 of the 1900 system shows the day that never was; null out of range."""
    n = F.floor(serial).cast("int")
    if epoch_1904:
        return F.when((n >= 0) & (n <= 2957003), F.date_format(F.date_add(F.lit("1904-01-01").cast("date"), n), "yyyy-MM-dd"))
    shown = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.when(n < 60, n + 1).otherwise(n)), "yyyy-MM-dd")
    return F.when(n == 60, "1900-02-29").when((n >= 0) & (n <= 2958465), shown)


def iso_date(text: Column) -> Column:
    """The date of YYYY-MM-DD or YYYY-MM in 1900 to 9999, digits exact; else null."""
    full = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}\z"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text)
    return F.when(F.substring(text, 1, 4) >= "1900", full.try_cast("date"))


def number_of(text: Column) -> Column:
    """1,234 and 92.3% and 00417 and -5 as numbers; null for other text."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), "%$", "")
    value = F.when(body.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?\z"), body.try_cast("double"))
    return F.when(F.trim(text).endswith("%"), value / 100).otherwise(value)


def round15(x: Column, places: int) -> Column:
    """Half away from zero on the decimal of 15 significant digits, as sheets round."""
    digits = F.format_string("%.14e", F.abs(x)).cast("decimal(38,18)")
    return F.when(x < 0, -1.0).otherwise(1.0) * F.round(digits, places).cast("double")


def display(x: Column, code: str) -> Column:
    """A number in one of the common formats; others raise ValueError (see functions.numfmt for the long tail)."""
    if code in ("#,##0", "#,##0.0", "#,##0.00"):
        places = len(code.partition(".")[2])
        return F.format_number(round15(x, places), places)
    if code in ("0", "0.0", "0.00"):
        places = len(code.partition(".")[2])
        return F.format_string(f"%.{places}f", round15(x, places))
    if code in ("0%", "0.0%"):
        places = len(code.partition(".")[2].rstrip("%"))
        return F.concat(F.format_string(f"%.{places}f", round15(x * 100, places)), F.lit("%"))
    if set(code) == {"0"}:
        return F.concat(F.when(round15(x, 0) < 0, "-").otherwise(""), F.lpad(F.abs(round15(x, 0)).cast("decimal(38,0)").cast("string"), len(code), "0"))
    if code == "yyyy-mm-dd":
        return date_text(x)
    if code == "yyyy-mm":
        return F.substring(date_text(x), 1, 7)
    if code == "@":
        return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))
    raise ValueError(f"not a common format: {code}")


def format_kind(code: Column) -> Column:
    """General, Text, Date or Number, from the code's first section without literals."""
    first = F.lower(F.regexp_replace(F.regexp_replace(F.split_part(code, F.lit(";"), F.lit(1)), r'"[^"]*"|\\.', ""), r"\[(?:[^hms\]][^\]]*)\]", ""))
    return F.when(first.isin("general", ""), "General").when(first == "@", "Text").when(first.rlike("[ymdhs]"), "Date").otherwise("Number")


def escape_cell(text: Column) -> Column:
    """A cell's text in a pipe table."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"\|", r"\\|"), "\n", "<br>")


def escape_xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(name: Column) -> Column:
    """Letters, digits and _ of a file's stem in lower case, other runs as -, 40 characters, doc if none is left."""
    stem = F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*\z", "")), r"[^\p{L}\p{N}_]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(stem, r"^-+", ""), 1, 40), r"-+\z", "")
    return F.when(cut == "", "doc").otherwise(cut)


def overlay(base: Column, own: Column) -> Column:
    """A property map over another: own keys win."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(base), lambda e: ~F.map_contains_key(own, e["key"])), F.map_entries(own)))


def map_minus(own: Column, base: Column) -> Column:
    """The keys of own whose value base doesn't have."""
    return F.map_filter(own, lambda k, v: ~v.eqNullSafe(F.try_element_at(base, k)))


def occurrences(text: Column, part: str) -> Column:
    """0-based starts of part in text, overlapping ones too."""
    import re

    pieces = F.split(text, f"(?={re.escape(part)})", -1)  # cut before each occurrence
    sizes = F.transform(pieces, lambda x: F.char_length(x))
    none = F.array().cast("array<int>")
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    starts = F.aggregate(sizes, first, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    return F.when(text.contains(part), F.when(text.startswith(part), starts).otherwise(F.slice(starts, 2, 1 << 30))).otherwise(F.when(text.isNotNull(), none))


def occurrence_count(text: Column, part: str) -> Column:
    """How many occurrences() there are."""
    import re

    pieces = F.size(F.split(text, f"(?={re.escape(part)})", -1))
    return F.when(text.contains(part), F.when(text.startswith(part), pieces).otherwise(pieces - 1)).otherwise(F.when(text.isNotNull(), 0)).cast("long")
