"""Cell addresses as expressions: column letters, A1 ranges, and where a range goes when rows move."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.once import once

# A sheet's rows and columns.
MAX_ROW, MAX_COL = 1_048_576, 16_384


def col_letters(index: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA ... 16384 -> XFD; null outside."""

    def of(i: Column) -> Column:
        letter = lambda x: F.chr((F.lit(65) + x).cast("int"))
        low, mid, top = letter((i - 1) % 26), letter(F.floor((i - 27) / 26) % 26), letter(F.floor((i - 703) / 676) % 26)
        return F.when((i < 1) | (i > MAX_COL), None).when(i <= 26, low).when(i <= 702, F.concat(mid, low)).otherwise(F.concat(top, mid, low))

    return once(index.cast("int"), of)


def col_index(letters: Column) -> Column:
    """A -> 1 ... XFD -> 16384, in either case; null for anything else."""

    def of(up: Column) -> Column:
        digits = F.transform(F.split(up, ""), lambda c: F.ascii(c) - 64)
        value = F.aggregate(F.filter(digits, lambda d: d > 0), F.lit(0), lambda a, d: a * 26 + d)
        return once(value, lambda v: F.when(up.rlike("^[A-Z]{1,3}\\z") & (v <= MAX_COL), v))

    return once(F.upper(letters), of)


def parse_range(text: Column) -> Column:
    """struct<c0, r0, c1, r1> of A1, $A$1 or A1:B2 with its corners in order; null where it is no range of a sheet."""
    form = r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})(?::\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6}))?\z"
    part = lambda k: F.regexp_extract(text, form, k)

    def corners(p: Column) -> Column:
        first = F.struct(col_index(p["a"]).alias("c"), p["b"].try_cast("int").alias("r"))
        return once(first, lambda f: F.struct(f.alias("f"), F.when(p["c"] == "", f).otherwise(F.struct(col_index(p["c"]).alias("c"), p["d"].try_cast("int").alias("r"))).alias("l")))

    def ordered(x: Column) -> Column:
        f, last = x["f"], x["l"]
        fine = f["c"].isNotNull() & last["c"].isNotNull() & (f["r"] <= MAX_ROW) & (last["r"] <= MAX_ROW)
        return F.when(fine, F.struct(F.least(f["c"], last["c"]).alias("c0"), F.least(f["r"], last["r"]).alias("r0"), F.greatest(f["c"], last["c"]).alias("c1"), F.greatest(f["r"], last["r"]).alias("r1")))

    return once(once(F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")), corners), ordered)


def print_range(r: Column) -> Column:
    def of(x: Column) -> Column:
        ends = F.struct(F.concat(col_letters(x["c0"]), x["r0"].cast("string")).alias("a"), F.concat(col_letters(x["c1"]), x["r1"].cast("string")).alias("b"))
        return once(ends, lambda e: F.when(e["a"] == e["b"], e["a"]).otherwise(F.concat(e["a"], F.lit(":"), e["b"])))

    return once(r, of)


def intersects(a: Column, b: Column) -> Column:
    return (a["c0"] <= b["c1"]) & (b["c0"] <= a["c1"]) & (a["r0"] <= b["r1"]) & (b["r0"] <= a["r1"])


def shift_insert(r: Column, cols: tuple[int, int], at: int, n: int) -> tuple[Column, Column]:
    """(moved, range) when n rows come in at row at of the columns cols: same, to or split."""
    apart = (r["c1"] < cols[0]) | (r["c0"] > cols[1]) | (r["r1"] < at)
    inside = (r["c0"] >= cols[0]) & (r["c1"] <= cols[1]) & (r["r1"] + n <= MAX_ROW)
    to = F.struct(r["c0"].alias("c0"), F.when(r["r0"] >= at, r["r0"] + n).otherwise(r["r0"]).alias("r0"), r["c1"].alias("c1"), (r["r1"] + n).alias("r1"))
    return F.when(apart, "same").when(inside, "to").otherwise("split"), F.when(apart, r).when(inside, to)


def shift_delete(r: Column, cols: tuple[int, int], first: int, last: int) -> tuple[Column, Column]:
    """(moved, range) when rows first to last of the columns cols go: same, to, gone or split."""
    n = last - first + 1
    apart = (r["c1"] < cols[0]) | (r["c0"] > cols[1]) | (r["r1"] < first)
    inside = (r["c0"] >= cols[0]) & (r["c1"] <= cols[1])
    gone = inside & (r["r0"] >= first) & (r["r1"] <= last)
    r0 = F.when(r["r0"] < first, r["r0"]).when(r["r0"] <= last, F.lit(first)).otherwise(r["r0"] - n)
    r1 = F.when(r["r1"] <= last, F.lit(first - 1)).otherwise(r["r1"] - n)
    to = F.struct(r["c0"].alias("c0"), r0.alias("r0"), r["c1"].alias("c1"), r1.alias("r1"))
    moved = F.when(apart, "same").when(gone, "gone").when(inside, "to").otherwise("split")
    return moved, F.when(apart, r).when(inside & ~gone, to)
