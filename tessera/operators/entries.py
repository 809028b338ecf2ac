"""Entries that stand at places of a text: ids, placement through edits, order, composition, budgets."""

from __future__ import annotations

import difflib
import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lazy import arrow_udf
from tessera.operators.revisions import fnv1a

# Bytes of a picture or a page, and of a document's pictures, at most.
PAGE_BYTES, DOCUMENT_BYTES = 64 << 20, 1 << 30
OPS = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"


def short_id(fingerprint: str) -> str:
    """k and four digits to base 32, the hash's lowest five bits first."""
    h = fnv1a(fingerprint.encode())
    return "k" + "".join("0123456789abcdefghijklmnopqrstuv"[h >> 5 * k & 31] for k in range(4))


@arrow_udf("string")
def short(fingerprint: pd.Series) -> pd.Series:
    known = {x: short_id(x) for x in set(fingerprint) if x is not None}
    return fingerprint.map(known.get)


def keep_ids(objects: DataFrame, by: str = "doc_id", seq: str = "seq", fp: str = "fp") -> DataFrame:
    """objects with keep_id, the same at each reading: the second object of an id in a document gets -2, the next -3."""
    nth = F.row_number().over(Window.partitionBy(by, "short_").orderBy(seq))
    return objects.withColumn("short_", short(fp)).withColumn("keep_id", F.concat("short_", F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(""))).drop("short_")


def word_changes(a: str | None, b: str | None) -> list[dict]:
    """Opcodes of two texts in characters, by their words and single white-space characters. What both begin and end with
    is set aside first, and white space starts no match of its own, so cost follows the words between."""
    x, y = (re.findall(r"\s|\S+", t or "") for t in (a, b))
    n, lo, hi = min(len(x), len(y)), 0, 0
    while lo < n and x[lo] == y[lo]:
        lo += 1
    while hi < n - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    mid = difflib.SequenceMatcher(str.isspace, x[lo : len(x) - hi], y[lo : len(y) - hi], autojunk=False).get_opcodes()
    ops = [("equal", 0, lo, 0, lo), *((t, *(k + lo for k in at)) for t, *at in mid), ("equal", len(x) - hi, len(x), len(y) - hi, len(y))]
    at, to = ([0, *itertools.accumulate(map(len, words))] for words in (x, y))
    return [{"tag": t, "i1": at[i1], "i2": at[i2], "j1": to[j1], "j2": to[j2]} for t, i1, i2, j1, j2 in ops if i1 < i2 or j1 < j2]


@arrow_udf(OPS)
def changes(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([word_changes(x, y) for x, y in zip(a, b, strict=True)])


def moved(at: Column, ops: Column, right: bool) -> Column:
    """Where an offset goes through opcodes. Inside a change, or where text comes in: to its start, or its end with right."""

    def through(o: Column) -> Column:
        return F.when(o["tag"] == "equal", o["j1"] + at - o["i1"]).otherwise(o["j2"] if right else o["j1"])

    inside = F.filter(ops, lambda o: (o["i1"] < at) & (at < o["i2"]))
    on = F.filter(ops, lambda o: (o["i1"] == at) | (o["i2"] == at))
    edge = F.when(F.size(on) == 0, at)
    edge = edge.when(F.lit(right), F.array_max(F.transform(on, lambda o: F.when(o["i1"] == o["i2"], o["j2"]).when(o["i1"] == at, o["j1"]).otherwise(o["j2"]))))
    edge = edge.otherwise(F.array_min(F.transform(on, lambda o: F.when(o["i1"] == at, o["j1"]).otherwise(o["j2"]))))
    return F.when(F.size(inside) > 0, through(F.get(inside, F.lit(0)))).otherwise(edge)


def placed(entries: DataFrame, versions: DataFrame, by: str = "doc_id") -> DataFrame:
    """entries (by, id, start, end), versions (by, old, new) -> (by, id, status, start, end): placed where its text went,
    or removed with it (start and end null). A start leans right and an end left, so an entry never takes in what was
    written beside it; an empty entry is a marker, goes with its place and is never removed."""
    ops = versions.select(by, changes("old", "new").alias("ops_"))
    rows = entries.join(ops, by)
    marker = F.col("start") == F.col("end")
    to = rows.withColumn("a_", moved(F.col("start"), F.col("ops_"), True)).withColumn("b_", F.when(marker, F.col("a_")).otherwise(moved(F.col("end"), F.col("ops_"), False)))
    gone = ~marker & (F.col("a_") >= F.col("b_"))
    return to.select(by, "id", F.when(gone, "removed").otherwise("placed").alias("status"), F.when(~gone, F.col("a_")).alias("start"), F.when(~gone, F.col("b_")).alias("end"))


def in_order(markers: DataFrame, by: str = "doc_id") -> DataFrame:
    """markers (by, para, start, seq, to_para, to_start) with to_para, to_start such that no marker of a paragraph lands
    before one that preceded it: it goes where that one went. A running maximum."""
    up = Window.partitionBy(by, "para").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rest = [F.col(c) for c in markers.columns if c not in ("to_para", "to_start")]
    return markers.withColumn("top_", F.max(F.struct("to_para", "to_start")).over(up)).select(*rest, "top_.to_para", "top_.to_start")


def composed(first: DataFrame, then: DataFrame, by: str = "doc_id") -> DataFrame:
    """Maps (by, old, new) of two revisions in a row as one: what the second doesn't keep goes."""
    a, b = first.select(by, "old", F.col("new").alias("mid_")), then.select(by, F.col("old").alias("mid_"), "new")
    return a.join(b, [by, "mid_"]).select(by, "old", "new")


def trim_of(old: str | None, new: str | None) -> tuple[int, str, str]:
    """(start, old, new): the span without the words that both begin and end with."""
    x, y = (re.findall(r"\s|\S+", t or "") for t in (old, new))
    n, lo, hi = min(len(x), len(y)), 0, 0
    while lo < n and x[lo] == y[lo]:
        lo += 1
    while hi < n - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    return sum(map(len, x[:lo])), "".join(x[lo : len(x) - hi]), "".join(y[lo : len(y) - hi])


@arrow_udf("struct<start:int,old:string,new:string>")
def trimmed(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([trim_of(a, b) for a, b in zip(old, new, strict=True)], columns=["start", "old", "new"])


def tracked(versions: DataFrame, author: str, by: str = "doc_id") -> DataFrame:
    """versions (by, old, new) -> (by, n, op, author, at, text): a row for each deletion (at an offset of old) and
    insertion (at one of new), as a file with tracked changes tells them."""
    rows = versions.select(by, "old", "new", F.posexplode(changes("old", "new")).alias("n", "o")).filter("o.tag <> 'equal'")
    part = lambda op, text, a, b: F.struct(F.lit(op).alias("op"), F.col(f"o.{a}").alias("at"), F.substring(F.col(text), F.col(f"o.{a}") + 1, F.col(f"o.{b}") - F.col(f"o.{a}")).alias("text"))
    both = F.filter(F.array(part("del", "old", "i1", "i2"), part("ins", "new", "j1", "j2")), lambda x: x["text"] != "")
    return rows.select(by, "n", F.explode(both).alias("x")).select(by, "n", "x.op", F.lit(author).alias("author"), "x.at", "x.text")


def within_budget(pictures: DataFrame, by: str = "doc_id", page_bytes: int = PAGE_BYTES, document_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """pictures (by, page, seq, bytes) with shown: one over a page's budget never is; of the others, those are with
    which the sum so far, in order, is within the page's budget and the document's. Sums count those that aren't shown."""
    fits = F.col("bytes") <= page_bytes
    own = F.when(fits, F.col("bytes")).otherwise(0)
    up = lambda *keys: F.sum(own).over(Window.partitionBy(*keys).orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return pictures.withColumn("shown", fits & (up(by, "page") <= page_bytes) & (up(by) <= document_bytes))


# White space of any kind, and characters that don't show.
SPACE, UNSEEN = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", r"\u00ad\u200b-\u200f\u2060-\u2064\ufeff"


def near_miss_of(text: str | None, part: str | None) -> int | None:
    """The line, from 1, where part begins if kinds of white space and unseen characters are ignored though it doesn't
    stand in text as it is; else where it does if all white space is. None if nowhere, or if it stands as it is."""
    text, part = text or "", part or ""
    words = [w for w in (re.sub(f"[{UNSEEN}]", "", w) for w in re.split(f"[{SPACE}]+", part)) if w]
    if part in text or not words:
        return None
    for within, between in ((f"[{UNSEEN}]*", f"[{UNSEEN}]*[{SPACE}][{SPACE}{UNSEEN}]*"), (f"[{SPACE}{UNSEEN}]*",) * 2):
        m = re.search(between.join(within.join(map(re.escape, w)) for w in words), text)
        if m:
            return text.count("\n", 0, m.start()) + 1
    return None


@arrow_udf("int")
def near_miss(text: pd.Series, part: pd.Series) -> pd.Series:
    return pd.Series([near_miss_of(a, b) for a, b in zip(text, part, strict=True)], dtype="Int32")
