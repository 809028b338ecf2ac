"""Differences: cells of two versions, lines of texts, three-way merges, and alignment of blocks."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lazy import arrow_udf


def cell_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, before, after) of cells that differ; rows that one side lacks count for each cell they fill."""
    cells = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(name)) for c in columns])).alias("x")).select(*keys, "x.*").filter(F.col(name).isNotNull())
    both = cells(old, "before").join(cells(new, "after"), [*keys, "column"], "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def first_changes(diff: DataFrame, order: Sequence[str], limit: int = 100) -> DataFrame:
    return diff.orderBy(*order).limit(limit)


def cut_lines(text: str | None) -> list[str]:
    return (text or "").splitlines(keepends=True)


def opcodes(a: Sequence, b: Sequence) -> list[tuple[str, int, int, int, int]]:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


@arrow_udf("array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>")
def line_opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Opcodes of two texts' lines."""
    return pd.Series([[dict(zip(("tag", "i1", "i2", "j1", "j2"), op, strict=True)) for op in opcodes(cut_lines(x), cut_lines(y))] for x, y in zip(a, b, strict=True)])


@arrow_udf("double")
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T of two texts' characters; two empty ones are alike."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def unified_of(a: str | None, b: str | None) -> str:
    """With 3 lines of context and a mark for a missing line end; empty if equal."""
    if (a or "") == (b or ""):
        return ""
    out = []
    for line in difflib.unified_diff(cut_lines(a), cut_lines(b), "base", "head", n=3):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


@arrow_udf("string")
def unified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([unified_of(x, y) for x, y in zip(a, b, strict=True)])


def merge_of(base: str | None, ours: str | None, theirs: str | None) -> tuple[str | None, list[str]]:
    """(merged, conflicts): ours' changes in theirs. One of ours that overlaps or touches one of theirs conflicts, unless
    both put the same lines in the same place; conflicts are ranges of base's lines, first:last."""
    b, o, t = cut_lines(base), cut_lines(ours), cut_lines(theirs)
    changed = lambda x: [op for op in opcodes(b, x) if op[0] != "equal"]
    their_changes, kept, conflicts = changed(t), [], []
    for _, lo, hi, j1, j2 in changed(o):
        near = [c for c in their_changes if lo <= c[2] and c[1] <= hi]
        if not near:
            kept.append((lo, hi, o[j1:j2]))
        elif len(near) > 1 or near[0][1:3] != (lo, hi) or t[near[0][3] : near[0][4]] != o[j1:j2]:
            first, last = min([lo, *[c[1] for c in near]]), max([hi, *[c[2] for c in near]])
            conflicts.append(f"{first + 1}:{max(last, first + 1)}")
    if conflicts:
        return None, conflicts
    changes = sorted([*kept, *[(c[1], c[2], t[c[3] : c[4]]) for c in their_changes]], key=lambda c: (c[0], c[1]))
    out, at = [], 0
    for lo, hi, put in changes:
        out += [*b[at:lo], *put]
        at = hi
    return "".join([*out, *b[at:]]), []


@arrow_udf("struct<merged:string,conflicts:array<string>>")
def merge3(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
    rows = [merge_of(*x) for x in zip(base, ours, theirs, strict=True)]
    return pd.DataFrame({"merged": [r[0] for r in rows], "conflicts": [r[1] for r in rows]})


def align_blocks(old: Sequence[str], new: Sequence[str], like: float = 0.5) -> list[tuple[int, int, str]]:
    """(old, new, how): blocks of equal runs, then moved ones (unique on both sides), then alike ones in gaps. Each new
    block is used once."""
    out, used_old, used_new = [], set(), set()

    def put(i: int, j: int, how: str) -> None:
        out.append((i, j, how))
        used_old.add(i)
        used_new.add(j)

    ops = opcodes(old, new)
    for tag, i1, i2, j1, _ in ops:
        if tag == "equal":
            for k in range(i2 - i1):
                put(i1 + k, j1 + k, "same")
    where: dict[str, list[int]] = {}
    for j, x in enumerate(new):
        if j not in used_new:
            where.setdefault(x, []).append(j)
    free = [i for i in range(len(old)) if i not in used_old]
    for i in free:
        if len(where.get(old[i], [])) == 1 and sum(old[k] == old[i] for k in free) == 1:
            put(i, where[old[i]][0], "moved")
    for tag, i1, i2, j1, j2 in ops:
        if tag == "replace":
            for i in range(i1, i2):
                best = max(((difflib.SequenceMatcher(None, old[i], new[j], autojunk=False).ratio(), -j) for j in range(j1, j2) if j not in used_new), default=(0, 0))
                if i not in used_old and best[0] >= like:
                    put(i, -best[1], "alike")
    return sorted(out)


@arrow_udf("array<struct<old:int,new:int,how:string>>")
def aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    """Alignment of two texts' paragraphs."""
    return pd.Series([[dict(zip(("old", "new", "how"), r, strict=True)) for r in align_blocks((x or "").split("\n\n"), (y or "").split("\n\n"))] for x, y in zip(a, b, strict=True)])


def edit_of(text: str, edits: Sequence[tuple[str, str]]) -> str:
    """Each old text must stand exactly once in the text as left by the edit before; ValueError names the edit."""
    for k, (old, new) in enumerate(edits):
        at = text.find(old)
        if not old or at < 0:
            raise ValueError(f"edit {k}: no match")
        if text.find(old, at + 1) >= 0:
            raise ValueError(f"edit {k}: ambiguous")
        text = text[:at] + new + text[at + len(old) :]
    return text


def map_position(at: int, ops: Sequence[tuple], right: bool = False) -> int:
    """Where an offset goes through opcodes; inside a change to its start, or its end with right. So does an offset at
    which text comes in."""
    for tag, i1, i2, j1, j2 in ops:
        if i1 < at < i2:
            return j1 + (at - i1) if tag == "equal" else (j2 if right else j1)
        if at == i1:
            return j2 if i1 == i2 and right else j1
    return ops[-1][4] if ops else at
