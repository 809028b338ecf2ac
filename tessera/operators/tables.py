"""Range operations on a table whose rows have a position: set, append, insert, delete, types, columns, sort, catalogue.

Position is a column, pos. Where a table has many documents or sheets, pass their keys as by, so that renumbering runs
within them and no single task sorts everything.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import number_of, sort_keys
from tessera.sources.shared import stored


class Refused(ValueError):
    """Operations that can't all be applied; nothing is. problems has each with the index of its operation."""

    def __init__(self, problems: list[tuple[int, str]]) -> None:
        super().__init__("; ".join(f"op {i}: {what}" for i, what in problems))
        self.problems = problems


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """df with pos, from 1, by order within by. Without by rows are sorted by ranges, and each range counts on from those
    before it, so no task sorts all; ranges are stored, as their counts must be those of the rows that are numbered."""
    if not by:
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
        ranged = stored(ranged.withColumn("part_", F.shiftright("at_", 33)).withColumn("at_", F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
        starts, total = [], 0
        for r in sorted(ranged.groupBy("part_").agg(F.min("at_").alias("low"), F.count("*").alias("n")).collect()):  # a row a task
            starts.append((r.part_, total - r.low + 1))
            total += r.n
        begins = F.broadcast(df.sparkSession.createDataFrame(starts, "part_ long, start_ long"))
        return ranged.join(begins, "part_").withColumn("pos", F.col("at_") + F.col("start_")).drop("at_", "part_", "start_")
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def set_cells(df: DataFrame, changes: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """changes has pos (and by) and new values; a null there clears a cell. Rows that changes lacks stay."""
    keys = [*by, "pos"]
    new = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("touched_"))
    both = df.join(new, keys, "left")
    return both.select(*[F.when(F.col("touched_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def append_rows(df: DataFrame, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rows (with pos from 1) after the last; columns they lack are empty."""
    last = df.groupBy(*by).agg(F.max("pos").alias("last_"))
    moved = rows.join(last, list(by), "left") if by else rows.crossJoin(F.broadcast(last))  # one row
    return df.unionByName(moved.withColumn("pos", F.col("pos") + F.coalesce("last_", F.lit(0))).drop("last_"), allowMissingColumns=True)


def insert_rows(df: DataFrame, before: int, rows: DataFrame, n: int) -> DataFrame:
    """n rows (pos from 1) come in before a position; those from there on move down."""
    moved = df.withColumn("pos", F.when(F.col("pos") >= before, F.col("pos") + n).otherwise(F.col("pos")))
    return moved.unionByName(rows.withColumn("pos", F.col("pos") + (before - 1)), allowMissingColumns=True)


def delete_rows(df: DataFrame, first: int, last: int) -> DataFrame:
    """Positions first to last go, later ones move up. A table that loses all keeps one empty row."""
    left = df.filter(~F.col("pos").between(first, last)).withColumn("pos", F.when(F.col("pos") > last, F.col("pos") - (last - first + 1)).otherwise(F.col("pos")))
    none = df.filter(F.col("pos") == first).select(*[F.lit(1).cast("long").alias("pos") if c == "pos" else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
    all_gone = df.agg(F.min("pos").alias("a_"), F.max("pos").alias("z_")).filter((F.col("a_") >= first) & (F.col("z_") <= last)).select(F.lit(1).alias("gone_"))
    return left.unionByName(none.crossJoin(F.broadcast(all_gone)).drop("gone_"))  # one row at most


def set_type(df: DataFrame, column: str, kind: str, shown: Column | None = None) -> DataFrame:
    """text: the displayed text (shown); number: 1,234 and 92.3% and 00417; date: ISO text. A cell that can't be
    converted makes the query fail, as the whole operation is refused."""
    from tessera.functions.values import iso_date

    old = F.col(column)
    if kind == "text":
        return df.withColumn(column, shown if shown is not None else old.cast("string"))
    new = number_of(old) if kind == "number" else iso_date(old)
    bad = F.raise_error(F.concat(F.lit(f"{column}: not a {kind}: "), old))
    return df.withColumn(column, F.when(old.isNull(), None).when(new.isNull(), bad).otherwise(new))


def add_column(df: DataFrame, column: str, value: Column) -> DataFrame:
    """At the right edge; a name that is there, in any case, is refused."""
    if column.lower() in (c.lower() for c in df.columns):
        raise Refused([(0, f"column {column} is there")])
    return df.withColumn(column, value)


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, bool]], by: Sequence[str] = ()) -> DataFrame:
    """Positions anew by (cell column, descending), ties by old position; empty cells last either way."""
    order = [k for column, desc in keys for k in sort_keys(F.col(column), desc)]
    return numbered(df, [*order, F.col("pos").asc()], by)


#: Cells that one format operation writes at most.
MAX_FORMAT = 100_000


def format_range(styles: DataFrame, box: tuple[int, int, int, int], keys: dict[str, str]) -> DataFrame:
    """styles (row, col, style: map) with the keys written on a range (c0, r0, c1, r1): border stands for all four sides of
    each cell, outline for the sides at the range's edge; other keys as they are. Only written keys change."""
    c0, r0, c1, r1 = box
    if (c1 - c0 + 1) * (r1 - r0 + 1) > MAX_FORMAT:
        raise Refused([(0, f"more than {MAX_FORMAT} cells")])
    sides = ("top", "left", "bottom", "right")
    plain = {k: v for k, v in keys.items() if k not in ("border", "outline")} | ({f"border-{s}": keys["border"] for s in sides} if "border" in keys else {})
    inside = F.col("row").between(r0, r1) & F.col("col").between(c0, c1)
    out = format_cells(styles, inside, plain) if plain else styles
    if "outline" in keys:
        edges = {"top": F.col("row") == r0, "left": F.col("col") == c0, "bottom": F.col("row") == r1, "right": F.col("col") == c1}
        for s in sides:
            out = format_cells(out, inside & edges[s], {f"border-{s}": keys["outline"]})
    return out


def format_cells(styles: DataFrame, at: Column, keys: dict[str, str]) -> DataFrame:
    """style: map<string, string>; where at holds the written keys replace those of the cell, others stay."""
    from tessera.functions.values import overlay

    new = F.create_map(*[F.lit(x) for kv in sorted(keys.items()) for x in kv])
    return styles.withColumn("style", F.when(at, overlay(F.col("style"), new)).otherwise(F.col("style")))


# The range operations, and the columns' types.
OPS = ("set", "append_rows", "insert_rows", "delete_rows", "fill_formula", "set_type", "add_column", "sort", "add_table", "add_sheet", "format")
TYPES = ("text", "number", "date", "mixed")
# Fixed value: new rows that one list of operations adds at most, unless a book says otherwise.
MAX_NEW_ROWS = 50


class Book:
    """A catalogue of tables (name -> DataFrame with pos, column types), and operations applied all or none."""

    def __init__(self, tables: dict[str, tuple[DataFrame, dict[str, str]]], sheets: Sequence[str] = ("Sheet1",), formulas: dict[tuple[str, str], str] | None = None, budget: int = MAX_NEW_ROWS) -> None:
        """formulas: (table, column) -> the formula of a calculated column; budget: new rows of one list at most."""
        self.tables, self.sheets, self.formulas, self.budget = dict(tables), list(sheets), dict(formulas or {}), budget

    def named(self, name: str) -> str | None:
        return next((t for t in self.tables if t.lower() == str(name).lower()), None)

    def problem(self, op: dict, tables: dict[str, dict[str, str]], sheets: list[str]) -> str | None:
        """Why op can't follow those before it, whose effect on names and types tables and sheets have."""
        kind = op.get("op")
        if kind not in OPS:
            return f"unknown operation {kind}"
        if kind == "add_sheet":
            if op["sheet"] in sheets or not 0 < len(op["sheet"]) <= 31 or any(c in op["sheet"] for c in "[]:*?/\\"):
                return f"bad sheet name {op['sheet']}"
            sheets.append(op["sheet"])
            return None
        if kind == "add_table":
            if op["name"].lower() in (t.lower() for t in tables) or op["sheet"] not in sheets:
                return f"bad table {op['name']}"
            tables[op["name"]] = dict(op["columns"])
            return None
        table = next((t for t in tables if t.lower() == str(op.get("table")).lower()), None)
        if table is None:
            return f"unknown table {op.get('table')}"
        columns = tables[table]
        used = [*op.get("values", {}), *[c for r in op.get("rows", []) for c in r], *[k[0] for k in op.get("keys", [])]]
        used += [op["column"]] if kind in ("fill_formula", "set_type") else []
        if unknown := [c for c in used if c not in columns]:
            return f"unknown column {unknown[0]}"
        for c, v in [*op.get("values", {}).items(), *[x for r in op.get("rows", []) for x in r.items()]]:
            fits = v is None or columns[c] == "mixed" or isinstance(v, str) and columns[c] in ("text", "date") or isinstance(v, int | float) and not isinstance(v, bool) and columns[c] == "number"
            if not fits:
                return f"{v!r} is no {columns[c]} for {c}"
            if (table, c) in self.formulas and v is not None:
                return f"{c} is calculated; its cells can't be written"
        if kind in ("set", "delete_rows") and not 1 <= op["range"][0] <= op["range"][1]:
            return f"rows {op['range'][0]}:{op['range'][1]} are no data rows"
        if kind == "set_type":
            if op["type"] not in TYPES or {columns[op["column"]], op["type"]} == {"number", "date"}:
                return f"{op['column']} can't become {op['type']}"
            columns[op["column"]] = op["type"]
        if kind == "add_column":
            if op["column"].lower() in (c.lower() for c in columns):
                return f"column {op['column']} is there"
            columns[op["column"]] = op.get("type", "number")
        return None

    def apply(self, ops: Sequence[dict] | str) -> Book:
        """A new book with ops (dicts, or their JSON) applied in order, or Refused with all problems."""
        from tessera.plans.formula import FormulaError, fill, order, parse

        ops = json.loads(ops) if isinstance(ops, str) else ops
        tables, sheets = {t: dict(c) for t, (_, c) in self.tables.items()}, list(self.sheets)
        problems = []
        added = sum(len(op.get("rows") or []) for op in ops if op.get("op") in ("append_rows", "insert_rows", "add_table"))
        if added > self.budget:
            problems.append((len(ops) - 1, f"{added} new rows; at most {self.budget} in one list"))
        for i, op in enumerate(ops):
            try:
                if what := self.problem(op, tables, sheets):
                    problems.append((i, what))
                if "formula" in op:
                    parse(op["formula"])
            except (KeyError, FormulaError) as e:
                problems.append((i, f"{e}"))
        if problems:
            raise Refused(problems)
        out = Book(self.tables, sheets, self.formulas, self.budget)
        spark = next(iter(self.tables.values()))[0].sparkSession
        sql = {"text": "string", "number": "double", "date": "string", "mixed": "string"}
        for op in ops:
            kind = op["op"]
            if kind == "add_sheet":
                continue
            if kind == "add_table":
                columns = dict(op["columns"])
                rows = op.get("rows") or [{}]
                df = spark.createDataFrame([(k + 1, *[r.get(c) for c in columns]) for k, r in enumerate(rows)], "pos long, " + ", ".join(f"`{c}` {sql[t]}" for c, t in columns.items()))
                out.tables[op["name"]] = (df, columns)
                continue
            name = out.named(op["table"])
            df, columns = out.tables[name]
            if kind in ("append_rows", "insert_rows"):
                rows = op["rows"]
                new = spark.createDataFrame([(k + 1, *[None if r.get(c) is None else float(r[c]) if columns[c] == "number" else str(r[c]) for c in columns]) for k, r in enumerate(rows)], "pos long, " + ", ".join(f"`{c}` {sql[t]}" for c, t in columns.items()))
                df = append_rows(df, new) if kind == "append_rows" else insert_rows(df, op["before"], new, len(rows))
            elif kind == "delete_rows":
                df = delete_rows(df, *op["range"])
            elif kind == "set":
                for c, v in op["values"].items():
                    df = df.withColumn(c, F.when(F.col("pos").between(*op["range"]), F.lit(v).cast(dict(df.dtypes)[c])).otherwise(F.col(c)))
            elif kind == "fill_formula":
                out.formulas[(name, op["column"])] = op["formula"]
            elif kind == "set_type":
                df, columns = set_type(df, op["column"], op["type"]), columns | {op["column"]: op["type"]}
            elif kind == "add_column":
                t = op.get("type", "number")
                df, columns = add_column(df, op["column"], F.lit(None).cast(sql[t])), columns | {op["column"]: t}
            elif kind == "sort":
                from tessera.functions.values import cell

                temp = df
                for k, (c, _) in enumerate(op["keys"]):
                    temp = temp.withColumn(f"key_{k}", cell(F.col(c)) if columns[c] == "number" else cell(None, F.col(c)))
                df = sort_rows(temp, [(f"key_{k}", desc) for k, (_, desc) in enumerate(op["keys"])]).select(*df.columns)
            out.tables[name] = (df, columns)
            own = {c: f for (t, c), f in out.formulas.items() if t == name}
            if kind in ("append_rows", "insert_rows", "set", "fill_formula", "set_type"):  # calculated columns go down all rows
                for c in order(own):
                    df = fill(df, c, own[c], {t: x for t, (x, _) in out.tables.items()}).drop(f"{c}_err")
                out.tables[name] = (df, columns)
        return out
