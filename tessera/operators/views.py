"""Readings of a book: windows of ranges and tables, what is shown unasked, the whole book, and its structure as text.

A book here is four tables: sheets (sheet_no, sheet, kind), tables (sheet, name, c0, r0, c1, r1, header, totals), columns
(table, ord, name, type, format, formula) and cells (sheet, row, col, shown).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import refs
from tessera.functions.a1 import print_range
from tessera.functions.values import escape_cell
from tessera.operators import windows
from tessera.operators.windows import MAX_ROWS, WindowError

# Columns of a window at most, and the rows and columns that are shown unasked.
MAX_COLUMNS, DEFAULT_ROWS, DEFAULT_COLUMNS = 64, 50, 26


@dataclass(frozen=True)
class Book:
    sheets: DataFrame
    tables: DataFrame
    columns: DataFrame
    cells: DataFrame


def attr(text: Column) -> Column:
    """A text as an attribute's value."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def pipe(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(escape_cell(c.cast("string")), F.lit("")) for c in cells]), F.lit(" |"))


def box_of(text: str) -> tuple[int, int, int, int]:
    """(c0, r0, c1, r1) of A1 or A1:B2."""
    ends = [refs.CORNER.fullmatch(x) for x in text.split(":")]
    if not 1 <= len(ends) <= 2 or None in ends:
        raise WindowError(f"{text!r} is not a range such as A1:F50.")
    cols, rows = sorted(refs.number(e[2]) for e in ends), sorted(int(e[4]) for e in ends)
    return cols[0], rows[0], cols[-1], rows[-1]


def rows_of(cells: DataFrame, box: tuple[int, int, int, int], names: Sequence[str]) -> DataFrame:
    """(row, names): the shown texts of a range, blank rows included. Rows and columns outside are not read."""
    c0, r0, c1, r1 = box
    part = cells.filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    wide = part.groupBy("row").agg(*[F.max(F.when(F.col("col") == c0 + k, F.col("shown"))).alias(f"c{k}") for k in range(c1 - c0 + 1)])
    want = cells.sparkSession.range(r0, r1 + 1).withColumnRenamed("id", "row")
    return F.broadcast(want).join(wide.withColumn("row", F.col("row").cast("long")), "row", "left").toDF("row", *names)


def checked(rows: tuple[int, int], columns: int = 1) -> None:
    a, b = rows
    if not 1 <= a <= b:
        raise WindowError(f"rows {a}:{b}")
    if b - a + 1 > MAX_ROWS:
        raise WindowError(f"a window shows at most {MAX_ROWS} rows; ask for {a}:{a + MAX_ROWS - 1}.")
    if columns > MAX_COLUMNS:
        raise WindowError(f"a window shows at most {MAX_COLUMNS} columns.")


def range_window(book: Book, sheet: str, text: str) -> DataFrame:
    """(row, A, B, ...) of a sheet's range: MAX_ROWS rows and MAX_COLUMNS columns at most; no such sheet, or one without
    cells, is an error."""
    kind = book.sheets.filter(F.col("sheet") == sheet).select("kind").first()
    if kind is None:
        raise WindowError(f'there is no sheet "{sheet}".')
    if kind.kind != "work":
        raise WindowError(f'sheet "{sheet}" is a chart sheet; it has no cells.')
    box = box_of(text)
    checked((box[1], box[3]), box[2] - box[0] + 1)
    return rows_of(book.cells.filter(F.col("sheet") == sheet), box, [refs.letters(c) for c in range(box[0], box[2] + 1)])


def data_rows(t) -> tuple[int, int]:
    """The rows between the header and the totals of a table's row."""
    return t.r0 + int(t.header), t.r1 - int(t.totals)


def table_named(book: Book, name: str):
    """A table by its name in any case."""
    t = book.tables.filter(F.lower("name") == name.lower()).first()
    if t is None:
        raise WindowError(f'there is no table "{name}".')
    return t


def table_window(book: Book, name: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """(row, columns of the table) of its data rows by sheet row: those asked for, else the first MAX_ROWS."""
    t = table_named(book, name)
    first, last = data_rows(t)
    if rows is None:
        rows = (first, min(last, first + MAX_ROWS - 1))
    elif not first <= rows[0] <= rows[1] <= last:
        raise WindowError(f"rows {rows[0]}:{rows[1]} are not data rows of {t.name} (rows {first}:{last}).")
    names = [r.name for r in book.columns.filter(F.lower("table") == name.lower()).orderBy("ord").collect()]  # a sheet's width bounds them
    if rows[0] > rows[1]:
        return rows_of(book.cells.limit(0), (t.c0, 1, t.c1, 1), names).limit(0)
    checked(rows)
    return rows_of(book.cells.filter(F.col("sheet") == t.sheet), (t.c0, rows[0], t.c1, rows[1]), names)


def default_window(book: Book) -> DataFrame | None:
    """The first table's first rows; without tables the corner of the first sheet's used range; without cells nothing."""
    t = book.tables.join(book.sheets, "sheet").orderBy("sheet_no", "r0", "c0").first()
    if t is not None:
        first, last = data_rows(t)
        return table_window(book, t.name, (first, min(last, first + DEFAULT_ROWS - 1)) if first <= last else None)
    used = book.cells.join(book.sheets, "sheet").groupBy("sheet_no", "sheet").agg(F.min("col").alias("c0"), F.min("row").alias("r0"), F.max("col").alias("c1"), F.max("row").alias("r1")).orderBy("sheet_no").first()
    if used is None:
        return None
    box = used.c0, used.r0, min(used.c1, used.c0 + DEFAULT_COLUMNS - 1), min(used.r1, used.r0 + DEFAULT_ROWS - 1)
    return rows_of(book.cells.filter(F.col("sheet") == used.sheet), box, [refs.letters(c) for c in range(box[0], box[2] + 1)])


def window_text(spark: SparkSession, head: str, rows: DataFrame) -> DataFrame:
    """(seq, content): a window as a pipe table whose first column is the row, between its marks."""
    names = rows.columns
    top = [(0, 0, head), (0, 1, "| " + " | ".join(n.replace("\\", "\\\\").replace("|", "\\|") for n in names) + " |"), (0, 2, "|" + "---|" * len(names))]
    body = rows.select(F.lit(1).alias("part"), F.col(f"`{names[0]}`").cast("long").alias("at"), pipe([F.col(f"`{n}`") for n in names]).alias("content"))
    frame = spark.createDataFrame([*top, (2, 0, "</data>")], "part int, at long, content string")
    return frame.unionByName(body)


def structure(book: Book) -> DataFrame:
    """(sheet_no, part, at, content): the book as text lines: each sheet's mark with its used range, each of its tables with
    the table's columns. Marks and columns are rows of their own, in order of (sheet_no, part, at)."""
    used = book.cells.groupBy("sheet").agg(F.struct(F.min("col").alias("c0"), F.min("row").alias("r0"), F.max("col").alias("c1"), F.max("row").alias("r1")).alias("u"))
    sheets = book.sheets.join(used, "sheet", "left")
    opened = F.when(F.col("u").isNull(), F.concat(F.lit('<sheet name="'), attr(F.col("sheet")), F.lit('">'))).otherwise(F.concat(F.lit('<sheet name="'), attr(F.col("sheet")), F.lit('" range="'), print_range(F.col("u")), F.lit('">')))
    lines = sheets.select("sheet_no", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), opened.alias("content"))
    from pyspark.sql import Window

    own = book.tables.join(book.sheets.select("sheet", "sheet_no"), "sheet").withColumn("part", F.row_number().over(Window.partitionBy("sheet_no").orderBy("r0", "c0")))
    box = print_range(F.struct("c0", "r0", "c1", "r1"))
    head = F.array(F.concat(F.lit('<table name="'), attr(F.col("name")), F.lit('" range="'), box, F.lit('">')), F.lit("| column | type | format | formula |"), F.lit("|---|---|---|---|"))
    heads = own.select("sheet_no", "part", F.posexplode(head).alias("at", "content")).withColumn("at", F.col("at").cast("long"))
    columns = own.select("sheet_no", "part", F.lower("name").alias("t_")).join(book.columns.withColumn("t_", F.lower("table")), "t_")
    body = columns.select("sheet_no", "part", (F.col("ord") + 3).cast("long").alias("at"), pipe([F.col(c) for c in ("name", "type", "format", "formula")]).alias("content"))
    ends = own.select("sheet_no", "part", F.lit(1 << 20).cast("long").alias("at"), F.lit("</table>").alias("content"))
    close = book.sheets.select("sheet_no", F.lit(1 << 20).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("</sheet>").alias("content"))
    return reduce(DataFrame.unionByName, (lines, heads, body, ends, close))


def full_view(book: Book, rows: int = DEFAULT_ROWS) -> DataFrame:
    """structure(), with the first data rows of each table after it: (sheet_no, part, at, content), one plan for all tables.

    A data row holds its table's shown cells in order; blank rows of a table stand too.
    """
    from pyspark.sql import Window

    own = book.tables.join(book.sheets.select("sheet", "sheet_no"), "sheet").withColumn("part", F.row_number().over(Window.partitionBy("sheet_no").orderBy("r0", "c0")))
    own = own.withColumn("first", F.col("r0") + F.col("header").cast("int")).withColumn("last", F.least(F.col("r1") - F.col("totals").cast("int"), F.col("first") + rows - 1)).filter("first <= last")
    grid = own.select("sheet", "sheet_no", "part", "c0", "c1", F.explode(F.sequence("first", "last")).alias("row"))
    wide = grid.select("*", F.explode(F.sequence("c0", "c1")).alias("col")).join(book.cells.select("sheet", "row", "col", "shown"), ["sheet", "row", "col"], "left")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("shown", F.lit("")).alias("shown")))), lambda x: escape_cell(x["shown"]))
    body = wide.groupBy("sheet_no", "part", "row").agg(F.concat(F.lit("| "), F.array_join(F.concat(F.array(F.col("row").cast("string")), texts), " | "), F.lit(" |")).alias("content"))
    base = 1 << 21
    heads = own.withColumn("t_", F.lower("name")).join(book.columns.withColumn("t_", F.lower("table")).groupBy("t_").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: escape_cell(x["name"])).alias("names")), "t_")
    whole = F.col("last") == F.col("r1") - F.col("totals").cast("int")
    mark = F.concat(F.lit('<data table="'), attr(F.col("name")), F.when(whole, '">').otherwise(F.concat(F.lit('" rows="'), F.concat_ws(":", "first", "last"), F.lit('">'))))
    lines = F.array(mark, F.concat(F.lit("| row | "), F.array_join("names", " | "), F.lit(" |")), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("names") + 1)))
    tops = heads.select("sheet_no", "part", F.posexplode(lines).alias("at", "content")).withColumn("at", (F.col("at") + base).cast("long"))
    ends = own.select("sheet_no", "part", F.lit(1 << 23).cast("long").alias("at"), F.lit("</data>").alias("content"))
    return reduce(DataFrame.unionByName, (structure(book), tops, body.select("sheet_no", "part", (F.col("row") + base + 3).cast("long").alias("at"), "content"), ends))


def span(text: str, what: str) -> tuple[int, int]:
    """a:b, a-b or a, from 1."""
    m = re.fullmatch(r"\s*(\d+)(?:\s*[:-]\s*(\d+))?\s*", text)
    if not m or not 1 <= int(m[1]) <= int(m[2] or m[1]):
        raise WindowError(f"{what} {text!r} is not a span such as 2:10.")
    return int(m[1]), int(m[2] or m[1])


def read(docs: DataFrame | None = None, book: Book | None = None, *, lines: str | None = None, section: str | None = None, slides: str | None = None, table: str | None = None, rows: str | None = None, sheet: str | None = None, range: str | None = None) -> DataFrame | None:  # noqa: A002
    """One reading of texts (docs: doc_id, text) or of a book: at most one of lines, section and slides; a table, with rows
    or not; or a sheet's range, its sheet apart or before a !. Unasked, texts are read whole and books by default_window."""
    if sum(x is not None for x in (lines, section, slides)) > 1:
        raise WindowError("ask for one of lines, section and slides.")
    if table is not None and (sheet is not None or range is not None):
        raise WindowError("ask for a table (with rows) or a sheet with a range, not both.")
    if rows is not None and table is None:
        raise WindowError("rows are a table's: name the table too.")
    if sheet is not None and range is None:
        raise WindowError("name the range of the sheet too.")
    if book is not None:
        if table is not None:
            return table_window(book, table, span(rows, "rows") if rows is not None else None)
        if range is not None:
            own, cut, box = (range if sheet is None else f"{sheet}!{range.rpartition('!')[2]}").rpartition("!")
            if not cut:
                raise WindowError('name the sheet of the range: sheet and range, or range "Sheet1!A1:F50".')
            return range_window(book, own.strip("'").replace("''", "'"), box)
        return default_window(book)
    if lines is not None:
        return windows.line_window(docs, *span(lines, "lines"))
    if section is not None:
        return windows.section_window(docs, re.sub(r"^#{1,6} ", "", section))
    if slides is not None:
        a, b = span(slides, "slides")
        return slide_window(docs, a, b)
    return windows.lines(docs)


def slide_window(docs: DataFrame, first: int, last: int, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, slide, line, content) of slides first to last. Front matter, a block between --- at the very top, is no slide."""
    body = docs.select(by, F.regexp_replace(F.coalesce(text, F.lit("")), r"\A---[ \t]*\n(?:(?!---[ \t]*(?:\n|\z)).*\n)*---[ \t]*(?:\n|\z)", "").alias("text"))
    return windows.slides(body, by, "text").filter(F.col("slide").between(first, last)).select(by, "slide", "line", "content")


def keep_list(entries: DataFrame, by: Sequence[str] = ("doc_id", "rev")) -> DataFrame:
    """entries (by, seq, kind, id, label) -> (by, id, label, block): the placeholders of a revision, whether each stands as
    a block; of a repeated id the first."""
    own = entries.filter(F.col("kind").isin("keep", "bkeep"))
    return own.groupBy(*by, "id").agg(F.min_by("label", "seq").alias("label"), F.min_by(F.col("kind") == "bkeep", "seq").alias("block"))
